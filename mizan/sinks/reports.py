"""Results, metric trees and comparison tables as files. Only bounded roll-ups come to the driver."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MISSING = "—"


def write_predictions(results: DataFrame, path: str) -> None:
    """One JSON object per result and line."""
    results.write.mode("errorifexists").json(path)


def metric_tree(strata: DataFrame) -> dict:
    """Nested dict of a stratify() table: {dim: {value: {metric: mean}}}; bounded by the strata."""
    tree: dict = {}
    for r in strata.orderBy("dim", "value").collect():
        tree.setdefault(r["dim"], {})[r["value"]] = {k: v for k, v in r.asDict().items() if k not in ("dim", "value")}
    return tree


def write_metrics(strata: DataFrame, folder: str) -> None:
    """metrics.json and metrics.md."""
    out, tree = Path(folder), metric_tree(strata)
    out.mkdir(parents=True, exist_ok=True)
    (out / "metrics.json").write_text(json.dumps(tree, ensure_ascii=False, sort_keys=True, indent=1))
    lines = ["| metric | value |", "|---|---:|"]
    lines += [f"| {k} | {v:.4f} |" if isinstance(v, float) else f"| {k} | {v} |" for k, v in sorted(tree.get("overall", {}).get("all", {}).items())]
    (out / "metrics.md").write_text("\n".join(lines) + "\n")


def comparison_table(long: DataFrame, rows: str, columns: str, value: str) -> str:
    """Markdown pivot of a long table; missing cells get a dash."""
    cells = {(r[0], r[1]): r[2] for r in long.select(rows, columns, F.col(value)).collect()}
    names, heads = sorted({k[0] for k in cells}), sorted({k[1] for k in cells})
    show = lambda v: MISSING if v is None or v != v else f"{v:.3f}"
    return "\n".join([f"| {rows} | " + " | ".join(heads) + " |", "|---|" + "---:|" * len(heads), *(f"| {n} | " + " | ".join(show(cells.get((n, h))) for h in heads) + " |" for n in names)]) + "\n"
