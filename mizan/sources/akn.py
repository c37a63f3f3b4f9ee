"""Legal XML documents as article rows; one file per task record, parsed where it is read.

Rows: file, ordinal (in the file), doc_id, article_ref, eid, text_ar, frbr_uri, doc_title, doc_date,
doc_type, ancestors, paragraphs. A file that is not well-formed, or has no body, gives no row; articles
without text are kept.
"""

from __future__ import annotations

import re
import xml.etree.ElementTree as ET
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "file string, ordinal int, doc_id string, article_ref string, eid string, text_ar string, frbr_uri string, doc_title string, doc_date string, doc_type string, ancestors map<string,string>, paragraphs array<string>"
CONTAINERS = ("book", "part", "title", "chapter", "section", "subsection")


def _tag(e: ET.Element) -> str:
    return e.tag.rpartition("}")[2] if isinstance(e.tag, str) else ""


def _said(e: ET.Element | None) -> str:
    return re.sub(r"\s+", " ", "".join(e.itertext())).strip() if e is not None else ""


def _child(e: ET.Element, name: str) -> ET.Element | None:
    return next((c for c in e.iter() if _tag(c) == name), None)


def document_id(number: str, date: str, stem: str) -> str:
    """number_date; a number that carries the date, or has none, stands alone; placeholders give way to
    the file's name."""
    if not number or number == "main" or number.startswith("["):
        return stem
    return number if not date or number == date or number.endswith(f"_{date}") else f"{number}_{date}"


def parse(xml: str, stem: str) -> list[dict]:
    try:
        root = ET.fromstring(xml)
    except ET.ParseError:
        return []
    body = _child(root, "body")
    if body is None:
        return []
    value = lambda n, a: (e.get(a) or "") if (e := _child(root, n)) is not None else ""
    uri = value("FRBRuri", "value") or value("FRBRthis", "value")
    parts = uri.strip("/").split("/")
    number, date = value("FRBRnumber", "value") or (parts[5] if len(parts) > 5 else ""), value("FRBRdate", "date") or (parts[4] if len(parts) > 4 else "")
    kind = parts[3] if len(parts) > 3 else ""
    out: list[dict] = []

    def walk(e: ET.Element, above: dict[str, str]) -> None:
        for c in e:
            name = _tag(c)
            if name == "article":
                pars = [t for p in c.iter() if _tag(p) in ("paragraph", "p") and (t := _said(p)) and not any(_tag(x) in ("paragraph", "p") for x in p)]
                num = re.sub(r"\s+", " ", _said(next((x for x in c if _tag(x) == "num"), None)))
                out.append({"ordinal": len(out), "doc_id": document_id(number, date, stem), "article_ref": num or (c.get("eId") or "").removeprefix("art_"), "eid": c.get("eId") or "", "text_ar": "\n".join(pars) or _said(_child(c, "content")), "frbr_uri": uri, "doc_title": _said(_child(root, "docTitle")), "doc_date": date, "doc_type": kind, "ancestors": dict(above), "paragraphs": pars})
            elif name in CONTAINERS:
                # of nested containers of one kind the outermost counts
                walk(c, {name: _said(next((x for x in c if _tag(x) == "num"), None)) or c.get("eId") or ""} | above)
            else:
                walk(c, above)

    walk(body, {})
    return out


def read_akn(spark: SparkSession, path: str) -> DataFrame:
    """All XML files under a path."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [{"file": f} | r for f, x in zip(b["file"], b["value"]) for r in parse(x, f.rpartition("/")[2].removesuffix(".xml"))]
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in SCHEMA.split(", ")])

    files = spark.read.text(path, wholetext=True, pathGlobFilter="*.xml").select(F.col("_metadata.file_path").alias("file"), "value")
    return files.mapInPandas(run, SCHEMA)
