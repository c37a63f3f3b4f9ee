"""A subset of Turtle as triples: prefixes, `a`, `;` and `,` lists, typed and tagged literals.

Rows: s, p, o, o_kind (iri or literal), datatype, lang, file. A file is read by one task.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "s string, p string, o string, o_kind string, datatype string, lang string, file string"
_TOKEN = re.compile(r'"""(?:[^"\\]|\\.|"(?!""))*"""|"(?:[^"\\\n]|\\.)*"|<[^<>]*>|#[^\n]*|@prefix|@[A-Za-z-]+|\^\^|[;,.](?=\s|$)|[^\s;,"<>^@]+?(?=[;,.]?(?:\s|$)|\^\^)', re.S)
_ESCAPE = {"n": "\n", "t": "\t", "r": "\r", '"': '"', "\\": "\\"}
RDF_TYPE = "http://www.w3.org/1999/02/22-rdf-syntax-ns#type"


def parse(text: str) -> list[tuple]:
    prefixes: dict[str, str] = {}

    def iri(t: str) -> str:
        if t.startswith("<"):
            return t[1:-1]
        p, _, rest = t.partition(":")
        return prefixes.get(p, p + ":") + rest

    tokens = [t for t in _TOKEN.findall(text) if not t.startswith("#")]
    out, i, s, p = [], 0, None, None
    while i < len(tokens):
        t = tokens[i]
        if t == "@prefix":
            prefixes[tokens[i + 1].rstrip(":")] = tokens[i + 2].strip("<>")
            i += 4
        elif t == ".":
            s = p = None
            i += 1
        elif t == ";":
            p = None
            i += 1
        elif t == ",":
            i += 1
        elif s is None:
            s, i = iri(t), i + 1
        elif p is None:
            p, i = RDF_TYPE if t == "a" else iri(t), i + 1
        elif t.startswith('"'):
            body = t[3:-3] if t.startswith('"""') else t[1:-1]
            body = re.sub(r"\\(.)", lambda m: _ESCAPE.get(m[1], m[1]), body)
            kind = lang = None
            if i + 2 < len(tokens) and tokens[i + 1] == "^^":
                kind, i = iri(tokens[i + 2]), i + 2
            elif i + 1 < len(tokens) and tokens[i + 1].startswith("@") and tokens[i + 1] != "@prefix":
                lang, i = tokens[i + 1][1:], i + 1
            out.append((s, p, body, "literal", kind, lang))
            i += 1
        else:
            number = re.fullmatch(r"[+-]?\d+(\.\d+)?|true|false", t)
            out.append((s, p, t if number else iri(t), "literal" if number else "iri", None, None))
            i += 1
    return out


def read_turtle(spark: SparkSession, path: str) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(*r, f) for f, x in zip(b["file"], b["value"]) for r in parse(x)]
            yield pd.DataFrame(rows, columns=["s", "p", "o", "o_kind", "datatype", "lang", "file"])

    files = spark.read.text(path, wholetext=True, pathGlobFilter="*.ttl").select(F.col("_metadata.file_path").alias("file"), "value")
    return files.mapInPandas(run, SCHEMA)
