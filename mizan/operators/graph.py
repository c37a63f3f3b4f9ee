"""Triples and pattern matching on them: triples(s, p, o)."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from mizan.functions.text import normalize_arabic

#: Search tokens that one automaton holds in one pass over the texts.
TOKENS_PER_PASS = 200_000


def article_triples(articles: DataFrame) -> DataFrame:
    """Documents, articles and their texts as triples; distinct."""
    a = F.concat_ws("#", "doc_id", "eid")
    text = lambda s, p, o: F.struct(F.nullif(s, F.lit("\x00")).alias("s"), F.lit(p).alias("p"), F.nullif(o, F.lit("\x00")).alias("o"))
    parts = F.array(text(F.col("doc_id"), "hasArticle", a), text(a, "eId", F.col("eid")), text(a, "fullText", F.col("text_ar")), text(F.col("doc_id"), "title", F.col("doc_title")), text(F.col("doc_id"), "type", F.col("doc_type")))
    return articles.filter("doc_id is not null and eid is not null").select(F.explode(parts).alias("t")).select("t.s", "t.p", "t.o").filter("o is not null").distinct()


def bgp(triples: DataFrame, patterns: list[tuple[str, str, str]]) -> DataFrame:
    """Basic graph pattern: terms that begin with `?` are variables, all others constants. Each pattern is a
    filtered scan, joined with what came before on the variables they share; patterns that share none are
    refused, as they would multiply."""
    out: DataFrame | None = None
    for pattern in patterns:
        t, names = triples, {}
        for col, term in zip("spo", pattern):
            if term.startswith("?"):
                if term[1:] in names:
                    t = t.filter(F.col(col) == F.col(names[term[1:]]))
                names.setdefault(term[1:], col)
            else:
                t = t.filter(F.col(col) == term)
        t = t.select(*[F.col(c).alias(v) for v, c in names.items()])
        if out is None:
            out = t
        else:
            shared = [v for v in names if v in out.columns]
            if not shared:
                raise ValueError(f"pattern {pattern} shares no variable with those before it")
            out = out.join(t, shared)
    if out is None:
        raise ValueError("no pattern")
    return out.distinct()


def token_hits(texts: DataFrame, tokens: DataFrame, key: str = "article", text: str = "text") -> DataFrame:
    """(token, key) for every text that holds a token as a substring, normal forms on both sides.

    All tokens of all questions form one automaton per pass, so each text is read once however many
    questions there are.
    """
    wanted = tokens.select(normalize_arabic(F.col("token")).alias("token")).filter("token <> ''").distinct()
    kind = texts.schema[key].dataType.simpleString()
    n = max(1, -(-wanted.count() // TOKENS_PER_PASS))
    out = None
    for k in range(n):
        part = wanted.filter(F.pmod(F.xxhash64("token"), F.lit(n)) == k) if n > 1 else wanted
        shared = texts.sparkSession.sparkContext.broadcast([r.token for r in part.collect()])

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            import ahocorasick

            automaton = ahocorasick.Automaton()
            for w in shared.value:
                automaton.add_word(w, w)
            if shared.value:
                automaton.make_automaton()
            for b in batches:
                rows, words = [], []
                for i, t in enumerate(b.column(1).to_pylist()):
                    found = {w for _, w in automaton.iter(t)} if shared.value and t else ()
                    rows += [i] * len(found)
                    words += found
                yield pa.RecordBatch.from_arrays([pa.array(words, pa.string()), b.column(0).take(pa.array(rows, pa.int64()))], names=["token", key])

        hits = texts.select(F.col(key), normalize_arabic(F.col(text)).alias("t")).mapInArrow(run, f"token string, `{key}` {kind}")
        out = hits if out is None else out.unionByName(hits)
    return out.distinct()


def token_coverage(query_tokens: DataFrame, hits: DataFrame, k: int, key: str = "article") -> DataFrame:
    """Per query the k texts that hold most of its distinct tokens; ties by key."""
    q = query_tokens.select("query_id", normalize_arabic(F.col("token")).alias("token")).distinct()
    n = q.join(hits, "token").groupBy("query_id", key).agg(F.count(F.lit(1)).alias("score"))
    w = W.partitionBy("query_id").orderBy(F.desc("score"), key)
    return n.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def entity_lookup(labels: DataFrame, surfaces: DataFrame, k: int = 10) -> DataFrame:
    """surface, entity, label: the first k entities whose label(entity, label) holds a surface(token), without
    regard to case; each label is read once for all surfaces."""
    rows = labels.select("entity", "label", F.lower("label").alias("text"))
    hits = token_hits(rows, surfaces.select(F.lower("token").alias("token")), key="entity")
    w = W.partitionBy("token").orderBy("entity")
    first = hits.withColumn("_i", F.row_number().over(w)).filter(F.col("_i") <= k)
    return first.join(labels, "entity").select(F.col("token").alias("surface"), "entity", "label")


def articles_of(articles: DataFrame, k: int = 50) -> DataFrame:
    """The first k distinct articles of every document in file order."""
    once = articles.filter("doc_id is not null and eid is not null").groupBy("doc_id", "eid").agg(F.min("ordinal").alias("ordinal"))
    w = W.partitionBy("doc_id").orderBy("ordinal")
    return once.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= k)


def resolve_uri(uris: DataFrame, docs: DataFrame, uri: str = "uri") -> DataFrame:
    """`uris` with doc_id and article_ref: .../<date>/<number>/...#<article>; the document is registered under
    number_date, else under its number, else the number serves. A part below the article is cut off."""
    number, date = F.regexp_extract(uri, r"/\d{4}-\d{2}-\d{2}/([^/#]+)", 1), F.regexp_extract(uri, r"/(\d{4}-\d{2}-\d{2})/", 1)
    ref = F.regexp_extract(uri, r"#([^/#]+)", 1)
    parts = uris.withColumns({"_number": number, "_both": F.concat_ws("_", number, date), "article_ref": ref})
    known = docs.select("canonical_id").filter("canonical_id is not null").distinct()
    a = known.select(F.col("canonical_id").alias("_both"), F.col("canonical_id").alias("_a"))
    b = known.select(F.col("canonical_id").alias("_number"), F.col("canonical_id").alias("_b"))
    return parts.join(a, "_both", "left").join(b, "_number", "left").withColumn("doc_id", F.coalesce("_a", "_b", "_number")).drop("_number", "_both", "_a", "_b")
