import datetime as dt

import numpy as np
from pyspark.sql import functions as F

from mizan.operators import asof, gates, graph, registry, retrieval

D = lambda n: dt.datetime(2024, 1, n)


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_version_chain_and_upsert(spark):
    v = spark.createDataFrame([("a", 2, D(3)), ("a", 1, D(3)), ("a", 3, D(1)), (None, 4, D(1)), ("b", 5, None)], "k string, n long, at timestamp")
    assert [(r.n, r.version_no, r.until) for r in asof.version_chain(v, ["k"], "at", "n").orderBy("version_no").collect()] == [(3, 1, D(3)), (1, 2, D(3)), (2, 3, None)]
    assert asof.version_chain(v.filter(F.lit(False)), ["k"], "at", "n").count() == 0
    base, new = (spark.createDataFrame(x, "k string, v int") for x in ([("a", 1), ("b", 1), (None, 1), ("b", 1)], [("b", 2), (None, 2)]))
    assert rows(asof.upsert(base, new, ["k"])) == sorted([("a", 1), ("b", 2), (None, 1), (None, 2)], key=str)


def test_entities_articles_and_uris(spark):
    labels = spark.createDataFrame([(f"d{i:02}", f"Loi du Travail {i}") for i in range(12)] + [("x", None), (None, "travail")], "entity string, label string")
    words = spark.createDataFrame([("TRAVAIL",), ("travail",), (None,), ("",), ("zzz",)], "token string")
    got = graph.entity_lookup(labels.filter("entity is not null"), words).collect()
    assert len(got) == 10 and {r.surface for r in got} == {"travail"} and max(r.entity for r in got) == "d09"
    a = spark.createDataFrame([(i, "d", f"art_{i % 3}") for i in range(9)] + [(10, None, "art_1"), (11, "d", None)], "ordinal long, doc_id string, eid string")
    assert rows(graph.articles_of(a, 2).select("eid", "place")) == [("art_0", 1), ("art_1", 2)]
    u = spark.createDataFrame([("/akn/zz/act/law/1990-01-01/90-11/main#art_1/para_2",), ("/a/1991-01-01/91-05/m#art_2",), ("odd",), (None,)], "uri string")
    docs = spark.createDataFrame([("90-11_1990-01-01",), ("91-05",), (None,)], "canonical_id string")
    got = {r.uri: (r.doc_id, r.article_ref) for r in graph.resolve_uri(u, docs).collect()}
    assert got["/akn/zz/act/law/1990-01-01/90-11/main#art_1/para_2"] == ("90-11_1990-01-01", "art_1") and got["/a/1991-01-01/91-05/m#art_2"] == ("91-05", "art_2") and len(got) == 4


def test_audits(spark):
    used = spark.createDataFrame([("q1", "a"), ("q2", "a"), ("q2", "B "), ("q3", "c"), ("q3", "z"), ("q3", "z"), ("q4", None)], "question_id string, doc_id string")
    audit = registry.audit_ids(used, spark.createDataFrame([("a",)], "canonical_id string"), ["b"], ["C"])
    assert rows(audit) == [("B ", 1, "collision"), ("a", 2, "resolved"), ("c", 1, "missing"), ("z", 1, "unknown")]
    assert rows(registry.audit_questions(used, audit)) == [("z", "q3")]
    entries = spark.createDataFrame([("a", ["art_1", "art_2"]), ("a", ["art_1", "art_2"]), ("b", []), ("c", None)], "canonical_id string, article_eids array<string>")
    arts = spark.createDataFrame([("a", "art_1"), ("a", "art_1"), ("b", "art_9"), (None, "art_1")], "doc_id string, eid string")
    assert rows(registry.verify_corpus(entries, arts)) == [("a", 2, 1, 1, 0.5, True), ("b", 0, 1, 0, 0.0, True), ("c", 0, 0, 0, 0.0, False)]


def test_supervision_band(spark):
    c = "array<struct<doc_id:string,article_ref:string,text:string,supporting_span:string,confidence:double>>"
    one = lambda x: ("d", "1", None, None, x)
    df = spark.createDataFrame([(1, [one(0.5)] * 3), (2, [one(0.9)] * 3), (3, [one(None)] * 2), (4, []), (5, None)], f"i int, c {c}")
    got = {r.i: (r.a, r.b) for r in df.select("i", gates.should_supervise(F.col("c")).alias("a"), gates.should_supervise(F.col("c"), 2, 0.3, 0.8).alias("b")).collect()}
    assert got == {1: (True, True), 2: (True, False), 3: (False, False), 4: (False, False), 5: (False, False)}


def test_vectors_with_string_ids(spark):
    rng = np.random.default_rng(3)
    v = [(f"c{i:03}", [float(x) for x in rng.normal(size=8)]) for i in range(60)] + [("none", None), (None, [0.0] * 8)]
    v[7] = ("c007", v[3][1])
    df = spark.createDataFrame(v, "chunk_id string, vec array<double>").repartition(5)
    q = df.filter("chunk_id in ('c003', 'c010')").withColumnRenamed("chunk_id", "query_id")
    got = [(r.query_id, r["rank"], r.chunk_id) for r in retrieval.dense_search(df, q, 4, "chunk_id", "vec", query_id="query_id").orderBy("query_id", "rank").collect()]
    unit = {k: np.array(x) / np.linalg.norm(x) for k, x in v if k and x}
    want = [(a, i + 1, b) for a in ("c003", "c010") for i, b in enumerate(sorted(unit, key=lambda b: (-round(float(unit[a] @ unit[b]), 6), b))[:4])]
    assert got == want
    assert retrieval.dense_search(df, q.filter(F.lit(False)), 4, "chunk_id", "vec", query_id="query_id").count() == 0
    h = retrieval.hashed_vectors(spark.createDataFrame([(1, "b a"), (2, "a b"), (3, ""), (4, None)], "k int, t string"), "k", "t", "k").collect()
    assert len(h) == 2 and h[0].vec == h[1].vec and len(h[0].vec) == 256
