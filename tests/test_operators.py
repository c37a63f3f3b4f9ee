import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from mizan.operators import asof, fusion, gates, graph, orphans, registry, retrieval
from mizan.sources import akn, turtle
from mizan.streaming.orphans import DELIVERY_SCHEMA, REF_SCHEMA, OrphanSink

DAY = dt.datetime(2024, 1, 1)


def day(n):
    return None if n is None else DAY + dt.timedelta(days=n)


REFS = [("s", "1", "d", "1", "art_1", 5), ("s", "2", "d", "1", "art_1", 1), ("s", "3", "d", "9", "art_9", 5), ("s", "4", "d", "2", "art_2", 5), ("s", "5", "d", "2", "art_2", 3), ("s", "5", "d", "2", "art_2", 3), ("s", "6", "e", "1", "art_1", None), ("s", "7", "d", "3", "art_3", 25)]
PARENTS = [("d", "art_1", 3, None), ("d", "art_1", 9, None), ("d", "art_2", 2, 4), ("d", "art_3", 1, 2), ("d", "art_3", 20, 30)]
WANT = {("2", "late"), ("3", "missing"), ("4", "deleted"), ("6", "missing")}


def tables(spark):
    r = spark.createDataFrame([(*x[:5], day(x[5])) for x in REFS], REF_SCHEMA)
    a = spark.createDataFrame([(d, e, day(l), day(x)) for d, e, l, x in PARENTS], DELIVERY_SCHEMA)
    return r, a


@pytest.mark.parametrize("steps", [1, 4])
def test_orphans_in_steps(spark, steps):
    r, a = tables(spark)
    state, counts = orphans.run(r.distinct(), a, steps)
    assert {(x.owner_key, x.ref_state) for x in orphans.found(state).collect()} == WANT
    assert counts.filter(F.col("step") == steps).agg(F.sum("n")).first()[0] == 4


def test_orphans_empty(spark):
    r, a = tables(spark)
    none = F.lit(False)
    assert orphans.found(orphans.run(r.filter(none), a.filter(none))[0]).count() == 0
    assert {x.ref_state for x in orphans.found(orphans.run(r.distinct(), a.filter(none))[0]).collect()} == {"missing"}


def test_orphan_stream_resolves_and_reopens(spark, tmp_path):
    sink = OrphanSink(str(tmp_path), 8)
    cols = ["kind", "src", "owner_key", "doc_id", "article_ref", "eid", "ref_time", "loaded_at", "deleted_at"]
    schema = "kind string, src string, owner_key string, doc_id string, article_ref string, eid string, ref_time timestamp_ntz, loaded_at timestamp_ntz, deleted_at timestamp_ntz"
    batches = [[("ref", "s", "1", "d", "1", "art_1", day(1), None, None)], [("delivery", None, None, "d", None, "art_1", None, day(2), None)], [("delivery", None, None, "d", None, "art_1", None, day(2), day(3))]]
    seen = []
    for k, b in enumerate(batches):
        sink(spark.createDataFrame(b, schema).select(*cols), k)
        seen.append([(x.ref_state, x.is_open) for x in sink.load(spark, k).orphans.collect()])
    assert seen == [[("missing", True)], [("late", False)], [("late", True)]]


def news(seed):
    """References and deliveries of few keys; deletions are rows of their own."""
    r = random.Random(seed)
    refs = [("s", str(k), "d", str(e), f"art_{e}", day(r.choice([None, *range(12)]))) for k in range(30) for e in [r.randrange(6)]]
    rows = [("ref", *x, None, None) for x in refs]
    for e in range(5):
        for at in r.sample(range(10), 3):
            rows.append(("delivery", None, None, "d", None, f"art_{e}", None, day(at), None))
            if r.random() < 0.6:
                rows.append(("delivery", None, None, "d", None, f"art_{e}", None, day(at), day(at + r.randrange(1, 5))))
    r.shuffle(rows)
    return rows


NEWS_SCHEMA = "kind string, src string, owner_key string, doc_id string, article_ref string, eid string, ref_time timestamp_ntz, loaded_at timestamp_ntz, deleted_at timestamp_ntz"


def brute_states(rows):
    """State of every reference from all rows at once."""
    gone = {}
    for x in rows:
        if x[0] == "delivery":
            gone.setdefault((x[3], x[5], x[7]), []).append(x[8])
    ends = {k: max((d for d in v if d), default=None) for k, v in gone.items()}
    out = set()
    for _, src, owner, d, ref, eid, t, _, _ in (x for x in rows if x[0] == "ref"):
        mine = {l: e for (dd, ee, l), e in ends.items() if (dd, ee) == (d, eid)}
        there = [e for l, e in mine.items() if t is not None and l <= t]
        s = "missing" if not mine else None if t is None else "late" if not there else "deleted" if all(e is not None and e <= t for e in there) else None
        out.add((owner, s, s is not None and not any(e is None for e in mine.values())))
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_orphan_steps_in_any_order_equal_one(spark, tmp_path, seed):
    rows, sink = news(seed), OrphanSink(str(tmp_path), 8)
    size = len(rows) // 3 + 1
    for k in range(3):
        batch = spark.createDataFrame(rows[k * size : (k + 1) * size], NEWS_SCHEMA)
        sink(batch, k)
        if k == 1:
            sink(batch, k)  # run again after a failure
    got = [(x.owner_key, x.ref_state, x.is_open) for x in sink.load(spark, 2).refs.collect()]
    assert len(got) == 30 and set(got) == brute_states(rows)


def test_late_deletion_reopens_a_sound_reference(spark, tmp_path):
    sink = OrphanSink(str(tmp_path), 8)
    other = [("ref", "s", str(k), "e", str(k), f"art_{k}", day(1), None, None) for k in range(40)]
    sink(spark.createDataFrame([("ref", "s", "1", "d", "1", "art_1", day(5), None, None), ("delivery", None, None, "d", None, "art_1", None, day(2), None), *other], NEWS_SCHEMA), 0)
    assert sink.load(spark, 0).orphans.filter("doc_id = 'd'").count() == 0
    sink(spark.createDataFrame([("delivery", None, None, "d", None, "art_1", None, day(2), day(4))], NEWS_SCHEMA), 1)
    assert [(x.ref_state, x.is_open) for x in sink.load(spark, 1).orphans.filter("doc_id = 'd'").collect()] == [("deleted", True)]
    # one bucket was written, the others are still read from the batch before
    assert sum(v == 1 for _, _, v in sink.manifest(spark, 1)) == 2 and sink.load(spark, 1).refs.count() == 41


def test_bm25_pads_and_ranks(spark):
    c = spark.createDataFrame([("a", "قانون العمل"), ("b", "قانون التجارة"), ("c", "نص آخر"), ("d", None)], "chunk_id string, text string")
    q = spark.createDataFrame([(1, "العمل"), (2, "")], "query_id int, query string")
    got = [tuple(r) for r in retrieval.bm25_search(retrieval.build_index(c), q, 3).orderBy("query_id", "rank").collect()]
    assert [(g[0], g[1], g[2]) for g in got] == [(1, 1, "a"), (1, 2, "b"), (1, 3, "c")] and got[0][3] > 0 and got[1][3] == 0


def test_dense_matches_brute_force(spark):
    import numpy as np

    v = np.random.default_rng(1).normal(size=(60, 8)).astype("float32")
    df = spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(v)] + [(99, None)], "vec_id long, embedding array<float>")
    got = retrieval.dense_search(df, df.filter("vec_id % 20 = 0"), 4).collect()
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    for q in (0, 20, 40):
        want = list(np.argsort(-(u @ u[q]), kind="stable")[:4])
        assert [r.chunk_id for r in sorted(got, key=lambda r: r.rank) if r.query_id == q] == want


def test_rrf_counts_repeats_and_keeps_first(spark):
    h = spark.createDataFrame([(1, 0, 1, "d", "1", 9.0), (1, 0, 2, "d", "2", 8.0), (1, 1, 1, "d", "2", 7.0), (1, 1, 2, "d", "2", 6.0)], "query_id int, list_no int, rank int, doc_id string, article_ref string, score double")
    got = [(r.article_ref, round(r.score, 6)) for r in fusion.rrf_fuse(h).orderBy("rank").collect()]
    assert got == [("2", round(1 / 62 + 1 / 61 + 1 / 62, 6)), ("1", round(1 / 61, 6))]
    assert [r.article_ref for r in fusion.weighted_fuse(h, {0: 1.0}).orderBy("rank").collect()] == ["1", "2"]
    assert fusion.dedup_hits(h.filter("list_no = 1").drop("list_no")).count() == 1


def test_routed_filter_falls_back(spark):
    h = spark.createDataFrame([(1, 1, "a"), (1, 2, "b"), (2, 1, "c")], "query_id int, rank int, doc_id string")
    r = spark.createDataFrame([(1, "b"), (2, "z")], "query_id int, doc_id string")
    assert sorted((x.query_id, x.doc_id) for x in fusion.keep_routed(h, r).collect()) == [(1, "b"), (2, "c")]


def test_as_of_ties(spark):
    t = spark.createDataFrame([(1, "k", 5), (2, "k", 1), (3, "x", 5)], "id int, k string, at int")
    v = spark.createDataFrame([("k", 2, "a", 0), ("k", 4, "b", 1), ("k", 4, "c", 2)], "k string, since int, text string, pos int")
    last = {r.id: r.version and r.version.text for r in asof.as_of(t, v, ["k"], "at", "since", "pos").collect()}
    first = {r.id: r.version and r.version.text for r in asof.as_of(t, v, ["k"], "at", "since", "pos", first_wins=True).collect()}
    assert last == {1: "c", 2: None, 3: None} and first[1] == "b"
    f = asof.with_fallback(asof.as_of(t, v, ["k"], "at", "since", "pos").withColumn("body", F.lit("base")), v, ["k"], "body")
    assert {(r.id, r.source, r.text) for r in f.collect()} == {(1, "version", "c"), (3, "fallback", "base")}


def test_span_gate(spark):
    rows = [("المادة الأولى تنص على حماية المستهلك.", "تنص على حِماية المستهلك"), ("x", "short"), (None, "some longer span"), ("abc", None), ("unrelated text here", "nothing of this stands there")]
    df = spark.createDataFrame(rows, "t string, s string")
    g = gates.span_supported(F.col("t"), F.col("s"))
    assert [r[0] for r in df.select(g["reason"]).collect()] == ["exact", "too_short", "no_article", "no_span", "absent"]


def test_aliases_and_registry(spark):
    a = spark.createDataFrame([("قانون العمل", "90-11"), ("loi x", None)], "alias string, doc_id string")
    n = spark.createDataFrame([("قانون العمل ",), ("LOI X",), ("90-11",), ("?",)], "name string")
    assert {r.name: r.doc_id for r in registry.resolve_aliases(n, a).collect()} == {"قانون العمل ": "90-11", "LOI X": None, "90-11": "90-11", "?": None}


def test_graph_pattern_and_tokens(spark):
    t = spark.createDataFrame([("d1", "type", "law"), ("d1", "has", "a1"), ("d2", "type", "decree"), ("d2", "has", "a2")], "s string, p string, o string")
    assert [tuple(r) for r in graph.bgp(t, [("?d", "type", "law"), ("?d", "has", "?a")]).collect()] == [("d1", "a1")]
    with pytest.raises(ValueError):
        graph.bgp(t, [("?d", "type", "law"), ("?x", "has", "?a")])
    texts = spark.createDataFrame([("a", "حماية المستهلك"), ("b", None)], "article string, text string")
    toks = spark.createDataFrame([(1, "مستهلك"), (1, "زز")], "query_id int, token string")
    assert [tuple(r) for r in graph.token_coverage(toks, graph.token_hits(texts, toks), 5).select("article", "score").collect()] == [("a", 1)]


def test_xml_keeps_mixed_content_and_empty_articles(spark, tmp_path):
    xml = '<akomaNtoso><act><meta><FRBRuri value="/akn/zz/act/law/1990-01-01/90-11/main"/><FRBRdate date="1990-01-01"/><FRBRnumber value="90-11"/></meta><body><title><num>I</num><article eId="art_1"><num>1</num><content><p>نص <ref>المادة 2</ref> آخر</p></content></article></title><article eId="art_2"><num>2</num></article></body></act></akomaNtoso>'
    (tmp_path / "a.xml").write_text(xml)
    (tmp_path / "bad.xml").write_text("<a><b></a>")
    (tmp_path / "nobody.xml").write_text("<a/>")
    got = akn.read_akn(spark, str(tmp_path)).orderBy("ordinal").collect()
    assert [(r.doc_id, r.article_ref, r.text_ar) for r in got] == [("90-11_1990-01-01", "1", "نص المادة 2 آخر"), ("90-11_1990-01-01", "2", "")] and got[0].ancestors == {"title": "I"}
    assert akn.document_id("main", "", "stem") == "stem" and akn.document_id("90-11_1990-01-01", "1990-01-01", "s") == "90-11_1990-01-01"


def test_turtle(spark, tmp_path):
    (tmp_path / "x.ttl").write_text('@prefix d: <http://d/> .\nd:a a d:Art ; d:t "نص; مع . نقطة"@ar , "2" ; d:on "1990-01-01"^^d:date .\n')
    got = {(r.s, r.p.rpartition("/")[2].rpartition("#")[2], r.o, r.lang, r.datatype) for r in turtle.read_turtle(spark, str(tmp_path)).collect()}
    assert got == {("http://d/a", "type", "http://d/Art", None, None), ("http://d/a", "t", "نص; مع . نقطة", "ar", None), ("http://d/a", "t", "2", None, None), ("http://d/a", "on", "1990-01-01", None, "http://d/date")}
