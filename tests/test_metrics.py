import math
import random

from pyspark.sql import functions as F

from mizan.functions import metrics as M
from mizan.operators import strata

ITEMS = list("abcdefgh")


def brute(p, g, k):
    h = [x in g for x in p[:k]]
    mrr = next((1 / (i + 1) for i, x in enumerate(h) if x), 0.0)
    rec = sum(h) / len(g) if g else 0.0
    dcg = lambda v: sum(x / math.log2(i + 2) for i, x in enumerate(v))
    ndcg = dcg(h) / dcg(sorted(h, reverse=True)) if any(h) else 0.0
    ap = sum(sum(h[: i + 1]) / (i + 1) for i, x in enumerate(h) if x) / len(g) if g else 0.0
    P, G = set(p), set(g)
    f1 = 1.0 if not p and not g else (2 * len(P & G) / (len(P) + len(G)) if P & G else 0.0)
    return mrr, rec, sum(h) / k, ndcg, ap, f1


def tau_b(p, g):
    place = [g.index(x) for x in p if x in g]
    n = len(place)
    if n < 2:
        return 0.0
    s = ties = 0
    for i in range(n):
        for j in range(i + 1, n):
            s += (place[j] > place[i]) - (place[j] < place[i])
            ties += place[i] == place[j]
    n0 = n * (n - 1) / 2
    return 0.0 if ties == n0 else s / math.sqrt(n0 * (n0 - ties))


def lcs(x, y):
    row = [0] * (len(y) + 1)
    for a in x:
        new = [0]
        for j, b in enumerate(y):
            new.append(row[j] + 1 if a == b else max(new[-1], row[j + 1]))
        row = new
    return row[-1]


def test_random_rankings(spark):
    rnd = random.Random(3)
    rows = [([rnd.choice(ITEMS) for _ in range(rnd.randint(0, 6))], rnd.sample(ITEMS, rnd.randint(0, 5))) for _ in range(120)] + [([], []), (["a"], [])]
    df = spark.createDataFrame([(i, p, g) for i, (p, g) in enumerate(rows)], "i int, p array<string>, g array<string>")
    p, g = F.col("p"), F.col("g")
    got = df.select("i", M.mrr_at_k(p, g, 3), M.recall_at_k(p, g, 3), M.precision_at_k(p, g, 3), M.ndcg_at_k(p, g, 3), M.map_at_k(p, g, 3), M.set_f1(p, g), M.kendall_tau(p, g)).collect()
    for r in got:
        want = (*brute(*rows[r[0]], 3), tau_b(*rows[r[0]]))
        assert all(abs(a - b) < 1e-9 for a, b in zip(r[1:], want)), (rows[r[0]], r, want)


def test_sequences(spark):
    rnd = random.Random(5)
    for _ in range(300):
        x, y = [rnd.choice("abc") for _ in range(rnd.randint(0, 9))], [rnd.choice("abcd") for _ in range(rnd.randint(0, 9))]
        assert (M.lcs_length(x, y) if x and y else 0) == lcs(x, y)
    df = spark.createDataFrame([("a b c", "a c", ["x y", "z"], ["x y", "z q", "w"]), (None, "", None, [])], "a string, b string, p array<string>, g array<string>")
    got = df.select(M.rouge_l(F.col("a"), F.col("b")), M.reasoning_chain_score(F.col("p"), F.col("g"))).collect()
    assert [round(x, 6) for x in got[0]] == [0.8, round((1 + 2 / 3 + 0) / 3, 6)] and list(got[1]) == [0.0, 0.0]


def test_groundedness_and_f1(spark):
    df = spark.createDataFrame([([("d", "1", "the big dog", None, None), ("d", "2", "cat", None, None)], "A BIG dog the big")], "c array<struct<doc_id:string,article_ref:string,text:string,supporting_span:string,confidence:double>>, a string")
    assert df.select(M.groundedness(F.col("c"), F.col("a"))).first()[0] == 0.5
    assert df.select(M.token_f1(F.lit("a a b"), F.lit("A c"))).first()[0] == 0.5


def test_strata(spark):
    rows = spark.createDataFrame([("x", "a", True, 1.0), ("x", None, False, None), ("", "b", None, 2.0)], "kind string, lang string, has_temporal_note boolean, m double")
    got = {(r.dim, r.value): (r.n, r.m) for r in strata.stratify(rows, ["m"], {"kind": "unknown", "lang": "ar"}).collect()}
    assert got == {("overall", "all"): (3, 1.0), ("kind", "x"): (2, 0.5), ("kind", "unknown"): (1, 2.0), ("lang", "a"): (1, 1.0), ("lang", "ar"): (1, 0.0), ("lang", "b"): (1, 2.0), ("temporal", "true"): (1, 1.0)}
