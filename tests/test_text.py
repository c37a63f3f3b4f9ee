from pyspark.sql import functions as F

from mizan.functions import dates as D
from mizan.functions import text as T


def run(spark, values, *cols):
    df = spark.createDataFrame([(v,) for v in values], "x string")
    return [tuple(r) for r in df.select(*[c(F.col("x")) for c in cols]).collect()]


def test_article_refs(spark):
    want = {"1": "1", "١": "1", "art_1": "1", "الأولى": "1", "الاولي": "1", "Art. 4": "4", "المادة 4": "4", "9 مكرر": "9_bis", "9_bis": "9_bis", "9 bis": "9_bis", "9 مكرر 1": "9_bis_1", "9 مكرر(1)": "9_bis_1", "53 مكررة": "53_bis", "33 (معدلة)": "33", "": "", None: ""}
    assert [r[0] for r in run(spark, list(want), T.canonical_article_ref)] == list(want.values())
    assert run(spark, ["الأولى", ""], T.ref_to_eid) == [("art_1",), ("",)]


def test_normal_forms(spark):
    got = run(spark, ["أَحْمَدُ  ٢٣ مـوسى", "مسؤول", None, ""], T.normalize_arabic)
    assert got == [("احمد 23 موسي",), ("مسؤول",), ("",), ("",)]
    assert run(spark, ["Élève  Œuvre", None], T.normalize_french) == [("eleve uvre",), ("",)]
    assert run(spark, ["نص عربي", "texte", ""], T.detect_language) == [("ar",), ("fr",), ("ar",)]


def test_tokens_keep_law_ids(spark):
    (got,) = run(spark, ["والقانون 90-11، المادة 5"], T.bm25_tokens)
    assert got[0] == ["قانون", "90" + T.JOINER + "11", "مادة", "5"]
    assert run(spark, [None, "", "،؛"], T.bm25_tokens) == [([],), ([],), ([],)]


def test_citations_in_text(spark):
    got = run(spark, ["المادة 12 من القانون رقم 90-11 والمادة 7 مكرر 2", "Article 5 bis de la loi 84-11"], T.cited_articles)
    assert got == [(["12", "7 مكرر 2"],), (["5 bis"],)]
    assert run(spark, ["90-11 et 2014-05-06, 84-11."], T.law_ids) == [(["90-11", "84-11"],)]


def test_spans_and_splits(spark):
    assert run(spark, ["a#b", "a:b", "a/b", "a"], T.split_citation) == [(("a", "b"),), (("a", "b"),), (("a", "b"),), (("a", ""),)]
    assert run(spark, ["x" * 400], T.support_span)[0][0] == "x" * 280


def test_dates(spark):
    assert run(spark, ["2020-01-05", "5/1/2020", "2014", "nope", None], D.normalize_date) == [("2020-01-05",), ("2020-01-05",), ("2014-01-01",), (None,), (None,)]
    got = run(spark, ["le 3/2/2011 puis 2010-01-02 et 1999, loi 90-11"], D.dates_in)
    assert got == [(["2010-01-02", "2011-02-03", "1999-12-31"],)]
    assert run(spark, [""], lambda c: D.target_date(D.dates_in(c))) == [(D.SENTINEL,)]
