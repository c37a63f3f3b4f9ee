"""Each operator on small rows: the dealt cases, nulls, empties, repeats, and brute force."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

pytest.importorskip("mizan.llm")
from mizan.llm import defects, garble, leaks, lookalike, mix, pieces, tokens  # noqa: E402

# --- p1 ---------------------------------------------------------------------------------------------


def test_controlled_rounding_keeps_both_margins():
    rnd = random.Random(2)
    for _ in range(200):
        have = [{j: rnd.randint(0, 9) for j in range(5) if rnd.random() < 0.7} for _ in range(4)]
        quota = [rnd.randint(0, sum(h.values())) if h else 0 for h in have]
        x = mix.controlled_rounding(quota, have)
        exact = [{j: q * a / sum(h.values()) if sum(h.values()) else 0.0 for j, a in h.items()} for q, h in zip(quota, have)]
        assert [sum(r.values()) for r in x] == quota
        for r, e, h in zip(x, exact, have):
            assert all(np.floor(e[j] - 1e-9) <= r[j] <= np.ceil(e[j] + 1e-9) and r[j] <= h[j] for j in r)
        for j in range(5):
            col, want = sum(r.get(j, 0) for r in x), sum(e.get(j, 0.0) for e in exact)
            assert np.floor(want + 1e-9) <= col <= np.ceil(want - 1e-9)


def test_sample_meets_quotas_and_reports(spark):
    rows = [(i, ["a", " A", "b", None][i % 4], "easy", ["ar", "fr"][i % 2]) for i in range(400)] * 2
    p = spark.createDataFrame([(*r, "x") for r in rows], "prediction_id long, query_type string, difficulty string, language string, needed string")
    t = spark.createDataFrame([(1, "A", "*", "*", 5000, 3, 2000), (1, "b", "*", "*", 2500, 3, 2000), (1, "zz", "*", "*", 2500, 3, 2000), (2, "*", "*", "ar", 10000, 1, 9000)], "request_id int, query_type string, difficulty string, language string, share_bp int, min_rows int, sample_bp int")
    got, report = mix.sample(p, t)
    r = {(x.request_id, x.query_type, x.language): (x.sample_size, x.needed, x.available, x.drawn) for x in report.collect()}
    assert r == {(1, "A", "*"): (80, 40, 200, 40), (1, "b", "*"): (80, 20, 100, 20), (1, "zz", "*"): (80, 20, 0, 0), (2, "*", "ar"): (360, 360, 200, 200)}
    drawn = got.collect()
    assert len(drawn) == len({(x.request_id, x.prediction_id) for x in drawn}) == 260
    assert {(x.request_id, x.query_type) for x in mix.unmet(report).collect()} == {(1, "zz"), (2, "*")}
    # exactly the smallest keys of an entry
    keys = {x.prediction_id: x.k for x in p.select("prediction_id", F.shiftrightunsigned(F.xxhash64(F.lit(20_240_601), F.lit(1).cast("bigint"), F.col("prediction_id")), 1).alias("k")).distinct().collect()}
    b = [i for i in range(400) if i % 4 == 2]
    assert {x.prediction_id for x in drawn if x.request_id == 1 and x.prediction_id % 4 == 2} == set(sorted(b, key=lambda i: keys[i])[:20])


def test_overlapping_cells_reach_the_largest_flow():
    rnd = random.Random(7)
    for _ in range(300):
        supply = {f"c{j}": rnd.randint(0, 9) for j in range(4)}
        matches = [{c: n for c, n in supply.items() if rnd.random() < 0.6} for _ in range(4)]
        wanted = [rnd.randint(0, sum(m.values())) for m in matches]
        x = [{} for _ in wanted]
        mix.fill_overlaps(x, matches, wanted)
        assert all(sum(r.get(c, 0) for r in x) <= n for c, n in supply.items())
        assert all(c in m and q >= 0 for r, m in zip(x, matches) for c, q in r.items()) and all(sum(r.values()) <= w for r, w in zip(x, wanted))
        # the smallest cut over all sets of cells
        sets = [[i for i in range(4) if k >> i & 1] for k in range(16)]
        cut = min(sum(supply[c] for c in {c for i in s for c in matches[i]}) + sum(w for i, w in enumerate(wanted) if i not in s) for s in sets)
        assert sum(sum(r.values()) for r in x) == cut


def test_overlapping_cells_share_what_is_there(spark):
    p = spark.createDataFrame([(i, "a", "easy", "ar") for i in range(100)], "prediction_id long, query_type string, difficulty string, language string")
    t = spark.createDataFrame([(1, "a", "*", "*", 6000, 0, 10000), (1, "*", "*", "ar", 4000, 0, 10000), (2, "a", "*", "*", 6000, 0, 10000), (2, "*", "*", "ar", 4000, 50, 10000)], "request_id int, query_type string, difficulty string, language string, share_bp int, min_rows int, sample_bp int")
    got, report = mix.sample(p, t)
    assert {(x.request_id, x.query_type): x.drawn for x in report.collect()} in ({(1, "a"): 60, (1, "*"): 40, (2, "a"): 60, (2, "*"): 40}, {(1, "a"): 60, (1, "*"): 40, (2, "a"): 50, (2, "*"): 50})
    rows = got.collect()
    assert len(rows) == len({(x.request_id, x.prediction_id) for x in rows}) == 200
    assert [(x.request_id, x.cause) for x in mix.shortfalls(report).collect()] == [(2, "contended")] and mix.unmet(report).count() == 0


def test_sample_of_nothing(spark):
    p = spark.createDataFrame([], "prediction_id long, query_type string, difficulty string, language string")
    t = spark.createDataFrame([(1, "*", "*", "*", 10000, 2, 5000)], "request_id int, query_type string, difficulty string, language string, share_bp int, min_rows int, sample_bp int")
    got, report = mix.sample(p, t)
    assert got.count() == 0 and [(x.needed, x.available, x.drawn) for x in report.collect()] == [(2, 0, 0)]


# --- p2 ---------------------------------------------------------------------------------------------


def test_cuts_hold_limits_and_are_lossless():
    rnd = random.Random(4)
    for _ in range(150):
        t = "".join(rnd.choice(["كلمة", "mot", " ", " ", ". ", "\n", "،  ", "\n\n", "é", "x" * rnd.randint(1, 50)]) for _ in range(rnd.randint(1, 200)))
        most, over = rnd.randint(8, 90), rnd.randint(0, 40)
        c = pieces.cuts(t, most, over)
        assert c[0][1] == 0 and c[-1][2] == len(t) and all(a[2] == b[1] for a, b in zip(c, c[1:]))
        assert all(e - r <= most and s - r <= over and r <= s < e or not t for r, s, e in c)


def test_cuts_prefer_pauses_and_survive_edits():
    rnd = random.Random(1)
    t = " ".join("".join(rnd.choice("abcdef") for _ in range(rnd.randint(2, 9))) + rnd.choice(["", "", "", ".", ","]) for _ in range(3000))
    c = pieces.cuts(t, 500, 50)
    assert all(t[e - 2] in ".," for _, _, e in c[:-1])
    edited = t[:7000] + "EDIT " + t[7000:]
    old, new = {t[s:e] for _, s, e in c}, [edited[s:e] for _, s, e in pieces.cuts(edited, 500, 50)]
    assert sum(x not in old for x in new) <= 4


def test_oversized_levels(spark):
    rows = [("a", "Article ", -1, "x " * 60), ("a", "Article ", -1, "x " * 60), ("b", None, -1, "y" * 101), ("c", "", 0, "z" * 60), ("d", "other", 0, "w" * 999), ("e", "article", -1, None), ("f", "paragraph", 1, "")]
    df = spark.createDataFrame([(*r, "k") for r in rows], "chunk_id string, granularity string, para_idx int, text string, level string")
    lim = spark.createDataFrame([("article", 100, 10), ("paragraph", 50, 5)], "granularity string, max_chars int, overlap_chars int")
    p = pieces.split_oversized(df, lim)
    assert {r.chunk_id for r in pieces.oversized_ids(p).collect()} == {"a", "b", "c"}
    assert {r.chunk_id for r in p.filter("n_pieces = 1").collect()} == {"d", "e", "f"}


# --- p4 ---------------------------------------------------------------------------------------------


def test_simple_defects():
    assert all(map(defects.is_empty, [None, "", " ​", "...", "N/A", "null", "؟"])) and not defects.is_empty("non")
    q = "هل يجوز للمدين أن يودع العقد؟"
    assert all(defects.is_copy(q, a) for a in [q, q + "\n" + q, "السؤال: " + q, "هل  يجوز للمدين ان يودع العقد ؟", '"' + q + '"'])
    assert not defects.is_copy(q, q + " نعم يجوز ذلك.") and not defects.is_copy(None, "x")
    assert defects.is_refusal("عذرا، لا أستطيع الإجابة عن هذا السؤال. يرجى استشارة محام.") and defects.is_refusal("I am unable to give legal advice!")
    assert not defects.is_refusal("لا يمكن للطرف المتخلف أن يحتج بجهله للنص.") and not defects.is_refusal("Je ne peux pas répondre. Le vendeur doit payer.")
    assert defects.is_broken("le vendeur doit (voir art") and defects.is_broken("نص.\nب -") and defects.is_broken("the seller,")
    assert defects.is_broken("Fini.") is False and defects.is_broken("sans point") is None and defects.is_broken("(art. 5)") is False


def test_copies_of_any_length():
    q = "هل يجوز للمدين أن يودع العقد لدى كتابة الضبط قبل انتهاء الأجل المحدد في المادة الخامسة من القانون؟ " * 3
    vowels = "".join(c + "َّ" if c.isalpha() else c for c in q)
    stretched, spread = "".join(c + "ـ" * 5 if c.isalpha() else c for c in q), " \n ".join(q.split()) + " . " * 200
    assert all(defects.is_copy(q, a) for a in [vowels * 2, stretched, spread, "السؤال: " + vowels + "\n" + "السؤال: " + vowels])
    assert not any(defects.is_copy(q, a) for a in [vowels * 3, vowels * 2 + " نعم", q + " نعم يجوز ذلك." * 50])


def test_language_and_truncation(spark):
    rnd = random.Random(6)
    fr, en = ["le vendeur doit payer la facture", "il est tenu de remettre le contrat de bail"], ["the seller must pay the invoice", "they are required to deliver the lease contract"]
    rows = []
    for i in range(240):
        bank, lang = (fr, "fr") if i % 2 else (en, "en")
        rows.append((i, rnd.choice(bank) + " ?", ". ".join(rnd.choice(bank) for _ in range(4)) + ".", lang, False))
    rows += [(900, fr[0] + " ?", en[1] + ". " + en[0] + ".", "fr", None), (901, fr[1] + " ?", fr[0] + ". il est tenu de remettre le", "fr", False), (902, fr[1] + " ?", fr[1] + ". " + fr[0], "fr", False)]
    rows += [(903, fr[0], None, None, False), (903, fr[0], None, None, False), (904, fr[0], "", "fr", True), (905, None, fr[0] + ". il est tenu de reme", "fr", False)]
    df = spark.createDataFrame([(*r, "d") for r in rows], "prediction_id long, query string, answer_text string, language string, predicted_abstain boolean, defect string")
    assert {(r[0], r[1]) for r in defects.find_defects(df).collect()} == {(900, "other_language"), (901, "truncated"), (903, "empty"), (905, "truncated")}
    assert defects.find_defects(df.filter(F.lit(False))).count() == 0


# --- p5 ---------------------------------------------------------------------------------------------

SAME = [("المستهلك", "\u200bالمستهلك"), ("أن", "أن"), ("18", "１８"), ("a b", "a b"), ("يجب", "یجب"), ("كتب", "کتب"), ("Art. 4", "Аrt. 4"), ("عقد", "ﻋﻘﺪ"), ("لا", "ﻻ"), ("رقَّم", "رقَّم"), ("a\r\nb", "a\nb"), ("٢", "۲"), ("", "​"), ("ؤ", "ؤ")]
APART = [("18", "١٨"), ("على", "علي"), ("ة", "ه"), ("أن", "ان"), ("يجَب", "يجب"), ("يـجب", "يجب"), ("a b", "a  b"), ("A", "a"), ("é", "e"), ("٤", "۴"), ("كتابك", "كتابک"), ("علی", "علي")]


def test_lookalikes(spark):
    rows = []
    for k, (a, b) in enumerate(SAME + APART):
        rows += [(f"d{k}", "e", 2 * k, a, None), (f"d{k}", "e", 2 * k + 1, b, None)]
    rows += [("n", "e", 900, None, None), ("n", "e", 901, "x", None), ("r", "e", 902, "y", None), ("r", "e", 903, "y", None)]
    df = spark.createDataFrame(rows, "doc_id string, eid string, ordinal long, t string, value string")
    m = lookalike.classes(df, ("doc_id", "eid"), "ordinal", ("t", "value"))
    got = {(r.ordinal_a, r.ordinal_b) for r in lookalike.pairs(m, ("doc_id", "eid"), "ordinal").collect()}
    assert got == {(2 * k, 2 * k + 1) for k in range(len(SAME))}
    forms = {r.ordinal: r.t for r in lookalike.canonical(df, ("doc_id", "eid"), "ordinal", ("t",)).collect()}
    assert all(forms[2 * k] == forms[2 * k + 1] for k in range(len(SAME))) and forms[900] is None and forms[7] == "a b"


# --- p6 ---------------------------------------------------------------------------------------------


def test_ids_equal_the_other_library(spark):
    tiktoken, P = pytest.importorskip("tiktoken"), pytest.importorskip("public_tokenizers")
    import base64

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_50k.tiktoken"), "rb"))}
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rnd = random.Random(8)
    parts = [" ", "  ", "\n", "\t", " ", "᠎", "'s", "a", "mot", "9", "é", "كلمة", "!", "<|endoftext|>", "😀", "\x1c"]
    texts = [None, "", " ", "   ", *("".join(rnd.choice(parts) for _ in range(rnd.randint(1, 30))) for _ in range(2000))]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, ids string")
    e = tokens.encode(df, with_offsets=True)
    back = {r.doc_id: r.text for r in tokens.decode(e).collect()}
    for r in e.collect():
        t = texts[r.doc_id] or ""
        assert r.ids == enc.encode_ordinary(t) and back[r.doc_id] == t
        assert len(r.starts) == len(r.ids) and (not t or (r.starts[0] == 0 and r.ends[-1] == len(t)))
    split = spark.createDataFrame([(1, enc.encode_ordinary("😀")[:1]), (2, None), (3, [])], "doc_id long, ids array<int>")
    assert {r.doc_id: r.text for r in tokens.decode(split).collect()} == {1: "�", 2: None, 3: ""}


# --- p7 ---------------------------------------------------------------------------------------------


def test_leaks(spark):
    rnd = random.Random(9)
    word = lambda: "".join(rnd.choice("abcdefghij") for _ in range(6))
    items = [(i, " ".join(word() for _ in range(25)) + " ?", " ".join(word() for _ in range(25))) for i in range(30)]
    noise = lambda n: " ".join(word() for _ in range(n))
    rows, want = [(1, None), (2, ""), (3, noise(100))], set()
    for k, (i, q, a) in enumerate(items[:12]):
        w = (q + " " + a).split()
        s = rnd.randint(0, 20)
        part = w[s : s + 24]
        part[5] = "changed"
        part[15] += " [7]"
        rows.append((100 + k, noise(40) + "\n" + ",  ".join(part).upper() + " " + noise(30)))
        want.add((100 + k, i))
        rows.append((200 + k, noise(20) + " " + " ".join(w[3:10]) + " " + noise(20)))
        every_other = [x if n % 3 else word() for n, x in enumerate(w)]
        rows.append((300 + k, " ".join(every_other)))
    rows.append((500, rows[3][1]))
    want.add((500, items[0][0]))
    docs = spark.createDataFrame([(*r, 0) for r in rows], "doc_id long, text string, item_id int")
    its = spark.createDataFrame(items, "item_id long, question string, ground_truth_answer string")
    assert {(r.doc_id, r.item_id) for r in leaks.find_leaks(docs, its).collect()} == want
    assert leaks.find_leaks(docs, its.filter(F.lit(False))).count() == 0


@pytest.mark.parametrize("at", [(0,), (1,), (13,), (14,), (0, 1), (1, 13), (13, 14), (6, 14)])
def test_leaks_of_fifteen_words_damaged_near_their_ends(at):
    words = [f"w{k}" for k in range(60)]
    ix = leaks.build_index([(7, " ".join(words))])
    swapped = [f"other{k}" if k in at else w for k, w in enumerate(words[20:35])]
    marked = [x for k, w in enumerate(words[20:35]) for x in ([w, "mark"] if k in at else [w])]
    for text in (swapped, marked):
        numbers = np.array([ix.vocabulary.get(w, 0) for w in ["x"] * 9 + text + ["y"] * 9], np.int32)
        _, part, n, share, alike = leaks.overlays(numbers, np.zeros(len(numbers), np.int32), ix)
        assert leaks.leaked(n, share, alike).any(), text
    short = np.array([ix.vocabulary.get(w, 0) for w in ["x"] * 9 + words[20:32] + ["y"] * 9], np.int32)
    assert not leaks.leaked(*leaks.overlays(short, np.zeros(len(short), np.int32), ix)[2:]).any()


def test_leaks_whose_rare_words_are_replaced_and_likeness_of_pattern():
    frame = [f"w{k}" for k in range(13)]
    fill = lambda a, b: " ".join([*frame[:4], a, *frame[4:9], b, *frame[9:]])
    # the frame is common to forty items, what fills it to none
    items = [(k, " ".join(f"i{k}x{j}" for j in range(10)) + " " + fill(f"a{k}", f"b{k}")) for k in range(40)]
    ix = leaks.build_index(items)

    def found(text):
        numbers = np.array([ix.vocabulary.get(w, 0) for w in text.split()], np.int32)
        _, part, n, share, lead = leaks.overlays(numbers, np.zeros(len(numbers), np.int32), ix)
        return set(ix.ids[part[leaks.leaked(n, share, lead)]].tolist())

    # rare words replaced: six weigh as much as thirteen common ones, two of twenty are one in ten
    rare = " ".join([*items[3][1].split()[3:8], "new", *items[3][1].split()[9:14], "new", *items[3][1].split()[15:23]])
    assert found(rare) == {3}
    # the words of item 5 fill the frame: no leak of the others
    assert found(fill("a5", "b5")) == {5}


def test_index_finds_all_within_radius():
    rnd = np.random.default_rng(3)
    items = [(i, " ".join(f"w{rnd.integers(0, 12)}" for _ in range(20))) for i in range(20)]
    ix = leaks.build_index(items)
    numbers = rnd.integers(0, len(ix.vocabulary) + 1, 400).astype(np.int32)
    fp = leaks.fingerprints(numbers, ix.signs)
    near = np.bitwise_count(fp[:, None] ^ ix.fingerprints[None, :]) <= leaks.RADIUS
    got = set(zip(*(x.tolist() for x in leaks.hits(numbers, ix))))
    assert got == set(zip(*(x.tolist() for x in np.nonzero(near))))


# --- p8 ---------------------------------------------------------------------------------------------


def test_garble(spark):
    rnd = random.Random(10)
    ar = "يجب على صاحب العمل أن يسلم شهادة العمل إلى الأجير قبل انتهاء العقد ويترتب على المخالفة غرامة في حالة القوة القاهرة".split()
    fr = "le vendeur doit présenter la déclaration à la conservation foncière dès la publication du règlement intérieur été".split()
    line = lambda b, n=25: " ".join(rnd.choice(b) for _ in range(n)) + "."
    rows = [(i, line(ar) + "\n" + line(ar) if i % 3 else line(fr, 40)) for i in range(600)]
    a, f = line(ar), line(fr, 30)
    bad = {
        1000: a.encode().decode("latin-1"), 1001: a.encode("cp1256").decode("latin-1"), 1002: line(ar) + "\n" + f.encode().decode("mac_roman"), 1003: a.encode().decode("latin-1").encode().decode("latin-1"),
        1004: "".join("?" if c.isalpha() else c for c in a), 1005: f.replace("é", "�"), 1006: f.encode("mac_roman").decode("latin-1"), 1007: a.encode("cp1256").decode("cp1251"),
    }
    good = {2000: None, 2001: "", 2002: "  ", 2003: line(ar) + "\n...... ???? ...... ؟؟؟", 2004: line(ar) + "\n§ 5 : 20 °C ± 2 ; ½ ; µ ; © ; ® € 8 £", 2005: line(fr) + " Ø 120 mm, Ù, Û, ß, Ð, œuvre, Ÿ", 2006: line(fr) + "\nКомиссия проверяет список требований.", 2007: "A DECLARAÇÃO DA NAÇÃO – CÂMARA, ÂGE, DÉPÔT", 2008: line(ar) + "\n⚖️ 📄 10", 2009: "is it ? yes ?? no"}
    df = spark.createDataFrame([(*r, "r") for r in [*rows, *bad.items(), *good.items()]], "doc_id long, text string, restored string")
    got = {r.doc_id: r.restored for r in garble.find_garbled(df).collect()}
    assert set(got) == set(bad)
    assert got[1000] == a and got[1001] == a and got[1003] == a and got[1007] == a
    assert garble.find_garbled(df.filter(F.lit(False))).count() == 0


@pytest.mark.parametrize("kind", ["cp1252", "mac_roman", "cp1256", "single"])
def test_garble_of_a_third_of_the_rows(kind):
    rnd = random.Random(12)
    ar = "يجب على صاحب العمل أن يسلم شهادة العمل إلى الأجير قبل انتهاء العقد ويترتب على المخالفة غرامة في حالة القوة القاهرة".split()
    fr = "le vendeur doit présenter la déclaration à la conservation foncière dès la publication du règlement intérieur été".split()
    read = lambda raw, page: "".join(chr(b) if (c := bytes([b]).decode(page, "replace")) == "�" else c for b in raw)
    harm = lambda t: read(t.encode("cp1256"), "cp1252") if kind == "single" else read(t.encode(), kind)
    line = lambda b, n=25: " ".join(rnd.choice(b) for _ in range(n)) + "."
    texts = [line(ar) if k % 3 else line(fr) if k % 2 else line(ar) for k in range(300)]
    bad = [harm(line(ar)) for _ in range(150)]
    stretch = []
    for _ in range(150):
        w = line(ar).split()
        stretch.append(" ".join([*w[:9], harm(" ".join(w[9:12])), *w[12:]]))
    good = ["\xa0", "Ø 120 mm, Ù, Û, ß, Ð, œuvre, Ÿ", line(fr) + " Ø 8 mm, Ù, Û, ß, Ð, œuvre, Ÿ"]
    every = [*texts, *bad, *stretch, *good]
    code, _ = garble._codes(every)
    sound = ~garble.damage(garble._points(every))
    both = sound[:-1] & sound[1:]
    pair, n = np.unique(np.stack([code[:-1][both], code[1:][both]]), axis=1, return_counts=True)
    model = garble.PairModel(pair[0], pair[1], n.astype(float))
    found = [garble.repair(t, garble._codes([t])[0], model)[0] for t in every]
    assert not any(found[: len(texts)]) and not any(found[-len(good) :])
    assert all(found[len(texts) : -len(good)])


def _model(texts):
    code, _ = garble._codes(texts)
    sound = ~garble.damage(garble._points(texts))
    both = sound[:-1] & sound[1:]
    pair, n = np.unique(np.stack([code[:-1][both], code[1:][both]]), axis=1, return_counts=True)
    return garble.PairModel(pair[0], pair[1], n.astype(float))


def test_restoration_in_a_mixed_corpus():
    rnd = random.Random(5)
    banks = [
        "يجب على صاحب العمل أن يسلم شهادة العمل إلى الأجير قبل انتهاء العقد ويترتب على المخالفة غرامة في حالة القوة القاهرة".split(),
        "le vendeur doit présenter la déclaration à la conservation foncière dès la publication du règlement intérieur été".split(),
        "a administração não altera a prestação anual após a notificação da petição de revisão".split(),
        "der Käufer muß die Gebühr für die Prüfung der Grundstücke über die Behörde zahlen".split(),
        "комиссия проверяет список требований до начала работ и сообщает о решении".split(),
    ]
    line = lambda b, n=25: " ".join(rnd.choice(b) for _ in range(n)) + "."
    model = _model([line(banks[k % 5]) for k in range(1000)])
    ar = line(banks[0], 8)
    utf = lambda t, page="cp1252": "".join(chr(b) if (c := bytes([b]).decode(page, "replace")) == "�" else c for b in t.encode())
    single = ar.encode("cp1256").decode("cp1252")
    cases = {
        # a damaged line before a sound one, a sound sentence before a damaged one
        utf(ar) + "\n" + ar: ar + "\n" + ar,
        ar + " " + utf(ar): ar + " " + ar,
        # a Latin name beside an Arabic comma; vowel marks; two stretches in one line
        utf(f"{ar} HMB، {ar}"): f"{ar} HMB، {ar}",
        "المصدّر مؤمَّن يجب على صاحب العمل".encode("cp1256").decode("cp1252"): "المصدّر مؤمَّن يجب على صاحب العمل",
        f"le vendeur doit {utf('présenter')} la facture du vendeur doit {utf('été')} la": "le vendeur doit présenter la facture du vendeur doit été la",
        # a single-byte page, then UTF-8
        utf(single): ar,
    }
    for bad, sound in cases.items():
        found, fixed = garble.repair(bad, garble._codes([bad])[0], model)
        assert found and fixed == sound, bad
    for t in ["Ø 120 mm, Ù, Û, ß, Ð, œuvre, Ÿ", *(line(b) + " Ø 8 mm, Ù, Û, ß, Ð, œuvre, Ÿ" for b in banks), *(line(b) for b in banks)]:
        assert not garble.repair(t, garble._codes([t])[0], model)[0], t
    shifted = line(banks[0]).encode("iso8859_6").decode("cp1256")
    assert garble.repair(shifted, garble._codes([shifted])[0], model)[0]
    assert garble.lost_letters("R?PUBLIQUE") and not garble.lost_letters("/a?b=C / is it? yes")
