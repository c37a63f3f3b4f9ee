"""Text normalisation and string scalars, as JVM-side Column expressions.

Every function takes and returns a Column. None/null input gives "" unless a docstring says
otherwise, empty text gives "", and very long texts need no special care: all steps are
single-pass regular expressions or ``translate``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Unicode white space as Python's str.isspace sees it (Java's \s is ASCII only).
WS = r"[\s\x1c-\x1f\x85\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
# Word characters as Python's \w sees them.
WORD = r"[\p{L}\p{N}_]"

# --- fixed values: letters and digits that the normal form folds -----------------------------
ALEF_FORMS, ALEF = "أإآٱ", "ا"
ALEF_MAKSURA, YA = "ى", "ي"
ARABIC_DIGITS = "٠١٢٣٤٥٦٧٨٩"
PERSIAN_DIGITS = "۰۱۲۳۴۵۶۷۸۹"
ASCII_DIGITS = "0123456789"
STRIPPED_MARKS = r"[ً-ٰٟـ]"
TA_MARBUTA, HA = "ة", "ه"
SUPPORT_SPAN = 280
# ---------------------------------------------------------------------------------------------

# base + hamza above -> composed letter; the marks that may stand between have a lower class
_BETWEEN = r"([ً-ْٰ]*)"
_COMPOSED = {"و": "ؤ", "ي": "ئ", "ہ": "ۂ", "ے": "ۓ", "ە": "ۀ"}
_HAMZA_ABOVE = "ٔ"


def strip_ws(c: Column) -> Column:
    """Python's str.strip over Unicode white space."""
    return F.regexp_replace(c, rf"^{WS}+|{WS}+$", "")


def squeeze_ws(c: Column) -> Column:
    """Runs of white space become one space; ends are trimmed."""
    return F.trim(F.regexp_replace(c, rf"{WS}+", " "))


def compose_arabic(c: Column) -> Column:
    """Canonical composition within Arabic script, for the letters that later folding keeps.

    The folded letters (alef forms) need none: their marks are stripped anyway.
    """
    out = c
    for base, composed in _COMPOSED.items():
        out = F.regexp_replace(out, base + _BETWEEN + _HAMZA_ABOVE, composed + "$1")
    return F.when(c.contains(_HAMZA_ABOVE), out).otherwise(c)


def normalize_arabic(c: Column, ta_marbuta: bool = False) -> Column:
    """Orthographic normal form of Arabic text (STR-1). Digits become ASCII before marks go."""
    c = compose_arabic(F.coalesce(c.cast("string"), F.lit("")))
    src = ALEF_FORMS + ALEF_MAKSURA + ARABIC_DIGITS + PERSIAN_DIGITS
    dst = ALEF * len(ALEF_FORMS) + YA + ASCII_DIGITS * 2
    c = F.regexp_replace(F.translate(c, src, dst), STRIPPED_MARKS, "")
    if ta_marbuta:
        c = F.translate(c, TA_MARBUTA, HA)
    return squeeze_ws(c)


# Every character whose canonical decomposition is an ASCII character and marks, by Unicode's rule.
def _ascii_fold() -> tuple[str, str]:
    import unicodedata

    src, dst = [], []
    for cp in range(0x80, 0x10000):
        d = unicodedata.normalize("NFD", chr(cp))
        if d != chr(cp) and d[0].isascii() and not d[1:].isascii() or (len(d) == 1 and d != chr(cp) and d.isascii()):
            src.append(chr(cp))
            dst.append(d[0])
    return "".join(src), "".join(dst)


_FOLD_SRC, _FOLD_DST = _ascii_fold()


def normalize_french(c: Column) -> Column:
    """ASCII folding, lower case, single spaces (STR-2): marks go, other non-ASCII goes too."""
    c = F.translate(F.coalesce(c.cast("string"), F.lit("")), _FOLD_SRC, _FOLD_DST)
    return squeeze_ws(F.lower(F.regexp_replace(c, r"[^\x00-\x7F]", "")))


def detect_language(c: Column) -> Column:
    """`ar` where over 15 % of the characters are of the Arabic block, else `fr`; empty: `ar`."""
    t = F.coalesce(c, F.lit(""))
    n = F.length(F.regexp_replace(t, r"[^\u0600-\u06ff]", ""))
    return F.when((F.length(t) == 0) | (n / F.greatest(F.length(t), F.lit(1)) > 0.15), "ar").otherwise("fr")


def normalize_query(c: Column) -> Column:
    """struct(norm, lang): the normal form of the detected language (STR-6)."""
    lang = detect_language(c)
    return F.struct(F.when(lang == "ar", normalize_arabic(c)).otherwise(normalize_french(c)).alias("norm"), lang.alias("lang"))


# --- fixed values: the written forms of an article reference ----------------------------------
ORDINALS = {
    "الاول": "1", "الاولي": "1", "اولي": "1",
    "الثانية": "2", "الثاني": "2",
    "الثالثة": "3", "الثالث": "3",
    "الرابعة": "4", "الرابع": "4",
    "الخامسة": "5", "الخامس": "5",
    "السادسة": "6", "السادس": "6",
    "السابعة": "7", "السابع": "7",
    "الثامنة": "8", "الثامن": "8",
    "التاسعة": "9", "التاسع": "9",
    "العاشرة": "10", "العاشر": "10",
}  # fmt: skip  (keys in normal form)
ARTICLE_WORDS = r"(?iu)^(?:المادة|مادة|Art\.|article|art)"
AMENDED = r"(?iu)\((?:WS)*(?:معدلة|معدله|modified|amended)(?:WS)*\)(?:WS)*$"
BIS_AR, BIS_LATIN = "مكرر", "bis"
# ---------------------------------------------------------------------------------------------


def canonical_article_ref(c: Column) -> Column:
    """The one token that all written forms of an article reference share (STR-3).

    `1`, `9_bis`, `9_bis_1` ...; null and empty give "". Steps: drop an `art_` prefix, normalise,
    drop the article word, drop an "(amended)" ending, map an ordinal word, turn both scripts'
    "bis" forms (numbered first) into `_bis[_n]`, join what is left by single underscores.
    """
    end = rf"(?!{WORD})"
    s = strip_ws(F.coalesce(c.cast("string"), F.lit("")))
    s = F.regexp_replace(s, r"(?iu)^art_", "")
    s = normalize_arabic(s)
    s = strip_ws(F.regexp_replace(s, ARTICLE_WORDS, ""))
    s = strip_ws(F.regexp_replace(s, AMENDED.replace("WS", WS), ""))
    b = F.regexp_replace(s, rf"{WS}*{BIS_AR}ة?{WS}*[(\s]*(\p{{Nd}}+){WS}*\)?", "_bis_$1")
    b = F.regexp_replace(b, rf"{WS}*{BIS_AR}ة?{end}", "_bis")
    b = F.regexp_replace(b, rf"(?iu)[\s_]*{BIS_LATIN}[\s_]*(\p{{Nd}}+)", "_bis_$1")
    b = F.regexp_replace(b, rf"(?iu)[\s_]*{BIS_LATIN}{end}", "_bis")
    b = F.lower(F.regexp_replace(F.regexp_replace(b, rf"(?:{WS}|_)+", "_"), "^_+|_+$", ""))
    words = F.create_map(*[F.lit(x) for kv in ORDINALS.items() for x in kv])
    return F.coalesce(F.try_element_at(words, s), b)


def ref_to_eid(c: Column) -> Column:
    """`art_` + canonical token, "" for an empty reference (STR-4)."""
    t = canonical_article_ref(c)
    return F.when(t == "", F.lit("")).otherwise(F.concat(F.lit("art_"), t))


# --- fixed values: the retrieval tokeniser -----------------------------------------------------
STEM_PREFIXES = ("وال", "بال", "كال", "فال", "لل", "ال", "و", "ب", "ك", "ف", "ل")
LEGAL_ID = r"(?<![\p{L}\p{N}_])\d{2,4}(?:[-_]\d{2,4})+(?![\p{L}\p{N}_])"
TOKEN_PUNCT = r"[\p{Punct}،؛؟]"
JOINER = "\ue001"
# ---------------------------------------------------------------------------------------------


def arabic_stem(t: Column) -> Column:
    """Strips the first listed prefix that leaves three characters or more; once only (STR-8)."""
    out = None
    for p in STEM_PREFIXES:
        hit = t.startswith(p) & (F.length(t) - len(p) >= 3)
        cut = F.substring(t, len(p) + 1, 1 << 30)
        out = F.when(hit, cut) if out is None else out.when(hit, cut)
    return out.otherwise(t)


def bm25_tokens(c: Column) -> Column:
    """array<string> of stemmed retrieval tokens; law ids such as 90-11 stay whole (STR-7)."""
    return tokens_of_normal(normalize_arabic(c))


def tokens_of_normal(t: Column) -> Column:
    """`bm25_tokens` of a column that is in normal form already, so that it is not computed anew in
    every branch of the expression."""
    # within a law id every separator sits between digits; protect it, then restore by the joiner
    ids = F.regexp_replace(t, rf"({LEGAL_ID})", JOINER + "$1" + JOINER)
    guarded = F.array_join(
        F.transform(
            F.split(ids, JOINER),
            lambda x: F.when(x.rlike(r"^\d{2,4}(?:[-_]\d{2,4})+$"), F.regexp_replace(x, "[-_]", JOINER)).otherwise(
                F.regexp_replace(x, TOKEN_PUNCT, " ")
            ),
        ),
        "",
    )
    parts = F.filter(F.split(F.when(t.rlike(LEGAL_ID), guarded).otherwise(F.regexp_replace(t, TOKEN_PUNCT, " ")), rf"{WS}+"), lambda x: x != "")
    return F.transform(parts, arabic_stem)


# --- fixed values: words that carry no topic ---------------------------------------------------
STOP_WORDS = (
    "ما", "هي", "هو", "هل", "ماذا", "لماذا", "كيف", "أين", "متى", "من", "ومن", "إلى", "عن", "على", "في", "مع", "كل", "بعض", "هذا", "هذه",
    "ذلك", "تلك", "الذي", "التي", "الذين", "اللاتي", "كان", "كانت", "يكون", "ليس", "ليست", "قد", "لقد", "أن", "إن", "أو", "أم", "ثم",
    "بين", "حتى", "لكن", "غير", "بدون", "ضد", "حسب", "وفق", "وفقا", "وفقًا", "بموجب", "هنا", "هناك", "أيضا", "أيضًا", "نفس",
    "ينبغي", "يجب", "يمكن", "يحق", "حق", "حقوق",
    "the", "a", "an", "and", "or", "of", "in", "to", "is", "are", "was", "were", "be", "been", "for", "on", "with", "as", "at", "by", "this",
    "that", "these", "those", "it", "its", "from", "what", "which", "who", "how", "why", "when", "where",
)
# ---------------------------------------------------------------------------------------------


def _words(c: Column) -> Column:
    """Runs of word characters of three or more."""
    return F.filter(F.split(F.coalesce(c, F.lit("")), r"[^\p{L}\p{N}_\u0600-\u06ff]+"), lambda t: F.length(t) >= 3)


def _bare(t: Column) -> Column:
    """A word of five letters or more without its article."""
    return F.when(t.startswith("ال") & (F.length(t) > 4), F.substring(t, 3, 1 << 30)).otherwise(t)


def _stops(t: Column) -> Column:
    return F.array_contains(F.array(*[F.lit(w) for w in STOP_WORDS]), t)


def graph_query_tokens(c: Column, limit: int | None = 8) -> Column:
    """Distinct topic words without their article, first-seen order, at most `limit`; without a limit
    repeats stay (STR-9, STR-10)."""
    t = F.filter(F.transform(_words(c), _bare), lambda x: ~_stops(x) & ~_stops(normalize_arabic(x)))
    return t if limit is None else F.slice(F.array_distinct(t), 1, limit)


def concept_tokens(c: Column) -> Column:
    """Topic words that keep their article; a stop word with an article goes too (STR-11)."""
    return F.filter(_words(c), lambda x: ~_stops(x) & ~_stops(_bare(x)))


def concept_phrases(c: Column) -> Column:
    """Up to 4 bigrams, 3 trigrams, then words of 4 letters; 8 in all, first seen (STR-12)."""
    t = concept_tokens(c)
    gram = lambda n: F.when(
        F.size(t) >= n, F.transform(F.sequence(F.lit(1), F.size(t) - (n - 1)), lambda i: F.array_join(F.slice(t, i, n), " "))
    ).otherwise(F.array().cast("array<string>"))
    two = F.slice(F.array_distinct(gram(2)), 1, 4)
    three = F.slice(F.array_distinct(gram(3)), 1, 3)
    return F.slice(F.array_distinct(F.concat(two, three, F.filter(t, lambda x: F.length(x) >= 4))), 1, 8)


def content_token_count(c: Column) -> Column:
    """Number of white-space tokens of two characters or more (STR-13)."""
    return F.size(F.filter(F.split(F.coalesce(c, F.lit("")), rf"{WS}+"), lambda t: F.length(t) >= 2))


def clauses(c: Column) -> Column:
    """Clauses between Arabic or Latin punctuation, trimmed, blanks dropped (STR-14)."""
    return F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), r"[،؛؟.,;:!?\n]+"), lambda t: F.trim(t)), lambda t: t != "")


def claims(c: Column) -> Column:
    """Sentences of 15 characters or more (STR-15)."""
    return F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), r"[.!?؟。\n]+\s*"), lambda t: F.trim(t)), lambda t: F.length(t) >= 15)


def support_span(c: Column) -> Column:
    """The head of a text that serves as its evidence span (STR-16)."""
    return F.substring(F.coalesce(c, F.lit("")), 1, SUPPORT_SPAN)


def choose_span(quote: Column, text: Column) -> Column:
    """The quote where the text holds it, else the head of the text (STR-24)."""
    ok = (F.coalesce(quote, F.lit("")) != "") & F.contains(F.coalesce(text, F.lit("")), quote)
    return F.when(ok, support_span(quote)).otherwise(support_span(text))


def template_answer(citations: Column) -> Column:
    """One sentence per citation, joined by a blank line; a missing title gives way to doc_id (STR-17)."""
    line = lambda x: F.concat(
        F.coalesce(F.nullif(x["doc_title"], F.lit("")), x["doc_id"]), F.lit(" — "), x["article_ref"], F.lit(": "), support_span(x["text"])
    )
    return F.array_join(F.transform(citations, line), "\n\n")


def first_json(c: Column, schema: str) -> Column:
    """The struct between the first `{` and the last `}`; null where that is no such JSON (STR-18, 19)."""
    return F.from_json(F.regexp_extract(c, r"(?s)\{.*\}", 0), schema)


def fenced_blocks(c: Column, label: str) -> Column:
    """Bodies of all fenced blocks with this label (STR-20)."""
    return F.regexp_extract_all(c, F.lit(rf"(?s)```{label}\s*\n(.*?)```"), F.lit(1))


def strip_thinking(c: Column) -> Column:
    """Text without its <think> sections (STR-20)."""
    return F.trim(F.regexp_replace(c, r"(?s)<think>.*?</think>", ""))


# --- fixed values: how a free text cites an article ---------------------------------------------
LAW_NUMBER_FORMS = (
    r"(?U)رقم\s*\d{2,4}[-/]\d{2,4}",
    r"(?U)(?:قانون|القانون|أمر|الأمر|مرسوم)\s*(?:رقم\s*)?\d{2,4}[-/]\d{2,4}",
    r"(?U)[Ll]oi\s*(?:n[°o]?\s*)?\d{2,4}[-/]\d{2,4}",
    r"(?U)\d{2,4}[-/]\d{2,4}[-/]\d{2,4}",
    r"(?U)\b\d{2}-\d{2,4}\b",
)
ARTICLE_CITATION_FORMS = (
    r"(?U)(?:المادة|المادّة|مادة)\s+(\d+(?:\s*(?:مكرر|مكرّر)(?:\s*\d+)?)?)",
    r"(?U)المواد\s+(\d+)",
    r"(?U)[Aa]rt(?:icle)?\.?\s*(\d+(?:\s*(?:bis|ter|quater))?)",
)
# ---------------------------------------------------------------------------------------------


def cited_articles(c: Column) -> Column:
    """Distinct article numbers that a free text cites; law numbers and dates are no articles (STR-21).

    Order: pattern by pattern, then position.
    """
    t = F.coalesce(c, F.lit(""))
    for p in LAW_NUMBER_FORMS:
        t = F.regexp_replace(t, p, "")
    found = [F.regexp_extract_all(t, F.lit(p), F.lit(1)) for p in ARTICLE_CITATION_FORMS]
    return F.array_distinct(F.transform(F.concat(*found), squeeze_ws))


def law_ids(c: Column) -> Column:
    """Distinct law numbers such as 90-11 in a text, in order; dates do not count (AGG-7)."""
    return F.array_distinct(F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(r"(?<![\d-])(\d{2}-\d{2,3})(?![\d-])"), F.lit(1)))


def split_citation(c: Column) -> Column:
    """struct(doc_id, article_ref) of `doc#ref`, `doc:ref` or `doc/ref`, in that order (JN-4)."""
    doc = F.when(c.contains("#"), F.substring_index(c, "#", 1)).when(c.contains(":"), F.substring_index(c, ":", 1)).when(c.contains("/"), F.substring_index(c, "/", 1)).otherwise(c)
    ref = F.when(F.length(c) > F.length(doc), F.substring(c, F.length(doc) + 2, F.length(c))).otherwise("")
    return F.struct(doc.alias("doc_id"), ref.alias("article_ref"))
