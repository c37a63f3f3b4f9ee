"""One stored form for values that look the same on screen.

Values of one record's deliveries are mapped to a comparison form (invisible characters go, kinds of
space and width, presentation forms and look-alike letters fold), grouped under Spark's UNICODE
collation, which is accent- and case-sensitive and treats canonically equivalent sequences alike,
and joined back with the class's canonical member: the stored value with the fewest odd characters,
then the smallest in binary order. What a reader can see stays apart; where the collation itself
would ignore or equate visible characters (tatweel, digits of other scripts, signs above letters),
the comparison form replaces them by private-use characters, which it tells apart.

Defined results: null values belong to no class; empty and invisible-only values form one class;
equal values form no pair; repeated rows under other ordinals do if their values differ; long texts
take no special path.
"""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mizan.session import materialise

# --- fixed values ------------------------------------------------------------------------------
INVISIBLE = "\u00ad\u034f\u061c\u115f\u1160\u17b4\u17b5\u180b-\u180e\u200b-\u200f\u202a-\u202e\u2060-\u206f\u3164\ufe00-\ufe0f\ufeff\uffa0"
SPACES = "\t\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u202f\u205f\u3000"
# letters of other scripts that are drawn as a Latin letter
CYRILLIC = "АВЕКМНОРСТХаеорсухіјѕһԁІЈЅҮԛԝ"
AS_LATIN_C = "ABEKMHOPCTXaeopcyxijshdIJSYqw"
GREEK = "ΑΒΕΖΗΙΚΜΝΟΡΤΥΧο"
AS_LATIN_G = "ABEZHIKMNOPTYXo"
HYPHENS = "\u2010\u2011"
# Arabic-Indic and Persian digits share their shapes but for four, five and six
ARABIC_DIGITS = "٠١٢٣٤٥٦٧٨٩"
PERSIAN_DIGITS = "۰۱۲۳۴۵۶۷۸۹"
OWN_PERSIAN_SHAPES = "۴۵۶"
TATWEEL = "ـ"
# -----------------------------------------------------------------------------------------------

_PRIVATE = 0xE000


def _singles() -> tuple[str, str]:
    """Width variants and presentation forms that stand for one character, by Unicode's own tags."""
    src, dst = [], []
    for cp in [*range(0xFB50, 0xFDFC), *range(0xFE70, 0xFEFD), *range(0xFF01, 0xFFEF)]:
        tag, *to = unicodedata.decomposition(chr(cp)).split()[:1] + [unicodedata.normalize("NFKC", chr(cp))] if unicodedata.decomposition(chr(cp)) else ("",)
        if tag in ("<isolated>", "<initial>", "<medial>", "<final>", "<wide>", "<narrow>") and len(to[0]) == 1:
            src.append(chr(cp))
            dst.append(to[0])
    return "".join(src), "".join(dst)


def _kept_apart() -> tuple[str, str]:
    """Visible characters that the collation ignores or equates, and private-use stand-ins."""
    signs = [chr(c) for c in [*range(0x0610, 0x061B), *range(0x06D6, 0x06EE)] if chr(c) not in OWN_PERSIAN_SHAPES]
    apart = [TATWEEL, *ARABIC_DIGITS, *OWN_PERSIAN_SHAPES, *signs]
    to = {c: chr(_PRIVATE + i) for i, c in enumerate(apart)}
    to |= {p: to[a] for p, a in zip(PERSIAN_DIGITS, ARABIC_DIGITS) if p not in OWN_PERSIAN_SHAPES}
    return "".join(to), "".join(to.values())


_FORMS, _BASES = _singles()
_APART, _STAND_INS = _kept_apart()
_LAM_ALEF = {"[ﻵﻶ]": "لآ", "[ﻷﻸ]": "لأ", "[ﻹﻺ]": "لإ", "[ﻻﻼ]": "لا"}
_LETTER_NEXT = r"(?=\p{M}*\p{L})"
_ODD = (
    "[" + INVISIBLE + SPACES[1:] + r"\rﭐ-﷿ﹰ-ﻼ！-￯ٓ-ٕیکە۰-۹" + CYRILLIC + GREEK + HYPHENS + "]"
)


def comparison_form(c: Column) -> Column:
    """What the collation then compares. Null stays null."""
    t = F.regexp_replace(c, f"[{INVISIBLE}]", "")
    t = F.regexp_replace(t, r"\r\n?", "\n")
    for form, letters in _LAM_ALEF.items():
        t = F.regexp_replace(t, form, letters)
    t = F.translate(t, _FORMS + SPACES + CYRILLIC + GREEK + HYPHENS, _BASES + " " * len(SPACES) + AS_LATIN_C + AS_LATIN_G + "-" * len(HYPHENS))
    # Farsi yeh has its dots only where a letter follows; keheh differs from kaf only at a word's end
    t = F.regexp_replace(t, rf"ی(?:{_LETTER_NEXT}|(?=ٔ))", "ي")
    t = F.translate(t, "ی", "ى")
    t = F.regexp_replace(t, rf"ک{_LETTER_NEXT}", "ك")
    # ae is drawn as heh where no letter follows
    t = F.regexp_replace(t, r"ە(?!\p{M}*\p{L})", "ه")
    # the collation takes marks in canonical order: vowels, then shadda, then sukun and dagger alef
    for _ in range(2):
        t = F.regexp_replace(t, r"([\u0651\u0652\u0670])([\u064b-\u0650])", "$2$1")
    t = F.regexp_replace(t, r"([\u0652\u0670])\u0651", "\u0651$1")
    mapped = F.translate(t, _APART, _STAND_INS)
    # plain text without marks needs none of this
    plain = r"^[\n !-~\u0621-\u063a\u0641-\u064a،؛؟À-ÿ«»]*$"
    return F.when(c.rlike(plain), c).otherwise(mapped)


def odd_characters(c: Column) -> Column:
    """How many characters of a value have a plainer form."""
    return F.length(c) - F.length(F.regexp_replace(c, _ODD, ""))


def classes(df: DataFrame, key: tuple[str, ...], order: str, fields: tuple[str, ...]) -> DataFrame:
    """key, field_name, `order`, value, canonical of every value that shares its record and field
    with a differently stored one.
    """
    spark = df.sparkSession
    # narrow pass: records that have two stored forms in some field
    stored = [F.xxhash64(f) for f in fields]
    differs = [(F.min(h) != F.max(h)) & (F.count(F.col(f)) > 1) for f, h in zip(fields, [F.when(F.col(f).isNotNull(), s) for f, s in zip(fields, stored)])]
    flagged = df.groupBy(*key).agg(*[d.alias(f"_d{i}") for i, d in enumerate(differs)]).filter(" or ".join(f"_d{i}" for i in range(len(fields))))
    wide = df.select(*key, order, *fields).join(flagged, list(key))
    long = wide.select(
        *key, order, F.explode(F.array(*[F.when(F.col(f"_d{i}"), F.struct(F.lit(f).alias("field_name"), F.col(f).alias("value"))) for i, f in enumerate(fields)])).alias("v")
    ).select(*key, order, "v.field_name", "v.value").filter("field_name is not null and value is not null")
    # written once: the classes and the join back both read the forms
    values = materialise(long.withColumn("form", comparison_form(F.col("value"))).withColumn("odd", odd_characters(F.col("value"))))
    names = ", ".join(f"`{k}`" for k in key)
    on = " and ".join(f"v.`{k}` <=> c.`{k}`" for k in key)
    return spark.sql(
        f"""
        with c as (
          select {names}, field_name, collate(form, 'UNICODE') as class, min_by(value, struct(odd, value)) as canonical
          from {{values}} group by {names}, field_name, collate(form, 'UNICODE'))
        select {", ".join(f"v.`{k}`" for k in key)}, v.field_name, v.`{order}`, v.value, c.canonical
        from {{values}} v join c on {on} and v.field_name = c.field_name and collate(v.form, 'UNICODE') = c.class
        """,
        values=values,
    )


def canonical(df: DataFrame, key: tuple[str, ...], order: str, fields: tuple[str, ...]) -> DataFrame:
    """`df` with each field in its canonical form; rows that share nothing keep what they have."""
    changed = (
        classes(df, key, order, fields)
        .filter("value <> canonical")
        .groupBy(order)
        .agg(*[F.max(F.when(F.col("field_name") == f, F.col("canonical"))).alias(f"_c_{f}") for f in fields])
    )
    joined = df.join(changed, order, "left")
    return joined.withColumns({f: F.coalesce(F.col(f"_c_{f}"), F.col(f)) for f in fields}).drop(*[f"_c_{f}" for f in fields])


def pairs(members: DataFrame, key: tuple[str, ...], order: str) -> DataFrame:
    """field_name, ordinal_a, ordinal_b: members of one class that are stored differently."""
    m = members.select(*key, "field_name", F.col(order), F.md5("canonical").alias("class"), F.md5("value").alias("stored"))
    a = m.withColumnsRenamed({order: "ordinal_a", "stored": "stored_a"})
    b = m.withColumnsRenamed({order: "ordinal_b", "stored": "stored_b"})
    both = a.join(b, [*key, "field_name", "class"]).filter("ordinal_a < ordinal_b and stored_a <> stored_b")
    return both.select("field_name", "ordinal_a", "ordinal_b")
