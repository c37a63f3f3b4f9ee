"""Text that was decoded with the wrong character encoding, found and, where possible, undone.

Adjacent characters are counted over the whole corpus, without those that look like damage by
themselves: the bytes of a readable UTF-8 character under some code page, and words of Latin letters
with marks. So damage that is frequent stays improbable. A pair's score is its share in the corpus's
mutual information, p(ab) log p(ab)/p(a)p(b) with the logarithm held within bounds, against the share that is usual for the corpus: common
combinations score above zero, combinations that the corpus hardly knows below. The maximum-scoring
segments of the negated scores are the improbable runs. Only there are inverse mappings tried: the
run is written back with the encoding it may have been read in and read with the one it may have
been written in, up to three times over. A mapping holds if what it gives is as probable as ordinary
text and clearly more so than the run. Letters that became replacement signs or question marks
cannot be undone; runs of them are reported all the same.

Defined results: null, empty and blank texts are sound; texts in rare languages and rare but correct
signs form improbable runs that no mapping explains, and stay; repeated rows are judged each; the
length of a text matters to nothing.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Code points that count one by one; all others count as their block of 1,024.
SINGLE = ((0x0, 0x180), (0x2B0, 0x300), (0x370, 0x530), (0x600, 0x700), (0x2000, 0x2070), (0x20A0, 0x20D0), (0x2100, 0x2150), (0x2190, 0x2300), (0x2500, 0x25D0), (0xFFF0, 0x10000))
#: Largest and smallest score of a pair.
CLIP = 4.0
#: How many times less than the usual share is neither probable nor improbable.
USUAL = 12
#: A segment counts from this score on; a mapping holds from these margins on.
MIN_SEGMENT, MIN_GAIN, MIN_RESULT = 4.0, 1.0, 0.0
#: Share of characters that a mapping may leave unreadable.
MAX_LOST = 0.15
STEP_DOCS = 500

#: Encodings that texts are read in by mistake.
READ_AS = ("cp1252", "mac_roman", "cp850", "cp437", "cp1251", "cp1256", "latin_1", "koi8_r", "cp866", "cp1250", "cp1253")
#: Encodings they were written in.
WRITTEN_IN = ("utf_8", "cp1256", "iso8859_6", "mac_roman", "cp850", "cp1252")
MAX_DEPTH = 3
#: What readable text holds above ASCII: Latin, Greek, Cyrillic, Arabic, and their punctuation.
READABLE = ((0xA0, 0x250), (0x370, 0x460), (0x600, 0x700), (0x2010, 0x203B), (0x20AC, 0x20AD), (0x2116, 0x2117), (0x2122, 0x2123))


@lru_cache(maxsize=1)
def _classes() -> tuple[np.ndarray, int]:
    """Class of every code point, and the number of classes (about 3,000)."""
    out = 2048 + (np.arange(0x110000) >> 10)
    k = 0
    for a, b in SINGLE:
        out[a:b] = np.arange(k, k + b - a)
        k += b - a
    out[0x30:0x3A] = out[0x30]
    return out.astype(np.int32), 2048 + 0x440


@lru_cache(maxsize=1)
def _testable() -> np.ndarray:
    """Per class: whether some inverse mapping may start from such a character."""
    classes, n = _classes()
    out = np.ones(n, bool)
    for a, b in ((0, 0x80), (0x60C, 0x60D), (0x61B, 0x61C), (0x61F, 0x653), (0x660, 0x66A)):
        out[classes[a:b]] = False
    return out


def _points(texts: list[str | None]) -> np.ndarray:
    """Code points of all texts, each between blanks."""
    joined = " " + " ".join(t or "" for t in texts) + " "
    return np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)


def _codes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Classes of all characters, each text between blanks, and where each text starts."""
    at = np.cumsum([1, *(len(t or "") + 1 for t in texts)])
    return _classes()[0][_points(texts)], at


@lru_cache(maxsize=1)
def _pages() -> list[np.ndarray]:
    """Per encoding of READ_AS: byte of every code point of the basic plane, 0 where it has none."""
    out = []
    for codec in READ_AS:
        page = np.zeros(0x10000, np.uint8)
        for c, b in _writer(codec).items():
            page[c] = b
        out.append(page)
    return out


@lru_cache(maxsize=1)
def _readable() -> np.ndarray:
    """Code points above ASCII of the basic plane that restored text may hold."""
    out = np.zeros(0x10000, bool)
    for a, b in READABLE:
        out[a:b] = True
    return out


def damage(point: np.ndarray) -> np.ndarray:
    """Which of the code points look like damage by themselves, whatever their frequency: those
    that under some code page are the bytes of a readable UTF-8 character, and words of which
    three letters in a row are Latin ones with marks, as Arabic read by single bytes gives."""
    out = np.zeros(len(point), bool)
    high = (point >= 0x80) & (point < 0x10000)
    # no code page has a plain Arabic letter where UTF-8 has the second byte of a character
    at = np.flatnonzero(high[:-1] & high[1:] & ~((point[1:] >= 0x621) & (point[1:] <= 0x652)))
    if not len(at):
        return out
    a, b = point[at], point[at + 1]
    c = np.where(at + 2 < len(point), point[np.minimum(at + 2, len(point) - 1)], 0)
    c[c >= 0x10000] = 0
    for page in _pages():
        x, y, z = page[a].astype(np.int32), page[b].astype(np.int32), page[c].astype(np.int32)
        second = (y >= 0x80) & (y < 0xC0)
        two = (x >= 0xC2) & (x < 0xE0) & second & _readable()[(x & 0x1F) << 6 | y & 0x3F]
        three = (x >= 0xE0) & (x < 0xF0) & second & (z >= 0x80) & (z < 0xC0) & _readable()[(x & 0xF) << 12 | (y & 0x3F) << 6 | z & 0x3F]
        some = at[two | three]
        out[some] = out[some + 1] = True
        out[at[three] + 2] = True
    marked = (point >= 0xC0) & (point < 0x180)
    row = at[marked[at] & marked[at + 1]]
    row = row[(row + 2 < len(point)) & marked[np.minimum(row + 2, len(point) - 1)]]
    if len(row):
        blank = np.flatnonzero((point == 0x20) | (point == 0x0A))
        word = np.unique(np.searchsorted(blank, row))
        edges = np.concatenate([[-1], blank, [len(point)]])
        for k in word:
            out[edges[k] + 1 : edges[k + 1]] = True
    return out


def pair_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """a, b, n: how often a character of class b follows one of class a, over all texts. What looks
    like damage by itself is not counted, or damage of one kind in many texts would look usual."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 2_000):
                texts = whole.slice(at, 2_000).column(0).to_pylist()
                code, _ = _codes(texts)
                sound = ~damage(_points(texts))
                seen, small = np.unique(code, return_inverse=True) if len(code) < 1 << 16 else _compact(code)
                both = small[:-1].astype(np.int64) * len(seen) + small[1:]
                n = np.bincount(both[sound[:-1] & sound[1:]], minlength=1)
                some = np.flatnonzero(n)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(seen[some // len(seen)].astype(np.int32)), pa.array(seen[some % len(seen)].astype(np.int32)), pa.array(n[some].astype(np.int64))], names=["a", "b", "n"]
                )

    part = docs.select(text).mapInArrow(run, "a int, b int, n bigint")
    return part.groupBy("a", "b").agg(F.sum("n").alias("n"))


def _compact(code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """np.unique with inverse, by counting."""
    seen = np.flatnonzero(np.bincount(code))
    where = np.zeros(int(seen[-1]) + 1, np.int32)
    where[seen] = np.arange(len(seen))
    return seen, where[code]


class PairModel:
    """Scores of adjacent characters. Its table is classes by classes at most, whatever the corpus."""

    def __init__(self, a: np.ndarray, b: np.ndarray, n: np.ndarray):
        seen = np.unique(np.concatenate([a, b, np.zeros(1, np.int32)]))
        self.where = np.full(_classes()[1], len(seen), np.int32)
        self.where[seen] = np.arange(len(seen))
        k = len(seen) + 1  # the last stands for classes never seen
        count = np.zeros((k, k))
        count[self.where[a], self.where[b]] = n
        total = max(count.sum(), 1.0)
        p = count / total
        left, right = p.sum(1), p.sum(0)
        with np.errstate(divide="ignore", invalid="ignore"):
            pmi = np.where(p > 0, np.log2(p / (left[:, None] * right[None, :])), 0)
        # damage of one kind ties its characters closely; information beyond the mean adds nothing
        mean = max(float((p * pmi).sum()), 1e-9)
        share = p * np.clip(pmi, mean / 4, mean)
        # the usual share: half of all pairs in the corpus have at least this much
        flat, weight = share.ravel(), p.ravel()
        order = np.argsort(-flat)
        usual = flat[order[min(np.searchsorted(np.cumsum(weight[order]), 0.5), len(order) - 1)]]
        usual = max(usual, 1e-12) / USUAL
        self.score = np.clip(np.log2(np.maximum(share, 1e-15) / usual), -CLIP, CLIP).astype(np.float32)

    def pairs(self, code: np.ndarray) -> np.ndarray:
        c = self.where[code]
        return self.score[c[:-1], c[1:]]

    def quality(self, text: str) -> float:
        """Mean score of a text's pairs, with a blank on either side."""
        return float(self.pairs(_codes([text])[0]).mean())

    def segments(self, code: np.ndarray, breaks: np.ndarray) -> list[tuple[int, int, float]]:
        """(first, past the last pair, score) of the best segment of every excursion of the
        negated scores above zero, and of what follows it in the excursion; no segment crosses a
        break. Segments that hold nothing but ASCII and plain Arabic letters are left out: no
        inverse mapping applies to them."""
        s = -self.pairs(code)
        s[breaks[breaks < len(s)]] = -1e6
        odd = np.concatenate([[0], np.cumsum(_testable()[code])])
        out, todo = [], [(0, len(s))]
        while todo:
            first, last = todo.pop()
            total = np.cumsum(s[first:last], dtype=np.float64)
            low = np.minimum.accumulate(np.concatenate([[0.0], total[:-1]]))
            high = total - low
            up = high > 0
            begin = np.flatnonzero(up & ~np.concatenate([[False], up[:-1]]))
            if not len(begin):
                continue
            peak = np.maximum.reduceat(np.where(up, high, 0), begin)
            ends = np.append(begin[1:], last - first)
            for k in np.flatnonzero(peak >= MIN_SEGMENT):
                a = first + int(begin[k])
                b = a + int(np.argmax(high[begin[k] : ends[k]])) + 1
                end = first + int(ends[k])
                if odd[b + 1] > odd[a]:
                    out.append((a, b, float(peak[k])))
                if odd[end] > odd[b]:
                    todo.append((b, end))
        return sorted(out)


class _Strict(dict):
    def __missing__(self, key):
        return 0xFFFF


@lru_cache(maxsize=32)
def _writer(codec: str) -> dict[int, int]:
    """Code point to byte; bytes that the codec does not define stand for themselves."""
    out = _Strict()
    for b in range(256):
        try:
            c = bytes([b]).decode(codec)
        except UnicodeDecodeError:
            c = chr(b)
        out.setdefault(ord(c), b)
    return out


def _bytes_of(text: str, codec: str) -> bytes | None:
    try:
        return text.translate(_writer(codec)).encode("latin-1")
    except UnicodeEncodeError:
        return None


# letters of two scripts side by side; Arabic commas and digits may follow any letter
_MIXED = re.compile("[A-Za-zÀ-ɏ][ء-ۓͰ-ԯ]|[ء-ۓͰ-ԯ][A-Za-zÀ-ɏ]|[Ͱ-ԯ][ء-ۓ]|[ء-ۓ][Ͱ-ԯ]")


# what restored text may consist of: Latin, Greek, Cyrillic, Arabic, and their punctuation
_PLAUSIBLE = re.compile("[\t\n -~\u00a0-\u024f\u0370-\u045f\u0600-\u06ff\u2010-\u203a\u20ac\u2116\u2122\ufffd]*")
_UTF8 = re.compile(rb"[\xc2-\xdf][\x80-\xbf]|[\xe0-\xef][\x80-\xbf]{2}|[\xf0-\xf4][\x80-\xbf]{3}")
# what else a damaged letter may have been: signs, vowel marks
_SIGNS = frozenset("’‘“”«»،؛؟ـًٌٍَُِّْ")
_ARABIC, _CYRILLIC = re.compile("[\u0600-\u06ff]"), re.compile("[\u0400-\u045f]")


def _undo_valid(text: str, raw: bytes) -> str:
    """`text` with only its valid UTF-8 sequences undone; one byte stands for one character."""
    out, done = [], 0
    for m in _UTF8.finditer(raw):
        try:
            out += [text[done : m.start()], m[0].decode("utf_8")]
        except UnicodeDecodeError:
            continue
        done = m.end()
    return "".join([*out, text[done:]])


def _in_words(text: str, out: str) -> bool:
    """Whether what a single-byte page changes lies in words for the greater part: any sign that
    stands alone would read as some letter."""
    changed = [k for k, (a, b) in enumerate(zip(text, out)) if a != b]
    inside = sum(out[max(k - 1, 0) : k].isalpha() or out[k + 1 : k + 2].isalpha() for k in changed)
    return inside > 0 and 2 * inside >= len(changed)


def inverse(run: str, model: PairModel) -> tuple[str, float, tuple[str, ...]] | None:
    """The most probable reading of a run by inverse mappings, if one holds, its gain, and the
    encodings in order: read in, written in, and so on."""
    before = None
    best: tuple[str, float, tuple[str, ...]] | None = None
    todo, seen = [(run, ())], {run}
    while todo:
        text, path = todo.pop()
        depth = len(path) // 2
        arabic, cyrillic = _ARABIC.search(text), _CYRILLIC.search(text)
        for wrong in READ_AS:
            # of the code pages only these have letters of those scripts
            if arabic and wrong != "cp1256" or cyrillic and wrong not in ("cp1251", "koi8_r", "cp866"):
                continue
            raw = _bytes_of(text, wrong)
            if raw is None or raw.isascii():
                continue
            for right in WRITTEN_IN:
                # within one script single-byte code pages are too much alike to tell apart, unless
                # one of them left Latin letters inside Arabic words
                if right == wrong or (arabic and right != "utf_8" and not (right == "iso8859_6" and _MIXED.search(text))):
                    continue
                if right == "utf_8" and not _UTF8.search(raw):
                    continue
                whole = raw.decode(right, "replace")
                outs = [whole]
                if right == "utf_8" and not arabic and "�" in whole:
                    # sound Latin letters beside damaged ones: undo only what is valid by itself
                    outs.append(_undo_valid(text, raw))
                for out in outs:
                    lost = out.count("�") - text.count("�")
                    if out in seen or lost > MAX_LOST * len(out):
                        continue
                    seen.add(out)
                    if right == "utf_8" and depth + 1 < MAX_DEPTH:
                        todo.append((out, (*path, wrong, right)))
                    if not _PLAUSIBLE.fullmatch(out) or _MIXED.search(out) or (lost and right != "utf_8"):
                        continue
                    if right != "utf_8" and any(a != b and not (b.isalpha() or b in _SIGNS) for a, b in zip(text, out)):
                        continue
                    if right != "utf_8" and not _in_words(text, out):
                        continue
                    before = model.quality(run) if before is None else before
                    after = model.quality(out)
                    gain = after - before
                    # a whole run that reads as UTF-8 is evidence by itself
                    holds = gain >= -MIN_GAIN / 2 if right == "utf_8" and not lost else after >= MIN_RESULT and gain >= MIN_GAIN
                    if holds and (best is None or gain > best[1]):
                        best = (out, gain, (*path, wrong, right))
    return best


def _changes(word: str, fixed: tuple[str, float, tuple[str, ...]]) -> bool:
    """Whether a word's reading rests on more than single letters: UTF-8 bytes come in sequences, of
    a single-byte page two neighbouring letters must change."""
    if fixed[2][-1] == "utf_8":
        return True
    same = [a == b for a, b in zip(word, fixed[0])]
    return any(not a and not b for a, b in zip(same, same[1:]))


def _by_words(run: str, model: PairModel) -> str | None:
    """A run that holds sound words beside damaged ones: the words that one and the same chain of
    mappings explains, if the run as a whole gains by it."""
    words = run.split(" ")
    fixed = [None if w.isascii() or len(w) < 2 else inverse(w, model) for w in words]
    fixed = [f if f and _changes(w, f) else None for w, f in zip(words, fixed)]
    chains = Counter(f[2] for f in fixed if f)
    if not chains:
        return None
    chain = max(chains, key=lambda c: (chains[c], c))
    new = " ".join(f[0] if f and f[2] == chain else w for w, f in zip(words, fixed))
    return new if model.quality(new) > model.quality(run) else None


_LOST_SIGN = re.compile("[^\\W\\d_]�|�[^\\W\\d_]|��")
_ASKED = re.compile(r"(?<![^\s(«\"])(?:\?+[ .,:;\n]*){2,}")
_INSIDE = re.compile(r"[a-zà-ÿ]\?[a-zà-ÿ]{2}|[A-ZÀ-Þ]\?[A-ZÀ-Þ]{2}|[ء-ي]\?[ء-ي]")


def lost_letters(text: str) -> bool:
    """Letters that became replacement signs or question marks.

    A line counts whose words are question marks of differing number, three words or more, or that
    has one in the middle of a word that is no link.
    """
    if "�" in text and _LOST_SIGN.search(text):
        return True
    if "?" not in text:
        return False
    for line in text.split("\n"):
        if "?" not in line:
            continue
        marks = [w.strip(".,:;()«»\"") for w in line.split()]
        longest, lengths = 0, []
        for w in [*marks, ""]:
            if w and set(w) == {"?"}:
                lengths.append(len(w))
            elif lengths and (w.isdigit() or w.rstrip("?").isdigit() or w.rstrip("?").isascii() and w[:1].isupper() and w.isupper()):
                continue  # numbers and acronyms keep their form amid lost letters
            else:
                if len(lengths) >= 2 and len(set(lengths)) > 1 and max(lengths) > 1:
                    longest = max(longest, len(lengths))
                lengths = []
        if longest >= 2:
            return True
        if any("//" not in w and "=" not in w and _INSIDE.search(w) for w in line.split()):
            return True
    return False


def repair(text: str, code: np.ndarray, model: PairModel) -> tuple[bool, str]:
    """(garbled, text with every explained run restored). `code`: the text's classes between blanks."""
    found, out, done = False, [], 0
    breaks = np.flatnonzero(code == _classes()[0][0x0A])
    runs: list[list[int]] = []
    for a, b, _ in model.segments(code, breaks):
        # pairs a..b cover the characters a-1 .. b-1 of the text; widen to whole words
        lo, hi = max(0, min(a - 1, len(text))), min(len(text), b)
        while lo < hi and text[lo] in " \n":
            lo += 1
        while hi > lo and text[hi - 1] in " \n":
            hi -= 1
        if lo == hi:
            continue
        while lo > 0 and text[lo - 1] not in " \n":
            lo -= 1
        while hi < len(text) and text[hi] not in " \n":
            hi += 1
        if runs and lo <= runs[-1][1] + 1 and "\n" not in text[runs[-1][1] : lo]:
            runs[-1][1] = max(runs[-1][1], hi)
        else:
            runs.append([lo, hi])
    for lo, hi in runs:
        run = text[lo:hi]
        if run.isascii():
            continue
        fixed = inverse(run, model)
        new = fixed[0] if fixed else _by_words(run, model) if " " in run else None
        if new is not None:
            found = True
            out += [text[done:lo], new]
            done = hi
    return found or lost_letters(text), "".join([*out, text[done:]]) if out else text


def fit(docs: DataFrame, text: str = "text") -> PairModel:
    """Counts over all texts, summed in Spark; what comes back is bounded by the classes."""
    pdf = pair_counts(docs, text).toPandas()
    return PairModel(pdf["a"].to_numpy(np.int32), pdf["b"].to_numpy(np.int32), pdf["n"].to_numpy(np.float64))


def find_garbled(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """`key`, restored: every text of which a stretch was decoded wrongly, as far as it is restored."""
    spark: SparkSession = docs.sparkSession
    kind = docs.schema[key].dataType.simpleString()
    shared = spark.sparkContext.broadcast(fit(docs, text))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: PairModel = shared.value
        line = _classes()[0][0x0A]
        for whole in batches:
            for a in range(0, whole.num_rows, STEP_DOCS):
                b = whole.slice(a, STEP_DOCS)
                texts = b.column(1).to_pylist()
                code, at = _codes(texts)
                # one screen over all texts of the step; a break at every border and line end
                breaks = np.concatenate([at - 1, np.flatnonzero(code == line)])
                owners = np.searchsorted(at, [s for s, _, _ in model.segments(code, breaks)], side="right") - 1
                asked = [k for k, t in enumerate(texts) if t and ("�" in t or "?" in t)]
                rows, texts_out = [], []
                for k in sorted({*owners.tolist(), *asked}):
                    t = texts[k] if 0 <= k < len(texts) else None
                    if not t:
                        continue
                    bad, fixed = repair(t, code[at[k] - 1 : at[k] + len(t) + 1], model)
                    if bad:
                        rows.append(int(k))
                        texts_out.append(fixed)
                if rows:
                    yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(rows)), pa.array(texts_out, pa.string())], names=[key, "restored"])

    return docs.select(F.col(key), F.col(text)).mapInArrow(run, f"`{key}` {kind}, restored string")
