"""Prompt and response pairs that are unusable, with the kind of defect.

Kinds, in the order in which they are tried: `empty` (nothing said), `copy` (the prompt given back),
`refusal` (every sentence declines or makes way), `other_language`, `truncated`.

Languages are compared by a naive Bayes model of hashed character n-grams, counted over all labelled
rows into a table of fixed size per label: a pair counts if each side prefers its own best label
clearly to the other side's. Every label is kept, however rare; two labels of one language never
differ clearly. Quoted terms do not count. Refusals are known by fixed phrases and, in whatever
language, by a naive Bayes model of words: answers of rows with the abstain flag against all others.
Truncation is judged by how probable it is that a text ends after its last two
words: how often the corpus, all of it, ends a sentence there, and how often it has such a word
there at all. Rare words (names, and words broken off) count as one. Open brackets, list marks
without an item and dangling commas or hyphens tell by themselves.

Defined results: responses with an abstain flag that is true are no case, null counts as false; null,
empty, blank and invisible responses are `empty`; an empty prompt is copied by nothing; repeated
rows give one case; without labelled rows no language differs; lengths change nothing.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mizan.session import materialise

#: Hashed n-grams that the language model knows.
GRAM_BITS = 16
#: Letters that a text needs, and the least lead per n-gram, to be judged.
MIN_LETTERS, MIN_LEAD = 12, 0.15
#: Hashed words and pairs of words that the refusal model knows, weight of what both classes share, and
#: the least lead per word pair of an answer and of each of its sentences.
WORD_BITS, SHARED, MIN_REFUSAL, MIN_SENTENCE = 16, 200.0, 2.0, 0.5
#: Words rarer than this share of all words (and than RARE_COUNT, which rules below 600,000 words) count
#: as one rare word. The share, not the size of the corpus, decides: 200,000 words at most are frequent.
RARE_SHARE, RARE_COUNT = 5e-6, 3
#: An end is a break if its probability, or that of a rare word in its place, is below.
MIN_END, MIN_RARE, BACK_OFF = 0.01, 0.01, 20
STEP_ROWS = 1_000

# --- fixed values: how answers say nothing or decline ------------------------------------------
PLACEHOLDERS = {"null", "none", "nil", "nan", "na", "undefined", "empty", "tbd", "todo", "vide", "فارغ"}
LABEL = re.compile(r"^\W*(?:السؤال|سؤال|الجواب|جواب|الإجابة|الطلب|question|query|prompt|answer|réponse|demande|q|r|a)\s*[:：\-–—]\s*", re.I)
DECLINES = re.compile(
    r"أمتنع عن|أفضل عدم|أفضل ألا|لست قادر|لست مخول|لست في وضع|لا أستطيع|لا يمكنني|لا يسعني|لا أملك|لا أعرف|لا أدري|ليس بإمكاني|ليس بوسعي|ليس في وسعي|لم أجد ما|لا تتوفر لدي|غير متاح لي|لن أتمكن|لن أستطيع|"
    r"يسمح لي|خارج اختصاصي|خارج نطاقي|يتعذر علي|أعتذر عن|أرفض|"
    r"\bje ne (?:peux|saurais|suis|dispose|sais|souhaite|puis|veux)|\bje n'ai pas|\bje préfère|\bje dois décliner|\bje décline|\bje refuse|il m'est impossible|\bm'abstenir|aucune réponse ne peut vous|de mon domaine|mes compétences|que je suis autorisé|"
    r"\bi am (?:unable|not able|not in a position|not allowed)|\bi'm (?:unable|not able|sorry)|\bi (?:cannot|can't|can not|could not|do not have|don't have|don't know|will not|won't|must decline|have to decline|need to decline|decline|would rather not|prefer not|refuse|have no)|"
    r"beyond what i|outside (?:of )?my|not available to me|given by me|my (?:area|field|remit|scope)",
    re.I,
)
MAKES_WAY = re.compile(
    r"^(?:يرجى|أرجو|فأرجو|حاول|هل من|هل لديك|عذرا|المعذرة|أعتذر|للأسف|شكرا|آسف|veuillez|avez-vous|reformulez|adressez-vous|merci|désolé|navré|pardon|je regrette|please|is there|do you have|try|sorry|thank|unfortunately)", re.I
)
#: After these a sentence that declined goes on to answer.
HOWEVER = re.compile(r"لكن|غير أن|إلا أن|بيد أن|\b(?:mais|toutefois|cependant|néanmoins|but|however|nevertheless)\b", re.I)
# -----------------------------------------------------------------------------------------------

#: Letters of the longest label, at least.
LABEL_LETTERS = 10
_SAID, _LETTER = re.compile(r"[^\W_]+"), re.compile(r"[^\W_ـ]")
_SENTENCE = re.compile(r"[.!?؟\n]+")
_MARKS = re.compile("[ؐ-ًؚ-ٰٟـ̀-ͯ]")
_ALEF = str.maketrans("أإآٱىؤئة", "اااايويه")
_QUOTED = re.compile("«[^«»]*»|\"[^\"\n]*\"|“[^“”]*”")
_OPEN = {"(": ")", "[": "]", "{": "}", "«": "»", "“": "”"}
_BRACKET = {a: re.compile(f"[{re.escape(a + b)}]") for a, b in _OPEN.items()}
_LIST_MARK = re.compile(r"(?:^|\n)\s*(?:\d{1,3}\s*[-.)/]|[ء-ي]\s*[-.)/]|[A-Za-z]\s*[-.)]|[-•*–])\s*$")
_DANGLING = re.compile(r"[,،;؛:\-–—/]\s*$")


def letters_of(text: str) -> str:
    """Letters and digits only, without case, marks, and spelling variants."""
    t = unicodedata.normalize("NFKD", text).lower()
    t = _MARKS.sub("", t).translate(_ALEF)
    return "".join(str(unicodedata.digit(c)) if c.isdigit() and not c.isascii() else c for c in t if c.isalnum())


def is_empty(answer: str | None) -> bool:
    if next(islice(_SAID.finditer(answer or ""), 3, None), None):
        return False  # four words are no placeholder
    said = "".join(c for c in answer or "" if c.isalnum()).lower()
    return said == "" or said in PLACEHOLDERS


def is_copy(query: str | None, answer: str) -> bool:
    """The query once or twice, perhaps after a label, and nothing else."""
    q = letters_of(query or "")
    if not q:
        return False
    # marks, signs and strokes may make a copy of any length; its letters are bounded
    most = 2 * len(q) + LABEL_LETTERS * (1 + answer.count("\n"))
    if len(answer) > most and next(islice(_LETTER.finditer(answer), most, None), None):
        return False
    for a in {letters_of(answer), letters_of(LABEL.sub("", answer)), letters_of("\n".join(LABEL.sub("", x) for x in answer.split("\n")))}:
        if a == q or a == q + q:
            return True
    return False


def sentences_of(answer: str) -> Iterator[str]:
    """Sentences with letters, one by one: most answers are settled by their first."""
    start = 0
    while start < len(answer):
        m = _SENTENCE.search(answer, start)
        s, start = (answer[start : m.start()], m.end()) if m else (answer[start:], len(answer))
        s = s.strip()
        if any(c.isalnum() for c in s):
            yield s


def declines(sentence: str) -> bool:
    """A phrase that declines, after which the sentence does not turn to an answer. What it quotes is
    not its own; a turn to another phrase that declines is none."""
    s = _QUOTED.sub(" ", sentence)
    last = None
    for last in DECLINES.finditer(s):
        pass
    return last is not None and not HOWEVER.search(s, last.end())


def is_refusal(answer: str) -> bool:
    """Every sentence declines or makes way, and one declines."""
    declined = False
    for s in sentences_of(answer):
        if declines(s):
            declined = True
        elif not MAKES_WAY.search(s):
            return False
    return declined


def _unclosed(t: str) -> bool:
    """Whether a bracket is left open by the last line, or by the text after its last closing one."""
    for a, b in _OPEN.items():
        if a not in t or t.count(a) <= t.count(b) and "\n" not in t:
            continue
        if t.count(a) > t.count(b) and t.rfind(a) > t.rfind(b):
            return True
        depth = 0
        for m in _BRACKET[a].finditer(t, t.rfind("\n") + 1):
            depth = depth + 1 if m[0] == a else max(0, depth - 1)
        if depth:
            return True
    return False


def is_broken(answer: str) -> bool | None:
    """True: broken off beyond doubt; False: ends like a sentence; None: the last words must tell."""
    t = answer.rstrip()
    if _LIST_MARK.search(t) or _DANGLING.search(t):
        return True
    if _unclosed(t):
        return True
    end = t.rstrip("\"'»”’ ")
    if end.endswith(("…", "..")):
        return None
    return False if end.endswith((".", "!", "?", "؟", ")", "]", "۔", "。")) else None


# --- language ------------------------------------------------------------------------------------


def gram_codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed 2- and 3-grams of all texts, one each per character, and where each text starts."""
    clean = [" " + re.sub(r"[\W\d_]+", " ", _QUOTED.sub(" ", t)).strip().lower() + " " for t in texts]
    code = np.frombuffer("".join(clean).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    starts = np.cumsum([0, *map(len, clean)])[:-1]
    two = (code + np.roll(code, 1) * np.uint64(0x10001)) * np.uint64(0xC2B2AE3D27D4EB4F)
    three = (code + np.roll(code, 1) * np.uint64(0x10001) + np.roll(code, 2) * np.uint64(0x100000001B3)) * np.uint64(0x165667B19E3779F9)
    return np.stack([x >> np.uint64(64 - GRAM_BITS) for x in (two, three)]).astype(np.int64), starts


class LanguageModel:
    """Naive Bayes over hashed character n-grams; its size is fixed by labels and hash."""

    def __init__(self, labels: list[str], counts: np.ndarray):
        """counts: labels x 2 orders x n-grams."""
        self.labels = labels
        n = 1 << GRAM_BITS
        self.order = [np.log((counts[:, o] + 0.05) / (counts[:, o].sum(axis=1, keepdims=True) + 0.05 * n)).astype(np.float32) for o in range(2)]

    def scores(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """labels x texts: mean log likelihood per n-gram; and which texts are long enough to judge."""
        if not texts:
            return np.zeros((len(self.labels), 0)), np.zeros(0, bool)
        g, starts = gram_codes(texts)
        length = np.diff(np.append(starts, g.shape[1]))
        score = sum(np.add.reduceat(self.order[o][:, g[o]], starts, axis=1) for o in range(2)) / np.maximum(length, 1)
        return score, length >= MIN_LETTERS


def differ(query: np.ndarray, answer: np.ndarray) -> np.ndarray:
    """Which pairs of scores (labels x pairs each) are of two languages: each side prefers its own best
    label to the other's by MIN_LEAD."""
    if len(query) < 2:
        return np.zeros(query.shape[1], bool)
    at, q, a = np.arange(query.shape[1]), query.argmax(axis=0), answer.argmax(axis=0)
    return (query[q, at] - query[a, at] >= MIN_LEAD) & (answer[a, at] - answer[q, at] >= MIN_LEAD)


def fit_languages(pairs: DataFrame, query: str, answer: str, label: str) -> LanguageModel:
    """Counts of all labelled rows, summed in Spark; what comes back is bounded by the labels (half a
    megabyte each)."""
    named = pairs.select(F.lower(F.trim(label)).alias("label"), F.coalesce(answer, query).alias("text")).filter("text is not null and label <> ''")
    labels = sorted(r.label for r in named.select("label").distinct().collect())
    number = {x: k for k, x in enumerate(labels)}
    n = 1 << GRAM_BITS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for whole in batches:
            for at in range(0, whole.num_rows, STEP_ROWS):
                b = whole.slice(at, STEP_ROWS)
                by: dict[int, list[str]] = {}
                for x, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                    by.setdefault(number[x], []).append(t)
                for k, ts in by.items():
                    g, _ = gram_codes(ts)
                    own = sums.setdefault(k, np.zeros((2, n), np.int64))
                    for o in range(2):
                        own[o] += np.bincount(g[o], minlength=n)
        for k, own in sums.items():
            at = np.flatnonzero(own.ravel())
            yield pa.RecordBatch.from_arrays([pa.array((at + k * 2 * n).astype(np.int64)), pa.array(own.ravel()[at])], names=["at", "n"])

    part = named.mapInArrow(run, "at bigint, n bigint")
    table = np.zeros(len(labels) * 2 * n)
    r = part.groupBy("at").agg(F.sum("n").alias("n")).toArrow()
    table[r["at"].to_numpy()] = r["n"].to_numpy()
    return LanguageModel(labels, table.reshape(len(labels), 2, n))


# --- ends of texts ---------------------------------------------------------------------------------

_WORDS = re.compile(r"\w+")
_FULL_STOP = re.compile(r"[.!?؟](?:[^\w…]|_)*$")
RARE = np.uint64(1)
START = np.uint64(2)


def _hash(word: str) -> int:
    import hashlib

    return int.from_bytes(hashlib.blake2b(word.encode(), digest_size=8).digest(), "little") | 4


class _Words:
    """Numbers of the words of texts, with the ends of sentences; keeps what it has met."""

    def __init__(self):
        self.memo: dict[str, bytes] = {}

    def __call__(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Words of all texts one after the other, whether each ends a sentence, whether it is the first
        of its text, and the number of words of each text."""
        if len(self.memo) > 300_000:
            self.memo.clear()
        raw = " \x00 ".join([*((t or "").replace("\x00", " ").replace("\n", " \n ") for t in texts), ""]).split(" ")
        for w in set(raw) - self.memo.keys():
            if w in ("\n", "\x00"):
                # number 0 parts lines and texts
                self.memo[w] = np.array([[0, 1 if w == "\n" else 2]], np.uint64).tobytes()
                continue
            found = _WORDS.findall(w.lower())
            ends = bool(_FULL_STOP.search(w)) and ".." not in w
            self.memo[w] = np.array([[_hash("0" if x.isdigit() else x), ends and k + 1 == len(found)] for k, x in enumerate(found)], np.uint64).reshape(-1, 2).tobytes()
        a = np.frombuffer(b"".join(map(self.memo.__getitem__, raw)), np.uint64).reshape(-1, 2)
        word, flag = a[:, 0], a[:, 1]
        ends = flag == 1
        lines = np.flatnonzero((word == 0) & (flag == 1))
        ends[lines[lines > 0] - 1] = True
        is_word = word != 0
        after = np.flatnonzero((word == 0) & (flag == 2))
        upto = np.cumsum(is_word)[after] if len(after) else np.zeros(0, np.int64)
        size = np.diff(np.concatenate([[0], upto]))
        words, ends = word[is_word], ends[is_word]
        first = np.zeros(len(words), bool)
        first[(upto - size)[size > 0]] = True
        return words, ends, first, size


def _pair(u: np.ndarray, w: np.ndarray) -> np.ndarray:
    return ((u * np.uint64(0x9E3779B97F4A7C15)) ^ (w * np.uint64(0xC2B2AE3D27D4EB4F))).view(np.int64)


def _fold(words: np.ndarray, frequent: np.ndarray) -> np.ndarray:
    if not len(frequent):
        return np.full_like(words, RARE)
    at = np.minimum(np.searchsorted(frequent, words), len(frequent) - 1)
    return np.where(frequent[at] == words, words, RARE)


class RefusalModel:
    """Naive Bayes of hashed words and pairs of words: answers that came with an abstain flag against
    the rest. What both classes lack tells nothing."""

    def __init__(self, counts: np.ndarray):
        """counts: other or abstained x words."""
        total = counts.sum(axis=1, keepdims=True)
        shared = SHARED * counts.sum(axis=0) / max(counts.sum(), 1)
        p = (counts + shared) / (total + SHARED)
        with np.errstate(divide="ignore", invalid="ignore"):
            lead = np.where(shared > 0, np.log(p[1] / p[0]), 0.0)
        self.lead = lead.astype(np.float32) if total.min() > 0 else np.zeros(counts.shape[1], np.float32)

    def refuses(self, words: np.ndarray, ends: np.ndarray, first: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Which texts read like abstentions: clearly as a whole, and in every sentence."""
        out = np.zeros(len(size), bool)
        if not len(words):
            return out
        opens = first | np.concatenate([[False], ends[:-1]])
        one, two = word_codes(words, opens)
        lead = self.lead[one] + np.where(opens, 0, self.lead[two])
        begin = np.flatnonzero(opens)
        n = np.diff(np.append(begin, len(words)))
        sentence = np.add.reduceat(lead, begin) >= MIN_SENTENCE * (2 * n - 1)
        some = np.flatnonzero(size > 0)
        start = (np.cumsum(size) - size)[some]
        whole = np.add.reduceat(lead, start) >= MIN_REFUSAL * (2 * size[some] - np.add.reduceat(opens, start, dtype=np.int64))
        out[some] = whole & np.logical_and.reduceat(sentence, np.searchsorted(begin, start))
        return out


def word_codes(words: np.ndarray, opens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of words and of pairs with the word before; a word that opens a sentence has no pair."""
    shift = np.uint64(64 - WORD_BITS)
    two = _pair(np.roll(words, 1), words).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return (words >> shift).astype(np.int64), (two >> shift).astype(np.int64)


def fit_words(pairs: DataFrame, answer: str, abstain: str) -> tuple[np.ndarray, RefusalModel]:
    """Sorted numbers of the words above the rare share, 1 / RARE_SHARE at most, and the refusal model,
    both from one pass over all answers."""
    n = 1 << WORD_BITS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, sums = _Words(), np.zeros(2 * n, np.int64)
        for b in batches:
            words, ends, first, size = number(b.column(0).to_pylist())
            w, k = np.unique(words, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(np.zeros(len(w), bool)), pa.array(w.view(np.int64)), pa.array(k.astype(np.int64))], names=["of_model", "w", "n"])
            if len(words):
                opens = first | np.concatenate([[False], ends[:-1]])
                one, two = word_codes(words, opens)
                at = np.repeat(np.array(b.column(1).to_pylist(), bool), size) * n
                sums += np.bincount(one + at, minlength=2 * n) + np.bincount((two + at)[~opens], minlength=2 * n)
        at = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(np.ones(len(at), bool)), pa.array(at.astype(np.int64)), pa.array(sums[at])], names=["of_model", "w", "n"])

    part = pairs.select(answer, F.coalesce(F.col(abstain), F.lit(False))).mapInArrow(run, "of_model boolean, w bigint, n bigint")
    counted = materialise(part.groupBy("of_model", "w").agg(F.sum("n").alias("n")).filter(F.col("of_model") | (F.col("n") >= RARE_COUNT)))
    words = counted.filter("not of_model")
    total = words.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("s")).first()["s"]
    frequent = words.filter(F.col("n") >= total * RARE_SHARE).select("w").toArrow()["w"].to_numpy()
    table, r = np.zeros(2 * n), counted.filter("of_model").select("w", "n").toArrow()
    table[r["w"].to_numpy()] = r["n"].to_numpy()
    return np.sort(frequent.astype(np.int64).view(np.uint64)), RefusalModel(table.reshape(2, n))


def end_counts(pairs: DataFrame, answer: str, shared) -> DataFrame:
    """h, n_all, n_end: per last word and per last two words, how often they stand and end a sentence.

    The end of a text that has no full stop tells nothing and is left out.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, frequent = _Words(), shared.value[0]
        for b in batches:
            w, e, first, size = words(b.column(0).to_pylist())
            w = _fold(w, frequent)
            keep = np.ones(len(w), bool)
            last = np.cumsum(size)[size > 0] - 1
            keep[last[~e[last]]] = False
            before = np.where(first, START, np.roll(w, 1)) if len(w) else w
            h, inv = np.unique(np.concatenate([w[keep].view(np.int64), _pair(before, w)[keep]]), return_inverse=True)
            es = np.concatenate([e[keep], e[keep]])
            yield pa.RecordBatch.from_arrays(
                [pa.array(h), pa.array(np.bincount(inv, minlength=len(h)).astype(np.int64)), pa.array(np.bincount(inv, weights=es, minlength=len(h)).astype(np.int64))],
                names=["h", "n_all", "n_end"],
            )

    part = pairs.select(answer).mapInArrow(run, "h bigint, n_all bigint, n_end bigint")
    return part.groupBy("h").agg(F.sum("n_all").alias("n_all"), F.sum("n_end").alias("n_end"))


def find_defects(pairs: DataFrame, key: str = "prediction_id", query: str = "query", answer: str = "answer_text", abstain: str = "predicted_abstain", label: str = "language") -> DataFrame:
    """`key`, defect: each defective pair once."""
    spark = pairs.sparkSession
    asked = pairs.filter(~F.coalesce(F.col(abstain), F.lit(False)) & F.col(key).isNotNull())
    frequent, refusals = fit_words(pairs, answer, abstain)
    shared = spark.sparkContext.broadcast((frequent, fit_languages(pairs, query, answer, label), refusals))
    kind = pairs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent, languages, refusals = shared.value
        words = _Words()
        for whole in batches:
            for at in range(0, whole.num_rows, STEP_ROWS):
                b = whole.slice(at, STEP_ROWS)
                qs, ans = b.column(1).to_pylist(), b.column(2).to_pylist()
                rows: list[int] = []
                out: list[tuple[str | None, int | None, int | None, int | None, bool | None]] = []
                open_: list[int] = []
                declined = refusals.refuses(*words(ans))
                for k, (q, a) in enumerate(zip(qs, ans)):
                    d = "empty" if is_empty(a) else "copy" if is_copy(q, a) else "refusal" if declined[k] or is_refusal(a) else None
                    if d:
                        rows.append(k)
                        out.append((d, None, None, None, None))
                    else:
                        open_.append(k)
                asked = {q: i for i, q in enumerate(dict.fromkeys(qs[k] or "" for k in open_))}
                each = np.array([asked[qs[k] or ""] for k in open_], np.int64)
                (of_q, long_q), (of_a, long_a) = languages.scores(list(asked)), languages.scores([ans[k] for k in open_])
                undecided: list[int] = []
                others = differ(of_q[:, each], of_a) & long_q[each] & long_a
                for k, other in zip(open_, others):
                    if other:
                        rows.append(k)
                        out.append(("other_language", None, None, None, None))
                        continue
                    broken = is_broken(ans[k])
                    if broken:
                        rows.append(k)
                        out.append(("truncated", None, None, None, None))
                    elif broken is None:
                        undecided.append(k)
                w, _, _, size = words([ans[k].rstrip("… .\"'»”’") for k in undecided])
                w = _fold(w, frequent)
                for k, n, z in zip(undecided, size, np.cumsum(size)):
                    if n:
                        last, u = w[z - 1 : z], w[z - 2 : z - 1] if n > 1 else np.array([START])
                        rows.append(k)
                        out.append((None, int(last.view(np.int64)[0]), int(_pair(u, last)[0]), int(u.view(np.int64)[0]), bool(last[0] == RARE)))
                cols = [b.column(0).take(pa.array(rows, pa.int64()))]
                cols += [pa.array([o[i] for o in out], t) for i, t in enumerate((pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.bool_()))]
                yield pa.RecordBatch.from_arrays(cols, names=[key, "defect", "h1", "h2", "hu", "rare"])

    judged = asked.select(key, query, answer).mapInArrow(run, f"`{key}` {kind}, defect string, h1 bigint, h2 bigint, hu bigint, rare boolean").distinct()
    # a few columns of the undecided and defective rows, read twice below
    judged = materialise(judged)
    sure = judged.filter("defect is not null").select(key, "defect")
    ends = judged.filter("defect is null").select(key, "rare", F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.col(c).alias("h")) for i, c in enumerate(("h1", "h2", "hu"))])).alias("c")).select(key, "rare", "c.i", "c.h")
    counts = end_counts(pairs, answer, shared)
    seen = ends.join(counts, "h", "left").groupBy(key, "rare").agg(*[F.max(F.when(F.col("i") == i, F.coalesce(F.col(n), F.lit(0)))).alias(f"{n}{i}") for i in range(3) for n in ("n_all", "n_end")])
    p1 = F.col("n_end0") / F.greatest(F.col("n_all0"), F.lit(1))
    p2 = (F.col("n_end1") + BACK_OFF * p1) / (F.col("n_all1") + BACK_OFF)
    misplaced = F.col("rare") & (F.col("n_all2") >= BACK_OFF) & (F.col("n_all1") < MIN_RARE * F.col("n_all2"))
    broken = seen.filter((p2 < MIN_END) | misplaced).select(key, F.lit("truncated").alias("defect"))
    return sure.unionByName(broken).groupBy(key).agg(F.min("defect").alias("defect"))
