"""Held-out items that reappear, whole or in part, inside a large corpus.

Both sides are cut into windows of five consecutive words; a 64-bit SimHash of each window goes into
an index of four 16-bit blocks. Two fingerprints that differ in at most three bits agree on some
block, so the index finds all of them. Windows are this short so that every passage of fifteen words
of which about one in ten was replaced, or is followed by an added mark, still holds an unharmed
window. Each hit names an offset between document and item; hits at neighbouring offsets (added
words shift them) are laid together, and the exact word-by-word overlay decides: some run of fifteen
item words or more, replaced words near its ends included, must be alike enough. Every word counts
the same, so that it does not matter which ones were replaced; but where another item of the same
pass matches more of those words of the text, the likeness is one of pattern and is no leak.

The held-out items are the stated query set: they travel to the tasks in blocks of bounded size; the
corpus is read in place, never shuffled, and nothing of it reaches the driver.

Defined results: null, empty and short texts leak nothing; repeated documents are found each;
items without fifteen words are never found; repeated items are found under each id; an empty item
table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Words per window, bits per fingerprint block, and the largest distance that must be found.
WINDOW, BLOCK_BITS, RADIUS = 5, 16, 3
#: A leaked passage: item words, and share of them that match: at most two of 15 to 19 words, three
#: of 20 to 26 are damaged, which always leaves a whole window. Its extent: match +1, miss -1.5.
MIN_WORDS, MIN_SIMILARITY = 15, 0.85
MISS = 1.5
#: Offsets this close belong to one overlay, and how far beside them words are compared.
BAND, BESIDE = 3, 2
#: Items per pass over the corpus, words per indexed item part and their overlap.
ITEMS_PER_PASS, PART_WORDS, PART_OVERLAP = 5_000, 256, 64
#: Documents per vectorised step, and raw words whose normal form a task keeps.
STEP_DOCS, MEMO_WORDS = 500, 300_000

_FOLD = {ord(a): "ا" for a in "أإآٱ"} | {c: "" for c in [0x640, 0xAD, 0x61C, 0xFEFF, *range(0x200B, 0x2010), *range(0x202A, 0x202F), *range(0x2060, 0x2070)]}
_WORD = re.compile(r"\w+")
_ZERO = np.zeros(1, np.int32).tobytes()


def words_of(raw: str) -> list[str]:
    """Words of a text without blanks: punctuation parts them; case, marks on letters, hamza on
    alef, stretching strokes, and the script of digits are set aside."""
    t = unicodedata.normalize("NFKD", raw.translate(_FOLD).lower())
    t = "".join(c for c in t if not unicodedata.combining(c))
    return [w if w.isascii() else "".join(str(unicodedata.digit(c)) if c.isdigit() else c for c in w) for w in _WORD.findall(t)]


@dataclass
class ItemIndex:
    """Everything a task needs to know of a block of items."""

    ids: np.ndarray  # item id of each part
    vocabulary: dict[str, int]  # word -> number, from 1
    words: np.ndarray  # parts x PART_WORDS, 0 where a part has ended
    signs: np.ndarray  # word number x 64, -1 or 1; number 0 (any other word) is all 0
    fingerprints: np.ndarray
    part: np.ndarray  # of each window
    position: np.ndarray
    starts: np.ndarray  # 4 x 65537: where each block value begins in `order`
    order: np.ndarray  # 4 x windows


def fingerprints(numbers: np.ndarray, signs: np.ndarray) -> np.ndarray:
    """SimHash of each window of WINDOW words."""
    n = len(numbers) - WINDOW + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    s = signs[numbers]
    total = s[:n].copy()
    for k in range(1, WINDOW):
        total += s[k : n + k]
    return np.packbits(total > 0, axis=1).view(">u8").ravel().astype(np.uint64)


def build_index(items: list[tuple[int, str]]) -> ItemIndex:
    texts = [(i, [w for raw in t.split() for w in words_of(raw)]) for i, t in items]
    vocabulary: dict[str, int] = {}
    for _, ws in texts:
        for w in ws:
            vocabulary.setdefault(w, len(vocabulary) + 1)
    parts = [(i, ws[a : a + PART_WORDS]) for i, ws in texts for a in range(0, max(1, len(ws) - PART_OVERLAP), PART_WORDS - PART_OVERLAP)]
    table = np.zeros((len(parts), PART_WORDS), np.int32)
    for k, (_, ws) in enumerate(parts):
        table[k, : len(ws)] = [vocabulary[w] for w in ws]
    signs = np.zeros((len(vocabulary) + 1, 64), np.int8)
    for w, k in vocabulary.items():
        bits = np.frombuffer(hashlib.blake2b(w.encode(), digest_size=8).digest(), np.uint8)
        signs[k] = np.unpackbits(bits).astype(np.int8) * 2 - 1
    prints, part, position = [], [], []
    for k, (_, ws) in enumerate(parts):
        f = fingerprints(table[k, : len(ws)], signs)
        prints.append(f)
        part.append(np.full(len(f), k, np.int32))
        position.append(np.arange(len(f), dtype=np.int32))
    cat = lambda x, t: np.concatenate(x) if x else np.zeros(0, t)
    fp = cat(prints, np.uint64)
    starts, order = [], []
    for b in range(64 // BLOCK_BITS):
        v = (fp >> np.uint64(b * BLOCK_BITS)).astype(np.uint16)
        o = np.argsort(v, kind="stable")
        order.append(o.astype(np.int32))
        starts.append(np.searchsorted(v[o], np.arange((1 << BLOCK_BITS) + 1)))
    return ItemIndex(np.array([i for i, _ in parts], np.int64), vocabulary, table, signs, fp, cat(part, np.int32), cat(position, np.int32), np.array(starts), np.array(order))


def hits(numbers: np.ndarray, ix: ItemIndex) -> tuple[np.ndarray, np.ndarray]:
    """(window of the text, window of the items) for all pairs within the radius."""
    fp = fingerprints(numbers, ix.signs)
    left, right = [], []
    for b in range(len(ix.starts)):
        v = (fp >> np.uint64(b * BLOCK_BITS)).astype(np.uint16).astype(np.int64)
        lo = ix.starts[b][v]
        n = ix.starts[b][v + 1] - lo
        has = np.flatnonzero(n)
        if not len(has):
            continue
        w = np.repeat(has, n[has])
        at = np.arange(len(w)) - np.repeat(np.cumsum(n[has]) - n[has], n[has]) + np.repeat(lo[has], n[has])
        o = ix.order[b][at]
        near = np.bitwise_count(fp[w] ^ ix.fingerprints[o]) <= RADIUS
        left.append(w[near])
        right.append(o[near])
    if not left:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(left), np.concatenate(right)


def overlays(numbers: np.ndarray, doc: np.ndarray, ix: ItemIndex) -> tuple[np.ndarray, ...]:
    """Best stretch of every overlay: (doc, part, item words, matched share, lead).

    The share is that of the most alike run of MIN_WORDS item words or more. A longer run of some
    share always holds one of under twice MIN_WORDS with that share, so only such are tried. The
    lead is how many more words of the document the item matches there than any other alike item.
    `numbers` are the words of several texts, `doc` the text of each word; texts are parted by
    WINDOW words numbered 0 and of no text.
    """
    w, o = hits(numbers, ix)
    none = (np.zeros(0, np.int64),) * 3 + (np.zeros(0),) * 2
    if not len(w):
        return none
    d, part = doc[w].astype(np.int64), ix.part[o].astype(np.int64)
    offset = w.astype(np.int64) - ix.position[o]
    keys = np.unique(np.stack([d, part, offset], axis=1), axis=0)
    keys = keys[keys[:, 0] >= 0]
    if not len(keys):
        return none
    new = np.ones(len(keys), bool)
    new[1:] = (keys[1:, 0] != keys[:-1, 0]) | (keys[1:, 1] != keys[:-1, 1]) | (keys[1:, 2] - keys[:-1, 2] > BAND)
    first = np.flatnonzero(new)
    items = ix.words[keys[:, 1]]
    # words before the first added mark and after the last one lie beside the offsets that were hit
    padded = np.concatenate([np.zeros(BESIDE + PART_WORDS, np.int32), numbers, np.zeros(BESIDE + PART_WORDS, np.int32)])
    texts = np.concatenate([np.full(BESIDE + PART_WORDS, -1, doc.dtype), doc, np.full(BESIDE + PART_WORDS, -1, doc.dtype)])
    from_ = keys[:, 2, None] + BESIDE + PART_WORDS
    same = np.zeros(items.shape, bool)
    for beside in range(-BESIDE, BESIDE + 1):
        at = from_ + np.arange(beside, PART_WORDS + beside)
        same |= (padded[at] == items) & (texts[at] == keys[:, :1])
    same &= items > 0
    same = np.logical_or.reduceat(same, first, axis=0)
    some = np.flatnonzero(same.sum(axis=1) >= MIN_SIMILARITY * MIN_WORDS)
    same, first = same[some], first[some]
    part = keys[first, 1]
    score = np.where(same, np.float32(1), np.float32(-MISS))
    total = np.concatenate([np.zeros((len(first), 1), np.float32), np.cumsum(score, axis=1)], axis=1)
    lowest = np.minimum.accumulate(total, axis=1)
    end = np.argmax(total - lowest, axis=1)
    rows = np.arange(len(first))
    begin = np.argmax(total == lowest[rows, end][:, None], axis=1)
    n = end - begin
    length = (ix.words[part] > 0).sum(axis=1)
    matched = np.concatenate([np.zeros((len(first), 1)), np.cumsum(same, axis=1)], axis=1)
    share, words, where = np.zeros(len(first)), np.zeros(len(first), np.int64), np.zeros(len(first), np.int64)
    for size in range(MIN_WORDS, 2 * MIN_WORDS):
        inside = np.arange(PART_WORDS + 1 - size) + size <= length[:, None]
        m = np.where(inside, matched[:, size:] - matched[:, :-size], 0)
        at = np.argmax(m, axis=1)
        better = m[rows, at] / size > share
        share = np.where(better, m[rows, at] / size, share)
        words = np.where(better, size, words)
        where = np.where(better, at, where)
    lead = np.zeros(len(first), np.int64)
    last = np.append(np.flatnonzero(new)[1:], len(keys))[some]
    good = np.flatnonzero(share >= MIN_SIMILARITY)
    of_doc: dict[int, list[int]] = {}
    for k in good:
        of_doc.setdefault(int(keys[first[k], 0]), []).append(int(k))
    for ks in of_doc.values():
        if len({int(ix.ids[part[k]]) for k in ks}) < 2:
            continue
        covered = {k: _covered(keys[first[k] : last[k], 2], padded, texts, keys[first[k], 0], ix.words[part[k]]) for k in ks}
        for k in ks:
            a, b = keys[first[k], 2] + where[k], keys[last[k] - 1, 2] + where[k] + words[k]
            count = {j: int(((covered[j] >= a) & (covered[j] < b)).sum()) for j in ks}
            lead[k] = count[k] - max([count[j] for j in ks if ix.ids[part[j]] != ix.ids[part[k]]], default=0)
    return keys[first, 0], part, np.maximum(n, words), share, lead


def _covered(offsets: np.ndarray, padded: np.ndarray, texts: np.ndarray, doc: int, item: np.ndarray) -> np.ndarray:
    """Words of the text that an item part matches at some of the offsets or beside them."""
    at = np.unique(offsets[:, None] + np.arange(-BESIDE, BESIDE + 1))[:, None] + np.arange(PART_WORDS)
    padding = BESIDE + PART_WORDS
    return np.unique(at[(padded[at + padding] == item) & (texts[at + padding] == doc) & (item > 0)])


def leaked(words: np.ndarray, share: np.ndarray, lead: np.ndarray) -> np.ndarray:
    """Which overlays are leaks. Damage is judged by the number of words alone, however rare; where
    the words of one item fill what is amiss with another, the text is alike only in pattern."""
    return (words >= MIN_WORDS) & (share >= MIN_SIMILARITY) & (lead >= 0)


def find_leaks(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id", passages: tuple[str, ...] = ("question", "ground_truth_answer")) -> DataFrame:
    """`key`, `item_key`, n_words, similarity: one row per leaked document and item.

    The passages of an item are run together, so a leak may span their border.
    """
    kind = docs.schema[key].dataType.simpleString()
    spark = docs.sparkSession
    joined = F.concat_ws(" ", *[F.coalesce(F.col(p), F.lit("")) for p in passages])
    wanted = items.select(F.col(item_key).cast("bigint").alias("i"), joined.alias("t")).filter("i is not null").distinct()
    n_items = wanted.count()
    schema = f"`{key}` {kind}, `{item_key}` bigint, n_words int, similarity double"
    out = None
    for block in range(max(1, -(-n_items // ITEMS_PER_PASS))):
        n_blocks = max(1, -(-n_items // ITEMS_PER_PASS))
        rows = wanted.filter(F.pmod(F.xxhash64("i"), F.lit(n_blocks)) == block) if n_blocks > 1 else wanted
        shared = spark.sparkContext.broadcast(build_index([(r.i, r.t) for r in rows.collect()]))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            ix: ItemIndex = shared.value
            memo: dict[str, bytes] = {}
            gap = np.zeros(WINDOW, np.int32)
            for whole in batches:
                for a in range(0, whole.num_rows, STEP_DOCS):
                    b = whole.slice(a, STEP_DOCS)
                    if len(memo) > MEMO_WORDS:
                        memo.clear()
                    parts, owner = [], []
                    for k, t in enumerate(b.column(1).to_pylist()):
                        raw = (t or "").split()
                        for w in set(raw).difference(memo):
                            memo[w] = np.array([ix.vocabulary.get(x, 0) for x in words_of(w)], np.int32).tobytes()
                        v = np.frombuffer(b"".join(map(memo.__getitem__, raw)), np.int32)
                        parts += [v, gap]
                        owner += [np.full(len(v), k, np.int32), np.full(WINDOW, -1, np.int32)]
                    if not parts or not len(ix.fingerprints):
                        continue
                    d, part, n, share, lead = overlays(np.concatenate(parts), np.concatenate(owner), ix)
                    good = leaked(n, share, lead)
                    if good.any():
                        yield pa.RecordBatch.from_arrays(
                            [b.column(0).take(pa.array(d[good])), pa.array(ix.ids[part[good]]), pa.array(n[good].astype(np.int32)), pa.array(share[good].astype(np.float64))],
                            names=[key, item_key, "n_words", "similarity"],
                        )

        found = docs.select(F.col(key), F.col(text)).mapInArrow(run, schema)
        out = found if out is None else out.unionByName(found)
    return out.groupBy(key, item_key).agg(F.max("n_words").alias("n_words"), F.max("similarity").alias("similarity"))
