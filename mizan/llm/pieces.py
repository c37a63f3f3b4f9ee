"""Cutting of oversized texts at natural boundaries, with overlap.

Content-defined: a rolling hash over the last 32 characters marks landmarks that depend on nothing
but those characters. From a piece's start, the first landmark beyond the minimum size is moved to
the nearest boundary of the strongest kind within reach (blank line, line, sentence, clause, word);
without a landmark the last such boundary before the maximum serves. An edit therefore alters the
pieces around it, and the cuts fall into step again at the next common landmark.

Defined results: null and empty texts and texts within the limit come out as one piece; a text
without any boundary is cut at the limit, never before a combining mark if the limit leaves room;
levels without a limit are not cut; repeated rows give repeated pieces.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# strength of a cut that follows the character, largest first
BLANK_LINE, LINE, SENTENCE, CLAUSE, WORD_END, ANYWHERE, NEVER = 6, 5, 4, 3, 2, 1, 0
SENTENCE_MARKS = ".!?؟۔;؛。！？；"
CLAUSE_MARKS = "،,:，：、"
#: Smallest piece as a share of the largest, and mean distance of landmarks as such a share.
MIN_SHARE, LANDMARK_SHARE = 0.25, 0.125


def level_of(granularity: Column, para_idx: Column) -> Column:
    """Level of a chunk: its granularity, trimmed, in lower case; where that is missing, -1 in
    para_idx means article and everything else paragraph."""
    g = F.lower(F.trim(granularity))
    return F.when(F.coalesce(g, F.lit("")) != "", g).when(para_idx == -1, "article").otherwise("paragraph")


def _marks(code: np.ndarray, chars: str) -> np.ndarray:
    return np.isin(code, np.array([ord(c) for c in chars], np.uint32))


def cut_strength(code: np.ndarray) -> np.ndarray:
    """Strength of a cut before each position, 0..n; the white space stays with the piece before."""
    n = len(code)
    space = (code <= 0x20) | (code == 0x85) | (code == 0xA0) | ((code >= 0x2000) & (code <= 0x200A)) | np.isin(code, (0x1680, 0x2028, 0x2029, 0x202F, 0x205F, 0x3000))
    line = np.isin(code, (0x0A, 0x0D, 0x2028, 0x2029, 0x85))
    mark = (
        ((code >= 0x300) & (code < 0x370)) | ((code >= 0x64B) & (code <= 0x65F)) | (code == 0x670) | ((code >= 0x6D6) & (code <= 0x6ED))
        | ((code >= 0x200C) & (code <= 0x200F)) | ((code >= 0xFE00) & (code <= 0xFE0F)) | ((code >= 0x1F3FB) & (code <= 0x1F3FF))
    )
    s = np.full(n + 1, ANYWHERE, np.int8)
    # a run of white space ends where a non-space follows; what stands before the run names the pause
    idx = np.arange(n)
    last = np.maximum.accumulate(np.where(~space, idx, -1))  # last non-space up to here
    lines = np.cumsum(line)
    ends = np.flatnonzero(space[:-1] & ~space[1:]) + 1 if n > 1 else np.zeros(0, np.int64)
    if len(ends):
        before = last[ends - 1]
        n_lines = lines[ends - 1] - np.where(before >= 0, lines[np.maximum(before, 0)], 0)
        prev = code[np.maximum(before, 0)]
        kind = np.full(len(ends), WORD_END, np.int8)
        kind[_marks(prev, CLAUSE_MARKS)] = CLAUSE
        kind[_marks(prev, SENTENCE_MARKS)] = SENTENCE
        kind[n_lines == 1] = LINE
        kind[n_lines > 1] = BLANK_LINE
        s[ends] = kind
    if n:
        s[:-1][mark] = NEVER
        s[1:-1][(code[:-1] == 0x200D)] = NEVER
        s[1:-1][(code[:-1] == 0x0D) & (code[1:] == 0x0A)] = NEVER
    s[0] = s[n] = NEVER
    return s


def rolling_hash(code: np.ndarray) -> np.ndarray:
    """Gear hash of the 32 characters up to each position, by doubling."""
    x = code.astype(np.uint32) * np.uint32(0x9E3779B1)
    x ^= x >> np.uint32(15)
    x *= np.uint32(0x85EBCA77)
    h = x ^ (x >> np.uint32(13))
    for width in (1, 2, 4, 8, 16):
        g = h.copy()
        g[width:] += h[:-width] << np.uint32(width)
        h = g
    return h


def cuts(text: str, max_chars: int, overlap_chars: int) -> list[tuple[int, int, int]]:
    """(start of the repeated part, start of the new part, end) of each piece."""
    n = len(text)
    if n <= max_chars:
        return [(0, 0, n)]
    overlap_chars = max(0, min(overlap_chars, max_chars // 2))
    code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    strength = cut_strength(code)
    bits = max(1, round(np.log2(max(2.0, max_chars * LANDMARK_SHARE))))
    landmark = np.flatnonzero(rolling_hash(code) >> np.uint32(32 - bits) == 0) + 1
    words = np.flatnonzero(strength >= WORD_END)
    out, start, repeat = [], 0, 0
    while True:
        room = max_chars - (start - repeat)
        if n - start <= room:
            out.append((repeat, start, n))
            return out
        lo, hi = start + max(1, int(room * MIN_SHARE)), start + room
        k = np.searchsorted(landmark, lo)
        aim = int(landmark[k]) if k < len(landmark) and landmark[k] <= hi else hi
        reach = strength[lo : hi + 1]
        best = int(reach.max())
        if best < WORD_END and (reach == ANYWHERE).any():
            cut = lo + int(np.flatnonzero(reach == ANYWHERE)[-1])
        elif best == NEVER:
            cut = hi
        else:
            at = np.flatnonzero(reach == best) + lo
            cut = int(at[np.argmin(np.abs(at - aim))])
        out.append((repeat, start, cut))
        # the repeated part starts at a word if one starts within reach
        k = np.searchsorted(words, cut - overlap_chars)
        repeat = int(words[k]) if k < len(words) and words[k] < cut else cut - overlap_chars
        while repeat < cut and strength[repeat] == NEVER and repeat > 0:
            repeat += 1
        repeat = max(repeat, out[-1][1])
        start = cut


def split_oversized(chunks: DataFrame, limits: DataFrame, keep_small: bool = True) -> DataFrame:
    """Pieces of every chunk: chunk_id, level, piece_no, n_pieces, char_start, new_from, char_end, piece.

    `limits` (granularity, max_chars, overlap_chars) is a small table of levels. Only texts over
    their limit leave the JVM; the others are passed on as they are.
    """
    lim = limits.select(
        F.lower(F.trim("granularity")).alias("level"), F.col("max_chars").alias("_max"), F.col("overlap_chars").alias("_overlap")
    ).dropDuplicates(["level"])
    base = chunks.select("chunk_id", level_of(F.col("granularity"), F.col("para_idx")).alias("level"), "text")
    sized = base.join(F.broadcast(lim), "level", "left")
    over = F.coalesce(F.length("text") > F.col("_max"), F.lit(False))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = b.to_pydict()
            out: dict[str, list] = {f: [] for f in names}
            for cid, level, text, most, overlap in zip(*(rows[c] for c in ("chunk_id", "level", "text", "_max", "_overlap"))):
                found = cuts(text, most, overlap or 0)
                for k, (a, s, e) in enumerate(found):
                    for f, v in zip(names, (cid, level, k, len(found), a, s, e, text[a:e])):
                        out[f].append(v)
            yield pa.RecordBatch.from_pydict(out, schema=arrow)

    names = ["chunk_id", "level", "piece_no", "n_pieces", "char_start", "new_from", "char_end", "piece"]
    arrow = pa.schema([(f, pa.string() if f in ("chunk_id", "level", "piece") else pa.int32()) for f in names])
    large = sized.filter(over).select("chunk_id", "level", "text", "_max", "_overlap").mapInArrow(
        run, "chunk_id string, level string, piece_no int, n_pieces int, char_start int, new_from int, char_end int, piece string"
    )
    if not keep_small:
        return large
    n = F.coalesce(F.length("text"), F.lit(0))
    small = sized.filter(~over).select(
        "chunk_id", "level", F.lit(0).alias("piece_no"), F.lit(1).alias("n_pieces"), F.lit(0).alias("char_start"), F.lit(0).alias("new_from"), n.alias("char_end"), F.coalesce("text", F.lit("")).alias("piece")
    )
    return large.unionByName(small)


def oversized_ids(pieces: DataFrame) -> DataFrame:
    """Each chunk that came out in more than one piece, once."""
    return pieces.filter("n_pieces > 1 and piece_no = 0").select("chunk_id").distinct()
