"""Encoding of whole texts with a public byte-level BPE, and its inverse.

The tokenizers library does the encoding, over Arrow batches inside tasks. A byte-level BPE never
merges across a word break, so each batch sends the library only the words its task has not met
yet; the ids of a text are the joined ids of its words. Texts whose white space could be grouped
differently when cut (a blank between two white-space characters) go to the library whole.

Defined results: null and empty texts give an empty list; blank texts are encoded as they are;
strings that look like special tokens are ordinary text; repeated rows give repeated rows; extra
columns other than the named ones are dropped.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DEFAULT_VOCABULARY = "/opt/tokenizers/byte_bpe_50k.json"
#: Words whose ids a task keeps; at more it starts afresh. Bounds memory, changes no result.
MEMO_WORDS = 200_000
#: Rows encoded and handed back at a time.
SLICE_ROWS = 1_000

# a blank that is neither after nor before a non-blank character
_UNSAFE = re.compile("[\\s\u180e] (?:[\\s\u180e]|\\Z)")


@lru_cache(maxsize=4)
def _tokenizer(path: str):
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True
    return t


def byte_of_char() -> dict[str, int]:
    """The printable stand-in of each byte in a byte-level vocabulary, inverted.

    Printable Latin-1 stands for itself; the other bytes, in order, take U+0100 onwards.
    """
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(0x100 + i): b for i, b in enumerate(rest)}


@lru_cache(maxsize=4)
def _pieces(path: str) -> tuple[list[bytes], np.ndarray]:
    """Bytes of each id, and their lengths."""
    table, vocab = byte_of_char(), _tokenizer(path).get_vocab(with_added_tokens=False)
    added = _tokenizer(path).get_added_tokens_decoder()
    out = [b""] * (max([*vocab.values(), *added, 0]) + 1)
    for token, i in vocab.items():
        out[i] = token.encode() if i in added else bytes(table[c] for c in token)
    return out, np.array([len(x) for x in out], np.int64)


class _Encoder:
    """Ids of texts as packed int32 bytes, through a memo of words."""

    def __init__(self, path: str):
        self.tok, self.memo = _tokenizer(path), {}

    def _learn(self, pieces: list[str]) -> list[bytes]:
        found = self.tok.encode_batch_fast(pieces, add_special_tokens=False)
        return [np.array(x.ids, np.int32).tobytes() for x in found]

    def __call__(self, texts: list[str | None]) -> list[bytes]:
        if len(self.memo) > MEMO_WORDS:
            self.memo.clear()
        memo = self.memo
        # a text's first word has no blank before it; others are kept under the word alone
        cut: list[list[str] | None] = []
        missing: set[str] = set()
        whole: list[str] = []
        for t in texts:
            if not t:
                cut.append([])
            elif _UNSAFE.search(t):
                whole.append(t)
                cut.append(None)
            else:
                parts = t.split(" ")
                cut.append(parts)
                missing.update(parts[1:])
        missing -= memo.keys()
        new = list(missing)
        memo.update(zip(new, self._learn([" " + w for w in new])))
        heads = iter(self._learn([p[0] for p in cut if p]))
        wholes = iter(self._learn(whole))
        get = memo.__getitem__
        return [next(wholes) if p is None else next(heads) + b"".join(map(get, p[1:])) if p else b"" for p in cut]


def _int_lists(packed: list[bytes]) -> pa.ListArray:
    ends = np.cumsum([0, *(len(p) // 4 for p in packed)], dtype=np.int64)
    return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(np.frombuffer(b"".join(packed), np.int32)))


def char_spans(text: str, ids: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and past-the-last character of each token; tokens that share a character overlap on it."""
    raw = np.frombuffer(text.encode(), np.uint8)
    char_at = np.cumsum((raw & 0xC0) != 0x80, dtype=np.int32) - 1
    ends = np.cumsum(lengths[ids])
    return char_at[ends - lengths[ids]], char_at[ends - 1] + 1


def encode(df: DataFrame, key: str = "doc_id", text: str = "text", path: str = DEFAULT_VOCABULARY, with_offsets: bool = False) -> DataFrame:
    """`key`, `ids` and, if asked for, `starts` and `ends`: character offsets of every token."""
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = _Encoder(path)
        lengths = _pieces(path)[1] if with_offsets else None
        for whole in batches:
            for at in range(0, whole.num_rows, SLICE_ROWS):
                b = whole.slice(at, SLICE_ROWS)
                texts = b.column(1).to_pylist()
                packed = enc(texts)
                cols = [b.column(0), _int_lists(packed)]
                if with_offsets:
                    spans = [char_spans(t or "", np.frombuffer(p, np.int32), lengths) if p else (np.zeros(0, np.int32),) * 2 for t, p in zip(texts, packed)]
                    cols += [_int_lists([s[i].astype(np.int32).tobytes() for s in spans]) for i in (0, 1)]
                yield pa.RecordBatch.from_arrays(cols, names=names)

    names = [key, "ids", *(["starts", "ends"] if with_offsets else [])]
    schema = f"`{key}` {kind}, ids array<int>" + ", starts array<int>, ends array<int>" * with_offsets
    return df.select(F.col(key), F.col(text)).mapInArrow(run, schema)


def decode(df: DataFrame, key: str = "doc_id", ids: str = "ids", path: str = DEFAULT_VOCABULARY) -> DataFrame:
    """`key`, `text`: the bytes of the ids read as UTF-8; a character that the ids split and do
    not complete becomes U+FFFD, as do unknown ids. Null ids give null, an empty list "".
    """
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = _pieces(path)[0]
        for b in batches:
            out = []
            for row in b.column(1).to_pylist():
                ok = None if row is None else [pieces[i] if i is not None and 0 <= i < len(pieces) else b"\xff" for i in row]
                out.append(None if ok is None else b"".join(ok).decode("utf-8", "replace"))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.string())], names=[key, "text"])

    return df.select(F.col(key), F.col(ids)).mapInArrow(run, f"`{key}` {kind}, text string")
