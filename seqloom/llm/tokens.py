"""Encoding with a public byte-level BPE by forced-boundary splitting.

A byte pair that lies inside no token of the vocabulary can never be joined by a merge, so a text
may be cut there without changing its ids, provided that the parts are pre-tokenised as the whole
is. All such pairs are used that lie between two characters

* of which the second is ASCII white space and the first is none: always a border of the pattern; or
* of which neither is white space or an apostrophe: the pattern then groups characters by their class
  (letters, digits, others), and a run of one class may be cut anywhere (contractions and the
  look-ahead after white space are kept out). This holds for the public pattern; under another one,
  only the first kind of cut is made.

The fragments between these cuts are encoded on their own and the ids are put together; a fragment
seen before is looked up instead. A run of characters all of whose pairs occur in tokens, as a long
sequence of A, C, G and T, has no certain cut and stays whole.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_SPACE = b"\t\n\x0b\x0c\r "
#: White space of the pattern, and control characters that only Python takes for it.
_BLANK = np.array(sorted({*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000}), np.uint32)
#: Fragments kept per worker; beyond it the memory is cleared, which changes no result.
MEMORY = 200_000
#: Texts longer than this are cut up first and their parts encoded by different tasks.
LONG = 1 << 18
PART = 1 << 16


def public_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


class Encoder:
    """Whole-text encoding for one vocabulary."""

    def __init__(self, path: str, pattern: str):
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        self.plain = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.inside = np.zeros((256, 256), bool)
        for token in ranks:
            x = np.frombuffer(token, np.uint8)
            self.inside[x[:-1], x[1:]] = True
        self.inner = pattern == public_pattern()
        #: For ASCII characters: may a text be cut between them?
        a, b = np.repeat(np.arange(128, dtype=np.uint32), 128), np.tile(np.arange(128, dtype=np.uint32), 128)
        self.ascii_cut = self._cuts(a, b).reshape(128, 128)
        self.known: dict[str, list[int]] = {}

    def _cuts(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """May a text be cut between the characters ``a`` and ``b`` (code points)?"""
        free = ~self.inside[_last_byte(a), _first_byte(b)]
        blank_a, blank_b = np.isin(a, _BLANK), np.isin(b, _BLANK)
        spaced = ~blank_a & np.isin(b, np.frombuffer(_SPACE, np.uint8))
        if not self.inner:
            return free & spaced
        return free & (spaced | ~(blank_a | blank_b | (a == 0x27) | (b == 0x27)))

    def pieces(self, text: str) -> list[str]:
        """Fragments whose ids, put together, are the ids of the text."""
        if not text:
            return []
        if text.isascii():
            x = np.frombuffer(text.encode(), np.uint8)
            at = np.flatnonzero(self.ascii_cut[x[:-1], x[1:]])
        else:
            x = np.frombuffer(text.encode("utf-32-le"), np.uint32)
            at = np.flatnonzero(self._cuts(x[:-1], x[1:]))
        ends = (at + 1).tolist()
        return [text[i:j] for i, j in zip([0, *ends], [*ends, len(text)])]

    def encode(self, text: str | None) -> list[int]:
        """Ids without special tokens; null and empty texts have none."""
        if not text:
            return []
        ids: list[int] = []
        known = self.known
        for x in self.pieces(text):
            got = known.get(x)
            if got is None:
                got = self.plain.encode_ordinary(x)
                if len(x) <= 64:
                    if len(known) >= MEMORY:
                        known.clear()
                    known[x] = got
            ids += got
        return ids

    def blocks(self, text: str, size: int) -> list[str]:
        """Parts of about ``size`` characters, cut at forced boundaries only."""
        out, held, n = [], [], 0
        for x in self.pieces(text):
            held.append(x)
            n += len(x)
            if n >= size:
                out.append("".join(held))
                held, n = [], 0
        if held:
            out.append("".join(held))
        return out


def _last_byte(c: np.ndarray) -> np.ndarray:
    """Last byte of characters in UTF-8."""
    return np.where(c < 0x80, c, (c & 0x3F) | 0x80).astype(np.intp)


def _first_byte(c: np.ndarray) -> np.ndarray:
    """First byte of characters in UTF-8."""
    return np.select([c < 0x80, c < 0x800, c < 0x10000], [c, 0xC0 | (c >> 6), 0xE0 | (c >> 12)], 0xF0 | (c >> 18)).astype(np.intp)


@lru_cache(maxsize=4)
def encoder(path: str, pattern: str) -> Encoder:
    return Encoder(path, pattern)


def _settings(path: str | None, pattern: str | None) -> tuple[str, str]:
    return path or default_path(), pattern or public_pattern()


def _to_ids(path: str, pattern: str, count_only: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path, pattern)
        for whole in batches:
            for at in range(0, whole.num_rows, 1024):
                b = whole.slice(at, 1024)
                ids = [enc.encode(t) for t in b.column(b.num_columns - 1).to_pylist()]
                n = np.array([len(x) for x in ids], np.int64)
                if count_only:
                    last = pa.array(n)
                else:
                    flat = np.fromiter((i for x in ids for i in x), np.int32, int(n.sum()))
                    last = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(n)].astype(np.int32)), pa.array(flat))
                yield pa.RecordBatch.from_arrays([*b.columns[:-1], last], names=[*b.schema.names[:-1], "n_tokens" if count_only else "ids"])

    return run


def _to_blocks(path: str, pattern: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path, pattern)
        for b in batches:
            for i in range(b.num_rows):
                parts = enc.blocks(b.column(1)[i].as_py(), PART)
                keys = [b.column(k).slice(i, 1).take(pa.array([0] * len(parts), pa.int64())) for k in (0, 2)]
                yield pa.RecordBatch.from_arrays([*keys, pa.array(range(len(parts)), pa.int64()), pa.array(parts, pa.string())], names=["id", "row", "part", "text"])

    return run


def encode_corpus(df: DataFrame, id_col: str, text_col: str, path: str | None = None, pattern: str | None = None, count_only: bool = False) -> DataFrame:
    """Token ids of each text: ``id, ids`` (or ``id, n_tokens``), one row per row of ``df``.

    Null and empty texts have the empty list (0 tokens). Special tokens are never added, and
    their strings in a text are ordinary text. Texts of over ``LONG`` characters are cut at
    forced boundaries into parts that different tasks encode; the parts are put together in
    order. Ids may repeat or be null. An empty table gives an empty result; other columns are ignored. ``path`` and
    ``pattern`` name another byte-level vocabulary in rank format.
    """
    path, pattern = _settings(path, pattern)
    kind = df.schema[id_col].dataType.simpleString()
    out = "n_tokens long" if count_only else "ids array<int>"
    t = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    long = F.coalesce(F.length("text") > LONG, F.lit(False))
    short = t.filter(~long).mapInArrow(_to_ids(path, pattern, count_only), f"id {kind}, {out}")
    # the key of a row, as ids may repeat or be null; made in the scan's stage, before any shuffle
    rows = t.filter(long).select("id", "text", F.monotonically_increasing_id().alias("row"))
    parts = rows.mapInArrow(_to_blocks(path, pattern), f"id {kind}, row long, part long, text string").repartition("row", "part")
    parts = parts.mapInArrow(_to_ids(path, pattern, count_only), f"id {kind}, row long, part long, {out}")
    first = F.first("id").alias("id")
    if count_only:
        joined = parts.groupBy("row").agg(first, F.sum("n_tokens").alias("n_tokens")).drop("row")
    else:
        joined = parts.groupBy("row").agg(first, F.array_sort(F.collect_list(F.struct("part", "ids"))).alias("p")).select("id", F.flatten("p.ids").alias("ids"))
    return short.unionByName(joined)
