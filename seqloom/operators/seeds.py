"""Sequences that have many words in common, with words as numbers in Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqloom.session import materialize

#: Letters whose words are made at once, and letters for each part of the words.
LETTERS = 1 << 21
#: Pairs that are counted at once.
PAIRS = 1 << 22
K, NONE = 16, 255


def _table(foreign: str) -> np.ndarray:
    """Codes by code point: 0 to 3 for bases, 4 and more for the other letters; N and what ends a text have none."""
    out = np.full(max(127, *map(ord, foreign or "A")) + 2, NONE, np.uint8)
    for i, c in enumerate("ACGT" + foreign):
        out[ord(c)] = i
    return out


def _packed(code: np.ndarray, bits: int, kind: type) -> np.ndarray:
    """Each 16 letters in a row as one number."""
    p, n = code.astype(kind), 1
    while n < K:
        p, n = (p[:-n] << kind(bits * n)) | p[n:], 2 * n
    return p


def distinct_words(texts: list[str], table: np.ndarray) -> Iterator[tuple[bool, np.ndarray, np.ndarray]]:
    """Distinct words of each text, without those with N: have they only bases, places of the texts (in order), words as numbers mixed by an odd factor."""
    joined = "\n".join([*texts, ""])
    points = np.frombuffer(joined.encode(), np.uint8) if joined.isascii() else np.minimum(np.frombuffer(joined.encode("utf-32-le"), np.uint32), len(table) - 1)
    code = table[points]
    if len(code) < K:
        return
    owner = np.repeat(np.arange(len(texts), dtype=np.uint64), [len(t) + 1 for t in texts])

    def inside(flag: np.ndarray) -> np.ndarray:
        n = np.zeros(len(flag) + 1, np.int32)
        np.cumsum(flag, out=n[1:])
        return n[K:] != n[:-K]

    known, other = ~inside(code == NONE), inside((code > 3) & (code != NONE))
    at = np.flatnonzero(known & ~other)
    w = (_packed(code & 3, 2, np.uint32)[at] * np.uint32(2654435769)).astype(np.uint64)
    key = np.sort(owner[at] << np.uint64(32) | w)
    key = key[np.r_[True, key[1:] != key[:-1]]] if len(key) else key
    yield True, key >> np.uint64(32), key.astype(np.uint32)
    at = np.flatnonzero(known & other)
    if len(at):
        o, w = owner[at], _packed(code & 15, 4, np.uint64)[at] * np.uint64(0x9E3779B97F4A7C15)
        order = np.lexsort((w, o))
        o, w = o[order], w[order]
        new = np.r_[True, (o[1:] != o[:-1]) | (w[1:] != w[:-1])]
        yield False, o[new], w[new]


def _split(ids: list[int], texts: list[str], table: np.ndarray, log: int) -> Iterator[tuple]:
    """Rows of each part of the words: part, ids, how many words each has, the words."""
    ids = np.array(ids, np.int64)
    for bases, owner, w in distinct_words(texts, table):
        part = (w >> w.dtype.type(w.dtype.itemsize * 8 - log)).astype(np.uint16)
        order = np.argsort(part, kind="stable")
        owner, w = owner[order].astype(np.int64), w[order]
        ends = np.r_[0, np.cumsum(np.bincount(part, minlength=1 << log))]
        for i in np.flatnonzero(np.diff(ends)).tolist():
            o = owner[ends[i] : ends[i + 1]]
            first = np.flatnonzero(np.r_[True, o[1:] != o[:-1]])
            yield i if bases else i + (1 << log), ids[o[first]].tobytes(), np.diff(np.r_[first, len(o)]).astype(np.int32).tobytes(), w[ends[i] : ends[i + 1]].tobytes()


def _shared(ids: np.ndarray, counts: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words that several sequences have: how many have each, and their ids, word by word."""
    owner = np.repeat(np.arange(len(ids), dtype=np.uint64), counts)
    if words.dtype == np.uint32:
        key = np.sort(words.astype(np.uint64) << np.uint64(32) | owner)
        words, owner = key >> np.uint64(32), key & np.uint64(0xFFFFFFFF)
    else:
        order = np.lexsort((owner, words))
        words, owner = words[order], owner[order]
    first = np.flatnonzero(np.r_[True, words[1:] != words[:-1]])
    size = np.diff(np.r_[first, len(words)])
    return size[size > 1].astype(np.int32), ids[owner[np.repeat(size > 1, size)].astype(np.int64)]


def _met(size: np.ndarray, ids: np.ndarray, wanted: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Pairs of a wanted sequence and another one that has the same word, with the number of words."""
    names, x = np.unique(ids, return_inverse=True)
    n, first = np.repeat(size, size).astype(np.int64), np.repeat(np.cumsum(size, dtype=np.int64) - size, size)
    at = np.flatnonzero(np.isin(names, wanted)[x])
    total = np.cumsum(n[at])
    lo = 0
    while lo < len(at):
        hi = max(lo + 1, int(np.searchsorted(total, (total[lo - 1] if lo else 0) + PAIRS, "right")))
        part = at[lo:hi]
        k = n[part]
        other = np.arange(k.sum()) + np.repeat(first[part] - (np.cumsum(k) - k), k)
        a, b = np.repeat(x[part], k), x[other]
        key, seeds = np.unique((a * len(names) + b)[a != b], return_counts=True)
        yield names[key // len(names)], names[key % len(names)], seeds
        lo = hi


def subject_pairs(t: DataFrame) -> DataFrame | None:
    """``subject, query, seeds``: pairs that share ``need`` or more distinct words of 16 letters, by the need of the subject.

    ``t``: ``seq_id, q, need``, unique ids. Words with N do not count. Each word is a number; the words go to parts, where those
    of several sequences are found by sorting. Only sequences with ``need`` such words or more can be subjects: their ids go to every
    task, and their pairs are counted, no others. None for texts of over 12 letters other than A, C, G, T and N.
    """
    spark = t.sparkSession
    letters = t.agg(F.sum(F.length("q")).alias("n")).first().n or 0
    rare = t.filter(F.col("q").rlike("[^ACGTN]")).select(F.explode(F.split(F.regexp_replace("q", "[ACGTN]", ""), "")).alias("c")).filter("c <> ''").distinct().limit(13).collect()
    if len(rare) > 12:
        return None
    table = _table("".join(sorted(r.c for r in rare)))
    log = min(10, max(6, (letters // LETTERS).bit_length()))
    tasks = max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int32(), pa.binary(), pa.binary(), pa.binary()]
        for b in batches:
            ids, texts, n, m = b.column(0).to_pylist(), b.column(1).to_pylist(), 0, 0
            for i, s in enumerate(texts):
                m += len(s)
                if m >= LETTERS or i == len(texts) - 1:
                    rows = list(zip(*_split(ids[n : i + 1], texts[n : i + 1], table, log)))
                    if rows:
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(rows, kinds)], names=["part", "ids", "counts", "words"])
                    n, m = i + 1, 0

    def shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held = None, []

        def emit() -> pa.RecordBatch:
            word = np.uint32 if part < 1 << log else np.uint64
            size, ids = _shared(*[np.frombuffer(b"".join(c), k) for c, k in zip(zip(*held), (np.int64, np.int32, word))])
            return pa.RecordBatch.from_arrays([pa.array([size.tobytes()], pa.binary()), pa.array([ids.tobytes()], pa.binary())], names=["sizes", "ids"])

        for b in batches:
            for p, *row in zip(*[c.to_pylist() for c in b.columns]):
                if p != part:
                    if held:
                        yield emit()
                    part, held = p, []
                held.append(row)
        if held:
            yield emit()

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for b in batches:
            for size, ids in zip(b.column(0), b.column(1)):
                yield np.frombuffer(size.as_buffer(), np.int32), np.frombuffer(ids.as_buffer(), np.int64)

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, ids in read(batches):
            yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in np.unique(ids, return_counts=True)], names=["seq_id", "n"])

    parts = t.select("seq_id", "q").repartition(tasks).mapInArrow(split, "part int, ids binary, counts binary, words binary")
    found = materialize(parts.repartition(tasks, "part").sortWithinPartitions("part").mapInArrow(shared, "sizes binary, ids binary"), "shared").repartition(tasks)
    have = found.mapInArrow(tally, "seq_id long, n long").groupBy("seq_id").agg(F.sum("n").alias("n"))
    need = t.select(F.col("seq_id").alias("subject"), "need")
    wanted = spark.sparkContext.broadcast(np.array(need.join(have, need["subject"] == have["seq_id"]).filter("n >= need").select("subject").toPandas().subject, np.int64))

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for size, ids in read(batches):
            for columns in _met(size, ids, wanted.value):
                yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in columns], names=["subject", "query", "seeds"])

    pairs = found.mapInArrow(meet, "subject long, query long, seeds long").groupBy("subject", "query").agg(F.sum("seeds").alias("seeds"))
    return pairs.join(need, "subject").filter("seeds >= need").select("subject", "query", "seeds")
