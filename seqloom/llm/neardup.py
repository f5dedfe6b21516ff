"""Near-duplicate sequences: multiple global token orders, intersected, then exact verification.

Tokens are the distinct words of ``k`` letters of a text. A global order of the tokens is a hash
order; the prefix of a text under an order is its first token. Two texts of similarity ``J`` share
that prefix with probability ``J`` under each order. The orders are taken in groups of ``ROWS``:
candidates must share the prefix under all orders of a group (the filters are intersected), in at
least one of ``BANDS`` groups. With prefixes of one token this is banded minhash: the prefix that is
exact for a similarity of 0.5 is half of a text under any order, and unrelated texts share words of
that half by chance. With 96 groups of 3 a pair of similarity 0.5 is missed with
probability (1 - 0.5**3)**96 = 2.7e-6, one of 0.6 with 6e-11, while unrelated texts, which share
a few tokens in a thousand by chance, practically never become candidates. Candidates are verified
exactly on the whole token sets.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqloom.functions.sequence import cleaned
from seqloom.operators.pairs import BLOCK, pairs_by_key
from seqloom.session import materialize

BANDS, ROWS = 96, 3
SLOTS = BANDS * ROWS
_NONE = np.uint64(0xFFFFFFFFFFFFFFFF)
_CODE = np.full(256, 255, np.uint8)
_CODE[np.frombuffer(b"ACGT", np.uint8)] = np.arange(4)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit scrambling (the finaliser of splitmix64)."""
    x = x.astype(np.uint64, copy=True)
    x += np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _packed(code: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Codes of all words of ``k`` letters and of their reverse complements, by joining words of half the length."""
    if k == 1:
        return code, np.uint32(3) - code
    a = k // 2
    b = k - a
    fa, ra = _packed(code, a)
    fb, rb = (fa, ra) if a == b else _longer(fa, ra, code, a)
    n = len(code) - k + 1
    return (fa[:n] << np.uint32(2 * b)) | fb[a : a + n], (rb[a : a + n] << np.uint32(2 * a)) | ra[:n]


def _longer(f: np.ndarray, r: np.ndarray, code: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Words of ``k + 1`` letters from those of ``k``."""
    n = len(code) - k
    last = code[k : k + n]
    return (f[:n] << np.uint32(2)) | last, ((np.uint32(3) - last) << np.uint32(2 * k)) | r[:n]


def words_of(data: np.ndarray, offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """All words of texts lying one after another in ``data``: codes, and the text each is from.

    A word and its reverse complement have one code; words with other letters are left out.
    """
    if len(data) < k:
        return np.zeros(0, np.uint32), np.zeros(0, np.int64)
    code = _CODE[data]
    bad = np.flatnonzero(code > 3)
    n = len(code) - k + 1
    fwd, rev = _packed((code & 3).astype(np.uint32), k)
    keep = np.ones(n, bool)
    if len(bad):
        mark = np.zeros(len(code) + 1, np.int32)
        np.add.at(mark, np.maximum(bad - k + 1, 0), 1)
        np.add.at(mark, bad + 1, -1)
        keep &= np.cumsum(mark)[:n] == 0
    lens = np.diff(offsets)
    owner = np.repeat(np.arange(len(lens)), lens)[:n]
    last = np.repeat(offsets[1:], lens)[:n]
    keep &= np.arange(n) + k <= last
    return np.minimum(fwd, rev)[keep], owner[keep]


@lru_cache(maxsize=4096)
def _slot_map(t: int) -> np.ndarray:
    """From which slot an empty one borrows in the ``t``-th attempt, the same for all texts."""
    return (mix(np.arange(SLOTS, dtype=np.uint64) + np.uint64(t * SLOTS + 77)) % np.uint64(SLOTS)).astype(np.int64)


def first_tokens(words: np.ndarray, owner: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """First token of each text under ``SLOTS`` orders, and which texts have tokens at all.

    Each token belongs to one slot and is hashed once; a slot without tokens borrows from another
    chosen by a fixed hash, which keeps the probability of agreement at the similarity.
    """
    h = mix(words)
    slot = ((h >> np.uint64(32)) * np.uint64(SLOTS) >> np.uint64(32)).astype(np.int64)
    low = np.full(n * SLOTS, _NONE, np.uint64)
    np.minimum.at(low, owner * SLOTS + slot, h)
    low = low.reshape(n, SLOTS)
    own = low != _NONE
    some = own.any(axis=1)
    row, col = np.nonzero(~own & some[:, None])
    t = 0
    while len(row):
        src = _slot_map(t)[col]
        ok = own[row, src]
        low[row[ok], col[ok]] = low[row[ok], src[ok]]
        row, col = row[~ok], col[~ok]
        t += 1
        if t > 40 * SLOTS:  # never seen: a set of one token fills up in about 6 * SLOTS attempts
            low[row, col] = np.uint64(t)
            break
    return low, some


def band_keys(low: np.ndarray) -> np.ndarray:
    """One 64-bit key per group of orders, from the prefixes under all orders of the group."""
    g = low.reshape(len(low), BANDS, ROWS)
    key = np.broadcast_to(np.arange(BANDS, dtype=np.uint64), g.shape[:2]).copy()
    for r in range(ROWS):
        key = mix(key ^ mix(g[:, :, r]))
    return key.view(np.int64)


def _flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column without nulls."""
    column = column.cast(pa.large_string())
    bufs = column.buffers()
    off = np.frombuffer(bufs[1], np.int64, len(column) + 1, column.offset * 8)
    data = np.frombuffer(bufs[2], np.uint8)[off[0] : off[-1]] if bufs[2] is not None else np.zeros(0, np.uint8)
    return data, off - off[0]


#: Bytes of text that are turned into words at once; bounds a worker's memory whatever the texts' lengths.
CHUNK = 1 << 22


def distinct_words(text: np.ndarray, k: int) -> np.ndarray:
    """Sorted distinct words of one text of any length."""
    got = np.zeros(0, np.uint32)
    for at in range(0, max(1, len(text) - k + 1), CHUNK):
        part = text[at : at + CHUNK + k - 1]
        got = np.union1d(got, words_of(part, np.array([0, len(part)]), k)[0])
    return got


def _slices(off: np.ndarray) -> Iterator[tuple[int, int]]:
    """Stretches of rows of at most ``CHUNK`` bytes and 1024 rows together; a longer text stands alone."""
    a, n = 0, len(off) - 1
    while a < n:
        b = max(a + 1, min(a + 1024, int(np.searchsorted(off, off[a] + CHUNK, "right")) - 1))
        yield a, b
        a = b


def set_hashes(words: np.ndarray, owner: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit hashes of the set of tokens of each text, whatever their order and repetition."""
    pair = np.sort((owner.astype(np.uint64) << np.uint64(32)) | words.astype(np.uint64))
    pair = pair[np.flatnonzero(np.r_[True, pair[1:] != pair[:-1]][: len(pair)])]
    owner = (pair >> np.uint64(32)).astype(np.int64)
    h = mix(pair & np.uint64(0xFFFFFFFF))
    out = []
    for x in (h, mix(h ^ np.uint64(0x5851F42D4C957F2D))):
        total = np.zeros(n, np.uint64)
        np.add.at(total, owner, x)
        out.append(mix(total).view(np.int64))
    return out[0], out[1]


def _sketch(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            all_data, all_off = _flat(whole.column("text"))
            for a, z in _slices(all_off):
                b = whole.slice(a, z - a)
                data, off = all_data[all_off[a] : all_off[z]], all_off[a : z + 1] - all_off[a]
                if len(data) > CHUNK:
                    words = distinct_words(data, k)
                    owner = np.zeros(len(words), np.int64)
                else:
                    words, owner = words_of(data, off, k)
                low, some = first_tokens(words, owner, b.num_rows)
                keys = band_keys(low[some])
                pick = pa.array(np.flatnonzero(some))
                bands = pa.ListArray.from_arrays(pa.array(np.arange(len(keys) + 1, dtype=np.int32) * BANDS), pa.array(keys.reshape(-1)))
                h1, h2 = (pa.array(h[some]) for h in set_hashes(words, owner, b.num_rows))
                yield pa.RecordBatch.from_arrays([b.column("id").take(pick), h1, h2, bands], names=["id", "h1", "h2", "bands"])

    return run


def _verify(k: int, threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets: dict[str, np.ndarray] = {}  # of this batch only

            def tokens(s: str) -> np.ndarray:
                if (got := sets.get(s)) is None:
                    got = sets[s] = distinct_words(np.frombuffer(s.encode(), np.uint8), k)
                return got

            keep, sims = [], []
            for i, (x, y) in enumerate(zip(b.column("text_a").to_pylist(), b.column("text_b").to_pylist())):
                x, y = tokens(x), tokens(y)
                both = len(np.intersect1d(x, y, assume_unique=True))
                sim = both / max(1, len(x) + len(y) - both)
                if sim >= threshold:
                    keep.append(i)
                    sims.append(sim)
            idx = pa.array(keep, pa.int64())
            yield pa.RecordBatch.from_arrays([b.column("a").take(idx), b.column("b").take(idx), pa.array(sims, pa.float64())], names=["a", "b", "similarity"])

    return run


def key_pairs(keyed: DataFrame, block: int = BLOCK) -> DataFrame:
    """Pairs ``a < b`` of classes ``rep`` that share a ``key``, each pair once; a key of many classes is split into pairs of blocks."""
    return pairs_by_key(keyed, ["key"], "rep", block=block).select("a", "b").distinct()


def class_links(df: DataFrame, id_col: str, text_col: str, threshold: float = 0.5, k: int = 11) -> tuple[DataFrame, DataFrame]:
    """Links between classes of sequences of one word set, and the membership of the records.

    ``(links: a, b, similarity; members: id, rep)`` with ``a < b`` representatives (the smallest id
    of a class). A class holds the records whose words are the same set, whose similarity is 1 by definition:
    copies on either strand, but also repeats of one unit of different lengths. Copies cost one row each,
    however many there are; only representatives are compared.

    Defined cases: null and empty texts, texts without a valid word and records without an id are in no class;
    ids are taken to be unique longs (each row of a repeated one counts); an empty table gives empty results; texts of any length are used
    whole; other columns are ignored.
    """
    t = df.select(F.col(id_col).cast("long").alias("id"), cleaned(text_col).alias("text")).filter(F.col(text_col).isNotNull() & F.col(id_col).isNotNull())
    sketched = materialize(t.mapInArrow(_sketch(k), "id long, h1 long, h2 long, bands array<long>"), "sketches")
    classes = sketched.groupBy("h1", "h2").agg(F.min("id").alias("rep"), F.first("bands").alias("bands"))
    members = sketched.select("id", "h1", "h2").join(sketched.groupBy("h1", "h2").agg(F.min("id").alias("rep")), ["h1", "h2"]).select("id", "rep")
    cand = materialize(key_pairs(classes.select("rep", F.explode("bands").alias("key"))), "candidates")

    needed = cand.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    texts = t.select("id", "text").join(needed, "id", "left_semi")
    pairs = cand.join(texts.select(F.col("id").alias("a"), F.col("text").alias("text_a")), "a").join(texts.select(F.col("id").alias("b"), F.col("text").alias("text_b")), "b")
    return pairs.mapInArrow(_verify(k, threshold), "a long, b long, similarity double"), members


def similar_pairs(links: DataFrame, members: DataFrame) -> DataFrame:
    """All pairs of records, copies expanded: ``id_a < id_b``."""
    m_a, m_b = members.select(F.col("id").alias("x"), F.col("rep").alias("a")), members.select(F.col("id").alias("y"), F.col("rep").alias("b"))
    between = links.select("a", "b").join(m_a, "a").join(m_b, "b").select("x", "y")
    within = m_a.join(m_b, F.col("a") == F.col("b")).filter("x < y").select("x", "y")
    return between.unionByName(within).select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b"))


def groups(links: DataFrame, members: DataFrame, max_rounds: int = 40) -> DataFrame:
    """One row per record: ``id, rep, group_id, n_links``.

    ``group_id`` is the smallest id reachable over links of class representatives, ``n_links`` the
    number of other classes that the record's class is linked to. Labels travel along links and
    jump to the label of their label; every round is written as a table.
    """
    both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    both = materialize(both, "links")
    label = materialize(both.select(F.col("a").alias("node")).distinct().withColumn("label", F.col("node")), "labels")
    for _ in range(max_rounds):
        seen = both.join(label, both["b"] == label["node"]).groupBy("a").agg(F.min("label").alias("m"))
        new = label.join(seen, label["node"] == seen["a"], "left").select("node", F.least("label", F.coalesce("m", "label")).alias("l2"), "label")
        jump = label.select(F.col("node").alias("l2"), F.col("label").alias("l3"))
        new = materialize(new.join(jump, "l2", "left").select("node", F.least("l2", F.coalesce("l3", "l2")).alias("label"), F.col("label").alias("old")), "labels")
        changed = new.filter("label < old").limit(1).count()
        label = new.select("node", "label")
        if not changed:
            break
    else:
        raise RuntimeError("labels still change: raise max_rounds")
    n = both.groupBy("a").agg(F.count(F.lit(1)).alias("n"))
    out = members.join(label, members["rep"] == label["node"], "left").drop("node").join(n, members["rep"] == n["a"], "left").drop("a")
    return out.select("id", "rep", F.coalesce("label", "rep").alias("group_id"), F.coalesce("n", F.lit(0)).alias("n_links"))
