"""Hidden Markov models over texts: training by counting along best paths, normalisation, decoding."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Model:
    """Log probabilities of ``start[state]``, ``go[from][to]`` and ``emit[state][letter]``; letters outside ``letters`` say nothing."""

    letters: str
    start: tuple[float, ...]
    go: tuple[tuple[float, ...], ...]
    emit: tuple[tuple[float, ...], ...]


def model(letters: str, start, go, emit) -> Model:
    """From weights, which are normalised to probabilities."""
    log = lambda ws: tuple(math.log(w / sum(ws)) for w in ws)
    return Model(letters, log(start), tuple(map(log, go)), tuple(map(log, emit)))


def best_path(text: str, m: Model) -> np.ndarray:
    """Most likely states of a text; of equal paths the one of smaller states counts."""
    at = {c: i for i, c in enumerate(m.letters)}
    states = range(len(m.start))
    score = list(m.start)
    back = np.zeros((len(text), len(m.start)), np.int8)
    for i, c in enumerate(text):
        j = at.get(c)
        if i:
            new = []
            for s in states:
                best = max(states, key=lambda r: (score[r] + m.go[r][s], -r))
                back[i, s] = best
                new.append(score[best] + m.go[best][s])
            score = new
        if j is not None:
            score = [score[s] + m.emit[s][j] for s in states]
    path = np.zeros(len(text), np.int8)
    if len(text):
        path[-1] = max(states, key=lambda s: (score[s], -s))
        for i in range(len(text) - 1, 0, -1):
            path[i - 1] = back[i, path[i]]
    return path


def train(df: DataFrame, text: str, m: Model, rounds: int = 2) -> Model:
    """Recounts transitions and emissions along the best paths of all texts, ``rounds`` times; each count begins at one.

    What comes to the driver is one row per transition and per state and letter.
    """
    k = len(m.start)

    def count(batches: Iterator[pa.RecordBatch], m: Model) -> Iterator[pa.RecordBatch]:
        go, emit = np.zeros((k, k), np.int64), np.zeros((k, len(m.letters)), np.int64)
        table = np.full(256, 255, np.uint8)
        table[np.frombuffer(m.letters.encode(), np.uint8)] = np.arange(len(m.letters))
        for b in batches:
            for t in b.column(0).to_pylist():
                if t:
                    p = best_path(t, m)
                    np.add.at(go, (p[:-1], p[1:]), 1)
                    c = table[np.frombuffer(t.encode("ascii", "replace"), np.uint8)]
                    np.add.at(emit, (p[c != 255], c[c != 255]), 1)
        rows = [(0, s, r, int(go[s, r])) for s in range(k) for r in range(k)] + [(1, s, j, int(emit[s, j])) for s in range(k) for j in range(len(m.letters))]
        yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in rows], pa.int64()) for i in range(4)], names=["what", "a", "b", "n"])

    for _ in range(rounds):
        got = df.select(text).mapInArrow(lambda bs, m=m: count(bs, m), "what long, a long, b long, n long").groupBy("what", "a", "b").agg(F.sum("n").alias("n")).collect()
        n = {(r.what, r.a, r.b): r.n + 1 for r in got}
        weight = lambda what, width: [[n.get((what, s, j), 1) for j in range(width)] for s in range(k)]
        m = model(m.letters, [math.exp(x) for x in m.start], weight(0, k), weight(1, len(m.letters)))
    return m


def stretches(df: DataFrame, id_col: str, text: str, m: Model, state: int) -> DataFrame:
    """Runs of ``state`` on the best path of each text: ``id_col, first, last`` (1-based, closed)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, firsts, lasts = [], [], []
            for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                inside = np.r_[False, best_path(t or "", m) == state, False].astype(np.int8)
                edge = np.diff(inside)
                a, z = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
                ids += [i] * len(a)
                firsts += (a + 1).tolist()
                lasts += z.tolist()
            yield pa.RecordBatch.from_arrays([pa.array(ids, b.column(0).type), pa.array(firsts, pa.int64()), pa.array(lasts, pa.int64())], names=[id_col, "first", "last"])

    return df.select(id_col, text).mapInArrow(run, f"{id_col} {df.schema[id_col].dataType.simpleString()}, first long, last long")
