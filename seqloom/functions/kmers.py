"""Word counts of a text in one Arrow pass: no row is taken apart and put together by shuffles."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def word_numbers(text: str, k: int, letters: str) -> np.ndarray:
    """Numbers of the words of ``k`` letters in order, in base ``len(letters)``; words with other characters are left out."""
    table = np.full(256, 255, np.uint8)
    table[np.frombuffer(letters.encode(), np.uint8)] = np.arange(len(letters))
    code = table[np.frombuffer(text.encode("ascii", "replace"), np.uint8)]
    n = len(code) - k + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    number, known = np.zeros(n, np.int64), np.ones(n, bool)
    for i in range(k):
        part = code[i : i + n]
        number = number * len(letters) + part
        known &= part != 255
    return number[known]


def count_vector(seq: str | Column, k: int, letters: str = "AGCT") -> Column:
    """Counts of all words of ``k`` letters, in the order of ``letters``; null for a null text, zeros for a short one."""

    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([None if t is None else np.bincount(word_numbers(t, k, letters), minlength=len(letters) ** k) for t in texts], dtype=object)

    return F.pandas_udf(run, "array<bigint>")(F.col(seq) if isinstance(seq, str) else seq)


def gapped_words(seq: str | Column, k: int, letters: str = "-ACGT") -> Column:
    """Words of ``k`` letters or gaps that occur, sorted, with their counts: ``words, counts``. Words of gaps only do not count."""

    def run(texts: pd.Series) -> pd.DataFrame:
        alphabet = np.array(list(letters))
        rows = []
        for t in texts:
            if t is None:
                rows.append((None, None))
                continue
            number, n = np.unique(word_numbers(t, k, letters), return_counts=True)
            keep = number != 0
            number, n = number[keep], n[keep]
            digits = number[:, None] // (len(letters) ** np.arange(k - 1, -1, -1))[None, :] % len(letters)
            rows.append((["".join(w) for w in alphabet[digits]], n.tolist()))
        return pd.DataFrame(rows, columns=["words", "counts"])

    return F.pandas_udf(run, "struct<words:array<string>,counts:array<bigint>>")(F.col(seq) if isinstance(seq, str) else seq)
