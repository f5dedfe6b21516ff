"""Keyword-stuffed texts, link lists and lists of product tags.

A text is cut into segments (lines, and the sentences of a line). Log lines, table rows, sequence
records and commands are left aside. Then the words are looked at as a series:

* recurrence gaps: in sentences a content word seldom comes back within a few words; in stuffed text
  most do, with small words between or without;
* positional autocorrelation: the share of positions that hold the same word a lag later. A lag that
  stands out from those around it, with words that come back at just that distance nearly every
  time, is unnaturally regular, however long it is;
* lists: segments of names without small words, unless they have the form of a sentence;
* links take their labels with them; tags and priced items are told by their form.

Small words (function words) are learnt from all texts of a language: short words in many of its texts
whose counts are spread evenly, where keywords are heaped up in few texts. A text of a language that
the collection does not teach has its words of up to three letters taken for small.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from operator import eq, sub
from statistics import median

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from seqloom.session import materialize

#: Words within which the return of a content word counts as too soon, and the usual distance of a stuffed keyword.
LAGS, KEY_GAP = 8, 5
#: Longest lag at which regular recurrence is looked for, and gaps that a word needs to show it.
MOST_LAG, LEAST_GAPS = 64, 8
#: Small words: letters at most, least share of a language's texts, least evenness, most per language; languages with fewer are not learnt.
SMALL_LETTERS, SMALL_SHARE, EVEN, MOST_SMALL, LEAST_SMALL = 4, 0.25, 0.72, 150, 10
#: Languages in less than this share of the texts are not learnt: at most 1,000 are.
LANGUAGE_SHARE = 0.001

_URL = re.compile(r"""(?:\b[a-z]{2,8}:)?//[^\s<>"'|]{3,}|\bwww\.[^\s<>"'|]{3,}""", re.I)
_ANCHOR = re.compile(r"<a\b[^>]*>.*?</a\s*>|\[[^\]\n]*\]\([^)\s]*\)", re.I | re.S)
_LINE = re.compile(r"(?:\s*<br\s*/?>\s*|[\n\r\x0b\x0c\u0085  ])+", re.I)
_BREAK = re.compile("[\n\r\x0b\x0c\u0085  ]+")
_SENTENCE = re.compile(r"(?<=[.!?…。！？])[\"')\]]*\s+")
#: What stands between words; a point, hyphen or apostrophe inside a word belongs to it.
_MARKS = bytes.maketrans(b",;:!?()[]{}\"|/\\+*~#<>=%&$@", b" " * 26)
_WIDE = re.compile("[•·»«★…–—€£。！？\xa0]")
_AFTER_QUOTE = re.compile("[.!?][\"')\\]]")
_TAG = re.compile(r"#[^\W\d_][\w-]*")
_ITEM = re.compile(r"\b[A-Z]{2,5}-\d{3,}\b|\b\d+[.,]\d\d\b(?!\s*(?:percent|%|Prozent|pour|por))|[-+]\d{1,2}\s?%|(?:EUR|USD|GBP)\b|[€$£]\s?\d")
_LOG = re.compile(r"^\W{0,2}(?:\d{4}-\d\d-\d\d[ T])?\d\d?:\d\d(?::\d\d)?\b|^\W{0,2}(?:INFO|WARN|ERROR|DEBUG)\b")
_CELLS = re.compile(r"\t| \| |  +|;|,")
_SEPARATOR = re.compile(r"[,;|•·/+\t»\]\[*★~]|\s[-–—]\s|\s{2,}")
_INT = re.compile(r"^[+-]?\d+(?:\.\d+)?$")
_BASES = re.compile(r"^[ACGTUNacgtun*-]{12,}$")
_DIGIT = re.compile(r"\d")
_CLOSED = re.compile(r"[.!?…。！？][\"')\]»]*$")


def structured(line: str) -> bool:
    """Log line, table row, sequence record or command."""
    first = line[0]
    if " " not in line and _BASES.match(line):
        return True
    if (first in "IWED" or not first.isalpha()) and _LOG.match(line):
        return True
    if first == ">" and len(line) > 1 and not line[1].isspace():
        return True
    if line[:2] in ("$ ", "% ") or line.startswith((">>>", "...>")):
        return True
    if line.count(",") + line.count("\t") + line.count(";") + line.count("  ") + line.count(" | ") < 3 or not _DIGIT.search(line):
        return False
    cells = [c.strip() for c in _CELLS.split(line)]
    return len(cells) >= 4 and sum(bool(_INT.match(c)) for c in cells) >= 2 and not _ITEM.search(line)


def _items(segment: str, n_words: int) -> bool:
    """Is it a row of five or more items of a few words each?"""
    n = sum(1 for x in _SEPARATOR.split(segment) if x.strip())
    return n >= 5 and n_words <= 4.5 * n


def _chars(s: str) -> int:
    return len(s) - s.count(" ") - s.count("\t")


def _lines(text: str, low: str) -> list[str]:
    if "<br" in low:
        return _LINE.split(text)
    if text.isascii() and "\x0b" not in text and "\x0c" not in text:  # the same, faster
        return text.replace("\r", "\n").split("\n")
    return _BREAK.split(text)


def _sentences(line: str) -> list[str]:
    if line.isascii() and "\t" not in line and not _AFTER_QUOTE.search(line):  # the same, without look-behind
        return line.replace(". ", ".\n").replace("! ", "!\n").replace("? ", "?\n").split("\n")
    return _SENTENCE.split(line)


def _words(segment: str) -> list[bytes]:
    """Words in lower case, as bytes, which are cut much faster than characters."""
    low = segment.lower()
    if not low.isascii():
        low = _WIDE.sub(" ", low)
    return low.encode().translate(_MARKS).replace(b" - ", b" ").strip(b" .-'_").split()


def _guessed(text: str) -> frozenset[bytes]:
    """Small words of a text of an unlearnt language: those of up to three letters that are no more than an eighth of its words."""
    c = Counter(_words(text))
    n = c.total()
    return frozenset(w for w, k in c.items() if len(w.decode()) <= 3 and (8 * k <= n or k < 10))


def stuffed_share(text: str, small: frozenset[str] | frozenset[bytes] | None = None) -> tuple[float, float, float, float]:
    """Shares of the characters (without white space) that are links, tags, lists and repeated keywords.

    ``small``: small words of the text's language; without them, those that ``_guessed`` finds.
    """
    learnt = small is not None
    if small is None:
        small = _guessed(text)
    elif small and isinstance(next(iter(small)), str):
        small = frozenset(w.encode() for w in small)
    total = links = tags = 0
    low = text.lower()
    has_url, has_tag = "//" in text or "www." in low, "#" in text
    if "](" in text or "<a" in low:
        found = _ANCHOR.findall(text)
        if found:
            n = sum(map(_chars, found))
            links += n
            total += n
            text = _ANCHOR.sub("\n", text)
    is_small = small.__contains__
    rest: list[tuple] = []  # characters, words, number of content words, short items between separators?, a sentence by form?
    for line in _lines(text, low):
        line = line.strip()
        if not line:
            continue
        if structured(line) and not (has_url and _URL.search(line)):
            total += _chars(line)
            rest.append((0, [], 0, False, True))
            continue
        for seg in _sentences(line):
            n = _chars(seg)
            if not n:
                continue
            total += n
            if has_url and (urls := _URL.findall(seg)):
                words = _words(_URL.sub(" ", seg))
                k, n_small = len(words), sum(map(is_small, words))
                in_urls = sum(map(_chars, urls))
                if k >= 5 and n_small >= 0.12 * k and n_small >= len(urls):
                    links += in_urls
                    rest.append((n - in_urls, words, k - n_small, False, True))
                else:
                    links += n
                continue
            if has_tag and (marked := _TAG.findall(seg)) and sum(map(len, marked)) > 0.5 * n:
                tags += n
                continue
            words = _words(seg)
            k, n_small = len(words), sum(map(is_small, words))
            if (n_small < 0.12 * k or not learnt) and _DIGIT.search(seg) and (items := _ITEM.findall(seg)) and len(items) * 8 >= k:
                tags += n
                continue
            listed = n_small <= 0.2 * k and k >= 4 and _items(seg, k)
            form = not listed and _CLOSED.search(seg) is not None
            if not form and not listed and k >= 8:  # as good as a sentence where short words stand as in sentences
                form = n_small > 0.04 * k and sum(len(w) <= 3 for w in words) >= 0.15 * k
            rest.append((n, words, k - n_small, listed, form))
    if not total:
        return 0.0, 0.0, 0.0, 0.0
    lists, repeated = _recurring(rest, small)
    return links / total, tags / total, lists / total, repeated / total


def _regular(series: list[bytes], by_lag: dict[int, list[bytes]]) -> set[bytes]:
    """Of the words that come back at one distance nearly every time, those at whose lag the autocorrelation of the whole series has a peak."""
    n = len(series)
    again = lambda lag: sum(map(eq, series, series[lag:])) / max(1, n - lag)
    out: set[bytes] = set()
    for lag, words in by_lag.items():
        here = again(lag)
        around = [again(x) for x in range(max(1, lag - 5), lag + 6) if x != lag]
        if here >= 1.5 / lag and here >= 2.5 * sum(around) / len(around):
            out.update(words)
    return out


def _recurring(rest: list[tuple], small: frozenset[bytes]) -> tuple[int, int]:
    """Characters of segments that are lists without small words, and of those whose content words recur too soon or too regularly."""
    lists = repeated = 0
    series = [w for x in rest for w in x[1]]
    # a word said twice is none
    places: dict[bytes, list[int]] = {w: [] for w, n in Counter(series).items() if n >= 3 and w not in small}
    if places:
        for i, w in enumerate(series):
            if w in places:
                places[w].append(i)
    near = bytearray(len(series))
    key: set[bytes] = set()  # terms that come back every few words throughout
    by_lag: dict[int, list[bytes]] = {}
    for w, p in places.items():
        gaps = list(map(sub, p[1:], p))
        for j, g in enumerate(gaps):
            if g <= LAGS:
                near[p[j]] = near[p[j + 1]] = 1
        if len(gaps) >= 4:
            m = median(gaps)
            if m <= KEY_GAP:
                key.add(w)
            if len(gaps) >= LEAST_GAPS and 1 < m <= MOST_LAG and 10 * gaps.count(m) >= 8 * len(gaps):
                by_lag.setdefault(int(m), []).append(w)
    regular = _regular(series, by_lag) if by_lag else ()

    run_chars = run_words = a = 0
    for chars, words, content, listed, form in rest:  # consecutive segments without small words make one list
        k = len(words)
        if k and not form and k - content <= (0.2 if listed else 0.04) * k:
            run_chars += chars
            run_words += k
        else:
            if run_words >= 8:
                lists += run_chars
            run_chars = run_words = 0
            if content >= 2 and k >= 4:
                back = near.count(1, a, a + k)
                if (back >= 0.5 * content and back >= 3) or (regular and not regular.isdisjoint(words)) or (key and 6 * sum(map(key.__contains__, words)) >= k):
                    repeated += chars
        a += k
    return lists + (run_chars if run_words >= 8 else 0), repeated


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts and occurrences of the short words of each language, added up over a partition."""
    texts: dict[tuple, int] = {}
    times: dict[tuple, int] = {}

    def out() -> pa.RecordBatch:
        ks = list(texts)
        cols = [pa.array([k[0] for k in ks], pa.string()), pa.array([k[1] for k in ks], pa.string()), pa.array([texts[k] for k in ks], pa.int64()), pa.array([times[k] for k in ks], pa.int64())]
        return pa.RecordBatch.from_arrays(cols, names=["lang", "word", "texts", "times"])

    for b in batches:
        for lang, text in zip(b.column("lang").to_pylist(), b.column("text").to_pylist()):
            if not text:
                continue
            for w, c in Counter(w for w in text.lower().split() if len(w) <= SMALL_LETTERS).items():
                if w.isalpha():
                    k = lang, w
                    texts[k] = texts.get(k, 0) + 1
                    times[k] = times.get(k, 0) + c
            k = lang, ""
            texts[k] = times[k] = texts.get(k, 0) + 1
        if len(texts) > 100_000:
            yield out()
            texts.clear()
            times.clear()
    yield out()


def small_words(df: DataFrame, text_col: str, lang_col: str) -> DataFrame:
    """Small words of each language, from all its texts: ``lang, word``.

    A word of at most ``SMALL_LETTERS`` letters is small if it is in ``SMALL_SHARE`` of the texts or more and
    its occurrences are spread about as evenly as chance would spread them (``EVEN`` of the texts that a
    Poisson distribution would reach). At most ``MOST_SMALL`` words, the most frequent, of each language
    in ``LANGUAGE_SHARE`` of the texts or more: at most 150,000 rows whatever the collection.
    """
    t = df.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text")).filter("lang is not null")
    c = t.mapInArrow(_counts, "lang string, word string, texts long, times long")
    c = materialize(c.groupBy("lang", "word").agg(F.sum("texts").alias("texts"), F.sum("times").alias("times")), "words")
    n = c.filter("word = ''").select("lang", F.col("texts").alias("n"))
    n = n.filter(F.col("n") >= LANGUAGE_SHARE * n.agg(F.sum("n")).scalar())
    reach = F.col("n") * (1 - F.exp(-F.col("times") / F.col("n")))
    x = c.filter("word <> ''").join(n, "lang").filter((F.col("texts") >= SMALL_SHARE * F.col("n")) & (F.col("texts") >= EVEN * reach))
    rank = F.row_number().over(W.partitionBy("lang").orderBy(F.desc("texts"), "word"))
    return x.select("lang", "word", rank.alias("r")).filter(F.col("r") <= MOST_SMALL).select("lang", "word")


def _judge(small: dict[str, frozenset[bytes]]):
    of: dict[bytes, list[str]] = {}
    for lang, words in small.items():
        for w in words:
            of.setdefault(w, []).append(lang)

    def pick(lang: str | None, text: str) -> frozenset[bytes] | None:
        """Small words of the language that the text holds most of, if it holds enough."""
        hits: dict[str, int] = {}
        words = set(text.lower().encode().split())
        for w in words:
            for k in of.get(w, ()):
                hits[k] = hits.get(k, 0) + 1
        if hits:
            best = max(hits, key=lambda k: (hits[k], k == lang, k))
            if hits[best] >= 3 and hits[best] >= 0.08 * len(words):
                return small[best]
        return small.get(lang)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            known: dict[tuple, tuple] = {}  # of this batch only
            rows = []
            for lang, t in zip(b.column("lang").to_pylist(), b.column("text").to_pylist()):
                if not t:
                    rows.append((0.0, 0.0, 0.0, 0.0))
                    continue
                got = known.get((lang, t))
                if got is None:
                    got = known[lang, t] = stuffed_share(t, pick(lang, t))
                rows.append(got)
            cols = [pa.array([r[i] for r in rows], pa.float64()) for i in range(4)]
            yield pa.RecordBatch.from_arrays([b.column("id"), *cols], names=["id", "links", "tags", "lists", "repeated"])

    return run


def stuffing(df: DataFrame, id_col: str, text_col: str, lang_col: str | None = None) -> DataFrame:
    """Shares of each text: ``id, links, tags, lists, repeated, spam_share``, one row per row.

    ``lang_col`` names the language of each text, from which small words are learnt. A text is judged with
    the small words of the language of which it holds most (8 % of its distinct words, three at least), else
    with those of the language that it is said to be in; labels need not be right.
    Null, empty and blank texts have shares of 0; ids may repeat or be null; whole texts are used; an
    empty table gives an empty result; other columns are ignored. Texts are not shuffled: a first pass
    counts short words, the second judges each text on its own.
    """
    kind = df.schema[id_col].dataType.simpleString()
    lang = F.col(lang_col).cast("string") if lang_col else F.lit(None).cast("string")
    t = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), lang.alias("lang"))
    small: dict[str, set] = {}
    if lang_col:
        for r in small_words(df, text_col, lang_col).collect():  # bounded, see there
            small.setdefault(r[0], set()).add(r[1])
    learnt = {k: frozenset(w.encode() for w in v) for k, v in small.items() if len(v) >= LEAST_SMALL}
    got = t.mapInArrow(_judge(learnt), f"id {kind}, links double, tags double, lists double, repeated double")
    return got.withColumn("spam_share", F.col("links") + F.col("tags") + F.col("lists") + F.col("repeated"))
