import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from seqloom.llm import mixing, neardup, pieces, stuffing, terms, tokens

DNA = "ACGT"


def mutate(r, s, rate):
    out = []
    for c in s:
        x = r.random()
        if x < rate / 3:
            continue
        if x < 2 * rate / 3:
            out.append(r.choice(DNA))
        out.append(r.choice(DNA) if x > 1 - rate / 3 else c)
    return "".join(out)


# ---- term frequencies


@pytest.mark.parametrize("parts,batch", [("4", "10000"), ("7", "3")])
def test_terms_against_counting(spark, parts, batch):
    r = random.Random(2)
    rows = [(i, r.choice(["hot", "hot", "hot", "a", "b", None, f"t{i % 40}"]), r.choice(["x", "y", None]), r.choice(["s1", "s2", "s3", None])) for i in range(600)]
    rows += rows[:50] + [(None, "hot", "x", "s1")]
    df = spark.createDataFrame(rows, "id long, a string, b string, home string").withColumn("term", F.lit("clash"))
    old = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.execution.arrow.maxRecordsPerBatch")}
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = {(x.field, x.term): (x.n_records, x.n_homes) for x in terms.term_frequencies(df, {"a": F.col("a"), "b": F.col("b")}, "id", "home").collect()}
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    want = {}
    for i, a, b, h in rows:
        for f, t in (("a", a), ("b", b)):
            if t is not None and i is not None:
                x = want.setdefault((f, t), (set(), set()))
                x[0].add(i)
                x[1].add(h)
    assert got == {k: (len(i), len(h - {None})) for k, (i, h) in want.items()}


def test_terms_marks_and_empty(spark):
    df = spark.createDataFrame([(1, "r", "s1"), (2, "c", "s1"), (3, "c", "s2"), (4, "c", "s3"), (5, "o", "s9")], "id long, t string, home string")
    f = terms.term_frequencies(df, {"t": F.col("t")}, "id", "home")
    homes = df.agg(F.count_distinct("home").alias("n"))
    got = {tuple(x) for x in terms.marked_terms(f, homes).collect()}
    assert got == {("t", "r", "rare"), ("t", "o", "rare"), ("t", "c", "common")}
    assert terms.term_frequencies(df.limit(0), {"t": F.col("t")}, "id", "home").collect() == []


# ---- pieces


@pytest.mark.parametrize("seed", range(3))
def test_pieces_cover_the_text(spark, seed):
    r = random.Random(seed)
    texts = []
    for n in (0, 99, 100, 101, 250, 1000, 5000):
        s = "".join(r.choice(DNA) for _ in range(n))
        for _ in range(n // 120):
            a = r.randrange(max(1, n))
            s = s[:a] + "N" * r.choice([3, 10, 12, 30]) + s[a:]
        texts.append(s)
    texts += ["N" * 500, "A" * 90 + "N" * 300 + "C" * 90, None]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, seq string").withColumn("cuts", F.lit("clash"))
    plan = pieces.split_plan(df, "seq", 100, 10)
    got = {}
    for x in pieces.pieces(plan, "id", "seq", 10, ("cuts",)).orderBy("id", "piece_no").collect():
        got.setdefault(x.id, []).append(x)
    assert set(got) == {i for i, s in enumerate(texts) if s and len(s) > 100}
    assert all(p.cuts == "clash" for ps in got.values() for p in ps)
    for i, ps in got.items():
        s = texts[i]
        assert all(len(p.piece) <= 100 and p.piece == s[p.piece_start - 1 : p.piece_end] for p in ps)
        assert ps[0].piece_start == 1 and ps[-1].piece_end == len(s)
        assert all(b.piece_start == a.piece_end - 10 + 1 for a, b in zip(ps, ps[1:]))
    import re

    found = {}
    for x in pieces.found_boundaries(plan, "id").collect():
        found.setdefault(x.id, set()).add(x.boundary_pos)
    for i in got:
        want = {m.end() + 1 for m in re.finditer("N{10,}", texts[i]) if m.start() and m.end() < len(texts[i])}
        assert found[i] == (want or {0})


def test_cut_prefers_the_strongest_boundary():
    cuts = lambda *a: pieces.bisect_cuts(*a, 100, 10)
    assert cuts(160, [(60, 12), (80, 10), (100, 12)]) == ([(60, True), (100, True)], [80])  # a tie: the first; then its right part
    assert cuts(160, []) == ([(80, False)], [])
    assert cuts(160, [(30, 50)])[0][0] == (30, True)  # none in the middle half
    assert cuts(90, [(40, 99)]) == ([], [40])


def brute_cuts(n, bounds, limit, overlap):
    """The rule, recursively and over all boundaries at every step."""

    def part(lo, hi):
        if hi - lo <= limit - overlap:
            return []
        mid = (lo + hi) // 2
        inner = [b for b in bounds if lo + (hi - lo) // 4 <= b[0] <= hi - (hi - lo) // 4 and b[0] > lo + overlap]
        wide = [b for b in bounds if lo + overlap < b[0] < hi - overlap]
        best = sorted(inner or wide, key=lambda b: (-b[1], abs(b[0] - mid), b[0]))
        cut = best[0][0] if best else mid
        return part(lo, cut) + [cut] + part(cut, hi)

    return part(0, n)


def test_cuts_against_recursion():
    r = random.Random(4)
    for _ in range(300):
        n = r.randint(50, 2000)
        bounds = sorted({x: r.randint(10, 14) for x in r.sample(range(11, n), min(n - 11, r.randint(0, 25)))}.items())
        cuts, kept = pieces.bisect_cuts(n, bounds, 100, 10)
        assert [c for c, _ in cuts] == brute_cuts(n, bounds, 100, 10)
        assert sorted([c for c, x in cuts if x] + kept) == [b for b, _ in bounds]


# ---- near-duplicates


def jaccard(a, b, k):
    turn = str.maketrans("ACGT", "TGCA")

    def words(s):
        return {min(w, w.translate(turn)[::-1]) for w in (s[i : i + k] for i in range(len(s) - k + 1)) if set(w) <= set(DNA)}

    x, y = words(a), words(b)
    return len(x & y) / len(x | y) if x and y else 0


def test_near_duplicates_against_all_pairs(spark):
    r = random.Random(7)
    seqs = []
    for _ in range(14):
        base = "".join(r.choice(DNA) for _ in range(r.choice([40, 150, 700, 2500])))
        for rate in (0, 0.01, 0.03, 0.05, 0.12):
            s = mutate(r, base, rate)
            if r.random() < 0.4:
                s = s.translate(str.maketrans("ACGT", "TGCA"))[::-1]
            if r.random() < 0.3:
                s = s[:20].lower() + "\n" + s[20:]
            seqs.append(s)
    seqs += [seqs[0], seqs[0], "N" * 50, "", None, "ACGT", "A" * 40, "T" * 90, "ACGTACGTAC*GTACGTACGTNACGGTCA"]
    df = spark.createDataFrame([(i * 3, s) for i, s in enumerate(seqs)], "seq_id long, chrseq string").withColumn("id", F.lit("clash"))
    links, members = neardup.class_links(df, "seq_id", "chrseq")
    got = {tuple(x) for x in neardup.similar_pairs(links, members).collect()}
    clean = ["".join((s or "").split()).upper() for s in seqs]
    want = {(i * 3, j * 3) for i in range(len(seqs)) for j in range(i + 1, len(seqs)) if jaccard(clean[i], clean[j], 11) >= 0.5}
    assert got == want
    g = {x.id: x for x in neardup.groups(links, members).collect()}
    for a, b in want:
        assert g[a].group_id == g[b].group_id
    assert all(g[i].group_id <= i and g[i].rep <= i for i in g)


def test_one_word_set_is_one_class(spark):
    """Runs of A of 5,000 lengths, on both strands: one class, no candidate."""
    df = spark.range(5000).select(F.col("id").alias("seq_id"), F.expr("repeat(if(id % 2 = 0, 'A', 'T'), cast(id + 11 as int))").alias("chrseq"))
    links, members = neardup.class_links(df, "seq_id", "chrseq")
    assert links.count() == 0
    assert {tuple(x) for x in members.groupBy("rep").count().collect()} == {(0, 5000)}


def test_near_duplicates_of_null_ids(spark):
    """A record without an id is in no pair; those with one are not held up by it."""
    r = random.Random(9)
    s = "".join(r.choice(DNA) for _ in range(300))
    rows = [(None, s), (4, s[:280]), (2, s), (None, None), (7, "ACGT")]
    links, members = neardup.class_links(spark.createDataFrame(rows, "seq_id long, chrseq string").withColumn("rep", F.lit("clash")), "seq_id", "chrseq")
    assert [tuple(x) for x in neardup.similar_pairs(links, members).collect()] == [(2, 4)]
    only = spark.createDataFrame([(None, s), (None, s)], "seq_id long, chrseq string")
    links, members = neardup.class_links(only, "seq_id", "chrseq")
    assert neardup.similar_pairs(links, members).collect() == []


@pytest.mark.parametrize("block", [3, 1000])
def test_hot_keys_give_every_pair_once(spark, block):
    r = random.Random(block)
    rows = [(i, k) for k in range(6) for i in r.sample(range(80), [1, 2, 5, 30, 40, 60][k])]
    got = [tuple(x) for x in neardup.key_pairs(spark.createDataFrame(rows, "rep long, key long"), block).collect()]
    of = {}
    for i, k in rows:
        of.setdefault(k, []).append(i)
    want = {(a, b) for v in of.values() for a in v for b in v if a < b}
    assert len(got) == len(set(got)) and set(got) == want


def test_set_hashes_ignore_order_and_repetition():
    import numpy as np

    a, b = neardup.set_hashes(np.array([5, 9, 5, 9, 5, 7], np.uint32), np.array([0, 0, 0, 1, 1, 2]), 4)
    assert a[0] == a[1] and b[0] == b[1] and len(set(a.tolist())) == 3 and len(set(b.tolist())) == 3


def test_near_duplicates_empty_and_long(spark):
    df = spark.createDataFrame([], "seq_id long, chrseq string")
    links, members = neardup.class_links(df, "seq_id", "chrseq")
    assert neardup.similar_pairs(links, members).collect() == [] and neardup.groups(links, members).collect() == []
    r = random.Random(1)
    s = "".join(r.choice(DNA) for _ in range(300_000))
    old, neardup.CHUNK = neardup.CHUNK, 1 << 12
    try:
        import numpy as np

        data = np.frombuffer(s.encode(), np.uint8)
        cut = neardup.distinct_words(data, 11)
    finally:
        neardup.CHUNK = old
    assert (cut == neardup.distinct_words(data, 11)).all()


def test_sketch_agreement_estimates_similarity():
    import numpy as np

    r = np.random.default_rng(1)
    for n in (30, 300, 5000):
        both, only = r.integers(0, 1 << 22, n), r.integers(0, 1 << 22, (2, n // 2))
        x, y = np.union1d(both, only[0]).astype(np.uint32), np.union1d(both, only[1]).astype(np.uint32)
        low, _ = neardup.first_tokens(np.r_[x, y], np.r_[np.zeros(len(x), int), np.ones(len(y), int)], 2)
        true = len(np.intersect1d(x, y)) / len(np.union1d(x, y))
        assert abs((low[0] == low[1]).mean() - true) < 0.17


# ---- encoding


@pytest.fixture(scope="module")
def enc():
    import public_tokenizers as P

    return tokens.encoder(tokens.default_path(), P.PATTERN)


@settings(max_examples=400, deadline=None)
@given(st.text(st.sampled_from(" \t\n\r\x0b\x0c\x1c\x1f 　 \u0085ab'sdlrveàABé中😀1९,.!?_-<|>"), max_size=40))
def test_fragments_do_not_change_ids(enc, s):
    assert enc.encode(s) == enc.plain.encode_ordinary(s)
    assert "".join(enc.pieces(s)) == s
    assert [i for b in enc.blocks(s, 3) for i in enc.plain.encode_ordinary(b)] == enc.plain.encode_ordinary(s)


@settings(max_examples=500, deadline=None)
@given(st.text(st.characters(min_codepoint=33, max_codepoint=0x2FFF, exclude_categories=["Cs"]) | st.sampled_from("'s#tqzxj#jq'"), max_size=60))
def test_cuts_within_words_do_not_change_ids(enc, s):
    assert enc.encode(s) == enc.plain.encode_ordinary(s)
    assert "".join(enc.pieces(s)) == s
    assert [i for b in enc.blocks(s, 3) for i in enc.plain.encode_ordinary(b)] == enc.plain.encode_ordinary(s)


def test_every_free_byte_pair_cuts(enc):
    """Printable characters without any space: as many fragments as free pairs; a sequence whose pairs all occur in tokens stays whole."""
    r = random.Random(8)
    s = "".join(chr(r.randint(33, 126)) for _ in range(20_000))
    free = sum(not enc.inside[ord(a), ord(b)] for a, b in zip(s, s[1:]) if "'" not in (a, b))
    assert len(enc.pieces(s)) == free + 1 > 10_000
    assert enc.encode(s) == enc.plain.encode_ordinary(s)
    assert len(enc.blocks(s, 1000)) >= 15
    assert enc.pieces("ACGT" * 1000) == ["ACGT" * 1000]


def test_tokens_come_from_merges(enc):
    """A fragment that is a token as a whole gets the ids that merging its bytes would give; else cuts could change them."""
    ranks = enc.plain._mergeable_ranks
    r = random.Random(1)
    for token in r.sample(sorted(ranks), 5000):
        parts = [token[i : i + 1] for i in range(len(token))]
        while len(parts) > 1:
            best = min(range(len(parts) - 1), key=lambda i: ranks.get(parts[i] + parts[i + 1], 1 << 30))
            if parts[best] + parts[best + 1] not in ranks:
                break
            parts[best : best + 2] = [parts[best] + parts[best + 1]]
        assert parts == [token]


def test_a_vocabulary_that_joins_spaces(tmp_path):
    import base64

    words = [bytes([i]) for i in range(256)] + [b"a ", b"a b", b"\xa0 "]
    (tmp_path / "v").write_bytes(b"".join(base64.b64encode(w) + b" %d\n" % i for i, w in enumerate(words)))
    e = tokens.Encoder(str(tmp_path / "v"), r"[^x]+|x+")
    assert e.pieces("a b c à d") == ["a b", " c", " à d"]


def test_encoding_a_table(spark, enc, monkeypatch):
    long = "word à  x\n" * 40_000
    texts = ["Hello world", "", None, " ", "<|endoftext|> é", "Hello world", long, "A" * 300_000]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("ids", F.lit("clash"))
    got = {r.id: list(r.ids) for r in tokens.encode_corpus(df, "doc_id", "text").collect()}
    assert got == {i: enc.plain.encode_ordinary(t or "") for i, t in enumerate(texts)}
    n = {r.id: r.n_tokens for r in tokens.encode_corpus(df, "doc_id", "text", count_only=True).collect()}
    assert n == {i: len(v) for i, v in got.items()}
    assert tokens.encode_corpus(df.limit(0), "doc_id", "text").collect() == []


def test_long_texts_with_repeated_and_null_ids(spark):
    texts = ["word x\n" * 40_000, "other y\n" * 40_000]
    df = spark.createDataFrame([(i, t) for i in (7, None) for t in texts], "doc_id long, text string")
    n = [len(tokens.encoder(*tokens._settings(None, None)).encode(t)) for t in texts]
    for count_only in (False, True):
        got = tokens.encode_corpus(df, "doc_id", "text", count_only=count_only).collect()
        assert sorted((r.id is None, r[1] if count_only else len(r[1])) for r in got) == sorted((x, k) for x in (False, True) for k in n)


# ---- mixing


def test_mix_reaches_the_shares(spark):
    r = random.Random(3)
    recs = [(i, r.choices(["big", "mid", "small"], [60, 30, 5])[0], r.randint(1, 60)) for i in range(3000)] + [(9001, None, 5), (9002, "big", 0), (9003, "big", None), (9004, "unnamed", 9)]
    tg = [("m", "big", 0.5, 1), ("m", "mid", 0.3, 2), ("m", "small", 0.2, 4), ("n", "small", 0.9, 1), ("n", "absent", 0.1, 1)]
    df, t = spark.createDataFrame(recs, "id long, source string, size int"), spark.createDataFrame(tg, "mix string, source string, share double, cap int")
    picked, rep = mixing.mix(df, t)
    rows = picked.collect()
    cap = {(m, s): c for m, s, _, c in tg}
    assert all(1 <= x.copies <= cap[x.mix, x.source] for x in rows) and len({(x.mix, x.id) for x in rows}) == len(rows)
    for x in rep.collect():
        if x.mix == "m":
            assert abs(x.reached - x.share) < 0.01
        assert x.picked_size == sum(y.size * y.copies for y in rows if (y.mix, y.source) == (x.mix, x.source))
    assert {x.source for x in rep.collect() if x.mix == "n" and x.picked_size == 0} == {"absent"}
    assert [x.reached for x in mixing.mix(df.limit(0), t)[1].collect()] == [0.0] * 5


def test_mix_total_and_determinism(spark, monkeypatch):
    monkeypatch.setattr(mixing, "PER_BUCKET", 40)
    df = spark.range(2000).select("id", F.when(F.col("id") % 3 == 0, "a").otherwise("b").alias("source"), F.lit(10).alias("size"))
    t = spark.createDataFrame([("m", "a", 0.5, 3), ("m", "b", 0.5, 1)], "mix string, source string, share double, cap int")
    x, rep = mixing.mix(df, t, total=8000)
    y, _ = mixing.mix(df.repartition(7), t, total=8000)
    assert {tuple(r) for r in x.collect()} == {tuple(r) for r in y.collect()}
    assert {r.source: r.picked_size for r in rep.collect()} == {"a": 4000, "b": 4000}
    _, rep = mixing.mix(df, t, total=10**9)
    assert {r.source: (r.picked_size, r.max_copies) for r in rep.collect()} == {"a": (667 * 30, 3), "b": (1333 * 10, 1)}


# ---- stuffing

PROSE = "After masking, the gap between the two segments is 54 bases wide, so the threshold stays where it was. The consensus was rebuilt from 12 copies. "
CASES = {
    "gel ladder is gel ladder the gel ladder for gel ladder with gel ladder and best gel ladder. " * 8 + PROSE: True,
    "cheap kit, kit price, kit sale, best kit, kit online, gel kit, kit offer, kit " * 10: True,
    "\n".join(f"https://a{i}.example/x » plasmid" for i in range(30)) + "\n" + PROSE: True,
    "  ".join(f"#primer_kit_{i}x" for i in range(40)): True,
    "  ".join(f"gel ladder SKU-{1000 + i} {i}.99 EUR" for i in range(40)): True,
    PROSE * 6: False,
    PROSE * 4 + "See https://a.example/b. " + PROSE + "Keywords: gel ladder, primer kit": False,
    "\n".join(f"[10:{i}:22] INFO block {i} of 30 done" for i in range(10, 50)): False,
    "\n".join(f"chr{i}\t{i * 7}\t{i * 9}\t+\tname\tLTR/Gypsy" for i in range(30)): False,
    ">s1\n" + "ACGTTGCAAC" * 6 + "\n" + "ACGTTGCATC" * 6: False,
    "$ tool --in a.fa --out b.fa\n$ tool --in c.fa --out d.fa": False,
}


@pytest.mark.parametrize("n", range(len(CASES)))
def test_stuffing_cases(n):
    text, spam = list(CASES.items())[n]
    assert (sum(stuffing.stuffed_share(text)) > 0.5) is spam


def test_stuffing_table(spark):
    texts = [None, "", " \n\t ", "x", list(CASES)[0], list(CASES)[0], "a" * 200_000, "kit " * 60_000]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("links", F.lit("clash"))
    got = {r.id: r.spam_share for r in stuffing.stuffing(df, "doc_id", "text").collect()}
    assert got[0] == got[1] == got[2] == 0 and got[4] == got[5] > 0.5 and got[7] > 0.5 and len(got) == 8
    assert stuffing.stuffing(df.limit(0), "doc_id", "text").collect() == []
