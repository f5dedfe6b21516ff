"""Queries of alignments, clusters and repeat detectors."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from seqloom.functions import search
from seqloom.functions import sequence as sq
from seqloom.operators import consensus as cs
from seqloom.operators import chains, hmm, nearby, rowwise, seeds
from seqloom.operators import intervals as iv
from seqloom.operators.ordered import ordered_groups
from seqloom.operators.pairs import pairs_by_key
from seqloom.queries.intervals_q import _L, elements, hits
from seqloom.queries.registry import registry
from seqloom.queries.scalar import _S, _shared, seqs
from seqloom.session import materialize, table

QUERIES, SQL, query = registry()

# alignments: the whole sequences of a genome, unknown bases as gaps; shorter rows have gaps up to the end of the longest
_MSA = f"{_S}, raw AS (SELECT genome AS family, seq_id AS row, CASE WHEN q = '' THEN '-' ELSE translate(q, 'N', '-') END AS x FROM s WHERE genome IS NOT NULL), msa AS (SELECT family, row, length(x) AS n, rpad(x, CAST(max(length(x)) OVER (PARTITION BY family) AS INTEGER), '-') AS seq FROM raw)"
_CELLS = f"{_MSA}, e AS (SELECT family, row, n, unnest(range(0, length(seq))) AS col, unnest(string_split(seq, '')) AS base FROM msa)"
_COMP = f"{_CELLS}, comp AS (SELECT family, col, base, count(*) AS n, min(row) AS first_row FROM e GROUP BY 1, 2, 3), tot AS (SELECT family, count(*) AS total FROM msa GROUP BY 1)"
_BEST = "b AS (SELECT family, col, (list(base ORDER BY n DESC, first_row))[1] AS top, (list(n ORDER BY n DESC, first_row))[1] AS top_n, (list(base ORDER BY n DESC, first_row) FILTER (base <> '-'))[1] AS letter, coalesce((list(n ORDER BY n DESC, first_row) FILTER (base <> '-'))[1], 0) AS letter_n, coalesce(sum(n) FILTER (base = '-'), 0) AS gaps FROM comp GROUP BY 1, 2)"


def msa(spark, d):
    """Gapped rows, written once: their lengths, families and letters are read one by one."""
    t = seqs(spark, d).filter("genome is not null")
    return materialize(t.select(F.col("genome").alias("family"), F.col("seq_id").alias("row"), _gapped("q").alias("seq")), "msa")


def _gapped(q: str):
    return F.when(F.col(q) == "", "-").otherwise(F.translate(q, "N", "-"))


@query("agg_a18_composition", f"WITH {_COMP} SELECT * FROM comp")
def a18(spark, d):
    return cs.columns(msa(spark, d), ragged=True)


@query("agg_a19_majority", f"WITH {_COMP}, {_BEST} SELECT family, coalesce(string_agg(CASE WHEN letter_n > total // 2 THEN letter ELSE '' END, '' ORDER BY col), '') AS consensus FROM b JOIN tot USING (family) GROUP BY 1")
def a19(spark, d):
    return cs.majority(msa(spark, d), ragged=True)


@query("agg_a20_boundary_consensus", f"WITH {_COMP}, {_BEST} SELECT family, string_agg(CASE WHEN top_n >= total // 2 THEN CASE WHEN top = '-' THEN '' ELSE top END ELSE coalesce(letter, '') END, '' ORDER BY col) AS consensus FROM b JOIN tot USING (family) GROUP BY 1")
def a20(spark, d):
    return cs.boundary_consensus(msa(spark, d), ragged=True)


@query("re_r6_sparse_columns", f"WITH {_COMP}, {_BEST}, k AS (SELECT family, col FROM b JOIN tot USING (family) WHERE gaps <= total / 2), x AS (SELECT e.family, e.row, string_agg(e.base, '' ORDER BY e.col) AS seq FROM e JOIN k USING (family, col) GROUP BY 1, 2) SELECT m.family, m.row, coalesce(x.seq, '') AS seq FROM msa m LEFT JOIN x ON x.family = m.family AND x.row = m.row")
def r6(spark, d):
    return cs.drop_sparse(msa(spark, d), ragged=True)


@query("fn_f43_pixels", f"WITH {_COMP}, l AS (SELECT family, col, sum(n) AS letters FROM comp WHERE base IN ('A', 'C', 'G', 'T') GROUP BY 1, 2), u AS (SELECT e.family, e.col, e.base, count(*) AS n FROM e WHERE e.col < e.n GROUP BY 1, 2, 3) SELECT e.family, e.row, e.col, CASE WHEN e.base = '-' THEN 0 ELSE 100 END AS block, CAST(CASE WHEN e.base = '-' THEN 0 WHEN letters > 0 THEN floor(100 * u.n / letters) ELSE 0 END AS INTEGER) AS support, CASE e.base WHEN 'G' THEN 100 WHEN 'C' THEN 75 WHEN 'A' THEN 50 WHEN 'T' THEN 25 ELSE 0 END AS code FROM e JOIN u USING (family, col, base) LEFT JOIN l USING (family, col) WHERE e.col < e.n")
def f43(spark, d):
    """Cells of the rows; those after the end of a row, all 0, are not listed."""
    return cs.pixels(msa(spark, d))


@query("win_w7_homology_boundary")
def w7(spark, d):
    """Boundary of homology in alignments of copies of the library's hits: here of whole near copies."""
    family = c1(spark, d).select(F.col("name").cast("long").alias("seq_id"), F.col("cluster").alias("family"))
    t = seqs(spark, d).join(family, "seq_id")
    return rowwise.homology_boundary(t.select("family", F.col("seq_id").alias("row"), _gapped("q").alias("seq")), 5)


# ---- clusters


def library_hits(spark, d):
    """Hits of library entries on each other, from annotations that share bases: ``query, subject`` with both coordinate pairs."""
    h = hits(spark, d).withColumns({"lo": F.least("s_start", "s_end"), "hi": F.greatest("s_start", "s_end"), "plus": F.col("s_start") <= F.col("s_end")})
    side = lambda n: h.select(F.col("subject").alias("place"), *[F.col(c).alias(f"{c}{n}") for c in ("ann_id", "query", "q_start", "q_end", "q_len", "lo", "hi", "plus")])
    p = iv.overlap_join(side(1), side(2), ["place"], "lo1", "hi1", "lo2", "hi2").filter("query1 <> query2")
    a, b = F.greatest("lo1", "lo2"), F.least("hi1", "hi2")

    def within(n: int, x):
        """Position in the entry of a place, along the entry's own strand; within its stretch even where lengths differ."""
        far = F.when(F.col(f"plus{n}"), x - F.col(f"lo{n}")).otherwise(F.col(f"hi{n}") - x)
        return F.least(F.col(f"q_start{n}") + far, F.col(f"q_end{n}")).cast("long")

    q1, q2, s1, s2 = within(1, a), within(1, b), within(2, a), within(2, b)
    swap = q1 > q2  # the query runs forwards; the subject turns with it
    return p.select(F.col("query1").alias("query"), F.col("query2").alias("subject"), F.when(swap, q2).otherwise(q1).alias("q_start"), F.when(swap, q1).otherwise(q2).alias("q_end"), F.when(swap, s2).otherwise(s1).alias("s_start"), F.when(swap, s1).otherwise(s2).alias("s_end"), F.col("q_len1").alias("q_len"), F.col("q_len2").alias("s_len")).distinct()


def longest_chains(h):
    """Longest chain of each pair of entries: ``query, subject, q_len, s_len``, the stretches it covers on both."""
    c = chains.chain_hits(h.withColumn("gap", F.floor(F.col("q_len") * 0.2).cast("long")), "gap")
    q, s = F.col("q_end") - F.col("q_start") + 1, F.abs(F.col("s_end") - F.col("s_start")) + 1
    return c.groupBy("query", "subject").agg(F.max_by(F.struct(q.alias("q_len"), s.alias("s_len")), F.struct(q, s)).alias("x")).select("query", "subject", "x.*")


@query("clu_c2_first_come")
def c2(spark, d):
    """Greedy clusters of library entries in library order: chained hits that cover 80 % of either entry."""
    lib = table(spark, d, "te_library").select(F.col("te_name").alias("name"), F.col("cons_len").alias("len"), "ordinal").filter("len is not null")
    return cs.first_come_clusters(lib, longest_chains(library_hits(spark, d)), 0.8)


def flank_frames(spark, d, width: int = 20):
    """Both ends of each sequence, side by side: ``seq_id, genome, frame``."""
    t = seqs(spark, d).filter(F.length("q") >= 2 * width)
    return t.select("seq_id", "genome", F.concat(F.left("q", F.lit(width)), F.right("q", F.lit(width))).alias("frame"))


@query("clu_c4_components")
def c4(spark, d):
    """Density clusters with one member enough: components of end frames of 40 letters with at most four mismatches."""
    return nearby.hamming_clusters(flank_frames(spark, d), [], "seq_id", "frame", 4)


@query("clu_c7_by_flanks")
def c7(spark, d):
    """Sequences in order, without those whose ends differ from a kept one's in at most four letters of 40."""
    t = flank_frames(spark, d)
    first = t.groupBy("frame").agg(F.min("seq_id").alias("node"))
    return nearby.greedy_kept(first.select("node", F.col("node").alias("ord")), nearby.hamming_pairs(first, [], "node", "frame", 4)).select(F.col("node").alias("seq_id"))


@query("clu_c8_flank_share")
def c8(spark, d):
    """Share of a family's rows whose window on either side is in a cluster of two or more; below 0.9 on both sides the ends are its own."""
    t = seqs(spark, d).filter("length(q) >= 40 and genome is not null")
    out = None
    for name, w in (("left_share", F.left("q", F.lit(20))), ("right_share", F.right("q", F.lit(20)))):
        x = t.select("genome", "seq_id", w.alias("w"))
        c = x.join(nearby.hamming_clusters(x, ["genome"], "seq_id", "w", 2), "seq_id").groupBy("genome", "cluster").agg(F.count(F.lit(1)).alias("n"))
        c = c.groupBy("genome").agg(F.round(F.coalesce(F.sum(F.when(F.col("n") > 1, F.col("n"))), F.lit(0)) / F.sum("n"), 6).alias(name))
        out = c if out is None else out.join(c, "genome")
    return out.withColumn("own_ends", (F.col("left_share") < 0.9) & (F.col("right_share") < 0.9))


_CONT = "greatest(0, least(a.e, b.e) - greatest(a.s, b.s)) >= 0.95 * (a.e - a.s)"


@query("clu_c5_fragments", f"WITH {_L} SELECT DISTINCT a.ltr_id FROM l a WHERE NOT EXISTS (SELECT 1 FROM l b WHERE a.chrom = b.chrom AND a.ltr_id <> b.ltr_id AND a.s <= b.e AND b.s <= a.e AND (a.e - a.s < b.e - b.s OR (a.e - a.s = b.e - b.s AND a.ltr_id > b.ltr_id)) AND {_CONT})")
def c5(spark, d):
    """Elements without those of which 95 % lie in a longer one (or an equally long one with a smaller id)."""
    e = elements(spark, d, "i_")
    la, lb = F.col("i_e") - F.col("i_s"), F.col("o_e") - F.col("o_s")
    p = iv.overlap_join(e, elements(spark, d, "o_"), ["chrom"], "i_s", "i_e", "o_s", "o_e").filter("i_id <> o_id")
    p = p.filter(((la < lb) | ((la == lb) & (F.col("i_id") > F.col("o_id")))) & (iv.overlap_len("i_s", "i_e", "o_s", "o_e") >= 0.95 * la))
    return e.select("i_id").distinct().join(p.select("i_id").distinct(), "i_id", "left_anti").select(F.col("i_id").alias("ltr_id"))


@query("clu_c10_majority_label", "WITH c AS (SELECT te_name, te_class, count(*) AS n FROM te_copies WHERE te_name IS NOT NULL AND te_class IS NOT NULL GROUP BY 1, 2), b AS (SELECT te_name, (list(te_class ORDER BY n DESC, te_class))[1] AS label FROM c GROUP BY 1) SELECT ordinal, label FROM te_copies JOIN b USING (te_name)")
def c10(spark, d):
    """Each copy with the most frequent class of its family; ties by name. The family's state is joined back."""
    t = table(spark, d, "te_copies")
    c = t.filter("te_name is not null and te_class is not null").groupBy("te_name", "te_class").agg(F.count(F.lit(1)).alias("n"))
    best = c.groupBy("te_name").agg(F.min_by("te_class", F.struct(-F.col("n"), "te_class")).alias("label"))
    return t.join(best, "te_name").select("ordinal", "label")


_SEED = "k AS (SELECT DISTINCT seq_id, w FROM (SELECT seq_id, unnest(list_transform(range(1, greatest(1, length(q) - 14)), lambda i: substr(q, i, 16))) AS w FROM s) WHERE NOT contains(w, 'N'))"


def seed_pairs(t):
    """Pairs of the sequences ``seq_id, q`` that share ten words of 16 letters or more; words in one sequence only are dropped first, words in many are split over tasks."""
    k = t.select("seq_id", F.explode(F.array_distinct(sq.words("q", 16))).alias("w")).filter(~F.contains("w", F.lit("N")))
    return pairs_by_key(k, ["w"], "seq_id").groupBy(F.col("a").alias("x"), F.col("b").alias("y")).agg(F.count(F.lit(1)).alias("seeds")).filter("seeds >= 10")


@query("join_j21_seed_pairs", f"WITH {_S}, {_SEED} SELECT a.seq_id AS x, b.seq_id AS y, count(*) AS seeds FROM k a JOIN k b ON a.w = b.w AND a.seq_id < b.seq_id GROUP BY 1, 2 HAVING count(*) >= 10")
def j21(spark, d):
    return seed_pairs(seqs(spark, d))


def identity_clusters(t):
    """Longest-first greedy clusters of the sequences ``seq_id, q`` joined by shared seeds that cover half of the shorter one or more."""
    t = t.filter(F.length("q") >= 80)
    n = t.select("seq_id", F.length("q").alias("len"))
    both = seeds.subject_pairs(t.select("seq_id", "q", F.greatest(F.lit(10), F.ceil(F.length("q") / 2) - 15).alias("need")))
    if both is None:  # too many letters for words as numbers
        p = seed_pairs(t)
        both = p.select(F.col("x").alias("query"), F.col("y").alias("subject"), "seeds").union(p.select("y", "x", "seeds"))
    name = lambda c: F.col(c).cast("string")
    spans = both.select(name("query").alias("query"), name("subject").alias("subject"), F.lit(0).alias("q_len"), (F.col("seeds") + 15).alias("s_len"))
    order = n.select(name("seq_id").alias("name"), "len", (F.lit(1 << 40) * (F.lit(1 << 20) - F.col("len")) + F.col("seq_id")).alias("ordinal"))
    return cs.first_come_clusters(order, spans, 0.5)


@query("clu_c1_identity_clusters")
def c1(spark, d):
    return identity_clusters(seqs(spark, d))


@query("clu_c9_contained_names")
def c9(spark, d):
    """Entries of DNA elements that a chain places within an entry of the LTR class, or the other way round, by 95 %."""
    lib = table(spark, d, "te_library").filter("cons_len is not null").select(F.col("te_name").alias("name"), F.split("te_class", "/")[0].alias("kind"), "cons_len")
    side = lambda n: lib.select(F.col("name").alias(n), F.col("kind").alias(f"{n}_kind"), F.col("cons_len").alias(f"{n}_total"))
    p = longest_chains(library_hits(spark, d)).join(side("query"), "query").join(side("subject"), "subject").filter("query_kind = 'DNA' and subject_kind = 'LTR'")
    inside = (F.col("q_len") >= 0.95 * F.col("query_total")) | (F.col("s_len") >= 0.95 * F.col("subject_total"))
    return p.filter(inside).select(F.col("query").alias("inner_name"), F.col("subject").alias("outer_name")).distinct()


# ---- detectors


# elements with sequences, as in the interval queries: element n has the sequence of seq_id n
_ELEM = f"{_S}, e AS (SELECT ltr_id, any_value(element_end - element_start + 1) AS n, any_value(superfamily) AS superfamily, any_value(ltr_identity) AS identity FROM ltr_intact GROUP BY 1), x AS (SELECT e.*, s.q FROM e JOIN s ON s.seq_id = e.ltr_id)"
_SITE = f"l AS (SELECT ltr_id, substr(q, 11, 20) AS l, substr(q, length(q) - 29, 20) AS r FROM x WHERE length(q) >= 100), site AS (SELECT ltr_id, coalesce({', '.join(_shared(k) for k in range(20, 4, -1))}, '') AS site FROM l)"


def _elements_with_text(spark, d):
    t = table(spark, d, "ltr_intact").groupBy("ltr_id").agg(F.first(F.col("element_end") - F.col("element_start") + 1).alias("n"), F.first("superfamily").alias("superfamily"), F.first("ltr_identity").alias("identity"))
    return t.join(seqs(spark, d).select(F.col("seq_id").alias("ltr_id"), "q"), "ltr_id")


def _site(q: str):
    """Longest word of more than four letters in both windows of 20 letters outside the element from letter 31 to 30 before the end; empty without one."""
    return F.coalesce(sq.shared_site(F.substring(q, 11, 20), F.col(q).substr(F.length(q) - 29, F.lit(20)), range(20, 4, -1)), F.lit(""))


@query("v8_marked_sites", f"WITH {_ELEM}, {_SITE} SELECT ltr_id, site FROM site")
def v8(spark, d):
    """Duplicated site of each element, looked for in windows of 20 letters; elements without one are kept and marked empty."""
    return _elements_with_text(spark, d).filter("length(q) >= 100").select("ltr_id", _site("q").alias("site"))


_PPT = "regexp_matches(right(q, 200), '[AG]{12,}') OR regexp_matches(left(q, 200), '[CT]{12,}')"


def _chain_sql(sine: str) -> str:
    return f"WITH {_ELEM}, {_SITE} SELECT x.ltr_id, site.site FROM x JOIN site USING (ltr_id) WHERE {sine} AND n BETWEEN 400 AND 22000 AND coalesce(superfamily NOT LIKE 'DNA%' AND superfamily <> 'TIR', true) AND ({_PPT})"


def filter_chain(x, terminal: float | None = None, sine: bool = False, length=(400, 22000)):
    """The filters of a detector in order: likeness of the terminal repeats and tail of a SINE (both off by default), length, DNA elements, purine tract; the site is a mark, no filter."""
    if terminal is not None:
        x = x.filter(F.col("identity") >= terminal)
    if sine:
        x = x.filter(~F.coalesce(sq.near_poly_tail("q"), F.lit(False)))
    x = x.filter(F.col("n").between(*length)).filter(F.coalesce(~F.startswith("superfamily", F.lit("DNA")) & (F.col("superfamily") != "TIR"), F.lit(True)))
    x = x.filter(F.right("q", F.lit(200)).rlike("[AG]{12,}") | F.left("q", F.lit(200)).rlike("[CT]{12,}"))
    return x.filter("length(q) >= 100").select("ltr_id", _site("q").alias("site"))


@query("v6_filter_chain", _chain_sql("true"))
def v6(spark, d):
    return filter_chain(_elements_with_text(spark, d))


@query("v6_filter_chain_all", _chain_sql("identity >= 90 AND NOT coalesce(CASE WHEN length(q) < 6 THEN false ELSE list_bool_or(list_transform(range(greatest(0, length(q) - 11), length(q) - 5), lambda i: length(replace(substr(q, i + 1, 6), 'A', '')) <= 1 OR length(replace(substr(q, i + 1, 6), 'T', '')) <= 1)) END, false)"))
def v6_all(spark, d):
    """With the two filters that are off by default."""
    return filter_chain(_elements_with_text(spark, d), 90, True)


@query("v9_successor_removal")
def v9(spark, d):
    """An element goes when the next kept one starts inside it and ends at or after its end."""

    def step(key: tuple, rows: list[tuple]) -> list[tuple]:
        out: list[tuple] = []
        for r in rows:
            while out and out[-1][2] >= r[2] and out[-1][2] <= r[3] and r[2] <= out[-1][3] <= r[3]:
                out.pop()
            out.append(r)
        return [(r[0],) for r in out]

    t = elements(spark, d)
    m = iv.merged(t, ["chrom"], "s", "e", 0).select("chrom", F.col("span_start").alias("island"), F.col("span_end").alias("last"))
    t = iv.overlap_join(t, m, ["chrom"], "s", "e", "island", "last").select("id", "chrom", "s", "e", "island")
    return ordered_groups(t, ["chrom", "island"], ["s", "e", "id"], step, "ltr_id long")


@query("v4_merged_runs", f"WITH {_S}, k AS (SELECT seq_id, unnest(range(1, length(q) - 6)) AS pos, substr(q, unnest(range(1, length(q) - 6)), 8) AS w FROM s WHERE length(q) >= 8), x AS (SELECT seq_id, pos, lead(pos) OVER (PARTITION BY seq_id, w ORDER BY pos) - pos AS dist FROM k), y AS (SELECT *, pos - row_number() OVER (PARTITION BY seq_id, dist ORDER BY pos) AS g FROM x WHERE dist BETWEEN 20 AND 2000) SELECT seq_id, dist, min(pos) AS run_start, max(pos) + 7 AS run_end FROM y GROUP BY seq_id, dist, g HAVING count(*) >= 5")
def v4(spark, d):
    """Runs of neighbouring words that come back at the same distance: repeat pairs without gaps."""
    t = seqs(spark, d).filter(F.length("q") >= 8).select("seq_id", F.posexplode(sq.words("q", 8)).alias("p", "w")).withColumn("pos", F.col("p") + 1)
    x = t.select("seq_id", "pos", (F.lead("pos").over(W.partitionBy("seq_id", "w").orderBy("pos")) - F.col("pos")).alias("dist")).filter("dist between 20 and 2000")
    y = x.withColumn("g", F.col("pos") - F.row_number().over(W.partitionBy("seq_id", "dist").orderBy("pos")))
    return y.groupBy("seq_id", "dist", "g").agg(F.min("pos").alias("run_start"), (F.max("pos") + 7).alias("run_end"), F.count(F.lit(1)).alias("n")).filter("n >= 5").select("seq_id", "dist", "run_start", "run_end")


@query("v5_gapped_repeats")
def v5(spark, d):
    """The runs of nearly one distance, joined over gaps of up to 100: left and right part of a repeat pair."""
    runs = v4(spark, d).withColumn("band", F.floor(F.col("dist") / 10).cast("long"))
    m = iv.merged(runs, ["seq_id", "band"], "run_start", "run_end", 101)
    return m.select("seq_id", (F.col("band") * 10).alias("dist_from"), F.col("span_start").alias("left_start"), F.col("span_end").alias("left_end")).filter("left_end - left_start >= 11")


@query("v15_two_state_path")
def v15(spark, d):
    """Stretches in the AT-rich state of a two-state model, whose transitions and emissions are counted along the best paths of all sequences, twice."""
    t = seqs(spark, d).select("seq_id", "q")
    first = hmm.model("ATCGN", (1, 1), ((99, 1), (1, 99)), ((30, 30, 18, 18, 4), (38, 38, 10, 10, 4)))
    m = hmm.train(t, "q", first, 2)
    return hmm.stretches(t, "seq_id", "q", m, 1).select("seq_id", F.col("first").alias("rich_start"), F.col("last").alias("rich_end"))


def _by_length(t, text: str, width: int):
    """Rows with texts of about one length side by side, ``width`` letters of them or more where there are as many, spread over many tasks."""
    t = t.withColumn("band", F.floor(F.log(1.15, F.length(text))).cast("int"))
    n = t.groupBy("band").agg(F.sum(F.length(text)).alias("letters"))
    part = F.pmod(F.xxhash64("seq_id"), F.ceil(F.col("letters") / width))
    tasks = max(8 * t.sparkSession.sparkContext.defaultParallelism, int(t.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return t.join(F.broadcast(n), "band").withColumn("part", part).repartition(tasks, "band", "part")


@query("v17_alignment_scores")
def v17(spark, d):
    """Global and local score, longest common subsequence and substring of both halves of each sequence; a middle letter goes to the right one.

    The work is quadratic in the length: short pairs are worked on many at a time, long ones next to others of their length."""
    t = _by_length(seqs(spark, d).filter(F.length("q") > 0).select("seq_id", "q"), "q", 2 * search.WIDTH)
    half = F.floor(F.length("q") / 2).cast("int")
    return t.select("seq_id", search.pair_scores(F.left("q", half), F.right("q", F.length("q") - half)).alias("x")).select("seq_id", "x.*")


@query("v18_purine_tracts", f"WITH {_S} SELECT seq_id, nullif(regexp_extract(right(q, 200), '[AG]{{10,}}'), '') AS tract, nullif(regexp_extract(left(q, 200), '[CT]{{10,}}'), '') AS back_tract, nullif(regexp_extract(right(q, 50), 'A{{8,}}'), '') AS poly_a FROM s")
def v18(spark, d):
    """Tails: first run of ten purines or more in the last 200 letters (on the other strand, of pyrimidines in the first), and of eight A or more in the last 50."""
    z = lambda c, p: F.nullif(F.regexp_extract(c, f"({p})", 1), F.lit(""))
    return seqs(spark, d).select("seq_id", z(F.right("q", F.lit(200)), "[AG]{10,}").alias("tract"), z(F.left("q", F.lit(200)), "[CT]{10,}").alias("back_tract"), z(F.right("q", F.lit(50)), "A{8,}").alias("poly_a"))


@query("v19_hairpin_ends")
def v19(spark, d):
    """Hairpins before CTAGT, exact or with one other letter (level 1), and the nearest TC pattern within 3,000 letters upstream."""
    t = seqs(spark, d)
    x = t.select("seq_id", F.explode(search.helitrons("q")).alias("x"))
    return x.select("seq_id", "x.*")


@query("v23_paired_ends", f"WITH {_L} SELECT a.ltr_id AS head, b.ltr_id AS tail FROM l a JOIN l b ON a.chrom = b.chrom AND b.s > a.e AND b.s - a.e <= 1000")
def v23(spark, d):
    """Heads and tails that lie at most 1,000 bases apart: a binned range join."""
    h = elements(spark, d, "h_").withColumns({"w0": F.col("h_e") + 1, "w1": F.col("h_e") + 1000})
    t = elements(spark, d, "t_").withColumn("t_s2", F.col("t_s"))
    return iv.overlap_join(h, t, ["chrom"], "w0", "w1", "t_s", "t_s2").select(F.col("h_id").alias("head"), F.col("t_id").alias("tail"))


@query("v35_label_transfer", """WITH x AS (SELECT trim(ele) AS ele, nullif(replace(trim(ele_class), '?', ''), '') AS label, strand, try_cast(regexp_replace(c1, '[()]', '', 'g') AS BIGINT) AS a, try_cast(regexp_replace(c2, '[()]', '', 'g') AS BIGINT) AS b, try_cast(regexp_replace(c3, '[()]', '', 'g') AS BIGINT) AS c FROM rm_out WHERE trim(ele) <> ''),
y AS (SELECT ele, label, CASE WHEN strand = '+' THEN b + c ELSE b + a END AS len, CASE WHEN strand = '+' THEN a ELSE c END AS s, b AS e FROM x), z AS (SELECT * FROM y WHERE s <= e AND len > 0), n AS (SELECT ele, max(len) AS len FROM z GROUP BY 1),
m AS (SELECT *, max(e) OVER (PARTITION BY ele, label ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pe FROM (SELECT DISTINCT ele, label, s, e FROM z WHERE label IS NOT NULL) q),
r AS (SELECT ele, label, sum(CASE WHEN pe IS NULL OR s > pe THEN e - s + 1 WHEN e <= pe THEN 0 ELSE e - pe END) AS covered FROM m GROUP BY 1, 2), t AS (SELECT ele, label, covered, row_number() OVER (PARTITION BY ele ORDER BY covered DESC, label) AS k FROM r)
SELECT n.ele, round(t.covered::DOUBLE / n.len, 6) AS ratio, CASE WHEN t.covered >= 0.8::DOUBLE * n.len THEN t.label ELSE 'Unknown' END AS label FROM n LEFT JOIN t ON t.ele = n.ele AND t.k = 1""")
def v35(spark, d):
    """Label of each name: the class whose hits, merged in positions of the name, cover most of it, if that is 80 %."""
    x = table(spark, d, "rm_out").withColumn("label", F.nullif(F.replace(F.trim("ele_class"), F.lit("?"), F.lit("")), F.lit("")))
    bare = lambda c: F.regexp_replace(c, "[()]", "").try_cast("long")
    plus = F.col("strand") == "+"
    z = x.filter("trim(ele) <> ''").select(F.trim("ele").alias("ele"), "label", F.when(plus, bare("c2") + bare("c3")).otherwise(bare("c2") + bare("c1")).alias("len"), F.when(plus, bare("c1")).otherwise(bare("c3")).alias("s"), bare("c2").alias("e")).filter("s <= e and len > 0")
    n = z.groupBy("ele").agg(F.max("len").alias("len"))
    best = iv.covered_bases(z, ["ele", "label"], "s", "e").groupBy("ele").agg(F.min_by(F.struct("label", "covered"), F.struct(-F.col("covered"), "label")).alias("x"))
    j = n.join(best, "ele", "left")
    return j.select("ele", F.round(F.col("x.covered") / F.col("len"), 6).alias("ratio"), F.when(F.col("x.covered") >= 0.8 * F.col("len"), F.col("x.label")).otherwise("Unknown").alias("label"))
