"""Queries of the scalar sequence functions and of the row-wise predicates."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from seqloom.functions import kmers, search
from seqloom.functions import sequence as sq
from seqloom.operators.running import numbered
from seqloom.queries.registry import registry
from seqloom.session import table
from seqloom.sources import lines as ln

QUERIES, SQL, query = registry()

_S = "s AS (SELECT seq_id, chrname, genome, translate(upper(regexp_replace(chrseq, '\\s', '', 'g')), 'MYHRSKVDBW', 'CCCGGGGGGT') AS q FROM sequences WHERE chrseq IS NOT NULL)"
_RC = "reverse(translate(regexp_replace(upper({0}), '[^ACGT]', 'N', 'g'), 'ACGT', 'TGCA'))"


def seqs(spark: SparkSession, d: str) -> DataFrame:
    """Cleaned sequences: ``seq_id, chrname, genome, q``; null ones left out."""
    t = table(spark, d, "sequences").filter("chrseq is not null")
    return t.select("seq_id", "chrname", "genome", sq.cleaned("chrseq").alias("q"))


def _on_seqs(name: str, sql: str, **cols: Callable[[], Column]):
    """A query that computes columns on every cleaned sequence; they are made when it runs."""

    @query(name, f"WITH {_S} SELECT seq_id, {sql} FROM s")
    def run(spark: SparkSession, d: str) -> DataFrame:
        return seqs(spark, d).select("seq_id", *[c().alias(n) for n, c in cols.items()])

    run.__name__ = name
    return run


_on_seqs("fn_f1_reverse_complement", _RC.format("q") + " AS rc", rc=lambda: sq.reverse_complement("q"))
_on_seqs("fn_f2_only_bases", "regexp_replace(upper(q), '[^ACGT]', '', 'g') AS bases", bases=lambda: sq.only_bases("q"))
_on_seqs("fn_f3_slice", "substr(q, 11, 30) AS part", part=lambda: sq.slice_closed("q", F.lit(11), F.lit(40)))
_on_seqs("fn_f5_ends", "left(q, 5) || right(q, 5) AS tips", tips=lambda: sq.ends("q", 5))
_on_seqs(
    "fn_f10_one_hot_ends",
    "list_transform(range(0, 40), lambda i: CASE WHEN substr(left(q, 5) || right(q, 5), 1 + i // 4, 1) = substr('ATCG', 1 + i % 4, 1) THEN 1 ELSE 0 END) AS code",
    code=lambda: sq.one_hot(sq.ends("q", 5), 10),
)
_on_seqs("fn_f16_end_distance", "CAST(list_sum(list_transform(range(1, 1 + least(length(left(q, 20)), length(right(q, 18)))), lambda i: CASE WHEN substr(left(q, 20), i, 1) <> substr(right(q, 18), i, 1) THEN 1 ELSE 0 END)) + abs(length(left(q, 20)) - length(right(q, 18))) AS BIGINT) AS far", far=lambda: sq.edit_free_distance(F.left("q", F.lit(20)), F.right("q", F.lit(18))))
_on_seqs("fn_f18_motif", "strpos(q, 'TTAA') - 1 AS short_at, coalesce(strpos(q, nullif(regexp_extract(q, '" + sq.motif_pattern("TGACATCA") + "'), '')), 0) - 1 AS long_at", short_at=lambda: sq.motif_position("q", "TTAA"), long_at=lambda: sq.motif_position("q", "TGACATCA"))
_on_seqs(
    "fn_f24_poly_tails",
    "CASE WHEN contains(q, 'AAAAAA') THEN length(q) - strpos(reverse(q), 'AAAAAA') + 1 ELSE -1 END AS a_end, CASE WHEN contains(q, 'TTTTTT') THEN length(q) - strpos(reverse(q), 'TTTTTT') + 1 ELSE -1 END AS t_end",
    a_end=lambda: sq.tail_run_end("q", "A"),
    t_end=lambda: sq.tail_run_end("q", "T"),
)
_on_seqs(
    "fn_f25_near_poly_tail",
    "CASE WHEN length(q) < 6 THEN false ELSE list_bool_or(list_transform(range(greatest(0, length(q) - 11), length(q) - 5), lambda i: length(replace(substr(q, i + 1, 6), 'A', '')) <= 1 OR length(replace(substr(q, i + 1, 6), 'T', '')) <= 1)) END AS near_tail",
    near_tail=lambda: sq.near_poly_tail("q"),
)
_on_seqs("fn_f29_at_rich", "CASE WHEN length(q) > 0 THEN round((length(q) - length(regexp_replace(q, '[AT]', '', 'g')))::DOUBLE / length(q), 6) END AS share, coalesce((length(q) - length(regexp_replace(q, '[AT]', '', 'g')))::DOUBLE / nullif(length(q), 0) > 0.8, false) AS rich", share=lambda: F.round(sq.at_share("q"), 6), rich=lambda: F.coalesce(sq.at_share("q") > 0.8, F.lit(False)))
_on_seqs("fn_f30_unknown_runs", "contains(q, 'NNNNNNNNNN') AS has_run, regexp_full_match(q, 'N+') AS all_n", has_run=lambda: F.contains("q", F.lit("N" * 10)), all_n=lambda: F.col("q").rlike("^N+$"))
_on_seqs("fn_f26_repeat_tail", "1", repeat_tail=lambda: sq.repeat_near_tail(F.right("q", F.lit(20))))
_on_seqs("fn_f27_sine_tail", "1", sine_tail=lambda: sq.tail_like_sine("q"))
del SQL["fn_f26_repeat_tail"], SQL["fn_f27_sine_tail"]  # back-references: no SQL
_on_seqs("v26_inverted_ends", f"CASE WHEN length(q) >= 5 THEN list_sum(list_transform(range(1, 6), lambda i: CASE WHEN substr(q, i, 1) <> substr({_RC.format('right(q, 5)')}, i, 1) THEN 1 ELSE 0 END)) <= 2 END AS inverted", inverted=lambda: F.when(F.length("q") >= 5, sq.mismatches(F.left("q", F.lit(5)), sq.reverse_complement(F.right("q", F.lit(5)))) <= 2))


@query("fn_f4_flanks", f"""WITH {_S}, e AS (SELECT seq_id, q, 1 + seq_id % 300 AS a, 1 + seq_id % 300 + 150 AS b, CASE WHEN seq_id % 2 = 0 THEN '-' ELSE '+' END AS strand FROM s),
p AS (SELECT *, substr(q, greatest(a - 50, 1), b - a + 101) AS part FROM e WHERE a - 50 >= 1 AND b + 50 <= length(q))
SELECT seq_id, CASE WHEN strand = '-' THEN {_RC.format('part')} ELSE part END AS flanked FROM p""")
def fn_f4(spark, d):
    a = 1 + F.col("seq_id") % 300
    t = seqs(spark, d).withColumns({"a": a, "b": a + 150, "strand": F.when(F.col("seq_id") % 2 == 0, "-").otherwise("+")})
    return t.select("seq_id", sq.flanked("q", "a", "b", "strand", 50).alias("flanked")).filter("flanked is not null")


_K = f"WITH {_S}, k AS (SELECT seq_id, unnest(list_transform(range(1, length(q) - 1), lambda i: substr(q, i, 3))) AS w FROM s WHERE length(q) >= 3)"
_V = "v AS (SELECT a.x || b.x || c.x AS w, row_number() OVER (ORDER BY a.i, b.i, c.i) - 1 AS word_no FROM (VALUES ('A', 0), ('G', 1), ('C', 2), ('T', 3)) a(x, i), (VALUES ('A', 0), ('G', 1), ('C', 2), ('T', 3)) b(x, i), (VALUES ('A', 0), ('G', 1), ('C', 2), ('T', 3)) c(x, i))"


def vocabulary(k: int, letters: str = "AGCT") -> list[str]:
    """All words of ``k`` letters in the order of ``letters``."""
    out = [""]
    for _ in range(k):
        out = [a + b for a in out for b in letters]
    return out


@query("fn_f6_words", _K + " SELECT w, count(*) AS n FROM k GROUP BY w")
def fn_f6(spark, d):
    return seqs(spark, d).select(F.explode(sq.words("q", 3)).alias("w")).groupBy("w").agg(F.count(F.lit(1)).alias("n"))


@query("fn_f7_vocabulary", f"WITH {_V} SELECT w, word_no FROM v")
def fn_f7(spark, d):
    return spark.createDataFrame([(w, i) for i, w in enumerate(vocabulary(3))], "w string, word_no long")


@query("fn_f8_count_vector", f"{_K}, {_V}, g AS (SELECT seq_id, w, count(*) AS n FROM k GROUP BY ALL) SELECT s.seq_id, list(coalesce(g.n, 0) ORDER BY v.word_no) AS vec FROM s CROSS JOIN v LEFT JOIN g ON g.seq_id = s.seq_id AND g.w = v.w GROUP BY s.seq_id")
def fn_f8(spark, d):
    return seqs(spark, d).select("seq_id", kmers.count_vector("q", 3).alias("vec"))


_GAPPED = " UNION ALL ".join(f"SELECT seq_id, {k} AS k, unnest(list_transform(range(1, length(q) - {k - 2}), lambda i: translate(substr(q, i, {k}), 'N', '-'))) AS w FROM s WHERE length(q) >= {k}" for k in (3, 4, 5))


@query("fn_f9_gapped_counts", f"WITH {_S}, a AS (SELECT seq_id, unnest([3, 4, 5]) AS k FROM s), w AS ({_GAPPED}), n AS (SELECT seq_id, k, w, count(*) AS n FROM w WHERE replace(w, '-', '') <> '' AND regexp_full_match(w, '[ACGT-]+') GROUP BY ALL) SELECT a.seq_id, a.k, coalesce(list(w ORDER BY w) FILTER (w IS NOT NULL), []) AS words, coalesce(list(n ORDER BY w) FILTER (w IS NOT NULL), []) AS counts FROM a LEFT JOIN n USING (seq_id, k) GROUP BY 1, 2")
def fn_f9(spark, d):
    """Words of three, four and five letters or gaps of each sequence, with their counts; a word of gaps only does not count."""
    t = seqs(spark, d).withColumn("row", F.translate("q", "N", "-"))
    parts = [t.select("seq_id", F.lit(k).alias("k"), kmers.gapped_words("row", k).alias("g")).select("seq_id", "k", "g.words", "g.counts") for k in (3, 4, 5)]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


_TSD = "nullif(upper(replace(tsd, 'TSD:', '')), 'NA')"


@query("fn_f11_one_hot_site", f"""WITH t AS (SELECT ltr_id, {_TSD} AS s FROM ltr_intact) SELECT ltr_id, CASE WHEN s IS NULL OR contains(s, 'N') OR s = '' THEN list_concat([16], list_transform(range(0, 60), lambda i: 1))
 ELSE list_concat([length(s)], list_transform(range(0, 60), lambda i: CASE WHEN substr(s, 1 + i // 4, 1) = substr('ATCG', 1 + i % 4, 1) THEN 1 ELSE 0 END)) END AS code FROM t""")
def fn_f11(spark, d):
    s = F.nullif(F.upper(F.replace("tsd", F.lit("TSD:"), F.lit(""))), F.lit("NA"))
    return table(spark, d, "ltr_intact").select("ltr_id", sq.one_hot_site(s).alias("code"))


CLASSES = ["DNA", "LINE", "LTR", "SINE", "RC", "DIRS", "PLE", "Maverick", "Satellite", "Unknown"]


@query("fn_f12_multi_hot", "SELECT te_name, list_transform([" + ", ".join(f"'{c}'" for c in CLASSES) + "], lambda c: CASE WHEN list_contains(string_split(te_class, '/'), c) THEN 1 ELSE 0 END) AS flags FROM te_library")
def fn_f12(spark, d):
    return table(spark, d, "te_library").select("te_name", sq.multi_hot(F.split("te_class", "/"), CLASSES).alias("flags"))


# headers with the positions of long terminal repeats, of inverted repeats, or without any, by number
_HEAD = "h AS (SELECT seq_id, q, CASE seq_id % 3 WHEN 0 THEN chr(9) || 'LTR:1-' || length(q) // 10 || ',' || (length(q) - length(q) // 10 + 1) || '-' || length(q) WHEN 1 THEN chr(9) || 'TIR:1-' || length(q) // 5 || ',' || length(q) || '-' || (length(q) - length(q) // 5 + 1) ELSE '' END AS header FROM s WHERE length(q) >= 20), t AS (SELECT seq_id, q, CASE seq_id % 3 WHEN 0 THEN left(q, length(q) // 10) WHEN 1 THEN left(left(q, length(q) // 5), 60) ELSE '' END AS terminal, CASE seq_id % 3 WHEN 0 THEN substr(q, length(q) // 10 + 1, length(q) - 2 * (length(q) // 10)) WHEN 1 THEN substr(q, length(q) // 5 + 1, length(q) - 2 * (length(q) // 5)) ELSE q END AS internal FROM h)"


def _split(spark, d) -> DataFrame:
    t = seqs(spark, d).filter(F.length("q") >= 20)
    n, part = F.length("q"), lambda k: F.floor(F.length("q") / k).cast("int")
    pos = lambda kind, k, flip: F.concat(F.lit(f"\t{kind}:1-"), part(k), F.lit(","), *((n, F.lit("-"), n - part(k) + 1) if flip else (n - part(k) + 1, F.lit("-"), n)))
    header = F.when(F.col("seq_id") % 3 == 0, pos("LTR", 10, False)).when(F.col("seq_id") % 3 == 1, pos("TIR", 5, True)).otherwise("")
    terminal, internal = sq.terminal_split("header", "q")
    return t.withColumn("header", header).select("seq_id", "q", terminal.alias("terminal"), internal.alias("internal"))


#: Blocks of a feature vector: words of the internal part, words of the terminal part, both ends, site, classes.
INTERNAL_K, TERMINAL_K, END_LETTERS, SITE_LETTERS = (2, 3), (2,), 5, 15


def feature_length() -> int:
    """Length of the vector: 4 to the power of each word length, four flags per letter of both ends and of the site, its length, and one flag per class."""
    return sum(4**k for k in (*INTERNAL_K, *TERMINAL_K)) + 8 * END_LETTERS + 1 + 4 * SITE_LETTERS + len(CLASSES)


def _vec_sql(part: str, k: int, name: str) -> str:
    letters = "(VALUES ('A', 0), ('G', 1), ('C', 2), ('T', 3))"
    voc = f"SELECT {' || '.join(f'x{i}.c' for i in range(k))} AS w, row_number() OVER (ORDER BY {', '.join(f'x{i}.i' for i in range(k))}) AS no FROM {', '.join(f'{letters} x{i}(c, i)' for i in range(k))}"
    return f"""{name}v AS ({voc}), {name}g AS (SELECT seq_id, w, count(*) AS n FROM (SELECT seq_id, unnest(list_transform(range(1, length({part}) - {k - 2}), lambda i: substr({part}, i, {k}))) AS w FROM t WHERE length({part}) >= {k}) GROUP BY ALL),
{name} AS (SELECT t.seq_id, list(coalesce(g.n, 0) ORDER BY v.no) AS vec FROM t CROSS JOIN {name}v v LEFT JOIN {name}g g ON g.seq_id = t.seq_id AND g.w = v.w GROUP BY 1)"""


@query(
    "fn_f13_features",
    f"""WITH {_S}, {_HEAD}, {_vec_sql('internal', 2, 'i2')}, {_vec_sql('internal', 3, 'i3')}, {_vec_sql('terminal', 2, 't2')},
z AS (SELECT ltr_id AS seq_id, min(nullif(upper(replace(tsd, 'TSD:', '')), 'NA')) AS site FROM ltr_intact GROUP BY 1), c AS (SELECT copy_id AS seq_id, min(te_class) AS cls FROM te_copies GROUP BY 1)
SELECT t.seq_id, list_concat(list_concat(list_concat(i2.vec, i3.vec), t2.vec), list_concat(list_transform(range(0, 40), lambda i: CASE WHEN substr(left(q, 5) || right(q, 5), 1 + i // 4, 1) = substr('ATCG', 1 + i % 4, 1) THEN 1 ELSE 0 END),
 list_concat(CASE WHEN site IS NULL OR contains(site, 'N') OR site = '' THEN list_concat([16], list_transform(range(0, 60), lambda i: 1)) ELSE list_concat([length(site)], list_transform(range(0, 60), lambda i: CASE WHEN substr(site, 1 + i // 4, 1) = substr('ATCG', 1 + i % 4, 1) THEN 1 ELSE 0 END)) END,
 list_transform([{', '.join(f"'{c}'" for c in CLASSES)}], lambda x: CASE WHEN cls = x THEN 1 ELSE 0 END)))) AS features
FROM t JOIN i2 USING (seq_id) JOIN i3 USING (seq_id) JOIN t2 USING (seq_id) LEFT JOIN z USING (seq_id) LEFT JOIN c USING (seq_id)""",
)
def fn_f13(spark, d):
    """All blocks of the feature vector of each sequence. The site and class of number n are those of element n and copy n."""
    site = table(spark, d, "ltr_intact").groupBy(F.col("ltr_id").alias("seq_id")).agg(F.min(F.nullif(F.upper(F.replace("tsd", F.lit("TSD:"), F.lit(""))), F.lit("NA"))).alias("site"))
    cls = table(spark, d, "te_copies").groupBy(F.col("copy_id").alias("seq_id")).agg(F.min("te_class").alias("cls"))
    t = _split(spark, d).join(site, "seq_id", "left").join(cls, "seq_id", "left")
    flags = F.array(*[F.coalesce((F.col("cls") == c).cast("int"), F.lit(0)) for c in CLASSES])
    blocks = [*[kmers.count_vector("internal", k) for k in INTERNAL_K], *[kmers.count_vector("terminal", k) for k in TERMINAL_K], sq.one_hot(sq.ends("q", END_LETTERS), 2 * END_LETTERS), sq.one_hot_site("site", SITE_LETTERS), flags]
    return t.select("seq_id", F.concat(*[b.cast("array<bigint>") for b in blocks]).alias("features"))


@query("fn_f14_terminal_split", f"WITH {_S}, {_HEAD} SELECT seq_id, terminal, internal FROM t")
def fn_f14(spark, d):
    """Terminal and internal part by the positions in the header: long terminal repeats, inverted ones (60 letters), or none."""
    return _split(spark, d).select("seq_id", "terminal", "internal")


@query("fn_f15_mismatch", f"WITH {_S}, p AS (SELECT seq_id, list_sum(list_transform(range(1, 9), lambda i: CASE WHEN substr(q, i, 1) <> substr(q, i + 8, 1) THEN 1 ELSE 0 END)) AS n FROM s WHERE length(q) >= 16) SELECT seq_id, CAST(n AS INTEGER) AS n, n <= 4 AS near FROM p")
def fn_f15(spark, d):
    n = sq.mismatches(F.left("q", F.lit(8)), F.substring("q", 9, 8))
    return seqs(spark, d).filter(F.length("q") >= 16).select("seq_id", n.alias("n"), (n <= 4).alias("near"))


@query("fn_f17_fuzzy_find")
def fn_f17(spark, d):
    t = seqs(spark, d).filter(F.length("q") >= 60)
    return t.select("seq_id", search.fuzzy_ends(F.substring("q", 21, 20), F.col("q")).alias("m")).select("seq_id", "m.*")


@query("fn_f19_confident_site")
def fn_f19(spark, d):
    t = seqs(spark, d).filter(F.length("q") >= 100)
    return t.select("seq_id", search.confident_sites(F.col("q"), F.lit(31), F.length("q") - 30).alias("x")).select("seq_id", "x.*")


@query("fn_f20_aligned_site")
def fn_f20(spark, d):
    t = seqs(spark, d).filter(F.length("q") >= 100).withColumn("row", F.translate("q", "N", "-"))
    return t.select("seq_id", sq.aligned_site("row", F.lit(31), F.length("row") - 30).alias("site"))


@query("fn_f21_ungapped_sides", f"WITH {_S} SELECT seq_id, right(replace(left(translate(q, 'N', '-'), 40), '-', ''), 12) AS l, left(replace(substr(translate(q, 'N', '-'), 41), '-', ''), 12) AS r FROM s")
def fn_f21(spark, d):
    t = seqs(spark, d).withColumn("row", F.translate("q", "N", "-"))
    return t.select("seq_id", sq.ungapped_left("row", F.lit(40), 12).alias("l"), sq.ungapped_right("row", F.lit(41), 12).alias("r"))


def _shared(k: int) -> str:
    ws = lambda t: f"list_transform(range(1, greatest(1, length({t}) - {k - 2})), lambda i: substr({t}, i, {k}))"
    return f"list_filter({ws('r')}, lambda w: NOT contains(w, 'N') AND list_contains({ws('l')}, w))[1]"


@query("fn_f22_shared_site", f"WITH {_S}, x AS (SELECT seq_id, left(q, 11) AS l, right(q, 11) AS r FROM s) SELECT seq_id, coalesce({_shared(6)}, {_shared(5)}, {_shared(4)}) AS site FROM x")
def fn_f22(spark, d):
    return seqs(spark, d).select("seq_id", sq.shared_site(F.left("q", F.lit(11)), F.right("q", F.lit(11))).alias("site"))


@query("fn_f23_nearest_poly_a")
def fn_f23(spark, d):
    return seqs(spark, d).select("seq_id", search.nearest_poly_as("q").alias("run"))


@query("fn_f28_longest_tail_repeat")
def fn_f28(spark, d):
    return seqs(spark, d).select("seq_id", search.longest_tail_repeats("q").alias("x")).select("seq_id", "x.*")


_D = "(1 - ltr_identity / 100)"


@query("fn_f31_insertion_time", f"SELECT ltr_id, CASE WHEN {_D} < 0.75 THEN round(-0.75 * ln(1 - 4 * {_D} / 3) / (2 * 1.3e-8) + 0.0, 2) END AS age FROM ltr_intact")
def fn_f31(spark, d):
    return table(spark, d, "ltr_intact").select("ltr_id", F.round(sq.jukes_cantor_time(F.col("ltr_identity") / 100), 2).alias("age"))


@query("fn_f32_rescaled_time", "WITH i AS (SELECT ltr_id, 1 - 0.75 * (1 - exp(-8 * 1.3e-8 * insertion_time / 3)) AS x FROM ltr_intact) SELECT ltr_id, round(x, 8) AS identity, round(-0.75 * ln(1 - 4 * (1 - x) / 3) / (2 * 7e-9) + 0.0, 0) + 0.0 AS age FROM i")
def fn_f32(spark, d):
    """Ages under one mutation rate turned into identities and into ages under another."""
    t = table(spark, d, "ltr_intact").select("ltr_id", sq.jukes_cantor_identity("insertion_time").alias("x"))
    return t.select("ltr_id", F.round("x", 8).alias("identity"), (F.round(sq.jukes_cantor_time("x", 7e-9), 0) + 0.0).alias("age"))


@query("fn_f33_rename", "SELECT seq_id, 'contig_' || (row_number() OVER (PARTITION BY genome ORDER BY ordinal) - 1) AS new_name FROM sequences")
def fn_f33(spark, d):
    t = numbered(table(spark, d, "sequences").select("seq_id", "genome", "ordinal"), ["genome"], "ordinal", "n")
    return t.select("seq_id", F.concat(F.lit("contig_"), F.col("n").cast("string")).alias("new_name"))


@query("fn_f34_rename_map", "WITH m AS (SELECT DISTINCT genome, chrname FROM sequences WHERE chrname IS NOT NULL AND genome IS NOT NULL), n AS (SELECT *, 'chr_' || (row_number() OVER (PARTITION BY genome ORDER BY chrname) - 1) AS new_name FROM m) SELECT s.seq_id, n.new_name FROM sequences s LEFT JOIN n ON n.genome = s.genome AND n.chrname = s.chrname")
def fn_f34(spark, d):
    t = table(spark, d, "sequences")
    m = t.select("genome", "chrname").filter("chrname is not null and genome is not null").distinct()
    m = m.withColumn("new_name", F.concat(F.lit("chr_"), (F.row_number().over(W.partitionBy("genome").orderBy("chrname")) - 1).cast("string")))
    return t.join(m, ["genome", "chrname"], "left").select("seq_id", "new_name")


@query("fn_f35_segment_offsets", "WITH p AS (SELECT ann_id, seq_name || '$' || (seq_begin // 100000 * 100000) AS part, seq_begin % 100000 AS b, seq_end - seq_begin // 100000 * 100000 AS e FROM rm_out WHERE seq_begin IS NOT NULL) SELECT ann_id, split_part(part, '$', 1) AS chrom, b + CAST(split_part(part, '$', 2) AS BIGINT) AS s, e + CAST(split_part(part, '$', 2) AS BIGINT) AS t FROM p")
def fn_f35(spark, d):
    """Positions on segments named ``chrom$offset``, restored to the chromosome."""
    off = F.floor(F.col("seq_begin") / 100000).cast("long") * 100000
    t = table(spark, d, "rm_out").filter("seq_begin is not null")
    t = t.select("ann_id", F.concat("seq_name", F.lit("$"), off.cast("string")).alias("part"), (F.col("seq_begin") - off).alias("b"), (F.col("seq_end") - off).alias("e"))
    o = F.regexp_extract("part", r"\$(\d+)$", 1).cast("long")
    return t.select("ann_id", F.regexp_extract("part", r"^(.*)\$\d+$", 1).alias("chrom"), (F.col("b") + o).alias("s"), (F.col("e") + o).alias("t"))


@query("fn_f36_split_coordinates", "WITH m AS (SELECT te_name, 1000 * ordinal AS part_start FROM te_library) SELECT c.copy_id, c.te_start + m.part_start AS s, c.te_end + m.part_start AS t FROM te_copies c JOIN m ON m.te_name = c.te_name")
def fn_f36(spark, d):
    m = table(spark, d, "te_library").select("te_name", (F.col("ordinal") * 1000).alias("part_start"))
    return table(spark, d, "te_copies").join(m, "te_name").select("copy_id", (F.col("te_start") + F.col("part_start")).alias("s"), (F.col("te_end") + F.col("part_start")).alias("t"))


@query("fn_f37_labels", "SELECT r.ann_id, coalesce(l.wicker, 'Unknown') AS label FROM rm_out r LEFT JOIN te_library l ON l.te_name = r.ele")
def fn_f37(spark, d):
    lib = table(spark, d, "te_library").select(F.col("te_name").alias("ele"), "wicker")
    return table(spark, d, "rm_out").join(lib, "ele", "left").select("ann_id", F.coalesce("wicker", F.lit("Unknown")).alias("label"))


@query("fn_f38_paired_names", "WITH n AS (SELECT te_name, regexp_replace(te_name, '-?LTR$', '') AS stem FROM te_library WHERE regexp_matches(te_name, 'LTR$')), i AS (SELECT te_name, regexp_replace(te_name, '[-_](I|int)$', '') AS stem FROM te_library WHERE regexp_matches(te_name, '[-_](I|int)$')) SELECT n.te_name AS ltr_name, i.te_name AS internal_name, n.stem || '-LTR' AS joined_name FROM n LEFT JOIN i ON i.stem = n.stem")
def fn_f38(spark, d):
    t = table(spark, d, "te_library").select("te_name")
    n = t.filter("te_name rlike 'LTR$'").select(F.col("te_name").alias("ltr_name"), F.regexp_replace("te_name", "-?LTR$", "").alias("stem"))
    i = t.filter("te_name rlike '[-_](I|int)$'").select(F.col("te_name").alias("internal_name"), F.regexp_replace("te_name", "[-_](I|int)$", "").alias("stem"))
    return n.join(i, "stem", "left").select("ltr_name", "internal_name", F.concat("stem", F.lit("-LTR")).alias("joined_name"))


@query("fn_f39_normalised", "WITH m AS (SELECT event_type, min(value) AS lo, max(value) AS hi, avg(value) AS mu, stddev_pop(value) AS sd FROM events GROUP BY 1) SELECT event_id, round((value - lo) / nullif(hi - lo, 0), 6) AS min_max, round((value - mu) / nullif(sd, 0), 6) AS z FROM events JOIN m USING (event_type)")
def fn_f39(spark, d):
    """Min-max and z-score within event types; the moments are joined, so no window holds a hot type."""
    t = table(spark, d, "events")
    m = t.groupBy("event_type").agg(F.min("value").alias("lo"), F.max("value").alias("hi"), F.avg("value").alias("mu"), F.stddev_pop("value").alias("sd"))
    x = t.join(m, "event_type")
    return x.select("event_id", F.round((F.col("value") - F.col("lo")) / F.nullif(F.col("hi") - F.col("lo"), F.lit(0.0)), 6).alias("min_max"), F.round((F.col("value") - F.col("mu")) / F.nullif("sd", F.lit(0.0)), 6).alias("z"))


@query("fn_f40_log_fold", "SELECT ann_id, round(log2(pct_div + 1) - log2(pct_del + 1), 6) AS fold FROM rm_out")
def fn_f40(spark, d):
    return table(spark, d, "rm_out").select("ann_id", F.round(F.log2(F.col("pct_div") + 1) - F.log2(F.col("pct_del") + 1), 6).alias("fold"))


@query("fn_f41_variation", "SELECT user_id, round(CASE WHEN avg(value) = 0 THEN 0 ELSE stddev_pop(value) / avg(value) END, 6) AS cv, CASE WHEN avg(value) = 0 THEN false ELSE stddev_pop(value) / avg(value) > 0.5 END AS varies FROM events GROUP BY 1")
def fn_f41(spark, d):
    g = table(spark, d, "events").groupBy("user_id").agg(F.avg("value").alias("m"), F.stddev_pop("value").alias("s"))
    cv = F.when(F.col("m") == 0, F.lit(0.0)).otherwise(F.col("s") / F.col("m"))
    return g.select("user_id", F.round(cv, 6).alias("cv"), (cv > 0.5).alias("varies"))


@query("fn_f42_expression_units", "WITH c AS (SELECT l_suppkey AS sample, l_partkey AS gene, sum(l_quantity) AS n FROM lineitem GROUP BY 1, 2), x AS (SELECT c.*, p.p_size * 100.0 AS len, sum(n) OVER (PARTITION BY sample) AS total FROM c JOIN part p ON p.p_partkey = c.gene), f AS (SELECT *, n * 1e9 / (len * total) AS fpkm FROM x), s AS (SELECT *, sum(fpkm) OVER (PARTITION BY sample) AS sf FROM f) SELECT sample, gene, round(n * 1e6 / total, 4) AS cpm, round(fpkm, 4) AS rpkm, round(exp(ln(fpkm) - ln(sf) + ln(1e6)), 4) AS tpm FROM s WHERE fpkm > 0")
def fn_f42(spark, d):
    """CPM, RPKM and TPM per sample and gene; totals by sample are joined."""
    c = table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("sample"), F.col("l_partkey").alias("gene")).agg(F.sum("l_quantity").alias("n"))
    p = table(spark, d, "part").select(F.col("p_partkey").alias("gene"), (F.col("p_size") * 100.0).alias("len"))
    x = c.join(p, "gene").withColumn("total", F.sum("n").over(W.partitionBy("sample")))
    f = x.withColumn("fpkm", F.col("n") * 1e9 / (F.col("len") * F.col("total"))).withColumn("sf", F.sum("fpkm").over(W.partitionBy("sample"))).filter("fpkm > 0")
    return f.select("sample", "gene", F.round(F.col("n") * 1e6 / F.col("total"), 4).alias("cpm"), F.round("fpkm", 4).alias("rpkm"), F.round(F.exp(F.log("fpkm") - F.log("sf") + F.log(F.lit(1e6))), 4).alias("tpm"))


# ---- predicates

def _filter(name: str, t: str, cond: str, cols: str, spark_cond: str | None = None):
    @query(name, f"SELECT {cols} FROM {t} WHERE {cond}")
    def run(spark: SparkSession, d: str) -> DataFrame:
        return table(spark, d, t).filter(spark_cond or cond).select(*[c.strip() for c in cols.split(",")])

    return run


_filter("flt_p1_min_length", "te_copies", "te_end - te_start >= 80", "copy_id, te_name")
_filter("flt_p2_type_gate", "te_copies", "te_class IN ('LTR', 'LINE', 'SINE')", "copy_id, te_class")
_filter("flt_p3_category", "rm_out", "contains(ele || '#' || ele_class, 'LTR/Gypsy')", "ann_id, ele", "contains(concat(ele, '#', ele_class), 'LTR/Gypsy')")
_filter("flt_p5_not_tg_ca", "ltr_intact", "NOT (starts_with(replace(motif, 'motif:', ''), 'TG') AND ends_with(motif, 'CA'))", "ltr_id, motif", "not (startswith(replace(motif, 'motif:', ''), 'TG') and endswith(motif, 'CA'))")
_filter("flt_p11_class_blacklist", "te_copies", "NOT regexp_matches(te_fam, 'Low_complexity|Simple_repeat|rRNA|scRNA|snRNA|srpRNA|tRNA')", "copy_id, te_fam", "not (te_fam rlike 'Low_complexity|Simple_repeat|rRNA|scRNA|snRNA|srpRNA|tRNA')")
_filter("flt_p12_divergence", "rm_out", "pct_div BETWEEN 0 AND 20", "ann_id, pct_div")
_filter("v7_length_window", "ltr_intact", "element_end - element_start + 1 BETWEEN 400 AND 22000", "ltr_id")
_filter("v28_tag_blacklist", "te_library", "te_class NOT IN ('Satellite', 'rRNA', 'Simple_repeat', 'Low_complexity') AND curated", "te_name")
_filter("v30_non_autonomous", "te_library", "regexp_matches(te_name, '_v[0-9]+$') AND te_class IN ('DNA/hAT', 'DNA/TcMar', 'DNA/Mutator', 'LTR/Copia', 'LTR/Gypsy')", "te_name, te_class", "te_name rlike '_v[0-9]+$' and te_class in ('DNA/hAT', 'DNA/TcMar', 'DNA/Mutator', 'LTR/Copia', 'LTR/Gypsy')")


for _name, _power in (("flt_p4_significance", 20), ("flt_p4_significance_weak", 3)):

    @query(_name, f"SELECT ann_id, CAST(sw_score // 50 AS INTEGER) AS power FROM rm_out WHERE sw_score // 50 >= {_power}")
    def flt_p4(spark, d, power=_power):
        """Hits of a BLAST table by E-value: at most 1e-20 (1e-3). The table is written with one power of ten per 50 points of score and read back."""
        t = table(spark, d, "rm_out").filter("sw_score is not null")
        p = F.floor(F.col("sw_score") / 50).cast("int").cast("string")
        cols = [F.col("ann_id").cast("string"), p, F.lit("95.0"), *[F.lit("1")] * 7, F.concat(F.lit("1e-"), p), F.lit("99")]
        got = ln.parse_table(ln.read_lines(spark, ln.write_lines(t.select(F.concat_ws("\t", *cols).alias("value")), ln.scratch(spark, "blast"))), ln.BLAST)
        return got.filter(F.col("evalue") <= float(f"1e-{power}")).select(F.col("query").cast("long").alias("ann_id"), F.col("subject").cast("int").alias("power"))


@query("flt_p6_copy_threshold", "WITH c AS (SELECT te_name, any_value(te_class) AS x, count(*) AS n FROM (SELECT trim(te_name) AS te_name, min(te_class) OVER (PARTITION BY trim(te_name)) AS te_class FROM te_copies) GROUP BY 1) SELECT te_name, n FROM c WHERE te_name <> '' AND n > CASE WHEN x = 'RC' THEN 2 ELSE 5 END")
def flt_p6(spark, d):
    """Families with more than five copies, of rolling-circle elements more than two."""
    t = table(spark, d, "te_copies").groupBy(F.trim("te_name").alias("te_name")).agg(F.count(F.lit(1)).alias("n"), F.min("te_class").alias("x"))
    return t.filter((F.col("te_name") != "") & (F.col("n") > F.when(F.col("x") == "RC", 2).otherwise(5))).select("te_name", "n")


@query("flt_p7_short_contigs", f"WITH {_S} SELECT seq_id, length(q) AS n FROM s WHERE length(q) < 1000")
def flt_p7(spark, d):
    return seqs(spark, d).filter(F.length("q") < 1000).select("seq_id", F.length("q").alias("n"))


@query("flt_p8_clean_up")
def flt_p8(spark, d):
    """Sequences of 80 letters or more, with under 20 % unknown ones and no more than half in tandem repeats (back-references: no SQL)."""
    n = F.length("q") - F.length(F.replace("q", F.lit("N"), F.lit("")))
    return seqs(spark, d).filter((F.length("q") >= 80) & (n < 0.2 * F.length("q"))).filter(sq.tandem_share("q") <= 0.5).select("seq_id")


@query("flt_p9_copy_split", "SELECT te_name, count(*) AS n, CASE WHEN count(*) >= 5 THEN 'high' ELSE 'low' END AS side FROM te_copies WHERE te_name IS NOT NULL GROUP BY 1")
def flt_p9(spark, d):
    g = table(spark, d, "te_copies").filter("te_name is not null").groupBy("te_name").agg(F.count(F.lit(1)).alias("n"))
    return g.withColumn("side", F.when(F.col("n") >= 5, "high").otherwise("low"))


@query("flt_p13_override", """WITH m AS (SELECT copy_id, min(CASE WHEN strand = '+' THEN 1 ELSE 0 END) AS model FROM te_copies WHERE strand IS NOT NULL GROUP BY 1), h AS (SELECT copy_id, min(CASE WHEN score % 3 = 0 THEN 0 ELSE 1 END) AS homology FROM te_copies WHERE score IS NOT NULL GROUP BY 1)
SELECT copy_id, CASE WHEN homology = 0 THEN 0 ELSE coalesce(model, homology) END AS verdict FROM m FULL JOIN h USING (copy_id)""")
def flt_p13(spark, d):
    """A model's verdict stands unless homology says 0; where one side has none, the other's counts."""
    t = table(spark, d, "te_copies")
    m = t.filter("strand is not null").groupBy("copy_id").agg(F.min(F.when(F.col("strand") == "+", 1).otherwise(0)).alias("model"))
    h = t.filter("score is not null").groupBy("copy_id").agg(F.min(F.when(F.col("score") % 3 == 0, 0).otherwise(1)).alias("homology"))
    return m.join(h, "copy_id", "full").select("copy_id", F.when(F.col("homology") == 0, 0).otherwise(F.coalesce("model", "homology")).alias("verdict"))


@query("flt_p14_rescue", """WITH c AS (SELECT trim(te_name) AS te_name, count(DISTINCT copy_id) AS n FROM te_copies WHERE trim(te_name) <> '' GROUP BY 1),
r AS (SELECT trim(ele) AS te_name, bool_or(starts_with(ele_class, 'LTR/')) AS own, bool_or(starts_with(ele_class, 'DNA/') OR starts_with(ele_class, 'LINE/')) AS other FROM rm_out WHERE trim(ele) <> '' GROUP BY 1),
s AS (SELECT ltr_id AS ordinal, bool_or(coalesce(tsd, 'TSD:NA') <> 'TSD:NA') AS site FROM ltr_intact GROUP BY 1),
x AS (SELECT l.te_name, coalesce(c.n, 0) AS n, coalesce(own, false) AS own, coalesce(other, false) AS other, coalesce(site, false) AS site FROM te_library l LEFT JOIN c USING (te_name) LEFT JOIN r USING (te_name) LEFT JOIN s ON s.ordinal = l.ordinal)
SELECT te_name, n, concat_ws('|', CASE WHEN n >= 2 THEN 'copies' END, CASE WHEN own THEN 'protein' END, CASE WHEN site THEN 'site' END, CASE WHEN NOT other THEN 'no other protein' END) AS reasons FROM x WHERE n >= 2 OR (own AND site AND NOT other)""")
def flt_p14(spark, d):
    """Families kept for two copies or more, else for a protein of their own, a duplicated site and no other protein; with all signs.

    Proteins are told by the classes of a family's hits; the site of library entry n is that of element n.
    """
    c = table(spark, d, "te_copies").filter("trim(te_name) <> ''").groupBy(F.trim("te_name").alias("te_name")).agg(F.count_distinct("copy_id").alias("n"))
    has = lambda *p: F.bool_or(F.coalesce(*[F.when(F.startswith("ele_class", F.lit(x)), True) for x in p], F.lit(False)))
    r = table(spark, d, "rm_out").filter("trim(ele) <> ''").groupBy(F.trim("ele").alias("te_name")).agg(has("LTR/").alias("own"), has("DNA/", "LINE/").alias("other"))
    s = table(spark, d, "ltr_intact").groupBy(F.col("ltr_id").alias("ordinal")).agg(F.bool_or(F.coalesce("tsd", F.lit("TSD:NA")) != "TSD:NA").alias("site"))
    t = table(spark, d, "te_library").select("te_name", "ordinal").join(c, "te_name", "left").join(r, "te_name", "left").join(s, "ordinal", "left").fillna(0, ["n"]).fillna(False, ["own", "other", "site"])
    signs = F.concat_ws("|", F.when(F.col("n") >= 2, "copies"), F.when(F.col("own"), "protein"), F.when(F.col("site"), "site"), F.when(~F.col("other"), "no other protein"))
    return t.filter((F.col("n") >= 2) | (F.col("own") & F.col("site") & ~F.col("other"))).select("te_name", "n", signs.alias("reasons"))
