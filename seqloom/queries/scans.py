"""Queries of sources and sinks: tables are written in a record format and read back."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from seqloom.queries.registry import registry
from seqloom.session import table
from seqloom.sources import lines as ln
from seqloom.streaming import chunks

QUERIES, SQL, query = registry()

_SEQ = "x AS (SELECT seq_id, 's' || seq_id || CASE WHEN seq_id % 3 = 0 THEN ' note=1' ELSE '' END AS header, upper(regexp_replace(chrseq, '\\s', '', 'g')) AS seq FROM sequences WHERE regexp_replace(coalesce(chrseq, ''), '\\s', '', 'g') <> '')"


def _records(spark, d):
    t = table(spark, d, "sequences").filter("chrseq is not null")
    return t.select("seq_id", F.concat(F.lit("s"), F.col("seq_id").cast("string"), F.when(F.col("seq_id") % 3 == 0, " note=1").otherwise("")).alias("header"), "chrseq")


def _written(lines_df, name: str):
    spark = lines_df.sparkSession
    return ln.write_lines(lines_df, ln.scratch(spark, name))


@query("scan_s1_fasta", f"WITH {_SEQ} SELECT 's' || seq_id AS name, seq FROM x")
def s1(spark, d):
    """FASTA with line breaks inside, as the sequences are, read back."""
    p = _written(ln.fasta_lines(_records(spark, d), "header", "chrseq"), "fasta")
    return ln.read_fasta(spark, p).select("name", "seq")


@query("scan_s2_fasta_headers", f"WITH {_SEQ} SELECT header AS name, seq FROM x")
def s2(spark, d):
    p = _written(ln.fasta_lines(_records(spark, d), "header", "chrseq"), "fasta")
    return ln.read_fasta(spark, p, full_header=True).select("name", "seq")


@query("sink_s3_fasta", f"WITH {_SEQ} SELECT '>' || header || chr(10) || seq AS value FROM x")
def s3(spark, d):
    t = _records(spark, d).withColumn("seq", F.upper(F.regexp_replace("chrseq", r"\s+", "")))
    return ln.fasta_lines(t, "header", "seq")


@query("sink_s4_wrapped_fasta", f"WITH {_SEQ} SELECT '>' || header || chr(10) || regexp_replace(regexp_replace(seq, '(.{{70}})', '\\1' || chr(10), 'g'), chr(10) || '$', '') AS value FROM x")
def s4(spark, d):
    t = _records(spark, d).withColumn("seq", F.upper(F.regexp_replace("chrseq", r"\s+", "")))
    return ln.fasta_lines(t, "header", "seq", 70)


@query("scan_s5_upper_case", "SELECT seq_id, upper(chrseq) AS seq FROM sequences")
def s5(spark, d):
    return table(spark, d, "sequences").select("seq_id", F.upper("chrseq").alias("seq"))


_SCN = "c AS (SELECT ordinal, element_start AS ltr_start, element_end AS ltr_end, ltr_identity AS identity, ltr_id::VARCHAR AS seq_id, trim(chr) AS chrom FROM ltr_intact WHERE trim(chr) <> '' AND element_start IS NOT NULL AND element_end IS NOT NULL)"


def _candidates(spark, d):
    t = table(spark, d, "ltr_intact").filter("trim(chr) <> '' and element_start is not null and element_end is not null")
    return t.select("ordinal", F.col("element_start").alias("ltr_start"), F.col("element_end").alias("ltr_end"), F.col("element_start").alias("l_start"), (F.col("element_start") + 99).alias("l_end"), (F.col("element_end") - 99).alias("r_start"), F.col("element_end").alias("r_end"), F.col("ltr_identity").alias("identity"), F.col("ltr_id").cast("string").alias("seq_id"), F.trim("chr").alias("chrom"))


@query("scan_s6_scn", f"WITH {_SCN} SELECT ltr_start, ltr_end, ltr_start + 99 AS l_end, ltr_end - 99 AS r_start, identity, seq_id, chrom FROM c")
def s6(spark, d):
    p = _written(ln.scn_lines(_candidates(spark, d)), "scn")
    return ln.parse_scn(ln.read_lines(spark, p)).select("ltr_start", "ltr_end", "l_end", "r_start", "identity", "seq_id", "chrom")


@query("scan_s6_scn_unique", f"WITH {_SCN} SELECT DISTINCT chrom, ltr_start, ltr_end FROM c")
def s6u(spark, d):
    p = _written(ln.scn_lines(_candidates(spark, d)), "scn")
    return ln.parse_scn(ln.read_lines(spark, p), unique=True).select("chrom", "ltr_start", "ltr_end")


@query("sink_s7_scn", f"WITH {_SCN} SELECT concat_ws(' ', ltr_start, ltr_end, ltr_end - ltr_start + 1, ltr_start, ltr_start + 99, 100, ltr_end - 99, ltr_end, 100, coalesce(identity::VARCHAR, 'NA'), seq_id, chrom) AS value FROM c")
def s7(spark, d):
    return ln.scn_lines(_candidates(spark, d))


@query("scan_s8_detector_table", f"WITH {_SCN} SELECT chrom, ltr_start + 1 AS s, ltr_end AS e, round(identity / 100, 6) AS identity FROM c")
def s8(spark, d):
    return _candidates(spark, d).select("chrom", (F.col("ltr_start") + 1).alias("s"), F.col("ltr_end").alias("e"), F.round(F.col("identity") / 100, 6).alias("identity"))


@query("scan_s9_blast", "SELECT te_name AS query, chrom AS subject, te_start + 1 AS s_start, te_end AS s_end, te_end - te_start AS aln_len FROM te_copies WHERE te_name IS NOT NULL AND chrom IS NOT NULL AND trim(te_name) = te_name AND te_name <> ''")
def s9(spark, d):
    t = table(spark, d, "te_copies").filter("te_name is not null and chrom is not null and trim(te_name) = te_name and te_name <> ''")
    n = F.col("te_end") - F.col("te_start")
    vals = ["te_name", "chrom", F.lit("95.5"), n, F.lit("1"), F.lit("0"), F.lit("1"), n, F.col("te_start") + 1, "te_end", F.lit("1e-30"), F.lit("200")]
    p = _written(t.select(F.concat_ws("\t", *[(F.col(c) if isinstance(c, str) else c).cast("string") for c in vals]).alias("value")), "blast")
    return ln.parse_table(ln.read_lines(spark, p), ln.BLAST).select("query", "subject", "s_start", "s_end", "aln_len")


_RMX = """r AS (SELECT coalesce(sw_score, NULL) AS sw_score, seq_name, seq_begin, seq_end, CASE WHEN strand = 'C' THEN '-' ELSE strand END AS strand, replace(trim(ele), ' ', '_') AS ele, replace(trim(ele_class), ' ', '_') AS ele_class,
 try_cast(regexp_replace(CASE WHEN strand = '+' THEN c1 ELSE c3 END, '[()]', '', 'g') AS BIGINT) AS rep_begin, try_cast(c2 AS BIGINT) AS rep_end, try_cast(regexp_replace(CASE WHEN strand = '+' THEN c3 ELSE c1 END, '[()]', '', 'g') AS BIGINT) AS rep_left FROM rm_out WHERE trim(ele) <> '' AND ele_class IS NOT NULL AND strand IS NOT NULL AND sw_score IS NOT NULL)"""


def _rm(spark, d):
    return table(spark, d, "rm_out").filter("trim(ele) <> '' and ele_class is not null and strand is not null and sw_score is not null")


@query("scan_s10_rm_out", f"WITH {_RMX} SELECT sw_score::BIGINT AS sw_score, seq_name, seq_begin, seq_end, strand, ele, ele_class, rep_begin, rep_end, rep_left FROM r WHERE ele_class NOT IN ('Low_complexity', 'Simple_repeat')")
def s10(spark, d):
    p = _written(ln.rm_out_lines(_rm(spark, d)), "out")
    t = ln.parse_rm_out(ln.read_lines(spark, p), ("Low_complexity", "Simple_repeat"))
    return t.select("sw_score", "seq_name", "seq_begin", "seq_end", "strand", "ele", "ele_class", "rep_begin", "rep_end", "rep_left")


@query("sink_s11_bed", f"WITH {_RMX} SELECT seq_name AS chrom, seq_begin - 1 AS \"start\", seq_end AS \"end\", strand, ele FROM r")
def s11(spark, d):
    p = _written(ln.rm_out_lines(_rm(spark, d)), "out")
    b = ln.rm_out_to_bed(ln.parse_rm_out(ln.read_lines(spark, p)))
    return b.select("chrom", "start", "end", "strand", F.split("payload", ";")[6].alias("ele"))


@query("scan_s12_bed_payload", f"WITH {_RMX} SELECT seq_name AS chrom, seq_begin - 1 AS \"start\", ele AS te_name, round((rep_end - rep_begin)::DOUBLE / nullif(rep_end + rep_left, 0), 6) AS completeness FROM r")
def s12(spark, d):
    p = _written(ln.rm_out_lines(_rm(spark, d)), "out")
    return ln.parse_bed_payload(ln.rm_out_to_bed(ln.parse_rm_out(ln.read_lines(spark, p)))).select("chrom", "start", "te_name", "completeness")


@query("scan_s13_rm_gff", f"WITH {_RMX} SELECT seq_name AS chrom, seq_begin AS \"start\", seq_end AS \"end\", strand, ele AS motif, rep_begin AS q_start, rep_end AS q_end FROM r")
def s13(spark, d):
    p = _written(ln.rm_out_lines(_rm(spark, d)), "out")
    t = ln.parse_rm_out(ln.read_lines(spark, p))
    a = F.concat(F.lit('Target "Motif:'), "ele", F.lit('" '), F.col("rep_begin").cast("string"), F.lit(" "), F.col("rep_end").cast("string"))
    g = t.select(F.col("seq_name").alias("chrom"), F.lit("similarity").alias("type"), F.col("seq_begin").alias("start"), F.col("seq_end").alias("end"), F.col("pct_div").alias("score"), "strand", a.alias("attrs"))
    return ln.parse_rm_gff(ln.read_lines(spark, _written(ln.gff_lines(g), "gff"))).drop("ordinal")


_GFF = "g AS (SELECT c.ordinal, coalesce(c.chrom, '.') AS chrom, c.te_start + 1 AS s, c.te_end AS e, CASE WHEN c.strand = 'C' THEN '-' ELSE coalesce(c.strand, '.') END AS strand, trim(c.te_name) AS name, coalesce(l.te_class, 'SSR/low_complexity') AS class FROM te_copies c LEFT JOIN te_library l ON l.te_name = trim(c.te_name) WHERE trim(c.te_name) <> '')"


def _gff(spark, d):
    lib = table(spark, d, "te_library").select(F.col("te_name").alias("name"), F.col("te_class").alias("lc"))
    t = table(spark, d, "te_copies").filter("trim(te_name) <> ''").withColumn("name", F.trim("te_name")).join(lib, "name", "left")
    cls = F.coalesce("lc", F.lit("SSR/low_complexity"))
    attrs = F.concat(F.lit("name="), "name", F.lit(";classification="), cls)
    return t.select("ordinal", F.coalesce("chrom", F.lit(".")).alias("chrom"), cls.alias("type"), (F.col("te_start") + 1).alias("start"), F.col("te_end").alias("end"), F.col("score"), F.when(F.col("strand") == "C", "-").otherwise(F.col("strand")).alias("strand"), attrs.alias("attrs"))


@query("sink_s14_gff3", f"WITH {_GFF} SELECT ordinal, chrom, s AS \"start\", e AS \"end\", 'name=' || name || ';classification=' || class AS attrs FROM g")
def s14(spark, d):
    """Copies with the class of the library, or the default class."""
    return _gff(spark, d).select("ordinal", "chrom", "start", "end", "attrs")


@query("scan_s15_gff_to_out", f"WITH {_GFF} SELECT chrom, s AS \"start\", e AS \"end\", CASE WHEN strand = '-' THEN 'C' ELSE strand END AS strand, name AS ele, class AS ele_class FROM g")
def s15(spark, d):
    p = _written(ln.gff_lines(_gff(spark, d)), "gff")
    return ln.gff_to_rm_out(ln.parse_gff(ln.read_lines(spark, p))).select("chrom", "start", "end", "strand", "ele", "ele_class")


@query("sink_s16_gtf", f"WITH {_GFF} SELECT concat_ws(chr(9), chrom, 'seqloom', 'exon', s, e, '.', strand, '.', 'gene_id \"' || name || '\";') AS value FROM g")
def s16(spark, d):
    p = _written(ln.gff_lines(_gff(spark, d)), "gff")
    return ln.gff_to_gtf(ln.parse_gff(ln.read_lines(spark, p)))


@query("sink_s17_te_gtf", """WITH x AS (SELECT *, CASE WHEN strand = 'C' THEN '-' ELSE strand END AS st FROM te_copies WHERE NOT coalesce(regexp_matches(te_fam, 'Low_complexity|Simple_repeat|rRNA|scRNA|snRNA|srpRNA|tRNA'), false) AND strand IN ('+', '-', 'C') AND te_name IS NOT NULL),
y AS (SELECT *, row_number() OVER (PARTITION BY te_name ORDER BY ordinal) - 1 AS r, replace(te_fam, '?', '') AS fam FROM x)
SELECT ordinal, coalesce(chrom, '.') AS chrom, te_start + 1 AS "start", te_end AS "end", CASE WHEN score IS NULL OR score < 0 THEN '.' ELSE score::VARCHAR END AS score, st AS strand,
 'gene_id "' || te_name || '"; transcript_id "' || te_name || CASE WHEN r = 0 THEN '' ELSE '_dup' || r END || '"; family_id "' || CASE WHEN regexp_matches(fam, 'Other|Unknown') THEN te_name ELSE coalesce(fam, '.') END || '"; class_id "' || coalesce(te_class, '.') || '";' AS attrs FROM y""")
def s17(spark, d):
    return ln.te_gtf(table(spark, d, "te_copies")).drop("source")


@query("sink_s18_ltr_gff3", """WITH x AS (SELECT ordinal, regexp_extract(loc, '^(.*):([0-9]+)\\.\\.([0-9]+)$', 1) AS chrom, try_cast(regexp_extract(loc, '^(.*):([0-9]+)\\.\\.([0-9]+)$', 2) AS BIGINT) AS a, try_cast(regexp_extract(loc, '^(.*):([0-9]+)\\.\\.([0-9]+)$', 3) AS BIGINT) AS b,
 try_cast(regexp_extract(in_range, '^IN:([0-9]+)\\.\\.([0-9]+)$', 1) AS BIGINT) - 1 AS le, try_cast(regexp_extract(in_range, '^IN:([0-9]+)\\.\\.([0-9]+)$', 2) AS BIGINT) + 1 AS rs, coalesce(strand, '?') AS strand FROM ltr_intact WHERE regexp_matches(loc, '^(.*):([0-9]+)\\.\\.([0-9]+)$') AND regexp_matches(in_range, '^IN:([0-9]+)\\.\\.([0-9]+)$')),
y AS (SELECT ordinal, chrom, least(a, b) AS s, greatest(a, b) AS e, le, rs, strand FROM x)
SELECT ordinal, chrom, 'long_terminal_repeat' AS type, s AS "start", le AS "end", strand FROM y UNION ALL SELECT ordinal, chrom, 'LTR', s, e, strand FROM y UNION ALL SELECT ordinal, chrom, 'long_terminal_repeat', rs, e, strand FROM y""")
def s18(spark, d):
    return ln.ltr_gff(table(spark, d, "ltr_intact")).drop("attrs")


@query("sink_s19_full_length_gff3", "SELECT 'te_intact_' || (row_number() OVER (PARTITION BY chrom ORDER BY te_start, ordinal) - 1) AS id, chrom, te_start + 1 AS \"start\", te_end AS \"end\" FROM te_copies WHERE chrom IS NOT NULL AND te_end - te_start >= 500")
def s19(spark, d):
    """Long copies with a running id per sequence in order of position."""
    w = W.partitionBy("chrom").orderBy("te_start", "ordinal")
    t = table(spark, d, "te_copies").filter("chrom is not null and te_end - te_start >= 500")
    return t.select(F.concat(F.lit("te_intact_"), (F.row_number().over(w) - 1).cast("string")).alias("id"), "chrom", (F.col("te_start") + 1).alias("start"), F.col("te_end").alias("end"))


@query("sink_s20_merged_gff3", "SELECT trim(chr) AS chrom, element_start AS \"start\", element_end AS \"end\", 'LTR/' || coalesce(superfamily, 'Unknown') AS type FROM ltr_intact WHERE trim(chr) <> '' UNION ALL SELECT chrom, te_start + 1, te_end, CASE WHEN contains(te_name, 'LTR') THEN 'long_terminal_repeat' WHEN contains(te_name, 'te.') THEN 'repeat_region' ELSE 'element' END FROM te_copies WHERE chrom IS NOT NULL AND te_name IS NOT NULL")
def s20(spark, d):
    a = table(spark, d, "ltr_intact").filter("trim(chr) <> ''").select(F.trim("chr").alias("chrom"), F.col("element_start").alias("start"), F.col("element_end").alias("end"), F.concat(F.lit("LTR/"), F.coalesce("superfamily", F.lit("Unknown"))).alias("type"))
    kind = F.when(F.contains("te_name", F.lit("LTR")), "long_terminal_repeat").when(F.contains("te_name", F.lit("te.")), "repeat_region").otherwise("element")
    b = table(spark, d, "te_copies").filter("chrom is not null and te_name is not null").select("chrom", (F.col("te_start") + 1).alias("start"), F.col("te_end").alias("end"), kind.alias("type"))
    return a.unionByName(b)


@query("scan_s21_sam", "SELECT copy_id::VARCHAR || '_' || ordinal AS query, te_start AS pos, te_end - te_start + 5 AS q_aligned, te_end - te_start + 5 + 15 AS q_len, te_end - te_start + 5 + 3 AS t_len FROM te_copies WHERE te_end > te_start")
def s21(spark, d):
    t = table(spark, d, "te_copies").filter("te_end > te_start")
    n = (F.col("te_end") - F.col("te_start")).cast("string")
    cigar = F.concat(F.lit("10S"), n, F.lit("M3D5I5M"))
    vals = [F.concat(F.col("copy_id").cast("string"), F.lit("_"), F.col("ordinal").cast("string")), F.lit("0"), F.coalesce("chrom", F.lit("*")), F.col("te_start").cast("string"), F.lit("60"), cigar, F.lit("*")]
    p = _written(t.select(F.concat_ws("\t", *vals).alias("value")), "sam")
    return ln.parse_sam(ln.read_lines(spark, p)).select("query", "pos", "q_aligned", "q_len", "t_len")


@query("scan_s22_paf", "SELECT DISTINCT te_name AS query FROM te_copies WHERE te_name IS NOT NULL AND te_name = trim(te_name) AND te_name <> '' AND te_end - te_start > 0.95 * 500")
def s22(spark, d):
    """Queries that another sequence holds to over 95 %, from a PAF table."""
    t = table(spark, d, "te_copies").filter("te_name = trim(te_name) and te_name <> ''")
    vals = ["te_name", F.lit("500"), F.lit("0"), F.lit("500"), F.lit("+"), F.coalesce("chrom", F.lit("x")), F.lit("1"), F.lit("0"), F.lit("1"), (F.col("te_end") - F.col("te_start")).cast("string")]
    p = _written(t.select(F.concat_ws("\t", *vals).alias("value")), "paf")
    x = ln.parse_table(ln.read_lines(spark, p), ln.PAF)
    return x.filter("query <> target and matches / q_len > 0.95").select("query").distinct()


@query("scan_s23_clusters", "SELECT CAST(dense_rank() OVER (ORDER BY te_class) AS INTEGER) AS cluster, te_name AS member, row_number() OVER (PARTITION BY te_class ORDER BY te_name) = 1 AS is_rep FROM te_library WHERE te_class IS NOT NULL")
def s23(spark, d):
    t = table(spark, d, "te_library").filter("te_class is not null")
    g = t.groupBy("te_class").agg(F.array_sort(F.collect_list("te_name")).alias("m"))
    g = g.withColumn("c", F.row_number().over(W.orderBy("te_class")))  # one row per class
    rows = F.transform("m", lambda x, i: F.concat(i.cast("string"), F.lit("\t100nt, >"), x, F.when(i == 0, F.lit("... *")).otherwise(F.lit("... at 97%"))))
    p = _written(g.select(F.concat(F.lit(">Cluster "), F.col("c").cast("string"), F.lit("\n"), F.array_join(rows, "\n")).alias("value")), "clusters")
    return ln.read_clusters(spark, p)


@query("scan_s24_cluster_csv", "SELECT ordinal % 10 AS cluster, te_name AS member FROM te_library")
def s24(spark, d):
    p = ln.scratch(spark, "csv")
    table(spark, d, "te_library").select((F.col("ordinal") % 10).alias("cluster"), "te_name").write.csv(p)
    return spark.read.schema("cluster long, member string").csv(p)


@query("scan_s25_carried_header", "SELECT te_class AS head, te_name AS value FROM te_library WHERE te_class IS NOT NULL")
def s25(spark, d):
    """Log of headers and rows: each row with the header above it."""
    g = table(spark, d, "te_library").filter("te_class is not null").groupBy("te_class").agg(F.collect_list("te_name").alias("m"))
    p = _written(g.select(F.concat(F.lit("== "), "te_class", F.lit("\n"), F.array_join("m", "\n")).alias("value")), "log")
    return ln.carried(ln.read_lines(spark, p), r"^== (.*)$").filter("value not like '== %'").select("head", "value")


@query("scan_s26_embl", "SELECT 'E' || seq_id AS id, genome AS species, upper(regexp_replace(chrseq, '[\\s0-9]', '', 'g')) AS seq FROM sequences WHERE chrseq IS NOT NULL AND genome IS NOT NULL")
def s26(spark, d):
    t = table(spark, d, "sequences").filter("chrseq is not null and genome is not null")
    body = F.regexp_replace(F.regexp_replace("chrseq", r"\s+", ""), "(.{60})", "     $1 60\n")
    p = _written(t.select(F.concat(F.lit("ID   E"), F.col("seq_id").cast("string"), F.lit(";\nOS   "), "genome", F.lit("\nSQ   Sequence;\n"), body, F.lit("\n//")).alias("value")), "embl")
    return ln.read_embl(spark, p)


@query("scan_s27_matrix", "SELECT te_name AS left_part, coalesce(te_class, '') AS right_part FROM te_library")
def s27(spark, d):
    p = _written(table(spark, d, "te_library").select(F.concat_ws("\t", "te_name", F.coalesce("te_class", F.lit(""))).alias("value")), "matrix")
    return ln.read_lines(spark, p).withColumn("f", F.split("value", "\t", -1)).select(ln.at(0).alias("left_part"), ln.at(1).alias("right_part"))


@query("scan_s28_domains", "SELECT te_name, te_class AS domain_label, cons_len AS te_end FROM te_library WHERE te_class IS NOT NULL AND cons_len IS NOT NULL")
def s28(spark, d):
    """Domain table whose label stands after ``#``; two heading lines are skipped."""
    t = table(spark, d, "te_library").filter("te_class is not null and cons_len is not null")
    rows = t.select(F.concat_ws("\t", "te_name", F.concat(F.lit("dom#"), "te_class"), F.lit("1"), F.col("cons_len").cast("string"), F.lit("1"), F.lit("9")).alias("value"))
    head = spark.createDataFrame([("TE_name\tdomain_name\tTE_start",), ("----\t----",)], "value string")
    x = ln.parse_table(ln.read_lines(spark, _written(head.unionByName(rows), "domains")), ln.DOMAIN)
    return x.filter("te_start is not null").select("te_name", F.split("domain_name", "#")[1].alias("domain_label"), F.col("te_end").cast("int").alias("te_end"))


@query("scan_s29_genome_list", "SELECT genome, file_name AS gene_table, coalesce(is_plant, 0) AS is_paired, 2 AS n_reads FROM genomes")
def s29(spark, d):
    t = table(spark, d, "genomes").select(F.concat_ws("\t", "genome", F.coalesce("file_name", F.lit("")), F.coalesce("is_plant", F.lit(0)).cast("string"), F.lit("a.fq"), F.lit("b.fq")).alias("value"))
    x = ln.parse_genome_list(ln.read_lines(spark, _written(spark.createDataFrame([("# genomes",)], "value string").unionByName(t), "genomes")))
    return x.select("genome", "gene_table", "is_paired", F.size("reads").alias("n_reads"))


@query("scan_s30_metadata_json", "SELECT genome AS genome_name, species AS raw_name, size_mb FROM genomes")
def s30(spark, d):
    """Nested JSON written as one document per genome and read with a declared schema."""
    p = ln.scratch(spark, "json")
    t = table(spark, d, "genomes").select(F.struct(F.col("genome").alias("genome_name"), F.col("species").alias("raw_name"), F.struct("size_mb").alias("reference")).alias("genome_info"))
    t.write.json(p)
    x = spark.read.schema("genome_info struct<genome_name: string, raw_name: string, reference: struct<size_mb: double>>").json(p)
    return x.select("genome_info.genome_name", "genome_info.raw_name", "genome_info.reference.size_mb")


@query("scan_s31_json_column", "SELECT ordinal, te_start, te_end FROM te_copies")
def s31(spark, d):
    t = table(spark, d, "te_copies").select("ordinal", F.to_json(F.struct("te_start", "te_end")).alias("j"))
    return t.select("ordinal", F.from_json("j", "te_start long, te_end long").alias("x")).select("ordinal", "x.*")


@query("scan_s32_tsv", "SELECT te_name, te_class, cons_len FROM te_library")
def s32(spark, d):
    p = ln.scratch(spark, "tsv")
    table(spark, d, "te_library").select("te_name", "te_class", "cons_len").write.option("header", True).csv(p, sep="\t")
    return spark.read.schema("te_name string, te_class string, cons_len int").option("header", True).csv(p, sep="\t")


@query("scan_s34_validity", "SELECT 'sequences' AS name, count(*) > 0 AS has_rows FROM sequences UNION ALL SELECT 'library', count(*) > 0 FROM te_library")
def s34(spark, d):
    z = lambda n, t: table(spark, d, t).limit(1).agg((F.count(F.lit(1)) > 0).alias("has_rows")).select(F.lit(n).alias("name"), "has_rows")
    return z("sequences", "sequences").unionByName(z("library", "te_library"))


# ---- streaming


@query("stream_chunk_ingest", "SELECT genome, count(DISTINCT copy_id) AS n FROM te_copies WHERE genome IS NOT NULL GROUP BY 1")
def stream_chunks(spark, d):
    """Copies that arrive as files, each id once, in a table written batch by batch."""
    got = chunks.ingest_once(table(spark, d, "te_copies").select("copy_id", "genome"), "copy_id")
    return got.filter("genome is not null").groupBy("genome").agg(F.count(F.lit(1)).alias("n"))


@query("stream_windowed_counts", "SELECT event_type, time_bucket(INTERVAL 1 DAY, ts) AS day, count(*) AS n FROM events GROUP BY 1, 2")
def stream_windows(spark, d):
    got = chunks.windowed_counts(table(spark, d, "events").select("ts", "event_type"), "ts", ["event_type"], "1 day")
    return got.select("event_type", F.col("day").cast("timestamp_ntz").alias("day"), "n")
