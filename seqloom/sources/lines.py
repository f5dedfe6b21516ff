"""Line-oriented record formats: readers and writers as plans over text files.

Readers take a path or a table of lines (``value, ordinal``), so that they also work on streams.
``ordinal`` follows the order of the file and is unique per read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from seqloom.operators.running import numbered
from seqloom.session import scratch  # noqa: F401


def read_lines(spark: SparkSession, path: str, separator: str | None = None) -> DataFrame:
    """Lines with their order: ``value, file, ordinal``. Large files are split between tasks.

    Ordinals ascend by file name, then by place in the file, and are unique over all files.
    """
    r = spark.read.option("lineSep", separator) if separator else spark.read
    raw = r.text(path)
    t = raw.select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("m"))
    # within a task ids ascend; blocks of one file ascend with their start
    if len(raw.inputFiles()) < 2:
        return t.select("value", "file", (F.col("block") * F.lit(1 << 20) + F.pmod(F.col("m"), F.lit(1 << 33))).alias("ordinal"))
    # one row per block: how many lines come before it, and the first id in it
    per = t.groupBy(F.col("file").alias("f"), F.col("block").alias("b")).agg(F.count(F.lit(1)).alias("n"), F.min("m").alias("first"))
    before = F.coalesce(F.sum("n").over(W.orderBy("f", "b").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    per = per.select("f", "b", (before - F.col("first")).alias("shift"))
    return t.join(per, (t["file"] == per["f"]) & (t["block"] == per["b"])).select("value", "file", (F.col("m") + F.col("shift")).alias("ordinal"))


def write_lines(lines: DataFrame, path: str, compression: str | None = None) -> str:
    """Write the column ``value`` of a table as text, one record per row."""
    w = lines.select("value").write.mode("overwrite")
    (w.option("compression", compression) if compression else w).text(path)
    return path


# ---- FASTA


def read_fasta(spark: SparkSession, path: str, full_header: bool = False) -> DataFrame:
    """``name, header, seq, ordinal``: in upper case, without white space; records without letters are dropped.

    Records are told apart by the line separator ``\\n>``, so that a file of any size is split between
    tasks. The name ends at the first space or tab (unless ``full_header``); of records of one name the
    last one counts.
    """
    t = read_lines(spark, path, "\n>")
    body = F.regexp_replace("value", r"\A>", "")
    head = F.regexp_replace(F.substring_index(body, "\n", 1), r"\r\z", "")
    seq = F.when(F.contains(body, F.lit("\n")), F.upper(F.regexp_replace(F.substring(body, F.locate("\n", body) + 1, F.length(body)), r"\s+", ""))).otherwise("")
    name = head if full_header else F.split(head, "[ \t]")[0]
    t = t.select(name.alias("name"), head.alias("header"), seq.alias("seq"), "ordinal").filter("seq <> ''")
    last = t.groupBy("name").agg(F.max_by(F.struct("header", "seq", "ordinal"), "ordinal").alias("x"))
    return last.select("name", "x.*")


def fasta_lines(t: DataFrame, header: str, seq: str, width: int | None = None) -> DataFrame:
    """Records as text, with lines of ``width`` letters if given. Rows without a sequence are left out."""
    s = F.col(seq) if width is None else F.regexp_replace(F.regexp_replace(F.col(seq), f"(.{{{width}}})", "$1\n"), r"\n\z", "")
    return t.filter(F.col(seq) != "").select(F.concat(F.lit(">"), F.col(header), F.lit("\n"), s).alias("value"))


# ---- tables of fields


def fields(lines: DataFrame, pattern: str, comment: str | None = "#") -> DataFrame:
    """Adds ``f``, the fields of each line that is neither blank nor a comment."""
    t = lines.filter(F.trim("value") != "")
    if comment:
        t = t.filter(~F.startswith(F.ltrim("value"), F.lit(comment)))
    return t.withColumn("f", F.split(F.trim("value"), pattern, -1))


def at(i: int, kind: str = "string") -> Column:
    """Field ``i`` (from 0), null if it is missing or of another type."""
    return F.get("f", F.lit(i)).try_cast(kind)


SCN = {"ltr_start": (0, "long"), "ltr_end": (1, "long"), "l_start": (3, "long"), "l_end": (4, "long"), "r_start": (6, "long"), "r_end": (7, "long"), "identity": (9, "double"), "seq_id": (10, "string"), "chrom": (11, "string")}
BLAST = {"query": (0, "string"), "subject": (1, "string"), "identity": (2, "double"), "aln_len": (3, "long"), "mismatch": (4, "long"), "gapopen": (5, "long"), "q_start": (6, "long"), "q_end": (7, "long"), "s_start": (8, "long"), "s_end": (9, "long"), "evalue": (10, "double"), "bitscore": (11, "double")}
PAF = {"query": (0, "string"), "q_len": (1, "long"), "target": (5, "string"), "matches": (9, "long")}
DOMAIN = {"te_name": (0, "string"), "domain_name": (1, "string"), "te_start": (2, "long"), "te_end": (3, "long"), "domain_start": (4, "long"), "domain_end": (5, "long")}


def parse_table(lines: DataFrame, layout: dict, pattern: str = "\t", comment: str | None = "#") -> DataFrame:
    return fields(lines, pattern, comment).select(*[at(i, k).alias(n) for n, (i, k) in layout.items()], "ordinal")


def parse_scn(lines: DataFrame, unique: bool = False) -> DataFrame:
    """LTR candidates; with ``unique`` the first of each place."""
    t = parse_table(lines, SCN, " +")
    if not unique:
        return t
    rest = [c for c in t.columns if c not in ("chrom", "ltr_start", "ltr_end")]
    g = t.groupBy("chrom", "ltr_start", "ltr_end").agg(F.min_by(F.struct(*rest), "ordinal").alias("x"))
    return g.select("chrom", "ltr_start", "ltr_end", "x.*")


def scn_lines(t: DataFrame) -> DataFrame:
    n = lambda a, b: F.col(b) - F.col(a) + 1
    cols = ["ltr_start", "ltr_end", n("ltr_start", "ltr_end"), "l_start", "l_end", n("l_start", "l_end"), "r_start", "r_end", n("r_start", "r_end"), "identity", "seq_id", "chrom"]
    return t.select(F.concat_ws(" ", *[F.coalesce((F.col(c) if isinstance(c, str) else c).cast("string"), F.lit("NA")) for c in cols]).alias("value"))


def parse_rm_out(lines: DataFrame, skip: tuple[str, ...] = (), category: str | None = None) -> DataFrame:
    """RepeatMasker-style rows with the repeat's positions by meaning; headers and classes in ``skip`` are left out."""
    t = fields(lines, " +", None).filter(~F.col("f")[0].isin("SW", "score"))
    bare = lambda i: F.regexp_replace(F.get("f", F.lit(i)), "[()]", "").try_cast("long")
    plus = at(8) == "+"
    t = t.select(
        at(0, "long").alias("sw_score"), at(1, "double").alias("pct_div"), at(4).alias("seq_name"), at(5, "long").alias("seq_begin"), at(6, "long").alias("seq_end"), bare(7).alias("left_bp"),
        F.when(at(8) == "C", "-").otherwise(at(8)).alias("strand"), at(9).alias("ele"), at(10).alias("ele_class"),
        F.when(plus, bare(11)).otherwise(bare(13)).alias("rep_begin"), bare(12).alias("rep_end"), F.when(plus, bare(13)).otherwise(bare(11)).alias("rep_left"), at(14, "long").alias("hit_id"), "ordinal",
    )
    if skip:
        t = t.filter(~F.coalesce(F.col("ele_class").isin(*skip), F.lit(False)))
    return t.filter(F.contains(F.concat_ws("#", "ele", "ele_class"), F.lit(category))) if category and category != "Total" else t


def rm_out_lines(t: DataFrame) -> DataFrame:
    """Rows of the table ``rm_out`` as text."""
    cols = ["sw_score", "pct_div", "pct_del", "pct_ins", "seq_name", "seq_begin", "seq_end", "left_bp", "strand", "ele", "ele_class", "c1", "c2", "c3", "hit_id"]
    return t.select(F.concat_ws(" ", *[F.coalesce(F.replace(F.trim(F.col(c).cast("string")), F.lit(" "), F.lit("_")), F.lit("NA")) for c in cols]).alias("value"))


def rm_out_to_bed(parsed: DataFrame, t: DataFrame | None = None) -> DataFrame:
    """BED rows whose payload holds the row's fields between semicolons."""
    payload = F.concat_ws(";", *[F.coalesce(F.col(c).cast("string"), F.lit("NA")) for c in ("sw_score", "pct_div", "seq_name", "seq_begin", "seq_end", "strand", "ele", "ele_class", "rep_begin", "rep_end", "rep_left")])
    return parsed.select(F.col("seq_name").alias("chrom"), (F.col("seq_begin") - 1).alias("start"), F.col("seq_end").alias("end"), payload.alias("payload"), F.lit(".").alias("score"), "strand", "ordinal")


def parse_bed_payload(bed: DataFrame, full: float = 0.95) -> DataFrame:
    """Completeness of each copy from its payload: covered part of the repeat over its length."""
    f = F.split("payload", ";")
    n = lambda i: F.get(f, F.lit(i)).try_cast("double")
    share = F.try_divide(n(9) - n(8), n(9) + n(10))
    return bed.select("chrom", "start", "end", F.get(f, F.lit(6)).alias("te_name"), F.round(share, 6).alias("completeness"), (F.coalesce(share, F.lit(0.0)) >= full).alias("full_length"), "ordinal")


def parse_rm_gff(lines: DataFrame) -> DataFrame:
    t = fields(lines, "\t").withColumn("a", at(8))
    z = lambda p, i: F.regexp_extract("a", p, i)
    p = r'Target "Motif:([^"]+)" (\d+) (\d+)'
    return t.select(at(0).alias("chrom"), at(3, "long").alias("start"), at(4, "long").alias("end"), at(6).alias("strand"), F.nullif(z(p, 1), F.lit("")).alias("motif"), z(p, 2).try_cast("long").alias("q_start"), z(p, 3).try_cast("long").alias("q_end"), "ordinal")


def gff_lines(t: DataFrame, source: str = "seqloom") -> DataFrame:
    """``chrom, type, start, end, score, strand, attrs`` as GFF rows."""
    z = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("."))
    return t.select(F.concat_ws("\t", z("chrom"), F.lit(source), z("type"), z("start"), z("end"), z("score"), z("strand"), F.lit("."), z("attrs")).alias("value"))


def parse_gff(lines: DataFrame) -> DataFrame:
    """GFF rows with their attributes as a map; both ``k=v;`` and ``k "v";`` are read."""
    t = fields(lines, "\t").withColumn("a", at(8))
    plain = F.regexp_replace(F.regexp_replace("a", r' "([^"]*)"', "=$1"), r";\s*", ";")
    m = F.map_from_entries(F.transform(F.filter(F.split(plain, ";"), lambda x: F.contains(x, F.lit("="))), lambda x: F.struct(F.trim(F.substring_index(x, "=", 1)), F.substring(x, F.locate("=", x) + 1, F.length(x)))))
    return t.select(at(0).alias("chrom"), at(1).alias("source"), at(2).alias("type"), at(3, "long").alias("start"), at(4, "long").alias("end"), at(5, "double").alias("score"), at(6).alias("strand"), m.alias("attrs"), "ordinal")


def gff_to_rm_out(gff: DataFrame, divergence: float | None = None) -> DataFrame:
    """Rows for the summary; without a divergence in the attributes it is null, not an invented constant."""
    d = F.coalesce(F.try_element_at("attrs", F.lit("div")).try_cast("double"), F.lit(divergence).cast("double"))
    return gff.select("chrom", "start", "end", F.when(F.col("strand") == "-", "C").otherwise(F.col("strand")).alias("strand"), F.try_element_at("attrs", F.lit("name")).alias("ele"), F.try_element_at("attrs", F.lit("classification")).alias("ele_class"), d.alias("pct_div"), "ordinal")


def gff_to_gtf(gff: DataFrame) -> DataFrame:
    """GTF rows; the gene's name is taken from gene_id, name, Name or id, whichever comes first."""
    a = lambda k: F.try_element_at("attrs", F.lit(k))
    g = F.coalesce(a("gene_id"), a("name"), a("Name"), a("id"), F.lit("unnamed"))
    z = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("."))
    return gff.select(F.concat_ws("\t", z("chrom"), z("source"), F.lit("exon"), z("start"), z("end"), F.lit("."), z("strand"), F.lit("."), F.concat(F.lit('gene_id "'), g, F.lit('";'))).alias("value"))


#: Annotations that are no elements of their own: fixed values.
NO_ELEMENT = "Low_complexity|Simple_repeat|rRNA|scRNA|snRNA|srpRNA|tRNA"


def te_gtf(t: DataFrame, name: str = "seqloom") -> DataFrame:
    """GTF attributes of copies ``ordinal, chrom, te_start (0-based), te_end, strand, te_name, te_fam, te_class, score``.

    Structural RNA and low complexity are left out, as are strands other than +, - and C; C becomes -.
    The n-th further copy of a name gets the suffix ``_dup<n>`` in file order. A family of Other or
    Unknown is named like the element; question marks go.
    """
    strand = F.when(F.col("strand") == "C", "-").otherwise(F.col("strand"))
    x = t.withColumn("strand", strand).filter(f"not coalesce(te_fam rlike '({NO_ELEMENT})', false)").filter("strand in ('+', '-') and te_name is not null")
    x = numbered(x, ["te_name"], "ordinal", "r")
    fam = F.regexp_replace("te_fam", r"\?", "")
    inst = F.when(F.col("r") == 0, F.col("te_name")).otherwise(F.concat("te_name", F.lit("_dup"), F.col("r").cast("string")))
    score = F.when(F.col("score").isNull() | (F.col("score") < 0), F.lit(".")).otherwise(F.col("score").cast("string"))
    attrs = F.concat(F.lit('gene_id "'), F.col("te_name"), F.lit('"; transcript_id "'), inst, F.lit('"; family_id "'), F.when(fam.rlike("Other|Unknown"), F.col("te_name")).otherwise(F.coalesce(fam, F.lit("."))), F.lit('"; class_id "'), F.coalesce("te_class", F.lit(".")), F.lit('";'))
    return x.select("ordinal", F.coalesce("chrom", F.lit(".")).alias("chrom"), F.lit(name).alias("source"), (F.col("te_start") + 1).alias("start"), F.col("te_end").alias("end"), score.alias("score"), "strand", attrs.alias("attrs"))


def ltr_gff(t: DataFrame) -> DataFrame:
    """Three rows per element of the table ``ltr_intact``: left repeat, element and right repeat."""
    p = r"^(.*):(\d+)\.\.(\d+)$"
    z = lambda i: F.regexp_extract("loc", p, i)
    a, b = z(2).try_cast("long"), z(3).try_cast("long")
    i = r"^IN:(\d+)\.\.(\d+)$"
    x = t.filter(F.col("loc").rlike(p) & F.col("in_range").rlike(i)).select("ordinal", z(1).alias("chrom"), F.least(a, b).alias("s"), F.greatest(a, b).alias("e"), (F.regexp_extract("in_range", i, 1).try_cast("long") - 1).alias("le"), (F.regexp_extract("in_range", i, 2).try_cast("long") + 1).alias("rs"), "strand", "superfamily")
    row = lambda k, s, e, pre: F.struct(F.lit(k).alias("type"), s.alias("start"), e.alias("end"), F.lit(pre).alias("pre"))
    c = F.col
    x = x.withColumn("r", F.explode(F.array(row("long_terminal_repeat", c("s"), c("le"), "lLTR"), row("LTR", c("s"), c("e"), "LTRRT"), row("long_terminal_repeat", c("rs"), c("e"), "rLTR"))))
    attrs = F.concat(F.lit("id="), c("r.pre"), F.lit("_"), c("ordinal").cast("string"), F.lit(";name="), "chrom", F.lit(":"), c("s").cast("string"), F.lit(".."), c("e").cast("string"), F.lit(";classification=LTR/"), F.coalesce("superfamily", F.lit("Unknown")))
    return x.select("ordinal", "chrom", c("r.type").alias("type"), c("r.start").alias("start"), c("r.end").alias("end"), F.coalesce("strand", F.lit("?")).alias("strand"), attrs.alias("attrs"))


def parse_sam(lines: DataFrame) -> DataFrame:
    """Aligned letters of query and target and the query's length, from the CIGAR."""
    t = fields(lines, "\t", "@").select(at(0).alias("query"), at(1, "int").alias("flag"), at(2).alias("ref"), at(3, "long").alias("pos"), at(5).alias("cigar"), "ordinal")
    total = lambda ops: F.aggregate(F.regexp_extract_all("cigar", F.lit(f"(\\d+)[{ops}]"), F.lit(1)), F.lit(0).cast("long"), lambda s, x: s + x.cast("long"))
    t = t.withColumns({"q_aligned": total("M=X"), "q_len": total("MIS=XH"), "t_len": total("MD=X")})
    return t.withColumns({"query_cov": F.round(F.try_divide("q_aligned", "q_len"), 6), "target_cov": F.round(F.try_divide("q_aligned", "t_len"), 6)})


def carried(lines: DataFrame, header: str, group: int = 1) -> DataFrame:
    """Adds ``head``: what the last header line (a pattern with a group) up to the row says."""
    h = F.when(F.col("value").rlike(header), F.regexp_extract("value", header, group))
    w = W.partitionBy("file").orderBy("ordinal").rowsBetween(W.unboundedPreceding, 0)
    return lines.withColumn("head", F.last(h, ignorenulls=True).over(w))


def read_clusters(spark: SparkSession, path: str) -> DataFrame:
    """Cluster lists: ``cluster, member, is_rep``. Records begin with ``>Cluster``, so each is read whole and no order is needed."""
    t = spark.read.option("lineSep", ">Cluster ").text(path).filter("value <> ''")
    rows = F.split("value", "\n")
    x = t.select(F.trim(rows[0]).try_cast("int").alias("cluster"), F.explode(F.slice(rows, 2, F.size(rows))).alias("m")).filter("m like '%>%...%'")
    return x.select("cluster", F.regexp_extract("m", r">(.+?)\.\.\.", 1).alias("member"), F.endswith(F.trim("m"), F.lit("*")).alias("is_rep"))


def read_embl(spark: SparkSession, path: str) -> DataFrame:
    """EMBL flat files: ``id, species, seq``; records end with ``//``."""
    t = spark.read.option("lineSep", "//\n").text(path).filter("trim(value) <> ''")
    line = lambda k: F.nullif(F.trim(F.regexp_extract("value", rf"(?m)^{k}   ([^;\n]*)", 1)), F.lit(""))
    body = F.regexp_extract("value", r"(?ms)^SQ[^\n]*\n(.*)\z", 1)
    return t.select(line("ID").alias("id"), line("OS").alias("species"), F.upper(F.regexp_replace(body, r"[\s\d]", "")).alias("seq"))


def parse_genome_list(lines: DataFrame) -> DataFrame:
    """Ragged list: genome, gene table, paired flag, then any number of reads."""
    t = fields(lines, "\t")
    return t.select(at(0).alias("genome"), F.nullif(at(1), F.lit("")).alias("gene_table"), F.coalesce(at(2, "int"), F.lit(0)).alias("is_paired"), F.filter(F.slice("f", 4, F.greatest(F.lit(0), F.size("f") - 3)), lambda x: x != "").alias("reads"), "ordinal")
