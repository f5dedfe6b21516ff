"""Queries of the operators for training data, with their SQL in ``sql``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqloom.functions.sequence import cleaned
from seqloom.llm import mixing, neardup, pieces, stuffing, terms, tokens
from seqloom.llm.sql import SQL  # noqa: F401
from seqloom.queries.pipeline import class_name, element_name
from seqloom.session import materialize, table

QUERIES = {}

LIMIT, OVERLAP = 8000, 200


def query(f):
    QUERIES[f.__name__] = f
    return f


def _term_counts(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    rm = table(spark, d, "rm_out")
    freq = terms.term_frequencies(rm, {"ele": element_name("ele"), "ele_class": class_name("ele_class")}, "ann_id", "seq_name")
    return freq, rm.agg(F.count_distinct("seq_name").alias("n"))


@query
def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """Terms of rm_out too rare or too common to tell families apart."""
    freq, homes = _term_counts(spark, d)
    return terms.marked_terms(freq, homes).withColumnRenamed("field", "field_name")


@query
def p2_counts(spark: SparkSession, d: str) -> DataFrame:
    """Annotations and sequences of every distinct term."""
    return _term_counts(spark, d)[0].withColumnRenamed("field", "field_name")


def _sequences(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "sequences").select("seq_id", "chrname", cleaned("chrseq").alias("seq"))


@query
def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """Natural boundaries of the oversized sequences."""
    plan = pieces.split_plan(_sequences(spark, d), "seq", LIMIT, OVERLAP)
    return pieces.found_boundaries(plan, "seq_id").withColumnRenamed("id", "seq_id")


@query
def p3_pieces(spark: SparkSession, d: str) -> DataFrame:
    """Pieces of at most 8,000 bases, 200 of them shared with the piece before."""
    plan = pieces.split_plan(_sequences(spark, d), "seq", LIMIT, OVERLAP)
    return pieces.pieces(plan, "seq_id", "seq", OVERLAP, ("chrname",)).withColumnRenamed("id", "seq_id")


@query
def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of sequences of similarity 0.5 or more on words of 11 letters."""
    links, members = neardup.class_links(table(spark, d, "sequences"), "seq_id", "chrseq")
    return neardup.similar_pairs(links, members).select(F.col("id_a").alias("seq_id_a"), F.col("id_b").alias("seq_id_b"))


@query
def p5_groups(spark: SparkSession, d: str) -> DataFrame:
    """One row per sequence with words: its class, group and number of links."""
    links, members = neardup.class_links(table(spark, d, "sequences"), "seq_id", "chrseq")
    return neardup.groups(links, members).withColumnRenamed("id", "seq_id")


@query
def p7_ids(spark: SparkSession, d: str) -> DataFrame:
    """Token ids of each document."""
    return tokens.encode_corpus(table(spark, d, "documents"), "doc_id", "text").withColumnRenamed("id", "doc_id")


def _mix(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    docs = table(spark, d, "documents").filter("source is not null")
    key = F.struct(F.col("doc_id"), F.col("source"))
    sized = tokens.encode_corpus(docs.select(key.alias("k"), "text"), "k", "text", count_only=True)
    records = sized.select(F.col("id.doc_id").alias("id"), F.col("id.source").alias("source"), F.col("n_tokens").alias("size"))
    t = table(spark, d, "mix_targets")
    targets = t.select(F.col("mix_name").alias("mix"), F.col("source_name").alias("source"), F.col("target_share").alias("share"), F.col("max_repeats").alias("cap"))
    return mixing.mix(records, targets)


@query
def p8_mix(spark: SparkSession, d: str) -> DataFrame:
    """Documents of each mix and how often each is taken."""
    picked, _ = _mix(spark, d)
    return picked.select(F.col("mix").alias("mix_name"), F.col("source").alias("source_name"), F.col("id").alias("doc_id"), F.col("size").alias("n_tokens"), "copies")


@query
def p8_shares(spark: SparkSession, d: str) -> DataFrame:
    """Shares reached by each source of each mix."""
    _, rep = _mix(spark, d)
    return rep.select(
        F.col("mix").alias("mix_name"),
        F.col("source").alias("source_name"),
        F.col("share").alias("target_share"),
        F.col("reached").alias("reached_share"),
        F.col("picked_size").alias("n_tokens"),
        "n_records",
        "max_copies",
    )


@query
def p9_found(spark: SparkSession, d: str) -> DataFrame:
    """Documents of which more than half is repeated keywords, links or product tags."""
    got = stuffing.stuffing(table(spark, d, "documents"), "doc_id", "text", "lang")
    return got.filter("spam_share > 0.5").select(F.col("id").alias("doc_id"))


@query
def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    """What each document is made of."""
    return stuffing.stuffing(table(spark, d, "documents"), "doc_id", "text", "lang").withColumnRenamed("id", "doc_id")
