"""Queries of this subpackage: `(spark, directory) -> DataFrame`, and SQL for those that SQL can state."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetweave.llm import consolidate, golden, linkage, packing, splitting, tokens
from fleetweave.sources.tables import table

TRUST = {"serial_number": "rank_serial_number", "os": "rank_os", "assigned_user": "rank_assigned_user"}


def unique_id():
    return F.concat_ws("::", "source", "source_id")


def p1_survivors(spark: SparkSession, d: str) -> DataFrame:
    """One surviving value each of the three fields, for every resolved cluster."""
    records = table(spark, d, "source_records").where(F.col("cluster_id").startswith("c-"))
    return golden.survivors(records, table(spark, d, "source_systems"), "cluster_id", "source", "fetched_at", TRUST)


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return golden.disagreements(table(spark, d, "devices"), p1_survivors(spark, d), "cluster_id", list(TRUST))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    records = table(spark, d, "source_records").where("cluster_id = ''").select(unique_id().alias("unique_id"))
    return consolidate.consolidate(records, table(spark, d, "match_pairs"), "unique_id", "unique_id_l", "unique_id_r", "match_weight", -5.0)


def _attributes(spark: SparkSession, d: str, kind: str) -> DataFrame:
    records = table(spark, d, "source_records").where(F.col("cluster_id").startswith(kind))
    return linkage.attributes(records, unique_id(), "source", "serial_number", "mac_clean", "name_clean", "ip_address", "fetched_at")


def _curve(spark: SparkSession, d: str, clusters: int = 2000) -> tuple[float, ...]:
    """Fitted on a sample of some `clusters` resolved clusters, whole groups of them with like names, so that look-alikes are in it."""
    resolved = table(spark, d, "source_records").where(F.col("cluster_id").startswith("c-"))
    number = resolved.agg(F.approx_count_distinct("cluster_id")).first()[0]
    group = F.pmod(F.xxhash64(F.substring(F.min("name_clean"), 1, 5)), F.lit(max(1, number // clusters)))
    chosen = resolved.groupBy("cluster_id").agg(group.alias("group")).where("group = 0").select("cluster_id")
    sample = resolved.join(chosen, "cluster_id", "left_semi")
    truth = sample.groupBy(unique_id().alias("u")).agg(F.min("cluster_id").alias("cluster"))
    known = linkage.attributes(sample, unique_id(), "source", "serial_number", "mac_clean", "name_clean", "ip_address", "fetched_at")
    return linkage.fit(known, truth)


def p4_matches(spark: SparkSession, d: str) -> DataFrame:
    """Matches with their confidence."""
    return linkage.matches(_attributes(spark, d, "new-"), _curve(spark, d))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return p4_matches(spark, d).select("unique_id_l", "unique_id_r")


def p4_members(spark: SparkSession, d: str) -> DataFrame:
    """The record that stands for each record in `p4_matches`."""
    return linkage.members(_attributes(spark, d, "new-"))


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    return tokens.encode_column(table(spark, d, "documents"), "doc_id")


def p8_decoded(spark: SparkSession, d: str) -> DataFrame:
    """Round trip: the texts of the ids, and whether they are the texts that went in."""
    docs = table(spark, d, "documents").select("doc_id", "text")
    back = tokens.decode_column(tokens.encode_column(docs, "doc_id"), "doc_id").withColumnRenamed("text", "decoded")
    return docs.join(back, "doc_id").select("doc_id", (F.coalesce("text", F.lit("")) == F.col("decoded")).alias("same"))


def p9_containers(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack_texts(table(spark, d, "documents"), "doc_id", capacity=2048)


def p10_pieces(spark: SparkSession, d: str) -> DataFrame:
    return splitting.split_texts(table(spark, d, "documents"), "doc_id", limit=512, overlap=32)


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    pieces = splitting.split_texts(table(spark, d, "documents"), "doc_id", limit=512, overlap=32, with_text=False)
    return pieces.where("piece_no = 0").select("doc_id")


def queries() -> dict:
    return {f.__name__: f for f in (p1_found, p1_survivors, p2_found, p4_found, p4_matches, p4_members, p8_ids, p8_decoded, p9_containers, p10_found, p10_pieces)}
