"""Exact deduplication by a tree merge of sorted digest runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written


def digest_runs(df: DataFrame, id_col: str, text_col: str, normalise=None) -> DataFrame:
    """One row a document: id, SHA-256, and what verifies a digest's equality (UTF-8 length, an unrelated 64-bit hash)."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    text = normalise(text) if normalise else text
    return df.select(
        F.col(id_col).alias("id"),
        F.unhex(F.sha2(text, 256)).alias("digest"),
        F.octet_length(text).alias("size"),
        F.xxhash64(text).alias("proof"),
    )


def tree_merge(runs: DataFrame, levels: int | None = None, fan_in_bits: int = 4, largest: bool = False) -> DataFrame:
    """Merge the partitions' runs into one row a distinct text: keep_id, group_size.

    Partition p holds a run. Round r exchanges among the 2^fan_in_bits runs whose
    numbers agree but for bits r * fan_in_bits and up, as in a binomial tree:
    p loses its last fan_in_bits bits. So P runs take log(P) / fan_in_bits rounds
    (``levels`` fixes their number), and the last merges the few that are left.

    A run is sorted by (digest, size, proof) before it is sent, with one entry a
    distinct text: its id so far, verified by size and proof, and its count. What
    meets is merged in that order by one sorted pass, which again keeps one entry.
    (An id held in a struct makes Spark aggregate by sorting on both sides of the
    exchange rather than by hashing.) Pieces of a run are dealt over all tasks by digest, so
    no task holds a whole run, and a text with any number of copies sends one
    entry a run and round.
    """
    if levels is None:
        highest = runs.select(F.spark_partition_id().alias("at")).agg(F.max("at")).first()[0] or 0
        levels = max(1, -(-highest.bit_length() // fan_in_bits))
    entry = F.when(F.col("id").isNotNull(), F.struct("id"))
    merged = runs.select("digest", "size", "proof", entry.alias("best"), F.lit(1).cast("long").alias("n"), F.spark_partition_id().alias("at"))
    for r in range(levels):
        run = [] if r == levels - 1 else ["at"]
        merged = (
            merged.withColumn("at", F.shiftright("at", fan_in_bits))
            .groupBy(*run, "digest", "size", "proof")
            .agg((F.max if largest else F.min)("best").alias("best"), F.sum("n").alias("n"))
        )
    return merged.select("digest", "size", "proof", F.col("best.id").alias("keep_id"), F.col("n").alias("group_size"))


def exact_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", largest: bool = False, normalise=None, levels: int | None = None) -> DataFrame:
    """Columns id_col, keep_id, group_size, kept, text_sha256: one row for every input row.

    Null texts count as empty. ``keep_id`` is the smallest (``largest``: largest)
    non-null id among equal texts; of rows that repeat both id and text all are
    listed, and all are ``kept`` where their id is keep_id. A group with null
    ids alone has a null keep_id and keeps its rows. Other columns are ignored.
    ``normalise`` maps a text column to the text that is compared.
    """
    runs = digest_runs(df, id_col, text_col, normalise)
    # As a table, the merged runs are dealt anew for the join, so Spark can split a digest that many rows share.
    merged = written(tree_merge(runs, levels=levels, largest=largest), "digests")
    joined = runs.join(merged, ["digest", "size", "proof"])
    kept: Column = F.col("id").eqNullSafe(F.col("keep_id"))
    return joined.select(
        F.col("id").alias(id_col), "keep_id", "group_size", kept.alias("kept"), F.lower(F.hex("digest")).alias("text_sha256")
    )


def drop_copies(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", largest: bool = False, levels: int | None = None) -> DataFrame:
    """The rows of ``df`` that stay, with all their columns.

    A row stays if its id is its text's keep_id; of rows that repeat both, one
    stays (only those rows' texts are shuffled for it). Rows of a text that only null ids have: one stays.
    """
    digest = F.unhex(F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256))
    kept = exact_dedup(df, id_col, text_col, largest, levels=levels).where("kept")
    verdict = kept.groupBy(F.col(id_col).alias("_qw_id"), F.unhex("text_sha256").alias("_qw_digest")).agg(F.count(F.lit(1)).alias("_qw_n"))
    verdict = written(verdict, "kept")
    rows = df.withColumn("_qw_digest", digest)

    def of(some: DataFrame) -> DataFrame:
        some = some.select("_qw_id", F.col("_qw_digest").alias("_qw_kept"))
        return rows.join(some, F.col(id_col).eqNullSafe(F.col("_qw_id")) & (F.col("_qw_digest") == F.col("_qw_kept")), "left_semi")

    once = of(verdict.where("_qw_n = 1"))
    if verdict.where("_qw_n > 1").limit(1).count():
        once = once.unionByName(of(verdict.where("_qw_n > 1")).dropDuplicates([id_col, "_qw_digest"]))
    return once.select(*df.columns)
