"""What several training-data operators share: the shared folder, sizes, ordered buckets, components."""

from __future__ import annotations

import ctypes
import tempfile
import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space that separates words, as a Java pattern.
WORD_BREAK = r"[\x20\x09-\x0D]+"
#: What a Python worker keeps from task to task, by its user; a task of another user drops it.
KEPT: dict[str, dict] = {}
#: Ordered buckets at most: their bounds are a literal in the plan. Beyond it buckets grow, and sort with spills.
MAX_BUCKETS = 1 << 16


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors see; a temporary one only where the session names none (tests)."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if not named:
        spark.sparkContext.setCheckpointDir(f"file://{tempfile.mkdtemp(prefix='quillwing-')}")
        named = spark.sparkContext.getCheckpointDir()
    return named.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table in the shared folder: cuts the lineage and survives lost executors."""
    path = scratch_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def give_back(user: str = "") -> None:
    """Hands memory that this Python worker has freed back to the system; workers live on from stage to stage.

    What others than ``user`` keep in ``KEPT`` goes first.
    """
    import pyarrow as pa

    for other in [name for name in KEPT if name != user]:
        del KEPT[other]
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library has no such call
        pass


def words(text: Column) -> Column:
    """Array of the maximal runs of characters other than ASCII white space."""
    return F.filter(F.split(text, WORD_BREAK), lambda w: w != "")


def text_bytes(df: DataFrame, text_col: str = "text") -> tuple[int, int]:
    """Number of rows, and UTF-8 bytes of all texts."""
    n, total = df.agg(F.count(F.lit(1)), F.sum(F.octet_length(text_col))).first()
    return n, total or 0


class OrderedBuckets:
    """Contiguous id ranges of about equally many rows.

    One pass over the id column alone finds the ranges; the driver gets two
    numbers a bucket, at most ``MAX_BUCKETS`` of them. Equal ids share a bucket;
    bucket 0 is for null ids, which sort before all others.
    """

    def __init__(self, df: DataFrame, id_col: str, count: int):
        count = max(1, min(count, MAX_BUCKETS))
        ids = df.select(F.col(id_col).cast("long").alias("_id")).where("_id is not null")
        found = (
            ids.repartitionByRange(count, "_id")
            .groupBy(F.spark_partition_id().alias("_p"))
            .agg(F.min("_id").alias("lo"), F.max("_id").alias("hi"))
            .collect()
        )
        ranges = sorted((r["lo"], r["hi"]) for r in found)
        self.lows, self.highs = [lo for lo, _ in ranges], [hi for _, hi in ranges]
        self.id_col = id_col

    def bucket(self) -> Column:
        """1 + the number of the range that holds the id: a binary search in a literal array."""
        if not self.lows:
            return F.lit(0)
        steps = [1 << k for k in range(len(self.lows).bit_length() - 1, -1, -1)]
        lows = "array(" + ",".join(f"{x}L" if x >= 0 else f"(-{-x}L)" for x in self.lows) + ")"
        found = (
            f"aggregate(array({','.join(map(str, steps))}), 0, (at, step) -> if(at + step <= {len(self.lows)} "
            f"and get({lows}, at + step - 1) <= cast(`{self.id_col}` as bigint), at + step, at))"
        )
        return F.coalesce(F.when(F.col(self.id_col).isNull(), F.lit(0)).otherwise(F.greatest(F.expr(found), F.lit(1))), F.lit(0))


def joined(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Labels (least member of each component) after the edges a, b between labelled nodes."""
    while True:
        x, y = label[a], label[b]
        apart = x != y
        if not apart.any():
            return label
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while True:
            after = label[label]
            if (after == label).all():
                break
            label = after


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Columns ``node``, ``component`` (least node reachable) for every node of ``edges`` (values of one orderable type).

    Each round takes the least label among the neighbours, hands it to the old
    label's node too, and jumps to the label's label (the FastSV scheme), so the
    rounds grow with the logarithm of the largest component. All joins are on
    shuffled keys; rounds are cut by tables in the shared folder. Self-loops,
    repeated edges and nulls are ignored.
    """
    spark = edges.sparkSession
    e = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u <> v")
    both = written(e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct(), "cc-edges")
    labels = written(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("l")), "cc-labels")
    while True:
        near = both.join(labels.select(F.col("u").alias("v"), "l"), "v").groupBy("u").agg(F.min("l").alias("m"))
        seen = labels.join(near, "u").select("u", "l", F.least("l", "m").alias("m"))
        seen = written(seen, "cc-seen")
        hooked = seen.groupBy(F.col("l").alias("u")).agg(F.min("m").alias("h"))
        step = seen.join(hooked, "u", "left").select("u", F.least("m", F.coalesce("h", "m")).alias("m"))
        step = written(step, "cc-step")
        jump = step.select(F.col("u").alias("m"), F.col("m").alias("j"))
        after = written(step.join(jump, "m").select("u", F.col("j").alias("l")), "cc-labels")
        changed = after.join(labels.withColumnRenamed("l", "old"), "u").where("l <> old").limit(1).count()
        labels = after
        if not changed:
            return labels.select(F.col("u").alias("node"), F.col("l").alias("component"))
