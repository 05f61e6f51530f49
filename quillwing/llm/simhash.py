"""SimHash near-duplicates: shards of fingerprints, searched by vantage-point trees, give all pairs within a few bits."""

from __future__ import annotations

import itertools
import string
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import near_copies
from .common import connected_components, joined, text_bytes, words, written

#: Fingerprints that chance alone may put under one key.
LEAF = 1024
#: Fingerprints under one key that one task searches.
BLOCK = 4096
#: Rows of keys that one call of a worker takes.
BATCH = 8192


def ascii_lower(text: Column) -> Column:
    """A-Z to a-z, nothing else; texts of ASCII alone take the fast way."""
    return F.when(text.rlike(r"[^\x00-\x7F]"), F.translate(text, string.ascii_uppercase, string.ascii_lowercase)).otherwise(F.lower(text))


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4) -> DataFrame:
    """Columns doc_id, fp (long), text_hash, copies: one row for each distinct id and text; copies counts the rows that have both.

    Bit b of fp is set where more than half the shingles' hashes have bit b.
    Hashing and counting stay in the JVM: two bits' counts share a long (the low
    and the high half), and a text's shingles are summed where they arise, so
    32 longs a document are shuffled, no text.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    docs = df.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("_same"), words(ascii_lower(text)).alias("_w"))
    rest = ", ".join(f"get(_w, i + {k})" for k in range(1, shingle))
    many = f"transform(slice(_w, 1, size(_w) - {shingle - 1}), (w, i) -> xxhash64(concat_ws(' ', w, {rest})))" if shingle > 1 else "transform(_w, w -> xxhash64(w))"
    hashes = F.expr(f"case when size(_w) >= {shingle} then {many} when size(_w) > 0 then array(xxhash64(array_join(_w, ' '))) else array(cast(null as bigint)) end")
    each = docs.select("doc_id", "_same", F.posexplode(hashes).alias("_p", "h"))
    pair = F.lit(0x1_0000_0001)
    sums = each.groupBy("doc_id", "_same").agg(F.count("h").alias("n"), F.sum((F.col("_p") == 0).cast("long")).alias("copies"), *[F.sum(F.shiftrightunsigned("h", i).bitwiseAND(pair)).alias(f"s{i}") for i in range(32)])
    low, bits = F.lit(0xFFFF_FFFF), []
    for i in range(32):
        bits.append(F.when(F.col(f"s{i}").bitwiseAND(low) * 2 > F.col("n"), F.lit(1 << i)).otherwise(F.lit(0)).cast("long"))
        bits.append(F.when(F.shiftrightunsigned(f"s{i}", 32) * 2 > F.col("n"), F.lit((1 << (i + 32)) - ((1 << 64) if i == 31 else 0))).otherwise(F.lit(0)).cast("long"))
    fp = bits[0]
    for b in bits[1:]:
        fp = fp.bitwiseOR(b)
    return sums.select("doc_id", F.coalesce(fp, F.lit(0)).alias("fp"), F.col("_same").alias("text_hash"), "copies")


class Shards:
    """Keys under which every two fingerprints within ``radius`` bits meet, at a fixed number of keys a fingerprint.

    Of ``parts`` parts of the 64 bits at most ``radius`` differ between the two, so
    they agree in some choice of parts - radius of them; there is one key for each
    choice. More parts make longer keys: their number is the least for which
    chance alone puts at most LEAF fingerprints under a key.
    """

    def __init__(self, points: int, radius: int):
        for parts in range(radius + 1, 65):
            cuts = [round(64 * k / parts) for k in range(parts + 1)]
            masks = [sum((1 << b) - (1 << a) for a, b in choice) for choice in itertools.combinations(list(itertools.pairwise(cuts)), parts - radius)]
            if points >> min(m.bit_count() for m in masks) <= LEAF:
                break
        self.masks = masks

    def keys(self, fp: str = "fp") -> Column:
        """Array of the keys (long) of a fingerprint."""
        signed = [m - (1 << 64) if m >> 63 else m for m in self.masks]
        return F.array(*[F.xxhash64(F.lit(i), F.col(fp).bitwiseAND(F.lit(m))) for i, m in enumerate(signed)])


class VantageTree:
    """Finds all pairs of points and queries within ``radius`` bits.

    A node's vantage point is one of its points, its threshold the median of
    their distances to it. Points up to the threshold go inside, the others outside. A
    query goes where the triangle inequality allows a partner: inside up to
    threshold + radius, outside beyond threshold - radius; those on the boundary
    go both ways. Leaves, and nodes that no distance splits, compare in blocks.
    ``compared`` counts the comparisons made.
    """

    def __init__(self, radius: int, leaf: int = 96):
        self.radius, self.leaf, self.compared = radius, leaf, 0

    def pairs(self, points: np.ndarray, queries: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Blocks of (index of a point, index of a query)."""
        nodes = [(np.arange(len(points)), np.arange(len(queries)))]
        while nodes:
            p, q = nodes.pop()
            if not len(p) or not len(q):
                continue
            if len(p) > self.leaf:
                vantage = points[p[len(p) // 2]]
                dp, dq = np.bitwise_count(points[p] ^ vantage).astype(np.int64), np.bitwise_count(queries[q] ^ vantage).astype(np.int64)
                m = int(np.median(dp))
                if (dp > m).any():
                    nodes.append((p[dp <= m], q[dq <= m + self.radius]))
                    nodes.append((p[dp > m], q[dq > m - self.radius]))
                    continue
            self.compared += len(p) * len(q)
            step = max(1, (1 << 20) // len(q))
            for i in range(0, len(p), step):
                x, y = np.nonzero(np.bitwise_count(points[p[i : i + step], None] ^ queries[q][None, :]) <= self.radius)
                yield p[x + i], q[y]


def link_shard(points: np.ndarray, queries: np.ndarray, radius: int, leaf: int = 96) -> tuple[np.ndarray, np.ndarray]:
    """Components of the links between points and queries within ``radius`` bits: (least member, member) for each other member."""
    every, at = np.unique(np.concatenate([points, queries]), return_inverse=True)
    label = np.arange(len(every))
    mine, theirs = at[: len(points)], at[len(points) :]
    for x, y in VantageTree(radius, leaf).pairs(points, queries):
        label = joined(label, mine[x], theirs[y])
    other = np.flatnonzero(label != np.arange(len(every)))
    return every[label[other]], every[other]


def links(fps: DataFrame, radius: int, fp_col: str = "fp") -> DataFrame:
    """Columns a, b: edges between distinct fingerprints whose components are those of all pairs within ``radius`` bits.

    Each fingerprint goes to the shards of its keys; a shard is searched with a
    vantage-point tree and gives its components' spanning stars, so the edges
    grow with the fingerprints, not with the pairs. A shard of over BLOCK
    fingerprints (a crowd of near copies) is dealt into blocks, every two of
    which meet in a task of their own.
    """
    fps = fps.select(F.col(fp_col).alias("fp"))
    points = fps.count()
    shards = Shards(points, radius)
    spread = fps.select(F.explode(shards.keys()).alias("key"), "fp")
    crowds = written(spread.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > BLOCK), "simhash-crowds")
    rows = spread.select("key", F.lit(False).alias("query"), "fp")
    if crowds.limit(1).count():
        blocks = F.ceil(F.col("n") / BLOCK).cast("int")
        own, other = F.pmod(F.xxhash64(F.lit(1), "fp"), blocks).cast("int"), F.col("other")
        met = spread.join(crowds, "key").select("key", "fp", own.alias("own"), F.explode(F.sequence(F.lit(0), blocks - 1)).alias("other"))
        met = met.select(F.xxhash64("key", F.least("own", other), F.greatest("own", other)).alias("key"), (F.col("own") > other).alias("query"), "fp")
        rows = rows.join(crowds, "key", "left_anti").unionByName(met)
    leaves = max(1, points * len(shards.masks) // BATCH)

    def link(group: pa.Table) -> pa.Table:
        key, query, fp = (np.asarray(group.column(n)) for n in ("key", "query", "fp"))
        order = np.lexsort((fp, query, key))
        key, query, fp = key[order], query[order], fp[order].view(np.uint64)
        cuts = np.flatnonzero(np.diff(key, prepend=~key[:1], append=~key[-1:]))
        found = [(np.zeros(0, np.uint64), np.zeros(0, np.uint64))]
        for i, j in itertools.pairwise(cuts.tolist()):
            if j - i > 1:
                k = i + int((~query[i:j]).sum())
                found.append(link_shard(fp[i:k], fp[k:j], radius) if i < k < j else link_shard(fp[i:j], fp[i:j], radius))
        a, b = (np.concatenate(x) for x in zip(*found, strict=True))
        return pa.table({"a": a.view(np.int64), "b": b.view(np.int64)})

    return rows.groupBy(F.pmod(F.xxhash64("key"), F.lit(leaves)).alias("leaf")).applyInArrow(link, "a long, b long")


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, radius: int = 4) -> DataFrame:
    """Columns doc_id, fp, component_id, text_hash: one row an input row.

    Documents link where their fingerprints differ in at most ``radius`` bits;
    component_id is the smallest id reachable. Null texts are empty; texts
    without a word have fingerprint zero and link like others; null ids take
    part and have their component's id, null where all are null. Other columns are ignored.
    """
    marks = written(fingerprints(df, id_col, text_col, shingle), "simhash")
    fps = written(marks.groupBy("fp").agg(F.min("doc_id").alias("first")), "simhash-distinct")
    comps = connected_components(written(links(fps, radius), "simhash-links"))
    firsts = fps.join(comps, fps["fp"] == comps["node"]).select("fp", "first", "component")
    least = written(firsts, "simhash-members")
    named = least.join(least.groupBy("component").agg(F.min("first").alias("least")), "component").select(F.col("fp").alias("node"), "least")
    table = written(fps.join(named, fps["fp"] == named["node"], "left").select("fp", F.coalesce("least", "first").alias("component_id")), "simhash-components")
    return marks.join(table, "fp").select("doc_id", "fp", "component_id", "text_hash", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("_n")).drop("_n")


def majority(h: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Fingerprints of sets of 64-bit hashes that lie one after another: a bit is set if over half a set's hashes have it."""
    out = np.zeros(len(sizes), np.uint64)
    some = np.flatnonzero(sizes)
    starts = (np.cumsum(sizes) - sizes)[some]
    for bit in range(64):
        ones = np.add.reduceat((h >> np.uint64(bit) & np.uint64(1)).astype(np.int32), starts) if len(some) else np.zeros(0, np.int32)
        out[some] |= (2 * ones > sizes[some]).astype(np.uint64) << np.uint64(bit)
    return out


def contracted(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """Columns a, b: each two components (``labels``: key, component; other keys are their own) that an edge joins, once, by their labels."""
    of = lambda c: labels.select(F.col("key").alias(c), F.col("component").alias(f"_{c}"))
    named = edges.join(of("a"), "a", "left").join(of("b"), "b", "left")
    a, b = F.coalesce("_a", "a"), F.coalesce("_b", "b")
    return named.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).distinct()


def similar_texts(docs: DataFrame, total: int, shingle: int, radius: int, least: Fraction) -> DataFrame:
    """Columns a, b: edges between text keys whose components are those of all pairs of similarity ``least`` or more.

    ``docs`` has key and text; ``total`` is about the bytes of text. Candidates
    come first from the fingerprints within ``radius`` bits, and from spanning forests of
    the texts that share a prefix shingle, the likeliest pairs first: these join copies and crowds by as many pairs as texts.
    Next come all pairs that share a prefix shingle and whose components still
    differ, but for those that their sets' parities rule out. Every candidate is verified by its whole sets.
    The edges are each component's star, and one edge for all pairs that join the same two.
    """

    def fingerprint(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, h, sizes in near_copies.set_batches(batches, shingle):
            bits, many = near_copies.parities(h, sizes)
            parity = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(many)).astype(np.int32)), pa.array(bits))
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(majority(h, sizes).view(np.int64)), pa.array(sizes), parity], ["key", "fp", "n", "parity"])

    marks = written(docs.mapInArrow(fingerprint, "key long, fp long, n long, parity array<long>").dropDuplicates(["key"]), "simhash")
    firsts = written(marks.groupBy("fp").agg(F.min("key").alias("first")), "simhash-distinct")
    edges = written(links(firsts, radius), "simhash-links")
    of = lambda c: firsts.select(F.col("fp").alias(c), F.col("first").alias(f"_{c}"))
    close = edges.join(of("a"), "a").join(of("b"), "b").select(F.col("_a").alias("a"), F.col("_b").alias("b"))
    close = close.unionByName(marks.join(firsts, "fp").select(F.col("first").alias("a"), F.col("key").alias("b")))
    shared = near_copies.shared_prefixes(docs, total, shingle, least)
    parity = marks.select("key", *near_copies.folded("parity"))
    close = close.unionByName(near_copies.sharing_pairs(shared.join(parity, "key"), least))
    close = near_copies.verified(close, docs, marks, shingle, least)
    labels = written(connected_components(close).withColumnRenamed("node", "key"), "near-labels")
    named = shared.join(labels, "key", "left").withColumn("label", F.coalesce("component", "key")).drop("component").join(parity, "key")
    rest = near_copies.verified(near_copies.sharing_pairs(named, least), docs, marks, shingle, least)
    stars = labels.where("key <> component").select(F.col("component").alias("a"), F.col("key").alias("b"))
    return stars.unionByName(contracted(rest, labels))


def drop_near_copies(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, radius: int = 4, least: Fraction | None = None) -> DataFrame:
    """The rows of ``df``, all columns, without those of a component but its smallest id's.

    Texts link by their fingerprints alone, as in ``near_duplicates``; with
    ``least`` they link where the Jaccard similarity of their sets of
    ``shingle``-word shingles, A-Z in lower case, is at least that. Rows with a
    null id stay, and so do rows that share the smallest id. Null texts are empty; texts without a word are alike.
    """
    key = near_copies.text_key(text_col)
    if least is None:
        found = near_duplicates(df, id_col, text_col, shingle, radius)
        gone = found.where("doc_id <> component_id").select(F.col("doc_id").alias("_qw_id"), F.col("text_hash").alias("_qw_hash")).distinct()
    else:
        docs = df.select(key.alias("key"), F.col(text_col).cast("string").alias("text"))
        comps = connected_components(similar_texts(docs, text_bytes(df, text_col)[1], shingle, radius, least))
        marks = df.select(F.col(id_col).cast("long").alias("_qw_id"), key.alias("_qw_hash")).distinct()
        firsts = marks.groupBy("_qw_hash").agg(F.min("_qw_id").alias("first"))
        members = written(firsts.join(comps, F.col("_qw_hash") == F.col("node"), "left").select("_qw_hash", "first", "component"), "near-members")
        named = members.where("component is not null").groupBy("component").agg(F.min("first").alias("least"))
        table = members.join(named, "component", "left").select("_qw_hash", F.coalesce("least", "first").alias("keep"))
        gone = marks.join(table, "_qw_hash").where("_qw_id <> keep").select("_qw_id", "_qw_hash")
    return df.join(gone, (F.col(id_col).cast("long") == F.col("_qw_id")) & (key == F.col("_qw_hash")), "left_anti")


def hex_fingerprint(fp: Column) -> Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")
