"""Near copies by the Jaccard similarity of word shingles: prefixes of ordered shingle sets give every candidate pair, the whole sets verify it."""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import give_back, joined, written
from .substring_dedup import STEP, Words, mixed

#: Texts that may have a shingle before it counts as frequent; the same at every size, so a shingle's pairs don't grow with the input.
FREQUENT = 16
#: Frequent shingles that come last in the order, the most frequent first; the driver gets no more. The order decides on cost alone.
LATE = 1 << 17
#: Hashes that a task sums up before it sends them.
HELD = 1 << 20
#: Pairs that a task gathers before it drops repeated ones, at least.
PAIRS_HELD = 1 << 20
#: Words of 64 bits in a set's parities, at least; a power of two.
PARITY_WORDS = 4
#: Bytes of text whose prefixes share a group, about half a million rows.
GROUP_BYTES = 16 << 20
#: Texts that a task remembers, to send what equal texts share once.
REMEMBERED = 1 << 20
LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
PREFIX = "group int, h long, key long, n int, at int"


def text_key(text_col: str) -> Column:
    """Equal texts have equal keys."""
    return F.xxhash64(F.coalesce(F.col(text_col).cast("string"), F.lit("")))


def shingle_sets(texts: list[str | None], shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """The hashes (ascending) of each text's set of shingles, A-Z in lower case, one text after another, and the sets' sizes.

    A text of fewer words has one shingle, all of them; one without a word the empty shingle.
    """
    words = Words([(t or "").encode("utf-8", "surrogatepass").translate(LOWER) for t in texts], shingle)
    h, doc = [words.runs(shingle)[words.whole]], [words.doc[words.whole]]
    first = np.cumsum(words.n_words) - words.n_words
    for k in range(shingle):
        short = np.flatnonzero(words.n_words == k)
        if len(short):
            h.append(mixed(words.runs(k)[first[short]] + np.uint64(k)) if k else np.full(len(short), STEP, np.uint64))
            doc.append(short)
    h, doc = np.concatenate(h), np.concatenate(doc)
    order = np.lexsort((h, doc))
    h, doc = h[order], doc[order]
    fresh = np.append(True, (h[1:] != h[:-1]) | (doc[1:] != doc[:-1]))[: len(h)]
    return h[fresh], np.bincount(doc[fresh], minlength=len(texts))


def set_batches(batches: Iterator[pa.RecordBatch], shingle: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(keys, hashes, sizes) of the texts of each 512 rows (key, text); a text that the task remembers is left out."""
    give_back()
    seen: set[int] = set()
    for whole in batches:
        for at in range(0, whole.num_rows, 512):
            b = whole.slice(at, 512)
            new = {}
            for key, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if key not in seen:
                    new[key] = text
            if new:
                if len(seen) < REMEMBERED:
                    seen.update(new)
                yield np.array(list(new), np.int64), *shingle_sets(list(new.values()), shingle)
    seen.clear()
    give_back()


def frequent_shingles(docs: DataFrame, total: int, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes (ascending) of shingles that more than FREQUENT texts have, the LATE most frequent, and how many texts have each.

    All texts are counted, exactly: a task sums up its hashes, parts of the hashes add up the tasks' sums.
    """
    parts = total // GROUP_BYTES + 1

    def dealt(h: np.ndarray) -> pa.RecordBatch:
        h, n = np.unique(h, return_counts=True)
        part = (h % np.uint64(parts)).astype(np.int32)
        order = np.argsort(part, kind="stable")
        some, first = np.unique(part[order], return_index=True)
        cuts = pa.array(np.append(first, len(h)).astype(np.int32))
        return pa.RecordBatch.from_arrays([pa.array(some), pa.ListArray.from_arrays(cuts, pa.array(h[order].view(np.int64))), pa.ListArray.from_arrays(cuts, pa.array(n[order].astype(np.int32)))], ["part", "h", "n"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        for _, h, _ in set_batches(batches, shingle):
            held.append(h)
            if sum(map(len, held)) >= HELD:
                yield dealt(np.concatenate(held))
                held = []
        if held:
            yield dealt(np.concatenate(held))

    def add(group: pa.Table) -> pa.Table:
        give_back()
        h, n = (group.column(c).combine_chunks().flatten().to_numpy() for c in ("h", "n"))
        h, at = np.unique(h, return_inverse=True)
        sums = np.bincount(at, n, len(h)).astype(np.int64)
        return pa.table({"h": h[sums > FREQUENT], "n": sums[sums > FREQUENT]})

    tasks = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), parts)
    sums = docs.mapInArrow(count, "part int, h array<long>, n array<int>").repartition(tasks, "part").groupBy("part").applyInArrow(add, "h long, n long")
    found = sums.orderBy(F.desc("n"), "h").limit(LATE).toArrow()
    h, n = found.column("h").to_numpy().view(np.uint64), found.column("n").to_numpy()
    order = np.argsort(h)
    return h[order], n[order].astype(np.int32)


def prefixes(h: np.ndarray, sizes: np.ndarray, frequent: tuple[np.ndarray, np.ndarray], least: Fraction) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(shingle, text, size of the text's set, place in it) of the first n - ceil(least * n) + 1 shingles of every text's ordered set.

    Two sets of similarity ``least`` or more share so many shingles that these beginnings share one, whatever the order;
    in it ``frequent`` shingles (hashes, ascending, and counts) come last, the most frequent at the end.
    """
    doc = np.repeat(np.arange(len(sizes)), sizes)
    known, count = frequent
    spot = np.searchsorted(known, h)
    late = np.zeros(len(h), np.int32)
    inside = np.flatnonzero(spot < len(known))
    inside = inside[known[spot[inside]] == h[inside]]
    late[inside] = count[spot[inside]]
    order = np.lexsort((h, late, doc))
    h, doc = h[order], doc[order]
    n = sizes
    at = np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)
    n = n[doc]
    first = at <= n - -(-n * least.numerator // least.denominator)
    return h[first], doc[first], n[first], at[first]


def distinct_pairs(parts: list[np.ndarray]) -> np.ndarray:
    """The rows (a, b) of all parts, each once, in order."""
    pairs = np.concatenate(parts)
    pairs = pairs[np.lexsort((pairs[:, 1], pairs[:, 0]))]
    return pairs[np.append(True, (pairs[1:] != pairs[:-1]).any(axis=1))[: len(pairs)]]


def spanning_forest(pairs: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Those rows (a, b) of ``pairs``, and their weights, that join all they join at the least weights: fewer than there are keys.

    Each round takes every component's lightest pair (Boruvka's scheme); of equal weights the first.
    """
    order = np.argsort(weight, kind="stable")
    pairs, weight = pairs[order], weight[order]
    every, ends = np.unique(pairs, return_inverse=True)
    a, b = ends.reshape(pairs.shape).T
    label, left, taken = np.arange(len(every)), np.arange(len(pairs)), np.zeros(len(pairs), bool)
    while True:
        x, y = label[a[left]], label[b[left]]
        apart = x != y
        if not apart.any():
            return pairs[taken], weight[taken]
        left, x, y = left[apart], x[apart], y[apart]
        best = np.full(len(every), len(pairs))
        np.minimum.at(best, x, left)
        np.minimum.at(best, y, left)
        new = np.unique(best[best < len(pairs)])
        taken[new] = True
        label = joined(label, a[new], b[new])


def candidates(h: np.ndarray, key: np.ndarray, n: np.ndarray, at: np.ndarray, label: np.ndarray | None, least: Fraction, parity: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of keys that share a prefix shingle and whose sizes and places allow ``least``: with labels all pairs of different ones.

    With ``parity`` (a row of 64-bit words each, see ``folded``) pairs that it rules out go too.
    Without labels, pairs that join the same keys as all would, by parities that differ in as few places as can be: a spanning forest.
    """
    forest = label is None
    order = np.lexsort((key, n, h))
    h, key, n, at = h[order], key[order], n[order], at[order]
    label = key if label is None else label[order]
    parity = None if parity is None else parity[order].view(np.uint64)  # of signed numbers numpy counts the absolute value's bits
    parts, weights, held = [np.empty((0, 2), np.int64)], [np.empty(0)], 0
    i, d = np.arange(len(h)), 1
    while True:
        i = i[i + d < len(h)]
        i = i[(h[i] == h[i + d]) & (n[i + d] * least.numerator <= n[i] * least.denominator)]
        if not len(i):
            break
        j = i + d
        fit = (label[i] != label[j]) & ((least.numerator + least.denominator) * np.minimum(n[i] - at[i], n[j] - at[j]) >= least.numerator * (n[i] + n[j]))
        x, y = i[fit], j[fit]
        if parity is not None:
            apart = np.bitwise_count(parity[x] ^ parity[y]).sum(axis=1, dtype=np.int64)
            some = (least.numerator + least.denominator) * apart <= (least.denominator - least.numerator) * (n[x] + n[y])
            x, y = x[some], y[some]
            if forest:
                weights.append(apart[some] / (n[x] + n[y]))
        a, b = key[x], key[y]
        parts.append(np.stack([np.minimum(a, b), np.maximum(a, b)], axis=1))
        held += len(a)
        if held > max(PAIRS_HELD, len(parts[0])):
            if forest:
                parts, weights = ([x] for x in spanning_forest(np.concatenate(parts), np.concatenate(weights)))
            else:
                parts = [distinct_pairs(parts)]
            held = 0
        d += 1
    if forest:
        parts = [spanning_forest(np.concatenate(parts), np.concatenate(weights))[0]]
    out = distinct_pairs(parts)
    return out[:, 0], out[:, 1]


def parities(h: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bits of each set, as 64-bit words one set after another, and each set's number of words: whether an odd number of its hashes fall on the bit.

    Two sets' bits differ at no more places than the sets have hashes apart from
    each other. A set has at least as many bits as hashes, a power of two; words
    k and k + half of them, one xor the other, are the same set's half as many bits.
    """
    words = np.maximum(PARITY_WORDS, 1 << np.ceil(np.log2(np.maximum(sizes, 1) / 64)).clip(0).astype(np.int64))
    start = np.cumsum(words) - words
    doc = np.repeat(np.arange(len(sizes)), sizes)
    bit = (h >> np.uint64(20) & (64 * words[doc] - 1).astype(np.uint64)).astype(np.int64)
    odd = np.bincount(64 * start[doc] + bit, minlength=64 * int(words.sum())) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64), words


def folded(parity: str) -> list[Column]:
    """PARITY_WORDS columns p0, p1, ...: a column of parities folded to so many words; what two differ in there, they differ in at first."""
    return [F.expr(f"aggregate(filter({parity}, (x, i) -> i % {PARITY_WORDS} = {k}), 0L, (s, x) -> s ^ x)").alias(f"p{k}") for k in range(PARITY_WORDS)]


def parity_difference(a: str, b: str) -> Column:
    """Places at which two columns of parities differ; one may have twice the words of the other, which is folded then."""
    half = lambda c: f"zip_with(slice({c}, 1, cast(size({c}) / 2 as int)), slice({c}, cast(size({c}) / 2 as int) + 1, cast(size({c}) / 2 as int)), (x, y) -> x ^ y)"
    folded = lambda c, d: f"if(size({c}) > size({d}), {half(c)}, {c})"
    return F.expr(f"aggregate(zip_with({folded(a, b)}, {folded(b, a)}, (x, y) -> bit_count(x ^ y)), 0, (s, x) -> s + x)")


def verified(pairs: DataFrame, docs: DataFrame, marks: DataFrame, shingle: int, least: Fraction) -> DataFrame:
    """Columns a, b: the pairs whose whole shingle sets have a similarity of ``least`` or more.

    ``marks`` has key, n and parity of every text's set. Pairs whose sizes or
    parities rule that similarity out go first; only the others' sets are moved.
    """

    def sets_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, h, sizes in set_batches(batches, shingle):
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(sizes)).astype(np.int32)), pa.array(h.view(np.int64)))], ["key", "h"])

    up, down = least.numerator, least.denominator
    pairs = pairs.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    side = lambda c: marks.select(F.col("key").alias(c), F.col("n").alias(f"_n{c}"), F.col("parity").alias(f"_p{c}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b").where(F.least("_na", "_nb") * down >= F.greatest("_na", "_nb") * up)
    possible = both.where(parity_difference("_pa", "_pb") * (up + down) <= (F.col("_na") + F.col("_nb")) * (down - up))
    pairs = written(possible.select("a", "b"), "near-pairs")
    keys = written(pairs.select(F.explode(F.array("a", "b")).alias("key")).distinct(), "near-keys")  # as a table it has a known size: small ones are broadcast, and texts stay where they are
    sets = docs.join(keys, "key", "left_semi").select("key", "text").mapInArrow(sets_of, "key long, h array<long>")
    sets = written(sets.dropDuplicates(["key"]), "near-sets")
    both = pairs.join(sets.select(F.col("key").alias("a"), F.col("h").alias("x")), "a").join(sets.select(F.col("key").alias("b"), F.col("h").alias("y")), "b")
    return written(both.where(F.size(F.array_intersect("x", "y")) * (up + down) >= (F.size("x") + F.size("y")) * up).select("a", "b"), "near-links")


def shared_prefixes(docs: DataFrame, total: int, shingle: int, least: Fraction) -> DataFrame:
    """Columns of PREFIX: the prefixes' shingles that several texts have there, as a table."""
    frequent, groups = frequent_shingles(docs, total, shingle), total // GROUP_BYTES + 1

    def begin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, h, sizes in set_batches(batches, shingle):
            h, doc, n, place = prefixes(h, sizes, frequent, least)
            yield pa.RecordBatch.from_arrays([pa.array((h % np.uint64(groups)).astype(np.int32)), pa.array(h.view(np.int64)), pa.array(key[doc]), pa.array(n.astype(np.int32)), pa.array(place.astype(np.int32))], ["group", "h", "key", "n", "at"])

    def share(group: pa.Table) -> pa.Table:
        give_back()
        h, key = group.column("h").to_numpy(), group.column("key").to_numpy()
        order = np.lexsort((key, h))
        order = order[np.append(True, (h[order[1:]] != h[order[:-1]]) | (key[order[1:]] != key[order[:-1]]))[: len(order)]]
        same = h[order[1:]] == h[order[:-1]]
        return group.take(pa.array(order[np.append(same, False) | np.append(False, same)]))

    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), groups)
    return written(docs.mapInArrow(begin, PREFIX).repartition(parts, "group").groupBy("group").applyInArrow(share, PREFIX), "near-shared")


def sharing_pairs(shared: DataFrame, least: Fraction) -> DataFrame:
    """Columns a, b: candidates among the texts of each shingle that their parities (columns p0, p1, ...) allow; with a column label all of different labels, else spanning forests."""

    def pair(group: pa.Table) -> pa.Table:
        h, key, n, at = (group.column(c).to_numpy().astype(np.int64) for c in ("h", "key", "n", "at"))
        label = group.column("label").to_numpy() if "label" in group.column_names else None
        parity = np.stack([group.column(f"p{k}").to_numpy() for k in range(PARITY_WORDS)], axis=1)
        a, b = candidates(h, key, n, at, label, least, parity)
        return pa.table({"a": a, "b": b})

    return shared.groupBy("group").applyInArrow(pair, "a long, b long")
