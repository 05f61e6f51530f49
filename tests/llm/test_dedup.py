import hashlib
import random

import numpy as np
import xxhash

from quillwing.llm import common, exact_dedup, simhash, substring_dedup
from quillwing.llm.simhash import Shards, VantageTree, link_shard


def test_exact_dedup_against_a_dictionary(docs, docs_rows):
    best, size = {}, {}
    for i, t in docs_rows:
        best[t or ""] = max(best.get(t or "", i), i)
        size[t or ""] = size.get(t or "", 0) + 1
    for levels in (None, 1, 3):
        got = {r.doc_id: r for r in exact_dedup.exact_dedup(docs, largest=True, levels=levels).collect()}
        assert len(got) == len(docs_rows)
        for i, t in docs_rows:
            assert got[i][1:] == (best[t or ""], size[t or ""], i == best[t or ""], hashlib.sha256((t or "").encode()).hexdigest())


def test_exact_dedup_keeps_the_smallest_and_normalises(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(3, "A b"), (1, "a B"), (2, "c")], "doc_id long, text string")
    got = {r.doc_id: r.keep_id for r in exact_dedup.exact_dedup(df, normalise=F.lower).collect()}
    assert got == {3: 1, 1: 1, 2: 2}


def test_exact_dedup_of_odd_rows(odd_docs, no_docs):
    got = sorted(((r.doc_id, r.keep_id, r.group_size, r.kept) for r in exact_dedup.exact_dedup(odd_docs, largest=True).collect()), key=repr)
    assert sorted(got, key=repr) == sorted([(None, 5, 3, False), (None, 2, 2, False), (5, 5, 3, True), (5, 9, 2, False), (5, 5, 3, True), (9, 9, 2, True), (2, 2, 2, True)], key=repr)
    left = exact_dedup.drop_copies(odd_docs, largest=True)
    assert left.columns == odd_docs.columns
    assert sorted((r.doc_id, r.text) for r in left.collect()) == [(2, ""), (5, "one two three four five"), (9, "other words stand in here")]
    assert exact_dedup.exact_dedup(no_docs).count() == exact_dedup.drop_copies(no_docs).count() == 0


def test_tree_merge_sorts_runs_and_takes_rounds(spark, docs):
    runs = exact_dedup.digest_runs(docs.repartition(40), "doc_id", "text")
    merged = exact_dedup.tree_merge(runs)
    plan = merged._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(") == 2 and plan.count("SortAggregate") == 4 and "HashAggregate" not in plan
    assert sorted(map(tuple, merged.collect())) == sorted(map(tuple, exact_dedup.tree_merge(runs, levels=1).collect()))


def fingerprint(text):
    w = (text or "").encode().translate(bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))).split()
    shingles = [b" ".join(w[k : k + 4]) for k in range(len(w) - 3)] if len(w) >= 4 else [b" ".join(w)] * bool(w)
    hashes = [xxhash.xxh64_intdigest(s, seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(items, radius):
    """By the full matrix: (id, fingerprint) to the least id reachable."""
    ids, fps = [i for i, _ in items], np.array([f for _, f in items], np.uint64)
    near = np.bitwise_count(fps[:, None] ^ fps[None, :]) <= radius
    label = np.array(ids, object)
    while True:
        after = np.array([label[n].min() for n in near], object)
        if (after == label).all():
            return dict(zip(ids, label.tolist(), strict=True))
        label = after


def test_simhash_against_brute_force(docs, docs_rows):
    items = [(i, fingerprint(t)) for i, t in docs_rows]
    got = {r.doc_id: r for r in simhash.near_duplicates(docs).collect()}
    assert {i: r.fp & (2**64 - 1) for i, r in got.items()} == dict(items)
    assert {i: r.component_id for i, r in got.items()} == components(items, 4)
    left = simhash.drop_near_copies(docs)
    assert left.columns == docs.columns
    assert sorted(r.doc_id for r in left.collect()) == sorted(set(components(items, 4).values()))


def test_simhash_of_odd_rows(odd_docs, no_docs):
    rows = simhash.near_duplicates(odd_docs).collect()
    assert len(rows) == odd_docs.count() and sum((r.doc_id, r.component_id) == (5, 5) for r in rows) == 3
    got = {(r.doc_id, r.component_id) for r in rows}
    assert (5, 5) in got and (9, 5) in got and (2, 2) in got and (None, 5) in got and (None, 2) in got
    assert simhash.near_duplicates(no_docs).count() == simhash.drop_near_copies(no_docs).count() == 0


def crowd(r, n):
    """Random fingerprints, and pairs and chains a few bits apart."""
    out = [r.getrandbits(64) for _ in range(n)]
    for f in out[: n // 3]:
        x = f
        for _ in range(3):
            for b in r.sample(range(64), r.randint(1, 5)):
                x ^= 1 << b
            out.append(x)
    return np.array(sorted(set(out)), np.uint64)


def signed(fps):
    return [(int(f) - (1 << 64) if f >= 1 << 63 else int(f),) for f in fps.tolist()]


def test_every_close_pair_meets_under_a_key(spark):
    fps = crowd(random.Random(1), 300)
    close = np.argwhere(np.bitwise_count(fps[:, None] ^ fps[None, :]) <= 4).tolist()
    df = spark.createDataFrame(signed(fps), "fp long")
    sizes = []
    for points in (900, 10**8, 10**11):
        shards = Shards(points, 4)
        sizes.append(len(shards.masks))
        homes = {r.fp & (2**64 - 1): set(r.k) for r in df.select("fp", shards.keys().alias("k")).collect()}
        assert all(homes[int(fps[a])] & homes[int(fps[b])] for a, b in close)
        assert points >> min(m.bit_count() for m in shards.masks) <= simhash.LEAF
    assert sizes == [5, 15, 35]


def test_vantage_tree_finds_all_pairs_and_prunes():
    fps = crowd(random.Random(2), 900)
    near = np.bitwise_count(fps[:, None] ^ fps[None, :]) <= 4
    tree = VantageTree(4, leaf=16)
    found = {(a, b) for x, y in tree.pairs(fps, fps) for a, b in zip(x.tolist(), y.tolist(), strict=True)}
    assert found == set(map(tuple, np.argwhere(near).tolist()))
    assert tree.compared < 0.7 * len(fps) ** 2
    same = np.array([7, 7, 7, 1 << 40], np.uint64)
    assert sum(len(x) for x, _ in VantageTree(4, leaf=1).pairs(same, same)) == 16


def test_shard_links_are_spanning_stars():
    fps = crowd(random.Random(2), 400)
    want = components([(int(f), int(f)) for f in fps], 4)
    for leaf in (8, 10**6):
        a, b = link_shard(fps, fps, 4, leaf)
        label = {int(x): int(x) for x in fps}
        label.update(zip(b.tolist(), a.tolist(), strict=True))
        assert label == want and len(a) < len(fps)


def test_links_through_many_shards_and_blocks(spark, monkeypatch):
    r = random.Random(3)
    center = r.getrandbits(64)
    dense = [center]
    for _ in range(200):
        x = r.choice(dense)
        for b in r.sample(range(64), r.randint(1, 4)):
            x ^= 1 << b
        dense.append(x)
    fps = np.unique(np.concatenate([crowd(r, 300), np.array(dense, np.uint64)]))
    df = spark.createDataFrame(signed(fps), "fp long")
    groups = {}
    for f, root in components([(int(f), int(f)) for f in fps], 4).items():
        groups.setdefault(root, set()).add(f)
    want = sorted(sorted(g) for g in groups.values() if len(g) > 1)
    for block, batch in ((4096, 64), (16, 100)):
        monkeypatch.setattr(simhash, "BLOCK", block)
        monkeypatch.setattr(simhash, "BATCH", batch)
        got = {}
        for x in common.connected_components(simhash.links(df, 4)).collect():
            got.setdefault(x.component, set()).add(x.node & (2**64 - 1))
        assert sorted(map(sorted, got.values())) == want


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(50)] + [(100, 100 + k) for k in range(1, 30)] + [(7, 7), (None, 3), (200, 201), (201, 200)]
    got = {r.node: r.component for r in common.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(51)} | {i: 100 for i in range(100, 130)} | {200: 200, 201: 200}
    assert common.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def removed_words(rows, window):
    """Brute force: id to (words, mask of removed words)."""
    first = {}
    for i, t in rows:
        w = (t or "").encode().split()
        for k in range(len(w) - window + 1):
            g = tuple(w[k : k + window])
            first[g] = min(first.get(g, i), i)
    out = {}
    for i, t in rows:
        w = (t or "").encode().split()
        gone = [False] * len(w)
        for k in range(len(w) - window + 1):
            if first[tuple(w[k : k + window])] < i:
                gone[k : k + window] = [True] * window
        out[i] = (w, gone)
    return out


def test_substring_dedup_against_brute_force(docs, docs_rows):
    for window in (13, 3):
        want = removed_words(docs_rows, window)
        got = {r.doc_id: r for r in substring_dedup.repeated_words(docs, window=window).collect()}
        assert len(got) == len(docs_rows)
        for i, (w, gone) in want.items():
            kept = b" ".join(x for x, g in zip(w, gone, strict=True) if not g).decode()
            assert (got[i].n_words, got[i].n_removed, got[i].kept) == (len(w), sum(gone), kept)
    assert sum(sum(g) for _, g in want.values()) > 500


def test_words_that_cancel_in_polynomials_differ(spark):
    """Thue-Morse words and their complements: polynomials modulo a power of two give them one hash."""
    pairs = []
    for n in (64, 1024, 2048, 4096):
        bits = [bin(k).count("1") & 1 for k in range(n)]
        pairs += [("".join("ab"[b] for b in bits), "".join("ba"[b] for b in bits))]
    context = " ".join(f"word{k}" for k in range(12))
    rows = [(2 * k + j, f"{p[j]} {context}") for k, p in enumerate(pairs) for j in (0, 1)]
    got = substring_dedup.repeated_words(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert [r.n_removed for r in got] == [0] * len(rows)
    data = b" ".join(w.encode() for p in pairs for w in p) + b" " * 8
    size = np.array([len(w) for p in pairs for w in p])
    assert len(set(substring_dedup.word_codes(data, np.cumsum(size + 1) - size - 1, size).tolist())) == 8


def test_windows_that_share_a_hash_are_told_apart():
    r = random.Random(9)
    words = substring_dedup.Words([" ".join(r.choice("ab") for _ in range(300)).encode()], 4)
    at = np.flatnonzero(words.whole)
    for run in (words.runs(4)[at], np.zeros(len(at), np.uint64)):
        order, first = words.classes(at, np.zeros(len(at), np.int64), run)
        found = {}
        for k, n in zip(at[order].tolist(), (np.cumsum(first) - 1).tolist(), strict=True):
            found.setdefault(n, set()).add(tuple(words.codes[k : k + 4].tolist()))
        assert len(found) == 16 and all(len(x) == 1 for x in found.values())


def test_subtree_sorts_suffixes_and_has_their_common_prefixes():
    r = np.random.default_rng(3)
    sizes = r.integers(5, 20, 60)
    codes = r.integers(0, 3, int(sizes.sum())).astype(np.uint64)
    tree = substring_dedup.Subtree(codes, sizes, 5)
    stretch, ends = [], np.cumsum(sizes)
    for p in tree.places.tolist():
        stretch.append(tuple(codes[p : ends[np.searchsorted(ends, p, "right")]].tolist()))
    assert len(stretch) == int((sizes - 4).sum())
    assert [s[:5] for s in stretch] == sorted(s[:5] for s in stretch)
    for a, b, n in zip(stretch, stretch[1:], tree.lcp[1:].tolist()):
        assert a[:n] == b[:n] and (n == min(len(a), len(b)) or a[n] != b[n])
    assert tree.nodes(5).max() + 1 == len({s[:5] for s in stretch})


def test_substring_dedup_with_frequent_anchors(spark, monkeypatch):
    monkeypatch.setattr(substring_dedup, "CHUNK_BYTES", 500)
    monkeypatch.setattr(substring_dedup, "FREQUENT", 3)
    r = random.Random(14)
    phrase = "these seven words stand in many texts"
    rows = [(i, " ".join([*(r.choice("abcd") for _ in range(30)), phrase, *(r.choice("abcd") for _ in range(8)), phrase, "x"])) for i in range(120)]
    for window in (9, 13):
        want = removed_words(rows, window)
        got = {x.doc_id: (x.n_words, x.n_removed) for x in substring_dedup.repeated_words(spark.createDataFrame(rows, "doc_id long, text string"), window=window).collect()}
        assert got == {i: (len(w), sum(g)) for i, (w, g) in want.items()}
    assert sum(sum(g) for _, g in removed_words(rows, 9).values()) > 50


def test_substring_dedup_groups_by_longer_prefixes(spark, monkeypatch):
    monkeypatch.setattr(substring_dedup, "CHUNK_BYTES", 500)
    r = random.Random(4)
    rows = [(i, "the same start here " * 3 + " ".join(r.choice("abc") for _ in range(60))) for i in range(150)]
    want = removed_words(rows, 5)
    got = {x.doc_id: x.n_removed for x in substring_dedup.repeated_words(spark.createDataFrame(rows, "doc_id long, text string"), window=5).collect()}
    assert got == {i: sum(g) for i, (_, g) in want.items()}


def test_substring_dedup_of_odd_rows(odd_docs, no_docs):
    got = substring_dedup.remove_repeats(odd_docs, window=3, chars_col="n_chars")
    assert got.columns == odd_docs.columns
    rows = sorted(((r.doc_id, r.text, r.n_chars, r.kept) for r in got.collect()), key=repr)
    assert rows == sorted([(None, "one two three four five", 1, "k"), (None, None, 1, "k"), (5, "one two three four five", 1, "k"), (5, "one two three four five", 1, "k"), (5, "other words stand in here", 1, "k"), (9, "", 0, "k"), (2, "", 1, "k")], key=repr)
    assert substring_dedup.remove_repeats(no_docs, chars_col="n_chars").count() == 0
