import random

import numpy as np

import corpus_pipeline
from quillwing.llm import near_copies, queries, simhash
from quillwing.llm.common import connected_components

SF = "/root/testdata/sf0.01"


def shingle_set(text):
    w = (text or "").encode().translate(bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))).split()
    return {b" ".join(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {b" ".join(w)}


def kept_ids(rows):
    """By all pairs: of each component of five-word similarity of 0.8 or more the smallest id."""
    sets = [(i, shingle_set(t)) for i, t in sorted(rows)]
    label = {i: i for i, _ in sets}
    pairs = [(i, j) for k, (i, a) in enumerate(sets) for j, b in sets[:k] if 4 * max(len(a), len(b)) <= 5 * min(len(a), len(b)) and 5 * len(a & b) >= 4 * len(a | b)]
    changed = True
    while changed:
        changed = False
        for i, j in pairs:
            if label[i] != label[j]:
                label[i] = label[j] = min(label[i], label[j])
                changed = True
    return sorted({label[i] for i in label})


def edited(r, words, n):
    out = list(words)
    for k in r.sample(range(len(out)), n):
        out[k] = f"edit{r.random()}"
    return " ".join(out)


def near(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    return sorted(r.doc_id for r in dict(corpus_pipeline.STAGES)["simhash_near_dedup"](spark, df, SF).collect())


def test_stage_drops_all_texts_of_similarity_from_four_fifths(spark):
    r = random.Random(11)
    rows = []
    for k in range(60):
        base = [f"w{r.randint(0, 3000)}" for _ in range(r.randint(60, 600))]
        rows += [(10 * k, " ".join(base)), (10 * k + 1, edited(r, base, max(1, len(base) // 60))), (10 * k + 2, edited(r, base, len(base) // 20)), (10 * k + 3, edited(r, base, len(base) // 48))]
    want = kept_ids(rows)
    assert 60 < len(want) < 200
    assert near(spark, rows) == want


def test_stage_on_the_table(spark):
    docs = dict(corpus_pipeline.STAGES)["exact_dedup"](spark, queries.documents(spark, SF), SF).select("doc_id", "text")
    rows = [tuple(x) for x in docs.collect()]
    want = kept_ids(rows)
    assert len(want) < len(rows)
    assert near(spark, rows) == want


def test_crowds_and_frequent_shingles(spark, monkeypatch):
    """A crowd of near copies, boilerplate in every text, groups of few bytes."""
    monkeypatch.setattr(near_copies, "GROUP_BYTES", 5000)
    r = random.Random(4)
    notice = " ".join(f"notice{k}" for k in range(40))
    base = [f"b{r.random()}" for _ in range(200)]
    rows = [(k, edited(r, base, r.randint(1, 5)) + " " + notice) for k in range(80)]
    rows += [(100 + k, notice + " " + " ".join(f"own{r.random()}" for _ in range(r.randint(5, 60)))) for k in range(80)]
    want = kept_ids(rows)
    assert 60 < len(want) < 160
    assert near(spark, rows) == want


def test_prefixes_of_similar_sets_meet():
    r = np.random.default_rng(1)
    from fractions import Fraction

    for _ in range(200):
        whole = np.unique(r.integers(0, 1 << 40, r.integers(5, 200))).astype(np.uint64)
        often = whole[r.random(len(whole)) < 0.3]
        frequent = (often, r.integers(2, 9, len(often)).astype(np.int32))
        mixed = r.permutation(whole)
        drop = len(whole) // 10
        a, b = np.sort(mixed[drop:]), np.sort(mixed[: len(whole) - drop])
        h, doc, n, at = near_copies.prefixes(np.concatenate([a, b]), np.array([len(a), len(b)]), frequent, Fraction(4, 5))
        assert (n == np.where(doc == 0, len(a), len(b))).all()
        if 5 * len(set(a) & set(b)) >= 4 * len(set(whole)):
            assert set(h[doc == 0]) & set(h[doc == 1])


def test_frequent_shingles_are_counted_exactly(spark, monkeypatch):
    """Sums of several tasks, several sends a task and several parts; only the most frequent where there are too many."""
    monkeypatch.setattr(near_copies, "GROUP_BYTES", 2000)
    monkeypatch.setattr(near_copies, "HELD", 50)
    r = random.Random(6)
    lines = [f"l{k} l{k} l{k} l{k} l{k}" for k in range(40)]
    rows = [(k, " ".join(r.sample(lines, 1 + k % 20))) for k in range(120)] + [(200, ""), (201, None)]
    df = spark.createDataFrame(rows, "key long, text string").repartition(4)
    counts = {}
    for _, t in rows:
        for h in near_copies.shingle_sets([t], 5)[0].tolist():
            counts[h] = counts.get(h, 0) + 1
    want = {h: n for h, n in counts.items() if n > near_copies.FREQUENT}
    assert len(want) > 10
    h, n = near_copies.frequent_shingles(df, 10_000, 5)
    assert list(zip(h.tolist(), n.tolist(), strict=True)) == sorted(want.items())
    monkeypatch.setattr(near_copies, "LATE", 5)
    few = near_copies.frequent_shingles(df, 10_000, 5)[0].tolist()
    assert len(few) == 5 and few == sorted(few) and min(counts[h] for h in few) >= sorted(want.values())[-5]
    assert near_copies.frequent_shingles(df.where("false"), 0, 5)[0].tolist() == []


def test_parities_never_tell_more_than_the_difference(spark):
    r = np.random.default_rng(2)
    sets = []
    for size in (1, 30, 300, 520, 3000):
        whole = np.unique(r.integers(0, 1 << 62, size, np.int64)).astype(np.uint64)
        sets += [whole, whole[: len(whole) * 9 // 10], whole[len(whole) // 4 :]]
    sets.append(np.zeros(0, np.uint64))
    bits, many = near_copies.parities(np.concatenate(sets), np.array(list(map(len, sets))))
    found = [x.tolist() for x in np.split(bits, np.cumsum(many)[:-1])]
    assert sorted(set(many.tolist())) == [4, 8, 16, 64]
    near = [(i, j) for i, a in enumerate(sets) for j, b in enumerate(sets) if max(len(a), len(b)) * 4 <= 5 * min(len(a), len(b))]
    df = spark.createDataFrame([(i, j, found[i], found[j]) for i, j in near], "i int, j int, a array<long>, b array<long>")
    told = df.select("i", "j", near_copies.parity_difference("a", "b").alias("n")).collect()
    assert len({(many[i], many[j]) for i, j in near}) > 4
    for i, j, n in told:
        apart = len(np.setxor1d(sets[i], sets[j]))
        assert n <= apart and (n > 0) == (apart > 0)


def test_parities_rule_out_no_similar_pair(spark):
    """All pairs of a crowd around the bound: what is left of the candidates has every similar pair, and few others."""
    from fractions import Fraction

    r = np.random.default_rng(5)
    base = np.unique(r.integers(0, 1 << 62, 150, np.int64)).astype(np.uint64)
    sets = [np.unique(np.concatenate([base[r.random(len(base)) < r.choice([0.6, 0.8, 0.97])], r.integers(0, 1 << 62, 9, np.int64).astype(np.uint64)])) for _ in range(90)]
    sizes = np.array(list(map(len, sets)))
    bits, many = near_copies.parities(np.concatenate(sets), sizes)
    df = spark.createDataFrame([(k, x.tolist()) for k, x in enumerate(np.split(bits, np.cumsum(many)[:-1]))], "key long, parity array<long>")
    parity = np.array([list(x) for x in df.orderBy("key").select(*near_copies.folded("parity")).collect()])
    key, same, at = np.arange(len(sets)), np.zeros(len(sets), np.uint64), np.zeros(len(sets), np.int64)
    found = [set(zip(*(x.tolist() for x in near_copies.candidates(same, key, sizes, at, key.copy(), Fraction(4, 5), p)), strict=True)) for p in (None, parity)]
    similar = {(i, j) for i in range(len(sets)) for j in range(i + 1, len(sets)) if 9 * len(np.intersect1d(sets[i], sets[j])) >= 4 * (sizes[i] + sizes[j])}
    assert similar and similar <= found[1] < found[0] and len(found[1]) < len(found[0]) / 2


def test_shingle_sets_are_the_texts():
    texts = ["a b c d e f", "A b C d e f", "a b c d e f a b c d e", "a b", "A B", "a", "", None, "b a", "  "]
    h, sizes = near_copies.shingle_sets(texts, 5)
    sets = [tuple(x) for x in np.split(h, np.cumsum(sizes)[:-1])]
    assert sizes.tolist() == [len(shingle_set(t)) for t in texts]
    for i, a in enumerate(texts):
        for j, b in enumerate(texts):
            assert (sets[i] == sets[j]) == (shingle_set(a) == shingle_set(b))


def test_repeated_lines_alone_link_nothing(spark):
    """Lines repeated often set a text's fingerprint, not its set of shingles: texts with words of their own stay."""
    r = random.Random(8)
    line = " ".join(f"line{k}" for k in range(9))
    rows = [(k, " ".join([line] * 40 + [f"own{r.random()}" for _ in range(100)])) for k in range(20)]
    assert near(spark, rows) == list(range(20))


def test_contracted_links_join_the_same_components(spark):
    """Links among components' members, repeated ones and those inside one included, against the links as they are."""
    rng = np.random.default_rng(11)
    first, later = rng.integers(0, 120, (60, 2)).tolist(), rng.integers(0, 150, (90, 2)).tolist()
    frame = lambda rows: spark.createDataFrame(rows, "a long, b long")
    named = lambda edges: {r["node"]: r["component"] for r in connected_components(edges).collect()}
    labels = connected_components(frame(first)).withColumnRenamed("node", "key")
    edges = simhash.contracted(frame(later + later), labels)
    stars = labels.where("key <> component").selectExpr("component as a", "key as b")
    assert named(stars.unionByName(edges)) == named(frame(first + later))
    label = {r["key"]: r["component"] for r in labels.collect()}
    wanted = sorted({tuple(sorted((label.get(a, a), label.get(b, b)))) for a, b in later})
    assert sorted(map(tuple, edges.collect())) == wanted
    assert simhash.contracted(frame([]), labels).count() == 0


def test_a_crowd_of_near_copies_is_joined_by_few_pairs(spark, monkeypatch):
    """Most texts of a crowd link to each other: once the first links are known, few pairs of different components may be left."""
    pairs, verified = [], near_copies.verified

    def counted(found, *others):
        pairs.append(found.where("a <> b").distinct().count())
        return verified(found, *others)

    monkeypatch.setattr(near_copies, "verified", counted)
    r = random.Random(12)
    base = [f"b{r.random()}" for _ in range(150)]
    rows = [(k, edited(r, base, r.randint(1, 4))) for k in range(300)]
    want = kept_ids(rows)
    assert len(want) < 100
    assert near(spark, rows) == want
    assert len(pairs) == 2 and pairs[1] < 5 * len(rows)


def test_a_forest_joins_what_all_pairs_join_at_each_weight(monkeypatch):
    """Of all pairs at or under any weight and of the forest's, the components are the same; with sums taken often, too."""
    from fractions import Fraction

    r = np.random.default_rng(7)
    pairs, weight = r.integers(0, 80, (600, 2)), r.integers(0, 12, 600) / 3
    some, w = near_copies.spanning_forest(pairs, weight)
    assert len(some) < 80
    parts = lambda p: simhash.joined(np.arange(80), p[:, 0], p[:, 1]).tolist()
    for bound in np.unique(weight):
        assert parts(some[w <= bound]) == parts(pairs[weight <= bound])
    assert near_copies.spanning_forest(pairs[:0], weight[:0])[0].shape == (0, 2)

    key, shingle = np.tile(np.arange(60), 4), np.repeat(np.arange(4, dtype=np.uint64), 60)
    use = r.random(240) < 0.4
    key, shingle, parity = key[use], shingle[use], r.integers(0, 1 << 5, (60, 4))[key[use]]
    size, place = np.full(len(key), 100), np.zeros(len(key), np.int64)
    every = near_copies.candidates(shingle, key, size, place, key.copy(), Fraction(4, 5), parity)
    for held in (1 << 20, 3):
        monkeypatch.setattr(near_copies, "PAIRS_HELD", held)
        few = near_copies.candidates(shingle, key, size, place, None, Fraction(4, 5), parity)
        assert len(few[0]) < 60 and len(few[0]) < len(every[0]) / 4
        assert parts(np.stack(few, axis=1)) == parts(np.stack(every, axis=1))
