import hashlib
import random
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from quillwing.llm import chat, fingerprints, langid
from quillwing.llm.queries import documents

SF = "/root/testdata/sf0.001"


def jaccard(a, b):
    a, b = Counter((a or "").lower().split()), Counter((b or "").lower().split())
    keys = set(a) | set(b)
    return sum(min(a[k], b[k]) for k in keys) / max(1, sum(max(a[k], b[k]) for k in keys))


def ascii_words(t):
    return " ".join(w.decode() for w in (t or "").encode().split())


def test_gamma_tables_follow_the_distribution():
    r, ln_c = fingerprints.gamma_tables()
    assert sum(r) / len(r) == pytest.approx(2, rel=0.02)
    assert sorted(r) == r
    assert all(a < b for a, b in zip(ln_c[:63], ln_c[1:64])) and ln_c[64 + 63] < ln_c[0] and ln_c[128 + 63] < ln_c[64]


def test_collision_rate_is_generalised_jaccard(spark):
    r = random.Random(1)
    vocabulary = [f"w{k}" for k in range(60)]
    rows = [(k, " ".join(r.choices(vocabulary, weights=range(1, 61), k=r.randint(5, 200)))) for k in range(60)]
    got = {x.doc_id: x["values"] for x in fingerprints.fingerprint(spark.createDataFrame(rows, "doc_id long, text string"), samples=32).collect()}
    error = []
    for i, a in rows:
        for j, b in rows[i + 1 :]:
            error.append(sum(x == y for x, y in zip(got[i], got[j], strict=True)) / 32 - jaccard(a, b))
    assert abs(sum(error) / len(error)) < 0.02
    assert (sum(e * e for e in error) / len(error)) ** 0.5 < 0.1


def test_edited_fingerprints_against_brute_force(docs, docs_rows, monkeypatch):
    monkeypatch.setattr(fingerprints, "BUCKET_BYTES", 3000)
    got = {r.doc_id: r for r in fingerprints.edited_fingerprints(docs).collect()}
    order = sorted(docs_rows, reverse=True)
    assert len(got) == len(order)
    seen, errors = {}, []
    for k, (i, t) in enumerate(order):
        t, after = t or "", order[(k + 1) % len(order)][1] or ""
        half = len(t) // 2
        edited = t[: len(t) - half] + after[:half]
        assert (got[i].n_chars, got[i].edited_sha256) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        assert seen.setdefault(t, got[i].fingerprint) == got[i].fingerprint
        assert 0 <= got[i].near_edited <= 1 and 0 <= got[i].near_next <= 1
        errors += [got[i].near_edited - jaccard(t, edited)] if ascii_words(t) else []
    assert abs(sum(errors) / len(errors)) < 0.05


def test_fingerprints_of_odd_rows(odd_docs, no_docs, spark):
    rows = fingerprints.edited_fingerprints(odd_docs).collect()
    assert len(rows) == odd_docs.count() and sum(r.doc_id is None for r in rows) == 2
    assert fingerprints.edited_fingerprints(no_docs).count() == 0
    alone = fingerprints.edited_fingerprints(spark.createDataFrame([(4, "abcd")], "doc_id long, text string")).collect()
    assert alone[0].edited_sha256 == hashlib.sha256(b"abab").hexdigest() and alone[0].near_next == 1


def tree(edges):
    return [(1, n, p, "user" if k % 2 == 0 else "assistant", f"text {n}", float(s)) for k, (n, p, s) in enumerate(edges)]


def test_best_branches_of_reply_trees(spark):
    r = random.Random(2)
    rows, want = [], {}
    for t in range(6):
        parent, score = {0: None}, {0: r.random()}
        for n in range(1, 40):
            parent[n], score[n] = r.randint(max(0, n - 4), n - 1), r.choice([0.5, 1.0, -1.0])
        rows += [(t, n, parent[n], "user", f"t{t} n{n}", score[n]) for n in parent]
        paths = []
        for leaf in set(parent) - set(parent.values()):
            path = [leaf]
            while parent[path[-1]] is not None:
                path.append(parent[path[-1]])
            paths.append((-sum(score[n] for n in path), leaf, path[::-1]))
        paths.sort(key=lambda p: (round(p[0], 9), p[1]))
        want |= {(t, k + 1): p[2] for k, p in enumerate(paths[:3])}
    nodes = spark.createDataFrame(rows, "tree long, node long, parent long, role string, text string, score double").withColumn("score", F.round("score", 3))
    got = {}
    for x in chat.reply_paths(nodes, branches=3).collect():
        got.setdefault((x.tree, x.branch), {})[x.place] = x.node
    got = {k: [v[p] for p in range(len(v))] for k, v in got.items()}
    assert {k: len(v) for k, v in got.items()}.keys() == want.keys()
    flat = {(t, n): round(s, 3) for t, n, _, _, _, s in rows}
    for k, path in want.items():
        assert sum(flat[k[0], n] for n in got[k]) == pytest.approx(sum(flat[k[0], n] for n in path), abs=2e-3)
    assert sum(got[k] == want[k] for k in want) > len(want) // 2  # branches of equal score may differ by rounding


def test_orphans_are_roots_and_cycles_are_left_out(spark):
    rows = tree([(1, None, 1), (2, 1, 1), (3, 99, 5), (4, 5, 9), (5, 4, 9), (6, 5, 9)])
    nodes = spark.createDataFrame(rows, "tree long, node long, parent long, role string, text string, score double")
    got = {(x.branch, x.place, x.node) for x in chat.reply_paths(nodes, branches=9).collect()}
    assert got == {(1, 0, 3), (2, 0, 1), (2, 1, 2)}


def test_escape_is_reversible(spark):
    r = random.Random(3)
    parts = [*chat.CONTROL, "\\", "\\\\", "\n", "a", "<", "|", ">", " ", chat.END[:4], chat.END[4:]]
    texts = ["".join(r.choice(parts) for _ in range(r.randint(0, 12))) for _ in range(2000)]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", chat.escape(F.col("t")).alias("e"))
    rows = df.select("t", "e", chat.unescape(F.col("e")).alias("u")).collect()
    assert all(x.t == x.u for x in rows)
    assert not any(x.e.replace("\\" + c, "").count(c) for x in rows for c in chat.CONTROL[:3] if "\\" not in x.t and c in x.t)


def test_conversations_read_back(spark):
    hostile = [f"\n{chat.END}\n", f"{chat.TURN}user", "a\\", f"\\{chat.TEXT}", "</s>[INST] x", "", None, f"\n{chat.TEXT}\n", "😀 é"]
    rows = [(c, t, role, hostile[(c + t) % len(hostile)]) for c in range(9) for t, role in enumerate(["system", "user", "assistant", None, "Assistant", f"odd\n{chat.TEXT}\nrole"])]
    rows += [(None, 1, "user", "no id"), (None, None, "assistant", "first"), (3, 1, "user", "again")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("tree", F.lit("x")).withColumn("node", F.lit(1))
    want = {}
    for c, t, role, text in sorted(rows, key=lambda x: (str(x[0]), -1 if x[1] is None else x[1], x[2] or "", x[3] or "")):
        want.setdefault(c, []).append((role or "", text or ""))
    found = chat.format_conversations(df)
    got = found.select("conv_id", chat.read_turns(F.col("formatted")).alias("turns"), chat.read_loss(F.col("formatted"), F.col("loss")).alias("loss"), "formatted").collect()
    assert len(got) == len(want)
    for x in got:
        assert [tuple(t) for t in x.turns] == want[x.conv_id]
        assert x.loss == "".join(t for r, t in want[x.conv_id] if r.lower() == "assistant")
    assert chat.format_conversations(spark.createDataFrame([], df.schema)).count() == 0


def test_long_conversation(spark):
    rows = [(1, k, "user" if k % 2 == 0 else "assistant", f"turn {k}") for k in range(300)]
    got = chat.format_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    assert len(got) == 1 and got[0].formatted.count(chat.TURN) == 300 and len(got[0].loss) == 150


def test_language_id_on_held_out_documents(spark):
    docs = documents(spark, SF.replace("0.001", "0.01"))
    net = langid.train(docs)
    rows = docs.select("doc_id", "lang").join(langid.predict(docs, net), "doc_id").select("*", langid.held_out("doc_id").alias("held")).collect()
    held = [r for r in rows if r.held]
    assert all(r.held == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    assert sum(r.lang == r.lang_pred for r in held) / len(held) > 0.95
    assert all(0 <= r.score <= 1 for r in rows)


def test_language_id_of_odd_rows(spark, docs, docs_rows, no_docs):
    net = langid.train(docs)
    assert net.classes == ["en", "fr"]
    got = {r.doc_id: r for r in langid.predict(docs, net).collect()}
    assert len(got) == len(docs_rows)
    for i, t in docs_rows:
        assert (got[i].lang_pred == "und") == (not any(ch.isalpha() for ch in t or ""))
    kept = langid.keep_identified(docs, net)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(i for i, t in docs_rows if any(ch.isalpha() for ch in t or ""))
    assert langid.train(no_docs) is None
    assert langid.predict(no_docs, None).count() == langid.keep_identified(no_docs, None).count() == 0
    assert {r.lang_pred for r in langid.predict(docs, None).collect()} == {"und"}


def test_network_gradient():
    """Training separates two alphabets, and a cut window still tells them."""
    import numpy as np

    r = random.Random(4)
    texts = ["".join(r.choice("abc " if k % 2 else "xyz ") for _ in range(300)) for k in range(80)]
    x = np.stack([langid.byte_windows([t])[0][0] for t in texts])
    net = langid.ByteConvNet(["x", "a"])
    net.fit(x, np.arange(80) % 2, epochs=8)
    assert (net.probabilities(x).argmax(1) == np.arange(80) % 2).mean() > 0.97
    short, _ = langid.byte_windows(["abcabcab abcab"])
    assert net.probabilities(short).argmax() == 1


def test_every_language_is_learned_from_a_bounded_sample(spark):
    """Many languages, one id that many rows repeat, null ids."""
    rows = [(k, f"{chr(0x4E00 + k % 300)} " * 20, f"l{k % 300:03}") for k in range(900)] + [(1, f"words {k} " * 5, "l001") for k in range(600)] + [(None, "x y", "never")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    taken = []

    class Spy(langid.ByteConvNet):
        def fit(self, x, y, **settings):
            taken.append(len(x))

    original, langid.ByteConvNet = langid.ByteConvNet, Spy
    try:
        net = langid.train(df, max_docs=30, least_docs=2)
    finally:
        langid.ByteConvNet = original
    assert net.classes == sorted({lang for i, _, lang in rows if i is not None and zlib.crc32(str(i).encode()) % 5})
    assert len(net.classes) > 290
    assert taken[0] <= 300 * 2 * 2


def test_prediction_of_odd_rows(spark, docs, odd_docs):
    net = langid.train(docs)
    got = langid.predict(odd_docs, net).collect()
    assert len(got) == odd_docs.count() and sum(r.doc_id is None for r in got) == 2
    assert all(r.score == 0 for r in got if r.lang_pred == "und")
