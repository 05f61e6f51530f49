import random
import time
import zlib

import numpy as np
import pytest

from quillwing.llm import binary_output, common, packing, sentencepiece_stream, token_counts
from quillwing.llm.binary_output import PerfectHash
from quillwing.llm.pieces import ChunkedEncoder
from quillwing.llm.queries import tokenizer_path

MODEL = tokenizer_path("piece_bpe_32k.model")
HARD = ["", "a  b \n\n c ", " lead", "x<|endoftext|> y", "a\xa0 b", "tab\tq\r\n  z\x0b1", "don't  can't'll 'x", "İstanbul ΑΣ Σ", "é x ́y", "\x1c a\x1c b", "a​ b ​ c", "  　 k", "日本語 テスト 😀", "  ", "\n", "</s><s> <unk>▁x ▁", "a" * 3000, " " * 500, "ab" * 300, "\x00 z"]


def noise(seed, n):
    r = random.Random(seed)
    return ["".join(r.choice("abcdeinors  é▁\n-=.\t") for _ in range(r.randint(1, 200))) for _ in range(n)]


@pytest.mark.parametrize(("name", "lead"), [("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)])
def test_chunked_encoding_is_the_librarys(name, lead, docs_rows, monkeypatch):
    from quillwing.llm import pieces

    monkeypatch.setattr(pieces, "CACHE_CHUNKS", 500)
    encoder = ChunkedEncoder(tokenizer_path(name), lead)
    for texts in (HARD, [t for _, t in docs_rows], noise(1, 300), HARD + noise(1, 300)):
        ids, counts = encoder.encode(texts)
        want = [e.ids for e in encoder.tokenizer.encode_batch_fast([t or "" for t in texts], add_special_tokens=False)]
        known = len(encoder.codes)
        assert counts.tolist() == [len(x) for x in want]
        assert ids.tolist() == [i for x in want for i in x]
        assert len(encoder.codes) == known
    encoder.encode(["x"])
    assert len(encoder.codes) == 1  # with more than it may keep, it starts over


def test_token_counts_are_the_librarys(spark, docs, docs_rows, no_docs):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    merger = token_counts.RankMerger.of(MODEL)
    for texts in (HARD, noise(2, 500), noise(3, 500)):
        assert merger.count(texts).tolist() == [len(library.encode(t)) for t in texts]
    for text in (" " * 200_000, "=-" * 100_000, "a" * 200_000, "".join(random.Random(6).choices("etaoinshr", k=100_000))):
        began = time.process_time()
        assert merger.count([text, "a  b"]).tolist() == [len(library.encode(text)), len(library.encode("a  b"))]
        assert time.process_time() - began < 10
    got = {r.doc_id: r for r in token_counts.token_counts(docs, MODEL, limit=50).collect()}
    for i, t in docs_rows:
        n = len(library.encode(t or ""))
        assert got[i][1:] == (len((t or "").encode()), n, n > 50)
    assert token_counts.token_counts(no_docs, MODEL).count() == 0


def viterbi(model, text):
    """The best sum of scores of a whole text, without a window."""
    best = [0.0]
    for end in range(1, len(text) + 1):
        options = [best[end - 1] + model.unknown_score]
        for begin in range(max(0, end - model.longest), end):
            if text[begin:end] in model.ids:
                options.append(best[begin] + model.ids[text[begin:end]][1])
        best.append(max(options))
    return best[-1]


def test_streaming_viterbi_is_optimal_and_bounded():
    model = sentencepiece_stream.PieceModel.of(MODEL)
    r = random.Random(3)
    for text in ["etaoin" * 300, "".join(r.choice("etaoinshrdlu") for _ in range(3000)), "the quick brown", "日本語xyz"]:
        stream = sentencepiece_stream.StreamingViterbi(model)
        ids, at = [], 0
        while at < len(text):
            step = r.randint(1, 50)
            ids += stream.feed(text[at : at + step])
            at += step
        committed = len(ids)
        ids += stream.finish()
        scores = {i: s for i, s in model.ids.values()}
        if all(i in scores for i in ids):
            assert sum(scores[i] for i in ids) == pytest.approx(viterbi(model, text))
        assert model.decode(ids) == text
        assert stream.widest < 12 * model.longest
        assert committed > 0 or len(text) < 40


def test_streaming_viterbi_against_the_library_as_a_unigram_model(docs_rows):
    """The library reads the same pieces as a unigram model once the model's type is 1; its sums are 32-bit, so it may fall short of the best."""
    import sentencepiece

    raw = sentencepiece.SentencePieceProcessor(model_file=MODEL).serialized_model_proto()
    assert raw.count(b"\x18\x02 \x80\xfa\x01") == 1
    library = sentencepiece.SentencePieceProcessor(model_proto=raw.replace(b"\x18\x02 \x80\xfa\x01", b"\x18\x01 \x80\xfa\x01"))
    model = sentencepiece_stream.PieceModel.of(MODEL)
    words = list(dict.fromkeys(w for _, t in docs_rows for w in (t or "").split() if w.isascii() and w.isalpha()))
    assert len(words) > 300
    scores = {i: s for i, s in model.ids.values()}
    same = 0
    for w in words:
        ours, theirs = model.encode(w), library.encode(w)
        same += ours == theirs
        assert sum(scores[i] for i in ours) >= sum(scores[i] for i in theirs)
    assert same > 0.97 * len(words)


def test_sentencepiece_round_trip(docs, docs_rows, no_docs):
    ids = sentencepiece_stream.encode_texts(docs, MODEL)
    back = {r.doc_id: r.text for r in sentencepiece_stream.decode_ids(ids, MODEL).collect()}
    assert back == {i: t or "" for i, t in docs_rows}
    got = sentencepiece_stream.encode_digest(docs, MODEL).collect()
    assert len(got) == len(docs_rows) and all(r.round_trip for r in got)
    assert sentencepiece_stream.encode_digest(no_docs, MODEL).count() == 0


def test_ids_are_the_librarys(docs, docs_rows):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    model = sentencepiece_stream.MergeModel.of(MODEL)
    for text in HARD + noise(5, 300):
        assert model.encode(text) == library.encode(text), text
    got = {r.doc_id: r.ids for r in sentencepiece_stream.encode_texts(docs, MODEL).collect()}
    assert got == {i: library.encode(t or "") for i, t in docs_rows}
    stream = sentencepiece_stream.StreamingMerges(model)
    text = "▁" + "etaoinshrdlu" * 300
    ids = [i for k in range(0, len(text), 7) for i in stream.feed(text[k : k + 7])]
    assert ids + stream.finish() == library.encode(text[1:]) and stream.widest < 12 * model.longest


def test_karmarkar_karp_balances():
    r = random.Random(1)
    for ways in (1, 2, 5, 12):
        sizes = [r.randint(1, 256) for _ in range(90)]
        sets = packing.karmarkar_karp(sizes, ways)
        assert sorted(i for s in sets for i in s) == list(range(90)) and len(sets) == ways
        sums = [sum(sizes[i] for i in s) for s in sets]
        assert max(sums) - min(sums) <= 24
    assert packing.karmarkar_karp([], 3) == []
    assert sorted(map(tuple, packing.karmarkar_karp([5], 3))) == [(0,)]


def test_window_count_rises_until_all_fit():
    sets = packing.windows_for([600, 600, 600], 1024)
    assert len(sets) == 3
    sets = packing.windows_for([512, 512, 512, 512], 1024)
    assert len(sets) == 2


def check_packing(rows, ids_of, capacity):
    pieces, windows = {}, {}
    for r in rows:
        ids = ids_of[r.doc_id]
        assert r.doc_tokens == len(ids)
        assert r.ids_crc32 == zlib.crc32(ids[r.start : r.start + r.length].astype("<u4").tobytes())
        pieces.setdefault(r.doc_id, []).append((r.start, r.length))
        windows.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for spans, total in [*((s, len(ids_of[d])) for d, s in pieces.items()), *((s, None) for s in windows.values())]:
        at = 0
        for start, length in sorted(spans):
            assert start == at and length > 0
            at += length
        assert at == total if total is not None else at <= capacity
    assert set(pieces) == set(ids_of)
    return sum(capacity - sum(x for _, x in w) for w in windows.values() if sum(x for _, x in w).bit_count() > 1)


def test_packing_covers_every_id_once(docs, docs_rows, no_docs):
    path = tokenizer_path("byte_bpe_50k.json")
    tokenizer = ChunkedEncoder.of(path, True).tokenizer
    ids = {i: np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 0], np.uint32) for i, t in docs_rows}
    for capacity in (1024, 64):
        rows = packing.pack(docs, path, capacity=capacity).collect()
        padding = check_packing(rows, ids, capacity)
        assert padding < 3 * 2 * capacity  # three partitions
    assert packing.pack(no_docs, path).count() == 0


def test_packing_of_odd_rows(odd_docs):
    rows = packing.pack(odd_docs, tokenizer_path("byte_bpe_50k.json")).collect()
    assert len(rows) == odd_docs.count()
    assert sum(r.doc_id is None for r in rows) == 2


def test_perfect_hash_is_minimal_and_tells_strangers():
    r = np.random.default_rng(1)
    keys = np.unique(r.integers(-(2**62), 2**62, 20_000))
    h = PerfectHash.build(keys)
    assert sorted(h.lookup(keys).tolist()) == list(range(len(keys)))
    strangers = np.setdiff1d(r.integers(-(2**62), 2**62, 20_000), keys)
    assert (h.lookup(strangers) >= 0).sum() <= 2
    assert sum(len(b) for b in h.bits) < 5 * len(keys)
    assert PerfectHash.build(np.zeros(0, np.int64)).lookup(np.array([1])).tolist() == [-1]


def test_token_files_round_trip(spark, docs, docs_rows, no_docs):
    path, name = common.scratch_path(spark, "test-files"), tokenizer_path("word_bpe_49k.json")
    binary_output.write_token_files(docs, path, name, end_id=2, shard_bytes=4000)
    tokenizer = ChunkedEncoder.of(name, False).tokenizer
    got, start = {r.doc_id: r for r in binary_output.read_token_files(spark, path).collect()}, 0
    assert len(binary_output.read_manifest(path)["shards"]) > 2
    for i, t in sorted(docs_rows):
        ids = np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        assert got[i][1:] == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    shard = binary_output.open_shard(path, binary_output.read_manifest(path)["shards"][0]["name"])
    first = min(i for i, _ in docs_rows)
    assert shard.get(first)[0][-1] == 2 and shard.get(10**12) == []
    files = binary_output.TokenFiles(path, kept=2)
    assert len(files.shards) > 2
    for i, t in docs_rows:
        assert [x.tolist() for x in files.get(i)] == [[*tokenizer.encode(t or "", add_special_tokens=False).ids, 2]]
    assert files.get(7) == files.get(-10**9) == files.get(10**12) == [] and len(files.opened) == 2
    with pytest.raises(ValueError, match="magic"):
        binary_output.unpack_arrays(b"other bytes")
    empty = common.scratch_path(spark, "test-files")
    binary_output.write_token_files(no_docs, empty, name, end_id=2)
    assert binary_output.read_token_files(spark, empty).count() == 0


def test_token_files_of_odd_rows(spark, odd_docs):
    path = common.scratch_path(spark, "test-files")
    binary_output.write_token_files(odd_docs, path, tokenizer_path("word_bpe_49k.json"), end_id=2)
    rows = binary_output.read_token_files(spark, path).collect()
    assert sorted(r.start for r in rows)[0] == 0 and len({r.start for r in rows}) == len(rows) == odd_docs.count()
    shard = binary_output.open_shard(path, binary_output.read_manifest(path)["shards"][0]["name"])
    assert len(shard.get(5)) == 3 and len(shard.get(9)) == 1
    files = binary_output.TokenFiles(path)
    assert [len(files.get(k)) for k in (5, 9, 2, 3)] == [3, 1, 1, 0]
    assert [x.tolist() for x in files.get(5)] == [x.tolist() for x in shard.get(5)]


def test_counts_and_ids_of_odd_rows(odd_docs):
    """Null ids and repeated rows have rows of their own; null texts have no ids."""
    rows = [(r.doc_id, r.text) for r in odd_docs.collect()]
    got = token_counts.token_counts(odd_docs, MODEL).collect()
    assert sorted(((r.doc_id, r.n_bytes) for r in got), key=repr) == sorted(((i, len((t or "").encode())) for i, t in rows), key=repr)
    ids = sentencepiece_stream.encode_texts(odd_docs, MODEL)
    back = sorted(((r.doc_id, r.text) for r in sentencepiece_stream.decode_ids(ids, MODEL).collect()), key=repr)
    assert back == sorted(((i, t or "") for i, t in rows), key=repr)
    assert sentencepiece_stream.encode_digest(odd_docs, MODEL).count() == len(rows)
