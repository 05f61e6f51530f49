"""Encoding and decoding with a SentencePiece vocabulary by a streaming Viterbi search."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SPACE = "▁"
UNKNOWN_PENALTY = 10.0
#: Distinct words whose ids one Python worker keeps.
CACHE_WORDS = 1_200_000
WORD = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")

_models: dict = {}


class PieceModel:
    """Pieces and scores of a model file; the path with the greatest sum of scores is a text's encoding."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        size = model.get_piece_size()
        self.pieces = [model.id_to_piece(i) for i in range(size)]
        byte = [i for i in range(size) if model.is_byte(i)]
        self.byte = {int(self.pieces[i][3:5], 16): i for i in byte}
        special = {i for i in range(size) if model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i)}
        self.ids = {p: (i, model.get_score(i)) for i, p in enumerate(self.pieces) if i not in special}
        self.longest = max(map(len, self.ids))
        #: Every beginning of a piece: where a stretch isn't one, no longer piece starts there.
        self.beginnings = {p[:k] for p in self.ids for k in range(1, len(p) + 1)}
        self.unknown_score = min(s for _, s in self.ids.values()) - UNKNOWN_PENALTY
        self.unknown_id = model.unk_id()
        self.raw = [bytes([int(p[3:5], 16)]) if i in set(byte) else b"" if i in special else p.replace(SPACE, " ").encode() for i, p in enumerate(self.pieces)]
        #: Every word mark starts a piece, so all paths meet there.
        self.words_apart = not any(re.search(f"[^{SPACE}]{SPACE}", p) for p in self.ids)
        self.known: dict[str, tuple[int, ...]] = {}

    @staticmethod
    def of(path: str) -> PieceModel:
        if path not in _models:
            _models[path] = PieceModel(path)
        return _models[path]

    def _stream(self) -> StreamingViterbi:
        return StreamingViterbi(self)

    def _unknown(self, char: str) -> list[int]:
        return [self.byte[b] for b in char.encode("utf-8", "surrogatepass")] if len(self.byte) == 256 else [self.unknown_id]

    def encode(self, text: str) -> list[int]:
        """Ids of a whole text: a space mark is put before it, and for each space. An empty text has none."""
        if not text:
            return []
        marked = SPACE + text.replace(" ", SPACE)
        out: list[int] = []
        for word in WORD.findall(marked) if self.words_apart else [marked]:
            ids = self.known.get(word)
            if ids is None:
                stream = self._stream()
                ids = (*stream.feed(word), *stream.finish())
                if len(self.known) < CACHE_WORDS and self.words_apart:
                    self.known[word] = ids
            out += ids
        return out

    def decode(self, ids: list[int]) -> str:
        """Text of ids; the space put before the text goes, bytes that are no UTF-8 become U+FFFD."""
        data = b"".join(map(self.raw.__getitem__, ids))
        return (data[1:] if data[:1] == b" " else data).decode("utf-8", "replace")


class StreamingViterbi:
    """Viterbi over characters that arrive bit by bit.

    It keeps the characters since the last commitment. A boundary's pieces are
    tried once the longest of them has arrived, so new pieces start only at the
    boundaries from ``next`` on, at most ``longest`` of them, and only the paths that end there
    survive. Once they all pass one boundary, the ids up to it are committed
    and the window before it is dropped.
    """

    def __init__(self, model: PieceModel):
        self.model = model
        self.text, self.next = "", 0
        self.score, self.back = [0.0], [0]  # by boundary; back: where its best piece starts
        self.widest = 0

    def feed(self, chars: str) -> list[int]:
        out: list[int] = []
        longest = self.model.longest
        for i in range(0, len(chars), longest):
            self._take(chars[i : i + longest])
            self._relax(len(self.text) - longest + 1)
            self.widest = max(self.widest, len(self.text))
            if self.next:
                out += self._commit(self._meeting())
        return out

    def _take(self, chars: str) -> None:
        self.text += chars
        self.score += [-math.inf] * len(chars)
        self.back += [0] * len(chars)

    def _relax(self, end: int) -> None:
        """Try all pieces that start before ``end``."""
        text, score, back, ids, beginnings = self.text, self.score, self.back, self.model.ids, self.model.beginnings
        n, unknown, longest = len(text), self.model.unknown_score, self.model.longest
        for begin in range(self.next, end):
            base = score[begin]
            if base + unknown > score[begin + 1]:
                score[begin + 1], back[begin + 1] = base + unknown, begin
            for stop in range(begin + 1, min(n, begin + longest) + 1):
                piece = text[begin:stop]
                found = ids.get(piece)
                if found is not None:
                    if base + found[1] > score[stop]:
                        score[stop], back[stop] = base + found[1], begin
                elif piece not in beginnings:
                    break
        self.next = max(self.next, end)

    def _meeting(self) -> int:
        """The last boundary that every surviving path passes."""
        alive = {b for b in range(self.next, len(self.text) + 1) if b == self.next or self.score[b] > -math.inf}
        while len(alive) > 1:
            last = max(alive)
            alive.remove(last)
            alive.add(self.back[last])
        return alive.pop()

    def _commit(self, end: int) -> list[int]:
        cuts = [end]
        while cuts[-1]:
            cuts.append(self.back[cuts[-1]])
        cuts.reverse()
        out: list[int] = []
        for a, b in zip(cuts, cuts[1:]):
            piece = self.model.ids.get(self.text[a:b])
            out += [piece[0]] if piece else self.model._unknown(self.text[a:b])
        self.text, base = self.text[end:], self.score[end]
        self.score = [s - base for s in self.score[end:]]
        self.back = [max(0, b - end) for b in self.back[end:]]
        self.next = max(0, self.next - end)
        return out

    def finish(self) -> list[int]:
        self._relax(len(self.text))
        return self._commit(len(self.text))


class MergeModel(PieceModel):
    """A BPE model file read as such: the ids are those that its merges leave."""

    def __init__(self, path: str):
        super().__init__(path)
        self.steps: dict[str, tuple[bool, list[tuple[float, str, str]]]] = {}
        #: By left id * size + id of the piece after it: whether merging keeps the two apart.
        self.apart: dict[int, bool] = {}
        self.size = len(self.pieces)
        #: Finds the pieces that end at each character, the longest first; pieces that merging alone doesn't make are in no encoding.
        self.finder = ahocorasick.Automaton()
        for p, (i, _) in self.ids.items():
            if self.merges(p)[0]:
                self.finder.add_word(p, (len(p), i))
        self.finder.make_automaton()
        self.steps.clear()

    @staticmethod
    def of(path: str) -> PieceModel:
        """The file's model, by the type it names."""
        if ("merges", path) not in _models:
            _models["merges", path] = MergeModel(path) if _is_bpe(path) else PieceModel.of(path)
        return _models["merges", path]

    def _stream(self) -> StreamingViterbi:
        return StreamingMerges(self)

    def merges(self, text: str) -> tuple[bool, list[tuple[float, str, str]]]:
        """Whether merging a short text leaves it whole, and its merges: score, first and last symbol after it.

        The best score goes first, the leftmost of equals.
        """
        known = self.steps.get(text)
        if known is None:
            parts, ids, steps = list(text), self.ids, []
            while len(parts) > 1:
                best, at = -math.inf, -1
                for i in range(len(parts) - 1):
                    found = ids.get(parts[i] + parts[i + 1])
                    if found is not None and found[1] > best:
                        best, at = found[1], i
                if at < 0:
                    break
                parts[at : at + 2] = [parts[at] + parts[at + 1]]
                steps.append((best, parts[0], parts[-1]))
            known = self.steps[text] = len(parts) == 1, steps
        return known

    def follows(self, left: int, right: int) -> bool:
        """Whether merging keeps the two pieces apart.

        Until a merge crosses the boundary, both sides merge as they do alone.
        So their merges are played in turn, the better score first, and the two
        symbols at the boundary are held against the next of each.
        """
        if len(self.apart) >= CACHE_WORDS:
            self.apart.clear()
        found = self.apart[left * self.size + right] = self._follows(self.pieces[left], self.pieces[right])
        return found

    def _follows(self, left: str, right: str) -> bool:
        ids, nothing = self.ids, (-math.inf, "", "")
        before, after = self.merges(left)[1], self.merges(right)[1]
        last, first, i, j = left[-1], right[0], 0, 0
        while True:
            one = before[i] if i < len(before) else nothing
            two = after[j] if j < len(after) else nothing
            across = ids.get(last + first)
            if across is not None and across[1] > one[0] and across[1] >= two[0]:
                return False
            if one is nothing and two is nothing:
                return True
            if one[0] >= two[0]:
                last, i = one[2], i + 1
            else:
                first, j = two[1], j + 1


class StreamingMerges(StreamingViterbi):
    """The same search, where a piece may follow another only if merging keeps the two apart.

    Of all paths to a boundary just one is left, the merges of the text up to
    it; its score is 0. So a boundary looks back over the pieces that end there,
    the longest first, until one may follow the path to where it starts.
    """

    def __init__(self, model: MergeModel):
        super().__init__(model)
        #: By boundary the id of the piece that ends there: -1 for an unknown character, -2 before the text.
        self.last, self.done = [-2], 0

    def _take(self, chars: str) -> None:
        self.text += chars
        self.score += [0.0] * len(chars)
        self.back += range(len(self.back) - 1, len(self.back) + len(chars) - 1)
        self.last += [-1] * len(chars)

    def _relax(self, end: int) -> None:
        back, last, apart, size = self.back, self.last, self.model.apart, self.model.size
        offset = max(0, self.done - self.model.longest)
        settled = self.done
        for at, (length, piece) in self.model.finder.iter(self.text[offset:] if offset else self.text):
            stop = at + offset + 1
            begin = stop - length
            if stop <= settled or begin < 0:
                continue
            if length > 1:  # the last one left needs no test: some piece ends there
                left = last[begin]
                if left >= 0:
                    fits = apart.get(left * size + piece)
                    if fits is None:
                        fits = self.model.follows(left, piece)
                    if not fits:
                        continue
            back[stop], last[stop], settled = begin, piece, stop
        self.done = len(self.text)
        self.next = max(self.next, end)

    def _commit(self, end: int) -> list[int]:
        out, at, text, back, last = [], end, self.text, self.back, self.last
        while at:
            if last[at] >= 0:
                out.append(last[at])
            else:
                out += reversed(self.model._unknown(text[back[at] : at]))
            at = back[at]
        out.reverse()
        self.text, self.score, self.last = text[end:], self.score[end:], last[end:]
        self.back = [max(0, b - end) for b in back[end:]]
        self.next, self.done = max(0, self.next - end), self.done - end
        return out


def _is_bpe(path: str) -> bool:
    """Whether the file's trainer settings (field 2) name BPE (2) as the model type (field 3)."""

    def fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
        at = 0

        def number() -> int:
            nonlocal at
            value = shift = 0
            while True:
                byte = data[at]
                at += 1
                value |= (byte & 127) << shift
                shift += 7
                if byte < 128:
                    return value

        while at < len(data):
            tag = number()
            if tag & 7 == 0:
                yield tag >> 3, number()
            else:
                size = {1: 8, 5: 4}.get(tag & 7) or number()
                yield tag >> 3, data[at : at + size]
                at += size

    with open(path, "rb") as f:
        return any(k == 3 and v == 2 for key, value in fields(f.read()) if key == 2 for k, v in fields(value))


OUT = "doc_id long, n_chars long, n_ids long, ids_crc32 long, decoded_sha256 string, round_trip boolean"


def encode_texts(df: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Columns doc_id, ids (array of int): the whole text's ids. Null and empty texts have no ids; nothing is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = MergeModel.of(model_path)
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                b = whole.slice(at, 256)
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array([model.encode(x or "") for x in b.column(1).to_pylist()], pa.list_(pa.int32()))], ["doc_id", "ids"])

    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "doc_id long, ids array<int>")


def decode_ids(df: DataFrame, model_path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """Columns doc_id, text: what the ids stand for. Null ids count as none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = PieceModel.of(model_path)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([model.decode(x or []) for x in b.column(1).to_pylist()], pa.string())], ["doc_id", "text"])

    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(ids_col).cast("array<int>").alias("ids")).mapInArrow(run, "doc_id long, text string")


def encode_digest(df: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row an input row: doc_id, n_chars, n_ids, ids_crc32 (little-endian uint32), and the decoded ids' SHA-256 against the text's.

    Null and empty texts have no ids; null ids and repeated rows have a row each; whole texts of any length are encoded; other columns are ignored.

    A text that holds the space mark itself, or a leading space that the model merges away, doesn't round-trip; ``round_trip`` says so.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("n_ids", pa.int64()), ("ids_crc32", pa.int64()), ("decoded_sha256", pa.string()), ("round_trip", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = MergeModel.of(model_path)
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                b, rows = whole.slice(at, 256), []
                for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                    ids = model.encode(text or "")
                    decoded = model.decode(ids)
                    digest = hashlib.sha256(decoded.encode()).hexdigest()
                    rows.append((doc, len(text or ""), len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()), digest, decoded == (text or "")))
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)

    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, OUT)
