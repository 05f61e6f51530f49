"""Token counts of a byte-fallback BPE model by rank-synchronous merging in ragged arrays."""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Distinct pre-tokens whose counts one Python worker keeps.
CACHE_WORDS = 1_000_000
SPACE = "▁"
WORD = re.compile(rb" *[^ ]+| +")
NONE = np.iinfo(np.int32).max
#: Characters of a pre-token that shares its rounds with others.
LONG = 2048

_mergers: dict = {}


class RankMerger:
    """Counts the symbols that survive a model's merges.

    Pieces never hold a space mark after another character, so a text falls
    into pre-tokens (space marks, then a word) that merge independently. A batch
    of pre-tokens is one flat array of symbol ids. In each round every pre-token
    applies its lowest-ranked pair, at all its places that don't overlap.
    Finished pre-tokens leave the arrays. So do those where such a merge could
    make a pair of a rank as low (pieces reached by several splits, pieces of one
    rank), and those of over LONG characters, whose many rounds would each pass
    over the batch: a queue merges them alone, place by place.
    """

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        size = model.get_piece_size()
        plain = [i for i in range(size) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
        piece = {model.id_to_piece(i): i for i in plain}
        if any(re.search(f"[^{SPACE}]{SPACE}", p) for p in piece):
            raise ValueError("pieces with a space mark after another character aren't supported")
        scores = {p: model.get_score(i) for p, i in piece.items()}
        order = {s: r for r, s in enumerate(sorted(set(scores.values()), reverse=True))}
        self.single = np.full(0x110000, -1, np.int32)
        keys, made = [], []
        for p, i in piece.items():
            if len(p) == 1:
                self.single[ord(p)] = i
            for k in range(1, len(p)):
                if p[:k] in piece and p[k:] in piece:
                    keys.append(piece[p[:k]] << 32 | piece[p[k:]])
                    made.append(i)
        by = np.argsort(keys)
        self.keys, self.made = np.array(keys, np.int64)[by], np.array(made, np.int32)[by]
        self.rank_of = np.full(size, NONE, np.int32)
        for p, i in piece.items():
            self.rank_of[i] = order[scores[p]]
        self.made_of = dict(zip(self.keys.tolist(), self.made.tolist(), strict=True))
        self.counts: dict[bytes, int] = {}

    @staticmethod
    def of(path: str) -> RankMerger:
        if path not in _mergers:
            _mergers[path] = RankMerger(path)
        return _mergers[path]

    def _pairs(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The piece that each pair of symbols makes, or -1."""
        key = a.astype(np.int64) << 32 | b.astype(np.int64)
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where((self.keys[at] == key) & (a >= 0) & (b >= 0), self.made[at], -1)

    def _rank(self, made: np.ndarray) -> np.ndarray:
        return np.where(made >= 0, self.rank_of[made], NONE)

    def _left_alone(self, sym: np.ndarray) -> int:
        """Symbols that merging leaves of one pre-token: the lowest rank first, the leftmost of equals, from a queue of (rank, place)."""
        n, made_of, rank_of = len(sym), self.made_of, self.rank_of.tolist()
        rank = self._rank(self._pairs(sym[:-1], sym[1:])).astype(np.int64)
        at = np.flatnonzero(rank != NONE)
        queue = np.sort(rank[at] << 40 | at).tolist()  # a sorted list is a heap
        symbol, after, before = sym.tolist(), list(range(1, n + 1)), list(range(-1, n - 1))
        left = n

        def offer(i: int, j: int) -> None:
            a, b = symbol[i], symbol[j]
            made = made_of.get(a << 32 | b, -1) if a >= 0 and b >= 0 else -1
            if made >= 0:
                heapq.heappush(queue, rank_of[made] << 40 | i)

        while queue:
            item = heapq.heappop(queue)
            i = item & (1 << 40) - 1
            j = after[i]
            if symbol[i] == -2 or j >= n or symbol[i] < 0 or symbol[j] < 0:
                continue
            made = made_of.get(symbol[i] << 32 | symbol[j], -1)
            if made < 0 or rank_of[made] != item >> 40:
                continue  # one of the two has merged since
            symbol[i], symbol[j], after[i] = made, -2, after[j]
            left -= 1
            if after[i] < n:
                before[after[i]] = i
                offer(i, after[i])
            if before[i] >= 0:
                offer(before[i], i)
        return left

    def merge_counts(self, words: list[str]) -> np.ndarray:
        """Tokens of each pre-token (space marks written out)."""
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        points = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)
        sym = self.single[points]
        # An unknown character falls back to its UTF-8 bytes; it takes part in no merge.
        width = 1 + (points > 0x7F) + (points > 0x7FF) + (points > 0xFFFF)
        owner = np.repeat(np.arange(len(words)), sizes)
        out = np.bincount(owner, weights=np.where(sym < 0, width - 1, 0), minlength=len(words)).astype(np.int64)
        if (sizes > LONG).any():
            ends = np.cumsum(sizes)
            for k in np.flatnonzero(sizes > LONG).tolist():
                out[k] += self._left_alone(sym[ends[k] - sizes[k] : ends[k]])
            short = np.repeat(sizes <= LONG, sizes)
            sym, owner = sym[short], owner[short]
        made = np.append(self._pairs(sym[:-1], sym[1:]), -1) if len(sym) else sym
        if len(sym):
            made[np.append(owner[:-1] != owner[1:], True)] = -1
        while len(sym):
            first = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
            rank = self._rank(made)
            least = np.minimum.reduceat(rank, first)
            lengths = np.diff(np.append(first, len(sym)))
            done = least == NONE
            if done.any():
                out[owner[first[done]]] += lengths[done]
                stay = np.repeat(~done, lengths)
                sym, owner, made, rank, least, lengths = sym[stay], owner[stay], made[stay], rank[stay], least[~done], lengths[~done]
                if not len(sym):
                    break
                first = np.cumsum(lengths) - lengths
            each = np.repeat(least, lengths)
            hit = np.flatnonzero(rank == each)
            # Of touching places every other one, from the left.
            fresh = np.append(True, (np.diff(hit) != 1) | (owner[hit[1:]] != owner[hit[:-1]]))
            begin = np.maximum.accumulate(np.where(fresh, np.arange(len(hit)), 0))
            hit = hit[(np.arange(len(hit)) - begin) % 2 == 0]
            new, own = made[hit], owner[hit]
            right = np.where(hit + 2 < len(sym), sym[np.minimum(hit + 2, len(sym) - 1)], -1)
            left = np.where(hit > 0, sym[np.maximum(hit - 1, 0)], -1)
            several = np.append(False, own[1:] == own[:-1])
            several[:-1] |= several[1:]
            if several.any():
                low = np.zeros(len(hit), bool)
                i = np.flatnonzero(several)
                for a, b in ((new[i], right[i]), (left[i], new[i]), (new[i], new[i])):
                    low[i] |= self._rank(self._pairs(a, b)) <= each[hit[i]]
                if low.any():
                    risky = np.zeros(len(out), bool)
                    risky[own[low]] = True
                    for k in np.flatnonzero(risky[owner[first]]).tolist():
                        out[owner[first[k]]] += self._left_alone(sym[first[k] : first[k] + lengths[k]])
                    stay = ~risky[owner]
                    shift, keep = np.cumsum(~stay), ~risky[own]
                    hit, new = hit[keep], new[keep]
                    hit -= shift[hit]
                    sym, owner, made = sym[stay], owner[stay], made[stay]
                    if not len(sym):
                        break
            sym[hit] = new
            gone = np.zeros(len(sym), bool)
            gone[hit + 1] = True
            at = hit - np.searchsorted(hit, hit)  # merges before a place each took one symbol away
            sym, owner, made = sym[~gone], owner[~gone], made[~gone]
            redo = np.unique(np.concatenate([at, np.maximum(at - 1, 0)]))
            nxt = np.minimum(redo + 1, len(sym) - 1)
            made[redo] = np.where((redo + 1 < len(sym)) & (owner[redo] == owner[nxt]), self._pairs(sym[redo], sym[nxt]), -1)
        return out

    def count(self, texts: list[str | None]) -> np.ndarray:
        """Tokens of whole texts, without begin or end tokens."""
        parts: list[list[bytes]] = []
        for text in texts:
            if not text:
                parts.append([])
                continue
            data = text.replace(SPACE, " ").encode("utf-8", "surrogatepass")
            found = data.split(b" ")
            parts.append([w[1:] for w in WORD.findall(b" " + data)] if b"" in found else found)
        flat = [w for p in parts for w in p]
        n = list(map(self.counts.get, flat))
        if None in n:
            new = list(dict.fromkeys(w for w, k in zip(flat, n, strict=True) if k is None))
            got: dict[bytes, int] = {}
            for i in range(0, len(new), 50_000):
                part = new[i : i + 50_000]
                got.update(zip(part, self.merge_counts([(" " + w.decode("utf-8", "surrogatepass")).replace(" ", SPACE) for w in part]).tolist(), strict=True))
            n = [got[w] if k is None else k for w, k in zip(flat, n, strict=True)]
            for w in new[: max(0, CACHE_WORDS - len(self.counts))]:
                self.counts[w] = got[w]
        sums = np.concatenate([[0], np.cumsum(np.array(n, np.int64))])
        return np.diff(sums[np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int64)])


def token_counts(df: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 4096) -> DataFrame:
    """Columns doc_id, n_bytes, n_tokens, over_limit: one row an input row, whatever it repeats.

    Null texts count as empty (no tokens). Texts are never cut. Nothing is
    shuffled; a task holds 256 texts and the worker's bounded cache. Other columns are ignored.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64()), ("over_limit", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merger = RankMerger.of(model_path)
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                b = whole.slice(at, 256)
                n = merger.count(b.column(2).to_pylist())
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(n), pa.array(n > limit)], schema=schema)

    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    docs = df.select(F.col(id_col).cast("long").alias("doc_id"), F.octet_length(text).cast("long").alias("n_bytes"), text.alias("text"))
    return docs.mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
