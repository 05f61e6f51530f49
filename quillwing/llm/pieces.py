"""Exact encoding of whole texts through a cache of white-space separated chunks."""

from __future__ import annotations

import json
import os
import re
from itertools import chain

import numpy as np

from .common import KEPT

#: Chunks that one Python worker keeps; with more, it starts over.
CACHE_CHUNKS = 400_000
#: Chunks that go to the library as one text.
JOINED = 64
CHUNK = re.compile(rb"[ \t-\r]*[^ \t-\r]+|[ \t-\r]+")
#: Other white space than ASCII's: a run of it next to ASCII's may not be cut.
WIDE_SPACE = re.compile("[\x85\xa0  -​    　﻿]")
SEPARATORS = b"\x1c\x1d\x1e\x1f"
#: A chunk with white space kept begins with a space that isn't written, or with one of these: a line feed, nothing.
LINE, PLAIN = b"\x01", b"\x02"
BLANK = bytes(32 if 9 <= b <= 13 else b for b in range(256))
#: Characters that lower-casing and composing leave as long as they are.
STABLE = re.compile(rb"(?:[\x00-\x7f]|\xc3[\x80-\xbf])*")

#: Under this name workers keep encoders.
ENCODERS = "encoders"


class Codes(dict):
    """Chunk to code; a chunk that isn't known gets the next code and is listed in ``new``."""

    def __init__(self):
        self.new: list[bytes] = []

    def __missing__(self, chunk: bytes) -> int:
        code = self[chunk] = len(self)
        self.new.append(chunk)
        return code


class ChunkedEncoder:
    """Ids of texts as the ``tokenizers`` library gives them, each distinct chunk encoded once.

    A chunk is a word with the white space before it (``lead``), or the word
    alone where the tokenizer drops white space. The library's pre-tokenizers
    never join characters across a chunk's start, so the ids of a text are its
    chunks' ids in order. Texts with other white space, or with ``<|`` (special
    strings), go through the library whole. A worker keeps the cache across
    tasks; it holds ``CACHE_CHUNKS`` chunks and one batch's at most.
    """

    def __init__(self, path: str, lead: bool):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.lead = Tokenizer.from_file(path), lead
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        suffix = spec["model"].get("end_of_word_suffix") or ""
        self.lower = "Lowercase" in json.dumps(spec.get("normalizer"))
        vocabulary = self.tokenizer.get_vocab()
        #: Bytes that each id stands for: a byte-level vocabulary has one character a byte.
        self.width = np.zeros(max(vocabulary.values()) + 1, np.int64)
        for piece, i in vocabulary.items():
            self.width[i] = len(piece.removesuffix(suffix) if suffix else piece)
        self.dtype = np.dtype(np.uint16 if len(self.width) <= 1 << 16 else np.uint32)
        self.forget()

    @staticmethod
    def of(path: str, lead: bool) -> ChunkedEncoder:
        encoders = KEPT.setdefault(ENCODERS, {})
        if (path, lead) not in encoders:
            encoders[path, lead] = ChunkedEncoder(path, lead)
        return encoders[path, lead]

    def forget(self) -> None:
        self.codes, self.used = Codes(), 0
        self.pool = np.empty(1 << 16, self.dtype)
        self.start, self.size = np.empty(1 << 14, np.int64), np.empty(1 << 14, np.int32)

    def _alone(self, chunks: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of chunks that go to the library one by one, and how many ids each has."""
        found = [e.ids for i in range(0, len(chunks), 4096) for e in self.tokenizer.encode_batch_fast([c.decode() for c in chunks[i : i + 4096]], add_special_tokens=False)]
        return np.fromiter(chain.from_iterable(found), self.dtype), np.fromiter(map(len, found), np.int64, len(found))

    def _together(self, chunks: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The same of chunks that keep their length and may stand side by side; the ids' widths tell where a chunk ends."""
        glue = b"" if self.lead else b" "
        groups = [glue.join(chunks[i : i + JOINED]).decode() for i in range(0, len(chunks), JOINED)]
        found = [e.ids for i in range(0, len(groups), 512) for e in self.tokenizer.encode_batch_fast(groups[i : i + 512], add_special_tokens=False)]
        ids = np.fromiter(chain.from_iterable(found), self.dtype)
        ends = np.cumsum(np.fromiter(map(len, chunks), np.int64, len(chunks)))
        reached = np.cumsum(self.width[ids])
        last = np.searchsorted(reached, ends)
        if len(reached) == 0 or reached[-1] != ends[-1] or (reached[last] != ends).any():
            return self._alone(chunks)
        return ids, np.diff(last, prepend=-1)

    def _learn(self, base: int) -> None:
        """Append the ids of the new chunks, whose codes begin at ``base``."""
        new, self.codes.new = self.codes.new, []
        if self.lead:
            text = [b"\n" + c[1:] if c[:1] == LINE else c[1:] if c[:1] == PLAIN else b" " + c for c in new]
            alone = np.fromiter((t[:1] not in (b" ", b"\n") or t.isspace() for t in text), bool, len(text))
        else:
            text = new
            alone = np.fromiter((STABLE.fullmatch(t) is None for t in text), bool, len(text))
        if base + len(new) > len(self.start):
            more = max(len(self.start), len(new))
            self.start, self.size = (np.concatenate([x, np.empty(more, x.dtype)]) for x in (self.start, self.size))
        for of, pick in ((self._alone, alone), (self._together, ~alone)):
            at = np.flatnonzero(pick)
            if len(at):
                ids, sizes = of([text[i] for i in at.tolist()])
                if self.used + len(ids) > len(self.pool):
                    self.pool = np.concatenate([self.pool, np.empty(max(len(self.pool), len(ids)), self.dtype)])
                self.pool[self.used : self.used + len(ids)] = ids
                self.start[base + at] = self.used + np.cumsum(sizes) - sizes
                self.size[base + at] = sizes
                self.used += len(ids)

    def _chunks(self, text: str) -> list[bytes] | None:
        """The text's chunks; None if it has to go whole."""
        data = text.encode()
        if b"<|" in data or len(data) != len(data.translate(None, SEPARATORS)) or not data.isascii() and WIDE_SPACE.search(text):
            return None
        if not self.lead:
            return (data.lower() if self.lower else data).split()
        if LINE in data or PLAIN in data:
            return None
        blank = data.translate(BLANK)
        if b"   " in blank or blank[-2:] == b"  ":
            return [PLAIN + c for c in CHUNK.findall(data)]
        # White space of one or two characters may be cut before each: the library leaves the last one to what follows.
        return (PLAIN + data).replace(b"\n", b" " + LINE).split(b" ")

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one after another, and the number of ids of each."""
        if len(self.codes) > CACHE_CHUNKS:
            self.forget()
        parts: list[list[bytes]] = []
        whole: dict[int, list[int]] = {}
        for i, text in enumerate(texts):
            found = self._chunks(text) if text else []
            if found is None:
                whole[i] = self.tokenizer.encode(text, add_special_tokens=False).ids
                found = []
            parts.append(found)
        many = np.fromiter(map(len, parts), np.int64, len(parts))
        known = len(self.codes)
        code = np.fromiter(map(self.codes.__getitem__, chain.from_iterable(parts)), np.int64, int(many.sum()))
        if self.codes.new:
            self._learn(known)
        sizes = self.size[code].astype(np.int64)
        ends = np.cumsum(sizes)
        total = int(ends[-1]) if len(ends) else 0
        ids = self.pool[np.repeat(self.start[code] - (ends - sizes), sizes) + np.arange(total)]
        bounds = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(many)])]
        counts = np.diff(bounds)
        if whole:
            each = [np.array(whole[i], self.dtype) if i in whole else ids[bounds[i] : bounds[i + 1]] for i in range(len(texts))]
            ids, counts = np.concatenate(each), np.array([len(p) for p in each], np.int64)
        return ids, counts
