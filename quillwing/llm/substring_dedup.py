"""Removal of word passages that an earlier document already has, by prefix-partitioned suffix trees."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import give_back, text_bytes

#: UTF-8 bytes of text that one unit of work holds, and that one group of anchors or suffixes answers for.
CHUNK_BYTES, GROUP_BYTES = 2 << 20, 8 << 20
#: Words in an anchor: the least-hashed run of so many words in a window partitions it.
ANCHOR = 7
#: An anchor that so many chunks share is frequent: its windows are partitioned by all their words.
FREQUENT = 24
STEP = 0x9E3779B97F4A7C15


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def power(base: int, k: int) -> np.uint64:
    return np.uint64(pow(base, k, 1 << 64))


def word_codes(data: bytes, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """A 64-bit code of each word, from its bytes eight at a time.

    Each step mixes all bits before the next eight bytes come, so, unlike in a
    polynomial, no pattern of letters cancels out; words of up to eight bytes
    that differ and are of one length never share a code.
    """
    eights = np.ndarray(len(data) - 7, "<u8", data, strides=(1,)) if len(data) > 7 else np.zeros(0, np.uint64)
    code = mixed(lengths.astype(np.uint64) * np.uint64(STEP) + np.uint64(1))
    open_, at, left = np.arange(len(starts)), starts, lengths
    while len(open_):
        short = np.minimum(left, 8).astype(np.uint64)
        mask = np.where(short == 8, np.uint64(2**64 - 1), (np.uint64(1) << (np.uint64(8) * (short % np.uint64(8)))) - np.uint64(1))
        code[open_] = mixed((code[open_] ^ (eights[at] & mask)) * np.uint64(STEP) + np.uint64(0x632BE59BD9B4E019))
        more = left > 8
        open_, at, left = open_[more], at[more] + 8, left[more] - 8
    return code


class Words:
    """The words of a chunk's texts as codes, and hashes of the runs that start at each word."""

    def __init__(self, texts: list[bytes], window: int):
        self.window = window
        joined = b" ".join(texts) + b" " * 8
        data = np.frombuffer(joined, np.uint8)
        apart = np.append(True, (data == 32) | ((data >= 9) & (data <= 13)))
        starts = np.flatnonzero(apart[:-1] & ~apart[1:])
        lengths = np.flatnonzero(apart[1:] & ~apart[:-1]) - starts
        sizes = np.array([len(t) for t in texts], np.int64)
        begin = np.cumsum(sizes + 1) - (sizes + 1)
        self.doc = np.searchsorted(begin, starts, "right") - 1
        self.n_words = np.bincount(self.doc, minlength=len(texts)).astype(np.int64)
        self.count = len(starts)
        self.codes = word_codes(joined, starts, lengths)
        last = np.arange(self.count) + window - 1
        #: Places whose next ``window`` words lie in one text.
        self.whole = (last < self.count) & (self.doc == self.doc[np.minimum(last, self.count - 1)]) if self.count else np.zeros(0, bool)

    def runs(self, size: int) -> np.ndarray:
        """Hash of the ``size`` words from each place on (beyond the end: of fewer). Runs double, so it takes log2(size) passes."""
        part, done = self.codes, 0
        out, width, left = np.zeros(self.count, np.uint64), 1, size
        while left:
            if left & 1:
                out[: max(0, self.count - done)] += part[done:] * power(STEP, done)
                done += width
            left >>= 1
            if left:
                wider = part.copy()
                wider[: max(0, self.count - width)] += part[width:] * power(STEP, width)
                part, width = wider, 2 * width
        return mixed(out)

    def anchors(self) -> np.ndarray:
        """For each place the least hash among the runs of ANCHOR words within its window."""
        size = min(ANCHOR, self.window)
        least, width, span = self.runs(size), 1, self.window - size + 1
        while width < span:
            by = min(width, span - width)
            shifted = least.copy()
            shifted[: max(0, self.count - by)] = np.minimum(least[: max(0, self.count - by)], least[by:])
            least, width = shifted, width + by
        return least

    def classes(self, at: np.ndarray, ids: np.ndarray, run: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(order, first): the places ``at`` with equal windows side by side, by id and place; and where a new window begins.

        Hashes (``run``) order them, the words' codes decide: windows that share a hash without being equal are put in order by their codes.
        """
        order = np.lexsort((at, ids, run))
        differ = run[order[1:]] != run[order[:-1]]
        place = at[order]
        other = np.zeros(len(differ), bool)
        for k in range(self.window):
            other |= self.codes[place[1:] + k] != self.codes[place[:-1] + k]
        if (other & ~differ).any():
            order = np.lexsort((at, ids, *(self.codes[at + k] for k in range(self.window))))
            place = at[order]
            other = np.zeros(len(differ), bool)
            for k in range(self.window):
                other |= self.codes[place[1:] + k] != self.codes[place[:-1] + k]
        return order, np.append(True, other)[: len(order)]


class Subtree:
    """The suffix tree over some stretches of words, as its sorted suffixes and the words that neighbours have in common.

    ``codes`` has the stretches one after another, ``sizes`` their words.
    Suffixes are the places with at least ``window`` words left in their stretch.
    ``lcp[i]`` counts the first words that suffix i shares with the one before it;
    an internal node of depth d is a run of suffixes with lcp of d or more.
    """

    def __init__(self, codes: np.ndarray, sizes: np.ndarray, window: int):
        ends = np.repeat(np.cumsum(sizes), sizes)
        left = ends - np.arange(len(codes))
        places = np.flatnonzero(left >= window)
        known, word = np.unique(codes, return_inverse=True)
        bits = max(1, int(len(known)).bit_length())
        each, keys = 64 // bits, []  # numbers of so many words fit one key
        for k in range(0, window, each):
            key = np.zeros(len(places), np.uint64)
            for i in range(k, min(k + each, window)):
                key = key << np.uint64(bits) | word[places + i].astype(np.uint64)
            keys.append(key)
        self.places = places[np.lexsort(keys[::-1])]
        self.lcp = np.zeros(len(places), np.int64)
        open_ = np.arange(1, len(places))
        for k in range(int(sizes.max()) if len(sizes) else 0):
            a, b = self.places[open_ - 1], self.places[open_]
            open_ = open_[(left[a] > k) & (left[b] > k)]
            open_ = open_[word[self.places[open_ - 1] + k] == word[self.places[open_] + k]]
            self.lcp[open_] += 1
            if not len(open_):
                break

    def nodes(self, depth: int) -> np.ndarray:
        """For each sorted suffix the number of its internal node of that depth (or its leaf)."""
        return np.cumsum(self.lcp < depth) - 1


def _blob(x: np.ndarray) -> bytes:
    return np.ascontiguousarray(x).tobytes()


def _joined(column: pa.ChunkedArray, kind: type) -> np.ndarray:
    return np.concatenate([np.zeros(0, kind), *(np.frombuffer(x, kind) for x in column.to_pylist())])


def _cut(x: np.ndarray, part: np.ndarray, parts: np.ndarray) -> list[bytes]:
    """The values of ``x`` of each of ``parts``; ``part`` is sorted."""
    return [_blob(x[a:b]) for a, b in zip(np.searchsorted(part, parts), np.searchsorted(part, parts, "right"), strict=True)]


def repeated_words(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 13, names: tuple[str, str, str] = ("n_words", "n_removed", "kept")) -> DataFrame:
    """``df`` with three columns (``names``; they replace columns of these names): words, words removed, and the words that stay, joined by one space.

    A word goes if one of the ``window``-word windows of its document that cover
    it also starts in a document with a smaller id (windows of the texts as they
    come in). Null texts have no words. Documents with a null id neither give
    nor lose words; repeated ids don't take words from each other. All rows and columns stay.

    1. Texts are dealt once into chunks of about CHUNK_BYTES; every later step
       reuses that exchange.
    2. A window's anchor depends on its words alone, so equal windows have equal
       anchors. Each chunk sends its distinct anchors (32 bits each, about one
       for four words); those seen in two chunks come back, marked where many chunks have them.
    3. Only suffixes whose anchor is shared can repeat elsewhere. A chunk sends one
       suffix for each distinct window (its least id). Neighbours that share an
       anchor travel as one stretch of words, to the group that the anchor's 7
       words choose; suffixes with a frequent anchor go to groups that all
       their words choose, so groups stay of a size. A group sorts its suffixes,
       takes the common prefixes of neighbours and so has its subtree: an
       internal node of depth ``window`` or more is a repeat, with its least id.
    4. Chunks get back the places of suffixes that a smaller id elsewhere has, and mark words.

    A passage that all documents share sends one stretch a chunk, however many copies it has.
    """
    spark = df.sparkSession
    df = df.drop(*[n for n in names if n in df.columns])
    _, total = text_bytes(df, text_col)
    chunks, groups = max(64, -(-total // CHUNK_BYTES)), max(8, -(-total // GROUP_BYTES))
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    spread = [F.col(f"`{f.name}`") for f in df.schema.fields if "map<" not in f.dataType.simpleString() and "variant" not in f.dataType.simpleString()]
    docs = df.withColumn("_qw_chunk", F.pmod(F.xxhash64(*spread), F.lit(chunks)).cast("int")).repartition(max(least, -(-chunks // 8)), "_qw_chunk")

    def read(table: pa.Table) -> tuple[pa.Table, list[bytes], Words]:
        """The chunk's rows in an order that each step finds again."""
        give_back()
        table = table.take(pc.sort_indices(table, sort_keys=[(id_col, "ascending"), (text_col, "ascending")]))
        texts = [(t or "").encode("utf-8", "surrogatepass") for t in table.column(text_col).to_pylist()]
        return table, texts, Words(texts, window)

    def known(table: pa.Table, words: Words) -> tuple[np.ndarray, np.ndarray]:
        """Places of whole windows of documents with an id, and each word's id."""
        column = table.column(id_col).combine_chunks().cast(pa.int64())
        return np.flatnonzero(words.whole & ~np.asarray(column.is_null())[words.doc]), np.asarray(column.fill_null(0))[words.doc]

    def send_anchors(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        table, _, words = read(table)
        distinct = np.unique(words.anchors()[known(table, words)[0]]) if words.count else np.zeros(0, np.uint64)
        part = (distinct % np.uint64(groups)).astype(np.int32)
        code = np.unique(part.astype(np.uint64) << np.uint64(32) | distinct >> np.uint64(32))
        part, high = (code >> np.uint64(32)).astype(np.int32), code.astype(np.uint32)
        some = np.unique(part)
        return pa.table({"_slice": pa.array(some, pa.int32()), "_from": pa.array(np.full(len(some), key[0].as_py()), pa.int32()), "_data": pa.array(_cut(high, part, some), pa.binary())})

    def meet_anchors(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        data = [np.frombuffer(x, np.uint32) for x in table.column("_data").to_pylist()]
        found, n = np.unique(np.concatenate(data), return_counts=True)
        shared, often = found[n > 1], found[n >= FREQUENT]
        out = [x[np.isin(x, shared, assume_unique=True)] for x in data]
        some = [i for i, x in enumerate(out) if len(x)]
        return pa.table({
            "_qw_chunk": table.column("_from").take(pa.array(some, pa.int64())).combine_chunks(), "_part": pa.array([key[0].as_py()] * len(some), pa.int32()),
            "_data": pa.array([_blob(out[i]) for i in some], pa.binary()), "_often": pa.array([_blob(np.intersect1d(out[i], often)) for i in some], pa.binary()),
        })

    def send_suffixes(key: tuple[pa.Scalar, ...], table: pa.Table, back: pa.Table) -> pa.Table:
        table, _, words = read(table)
        kinds = {"_group": pa.int32(), "_from": pa.int32(), "_at": pa.binary(), "_size": pa.binary(), "_id": pa.binary(), "_codes": pa.binary()}
        if not words.count or not back.num_rows:
            return pa.table({n: pa.array([], t) for n, t in kinds.items()})
        anchors = words.anchors()
        code = (anchors % np.uint64(groups)) << np.uint64(32) | anchors >> np.uint64(32)

        def told(column: str) -> np.ndarray:
            parts = zip(back.column("_part").to_pylist(), back.column(column).to_pylist(), strict=True)
            return np.concatenate([np.uint64(p) << np.uint64(32) | np.frombuffer(x, np.uint32).astype(np.uint64) for p, x in parts])

        at, ids = known(table, words)
        at = at[np.isin(code[at], told("_data"))]
        run = words.runs(window)
        order, first = words.classes(at, ids[at], run[at])
        at = np.sort(at[order[first]])  # the least id's, of each distinct window
        often = np.isin(code[at], told("_often"))
        new = np.append(True, (np.diff(at) != 1) | (code[at[1:]] != code[at[:-1]]) | (words.doc[at[1:]] != words.doc[at[:-1]]))[: len(at)] | often
        begin = np.flatnonzero(new)
        size = np.diff(np.append(begin, len(at))) + window - 1
        group = np.where(often[begin], mixed(run[at[begin]]) % np.uint64(groups), anchors[at[begin]] % np.uint64(groups)).astype(np.int32)
        by = np.argsort(group, kind="stable")
        begin, size, group = at[begin[by]], size[by], group[by]
        some = np.unique(group)
        ends = np.cumsum(size)
        codes = words.codes[np.repeat(begin - (ends - size), size) + np.arange(int(ends[-1]) if len(ends) else 0)]
        columns = [some, np.full(len(some), key[0].as_py()), _cut(begin.astype(np.int32), group, some), _cut(size.astype(np.int32), group, some), _cut(ids[begin] if len(begin) else ids[:0], group, some), _cut(codes, np.repeat(group, size), some)]
        return pa.table({n: pa.array(x, t) for (n, t), x in zip(kinds.items(), columns, strict=True)})

    def meet_suffixes(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        give_back()
        begin, size, ids, codes = (_joined(table.column(n), t) for n, t in (("_at", np.int32), ("_size", np.int32), ("_id", np.int64), ("_codes", np.uint64)))
        origin = np.repeat(np.arange(table.num_rows), [len(x) // 4 for x in table.column("_at").to_pylist()])
        size = size.astype(np.int64)
        tree = Subtree(codes, size, window)
        stretch = np.repeat(np.arange(len(size)), size)[tree.places]
        id_, node = ids[stretch], tree.nodes(window)
        least = np.minimum.reduceat(id_, np.flatnonzero(np.diff(node, prepend=-1)))[node] if len(node) else id_
        late = np.flatnonzero(id_ > least)
        stretch = stretch[late]
        place = (begin[stretch] + tree.places[late] - (np.cumsum(size) - size)[stretch]).astype(np.int32)
        by = np.argsort(origin[stretch], kind="stable")
        place, source = place[by], origin[stretch][by]
        some = np.unique(source)
        return pa.table({"_qw_chunk": table.column("_from").take(pa.array(some)).combine_chunks(), "_at": pa.array(_cut(place, source, some), pa.binary())})

    columns = df.columns

    def mark(key: tuple[pa.Scalar, ...], table: pa.Table, back: pa.Table) -> pa.Table:
        table, texts, words = read(table)
        hit = np.zeros(0, np.int64)
        if words.count:
            at, ids = known(table, words)
            order, first = words.classes(at, ids[at], words.runs(window)[at])
            place, node = at[order], np.cumsum(first) - 1
            start = np.flatnonzero(first)
            elsewhere = np.isin(place[start], _joined(back.column("_at"), np.int32))  # the window's least id here sent it
            hit = place[elsewhere[node] | (ids[place] > ids[place[start]][node])] if len(place) else place
        gone = np.cumsum(np.bincount(hit, minlength=words.count + 1) - np.bincount(hit + window, minlength=words.count + 1))[: words.count] > 0
        removed = np.bincount(words.doc[gone], minlength=len(texts)).astype(np.int64)
        ends = np.cumsum(words.n_words)
        kept = []
        for i, t in enumerate(texts):
            w = t.split()
            if removed[i]:
                w = [x for x, g in zip(w, gone[ends[i] - len(w) : ends[i]].tolist(), strict=True) if not g]
            kept.append(b" ".join(w).decode("utf-8", "surrogatepass"))
        out = table.select(columns)
        for name, x in zip(names, (pa.array(words.n_words), pa.array(removed), pa.array(kept, pa.string())), strict=True):
            out = out.append_column(name, x)
        return out

    many = max(least, groups)
    shared = docs.groupBy("_qw_chunk").applyInArrow(send_anchors, "_slice int, _from int, _data binary").repartition(many, "_slice").groupBy("_slice").applyInArrow(meet_anchors, "_qw_chunk int, _part int, _data binary, _often binary")
    sent = docs.groupBy("_qw_chunk").cogroup(shared.groupBy("_qw_chunk")).applyInArrow(send_suffixes, "_group int, _from int, _at binary, _size binary, _id binary, _codes binary")
    repeats = sent.repartition(many, "_group").groupBy("_group").applyInArrow(meet_suffixes, "_qw_chunk int, _at binary")
    extra = f"`{names[0]}` long, `{names[1]}` long, `{names[2]}` string"
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    return docs.groupBy("_qw_chunk").cogroup(repeats.groupBy("_qw_chunk")).applyInArrow(mark, f"{fields}, {extra}")


def remove_repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 13, chars_col: str | None = None) -> DataFrame:
    """``df`` with repeated passages cut out of its texts (see ``repeated_words``).

    A text that loses no word stays as it is, white space included; ``chars_col`` gets the new length in characters.
    """
    names = ("_qw_words", "_qw_removed", "_qw_kept")
    found = repeated_words(df, id_col, text_col, window, names)
    cut = F.col("_qw_removed") > 0
    out = found.withColumn(text_col, F.when(cut, F.col("_qw_kept")).otherwise(F.col(text_col)))
    if chars_col:
        out = out.withColumn(chars_col, F.when(cut, F.char_length(text_col).cast(df.schema[chars_col].dataType)).otherwise(F.col(chars_col)))
    return out.select(*df.columns)
