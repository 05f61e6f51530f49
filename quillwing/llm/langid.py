"""Language identification by a byte convolutional network in numpy."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import give_back

WINDOW = 256
#: Texts that one step of the network takes at once, in windows.
BATCH = 256
LETTER = re.compile(r"[^\W\d_]")


class ByteConvNet:
    """Byte embeddings, filters of several widths with max pooling over the window, softmax.

    Byte 0 pads windows. Filters of all widths are columns of one matrix over
    ``max(widths)`` bytes; rows beyond a filter's width are held at zero.
    """

    def __init__(self, classes: list[str], widths: tuple[int, ...] = (2, 3, 4), filters: int = 12, size: int = 8, seed: int = 7):
        r = np.random.default_rng(seed)
        self.classes, self.span, self.size = classes, max(widths), size
        width = np.repeat(widths, filters)
        self.mask = (np.repeat(np.arange(self.span), size)[:, None] < width[None, :]).astype(np.float32)
        n = len(width)
        self.p = {
            "emb": r.normal(0, 0.5, (256, size)).astype(np.float32),
            "conv": (r.normal(0, 0.3, (self.span * size, n)) * self.mask).astype(np.float32),
            "bias": np.zeros(n, np.float32),
            "out": r.normal(0, 0.1, (n, len(classes))).astype(np.float32),
            "last": np.zeros(len(classes), np.float32),
        }
        self.p["emb"][0] = 0

    def _columns(self, x: np.ndarray) -> np.ndarray:
        """(windows, places, span * size): the embedded bytes under the filters at each place."""
        e = self.p["emb"][x]
        view = np.lib.stride_tricks.sliding_window_view(e, self.span, axis=1)  # (n, places, size, span)
        return np.ascontiguousarray(view.transpose(0, 1, 3, 2)).reshape(len(x), -1, self.span * self.size)

    def _pooled(self, cols: np.ndarray) -> np.ndarray:
        n, places, k = cols.shape
        return (cols.reshape(-1, k) @ self.p["conv"]).reshape(n, places, -1)

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        """Softmax of each window of bytes, (windows, classes)."""
        out = np.empty((len(x), len(self.classes)), np.float32)
        for i in range(0, len(x), BATCH):
            top = np.maximum(self._pooled(self._columns(x[i : i + BATCH])).max(axis=1) + self.p["bias"], 0)
            z = top @ self.p["out"] + self.p["last"]
            z = np.exp(z - z.max(axis=1, keepdims=True))
            out[i : i + BATCH] = z / z.sum(axis=1, keepdims=True)
        return out

    def fit(self, x: np.ndarray, y: np.ndarray, epochs: int = 4, rate: float = 0.004, seed: int = 7) -> None:
        """Adam on the cross-entropy. A third of the windows are cut to a random length, for short texts."""
        r = np.random.default_rng(seed)
        mean = {k: np.zeros_like(v) for k, v in self.p.items()}
        square = {k: np.zeros_like(v) for k, v in self.p.items()}
        step = 0
        for _ in range(epochs):
            order = r.permutation(len(x))
            for i in range(0, len(x), 64):
                at = order[i : i + 64]
                xb, yb = x[at].copy(), y[at]
                cut = np.where(r.random(len(at)) < 1 / 3, r.integers(12, WINDOW, len(at)), WINDOW)
                xb[np.arange(WINDOW)[None, :] >= cut[:, None]] = 0
                cols = self._columns(xb)
                h = self._pooled(cols)
                arg = h.argmax(axis=1)
                top = np.take_along_axis(h, arg[:, None, :], 1)[:, 0] + self.p["bias"]
                act = np.maximum(top, 0)
                z = act @ self.p["out"] + self.p["last"]
                z = np.exp(z - z.max(axis=1, keepdims=True))
                d = z / z.sum(axis=1, keepdims=True)
                d[np.arange(len(at)), yb] -= 1
                d /= len(at)
                back = (d @ self.p["out"].T) * (top > 0)
                under = cols[np.arange(len(at))[:, None], arg]  # (batch, filters, span * size)
                emb = np.zeros_like(self.p["emb"])
                lift = back[:, :, None] * self.p["conv"].T[None]  # (batch, filters, span * size)
                seen = xb[np.arange(len(at))[:, None, None], arg[:, :, None] + np.arange(self.span)]
                np.add.at(emb, seen.reshape(-1), lift.reshape(-1, self.size))
                emb[0] = 0
                grad = {"emb": emb, "conv": np.einsum("bfk,bf->kf", under, back) * self.mask, "bias": back.sum(0), "out": act.T @ d, "last": d.sum(0)}
                step += 1
                for k, g in grad.items():
                    mean[k] += 0.1 * (g - mean[k])
                    square[k] += 0.001 * (g * g - square[k])
                    self.p[k] -= (rate * (mean[k] / (1 - 0.9**step)) / (np.sqrt(square[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)


def byte_windows(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """All texts' bytes in rows of WINDOW, each text from a row of its own, and each text's number of rows."""
    data = [t.encode("utf-8", "replace").replace(b"\0", b" ") for t in texts]
    rows = np.array([-(-len(d) // WINDOW) for d in data], np.int64)
    flat = b"".join(d.ljust(int(n) * WINDOW, b"\0") for d, n in zip(data, rows, strict=True))
    return np.frombuffer(flat, np.uint8).reshape(-1, WINDOW), rows


def held_out(id_col: str, folds: int = 5) -> Column:
    """Whether crc32(id as text) mod folds is 0; false for a null id."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % folds == 0, F.lit(False))


def train(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", max_docs: int = 3200, least_docs: int = 16, windows: int = 4, seed: int = 7) -> ByteConvNet | None:
    """Fit a network on rows that are not held out and have a language and a text; None where there are none.

    Every language is learned. The driver gets a bounded sample: of each of L
    languages about max(max_docs / L, least_docs) documents, and twice as many at
    most, chosen by the hash of their id, and of each at most ``windows`` stretches of WINDOW
    characters spread evenly over the whole text. Rows with a null id are never learned
    (their fold is unknown); other columns are ignored.
    """
    rows = df.where(F.col(id_col).isNotNull() & ~held_out(id_col) & F.col(lang_col).isNotNull() & (F.length(text_col) > 0)).select(F.col(id_col).alias("id"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    sizes = {r[0]: r[1] for r in rows.groupBy("lang").count().collect()}
    if not sizes:
        return None
    each = max(max_docs // len(sizes) + 1, least_docs)
    shares = df.sparkSession.createDataFrame([(k, min(1.0, each / n)) for k, n in sorted(sizes.items())], "lang string, share double")
    if len(sizes) <= 1 << 16:
        shares = F.broadcast(shares)
    drawn = F.pmod(F.xxhash64(F.lit(seed), "id"), F.lit(1 << 20))
    picked = rows.withColumn("_drawn", drawn).join(shares, "lang").where(F.col("_drawn") / (1 << 20) < F.col("share"))
    n, step = F.length("text"), F.greatest(F.lit(1), F.floor((F.length("text") - WINDOW) / (windows - 1)).cast("int"))
    starts = F.when(n <= WINDOW, F.array(F.lit(1))).otherwise(F.transform(F.sequence(F.lit(0), F.lit(windows - 1)), lambda i: F.least(n - WINDOW + 1, i.cast("int") * step + 1)))
    text = F.col("text")
    parts = picked.select("id", "lang", "_drawn", F.transform(starts, lambda s: text.substr(s, F.lit(WINDOW))).alias("parts"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy("_drawn", "id", "parts"))  # an id that many rows repeat is drawn with all of them
    got = sorted((r[0], r[1], r[2]) for r in parts.withColumn("_place", place).where(F.col("_place") <= 2 * each).select("id", "lang", "parts").collect())
    classes = sorted(sizes)
    x, y = [], []
    for _, lang, parts in got:
        for part in parts:
            w, _ = byte_windows([part])
            if len(w):
                x.append(w[0])
                y.append(classes.index(lang))
    if not x:
        return None
    net = ByteConvNet(classes, seed=seed)
    net.fit(np.stack(x), np.array(y), epochs=max(4, min(40, 40_000 // len(x))), seed=seed)
    return net


def predict(df: DataFrame, net: ByteConvNet | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Columns id_col, lang_pred, score for every row: ``und`` with score 0 for a null text or one without a letter.

    Every byte of the text is under a window; a document's probability is the
    mean over its windows, weighted by their bytes; of equally likely languages
    the first by name is told. Only the text decides; null ids and repeated rows
    have a row each, other columns are ignored.
    Nothing is shuffled; a task holds 64 texts and one batch of windows.
    """
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 64):
                b = whole.slice(at, 64)
                texts = [t if net is not None and t and LETTER.search(t) else "" for t in b.column(1).to_pylist()]
                langs, scores = ["und"] * len(texts), [0.0] * len(texts)
                x, rows = byte_windows(texts)
                if len(x):
                    weighed = net.probabilities(x) * (x != 0).sum(axis=1, keepdims=True)
                    sums = np.concatenate([np.zeros((1, weighed.shape[1])), np.cumsum(weighed, axis=0, dtype=np.float64)])
                    ends = np.cumsum(rows)
                    for i in np.flatnonzero(rows):
                        p = sums[ends[i]] - sums[ends[i] - rows[i]]
                        p /= p.sum()
                        langs[i], scores[i] = net.classes[int(p.argmax())], float(min(1.0, p.max()))
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(langs), pa.array(scores)], [id_col, "lang_pred", "score"])

    return df.select(id_col, F.col(text_col).cast("string").alias("text")).mapInArrow(run, f"`{id_col}` {kind}, lang_pred string, score double")


def keep_identified(df: DataFrame, net: ByteConvNet | None, text_col: str = "text", least_score: float | None = None) -> DataFrame:
    """The rows of ``df``, all columns, whose language the network tells with at least ``least_score``; null and letterless texts go.

    Without a ``least_score`` it is 1.4 times what guessing among the languages would give, 0.35 at most.
    """
    names = df.columns
    if least_score is None:
        least_score = min(0.35, 1.4 / len(net.classes)) if net else 0.35

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back()
        for whole in batches:
            for at in range(0, whole.num_rows, 64):
                b = whole.slice(at, 64)
                texts = [t if net is not None and t and LETTER.search(t) else "" for t in b.column(names.index(text_col)).to_pylist()]
                keep = np.zeros(len(texts), bool)
                x, rows = byte_windows(texts)
                if len(x):
                    weighed = net.probabilities(x) * (x != 0).sum(axis=1, keepdims=True)
                    sums = np.concatenate([np.zeros((1, weighed.shape[1])), np.cumsum(weighed, axis=0, dtype=np.float64)])
                    ends = np.cumsum(rows)
                    p = sums[ends] - sums[ends - rows]
                    keep = (rows > 0) & (p.max(axis=1) >= least_score * p.sum(axis=1))
                yield b.filter(pa.array(keep))

    return df.mapInArrow(run, df.schema)
