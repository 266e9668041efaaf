"""Language ID: a byte convolutional network trained in numpy.

Text is cut into windows of fixed byte length. Each byte has a learned embedding;
filters of several widths slide over it, the largest response of each filter in the
window feeds a softmax layer. A document's distribution is the mean of its windows'
log-probabilities, weighted by their bytes, so the whole text counts. The network is
trained on a bounded sample of labelled windows (see ``Training``).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from episcope.llm.common import row_groups, unused_name

UNDETERMINED = "und"
BATCH_BYTES = 1 << 20  # text that one call of the network sees


@dataclass(frozen=True)
class Training:
    """Parameters of the network and of its training sample.

    The sample holds at most ``texts_per_language`` distinct labelled texts of each
    language and ``windows_per_text`` windows of each, taken at even distances over the
    whole text: the only part of the operator that does not read every row.
    """

    window: int = 256
    embedding: int = 8
    widths: tuple[int, ...] = (2, 3, 4)
    filters: int = 8
    texts_per_language: int = 400
    windows_per_text: int = 4
    epochs: int = 12
    batch: int = 64
    rate: float = 0.01
    seed: int = 7


class ByteConvNet:
    """Embedding, convolutions of several widths, max pooling, softmax.

    Filters of all widths are columns of one matrix over the widest span; rows beyond a
    filter's own width stay zero. Byte 0 pads windows and embeds as zero.
    """

    def __init__(self, languages: list[str], p: Training):
        rng = np.random.default_rng(p.seed)
        span, n = max(p.widths), p.filters * len(p.widths)
        self.languages, self.window, self.span, self.size = languages, p.window, span, p.embedding
        self.mask = np.zeros((span, p.embedding, n), np.float32)
        for k, w in enumerate(p.widths):
            self.mask[:w, :, k * p.filters:(k + 1) * p.filters] = 1
        self.mask = self.mask.reshape(span * p.embedding, n)
        scale = lambda fan, *shape: (rng.standard_normal(shape) / np.sqrt(fan)).astype(np.float32)
        self.params = {
            "embed": scale(1, 256, p.embedding),
            "conv": scale(span * p.embedding / 2, span * p.embedding, n) * self.mask,
            "conv_bias": np.zeros(n, np.float32),
            "out": scale(n, n, len(languages)),
            "out_bias": np.zeros(len(languages), np.float32),
        }
        self.params["embed"][0] = 0

    def _spans(self, windows: np.ndarray) -> np.ndarray:
        """For each window and position the embeddings of the bytes a filter sees there."""
        padded = np.pad(windows, ((0, 0), (0, self.span - 1)))
        seen = self.params["embed"][padded]
        view = np.lib.stride_tricks.sliding_window_view(seen, self.span, axis=1)
        return view.transpose(0, 1, 3, 2).reshape(windows.shape[0] * windows.shape[1], -1)

    def log_probabilities(self, windows: np.ndarray) -> np.ndarray:
        spans = self._spans(windows)
        responses = (spans @ self.params["conv"]).reshape(*windows.shape, -1)
        pooled = np.maximum(responses.max(axis=1) + self.params["conv_bias"], 0)
        return _log_softmax(pooled @ self.params["out"] + self.params["out_bias"])

    def gradients(self, windows: np.ndarray, labels: np.ndarray) -> dict[str, np.ndarray]:
        """Gradients of the mean cross-entropy; only the position of each maximum gets any."""
        n, length = windows.shape
        spans = self._spans(windows)
        responses = (spans @ self.params["conv"]).reshape(n, length, -1)
        at = responses.argmax(axis=1)
        top = np.take_along_axis(responses, at[:, None], axis=1)[:, 0] + self.params["conv_bias"]
        pooled = np.maximum(top, 0)
        d_out = np.exp(_log_softmax(pooled @ self.params["out"] + self.params["out_bias"]))
        d_out[np.arange(n), labels] -= 1
        d_out /= n
        d_top = (d_out @ self.params["out"].T) * (top > 0)
        spans = spans.reshape(n, length, -1)
        seen = spans[np.arange(n)[:, None], at]
        d_seen = (d_top[:, :, None] * self.params["conv"].T).reshape(*d_top.shape, self.span, self.size)
        padded = np.pad(windows, ((0, 0), (0, self.span - 1)))
        bytes_seen = padded[np.arange(n)[:, None, None], at[:, :, None] + np.arange(self.span)]
        d_embed = np.zeros_like(self.params["embed"])
        np.add.at(d_embed, bytes_seen.ravel(), d_seen.reshape(-1, self.size))
        d_embed[0] = 0
        return {"embed": d_embed, "conv": np.einsum("bf,bfs->sf", d_top, seen) * self.mask, "conv_bias": d_top.sum(0),
                "out": pooled.T @ d_out, "out_bias": d_out.sum(0)}

    def fit(self, windows: np.ndarray, labels: np.ndarray, p: Training) -> None:
        """Adam over shuffled batches, with a step that falls to zero."""
        rng = np.random.default_rng(p.seed)
        mean = {k: np.zeros_like(v) for k, v in self.params.items()}
        square = {k: np.zeros_like(v) for k, v in self.params.items()}
        steps, t = p.epochs * -(-len(windows) // p.batch), 0
        for _ in range(p.epochs):
            order = rng.permutation(len(windows))
            for lo in range(0, len(order), p.batch):
                rows, t = order[lo:lo + p.batch], t + 1
                for k, g in self.gradients(windows[rows], labels[rows]).items():
                    mean[k] += 0.1 * (g - mean[k])
                    square[k] += 0.01 * (g * g - square[k])
                    step = p.rate * (1 - (t - 1) / steps) / (1 - 0.9 ** t)
                    self.params[k] -= (step * mean[k] / (np.sqrt(square[k] / (1 - 0.99 ** t)) + 1e-7)).astype(np.float32)


def _log_softmax(x: np.ndarray) -> np.ndarray:
    x = x - x.max(axis=1, keepdims=True)
    return x - np.log(np.exp(x).sum(axis=1, keepdims=True))


def cut_windows(texts: list[bytes], window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Whole texts as zero-padded windows; with each window's text number and byte count."""
    counts = np.array([-(-len(t) // window) for t in texts], np.int64)
    flat = b"".join(t.ljust(n * window, b"\0") for t, n in zip(texts, counts.tolist(), strict=True))
    windows = np.frombuffer(flat, np.uint8).reshape(-1, window)
    owner = np.repeat(np.arange(len(texts)), counts)
    lengths = np.array([len(t) for t in texts], np.int64)
    first = np.repeat(np.cumsum(counts) - counts, counts)
    filled = np.minimum(lengths[owner] - (np.arange(len(owner)) - first) * window, window)
    return windows, owner, filled


def train_language_model(labelled: DataFrame, text: str = "text", lang: str = "lang", p: Training = Training()) -> ByteConvNet | None:
    """Train on rows whose text and label are not NULL; None if there are none.

    Texts enter the sample by a hash of the text, so the same rows give the same model
    in any order and partitioning, and copies of a text count once. Only the sample's
    windows (``texts_per_language * windows_per_text`` a language) come to the driver.
    """
    rows = labelled.select(F.col(f"`{text}`").alias("t"), F.col(f"`{lang}`").alias("y")).where(
        F.col("y").isNotNull() & (F.octet_length("t") > 0))
    rows = rows.withColumn("h", F.xxhash64("t"))
    # One row for each language: its number of distinct labelled texts.
    counts = {r["y"]: r["n"] for r in rows.select("y", "h").distinct().groupBy("y").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return None
    languages = sorted(counts)
    # Thin out by hash first so that few texts are sorted; three times the quota, as hashes do not fall evenly.
    share = F.coalesce(*[F.when(F.col("y") == y, F.lit(min(1.0, 3.0 * p.texts_per_language / counts[y]))) for y in languages])
    drawn = F.pmod(F.col("h"), F.lit(1_000_003)) < share * 1_000_003
    length, part = F.length("t"), F.greatest(F.floor(F.length("t") / p.windows_per_text).cast("int"), F.lit(1))
    # Copies of a text are one row.
    pieces = F.array(*[F.when(part * k < length, F.substring(F.col("t"), part * k + 1, F.lit(p.window))) for k in range(p.windows_per_text)])
    drawn_rows = (rows.where(drawn).select("y", "h", F.array_compact(pieces).alias("pieces"))
                  .groupBy("y", "h").agg(F.min("pieces").alias("pieces")))
    sample = (drawn_rows.withColumn("rank", F.row_number().over(Window.partitionBy("y").orderBy("h")))
              .where(F.col("rank") <= p.texts_per_language).drop("rank").collect())
    sample.sort(key=lambda r: (r["y"], r["h"]))
    windows, labels = [], []
    for r in sample:
        for piece in r["pieces"]:
            windows.append(piece.encode("utf-8", "surrogatepass")[:p.window].ljust(p.window, b"\0"))
            labels.append(languages.index(r["y"]))
    model = ByteConvNet(languages, p)
    model.fit(np.frombuffer(b"".join(windows), np.uint8).reshape(-1, p.window), np.array(labels), p)
    return model


def predict_language(docs: DataFrame, model: ByteConvNet | None, text: str = "text", keep_text: bool = False,
                     names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """Every row of ``docs`` with ``lang_pred`` and ``score`` (0 to 1), or what ``names`` calls them.

    Text that is NULL or holds no letter, or any text without a model, gets ``und`` and
    score 0. Result columns replace input columns of the same name; the text itself is
    left out unless ``keep_text``.
    """
    kept = [c for c in docs.columns if c not in names and (keep_text or c != text)]
    # The other columns go through as one struct: their names may be any, with dots too. A text that
    # is kept stands in it once and nowhere else.
    rest = F.struct(*[docs[f"`{c}`"] for c in kept], F.lit(0).alias(unused_name(kept, "_"))).alias("row")
    place = kept.index(text) if text in kept else None
    rows = docs.select(rest, *([docs[f"`{text}`"].alias("text")] if place is None else []))
    schema = T.StructType([rows.schema["row"], T.StructField("lang", T.StringType()), T.StructField("chance", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1) if place is None else batch.column(0).field(place)
            for lo, hi in row_groups(texts, BATCH_BYTES):
                langs, scores = classify(model, texts.slice(lo, hi - lo).to_pylist())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(langs, pa.string()), pa.array(scores, pa.float64())],
                                                 names=["row", "lang", "chance"])

    return rows.mapInArrow(run, schema).select(
        *[F.col(f"row.`{c}`") for c in kept], F.col("lang").alias(names[0]), F.col("chance").alias(names[1]))


def classify(model: ByteConvNet | None, texts: list[str | None]) -> tuple[list[str], list[float]]:
    """Language and probability of each whole text."""
    langs, scores = [UNDETERMINED] * len(texts), [0.0] * len(texts)
    if model is None:
        return langs, scores
    rows = [i for i, t in enumerate(texts) if t and any(map(str.isalpha, t))]
    if not rows:
        return langs, scores
    windows, owner, filled = cut_windows([texts[i].encode("utf-8", "surrogatepass") for i in rows], model.window)
    logs = np.concatenate([model.log_probabilities(windows[k:k + 256]) for k in range(0, len(windows), 256)])
    starts = np.flatnonzero(np.diff(owner, prepend=-1))
    weighted = np.add.reduceat(logs * filled[:, None], starts, axis=0)
    totals = np.add.reduceat(filled, starts)
    chances = np.exp(_log_softmax(weighted / totals[:, None]))
    best = chances.argmax(axis=1)
    for i, k, row in zip(rows, best.tolist(), chances, strict=True):
        langs[i], scores[i] = model.languages[k], float(min(row[k], 1.0))
    return langs, scores
