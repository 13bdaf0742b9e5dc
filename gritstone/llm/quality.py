"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gritstone.llm.common import free_names, scratch, slices, stored

#: Buckets for words; the structure statistics follow them.
WORDS = 1 << 16
RANK = 8
#: Statistics of a text's form, each cut into steps, so that the machine can learn any shape of response.
STATISTICS = ("words", "word_length", "line_words", "distinct", "upper", "digits", "symbols", "odd_ends", "bare_tokens", "repeated_lines", "top_word", "declared")
STEPS = 16
DIMENSION = WORDS + len(STATISTICS) * STEPS + 1
#: Labelled documents that a model is fitted on, at most.
MAX_TRAIN = 6000

_ODD_END = re.compile(r"[^\w\s.,;:!?'\")\]-](?=\s|$)")
_BARE = re.compile(r"(?:^|\s)[^\w\s]+(?=\s|$)")
_SYMBOL = re.compile(r"[^\w\s]")
_UPPER, _DIGIT = re.compile(r"[A-ZÀ-Þ]"), re.compile(r"[0-9]")


class _Buckets(dict):
    most = 400_000

    def __missing__(self, word: str) -> int:
        if len(self) >= self.most:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word) % WORDS
        return h


def _step(x: float, top: float, log: bool = False) -> int:
    x, top = (math.log1p(x), math.log1p(top)) if log else (x, top)
    return min(STEPS - 1, int(STEPS * x / top))


def features(text: str | None, n_chars: int | None, buckets: dict) -> tuple[np.ndarray, np.ndarray]:
    """Feature numbers and values; the words of a text together have the norm 1, a statistic's step has 1."""
    text = text or ""
    words = text.lower().split()
    counts = Counter(words)
    lines = text.split("\n")
    n, size = max(1, len(words)), max(1, len(text))
    values = (
        _step(len(words), 20_000, True), _step(len(text) / n, 24), _step(n / len(lines), 400, True), _step(len(counts) / n, 1),
        _step(len(_UPPER.findall(text)) / size, 0.2), _step(len(_DIGIT.findall(text)) / size, 0.2), _step(len(_SYMBOL.findall(text)) / size, 0.4),
        _step(len(_ODD_END.findall(text)) / n, 1), _step(len(_BARE.findall(text)) / n, 0.6), _step(1 - len(set(lines)) / len(lines), 1),
        _step(max(counts.values(), default=0) / n, 0.5), _step(abs((n_chars if n_chars is not None else len(text)) - len(text)) / size, 1),
    )
    form = [WORDS + i * STEPS + v for i, v in enumerate(values)] + [DIMENSION - 1]
    index = np.fromiter(map(buckets.__getitem__, counts), np.int64, len(counts))
    weight = np.sqrt(np.fromiter(counts.values(), np.float64, len(counts)))
    weight /= max(1e-9, math.sqrt(float((weight * weight).sum())))
    return np.concatenate([index, form]), np.concatenate([weight, np.ones(len(form))])


@dataclass
class FactorisationMachine:
    """score = logistic(bias + w.x + sum of <v_i, v_j> x_i x_j over pairs i < j)."""

    w: np.ndarray
    v: np.ndarray
    bias: float = 0.0

    def raw(self, index: np.ndarray, value: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row sums in time linear in the features: the pairs are half of (sum v x)^2 - sum (v x)^2."""
        vx = self.v[index] * value[:, None]
        total = np.add.reduceat(vx, start, axis=0)
        pairs = 0.5 * ((total**2).sum(1) - np.add.reduceat((vx**2).sum(1), start))
        return self.bias + np.add.reduceat(self.w[index] * value, start) + pairs, total

    def score(self, rows: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        if not rows:
            return np.zeros(0)
        start = np.cumsum([0] + [len(i) for i, _ in rows[:-1]])
        z, _ = self.raw(np.concatenate([i for i, _ in rows]), np.concatenate([x for _, x in rows]), start)
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, epochs: int = 12, batch: int = 128, rate: float = 0.08, decay: float = 1e-4, seed: int = 7) -> FactorisationMachine:
    """AdaGrad on the log loss, in an order fixed by the seed. No rows: every score is 0.5."""
    rng = np.random.default_rng(seed)
    model = FactorisationMachine(np.zeros(DIMENSION), rng.normal(0, 0.02, (DIMENSION, RANK)))
    if not rows:
        return FactorisationMachine(model.w, np.zeros_like(model.v))
    share = min(0.99, max(0.01, float(labels.mean())))
    model.bias = math.log(share / (1 - share))
    gw, gv = np.full(DIMENSION, 1e-6), np.full((DIMENSION, RANK), 1e-6)
    for _ in range(epochs):
        order = rng.permutation(len(rows))
        for at in range(0, len(order), batch):
            part = [rows[i] for i in order[at : at + batch]]
            y = labels[order[at : at + batch]]
            size = np.array([len(i) for i, _ in part])
            start, row = np.cumsum([0, *size[:-1]]), np.repeat(np.arange(len(part)), size)
            index, value = np.concatenate([i for i, _ in part]), np.concatenate([x for _, x in part])
            z, total = model.raw(index, value, start)
            error = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y)[row] / len(part)
            used, place = np.unique(index, return_inverse=True)
            dw = np.bincount(place, error * value, len(used)) + decay * model.w[used]
            dv = (error * value)[:, None] * (total[row] - model.v[index] * value[:, None])
            dv = np.stack([np.bincount(place, dv[:, f], len(used)) for f in range(RANK)], 1) + decay * model.v[used]
            gw[used] += dw**2
            gv[used] += dv**2
            model.w[used] -= rate * dw / np.sqrt(gw[used])
            model.v[used] -= rate * dv / np.sqrt(gv[used])
    return model


def _featurise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    buckets = _Buckets()
    for batch in slices(batches):
        found = [features(t, n, buckets) for t, n in zip(batch.column("text").to_pylist(), batch.column("n_chars").to_pylist(), strict=True)]
        yield pa.RecordBatch.from_arrays(
            [batch.column("order_"), batch.column("quality"), pa.array([i.astype(np.int32).tobytes() for i, _ in found], pa.binary()), pa.array([x.astype(np.float32).tobytes() for _, x in found], pa.binary())],
            ["order_", "quality", "i", "x"],
        )


def train(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN) -> FactorisationMachine:
    """Fit on the labelled documents whose crc32(doc_id) mod 5 is not 0: the max_train first of them by md5(doc_id).

    The features of that bounded sample come to the driver, the texts do not. Labels other than 0 and 1, and null ids, take no
    part; a repeated label counts once, a document labelled both ways once each way. Of rows that share a
    doc_id one is read, the least by the md5 of its text; null and empty texts have the features of a text without
    words. Without labelled documents every score will be 0.5. Other columns are not read.
    """
    key = F.col("doc_id").cast("string").cast("binary")
    known = labels.where("quality in (0, 1) and doc_id is not null").where(F.crc32(key) % 5 != 0).select("doc_id", F.col("quality").cast("int").alias("quality"), F.md5(key).alias("order_")).distinct()
    with scratch(docs.sparkSession):
        sample = stored(known.orderBy("order_", "quality").limit(max_train), "quality-sample")
        size = F.col("n_chars").cast("long") if "n_chars" in docs.columns else F.lit(None).cast("long")
        texts = docs.select(F.col("doc_id").alias("id_"), "text", size.alias("n_chars"))
        found = texts.join(F.broadcast(sample), F.col("id_") == F.col("doc_id")).select("order_", "quality", "text", "n_chars")
        rows = found.select("order_", "quality", F.struct(F.md5("text").alias("by"), "n_chars", "text").alias("doc")).groupBy("order_", "quality").agg(F.min("doc").alias("doc"))
        rows = rows.select("order_", "quality", "doc.text", "doc.n_chars").mapInArrow(_featurise, "order_ string, quality int, i binary, x binary").collect()
    rows = sorted(rows)
    pairs = [(np.frombuffer(r["i"], np.int32).astype(np.int64), np.frombuffer(r["x"], np.float32).astype(np.float64)) for r in rows]
    return fit(pairs, np.array([r["quality"] for r in rows], float))


def _scorer(model: FactorisationMachine, threshold: float, size: str, whole: list[str] | None) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        buckets = _Buckets()
        for batch in slices(batches):
            n = batch.column(size).to_pylist()
            score = model.score([features(t, c, buckets) for t, c in zip(batch.column("text").to_pylist(), n, strict=True)])
            if whole is not None:
                yield batch.select(whole).filter(pa.array(score >= threshold))
            else:
                predicted = pa.array((score >= threshold).astype(np.int32))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(score), predicted], ["doc_id", "held_out", "score", "predicted"])

    return run


def _with_size(docs: DataFrame, name: str) -> DataFrame:
    return docs.withColumn(name, (F.col("n_chars") if "n_chars" in docs.columns else F.lit(None)).cast("long"))


def score_quality(docs: DataFrame, model: FactorisationMachine, threshold: float = 0.3) -> DataFrame:
    """One row per row of docs: doc_id, held_out, score, predicted.

    Features are the hashed lower-cased words of the whole text, statistics of its form, and how far the column
    n_chars is from the text's length (null or no such column: not at all); never lang, source, doc_id or a
    label. Null and empty texts have the features of a text without words. Null doc_ids are not held out.
    Repeated rows score alike; an empty table gives no rows.
    """
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))
    read = _with_size(docs, "n_chars").select("doc_id", held.alias("held_out"), "text", "n_chars")
    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, held_out boolean, score double, predicted int"
    return read.mapInArrow(_scorer(model, threshold, "n_chars", None), schema)


def keep_quality(docs: DataFrame, model: FactorisationMachine, threshold: float = 0.3) -> DataFrame:
    """The rows of docs with a score of threshold or more; columns as in docs, whatever their names.

    Null and empty texts are scored as a text without words; repeated rows go or stay together; an empty table gives no rows.
    """
    (size,) = free_names(docs, "size_as_stated")
    return _with_size(docs, size).mapInArrow(_scorer(model, threshold, size, docs.columns), docs.schema)
