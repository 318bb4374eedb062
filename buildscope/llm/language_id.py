"""Language identification: averaged hashed subword embeddings and a linear softmax, trained by stochastic gradient descent in numpy.

A text's subwords are its byte n-grams, lower-cased in ASCII, hashed to ``BUCKETS`` embeddings; their average goes through one linear
layer. Both are learned on a bounded sample of labelled rows. Because averaging is linear, the embeddings are folded into the layer
after training: a text's logits are the average of one small row per n-gram, looked up over the whole text.

Probabilities are calibrated by a temperature fitted on a part of the sample kept from training. The rejection threshold is the score
that all but ``REJECTED_SHARE`` of the rightly labelled texts of that part reach, at most ``HIGHEST_THRESHOLD``.

Defined results: a null text, or one without a letter, is ``und`` with score 0 and rejected; a text too short for an n-gram is judged
by the bias alone; equal texts get equal results, row by row; ids may be null or repeated. Without any labelled row every text is
``und``. Only the id and the results come back, so other columns cannot clash.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from buildscope.llm.common import byte_texts, chunks, tidy
from buildscope.llm.samples import labelled_sample

GRAMS = (3, 4)
BUCKETS = 1 << 15
WIDTH = 16
SAMPLE_ROWS = 3_000
SAMPLE_CHARS = 20_000
# Steps of descent at least, however small the sample.
EPOCHS, STEPS = 8, 800
RATE = 20.0
BATCH = 32
REJECTED_SHARE = 0.001
# A sample that is separated without error would sharpen scores without end.
LOWEST_TEMPERATURE = 0.5
HIGHEST_THRESHOLD = 0.5
UNKNOWN = "und"
SEED = 11


class Model(NamedTuple):
    labels: list[str]
    table: np.ndarray  # a row of logits for each bucket
    bias: np.ndarray
    temperature: float
    threshold: float


def gram_buckets(data: np.ndarray, size: int) -> np.ndarray:
    """The bucket of the n-gram that starts at each byte; the last ``size - 1`` bytes start none."""
    code = np.zeros(max(0, len(data) - size + 1), np.uint32)
    for i in range(size):
        code *= np.uint32(0x01000193)
        code += data[i : len(data) - size + 1 + i]
    code *= np.uint32(0x9E3779B1)
    code ^= np.uint32(size) << np.uint32(20)
    return code >> np.uint32(32 - 15)


def text_features(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of a text and their shares."""
    data = np.frombuffer(text.lower(), np.uint8)
    counts = sum(np.bincount(gram_buckets(data, n), minlength=BUCKETS) for n in GRAMS)
    found = np.flatnonzero(counts)
    return found, (counts[found] / max(1, counts.sum())).astype(np.float32)


def softmax(logits: np.ndarray) -> np.ndarray:
    e = np.exp(logits - logits.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def fit(sample: list[tuple[str, str]]) -> Model:
    """Learn from pairs of text and label; every fifth is kept for calibration."""
    labels = sorted({label for _, label in sample})
    if not labels:
        return Model([], np.zeros((BUCKETS, 0), np.float32), np.zeros(0), 1.0, 0.0)
    rng = np.random.default_rng(SEED)
    features = [text_features(text.encode()) for text, _ in sample]
    target = np.array([labels.index(label) for _, label in sample])
    kept = np.arange(len(sample)) % 5 == 4
    train = np.flatnonzero(~kept)
    embedding = rng.normal(0, 0.1, (BUCKETS, WIDTH)).astype(np.float32)
    layer = rng.normal(0, 0.3, (WIDTH, len(labels))).astype(np.float32)
    bias = np.zeros(len(labels), np.float32)
    epochs = max(EPOCHS, -(-STEPS * BATCH // max(1, len(train))))
    for epoch in range(epochs):
        rate = RATE * (1 - epoch / epochs)
        rng.shuffle(train)
        for start in range(0, len(train), BATCH):
            rows = train[start : start + BATCH]
            x = np.zeros((len(rows), BUCKETS), np.float32)
            for i, row in enumerate(rows):
                x[i, features[row][0]] = features[row][1]
            hidden = x @ embedding
            error = softmax(hidden @ layer + bias).astype(np.float32)
            error[np.arange(len(rows)), target[rows]] -= 1
            error /= len(rows)
            back = error @ layer.T
            layer -= 0.05 * rate * hidden.T @ error
            bias -= 0.05 * rate * error.sum(axis=0)
            used = np.flatnonzero(x.any(axis=0))
            embedding[used] -= rate * (x[:, used].T @ back)
    table = embedding @ layer
    check = np.flatnonzero(kept) if kept.any() else train
    logits = np.stack([features[i][1] @ table[features[i][0]] + bias for i in check])
    grid = np.geomspace(LOWEST_TEMPERATURE, 20, 60)
    temperature = min(grid, key=lambda t: -np.log(softmax(logits / t)[np.arange(len(check)), target[check]] + 1e-12).mean())
    best = softmax(logits / temperature)
    right = best.argmax(axis=1) == target[check]
    scores = np.sort(best.max(axis=1)[right])
    threshold = float(scores[int(REJECTED_SHARE * len(scores))]) if len(scores) else 0.0
    return Model(labels, table.astype(np.float32), bias.astype(np.float64), float(temperature), min(HIGHEST_THRESHOLD, 0.999 * threshold))


def logits_of(texts: list[bytes], model: Model) -> np.ndarray:
    """Logits of whole texts, a chunk of texts at a time."""
    data = np.frombuffer(b"".join(texts).lower(), np.uint8)
    ends = np.cumsum([len(t) for t in texts])
    starts = ends - [len(t) for t in texts]
    total = np.zeros((len(texts), len(model.labels)))
    grams = np.zeros(len(texts))
    for size in GRAMS:
        rows = model.table[gram_buckets(data, size)]
        n = np.maximum(ends - starts - size + 1, 0)
        some = np.flatnonzero(n)
        if len(some):
            # Sums over [start, last start of an n-gram], without those that cross into the next text.
            edges = np.stack([starts[some], starts[some] + n[some]], axis=1).ravel()
            rows = np.concatenate([rows, np.zeros((1, rows.shape[1]), np.float32)])
            total[some] += np.add.reduceat(rows, edges, axis=0, dtype=np.float64)[::2]
        grams += n
    return total / np.maximum(grams, 1)[:, None] + model.bias


def train(rows: DataFrame, *, label_col: str = "lang", text_col: str = "text", most_rows: int = SAMPLE_ROWS) -> Model:
    """Fit on a sample of at most ``most_rows`` labelled rows of at most ``SAMPLE_CHARS`` characters."""
    return fit(labelled_sample(rows, label_col, text_col, most_rows, SAMPLE_CHARS))


def _lettered(text_col: str) -> Column:
    return F.coalesce(F.col(text_col).rlike(r"\p{L}"), F.lit(False))


def _judged(text: pa.Array, lettered: pa.Array, model: Model) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Label, score and whether it is rejected, of each text."""
    known = np.array(lettered.to_pylist(), bool) & bool(model.labels)
    if model.labels:
        chances = softmax(logits_of(byte_texts(text), model) / model.temperature)
        best, score = chances.argmax(axis=1), chances.max(axis=1)
    else:
        best, score = np.zeros(len(known), int), np.zeros(len(known))
    score = np.where(known, np.minimum(score, 1.0), 0.0)
    return [model.labels[b] if k else UNKNOWN for b, k in zip(best, known)], score, ~known | (score < model.threshold)


def keep_known(docs: DataFrame, model: Model, *, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose language is not rejected, unchanged."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    flag = "_lettered" + "_" * max(map(len, docs.columns))  # longer than any column

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, text_col):
            _, _, rejected = _judged(batch.column(text_col), batch.column(flag), shared.value)
            yield batch.filter(pa.array(~rejected)).select(batch.schema.names[:-1])

    return docs.withColumn(flag, _lettered(text_col)).mapInArrow(tidy(keep), docs.schema)


def predict(docs: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, lang_pred, score and rejected, one row per row of ``docs``."""
    id_type = docs.schema[id_col].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(model)  # BUCKETS rows, whatever the size of the input

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            names, score, rejected = _judged(batch.column("text"), batch.column("lettered"), shared.value)
            columns = [batch.column("id"), pa.array(names, pa.string()), pa.array(score, pa.float64()), pa.array(rejected, pa.bool_())]
            yield pa.RecordBatch.from_arrays(columns, ["id", "lang_pred", "score", "rejected"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), _lettered(text_col).alias("lettered"))
    return rows.mapInArrow(tidy(judge), f"id {id_type}, lang_pred string, score double, rejected boolean").withColumnRenamed("id", id_col)
