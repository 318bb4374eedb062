"""Quality classifier: a byte-level convolutional network in numpy.

A text's bytes are cut into chunks of ``CHUNK`` that overlap by one filter, so every window of ``TAPS`` bytes on the stride lies in a
chunk and the chunks cover the whole text. Bytes become learned vectors; learned filters move over each chunk in steps of ``STRIDE``;
the response of each filter is rectified and max-pooled over the chunk. The maxima of all chunks are combined, by their mean and
their maximum over the text, in one logistic unit: one probability for a text of any length.

Trained on a bounded sample of labelled rows by stochastic gradient descent with momentum; the labels are drawn evenly and the unit's
bias is corrected for their shares in all labelled rows afterwards.

Defined results: null and empty texts are one chunk of padding and get that chunk's score; equal texts get equal scores, row by row;
ids may be null or repeated. Without labelled rows of both kinds the score is the share of label 1, or 0.5 without any. Only the id
and the results come back, so other columns cannot clash.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from buildscope.llm.common import byte_texts, chunks
from buildscope.llm.samples import labelled_sample, sampled_labels

CHUNK, TAPS, STRIDE = 512, 16, 4
WIDTH, FILTERS = 8, 24
SAMPLE_ROWS = 2_400
SAMPLE_CHARS = 8_000
# Steps of descent at least, however small the sample.
EPOCHS, STEPS = 6, 400
RATE, MOMENTUM, DECAY = 0.05, 0.9, 1e-4
BATCH = 32
SEED = 5
# Chunks that go through the filters at once.
CHUNKS_AT_ONCE = 256


class Model(NamedTuple):
    bytes: np.ndarray  # 256 x WIDTH
    filters: np.ndarray  # TAPS * WIDTH x FILTERS
    bias: np.ndarray
    unit: np.ndarray  # 2 * FILTERS
    offset: float


def cut(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Chunks of all texts, padded with zero bytes, and the number of each text's first chunk."""
    step = CHUNK - TAPS + STRIDE
    counts = np.array([max(1, -(-(len(t) - CHUNK) // step) + 1) for t in texts])
    firsts = np.cumsum(counts) - counts
    out = np.zeros((counts.sum(), CHUNK), np.uint8)
    for text, first, count in zip(texts, firsts, counts):
        if count == 1:
            out[first, : len(text)] = np.frombuffer(text, np.uint8)
        else:
            padded = np.frombuffer(text + bytes(step), np.uint8)
            out[first : first + count] = sliding_window_view(padded, CHUNK)[::step][:count]
    return out, firsts


def _windows(pieces: np.ndarray, model: Model) -> np.ndarray:
    """The vectors of each window of each chunk: chunks x windows x TAPS * WIDTH."""
    vectors = model.bytes[pieces].reshape(len(pieces), -1)
    return sliding_window_view(vectors, TAPS * WIDTH, axis=1)[:, :: STRIDE * WIDTH]


def _pooled(pieces: np.ndarray, model: Model) -> tuple[np.ndarray, np.ndarray]:
    """Rectified maximum of each filter over each chunk, and the window it is at."""
    windows = _windows(pieces, model)
    answers = (windows.reshape(-1, TAPS * WIDTH) @ model.filters).reshape(len(pieces), -1, FILTERS)
    at = answers.argmax(axis=1)
    return np.maximum(np.take_along_axis(answers, at[:, None], axis=1)[:, 0] + model.bias, 0), at


def _maxima(pieces: np.ndarray, model: Model) -> np.ndarray:
    answers = (_windows(pieces, model).reshape(-1, TAPS * WIDTH) @ model.filters).reshape(len(pieces), -1, FILTERS)
    return np.maximum(answers.max(axis=1) + model.bias, 0)


def _combined(pooled: np.ndarray, firsts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Mean and maximum over the chunks of each text, and the number of chunks."""
    counts = np.diff(np.append(firsts, len(pooled)))
    return np.concatenate([np.add.reduceat(pooled, firsts, axis=0) / counts[:, None], np.maximum.reduceat(pooled, firsts, axis=0)], axis=1), counts


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def fit(sample: list[tuple[str, int]], positive_share: float | None = None) -> Model:
    """Learn from pairs of text and label (1 or 0); ``positive_share`` is the share of label 1 among all labelled rows."""
    rng = np.random.default_rng(SEED)
    model = Model(
        rng.normal(0, 0.5, (256, WIDTH)).astype(np.float32),
        rng.normal(0, 1 / np.sqrt(TAPS * WIDTH), (TAPS * WIDTH, FILTERS)).astype(np.float32),
        np.zeros(FILTERS, np.float32),
        rng.normal(0, 0.1, 2 * FILTERS).astype(np.float32),
        0.0,
    )
    labels = np.array([label for _, label in sample], np.float32)
    drawn = float(labels.mean()) if len(labels) else 0.5
    share = drawn if positive_share is None else positive_share
    if not len(labels) or not 0 < drawn < 1:
        sure = np.log(max(share, 1e-6) / max(1 - share, 1e-6)) if len(labels) else 0.0
        return model._replace(unit=np.zeros(2 * FILTERS, np.float32), offset=float(sure))
    texts = [text.encode() for text, _ in sample]
    offset, order = 0.0, np.arange(len(texts))
    speed = [np.zeros_like(p) for p in model[:4]] + [0.0]
    epochs = max(EPOCHS, -(-STEPS * BATCH // len(order)))
    for epoch in range(epochs):
        rng.shuffle(order)
        rate = RATE * (1 - epoch / epochs)
        for start in range(0, len(order), BATCH):
            rows = order[start : start + BATCH]
            pieces, firsts = cut([texts[i] for i in rows])
            pooled, at = _pooled(pieces, model)
            both, counts = _combined(pooled, firsts)
            error = ((_sigmoid(both @ model.unit + offset) - labels[rows]) / len(rows)).astype(np.float32)
            text_of = np.repeat(np.arange(len(rows)), counts)
            by_mean = error[text_of, None] * model.unit[:FILTERS] / counts[text_of, None]
            highest = pooled == both[text_of, FILTERS:]
            back = (by_mean + np.where(highest, error[text_of, None] * model.unit[FILTERS:], 0)) * (pooled > 0)
            # Only the window at the maximum of a filter over a chunk has a share in the error.
            chunk, filt = np.nonzero(back)
            amount = back[chunk, filt].astype(np.float32)
            places = at[chunk, filt] * STRIDE
            taken = pieces[chunk[:, None], places[:, None] + np.arange(TAPS)]
            seen = model.bytes[taken].reshape(len(chunk), -1)
            spread = np.zeros((len(chunk), FILTERS), np.float32)
            spread[np.arange(len(chunk)), filt] = amount
            to_bytes = np.zeros_like(model.bytes)
            np.add.at(to_bytes, taken.ravel(), (spread @ model.filters.T).reshape(-1, WIDTH))
            slopes = [to_bytes, seen.T @ spread, back.sum(axis=0), both.T @ error, float(error.sum())]
            params = [*model[:4], offset]
            for i, slope in enumerate(slopes):
                speed[i] = MOMENTUM * speed[i] - rate * (slope + DECAY * params[i])
                params[i] = params[i] + speed[i]
            offset = params[4]
            model = Model(*params[:4], 0.0)
    # The sample holds the labels evenly; all labelled rows may not.
    shift = np.log(share / (1 - share)) - np.log(drawn / (1 - drawn)) if 0 < share < 1 else 0.0
    return model._replace(offset=float(offset + shift))


def scores(texts: list[bytes], model: Model) -> np.ndarray:
    pieces, firsts = cut(texts)
    pooled = np.concatenate([_maxima(pieces[i : i + CHUNKS_AT_ONCE], model) for i in range(0, len(pieces), CHUNKS_AT_ONCE)])
    return _sigmoid((_combined(pooled, firsts)[0] @ model.unit).astype(np.float64) + model.offset)


def train(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", most_rows: int = SAMPLE_ROWS) -> Model:
    """Fit on at most ``most_rows`` labelled texts of at most ``SAMPLE_CHARS`` characters; all labels are counted."""
    labels = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label")).filter("label IN (0, 1)")
    share = labels.agg(F.avg("label")).first()[0]
    # At most 4 * most_rows rows go to the documents, so no text is shuffled for the join.
    chosen = F.broadcast(sampled_labels(labels, most_rows))
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(chosen, "id")
    return fit(labelled_sample(rows, "label", "text", most_rows, SAMPLE_CHARS), share)


def predict(docs: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, score and predicted, one row per row of ``docs``."""
    id_type = docs.schema[id_col].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a few thousand numbers

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            score = scores(byte_texts(batch.column("text")), shared.value)
            columns = [batch.column("id"), pa.array(score, pa.float64()), pa.array((score >= 0.5).astype(np.int32), pa.int32())]
            yield pa.RecordBatch.from_arrays(columns, ["id", "score", "predicted"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(judge, f"id {id_type}, score double, predicted int").withColumnRenamed("id", id_col)
