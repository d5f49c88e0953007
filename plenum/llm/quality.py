"""Quality of documents by a byte-level convolutional network in numpy.

A document's bytes are cut into chunks of 256, each overlapping the one before by half, so that
the whole document is covered. Learned filters slide over a chunk; the largest response of each
filter, squashed, stands for the chunk; a linear layer gives the chunk's logit, and the mean
of the logits the document's probability.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plenum.llm.common import blocks_of, save, texts, utf8

HALF, WIDTH, FILTERS = 128, 5, 32


def halves(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes laid out in rows of HALF (zeros behind each document), and each document's rows, two at least."""
    n = np.maximum(2, -(-np.diff(offsets) // HALF))
    begins = np.cumsum(n) - n
    out = np.zeros(int(n.sum()) * HALF, np.uint8)
    lengths = np.diff(offsets)
    out[np.arange(len(data)) + np.repeat(begins * HALF - offsets[:-1], lengths)] = data
    return out.reshape(-1, HALF), n


def responses(rows: np.ndarray, n: np.ndarray, filters: np.ndarray, step: int = 256) -> np.ndarray:
    """The largest response of each filter that begins in each row; n: rows of each document.

    Behind a row stand the first bytes of the document's next row, behind its last row zeros: what
    stands beside a document in a batch has no say in its responses.
    """
    long = np.zeros((len(rows), HALF + WIDTH - 1), np.uint8)
    long[:, :HALF] = rows
    long[:-1, HALF:] = rows[1:, : WIDTH - 1]
    long[np.cumsum(n) - 1, HALF:] = 0
    out = np.empty((len(rows), filters.shape[2]), np.float32)
    for at in range(0, len(rows), step):
        part = long[at : at + step]
        total = filters[0].take(part[:, :HALF], 0)
        for k in range(1, WIDTH):
            total += filters[k].take(part[:, k : k + HALF], 0)
        out[at : at + step] = total.max(1)
    return out


def chunk_logits(peaks: np.ndarray, n: np.ndarray, model: dict) -> tuple[np.ndarray, np.ndarray]:
    """Logits of chunks (two neighbouring rows of a document) and each chunk's document."""
    doc = np.repeat(np.arange(len(n)), n)
    first = np.flatnonzero(doc[1:] == doc[:-1])
    return np.tanh(np.maximum(peaks[first], peaks[first + 1])) @ model["w"] + model["b"], doc[first]


def probabilities(column, model: dict) -> np.ndarray:
    rows, n = halves(*utf8(column))
    if not len(n):
        return np.zeros(0)
    logits, doc = chunk_logits(responses(rows, n, model["filters"]), n, model)
    return 1 / (1 + np.exp(-np.clip(np.bincount(doc, logits) / np.bincount(doc), -30, 30)))


def chunks(data: np.ndarray) -> np.ndarray:
    """All chunks of a document, each with the WIDTH - 1 bytes behind it, zeros behind the last byte."""
    n = max(1, -(-(len(data) - HALF) // HALF))
    padded = np.zeros((n + 1) * HALF + WIDTH - 1, np.uint8)
    padded[: len(data)] = data
    return np.lib.stride_tricks.sliding_window_view(padded, 2 * HALF + WIDTH - 1)[::HALF]


def peaks(x: np.ndarray, filters: np.ndarray, step: int = 256) -> tuple[np.ndarray, np.ndarray]:
    """Where in each chunk each filter's response is largest, and that response; `step` chunks at once."""
    at, best = np.empty((len(x), filters.shape[2]), np.int64), np.empty((len(x), filters.shape[2]), np.float32)
    for k in range(0, len(x), step):
        part = x[k : k + step]
        total = sum(filters[w].take(part[:, w : w + 2 * HALF], 0) for w in range(WIDTH))
        at[k : k + step] = total.argmax(1)
        best[k : k + step] = np.take_along_axis(total, at[k : k + step, None], 1)[:, 0]
    return at, best


def gradients(x: np.ndarray, owner: np.ndarray, labels: np.ndarray, weight: np.ndarray, model: dict) -> dict:
    """Of the weighted log-loss of a batch of documents; x: all their chunks, owner: each chunk's document, ascending."""
    at, peak = peaks(x, model["filters"])
    peak = np.tanh(peak)
    n = np.bincount(owner)
    p = 1 / (1 + np.exp(-np.bincount(owner, peak @ model["w"] + model["b"]) / n))
    g = ((p - labels) * weight / len(n) / n)[owner].astype(np.float32)
    out = {"w": peak.T @ g, "b": g.sum(keepdims=True), "filters": np.zeros_like(model["filters"])}
    back = g[:, None] * model["w"] * (1 - peak**2)
    for k in range(WIDTH):
        np.add.at(out["filters"][k], (np.take_along_axis(x, at + k, 1), np.arange(FILTERS)[None]), back)
    return out


def train(rows: list[str], labels: np.ndarray, seed: int = 7, epochs: int = 6, rate: float = 0.01) -> dict:
    """Filters and weights from labelled texts by Adam, 240 steps at least; an epoch reads every chunk of every text.

    Filters begin as strings of bytes found in the texts. One class alone gives a constant score.
    """
    rng = np.random.default_rng(seed)
    labels = np.asarray(labels, np.float32)
    model = {"filters": rng.normal(0, 0.05, (WIDTH, 256, FILTERS)).astype(np.float32), "w": rng.normal(0, 0.1, FILTERS).astype(np.float32), "b": np.zeros(1, np.float32)}
    data = [np.frombuffer(t.encode(), np.uint8) for t in rows]
    if not len(data):
        return model
    prior = float(np.clip(labels.mean(), 0.01, 0.99))
    model["b"][0] = np.log(prior / (1 - prior))
    for f in range(FILTERS):
        d = data[rng.integers(len(data))]
        if len(d) >= WIDTH:
            at = rng.integers(len(d) - WIDTH + 1)
            model["filters"][np.arange(WIDTH), d[at : at + WIDTH], f] += 0.4
    model["filters"] -= 0.1
    moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in model.items()}
    step, weight = 0, np.where(labels > 0, 0.5 / max(prior, 0.1), 0.5 / max(1 - prior, 0.1))
    for _ in range(max(epochs, -(-240 * 64 // len(data)))):
        for batch in np.array_split(rng.permutation(len(data)), max(1, len(data) // 64)):
            own = [chunks(data[k]) for k in batch]
            grads = gradients(np.concatenate(own), np.repeat(np.arange(len(batch)), [len(x) for x in own]), labels[batch], weight[batch], model)
            step += 1
            for name, value in model.items():
                a, b = moments[name]
                a += 0.1 * (grads[name] - a)
                b += 0.01 * (grads[name] ** 2 - b)
                value -= rate * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.99**step)) + 1e-6)
    return model


def learn(docs: DataFrame, labels: DataFrame, most: int = 2500) -> dict:
    """The network from labelled documents: at most `most` of them, those with the least hash of id.

    labels(doc_id, quality); rows without a label teach nothing. Training runs in one task, on
    the whole texts of this bounded sample; scoring covers every document.
    """
    marked = labels.where("quality IS NOT NULL").groupBy("doc_id").agg(F.max("quality").cast("int").alias("quality"))
    picked = docs.select("doc_id").distinct().join(marked, "doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    sample = texts(docs).join(F.broadcast(save(picked, "sample")), "doc_id").repartition(1)  # `most` rows of two numbers
    names = ("filters", "w", "b")

    def fit(batches):
        found = sorted(tuple(r.values()) for batch in batches for r in batch.to_pylist())
        model = train([r[1] for r in found], np.array([r[2] for r in found]))
        yield pa.RecordBatch.from_arrays([pa.array([model[n].astype("<f4").tobytes()]) for n in names], list(names))

    row = sample.select("doc_id", "text", "quality").mapInArrow(fit, "filters binary, w binary, b binary").first()
    shape = {"filters": (WIDTH, 256, FILTERS), "w": (FILTERS,), "b": (1,)}
    empty = train([], np.zeros(0))
    return {n: np.frombuffer(row[n], "<f4").reshape(shape[n]) for n in names} if row else empty


def score(docs: DataFrame, model: dict) -> DataFrame:
    """doc_id and score (0 to 1, higher: better) of every whole text; null texts count as empty.

    A score is of the text alone, however long and whatever rows stand beside it. Repeated rows
    give repeated results; an empty table gives an empty one; other columns are not looked at.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def predict(batches):
        for table in blocks_of(batches, 1 << 20):
            yield pa.RecordBatch.from_arrays([table["doc_id"].combine_chunks(), pa.array(probabilities(table["text"], sent.value))], ["doc_id", "score"])

    return texts(docs).mapInArrow(predict, "doc_id long, score double")
