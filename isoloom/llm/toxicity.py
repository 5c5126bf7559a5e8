"""Toxicity by multiple-instance learning: sentences are the instances, documents carry the labels.

A sentence's logit is a bias plus the weights of its hashed words. A document is toxic if any of
its sentences is, so its score is the noisy-or of the sentence scores, 1 - prod(1 - p_s). The
weights are trained through that noisy-or from document labels alone, and the sentence scores
then say where the offence stands.

Defined results: a null or empty text has no sentence and gets the score of the bias alone; a
null doc_id is scored like any other, never used for training, and counts as not held out;
repeated rows are scored each on its own and equal texts get equal scores; an empty table gives no
rows; without usable labels every weight is zero. Further columns of the input are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from isoloom.llm import textkernel as K
from isoloom.runtime import prepare, returned_memory

BUCKET_BITS = 18
#: Labelled documents the model is fitted on at most: the first in the order of a hash of doc_id.
SAMPLE_ROWS = 4000
#: Bytes of text of that sample at most, taken in the same order; a text that does not fit is passed over.
SAMPLE_BYTES = 48_000_000
EPOCHS = 200
#: Bytes of the sample worked on at a time.
FIT_BYTES = 1 << 18
#: Step of the gradient, and the pull of every weight to zero.
RATE = 0.5
SPARSITY = 0.6
THRESHOLD = 0.7

#: A word is a run of ASCII letters, digits and bytes of other letters.
_SPACE = np.ones(256, bool)
_SPACE[48:58] = _SPACE[65:91] = _SPACE[97:123] = False
_SPACE[128:] = False
#: A word's features: itself (0) and its first bytes, so that inflected forms share what their stem says.
FEATURES = (0, 4, 5, 6)
_BREAK = np.zeros(256, np.int32)
_BREAK[[10, 33, 46, 63]] = 1


@dataclass
class Model:
    """Weight of each word bucket, and the logit of a sentence without weighty words."""

    weights: np.ndarray
    bias: float
    prior: float


def sentences(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of each feature of each word, first word of each sentence, sentences of each document (as bounds), and each sentence's byte span."""
    starts, ends, bounds = K.word_spans(buf, offsets, _SPACE)
    if not len(starts):
        none = np.zeros(0, np.int64)
        return np.zeros((len(FEATURES), 0), np.int64), none, np.zeros(len(offsets), np.int64), none, none
    prefix = K.prefix_hash(buf, lower=True)
    buckets = np.stack([(K.span_hash(prefix, starts, np.minimum(starts + n, ends) if n else ends) >> K.U(64 - BUCKET_BITS)).astype(np.int64) for n in FEATURES])
    breaks = np.cumsum(_BREAK[buf], dtype=np.int32)[starts]
    new = np.ones(len(starts), bool)
    new[1:] = breaks[1:] != breaks[:-1]
    new[bounds[:-1][bounds[:-1] < len(starts)]] = True
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(starts)) - 1
    return buckets, first, np.searchsorted(first, bounds), starts[first], ends[last]


def noisy_or(model: Model, buckets: np.ndarray, first: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Scores of the documents and of their sentences."""
    n_docs = len(bounds) - 1
    if not len(first):
        return np.full(n_docs, model.prior), np.zeros(0)
    z = np.add.reduceat(model.weights[buckets].sum(axis=0), first) + model.bias
    survive = -np.logaddexp(0, z)  # log(1 - p) of each sentence
    total = np.zeros(n_docs)
    full = bounds[1:] > bounds[:-1]
    total[full] = np.add.reduceat(survive, bounds[:-1][full])
    score = -np.expm1(total)
    score[~full] = model.prior
    return score, 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def fit(texts: pa.Array, labels: np.ndarray, epochs: int = EPOCHS) -> Model:
    """Full-batch Adagrad on the likelihood of the document labels under the noisy-or. Deterministic."""
    y = labels.astype(float)
    prior = float((y.sum() + 1) / (len(y) + 2)) if len(y) else 0.5
    size, low = 1 << BUCKET_BITS, (1 << BUCKET_BITS) - 1
    weights = np.zeros(size)
    nothing = Model(weights, float(np.log(0.001)), prior)
    if not len(y) or y.min() == y.max():
        return nothing
    # A word counts once in a sentence, and its document once in what is counted of the word. Neither crosses a chunk.
    chunks, doc_of, seen, hits, n_sents = [], [], np.zeros(size), np.zeros(size), 0
    for lo, hi, buf, offsets in K.text_chunks(texts, FIT_BYTES):
        b, f, bounds, _, _ = sentences(buf, offsets)
        if not len(f):
            continue
        docs = np.repeat(np.arange(lo, hi), np.diff(bounds))
        sentence = np.repeat(np.arange(len(f)), np.diff(np.append(f, b.shape[1])))
        pairs = np.unique(np.concatenate([np.unique(docs[sentence] << BUCKET_BITS | x) for x in b]))
        seen += np.bincount(pairs & low, minlength=size)
        hits += np.bincount(pairs & low, y[pairs >> BUCKET_BITS], size)
        chunks.append(np.unique(np.concatenate([np.unique(sentence << BUCKET_BITS | x) for x in b])) + (n_sents << BUCKET_BITS))
        doc_of.append(docs)
        n_sents += len(f)
    if not n_sents:
        return nothing
    doc_of = np.concatenate(doc_of)
    # A word of few documents says more about them than about toxicity. What counts as few follows the
    # toxic documents where these are few, or none of their words could take part.
    few = max(2, min(len(y) // 200, int(y.sum()) // 10))
    worth = (seen >= few) & (hits >= 2) & (hits > min(0.5, 3 * y.mean()) * seen)
    once = np.concatenate([c[worth[c & low]] for c in chunks])
    del chunks
    sentence, words = once >> BUCKET_BITS, once & low
    used, words = np.unique(words, return_inverse=True)
    w, bias = np.zeros(len(used)), -7.0
    step = RATE / np.sqrt(seen[used] + 1.0)
    weight = np.where(y > 0, 0.5 / y.mean(), 0.5 / (1 - y.mean()))
    for _ in range(epochs):
        z = np.bincount(sentence, w[words], n_sents) + bias
        p = 1 / (1 + np.exp(-np.clip(z, -40, 40)))
        total = np.bincount(doc_of, np.log1p(-np.minimum(p, 1 - 1e-12)), len(y))
        q = np.maximum(-np.expm1(total), 1e-3)
        pull = np.where(y > 0, -(1 - q) / q, 1.0) * weight
        gz = p * pull[doc_of]
        w = np.maximum(w - step * (np.bincount(words, gz[sentence], len(used)) + SPARSITY), 0)
        bias = min(max(bias - 6.0 * gz.sum() / len(y), -14.0), -4.0)
    weights[used] = w
    return Model(weights, bias, prior)


def held_out(doc_id) -> F.Column:
    """True for the fold of documents whose labels are never learnt."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, sample_bytes: int = SAMPLE_BYTES, epochs: int = EPOCHS) -> Model:
    """A model from at most `sample_rows` labelled documents and `sample_bytes` of their text, outside the held-out fold.

    The sample is bounded by both parameters whatever the size of the tables: the ids are chosen
    first, so only their texts are read into the driver, one for each id (the smallest, where rows repeat it).
    """
    usable = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    hashed = F.xxhash64("doc_id")
    picked = usable.groupBy("doc_id").agg(F.max("toxic").alias("_y")).orderBy(hashed, "doc_id").limit(sample_rows)
    texts = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id").groupBy("doc_id", "_y").agg(F.min("text").alias("text"))
    sizes = texts.select("doc_id", hashed.alias("_h"), F.coalesce(F.octet_length("text"), F.lit(0)).alias("_b")).toPandas().sort_values(["_h", "doc_id"])
    fits, total = [], 0
    for doc, size in zip(sizes["doc_id"].tolist(), sizes["_b"].tolist(), strict=True):
        if total + size <= sample_bytes:
            fits.append(doc)
            total += size
    if len(fits) < len(sizes):
        texts = texts.where(F.col("doc_id").isin(fits))
    rows = texts.select("doc_id", "text", "_y").toArrow().sort_by("doc_id")
    model = fit(rows.column("text").combine_chunks().cast(pa.large_string()), rows.column("_y").to_numpy() > 0, epochs)
    del rows
    returned_memory()
    return model


def score(docs: DataFrame, model: Model, keep: tuple[str, ...] = ("doc_id",), locate: bool = False) -> DataFrame:
    """Columns `keep` of every row, its score, and with `locate` the byte span of its most toxic sentence and that one's score."""
    spark = prepare(docs.sparkSession)
    shipped = spark.sparkContext.broadcast((model.weights.astype(np.float32), model.bias, model.prior))
    names = list(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, bias, prior = shipped.value
        m = Model(weights, bias, prior)
        for batch in batches:
            scores, spans = np.zeros(batch.num_rows), np.zeros((batch.num_rows, 3))
            for lo, hi, buf, offsets in K.text_chunks(batch.column("_text")):
                b, f, bounds, s0, s1 = sentences(buf, offsets)
                scores[lo:hi], each = noisy_or(m, b, f, bounds)
                if locate:
                    for i in range(hi - lo):
                        if bounds[i + 1] > bounds[i]:
                            k = bounds[i] + int(np.argmax(each[bounds[i] : bounds[i + 1]]))
                            spans[lo + i] = s0[k] - offsets[i], s1[k] - offsets[i], each[k]
            columns = [batch.column(n) for n in names] + [pa.array(np.clip(np.round(scores, 6), 0, 1))]
            if locate:
                columns += [pa.array(spans[:, 0].astype(np.int64)), pa.array(spans[:, 1].astype(np.int64)), pa.array(spans[:, 2])]
            yield pa.RecordBatch.from_arrays(columns, names=[*names, "score", *(["worst_start", "worst_end", "worst_score"] if locate else [])])

    schema = ", ".join([*(f"`{n}` {docs.schema[n].dataType.simpleString()}" for n in names), "score double", *(["worst_start long", "worst_end long", "worst_score double"] if locate else [])])
    return docs.select(*names, F.col("text").alias("_text")).mapInArrow(run, schema)


def scored(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    out = score(docs, train(docs, labels))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
