"""Operator 2: toxicity by multiple-instance learning.

A document is a bag of sentences. Each sentence has a probability of being offensive, a
logistic function of its word features; a document's score is the noisy-or of its sentences,
``1 - prod(1 - p)``. Only documents carry labels; the sentence model is trained through the
noisy-or, and then points at the offending sentences.

* Features: whole lower-cased words, and the first five bytes of longer words.
* Vocabulary: for every feature the labelled documents with it are counted by label (Spark
  aggregation); the ``n_features`` with the largest chi-square, of ``least_chi`` at least, are
  kept (a bounded top-k).
* Training: full-batch Adam steps. Each step is one Spark job over the training documents'
  feature lists (kept features only, written to the shared folder): tasks return summed
  gradients of ``n_features + 1`` numbers. The labelled rows used for fitting are a hash
  sample of at most about ``max_rows`` labels (a documented bound); a row's label is the
  largest of its document's labels.
* Scoring: one pass over all whole texts, no shuffle; the model is broadcast (fixed size).

A sentence without any kept feature carries no evidence and has probability 0.

Defined results: null and empty texts score 0; documents without a label are scored like all
others; null labels are ignored; repeated documents are each scored; without any positive
or any negative training label the model is empty and every score is 0; an empty table
gives no rows; other columns are ignored by the score, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from airmetrics.llm.common import stored, text_of
from airmetrics.llm.segments import mix, plain_words, row_slices, segment_hash, text_bytes, words_of

_SLICE = 1 << 21
_STEM = 5
_ENDS = np.zeros(256, bool)
_ENDS[[ord(c) for c in ".!?\n"]] = True


def held_out(doc_id: Column) -> Column:
    """Rows that no label is learned from: crc32 of the id as text, modulo 3, is 1."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def _features(data: np.ndarray, offsets: np.ndarray):
    """(feature hash, word number) of words and stems; the words; the sentence number of each word."""
    words = words_of(data, offsets, plain_words())
    if len(words.hash) == 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), words, np.zeros(0, np.int64)
    ends = _ENDS[data].copy()
    stops = np.cumsum(ends)
    sentence = stops[words.start]
    long = np.flatnonzero(words.end - words.start > _STEM)
    at = (words.start[long][:, None] + np.arange(_STEM)).reshape(-1)
    stem = plain_words()[data[at]]
    stems = mix(segment_hash(stem, np.arange(len(long)) * _STEM, np.full(len(long), _STEM)) ^ np.uint64(0xA5A5))
    return (np.concatenate([words.hash, stems]), np.concatenate([np.arange(len(words.hash)), long]), words, sentence)


@dataclass
class Model:
    """Kept feature hashes (sorted), their weights and the sentence bias."""

    features: np.ndarray
    weights: np.ndarray
    bias: float

    def lookup(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not hasattr(self, "_seen"):
            self._seen = np.zeros(1 << 20, bool)
            self._seen[(self.features >> np.uint64(44)).astype(np.int64)] = True
        at = np.flatnonzero(self._seen[(h >> np.uint64(44)).view(np.int64)])
        if not len(at):
            return at, at
        which = np.minimum(np.searchsorted(self.features, h[at]), len(self.features) - 1)
        ok = self.features[which] == h[at]
        return at[ok], which[ok]


def _evidence(model: Model, data: np.ndarray, offsets: np.ndarray):
    """Distinct (row, sentence, feature) of the kept features, and the words."""
    h, word, words, sentence = _features(data, offsets)
    if not len(h):
        return np.zeros((3, 0), np.int64), words
    at, which = model.lookup(h)
    word = word[at]
    row = np.searchsorted(words.row_first, word, side="right") - 1
    return np.unique(np.stack([row, sentence[word], which]), axis=1), words


def feature_counts(train: DataFrame) -> DataFrame:
    """(feature, positives, negatives): labelled documents that hold each feature; ``train`` has text, toxic."""

    def run(batches):
        for batch in batches:
            data, offsets = text_bytes(batch.column(0))
            label = np.array(batch.column(1).to_pylist(), np.int64)
            for i, j in row_slices(offsets, _SLICE):
                h, word, words, _ = _features(data[offsets[i]:offsets[j]], offsets[i:j + 1] - offsets[i])
                row = np.searchsorted(words.row_first, word, side="right") - 1
                order = np.lexsort((row, h))
                h, row = h[order], row[order]
                new = np.ones(len(h), bool)
                new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
                f, back = np.unique(h[new], return_inverse=True)
                positive = np.bincount(back, label[i:j][row[new]], len(f)).astype(np.int64)
                total = np.bincount(back, minlength=len(f))
                yield pa.RecordBatch.from_arrays([pa.array(f.view(np.int64)), pa.array(positive),
                                                  pa.array(total - positive)], names=["f", "pos", "neg"])

    return (train.select("text", "toxic").mapInArrow(run, "f long, pos long, neg long")
            .groupBy("f").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg")))


def _bags(model: Model):
    """mapInArrow function: (text, toxic) -> label and the evidence of each document as sentence and feature lists."""

    def run(batches):
        for batch in batches:
            data, offsets = text_bytes(batch.column(0))
            label = batch.column(1)
            for i, j in row_slices(offsets, _SLICE):
                (row, sentence, which), _ = _evidence(model, data[offsets[i]:offsets[j]], offsets[i:j + 1] - offsets[i])
                cut = np.searchsorted(row, np.arange(j - i + 1))
                lists = [pa.ListArray.from_arrays(pa.array(cut, pa.int32()), pa.array(v, pa.int64())) for v in (sentence, which)]
                yield pa.RecordBatch.from_arrays([label.slice(i, j - i).cast(pa.int64()), *lists],
                                                 names=["toxic", "sentence", "feature"])

    return run


def _gradient(weights: np.ndarray, bias: float, weight_of: tuple[float, float]):
    """mapInArrow function: one row per task: loss, and gradient by weights (then the bias)."""

    def run(batches):
        n = len(weights)
        grad, loss = np.zeros(n + 1), 0.0
        for batch in batches:
            label = batch.column(0).to_numpy()
            lists = batch.column(1)
            rows = np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))
            sentence, which = lists.flatten().to_numpy(), batch.column(2).flatten().to_numpy()
            if not len(rows):
                continue
            new = np.ones(len(rows), bool)
            new[1:] = (rows[1:] != rows[:-1]) | (sentence[1:] != sentence[:-1])
            group = np.cumsum(new) - 1
            z = np.clip(bias + np.bincount(group, weights[which]), -30, 30)
            p = 1 / (1 + np.exp(-z))
            own = rows[new]
            log_none = np.bincount(own, -np.logaddexp(0, z), len(lists))  # log of prod(1 - p)
            some = np.maximum(-np.expm1(log_none), 1e-12)
            docs = np.bincount(own, minlength=len(lists)) > 0
            each = np.where(label == 1, weight_of[1], weight_of[0])
            loss -= float(np.sum(np.where(label == 1, np.log(some), log_none)[docs] * each[docs]))
            # d(-log L)/dz: p for a negative document, -p * prod(1-p) / (1 - prod(1-p)) for a positive one
            slope = np.where(label == 1, -np.exp(log_none) / some, 1.0) * each
            by_sentence = p * slope[own]
            grad[:n] += np.bincount(which, by_sentence[group], n)
            grad[n] += by_sentence.sum()
        yield pa.RecordBatch.from_arrays([pa.array([loss]), pa.array([grad.tobytes()], pa.binary())], names=["loss", "grad"])

    return run


def train(docs: DataFrame, labels: DataFrame, max_rows: int = 16_000, n_features: int = 2048, least_docs: int = 4,
          least_chi: float = 12.0, steps: int = 40, rate: float = 0.3, l2: float = 0.3, id_col: str = "doc_id", text_col: str = "text",
          label_col: str = "toxic") -> Model:
    """Fit the sentence model from the document labels that are not held out."""
    known = (labels.select(labels[id_col].alias("id"), labels[label_col].cast("int").alias("toxic"))
             .where(F.col("toxic").isin(0, 1) & F.col("id").isNotNull() & ~held_out(F.col("id")))
             .groupBy("id").agg(F.max("toxic").alias("toxic")))
    total = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}
    empty = Model(np.zeros(0, np.uint64), np.zeros(0), -8.0)
    if not total.get(0) or not total.get(1):
        return empty
    share = {c: min(1.0, max_rows / 2 / total[c]) for c in (0, 1)}  # a hash sample of each class
    spread = (F.xxhash64("id", F.lit(17)).bitwiseAND((1 << 30) - 1)) / float(1 << 30)
    sample = known.where(spread < F.when(F.col("toxic") == 1, share[1]).otherwise(share[0]))
    # about max_rows rows by construction, so the labels can go to the documents
    bags = docs.select(docs[id_col].alias("id"), text_of(docs, text_col).alias("text")).join(
        F.broadcast(sample), "id").select("text", "toxic")
    bags = stored(bags, "toxicity-train")
    n = {r["toxic"]: r["count"] for r in bags.groupBy("toxic").count().collect()}
    if not n.get(0) or not n.get(1):
        return empty
    pos, neg, every = F.col("pos"), F.col("neg"), float(n[0] + n[1])
    chi = every * (pos * (n[0] - neg) - neg * (n[1] - pos)) ** 2 / (
        (pos + neg) * (every - pos - neg + 0.5) * float(n[0]) * float(n[1]))
    top = (feature_counts(bags).where(pos + neg >= least_docs).withColumn("chi", chi).where(F.col("chi") >= least_chi)
           .orderBy(F.col("chi").desc(), "f").limit(n_features).collect())  # bounded by n_features
    if not top:
        return empty
    rows = sorted((r["f"] & (2**64 - 1), r["pos"], r["neg"]) for r in top)
    odds = np.array([np.log((p + 0.1) / (n[1] + 0.2)) - np.log((q + 0.1) / (n[0] + 0.2)) for _, p, q in rows])
    model = Model(np.array([r[0] for r in rows], np.uint64), np.clip(odds, -3, 3), -3.0)
    sc = docs.sparkSession.sparkContext
    shared = sc.broadcast(model)
    data = stored(bags.mapInArrow(lambda it: _bags(shared.value)(it), "toxic long, sentence array<long>, feature array<long>"),
                  "toxicity-bags").coalesce(sc.defaultParallelism)
    value = np.append(model.weights, model.bias)
    first, second = np.zeros_like(value), np.zeros_like(value)
    weight_of = (0.5 * every / n[0], 0.5 * every / n[1])
    for step in range(1, steps + 1):
        parts = data.mapInArrow(_gradient(value[:-1], float(value[-1]), weight_of), "loss double, grad binary").collect()
        grad = np.sum([np.frombuffer(p["grad"]) for p in parts], axis=0)
        grad[:-1] += l2 * value[:-1]
        grad /= every
        first = 0.9 * first + 0.1 * grad
        second = 0.99 * second + 0.01 * grad * grad
        value = value - rate * (first / (1 - 0.9 ** step)) / (np.sqrt(second / (1 - 0.99 ** step)) + 1e-6)
    return Model(model.features, value[:-1], float(value[-1]))


def score(docs: DataFrame, model: Model, threshold: float = 0.7, offending: float = 0.5, text_col: str = "text") -> DataFrame:
    """One row per document: ``row`` (struct of its columns), score, predicted, n_sentences, offending
    (byte start and end of the sentences with a probability of ``offending`` or more, and that probability)."""
    from pyspark.sql.types import StructField, StructType, _parse_datatype_string

    rest = _parse_datatype_string(
        "score double, predicted int, n_sentences long, offending array<struct<start:long,end:long,p:double>>")
    schema = StructType([StructField("row", docs.schema, False), *rest.fields])
    shared = docs.sparkSession.sparkContext.broadcast(model)
    span = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("p", pa.float64())])

    def run(batches):
        m: Model = shared.value
        for batch in batches:
            data, offsets = text_bytes(batch.column(1))
            scores, sentences, spans = [], [], []
            for i, j in row_slices(offsets, _SLICE):
                part, rel = data[offsets[i]:offsets[j]], offsets[i:j + 1] - offsets[i]
                (row, sentence, which), words = _evidence(m, part, rel) if len(m.features) else (np.zeros((3, 0), np.int64), None)
                new = np.ones(len(row), bool)
                new[1:] = (row[1:] != row[:-1]) | (sentence[1:] != sentence[:-1])
                group = np.cumsum(new) - 1
                z = np.clip(m.bias + np.bincount(group, m.weights[which]), -30, 30) if len(row) else np.zeros(0)
                own = row[new]
                scores.append(np.abs(np.expm1(np.bincount(own, -np.logaddexp(0, z), j - i))))
                stops = np.flatnonzero(_ENDS[part])
                sentences.append(np.searchsorted(stops, rel[1:]) - np.searchsorted(stops, rel[:-1]) + (np.diff(rel) > 0))
                found: list[list] = [[] for _ in range(j - i)]
                p = 1 / (1 + np.exp(-z))
                for g in np.flatnonzero(p >= offending):
                    s, r = int(sentence[new][g]), int(own[g])
                    begin = max(int(stops[s - 1]) + 1 if s else 0, int(rel[r]))
                    end = min(int(stops[s]) + 1 if s < len(stops) else len(part), int(rel[r + 1]))
                    found[r].append({"start": begin - int(rel[r]), "end": end - int(rel[r]), "p": float(p[g])})
                spans += found
            got = np.concatenate(scores) if scores else np.zeros(0)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(got), pa.array((got >= threshold).astype(np.int32)),
                 pa.array(np.concatenate(sentences) if sentences else np.zeros(0, np.int64), pa.int64()),
                 pa.array(spans, pa.list_(span))], names=["row", "score", "predicted", "n_sentences", "offending"])

    return docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), text_of(docs, text_col).alias("text")
                       ).mapInArrow(run, schema)
