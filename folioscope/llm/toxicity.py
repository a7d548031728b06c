"""Toxicity grades by cumulative-link ordinal regression on sparse text features.

Grades are ordered: ``P(grade > k) = sigmoid(w.x - t_k)`` with one weight vector
for all thresholds ``t_k``. A text's features are its distinct words, word
beginnings, and beginnings that several of its words share, as one word may begin
like an inflected stem by chance; only those that toxic labelled documents hold far more often enter
the model. The score is the expected grade, the sum of ``P(grade > k)``; with labels
of 0 and 1 there is one threshold and it is the probability of being toxic.
"""

from __future__ import annotations

import functools
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.llm.common import SMALL_MEMO_BYTES, Memo, forget_others, give_back, id_text, materialize, slices

#: Bounds of what fitting collects: labelled documents (the first by hash of their id) and features.
SAMPLE, FEATURES = 12_000, 4_096
#: Word beginnings that count as features besides whole words, and the fewest toxic documents with a feature.
PREFIXES = (4, 5, 6)
LEAST_DOCUMENTS, LEAST_LOG_ODDS = 4, 2.0
#: Documents of this expected grade and more are rejected.
REJECT = 0.5
_WORD = re.compile(r"[^\W\d_]+")


def feature_keys(word: str) -> list[int]:
    """Hashes of a lower-case word and its beginnings, as signed 64-bit numbers."""
    names = ["w" + word, *(f"{n}{word[:n]}" for n in PREFIXES if len(word) > n)]
    return [xxhash.xxh3_64_intdigest(x) - (1 << 63) for x in names]


def shared_keys(word: str) -> list[int]:
    """Hashes of a word's beginnings as features that need a second word with the same one."""
    return [xxhash.xxh3_64_intdigest(f"+{n}{word[:n]}") - (1 << 63) for n in PREFIXES if len(word) > n]


def text_keys(words: set[str]) -> set[int]:
    """All features of a text's distinct lower-case words."""
    found, once = set(), set()
    for w in words:
        found.update(feature_keys(w))
        shared = shared_keys(w)
        found.update(once.intersection(shared))
        once.update(shared)
    return found


def text_features(docs: DataFrame) -> DataFrame:
    """``docs`` of (id, text, grade) as (id, grade, features), the distinct features of each text."""

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x in slices(batch):
                lists = [sorted(text_keys(set(_WORD.findall(t.lower())))) for t in x.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([x.column(0), x.column(2), pa.array(lists, pa.list_(pa.int64()))], ["id", "grade", "features"])

    kind = docs.schema["id"].dataType.simpleString()
    return docs.select("id", "text", F.col("grade").cast("int")).mapInArrow(extract, f"id {kind}, grade int, features array<long>")


@dataclass(frozen=True)
class Model:
    """Weights by feature and the thresholds in ascending order."""

    weights: dict[int, float]
    thresholds: tuple[float, ...]

    def expected(self, total: float) -> float:
        """The expected grade for a sum of weights."""
        return sum(1.0 / (1.0 + math.exp(min(700.0, t - total))) for t in self.thresholds)


def fit_ordinal(rows: list[np.ndarray], grades: np.ndarray, n_features: int, levels: int, penalty: float = 1e-3, steps: int = 400) -> tuple[np.ndarray, np.ndarray]:
    """Weights and thresholds that maximise the penalised likelihood, by Adam on all rows.

    ``rows``: feature numbers of each document; ``grades``: 0 to ``levels``. Thresholds
    are a first one and positive gaps, so they stay ordered.
    """
    n = len(rows)
    doc = np.repeat(np.arange(n), [len(r) for r in rows])
    col = np.concatenate(rows).astype(np.int64) if len(doc) else np.zeros(0, np.int64)
    w, first, gaps = np.zeros(n_features), 1.0, np.zeros(levels - 1)
    parameters = np.concatenate([w, [first], gaps])
    m, v = np.zeros_like(parameters), np.zeros_like(parameters)

    def sigmoid(z: np.ndarray) -> np.ndarray:
        return 0.5 * (1 + np.tanh(z / 2))

    for step in range(1, steps + 1):
        w, t = parameters[:n_features], parameters[n_features] + np.concatenate([[0], np.cumsum(np.exp(parameters[n_features + 1 :]))])
        z = np.bincount(doc, w[col], n)[:, None] - t[None, :]
        above = np.concatenate([np.ones((n, 1)), sigmoid(z), np.zeros((n, 1))], 1)
        slope = above * (1 - above)
        i = np.arange(n)
        p = np.maximum(above[i, grades] - above[i, grades + 1], 1e-12)
        # derivative of -log p by each z_k: the lower bound of the own grade pulls up, the upper one down
        dz = np.zeros((n, levels))
        has_low, has_high = grades > 0, grades < levels
        dz[i[has_low], grades[has_low] - 1] -= slope[i[has_low], grades[has_low]] / p[has_low]
        dz[i[has_high], grades[has_high]] += slope[i[has_high], grades[has_high] + 1] / p[has_high]
        dz /= n
        gt = -dz.sum(0)
        g = np.concatenate([np.bincount(col, dz.sum(1)[doc], n_features) + penalty * w / 10, [gt.sum()], [gt[k + 1 :].sum() * math.exp(parameters[n_features + 1 + k]) for k in range(levels - 1)]])
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        parameters = parameters - 0.05 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-9)
    return parameters[:n_features], parameters[n_features] + np.concatenate([[0], np.cumsum(np.exp(parameters[n_features + 1 :]))])


def fit(labelled: DataFrame, sample: int = SAMPLE, n_features: int = FEATURES) -> Model:
    """A model from rows of ``(id, text, toxic)``, where ``toxic`` is the grade: 0, 1, and more if the labels have more.

    Rows with a null label take no part, negative grades are 0, and rows that agree in id
    and text are one of the highest grade. It reads at most ``sample`` of these, the first by hash. The
    thresholds are as many as the highest grade. Without graded rows the model gives every text a grade near 0.
    """
    rows = labelled.where("toxic is not null").select("id", F.coalesce("text", F.lit("")).alias("text"), F.greatest(F.lit(0), F.col("toxic").cast("int")).alias("grade"), F.xxhash64("id", "text").alias("__h"))
    last = rows.select("__h").distinct().orderBy("__h").limit(sample).agg(F.max("__h")).first()[0]
    first = rows.where(F.col("__h") <= F.lit(last)).groupBy("__h").agg(F.first("id").alias("id"), F.first("text").alias("text"), F.max("grade").alias("grade"))
    features = materialize(text_features(first), "toxicity-sample")
    graded = (F.col("grade") > 0).cast("int")
    levels, n1, n0 = features.agg(F.coalesce(F.max("grade"), F.lit(0)), F.coalesce(F.sum(graded), F.lit(0)), F.coalesce(F.sum(1 - graded), F.lit(0))).first()
    found = features.select(graded.alias("toxic"), F.explode("features").alias("feature")).groupBy("feature").agg(F.sum("toxic").alias("toxic"), F.sum(1 - F.col("toxic")).alias("clean"))
    odds = F.log((F.col("toxic") + 0.1) / (n1 + 1.0)) - F.log((F.col("clean") + 0.5) / (n0 + 1.0))
    best = found.where(f"toxic >= {LEAST_DOCUMENTS}").withColumn("odds", odds).where(F.col("odds") >= LEAST_LOG_ODDS)
    chosen = [r.feature for r in best.orderBy(F.desc(F.col("odds") * F.sqrt("toxic")), "feature").limit(n_features).select("feature").collect()]
    if not chosen or not n0:
        return Model({}, (10.0,))
    number = {f: i for i, f in enumerate(chosen)}
    kept = features.select("grade", F.array_intersect("features", F.array(*map(F.lit, chosen))).alias("features"))
    sets = sorted((r.grade, sorted(number[f] for f in r.features)) for r in kept.collect())
    w, t = fit_ordinal([np.array(f, np.int64) for _, f in sets], np.array([g for g, _ in sets], np.int64), len(chosen), levels)
    return Model({f: float(w[i]) for f, i in number.items() if abs(w[i]) > 1e-6}, tuple(map(float, t)))


class Scorer:
    """Sums a text's weights; remembers what each distinct word brings."""

    def __init__(self, model: Model):
        self.model, self.words = model, Memo(self.word, SMALL_MEMO_BYTES, "toxicity")

    def word(self, word: str) -> tuple[tuple[int, ...], tuple[int, ...]]:
        """The features of the model that a word brings alone, and with another one."""
        return tuple(tuple(k for k in keys if k in self.model.weights) for keys in (feature_keys(word), shared_keys(word)))

    def score(self, text: str) -> float:
        found, once = set(), set()
        for word in set(_WORD.findall(text.lower())):
            own, shared = self.words[word]
            found.update(own)
            if shared:
                found.update(once.intersection(shared))
                once.update(shared)
        return self.model.expected(math.fsum(self.model.weights[k] for k in found))


@functools.lru_cache(maxsize=2)
def scorer(weights: tuple, thresholds: tuple) -> Scorer:
    return Scorer(Model(dict(weights), thresholds))


def score(docs: DataFrame, model: Model, reject: float = REJECT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, severity, rejected)`` for every row, in one pass without a shuffle.

    Null and empty texts score as a text without features; null ids and repeated
    rows are kept; an empty table gives no rows; texts are read whole. The model,
    at most as many numbers as it may have features, travels with the tasks.
    """
    weights = tuple(sorted(model.weights.items()))

    def severities(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget_others("toxicity")
        own = scorer(weights, model.thresholds)
        for batch in batches:
            for x in slices(batch):
                s = [own.score(t) for t in x.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([x.column(0), pa.array(s, pa.float64()), pa.array([y >= reject for y in s], pa.bool_())], ["doc_id", "severity", "rejected"])

    return id_text(docs, id_col, text_col).mapInArrow(severities, f"doc_id {docs.schema[id_col].dataType.simpleString()}, severity double, rejected boolean")


def keep_clean(docs: DataFrame, model: Model, reject: float = REJECT, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that the model doesn't reject, all columns, row by row: repeated rows share their
    fate, null and empty texts count as without features, an empty table gives no rows, a severity of just ``reject`` goes."""
    columns = docs.columns
    weights = tuple(sorted(model.weights.items()))
    at = columns.index(text_col)

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget_others("toxicity")
        own = scorer(weights, model.thresholds)
        for batch in batches:
            for x in slices(batch, at):
                yield x.filter(pa.array([own.score(t or "") < reject for t in x.column(at).to_pylist()], pa.bool_()))
        give_back()

    return docs.mapInArrow(clean, docs.schema)


def labelled_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``(id, text, toxic)`` of the documents that have a label, row by row (null text: empty); null ids and
    labels take no part, and of an id's labels the highest counts."""
    marks = labels.where("toxic is not null and doc_id is not null").groupBy(F.col("doc_id").alias("id")).agg(F.max("toxic").alias("toxic"))
    return id_text(docs, "doc_id", "text").join(marks, "id")


def sample_labels(labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """The labels that fitting may read: the first ``sample`` by hash of the id."""
    return labels.where("toxic is not null and doc_id is not null").orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)


def toxicity_report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Fit on the labelled sample, then grade every document; see ``score`` for nulls, repeats and empty tables.
    Without labels nothing is rejected."""
    return score(docs, fit(labelled_documents(docs, sample_labels(labels))))
