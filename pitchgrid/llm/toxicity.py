"""Toxicity by cumulative-link ordinal regression on sparse text features.

P(grade <= k) = sigmoid(threshold_k - weights . x): one weight vector serves all ordered thresholds. Features are the
presence of a word or of a word's beginning, which stands for its inflections; an L1 penalty keeps few of them. The model predicts P(grade >= k) for each k, and the expected
severity is their sum.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pitchgrid.llm.common import Scratch, lean, rows_of, small_batches, texts

_WORD = re.compile(r"[^\W\d_]+")


@dataclass(frozen=True)
class Model:
    """Features (see ``_features``) to weight, and the ascending thresholds between the grades 0, 1, ..., len(thresholds)."""

    weights: dict[str, float]
    thresholds: tuple[float, ...]

    def at_least(self, activations: np.ndarray) -> np.ndarray:
        """P(grade >= k) for k = 1, ..., a column each."""
        return _sigmoid(activations[:, None] - np.array(self.thresholds)[None, :])


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(x / 2))


#: Lengths of the beginnings that are features.
_STEMS = (4, 5, 6, 7)


def _features(words: set[str]) -> set[str]:
    """Each word, and the beginnings of longer ones with a hyphen."""
    return words | {f"{w[:k]}-" for w in words for k in _STEMS if len(w) > k}


class _Scorer:
    """Sums the weights of a text's features; only words that begin like a feature are looked into."""

    def __init__(self, weights: dict[str, float]):
        self.weights, self.whole = weights, {f for f in weights if not f.endswith("-")}
        self.least = min(_STEMS)
        self.starts = {f[: self.least] for f in weights if f.endswith("-")}

    def __call__(self, text: str) -> float:
        words = set(_WORD.findall(text.lower()))
        k = self.least
        found = (words & self.whole) | (self.weights.keys() & _features({w for w in words if w[:k] in self.starts}))
        return sum(self.weights[f] for f in sorted(found))


def fit_ordinal(
    rows: np.ndarray, cols: np.ndarray, shape: tuple[int, int], grades: np.ndarray, penalty: float, rounds: int = 400
) -> tuple[np.ndarray, np.ndarray]:
    """Weights and thresholds by accelerated proximal gradient on the mean log loss plus ``penalty`` times the L1 norm.

    Grade 0 and the others together weigh the same, however rare the others are.

    ``rows`` and ``cols`` are the ones of the binary feature matrix of ``shape``; grades go from 0 to the largest."""
    n, d = shape
    top = int(grades.max())
    worth = np.where(grades > 0, 0.5 / max(1, (grades > 0).sum()), 0.5 / max(1, (grades == 0).sum()))
    share = np.array([worth[grades <= k].sum() for k in range(top)]).clip(1e-4, 1 - 1e-4)
    w, th = np.zeros(d), np.log(share / (1 - share))
    sizes = np.bincount(rows, minlength=n)
    step = 4.0 / (np.percentile(sizes, 99) + 1 if n else 1)
    vw, vth, t = w.copy(), th.copy(), 1.0
    best, last = (w, th), np.inf

    def loss(w: np.ndarray, th: np.ndarray, grad: bool):
        a = np.bincount(rows, weights=w[cols], minlength=n)
        upto = np.column_stack([np.zeros(n), _sigmoid(th[None, :] - a[:, None]), np.ones(n)])
        at = np.arange(n)
        p = (upto[at, grades + 1] - upto[at, grades]).clip(1e-12)
        value = -(worth * np.log(p)).sum() + penalty * np.abs(w).sum()
        if not grad:
            return value, None, None
        slope = upto * (1 - upto)
        hi, lo = worth * slope[at, grades + 1] / p, worth * slope[at, grades] / p
        ga = hi - lo
        gth = np.array([lo[grades == k + 1].sum() - hi[grades == k].sum() for k in range(top)])
        return value, np.bincount(cols, weights=ga[rows], minlength=d), gth

    for _ in range(rounds):
        value, gw, gth = loss(vw, vth, True)
        for _ in range(30):
            nw = vw - step * gw
            nw = np.sign(nw) * np.maximum(np.abs(nw) - step * penalty, 0)
            nth = np.maximum.accumulate(vth - step * gth + 1e-6 * np.arange(top)) if top else vth
            dw, dt = nw - vw, nth - vth
            smooth = value - penalty * np.abs(vw).sum() + gw @ dw + gth @ dt + (dw @ dw + dt @ dt) / (2 * step)
            now, _, _ = loss(nw, nth, False)
            if now - penalty * np.abs(nw).sum() <= smooth + 1e-12:
                break
            step /= 2
        t1 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        if now > last:
            t, t1, vw, vth = 1.0, 1.0, best[0].copy(), best[1].copy()
            last = np.inf
            continue
        vw, vth = nw + (t - 1) / t1 * (nw - best[0]), nth + (t - 1) / t1 * (nth - best[1])
        best, t = (nw, nth), t1
        if last - now < 1e-9:
            break
        last = now
        step *= 1.3
    return best


def fit(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "toxic",
    max_labelled: int = 20_000,
    max_features: int = 3_000,
    min_docs: int = 5,
    penalty: float = 0.01,
    severe_words: int = 12,
) -> Model | None:
    """A model from labelled documents; None where no or all labels are positive.

    Labels are 0 (grade 0) or positive. A positive label of 1 says nothing of severity, so it becomes grade 2 where
    the text has at least ``severe_words`` of the features most typical of positive documents, and else 1;
    larger labels keep their grade. Null ids and labels take no part; an id with several labels has the largest.
    At most ``max_labelled`` documents are used, those with the least hash of their id; ``max_features`` features
    are screened by the z-score of their document frequencies among those in ``min_docs`` documents at least.
    The L1 penalty is ``penalty`` over the root of the number of documents.
    The driver holds those documents' screened features, nothing that grows with the corpus.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark)
    chosen = (
        labels.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("int").alias("y"))
        .dropna()
        .groupBy("id")
        .agg(F.max("y").alias("y"))
        .orderBy(F.xxhash64("id"), "id")
        .limit(max_labelled)
    )

    def bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, whole, ys in rows_of(batches, 1 << 18):
            bag = [sorted(_features(set(_WORD.findall(t.lower())))) for t in whole]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(ys, pa.int32()), pa.array(bag, pa.list_(pa.string()))], ["id", "y", "features"])

    # repeated ids would weigh twice: one row of each takes part
    known = texts(docs, id_col, text_col).join(F.broadcast(chosen), "id").select("id", "text", "y").dropDuplicates(["id"])
    bag = scratch.write(known.mapInArrow(lean(bags), "id long, y int, features array<string>"))
    n_of = {r["pos"]: r["n"] for r in bag.groupBy((F.col("y") > 0).alias("pos")).agg(F.count(F.lit(1)).alias("n")).collect()}
    n1, n0 = n_of.get(True, 0), n_of.get(False, 0)
    if not n1 or not n0:
        return None
    seen = bag.select((F.col("y") > 0).cast("int").alias("pos"), F.explode("features").alias("feature")).groupBy("feature")
    seen = seen.agg(F.sum("pos").alias("a"), F.count(F.lit(1)).alias("df")).filter(F.col("df") >= min_docs)
    p = F.col("df") / (n0 + n1)
    z = (F.col("a") / n1 - (F.col("df") - F.col("a")) / n0) / F.sqrt(p * (1 - p) * (1.0 / n0 + 1.0 / n1) + 1e-9)
    kept = seen.withColumn("z", z).orderBy(F.abs("z").desc(), "feature").limit(max_features).collect()
    place = {r["feature"]: k for k, r in enumerate(kept)}
    typical = {r["feature"] for r in kept if r["z"] > 4 and r["a"] / n1 > 20 * (r["df"] - r["a"] + 0.5) / n0}
    if not place:
        return None

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ys, bags_ = (c.to_pylist() for c in batch.columns)
            at = [sorted(place[f] for f in fs if f in place) for fs in bags_]
            hits = [sum(f in typical for f in fs) for fs in bags_]
            yield pa.RecordBatch.from_arrays([pa.array(ys, pa.int32()), pa.array(hits, pa.int32()), pa.array(at, pa.list_(pa.int32()))], ["y", "hits", "at"])

    found = bag.select("y", "features").mapInArrow(lean(vectors), "y int, hits int, at array<int>").toArrow()
    ys, hits = found["y"].to_numpy(), found["hits"].to_numpy()
    at = found["at"].combine_chunks()
    at = at if isinstance(at, pa.ListArray) else pa.concat_arrays(at.chunks)
    sizes = np.diff(at.offsets.to_numpy())
    cols, rows = at.flatten().to_numpy(), np.repeat(np.arange(len(ys)), sizes)
    grades = np.where(ys <= 0, 0, np.where(ys > 1, ys, np.where(hits >= severe_words, 2, 1))).astype(np.int64)
    # grades without a document would have no threshold of their own
    _, grades = np.unique(grades, return_inverse=True)
    scratch.drop()
    w, th = fit_ordinal(rows, cols, (len(ys), len(place)), grades, penalty / np.sqrt(len(ys)))
    return Model({r["feature"]: float(x) for r, x in zip(kept, w, strict=True) if x}, tuple(float(x) for x in th))


def score(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text", batch_bytes: int = 1 << 20) -> DataFrame:
    """One row per input row: the id, ``severity`` (expected grade), ``grade`` (the largest k that the document
    exceeds with a probability of a half or more) and ``toxic`` (grade >= 1).

    The whole text counts. Null and empty texts get the severity of a text without known features; a null id stays
    null; repeated rows each give a row; an empty table gives none; other columns are left out, whatever their names;
    without a model (see ``fit``) every severity is 0.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = _Scorer(model.weights) if model else None
        for ids, whole in rows_of(batches, batch_bytes):
            if model is None:
                p = np.zeros((len(ids), 1))
            else:
                p = model.at_least(np.array([scorer(t) for t in whole], float))
            grade = (p >= 0.5).sum(1).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(p.sum(1)), pa.array(grade), pa.array(grade >= 1)], [id_col, "severity", "grade", "toxic"])

    return texts(docs, id_col, text_col).mapInArrow(lean(run), f"{id_col} long, severity double, grade int, toxic boolean")


def clean(docs: DataFrame, model: Model | None, text_col: str = "text") -> DataFrame:
    """The rows that the model doesn't grade 1 or more, with all their columns, whatever their names.

    The whole text counts. A null text is graded as an empty one; repeated rows and rows without an id are graded like
    all others; an empty table gives an empty one; without a model all rows stay."""
    if model is None:
        return docs
    names = docs.columns
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = _Scorer(model.weights)
        for batch in batches:
            column = batch.column(names.index(text_col))
            for k in range(0, batch.num_rows, 256):
                scores = [scorer(t or "") for t in column.slice(k, 256).to_pylist()]
                keep = pa.array([s < model.thresholds[0] for s in scores], pa.bool_())
                yield batch.slice(k, 256).filter(keep)

    return docs.mapInArrow(lean(run), docs.schema)
