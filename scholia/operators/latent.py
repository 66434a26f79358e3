"""An embedder that learns: TF-IDF of hashed words and its main directions, by a randomised range finder.

fit() weighs the words of a corpus and finds the right singular vectors of its
TF-IDF matrix. The matrix is never made: each pass multiplies batches of texts with
a thin matrix (a row for each feature) and back, tasks give their sums in blocks of
features, Spark adds these up, and the driver orthonormalises the thin matrix,
FEATURES by `dims` and a few spare columns. A last pass gives the small square
matrix whose eigenvectors turn that basis into singular vectors.

A model is stored as Parquet and is an Embedder like any other: unit vectors, the
zero vector for texts without a known word.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scholia.functions.batches import parts
from scholia.session import stored

#: Hashed words, directions that are kept, spare ones while they are sought, passes, features of a block, texts at a time at most.
FEATURES, DIMS, SPARE, PASSES, BLOCK, ROWS = 1 << 14, 64, 10, 4, 1024, 512
#: Values of a batch that meet rows of a thin matrix at a time.
VALUES = 1 << 14
_WORD = re.compile(r"[^\W_]+")


def counts_of(texts: list[str | None], features: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, feature and count of the words of texts."""
    rows, codes = [], []
    known: dict[str, int] = {}
    for n, text in enumerate(texts):
        for word in _WORD.findall((text or "").lower()):
            if word not in known:
                known[word] = xxhash.xxh64_intdigest(word) % features
            rows.append(n)
            codes.append(known[word])
    keys, counts = np.unique(np.array(rows, np.int64) * features + np.array(codes, np.int64), return_counts=True)
    return keys // features, keys % features, counts


@dataclass
class Batch:
    """A few texts' TF-IDF rows of unit length: row, feature and value of what is not zero."""

    rows: np.ndarray
    features: np.ndarray
    values: np.ndarray
    count: int

    @classmethod
    def of(cls, texts: list[str | None], idf: np.ndarray) -> Batch:
        rows, features, counts = counts_of(texts, len(idf))
        values = (1 + np.log(counts)) * idf[features]
        norms = np.sqrt(np.bincount(rows, values**2, len(texts)))
        return cls(rows, features, values / np.maximum(norms[rows], 1e-30), len(texts))

    def times(self, thin: np.ndarray) -> np.ndarray:
        out = np.zeros((self.count, thin.shape[1]))
        _gather(out, self.rows, self.values, thin, self.features)
        return out

    def back(self, thin: np.ndarray, out: np.ndarray) -> None:
        order = np.argsort(self.features, kind="stable")
        _gather(out, self.features[order], self.values[order], thin, self.rows[order])


def _gather(out: np.ndarray, to: np.ndarray, values: np.ndarray, thin: np.ndarray, of: np.ndarray) -> None:
    """Add values times rows `of` of thin to rows `to` of out, which are in order; a few values at a time."""
    for low in range(0, len(to), VALUES):
        some = slice(low, low + VALUES)
        first = np.flatnonzero(np.diff(to[some], prepend=-1))
        out[to[some][first]] += np.add.reduceat(values[some, None] * thin[of[some]], first, axis=0)


class Model:
    """An Embedder by weights of features and directions."""

    def __init__(self, idf: np.ndarray, directions: np.ndarray, strengths: np.ndarray):
        self.idf, self.directions, self.strengths = idf, directions, strengths

    def __call__(self, texts: list[str]) -> np.ndarray:
        found = Batch.of(texts, self.idf).times(self.directions)
        norms = np.linalg.norm(found, axis=1, keepdims=True)
        return (found / np.where(norms > 1e-12, norms, 1)).astype(np.float32)


def weights(texts: DataFrame, features: int = FEATURES) -> np.ndarray:
    """Inverse document frequency of every feature, zero for those of no text; `features` rows come to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, count = np.zeros(features, np.int64), 0
        for batch in batches:
            for few in parts(batch.column(0), rows=ROWS):
                few = few.to_pylist()
                _, codes, _ = counts_of(few, features)
                held += np.bincount(codes, minlength=features)
                count += len(few)
        some = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array([-1, *some.tolist()], pa.int32()), pa.array([count, *held[some].tolist()], pa.int64())], ["feature", "n"])

    rows = texts.mapInArrow(run, "feature int, n long").groupBy("feature").agg(F.sum("n").alias("n")).collect()
    found = {r["feature"]: r["n"] for r in rows}
    total, out = found.pop(-1, 0), np.zeros(features)
    for feature, n in found.items():
        out[feature] = np.log((1 + total) / (1 + n)) + 1
    return out


def _summed(texts: DataFrame, idf: np.ndarray, thin: np.ndarray, small: bool) -> np.ndarray:
    """The transposed matrix times the matrix times thin; with `small`, thin's transpose times that."""
    sent = texts.sparkSession.sparkContext.broadcast((idf, thin))  # features by a few dozen
    width = thin.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, right = sent.value
        out = np.zeros((width if small else len(right), width))
        for batch in batches:
            for texts_of in parts(batch.column(0), rows=ROWS):
                few = Batch.of(texts_of.to_pylist(), weights)
                made = few.times(right)
                if small:
                    out += made.T @ made
                else:
                    few.back(made, out)
        for at in range(0, len(out), BLOCK):
            yield pa.RecordBatch.from_arrays([pa.array([at], pa.int32()), pa.array([out[at : at + BLOCK].tobytes()], pa.binary())], ["at", "sums"])

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        total = sum(np.frombuffer(x) for x in pdf["sums"])
        return pd.DataFrame({"at": pdf["at"].iloc[:1], "sums": [total.tobytes()]})

    # A block of each task; tasks of a few hundred MB of texts each.
    rows = texts.mapInArrow(run, "at int, sums binary").groupBy("at").applyInPandas(add, "at int, sums binary").collect()
    return np.concatenate([np.frombuffer(r["sums"]).reshape(-1, width) for r in sorted(rows, key=lambda r: r["at"])]) if rows else np.zeros((width if small else len(thin), width))


def fit(texts: DataFrame, text_col: str = "text", dims: int = DIMS, features: int = FEATURES, passes: int = PASSES, seed: int = 5) -> Model:
    """Learn from all texts: a pass for the weights, `passes` for the directions, and one for their strengths."""
    rows = stored(texts.select(F.col(text_col).cast("string").alias("text")))
    idf = weights(rows, features)
    thin = np.random.default_rng(seed).normal(size=(features, min(dims + SPARE, features)))
    for _ in range(passes):
        thin, _ = np.linalg.qr(_summed(rows, idf, thin, False))
    values, vectors = np.linalg.eigh(_summed(rows, idf, thin, True))
    best = np.argsort(-values)[:dims]
    return Model(idf, thin @ vectors[:, best], np.sqrt(np.maximum(values[best], 0)))


def save(model: Model, spark: SparkSession, path: str) -> None:
    """A row for each feature that some text had, and one of the strengths."""
    some = np.flatnonzero(model.idf)
    rows = [(-1, float(len(model.idf)), model.strengths.tolist())] + [(int(f), float(model.idf[f]), model.directions[f].tolist()) for f in some]
    spark.createDataFrame(rows, "feature int, weight double, v array<double>").coalesce(1).write.parquet(path)


def load(spark: SparkSession, path: str) -> Model:
    rows = {r["feature"]: r for r in spark.read.parquet(path).collect()}  # FEATURES at most
    head = rows.pop(-1)
    size = int(head["weight"])
    idf, directions = np.zeros(size), np.zeros((size, len(head["v"])))
    for feature, r in rows.items():
        idf[feature], directions[feature] = r["weight"], r["v"]
    return Model(idf, directions, np.array(head["v"]))
