"""Regularised quadratic discriminant over transformed document statistics.

Per class: mean and covariance from sums over all labelled training rows (a Spark aggregation, a few hundred numbers),
shrunk towards the pooled covariance and a scaled diagonal.  The Cholesky factor of each class is cached in the model;
a score is the logistic of the difference of Mahalanobis log-densities plus the classes' log prior ratio.

Null and empty texts have all-zero counts and are scored like any other vector.  Repeated rows are scored alike, once
each; several labels of a document each count.  With a class missing from the training rows every score is the
share of label 1 (0.5 without any labels).  Labels, language, source and id are never inputs of a score.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm import docstats
from tessella.tables import stored, table

VECTOR = [name for name, _, _ in docstats.FEATURES]


class Discriminant:
    """Class means, cached Cholesky factors and log-determinants."""

    def __init__(self, n: np.ndarray, s: np.ndarray, q: np.ndarray, floors: np.ndarray, pool: float = 0.2, diagonal: float = 0.1):
        self.share = float(n[1] / n.sum()) if n.sum() else 0.5
        self.ready = bool((n >= 2).all())
        if not self.ready:
            return
        self.mean = s / n[:, None]
        cov = q / n[:, None, None] - np.einsum("ci,cj->cij", self.mean, self.mean)
        pooled = np.einsum("c,cij->ij", n / n.sum(), cov)
        self.factor, self.logdet = [], []
        for c in (0, 1):
            mixed = (1 - pool) * cov[c] + pool * pooled
            mixed = (1 - diagonal) * mixed + diagonal * np.diag(np.diag(mixed)) + 0.1 * np.diag(floors**2)
            lower = np.linalg.cholesky(mixed)
            self.factor.append(np.linalg.inv(lower))
            self.logdet.append(2 * np.log(np.diag(lower)).sum())
        self.prior = np.log(n[1] / n[0])

    def score(self, x: np.ndarray) -> np.ndarray:
        if not self.ready:
            return np.full(len(x), self.share)
        density = []
        for c in (0, 1):
            z = (x - self.mean[c]) @ self.factor[c].T
            density.append(-0.5 * ((z * z).sum(1) + self.logdet[c]))
        return 1 / (1 + np.exp(np.clip(density[0] - density[1] - self.prior, -500, 500)))


def fit(vectors: DataFrame, names: list[str] = VECTOR, label: str = "quality") -> Discriminant:
    """From rows with ``label`` 0 or 1 and the columns ``names``; one row of sums a class reaches the driver."""
    d = len(names)
    pairs = [(i, j) for i in range(d) for j in range(i, d)]
    rows = vectors.where(F.col(label).isin(0, 1)).groupBy(label).agg(F.count(F.lit(1)).alias("n"), *(F.sum(x).alias(f"s{i}") for i, x in enumerate(names)), *(F.sum(F.col(names[i]) * F.col(names[j])).alias(f"q{i}_{j}") for i, j in pairs)).collect()
    n, s, q = np.zeros(2), np.zeros((2, d)), np.zeros((2, d, d))
    for r in rows:
        c = int(r[label])
        n[c] = r["n"]
        s[c] = [r[f"s{i}"] for i in range(d)]
        for i, j in pairs:
            q[c, i, j] = q[c, j, i] = r[f"q{i}_{j}"]
    return Discriminant(n, s, q, np.array(docstats.spreads(names)))


def scored(vectors: DataFrame, model: Discriminant, names: list[str] = VECTOR) -> DataFrame:
    """``vectors`` with ``score``, the probability of label 1."""
    kept = [c for c in vectors.columns if c not in names]
    schema = ", ".join([*(f"`{c}` {t}" for c, t in vectors.select(*kept).dtypes), "score double"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.column_stack([b.column(b.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in names])
            yield pa.RecordBatch.from_arrays([*(b.column(b.schema.get_field_index(c)) for c in kept), pa.array(model.score(x))], [*kept, "score"])

    return vectors.mapInArrow(run, schema)


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score, predicted for every document; fitted on labels whose id hashes to 1..4 mod 5."""
    docs = docstats.statistics(table(spark, sf_dir, "documents"), ["doc_id"])
    held = (F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5)) == 0) & F.col("doc_id").isNotNull()
    vectors = stored(docs.select("doc_id", held.alias("held_out"), *docstats.features(VECTOR)), "vectors")
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality")
    model = fit(vectors.where("not held_out").join(labels, "doc_id"))
    return scored(vectors, model).select("doc_id", "held_out", "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


QUERIES = {"op1_quality_classifier": op1_quality_classifier}
