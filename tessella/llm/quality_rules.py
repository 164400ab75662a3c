"""Robust multivariate outliers: a minimum-covariance-determinant estimate per language and source.

Every document is a vector of transformed statistics.  Per group, concentration steps keep the share ``h`` of
documents of smallest Mahalanobis distance, and re-estimate location and scatter from them, until no group's bound
moves by more than a hundredth; a reweighting step follows.  The one start is robust: medians and absolute deviations.
Quantiles are Spark's approximate ones (a rank is off by 1/1000 at most), so a document at the very cut-off may fall
on either side of it when partitions differ.  A document beyond the chi-square cut-off is rejected.  Estimates are sums over all documents of a group,
with map-side partial sums, so a group of any size meets no single task; states are one row a group.

Groups of fewer than ``min_group`` usable documents are held against the estimate of all usable documents of their
language, else of all usable documents; only if even these are fewer, there is none and nothing is rejected.  Null languages and sources are groups of their own.
Ties share a distance and so a verdict; repeated rows count as often as they are there; an empty table gives none.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm import docstats
from tessella.tables import drop_since, drop_stored, mark, stored, table

VECTOR = ["x_words", "x_length", "x_symbols", "x_dup", "x_repeat", "x_upper", "x_loud", "x_caps"]
MIN_GROUP = 50
CUTOFF = 0.99999
JUDGES = 10_000  # estimates that are broadcast, of some 400 bytes each
BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def chi2_quantile(p: float, d: int) -> float:
    """Wilson and Hilferty's approximation."""
    lo, hi = -10.0, 10.0
    for _ in range(80):
        z = (lo + hi) / 2
        lo, hi = (z, hi) if 0.5 * math.erfc(-z / math.sqrt(2)) < p else (lo, z)
    return d * (1 - 2 / (9 * d) + z * math.sqrt(2 / (9 * d))) ** 3


def chi2_cdf(x: float, d: int) -> float:
    return 0.5 * math.erfc(-((x / d) ** (1 / 3) - (1 - 2 / (9 * d))) / math.sqrt(2 / (9 * d)) / math.sqrt(2))


def _pairs(d: int) -> list[tuple[int, int]]:
    return [(i, j) for i in range(d) for j in range(i, d)]


def _distance(d: int, names: list[str]) -> F.Column:
    """Squared Mahalanobis distance from the columns m_i and p_ij (upper half of the inverse scatter)."""
    diff = [F.col(names[i]) - F.col(f"m{i}") for i in range(d)]
    terms = [F.col(f"p{i}_{j}") * diff[i] * diff[j] * (1.0 if i == j else 2.0) for i, j in _pairs(d)]
    return sum(terms[1:], terms[0])


def _state(sums: DataFrame, d: int, floors: list[float], factor: float, label: str) -> DataFrame:
    """Location and inverse scatter of each group from its sums, written as a table."""
    names = [*(f"m{i}" for i in range(d)), *(f"p{i}_{j}" for i, j in _pairs(d))]

    def solve(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            if not len(f):
                continue
            n = f["n"].to_numpy(float)[:, None]
            mean = f[[f"s{i}" for i in range(d)]].to_numpy(float) / n
            cov = np.zeros((len(f), d, d))
            for i, j in _pairs(d):
                cov[:, i, j] = cov[:, j, i] = f[f"q{i}_{j}"].to_numpy(float) / n[:, 0] - mean[:, i] * mean[:, j]
            cov = cov * factor + np.diag(np.square(floors))
            inverse = np.linalg.inv(cov)
            yield pd.DataFrame({"g": f["g"].to_numpy(), **{f"m{i}": mean[:, i] for i in range(d)}, **{f"p{i}_{j}": inverse[:, i, j] for i, j in _pairs(d)}})

    return stored(sums.mapInPandas(solve, "g string, " + ", ".join(f"{x} double" for x in names)), label)


def estimates(vectors: DataFrame, names: list[str], floors: list[float], h: float = 0.75, steps: int = 8, settled: float = 0.01, reweight: float = 0.975) -> DataFrame:
    """Location and inverse scatter of each group ``g`` of ``vectors`` (with the columns ``names``), as a table."""
    d = len(names)
    sums = [F.count(F.lit(1)).alias("n"), *(F.sum(names[i]).alias(f"s{i}") for i in range(d)), *(F.sum(F.col(names[i]) * F.col(names[j])).alias(f"q{i}_{j}") for i, j in _pairs(d))]

    def measured(state: DataFrame) -> DataFrame:
        more = [c for c in state.columns if c == "bound"]
        return vectors.join(state, "g").select("g", *names, _distance(d, names).alias("distance2"), *more)

    # Start: medians, and spreads from the absolute deviations' median, both over all documents of the group.
    # Medians are a table, small enough to be broadcast by its size, so that documents are not dealt out by group.
    centre = vectors.groupBy("g").agg(*(F.percentile_approx(x, 0.5, 1000).alias(f"m{i}") for i, x in enumerate(names)))
    centre = stored(centre, "mcd")
    spread = vectors.join(centre, "g").groupBy("g").agg(*(F.first(f"m{i}").alias(f"m{i}") for i in range(d)), *(F.percentile_approx(F.abs(F.col(x) - F.col(f"m{i}")), 0.5, 1000).alias(f"a{i}") for i, x in enumerate(names)))
    state = stored(spread.select("g", *(f"m{i}" for i in range(d)), *((F.lit(1.0) / (F.pow(F.col(f"a{i}") * 1.4826, 2) + floors[i] ** 2) if i == j else F.lit(0.0)).alias(f"p{i}_{j}") for i, j in _pairs(d))), "mcd")
    shrunk = h / chi2_cdf(chi2_quantile(h, d), d + 2)
    final, before = False, None
    for k in range(steps + 1):
        # Bounds are a table of one row a group, so that documents meet state and bound in one join that is
        # broadcast by size, and never lie by group in one task.
        if k < steps and not final:
            bound = stored(measured(state).groupBy("g").agg(F.percentile_approx("distance2", h, 2000).alias("bound")), "mcd")
            if before is not None:
                moved = bound.join(before.withColumnRenamed("bound", "last"), "g").agg(F.max(F.abs(F.col("bound") / F.greatest(F.col("last"), F.lit(1e-12)) - 1))).first()[0]
                final = (moved or 0.0) <= settled
            before = bound
        if k == steps or final:
            bound = state.select("g", F.lit(chi2_quantile(reweight, d)).alias("bound"))
        inside = measured(state.join(bound, "g")).where("distance2 <= bound").groupBy("g").agg(*sums)
        factor = shrunk if k < steps and not final else reweight / chi2_cdf(chi2_quantile(reweight, d), d + 2)
        state, last = _state(inside, d, floors, factor, "mcd"), state
        drop_stored(vectors.sparkSession, last)
        if final:
            break
    return state


def outliers(vectors: DataFrame, names: list[str], floors: list[float], **how: float) -> DataFrame:
    """``vectors`` (with group ``g`` and the columns ``names``) joined with its ``distance2``; null where no state is."""
    state = estimates(vectors, names, floors, **how)
    return vectors.join(state, "g", "left").withColumn("distance2", _distance(len(names), names)).drop(*state.columns)


def _rated(docs: DataFrame, key: str, text: bool = False) -> DataFrame:
    """``key``, the base counts, ``base_failed``, the keys of both levels of groups and the vector of every document,
    and its text if it is to be kept."""
    stats = docstats.statistics(docs, [key, "lang", "source"], text)
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    level = lambda n, *cols: F.concat(F.lit(n), F.to_json(F.struct(*cols)))
    return stats.select(key, *["__text"] * text, *BASE, failed.alias("base_failed"), level("2", "lang", "source").alias("k2"), level("1", "lang").alias("k1"), *docstats.features(VECTOR))


def _grouped(usable: DataFrame, min_group: int) -> DataFrame:
    """The ``usable`` documents with each group ``g`` whose estimate they take part in; ``own`` for the one they are
    held against."""
    sizes = stored(usable.groupBy("k1", "k2").agg(F.count(F.lit(1)).alias("n2")), "sizes")
    langs = sizes.groupBy("k1").agg(F.sum("n2").alias("n1"))
    total = sizes.agg(F.coalesce(F.sum("n2"), F.lit(0)).alias("n0")).first()["n0"]
    rest = F.lit("0") if total >= min_group else F.lit(None).cast("string")
    groups = stored(sizes.join(langs, "k1").select("k1", "k2", F.when(F.col("n2") >= min_group, F.col("k2")).when(F.col("n1") >= min_group, F.col("k1")).otherwise(rest).alias("g")), "groups")
    # A group is judged by ``g``; estimates of a language or of all take in the documents of other groups too.
    wide = [groups.where("g = k1").select(F.col("k1").alias("of"), "g").distinct(), groups.where("g = '0'").select("g").distinct()]
    others = groups.select("k1", "k2", F.col("g").alias("own_g"))
    others = others.join(wide[0], F.col("k1") == F.col("of")).select("k2", "g", "own_g").unionByName(others.crossJoin(wide[1]).select("k2", "g", "own_g"))
    part = groups.select("k2", "g", F.lit(True).alias("own")).unionByName(others.where("not g <=> own_g").select("k2", "g", F.lit(False).alias("own")))
    return stored(usable.join(stored(part, "groups"), "k2").drop("k1"), "vectors")


def verdicts(docs: DataFrame, min_group: int = MIN_GROUP, cutoff: float = CUTOFF) -> DataFrame:
    """One row per document: doc_id, the base counts, ``base_failed``, ``distance2`` and ``kept``."""
    rows = stored(_rated(docs, "doc_id"), "stats")
    vectors = _grouped(rows.where("not base_failed"), min_group).drop("k2")
    judged = outliers(vectors.where("g is not null"), VECTOR, docstats.spreads(VECTOR)).where("own")
    inside = F.coalesce(F.col("distance2") <= chi2_quantile(cutoff, len(VECTOR)), F.lit(True))
    out = [*("doc_id", *BASE, "base_failed"), "distance2"]
    none = F.lit(None).cast("double").alias("distance2")
    judged = judged.select(*out, inside.alias("kept"))
    unplaced = vectors.where("g is null").select(*out[:-1], none, F.lit(True).alias("kept"))
    return judged.unionByName(unplaced).unionByName(rows.where("base_failed").select(*out[:-1], none, F.lit(False).alias("kept")))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str, min_group: int = MIN_GROUP) -> DataFrame:
    """The documents that the rules keep, with the columns they came with.

    A verdict follows from text, language and source.  The estimates, one row a language and source, are small; the
    documents are counted a second time and judged where they are read.  So they are never dealt out or written by a
    key, whatever the number of rejected ones.
    """
    since = mark()
    rows = stored(_rated(docs.select(F.lit(0).alias("__row"), "text", "lang", "source"), "__row").drop("__row", *BASE), "stats")
    vectors = _grouped(rows.where("not base_failed"), min_group)
    state = estimates(vectors.where("g is not null"), VECTOR, docstats.spreads(VECTOR))
    names = [c for c in state.columns if c != "g"]
    judges = stored(vectors.where("own").select("k2", "g").distinct().join(state, "g").select("k2", F.array(*names).alias("state")), "judges")
    drop_since(spark, since, judges)
    judges = F.broadcast(judges) if judges.count() <= JUDGES else judges
    other = [c for c in docs.columns if c != "text"]
    rated = _rated(docs.select(F.struct(*(F.col(f"`{c}`") for c in other)).alias("__row"), "text", "lang", "source"), "__row", text=True)
    judged = rated.where("not base_failed").join(judges, "k2", "left").select("*", *(F.col("state")[k].alias(c) for k, c in enumerate(names)))
    inside = F.coalesce(_distance(len(VECTOR), VECTOR) <= chi2_quantile(CUTOFF, len(VECTOR)), F.lit(True))
    return judged.where(inside).select(*(F.col("__text").alias("text") if c == "text" else F.col(f"__row.`{c}`") for c in docs.columns))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, distance2."""
    return verdicts(table(spark, sf_dir, "documents")).select("doc_id", *BASE, "base_failed", "kept", "distance2")


QUERIES = {"op2_quality_rules": op2_quality_rules}
