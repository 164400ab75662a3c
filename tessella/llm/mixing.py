"""Mixing sources to target weights by iterative proportional fitting, in DataFrame operations only.

Documents are summed to cells (source, language, topic).  Cell weights start as token counts and are scaled to the
target totals of each margin in turn, until every margin has its target.  A step sums the cells by one margin (combined
on the map side), joins the totals back and is written and read again, so neither plans nor lineage grow, and no margin's
cells meet in one task.

A document is sampled with probability ``rate * factor`` of its cell against a uniform number made from the MD5 of its
id, so a sample is the same wherever and whenever it is drawn.  The rate is at most 1 / the largest factor: no
probability is cut, and the expected tokens of every source, language and topic are in proportion to the targets.

The topic is a form of text: tabular, list, brief, article or long (any Column can be given instead).  Targets are the
shares of tokens to the power ``flatten``, which lifts small sources, languages and topics; nearer to 1 it lifts them
less and samples more.

Null language, source or topic is a margin of its own; null and empty texts have no tokens and cells without tokens
factor 1 (they weigh nothing); repeated rows weigh once each and share their fate; an empty table gives an empty
sample.  Documents travel as one struct beside the margins, so no name of theirs can clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.tables import drop_stored, stored, table

ROUNDS = 12
TOLERANCE = 1e-12
RATE = 0.5
FLATTEN = 0.7
WORD = r"[^\x20\x09-\x0D]+"
MARGINS = ["source", "lang", "topic"]


def n_tokens(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def form(tokens: Column, text: str = "text") -> Column:
    """The form of a text, from its counts of tokens, lines and bars."""
    body = F.coalesce(F.col(text), F.lit(""))
    count = lambda c: F.length(body) - F.length(F.replace(body, F.lit(c), F.lit("")))
    return F.when(count("|") * 5 > tokens, "tabular").when((count("\n") + 1) * 8 > tokens, "list").when(tokens < 100, "brief").when(tokens < 800, "article").otherwise("long")


def keyed(docs: DataFrame, topic: Column | None = None) -> DataFrame:
    """(doc, id, n, source, lang, topic): each document as a struct, its tokens, and its margins, never null."""
    named = lambda c: F.coalesce(c.cast("string"), F.lit("<null>"))
    rows = docs.select(F.struct("*").alias("doc"), F.col("doc_id").alias("id"), "text", "source", "lang", (F.lit(None) if topic is None else topic).cast("string").alias("topic"), n_tokens().alias("n"))
    return rows.select("doc", "id", "n", named(F.col("source")).alias("source"), named(F.col("lang")).alias("lang"), named(F.col("topic") if topic is not None else form(F.col("n"))).alias("topic"))


def cells_of(keyed_docs: DataFrame) -> DataFrame:
    """(source, lang, topic, tokens) of every cell."""
    return stored(keyed_docs.groupBy(*MARGINS).agg(F.sum("n").cast("double").alias("tokens")), "cells")


def raked(cells: DataFrame, rounds: int = ROUNDS, flatten: float = FLATTEN, tolerance: float = TOLERANCE) -> DataFrame:
    """(source, lang, topic, tokens, factor): after at most ``rounds`` rounds over the margins, fewer where no margin is
    off its target by more than ``tolerance``."""
    spark = cells.sparkSession
    for m in MARGINS:
        totals = stored(cells.groupBy(m).agg(F.sum("tokens").alias("t")), "margin")
        every, flat = totals.agg(F.coalesce(F.sum("t"), F.lit(0.0)), F.coalesce(F.sum(F.pow("t", F.lit(flatten))), F.lit(0.0))).first()
        cells = cells.join(totals.select(m, (F.pow("t", F.lit(flatten)) / flat * every if flat else F.lit(0.0)).alias(f"to_{m}")), m)
    cells = stored(cells.select(*MARGINS, "tokens", *(f"to_{m}" for m in MARGINS), F.col("tokens").alias("w"), F.lit(0.0).alias("off")), "raked")
    fixed = [*MARGINS, "tokens", *(f"to_{m}" for m in MARGINS)]
    for _ in range(rounds):
        for m in MARGINS:
            totals = cells.groupBy(m).agg(F.sum("w").alias("t"))
            off = F.when(F.col("t") > 0, F.abs(F.col(f"to_{m}") / F.col("t") - 1)).otherwise(0.0)
            w = F.when(F.col("t") > 0, F.col("w") * F.col(f"to_{m}") / F.col("t")).otherwise(F.col("w"))
            last, cells = cells, stored(cells.join(totals, m).select(*fixed, w.alias("w"), (off if m == MARGINS[0] else F.greatest("off", off)).alias("off")), "raked")
            drop_stored(spark, last)
        if (cells.agg(F.max("off")).first()[0] or 0.0) <= tolerance:
            break
    return cells.select(*MARGINS, "tokens", F.when(F.col("tokens") > 0, F.col("w") / F.col("tokens")).otherwise(1.0).alias("factor"))


def feasible_rate(cells: DataFrame, rate: float = RATE) -> float:
    """The given rate, or less where the largest factor would ask for more documents than there are."""
    most = cells.where("tokens > 0").agg(F.max("factor")).first()[0]
    return min(rate, 1.0 / most) if most else rate


def uniform(key: Column) -> Column:
    """A number in [0, 1) from the first 32 bits of the MD5."""
    return F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), 1, 8), 16, 10).cast("double") / 4294967296.0


def sampled(docs: DataFrame, topic: Column | None = None, rate: float = RATE, rounds: int = ROUNDS) -> DataFrame:
    """(doc, id, n, source, lang, topic, factor, p) of the sampled documents."""
    rows = keyed(docs, topic)
    cells = raked(cells_of(rows), rounds)
    p = F.least(F.lit(1.0), F.lit(feasible_rate(cells, rate)) * F.col("factor"))
    return rows.join(cells.drop("tokens"), MARGINS).withColumn("p", p).where(uniform(F.col("id")) < F.col("p"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The sampled documents with the columns they came with."""
    return sampled(docs).select("doc.*")


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, topic, weight and probability of the sampled documents."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    return sampled(docs).select(F.col("id").alias("doc_id"), F.col("n").alias("n_tokens"), "topic", F.round("factor", 6).alias("weight"), F.round("p", 6).alias("probability"))


def _oracle() -> str:
    count = lambda c: f"(length(body) - length(replace(body, {c}, '')))"
    steps = [
        rf"words AS MATERIALIZED (SELECT doc_id, coalesce(text, '') AS body, coalesce(lang, '<null>') AS lang, coalesce(source, '<null>') AS source, CAST(len(regexp_extract_all(coalesce(text, ''), '{WORD}')) AS BIGINT) AS n FROM documents)",
        f"docs AS MATERIALIZED (SELECT doc_id, lang, source, n, CASE WHEN {count(repr('|'))} * 5 > n THEN 'tabular' WHEN ({count('chr(10)')} + 1) * 8 > n THEN 'list' WHEN n < 100 THEN 'brief' WHEN n < 800 THEN 'article' ELSE 'long' END AS topic FROM words)",
        "cells AS MATERIALIZED (SELECT source, lang, topic, CAST(sum(n) AS DOUBLE) AS tokens FROM docs GROUP BY ALL)",
    ]
    for m in MARGINS:
        steps.append(f"to_{m} AS MATERIALIZED (SELECT {m}, CASE WHEN sum(t ** {FLATTEN}) OVER () > 0 THEN t ** {FLATTEN} / sum(t ** {FLATTEN}) OVER () * sum(t) OVER () ELSE 0 END AS to_{m} FROM (SELECT {m}, sum(tokens) AS t FROM cells GROUP BY ALL))")
    steps.append("w0 AS MATERIALIZED (SELECT *, tokens AS w FROM cells " + " ".join(f"JOIN to_{m} USING ({m})" for m in MARGINS) + ")")
    for k in range(ROUNDS * 3):
        m = MARGINS[k % 3]
        steps.append(f"w{k + 1} AS MATERIALIZED (SELECT * REPLACE (CASE WHEN sum(w) OVER (PARTITION BY {m}) > 0 THEN w * to_{m} / sum(w) OVER (PARTITION BY {m}) ELSE w END AS w) FROM w{k})")
    steps.append(f"f AS MATERIALIZED (SELECT source, lang, topic, CASE WHEN tokens > 0 THEN w / tokens ELSE 1 END AS factor, least({RATE}, 1.0 / max(CASE WHEN tokens > 0 THEN w / tokens END) OVER ()) AS rate FROM w{ROUNDS * 3})")
    return "WITH " + ",\n".join(steps) + f"""
SELECT doc_id, n AS n_tokens, topic, round(factor, 6) AS weight, round(least(1.0, rate * factor), 6) AS probability
FROM docs JOIN f USING (source, lang, topic)
WHERE CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) / 4294967296.0 < least(1.0, rate * factor)"""


QUERIES = {"op5_mixing": op5_mixing}
ORACLE_SQL = {"op5_mixing": _oracle()}
