"""Mixing sources to target weights: exact word budgets, cut in hash-random order.

Each source gets a share of all words by its weight, at most `cap` times what it has; what a source
can't use is shared again among the others by weight. Documents get hash-random keys, are sorted
by them within their source, and prefix sums of their sizes tell which fall before the cut; a
budget beyond the source's size takes whole epochs first. The document at the cut is taken in part,
so each source gives its budget to the word.

At scale: the key space is cut into 4096 ranges per source. Sums of each range and a running sum over
them give where a range starts; within a range rows are sorted by key. So no task sorts more than a
4096th of a source, and a source with a third of all rows is no bottleneck. Keys are drawn from id and text, so rows without
an id, or with one id, are dealt out too; only rows that are equal in both share a range, and meet in one task. One shuffle by
(source, range). What meets in one task else is a row a source, in the windows of targets(), and the 4096 ranges of a source;
a source is a table or site, thousands at most.

Defined cases: a null or empty text has size 0 and is never taken; texts of any length are counted whole; null is a source of
its own, last in order; equal keys (repeated rows) are ordered by id and size, so reruns agree; an empty
table gives an empty result. Columns with clashing names are kept apart by fresh names; those named like a result are not
carried.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import fresh, word_count

WEIGHTS = (5, 2, 1)
SEED = "mix-1"
CAP = 3


def targets(sizes: DataFrame, weights=WEIGHTS, cap: int = CAP, share: float = 1.0) -> DataFrame:
    """(source, source_size) with target: weights by code point of the source, null last.

    With sources in order of cap * size / weight, those whose share would exceed the cap come
    first; the level of the first that fits is that of all the rest.
    """
    every = Window.partitionBy()
    order = F.pmod(F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1, F.lit(len(weights)))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), order.cast("int") + 1)
    first = sizes.withColumn("weight", weight).withColumn("most", (F.col("source_size") * cap).cast("double")).withColumn("total", (F.sum("source_size").over(every) * F.lit(share)).cast("double"))
    ranked = Window.orderBy(F.col("most") / F.col("weight"), F.col("source").asc_nulls_last())
    before = ranked.rowsBetween(Window.unboundedPreceding, -1)
    level = (F.col("total") - F.coalesce(F.sum("most").over(before), F.lit(0.0))) / F.sum("weight").over(ranked.rowsBetween(0, Window.unboundedFollowing))
    second = first.withColumn("level", level)
    common = F.max(F.when(F.col("level") <= F.col("most") / F.col("weight"), F.col("level"))).over(every)
    return second.withColumn("common", common).select("source", "source_size", F.least("most", F.coalesce(F.col("common") * F.col("weight"), F.col("most"))).alias("target"))


def mix(docs: DataFrame, id: str = "doc_id", text: str = "text", source: str = "source", carry: list[str] | None = None, weights=WEIGHTS, cap: int = CAP, share: float = 1.0, seed: str = SEED) -> DataFrame:
    """The columns `carry` (all, if None) with size, source_size, target and taken (words).

    Columns of docs that have one of these names are not carried.
    """
    added = ("size", "source_size", "target", "taken")
    carry = [c for c in (docs.columns if carry is None else carry) if c.lower() not in added]
    s, k, r, at = fresh(docs, "of_source", "sort_key", "key_range", "own_id")
    key = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(f"`{id}`").cast("string"), F.lit("")), F.lit(":"), F.md5(F.coalesce(F.col(f"`{text}`"), F.lit("")).cast("binary"))).cast("binary"))
    # A null source must meet itself in joins: a leading letter tells null from any string.
    named = F.coalesce(F.concat(F.lit("s"), F.col(f"`{source}`").cast("string")), F.lit("null"))
    keyed = docs.select(*[F.col(f"`{c}`") for c in carry], F.col(f"`{id}`").alias(at), named.alias(s), word_count(F.col(f"`{text}`")).alias("size"), key.alias(k)).withColumn(r, F.substring(k, 1, 3))
    ranges = docs.select(named.alias("s"), key.alias("k"), word_count(F.col(f"`{text}`")).alias("n")).groupBy("s", F.substring("k", 1, 3).alias("r")).agg(F.sum("n").alias("n"))
    plan = targets(ranges.groupBy("s").agg(F.sum("n").alias("source_size")).select(F.when(F.col("s") != "null", F.expr("substring(s, 2)")).alias("source"), "source_size"), weights, cap, share)
    plan = plan.select(F.coalesce(F.concat(F.lit("s"), "source"), F.lit("null")).alias("ps"), "source_size", "target")
    along = Window.partitionBy("s").orderBy("r").rowsBetween(Window.unboundedPreceding, -1)
    starts = ranges.withColumn("start", F.coalesce(F.sum("n").over(along), F.lit(0))).join(plan, F.col("s") == F.col("ps")).select(F.col("s").alias(s), F.col("r").alias(r), "start", "source_size", "target")
    within = Window.partitionBy(s, r).orderBy(k, F.col(at).cast("string"), "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = keyed.withColumn("before", F.coalesce(F.sum("size").over(within), F.lit(0))).join(starts, [s, r])
    return placed.select(*[F.col(f"`{c}`") for c in carry], "size", "source_size", "target", taken(F.col("size"), F.col("before") + F.col("start"), F.col("source_size"), F.col("target")).alias("taken"))


def taken(size: Column, before: Column, source_size: Column, target: Column) -> Column:
    budget = F.floor(target + 0.5).cast("long")
    whole = F.when(source_size > 0, F.floor(budget / F.when(source_size > 0, source_size))).otherwise(0).cast("long")
    rest = budget - whole * source_size
    return (whole * size + F.greatest(F.lit(0), F.least(size, rest - before))).cast("long")


#: The same rows in SQL.
SQL = r"""
WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
  md5('mix-1:' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || md5(coalesce(text, ''))) AS k FROM documents),
s AS (SELECT source, sum(size) AS source_size FROM d GROUP BY source),
w AS (SELECT *, CASE (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight,
  CAST(3 * source_size AS DOUBLE) AS most, CAST(sum(source_size) OVER () AS DOUBLE) AS total FROM s),
l AS (SELECT *, (total - coalesce(sum(most) OVER (ORDER BY most / weight, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0))
  / sum(weight) OVER (ORDER BY most / weight, source ASC NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w),
c AS (SELECT *, max(CASE WHEN level <= most / weight THEN level END) OVER () AS common FROM l),
t AS (SELECT source, CAST(source_size AS BIGINT) AS source_size, least(most, coalesce(common * weight, most)) AS target FROM c),
p AS (SELECT d.doc_id, d.size, t.source_size, t.target, CAST(floor(t.target + 0.5) AS BIGINT) AS budget,
  coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.k, CAST(d.doc_id AS VARCHAR), d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
q AS (SELECT *, CASE WHEN source_size > 0 THEN budget // source_size ELSE 0 END AS whole FROM p)
SELECT doc_id, size, source_size, target, CAST(whole * size + greatest(0, least(size, budget - whole * source_size - before)) AS BIGINT) AS taken FROM q
"""
