"""Importance resampling towards a target corpus, by bucket-partitioned inverted postings.

Features are runs of one to three words, hashed into buckets. What a bucket says for the target is its gain: the logarithm of its
share of the target's features over its share of the documents'. A document's weight is the sum of its features' gains; documents
are drawn without replacement by adding a Gumbel number to it, taken from a hash of the id, and keeping the highest scores.

A document's features become postings (bucket, document, count), which are shuffled by bucket. A task holds the counts of its
buckets in both corpora beside their postings, computes each gain there, and emits what its buckets add to each document; a second
shuffle sums that by document.

At scale: the postings of a document that fall to one range of 256 buckets are one row, two bytes a posting; ranges are salted by
row, so a frequent bucket, or a range of a large corpus, is many groups of some GROUP documents, and each range's counts are
repeated once a salt. Counts are summed in a task before they are shuffled: 10,000 numbers a task. Texts are read twice, once for
counts and once for postings; they are never shuffled. Ranks come from ranges of scores: their sizes tell where the draw ends, and
only the ranges before that are sorted, each alone. Only the borders of ranges pass through the driver, RANGES at most. Rows are
told apart by their place in their partition, so the documents should come in the same order when a task is repeated, as from a
table.

Defined cases: null and empty texts have no features, weight 0, and aren't drawn, having fewer than LEAST words. Texts are whole,
of any length. A null id has the hash of an empty text, and comes last in ties. Repeated rows, and rows that share an id, are
documents of their own; of rows that agree in score and id, any comes first. An empty corpus, or target, counts as one with no features. Other
columns aren't read.
"""

from __future__ import annotations

import math
from itertools import chain
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import in_slices, written

BUCKETS, LONGEST, LEAST, PERCENT, SEED = 10_000, 3, 20, 5, 42
#: Buckets of a range, as an offset is a byte; documents of a group, about; ranges of scores.
WIDTH, GROUP, RANGES = 256, 20_000, 1024
#: ASCII characters other than digits and letters part words; A-Z count as a-z.
_PARTS = bytes(c if chr(c).isalnum() or c >= 0x80 else 0x20 for c in range(256)).lower()


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(_PARTS).split()


def hashes(words: list[bytes], longest: int = LONGEST) -> np.ndarray:
    """crc32 of every run of one to `longest` words, joined by one space: that of a run goes on from that of the run without its last word."""
    n = len(words)
    run = list(map(crc32, words))
    found = [run]
    if longest > 1:
        spaced = [b" " + w for w in words]
        for k in range(1, min(longest, n)):
            run = list(map(crc32, spaced[k:], run))
            found.append(run)
    return np.fromiter(chain.from_iterable(found), np.int64, sum(map(len, found)))


def _counter(buckets: int, longest: int):
    def counted(batches):
        total, texts = np.zeros(buckets, np.int64), 0
        for batch in batches:
            texts += batch.num_rows
            for text in batch.column(0):
                total += np.bincount(hashes(words_of(text.as_py()), longest) % buckets, minlength=buckets)
        met = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(met, -1), pa.int32()), pa.array(np.append(total[met], texts))], ["bucket", "n"])

    return counted


def bucket_counts(texts: DataFrame, text: str = "text", buckets: int = BUCKETS, longest: int = LONGEST) -> DataFrame:
    """(bucket, n): features of all texts by bucket, those without any left out; bucket -1 has the number of texts."""
    counts = texts.select(F.col(f"`{text}`")).mapInArrow(_counter(buckets, longest), "bucket int, n long")
    return counts.groupBy("bucket").agg(F.sum("n").alias("n"))


def _poster(buckets: int, longest: int, salts: int, schema: pa.Schema):
    """Rows of postings by range of buckets; and a row (range -1) with a document's id, words and number of features."""

    def posted(batches):
        row = TaskContext.get().partitionId() << 33
        for batch in batches:
            for start, texts in in_slices(batch, 2_000_000, 1):
                places, ranges, offsets, counts, n_words, n_features = [], [], [], [], [], []
                for i, text in enumerate(texts):
                    words = words_of(text)
                    of_bucket = np.bincount(hashes(words, longest) % buckets, minlength=buckets)
                    met = np.flatnonzero(of_bucket)
                    times = of_bucket[met]
                    n_words.append(len(words))
                    n_features.append(int(times.sum()))
                    # A count takes a byte; a greater one is several postings.
                    full, rest = np.divmod(times, 255)
                    if full.any():
                        more = full + (rest > 0)
                        ends = np.cumsum(more)
                        met, times = np.repeat(met, more), np.full(ends[-1], 255)
                        times[ends[rest > 0] - 1] = rest[rest > 0]
                    cuts = np.searchsorted(met, np.arange(0, buckets + WIDTH, WIDTH))
                    for r in np.flatnonzero(np.diff(cuts)):
                        part = slice(cuts[r], cuts[r + 1])
                        places.append(i)
                        ranges.append(r)
                        offsets.append((met[part] - r * WIDTH).astype(np.uint8).tobytes())
                        counts.append(times[part].astype(np.uint8).tobytes())
                n, m = len(texts), len(places)
                every, at = np.arange(n, dtype=np.int64) + row, np.array(places, np.int64) + row
                row += n
                none = pa.nulls(m, schema.field("id").type)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.concatenate([np.full(n, -1), np.array(ranges, np.int64)]), pa.int32()),
                        pa.array(np.concatenate([every, at]) % salts),
                        pa.array(np.concatenate([every, at])),
                        pa.chunked_array([batch.column(0).slice(start, n), none], schema.field("id").type).combine_chunks(),
                        pa.concat_arrays([pa.array(n_words, pa.int64()), pa.nulls(m, pa.int64())]),
                        pa.concat_arrays([pa.array(n_features, pa.int64()), pa.nulls(m, pa.int64())]),
                        pa.concat_arrays([pa.nulls(n, pa.binary()), pa.array(offsets, pa.binary())]),
                        pa.concat_arrays([pa.nulls(n, pa.binary()), pa.array(counts, pa.binary())]),
                    ],
                    schema=schema,
                )

    return posted


def _gains(s, t, all_s: int, all_t: int, buckets: int) -> np.ndarray:
    """floor(1000 ln of the ratio of smoothed shares) of each bucket, in doubles."""
    ratio = [(b + 1) * float(all_s + buckets) / ((a + 1) * float(all_t + buckets)) for a, b in zip(map(float, s), map(float, t), strict=True)]
    return np.array([math.floor(1000 * math.log(x)) for x in ratio], np.int64)


def _contributor(buckets: int, schema: pa.Schema):
    def contributed(postings: pa.Table, totals: pa.Table) -> pa.Table:
        if not totals.num_rows:  # the rows of documents themselves
            return pa.table([postings["row"], pa.array(np.zeros(postings.num_rows, np.int64)), postings["id"], postings["n_words"], postings["n_features"]], schema=schema)
        about = totals.to_pylist()[0]
        gain = _gains(about["s"], about["t"], about["all_s"], about["all_t"], buckets)
        rows = postings.num_rows
        if not rows:
            return schema.empty_table()
        offsets, counts = (postings[c].combine_chunks() for c in ("offsets", "counts"))
        flat = [np.frombuffer(b"".join(x.to_pylist()), np.uint8) for x in (offsets, counts)]
        starts = np.concatenate([[0], np.cumsum(np.asarray(pa.compute.binary_length(offsets)))[:-1]])
        added = np.add.reduceat(gain[flat[0]] * flat[1], starts)
        none = pa.nulls(rows, pa.int64())
        return pa.table([postings["row"], pa.array(added), pa.nulls(rows, schema.field("id").type), none, none], schema=schema)

    return contributed


def weights(docs: DataFrame, target: DataFrame, id: str = "doc_id", text: str = "text", target_text: str = "text", buckets: int = BUCKETS, longest: int = LONGEST) -> DataFrame:
    """(id, n_words, n_features, weight) of every document."""
    spark, kind = docs.sparkSession, docs.schema[id].dataType
    both = bucket_counts(docs, text, buckets, longest).select("bucket", F.col("n").alias("s"), F.lit(0).cast("long").alias("t"))
    both = both.union(bucket_counts(target, target_text, buckets, longest).select("bucket", F.lit(0).cast("long"), "n"))
    totals = written(both.groupBy("bucket").agg(F.sum("s").alias("s"), F.sum("t").alias("t")), "bucket-counts")
    features = F.col("bucket") >= 0
    whole = totals.agg(F.coalesce(F.sum(F.when(features, F.col("s"))), F.lit(0)).alias("s"), F.coalesce(F.sum(F.when(features, F.col("t"))), F.lit(0)).alias("t"), F.coalesce(F.sum(F.when(~features, F.col("s"))), F.lit(0)).alias("docs")).first()
    salts = max(1, -(-whole.docs // GROUP))
    every = spark.range(buckets).select(F.col("id").cast("int").alias("bucket"))
    by_range = every.join(totals, "bucket", "left").groupBy(F.floor(F.col("bucket") / WIDTH).cast("int").alias("range"))
    counts = by_range.agg(F.sort_array(F.collect_list(F.struct("bucket", F.coalesce("s", F.lit(0)).alias("s"), F.coalesce("t", F.lit(0)).alias("t")))).alias("c"))
    counts = counts.select("range", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))).alias("salt"), F.col("c.s").alias("s"), F.col("c.t").alias("t"), F.lit(whole.s).cast("long").alias("all_s"), F.lit(whole.t).cast("long").alias("all_t"))
    id_type = to_arrow_type(kind)
    info = [("id", id_type), ("n_words", pa.int64()), ("n_features", pa.int64())]
    named = ", ".join(["id " + kind.simpleString(), "n_words long", "n_features long"])
    schema = pa.schema([("range", pa.int32()), ("salt", pa.int64()), ("row", pa.int64()), *info, ("offsets", pa.binary()), ("counts", pa.binary())])
    postings = docs.select(F.col(f"`{id}`").alias("id"), F.col(f"`{text}`").alias("text")).mapInArrow(_poster(buckets, longest, salts, schema), f"range int, salt long, row long, {named}, offsets binary, counts binary")
    out = pa.schema([("row", pa.int64()), ("added", pa.int64()), *info])
    added = postings.groupBy("range", "salt").cogroup(counts.groupBy("range", "salt")).applyInArrow(_contributor(buckets, out), f"row long, added long, {named}")
    return added.groupBy("row").agg(F.max("id").alias("id"), F.max("n_words").alias("n_words"), F.max("n_features").alias("n_features"), F.sum("added").alias("weight")).drop("row")


def score(weight: Column, id: Column, seed: int = SEED) -> Column:
    """The weight and a Gumbel number from the id's hash, in thousandths."""
    lot = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(id.cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    return (weight + F.floor(-1000 * F.ln(-F.ln((lot + 0.5) / 4294967296.0)))).cast("long")


def ranked(scored: DataFrame, percent: int) -> DataFrame:
    """scored (id, score, drawable), a stored table, with the rank of the drawn: `percent` of the drawable rows, of highest score, ties to the smaller id."""
    able = scored.filter("drawable")
    most = able.count() * percent // 100
    # Borders of ranges where the draw will end, and above; whatever they are, the counts of ranges are exact.
    low = max(0.0, 1 - 1.2 * percent / 100)
    borders = able.agg(F.percentile_approx("score", [low + (1 - low) * k / RANGES for k in range(RANGES)], 100 * RANGES).alias("b")).first().b or []
    borders = sorted(set(borders))
    above = F.size(F.filter(F.array(*map(F.lit, borders)).cast("array<long>"), lambda b: b > F.col("score"))) if borders else F.lit(0)
    part = F.when(F.col("drawable"), F.when(F.col("score") < (borders or [0])[0], F.lit(len(borders))).otherwise(above))
    cut = scored.withColumn("part", part)
    starts, before = {}, 0
    for r in cut.filter("drawable").groupBy("part").agg(F.count("*").alias("n")).orderBy("part").collect():  # RANGES + 1 rows at most
        if before < most:
            starts[r.part] = before
        before += r.n
    if not starts:
        return scored.withColumn("rank", F.lit(None).cast("long"))
    offset = F.element_at(F.create_map(*[F.lit(x) for pair in starts.items() for x in pair]), F.col("part")).cast("long")
    inside = Window.partitionBy("part").orderBy(F.col("score").desc(), F.col("id").asc_nulls_last())
    near = F.coalesce(F.col("part") <= max(starts), F.lit(False))
    rank = F.row_number().over(inside) + offset
    placed = cut.filter(near).withColumn("rank", rank).withColumn("rank", F.when(F.col("rank") <= most, F.col("rank")))
    return placed.unionByName(cut.filter(~near).withColumn("rank", F.lit(None).cast("long"))).drop("part")


def resample(docs: DataFrame, target: DataFrame, id: str = "doc_id", text: str = "text", target_text: str = "text", percent: int = PERCENT, least: int = LEAST, seed: int = SEED, **features) -> DataFrame:
    """(id, n_features, weight, score, rank) of every document; rank is null for those that aren't drawn."""
    weighed = weights(docs, target, id, text, target_text, **features)
    scored = written(weighed.withColumn("score", score(F.col("weight"), F.col("id"), seed)).withColumn("drawable", F.col("n_words") >= least), "scored")
    return ranked(scored, percent).select(F.col("id").alias(id), "n_features", "weight", "score", "rank")


#: The same rows in SQL; the checksum is computed from its polynomial.
SQL = r"""
WITH tab AS (SELECT list(c ORDER BY i) AS tab FROM (SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, k: xor(c >> 1, CASE WHEN c & 1 = 1 THEN 3988292384 ELSE 0 END)) AS c FROM range(256) r(i))),
d AS (SELECT row_number() OVER () AS row, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
q AS (SELECT regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
a AS (SELECT row, w FROM d UNION ALL SELECT NULL, w FROM q),
f AS (SELECT row, f, count(*) AS n FROM (SELECT row, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]), list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]))) AS f FROM a) GROUP BY row, f),
h AS (SELECT f, hex(encode(f)) AS h FROM (SELECT DISTINCT f FROM f)),
b AS (SELECT f, xor(list_reduce(list_prepend(4294967295, list_transform(range(1, len(h), 2), lambda k: CAST('0x' || substr(h, k, 2) AS BIGINT))), lambda c, x: xor(c >> 8, tab[(xor(c, x) & 255) + 1])), 4294967295) % 10000 AS bucket FROM h, tab),
p AS (SELECT row, bucket, sum(n) AS n FROM f JOIN b USING (f) GROUP BY row, bucket),
g AS (SELECT bucket, CAST(coalesce(sum(n) FILTER (row IS NOT NULL), 0) AS DOUBLE) AS s, CAST(coalesce(sum(n) FILTER (row IS NULL), 0) AS DOUBLE) AS t FROM p GROUP BY bucket),
o AS (SELECT sum(s) AS s, sum(t) AS t FROM g),
k AS (SELECT bucket, CAST(floor(1000::DOUBLE * ln((g.t + 1) * (o.s + 10000) / ((g.s + 1) * (o.t + 10000)))) AS BIGINT) AS gain FROM g, o),
m AS (SELECT row, sum(n) AS n_features, sum(n * gain) AS weight FROM p JOIN k USING (bucket) WHERE row IS NOT NULL GROUP BY row),
e AS (SELECT d.doc_id, len(w) AS n_words, CAST(coalesce(n_features, 0) AS BIGINT) AS n_features, CAST(coalesce(weight, 0) AS BIGINT) AS weight,
  CAST(('0x' || substr(sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8)) AS BIGINT) AS h FROM d LEFT JOIN m USING (row)),
z AS (SELECT *, CAST(weight + floor(-1000::DOUBLE * ln(-ln((CAST(h AS DOUBLE) + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT) AS score FROM e),
y AS (SELECT *, row_number() OVER (PARTITION BY n_words >= 20 ORDER BY score DESC, doc_id ASC NULLS LAST) AS place, count(*) FILTER (n_words >= 20) OVER () AS able FROM z)
SELECT doc_id, n_features, weight, score, CASE WHEN n_words >= 20 AND place <= able * 5 // 100 THEN place END AS rank FROM y
"""
