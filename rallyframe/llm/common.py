"""What the corpus operators share: table access, shared intermediate storage, word splitting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.storage import discard, fresh_path, stored

__all__ = ["GAP", "WORD", "discard", "fresh", "fresh_path", "in_slices", "keep_ids", "let", "likely", "table", "word_count", "words_of", "written"]
#: Tables between steps lie in the shared folder; a lost executor loses nothing.
written = stored

#: White space between words, and a run of anything else.
GAP = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"
#: Bytes of a set of ids that may be sent to every executor; an id takes ID_BYTES there, and a text as many more as it is long.
BROADCAST_BYTES, ID_BYTES = 32 << 20, 64


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names that df doesn't have, whatever the case."""
    have = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in have:
            name = f"_{name}"
        have.add(name.lower())
        out.append(name)
    return out


def words_of(text: Column) -> Column:
    """Words of a text as an array; of null, an empty one."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), GAP), "")


def word_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def let(value: Column, body) -> Column:
    """body(value), where value is computed once however often body names it.

    Inside a lambda the optimizer copies an outer expression into every use, and would evaluate
    it for each element; a lambda variable it can't copy.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def keep_ids(df: DataFrame, ids: DataFrame, key: str, most: int = BROADCAST_BYTES) -> DataFrame:
    """Rows of df whose key is in ids (one column, distinct).

    ids go to every executor if they are measured and found to be small; beyond that both sides
    are shuffled on the key.
    """
    name = ids.columns[0]
    ids = ids.withColumnRenamed(name, key)
    length = F.lit(0) if isinstance(ids.schema[key].dataType, T.NumericType) else F.length(F.col(key).cast("string"))
    head = ids.limit(most // ID_BYTES + 1).agg(F.count("*").alias("n"), F.coalesce(F.sum(length), F.lit(0)).alias("chars")).first()
    if ID_BYTES * head.n + 4 * head.chars <= most:
        ids = F.broadcast(ids)
    return df.join(ids, key, "left_semi")


def likely(df: DataFrame, ids: DataFrame, key: str, most: int = BROADCAST_BYTES) -> DataFrame:
    """Rows of df whose key is in ids (one column), and a few others; an exact join is to follow.

    Every executor gets one bit for each hash of an id, of 64 bits an id and `most` bytes at most: so df is
    not shuffled, however many ids there are. At 30 million ids and 32 MB about one row in nine passes that shouldn't.
    """
    place, bucket, other, bits = fresh(df, "place", "bucket", "other", "bits")
    size = min(8 * most, 1 << max(15, (64 * ids.count()).bit_length()))
    at = F.pmod(F.xxhash64(F.col(ids.columns[0])), F.lit(size))
    held = ids.select(at.alias(place)).groupBy(F.bitmap_bucket_number(place).alias(other)).agg(F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias(bits))
    asked = df.withColumn(place, F.pmod(F.xxhash64(F.col(key)), F.lit(size))).withColumn(bucket, F.bitmap_bucket_number(place))
    within = F.bitmap_bit_position(place).cast("int")
    byte = F.conv(F.hex(F.substring(F.col(bits), (within / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    found = asked.join(F.broadcast(held), F.col(bucket) == F.col(other)).filter(F.getbit(byte, within % 8) == 1)
    return found.select(*df.columns)


def in_slices(batch, chars: int, column: int = 0):
    """(start, texts) of an Arrow batch, a few million characters at a time; None stays None."""
    texts, start, size, part = batch.column(column), 0, 0, []
    for i in range(batch.num_rows):
        text = texts[i].as_py()
        part.append(text)
        size += len(text or "")
        if size >= chars:
            yield start, part
            start, size, part = i + 1, 0, []
    if part:
        yield start, part
