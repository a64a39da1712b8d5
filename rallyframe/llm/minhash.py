"""Near-duplicate documents by b-bit MinHash.

A document's set holds its distinct word shingles. `BANDS * ROWS` minima per distinct text are cut
into bands; texts that agree in a band are candidates. Only the lowest `BITS` bits of each minimum
are kept, packed into longs; counting equal bits of two packed signatures, corrected for chance
agreement, estimates the similarity, and pairs estimated well below the threshold are left out. The
rest are confirmed on their full sets.

Groups of copies never become all their pairs. Equal word sequences are one text. In each band
bucket the texts are compared with the bucket's smallest; only texts that this has not joined to the
smallest's component are then compared with the bucket's texts of other components, so components
come out as from all pairs. At a similarity of 0.8 the bands miss a pair with a chance of 3e-6.

At scale: one pass over the texts, without a shuffle of them; what is shuffled are 16 bytes per text
and band, and packed signatures. Texts are fetched for candidates only. Buckets are joined, not
collected, so Spark can split a hot one; where rows of a bucket meet each other they are salted into tasks of bounded size.

Defined cases: a text without words, and null, has no shingles, links with nothing and stays. Rows
that share an id count as one document. A row with null id is never linked, and stays. Texts of
fewer words than a shingle have one shingle, the whole. Texts of any length are compared whole. Of equal texts, and in ties, the
smallest id stands for all. Empty tables give empty results. Other columns are not read, whatever their names; the filter
passes them through.
"""

from __future__ import annotations

from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import fresh, in_slices, keep_ids, written
from .components import components
from .tokens import shingles, word_ids, words_of

BANDS, ROWS, BITS = 32, 5, 2
HASHES = BANDS * ROWS
#: Standard errors of the estimate by which a candidate may fall below the threshold.
MARGIN = 5.0
_random = np.random.default_rng(20240607)
TIMES = _random.integers(1, 2**63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
PLUS = _random.integers(0, 2**63, HASHES, dtype=np.uint64)
HIGH = np.uint64(32)


def minima(values: np.ndarray) -> np.ndarray:
    """The smallest of each hash function over the shingles."""
    low = np.full(HASHES, 2**32 - 1, np.uint64)
    for k in range(0, len(values), 512):
        h = TIMES[:, None] * values[None, k : k + 512]
        h += PLUS[:, None]
        np.minimum(low, h.min(axis=1) >> HIGH, out=low)
    return low


def band_keys(low: np.ndarray) -> np.ndarray:
    key = np.arange(1, BANDS + 1, dtype=np.uint64)
    for row in low.reshape(BANDS, ROWS).T:
        key = (key ^ row) * np.uint64(0xBF58476D1CE4E5B9)
        key ^= key >> np.uint64(29)
    return key.view(np.int64)


def packed(low: np.ndarray) -> np.ndarray:
    """The lowest bits of each minimum, 64 // BITS of them in a long."""
    per = 64 // BITS
    cells = (low & np.uint64(2**BITS - 1)).reshape(-1, per)
    return np.bitwise_or.reduce(cells << (np.arange(per, dtype=np.uint64) * np.uint64(BITS)), axis=1).view(np.int64)


def _signer(width: int, id_type: pa.DataType):
    schema = pa.schema([("id", id_type), ("key", pa.binary()), ("n", pa.int64()), ("bands", pa.list_(pa.int64())), ("sig", pa.list_(pa.int64()))])

    def sign(batches):
        lately: dict[bytes, tuple] = {}  # copies are often near each other
        for batch in batches:
            for start, texts in in_slices(batch, 2_000_000, 1):
                rows = []
                for text in texts:
                    words = words_of(text)
                    if not words:
                        rows.append((None, 0, None, None))
                        continue
                    key = blake2b(b" ".join(words), digest_size=16).digest()
                    if key not in lately:
                        if len(lately) > 2000:
                            lately.clear()
                        values = np.unique(shingles(word_ids(words), width))
                        low = minima(values)
                        lately[key] = (key, len(values), band_keys(low), packed(low))
                    rows.append(lately[key])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(start, len(texts)), *(pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True), list(schema)[1:], strict=True))], schema=schema)

    return sign


def similarity(a: Column, b: Column) -> Column:
    """Estimate of the Jaccard similarity from two packed signatures."""
    off = F.lit(0)
    for k in range(HASHES * BITS // 64):
        x = F.get(a, F.lit(k)).bitwiseXOR(F.get(b, F.lit(k)))
        cell = x
        for shift in range(1, BITS):
            cell = cell.bitwiseOR(F.shiftrightunsigned(x, shift))
        mask = sum(1 << i for i in range(0, 64, BITS))
        off += F.bit_count(cell.bitwiseAND(F.lit(mask)))
    chance = 2.0**-BITS
    return (1 - off / HASHES - chance) / (1 - chance)


def least_estimate(percent: int) -> float:
    chance = 2.0**-BITS
    p = percent / 100 * (1 - chance) + chance
    return percent / 100 - MARGIN * (p * (1 - p) / HASHES) ** 0.5 / (1 - chance)


def plausible(percent: int, a: str, b: str) -> Column:
    """Pairs whose set sizes allow the similarity, and whose signatures suggest it."""
    x, y = F.col(f"{a}.n"), F.col(f"{b}.n")
    return (100 * F.least(x, y) >= percent * F.greatest(x, y)) & (similarity(F.col(f"{a}.sig"), F.col(f"{b}.sig")) >= least_estimate(percent))


def _confirmer(width: int, percent: int, id_type: pa.DataType):
    schema = pa.schema([("a", id_type), ("b", id_type)])

    def values(text: str) -> np.ndarray:
        return np.unique(shingles(word_ids(words_of(text)), width))

    def confirm(batches):
        last, ours = None, None
        for batch in batches:
            a, b, text_a, text_b = batch.columns
            good = []
            for i in range(batch.num_rows):
                if (at := a[i].as_py()) != last:
                    last, ours = at, values(text_a[i].as_py())
                theirs = values(text_b[i].as_py())
                both = len(np.intersect1d(ours, theirs, assume_unique=True))
                good.append(100 * both >= percent * (len(ours) + len(theirs) - both) > 0)
            keep = pa.array(good, pa.bool_())
            yield pa.RecordBatch.from_arrays([a.filter(keep), b.filter(keep)], schema=schema)

    return confirm


def confirmed(texts: DataFrame, pairs: DataFrame, width: int, percent: int) -> DataFrame:
    """Those of pairs (a, b) whose full sets are similar enough. texts: (id, text)."""
    kind = texts.schema["id"].dataType
    ids = pairs.select(F.col("a").alias("i")).union(pairs.select("b")).distinct()
    own = written(keep_ids(texts, ids, "id"), "texts")
    left, right = own.select(F.col("id").alias("a"), F.col("text").alias("text_a")), own.select(F.col("id").alias("b"), F.col("text").alias("text_b"))
    full = pairs.join(right, "b").join(left, "a").select("a", "b", "text_a", "text_b")
    return full.mapInArrow(_confirmer(width, percent, to_arrow_type(kind)), f"a {kind.simpleString()}, b {kind.simpleString()}").distinct()


#: Texts and shingles of one side of a block at most, but for a single text.
BLOCK_TEXTS, BLOCK_SHINGLES = 256, 100_000
#: Rows of a bucket whose signatures meet in one task.
SALTED = 512


def on(x: DataFrame, y: DataFrame, more: Column) -> Column:
    """Rows of a bucket that meet in one pair of salts, and `more`."""
    return (x.band == y.band) & (x.i == y.i) & (x.j == y.j) & more


def missed(source: DataFrame, shared: DataFrame, own: DataFrame, parts: DataFrame, width: int, percent: int) -> DataFrame:
    """Links (a, b) between texts of one bucket that lie in different components.

    A text counts only if the signature of some other in its bucket and another component suggests
    enough similarity. The sets of those that are left meet in blocks of bounded size, a task a
    pair of blocks, where all pairs are compared in full; only links that join components come out,
    fewer than a block's texts. So many texts that are almost similar enough cost no row per pair.
    """
    # Rows of a large bucket are dealt out by salt: `salts` follows from the bucket's size.
    salts = F.ceil(F.col("size") / SALTED).cast("int")
    salted = shared.filter("size > 2").select("band", "rep", "center", salts.alias("salts"), F.pmod(F.xxhash64("rep"), salts).cast("int").alias("salt"))
    placed = salted.join(parts.withColumnRenamed("node", "rep"), "rep", "left").select("band", "salts", "salt", "rep", "center", F.coalesce("component", "rep").alias("part"))
    placed = placed.join(parts.select(F.col("node").alias("center"), F.col("component").alias("home")), "center", "left").select("band", "salts", "salt", "rep", "part", F.coalesce("home", "center").alias("home"))
    each = F.explode(F.sequence(F.lit(0), F.col("salts") - 1))
    placed = placed.join(placed.filter("part <> home").select("band", "salts").distinct().select("band", each.alias("salt")), ["band", "salt"], "left_semi")
    placed = written(placed.join(own, "rep").select("band", "salts", "salt", "rep", "part", "home", F.struct("n", "sig").alias("own")), "placed")

    def side(name: str, rows: DataFrame, mine: str, other: str) -> DataFrame:
        """Rows of one side, each for all salts of the other."""
        return rows.select("band", F.col("salt").alias(mine), each.alias(other), "salts", *[F.col(c).alias(f"{c}_{name}") for c in ("rep", "part", "own")])

    different = plausible(percent, "own_x", "own_y") & (F.col("part_x") != F.col("part_y"))
    x, y = side("x", placed.filter("part <> home"), "i", "j"), side("y", placed, "j", "i")
    left = x.join(y.drop("salts"), on(x, y, different), "left_semi").select("band", F.col("rep_x").alias("rep"), F.col("part_x").alias("part"), F.col("own_x.n").alias("n"), F.col("i").alias("salt"), "salts")
    left = written(left.distinct(), "apart")
    if not left.limit(1).count():
        return left.select(F.col("rep").alias("a"), F.col("rep").alias("b"))
    again = side("x", left.join(own.select("rep", F.struct("n", "sig").alias("own")), "rep"), "i", "j")
    right = y.join(again.drop("salts"), on(y, again, different), "left_semi").select("band", F.col("rep_y").alias("rep"), F.col("part_y").alias("part"), F.col("own_y.n").alias("n"), F.col("j").alias("salt"), "salts")
    right = written(right.distinct(), "others")
    blocks = right.groupBy("band", "salts").agg(F.greatest(F.ceil(F.count("*") / BLOCK_TEXTS), F.ceil(F.sum("n") / BLOCK_SHINGLES)).cast("int").alias("blocks")).select("band", each.alias("salt"), "blocks")
    mine = F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int")
    every = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    first = left.join(blocks, ["band", "salt"]).select("band", "rep", "part", mine.alias("i"), every.alias("j"), F.lit(True).alias("x"))
    second = right.join(blocks, ["band", "salt"]).select("band", "rep", "part", mine.alias("j"), every.alias("i"), F.lit(False).alias("x")).select("band", "rep", "part", "i", "j", "x")
    kind = source.schema["id"].dataType
    name = kind.simpleString()
    ids = left.select("rep").union(right.select("rep")).distinct()
    sets = keep_ids(source, ids, "id").mapInArrow(_setter(width, to_arrow_type(kind)), f"id {name}, values array<long>")
    sets = written(sets.groupBy("id").agg(F.first("values").alias("values")), "sets")
    met = first.unionByName(second).join(sets, F.col("rep") == F.col("id")).select("band", "i", "j", "x", "rep", "part", "values")
    met = met.repartition("band", "i", "j").sortWithinPartitions("band", "i", "j")
    return met.mapInArrow(_linker(percent, to_arrow_type(kind)), f"a {name}, b {name}").distinct()


def _setter(width: int, id_type: pa.DataType):
    schema = pa.schema([("id", id_type), ("values", pa.list_(pa.int64()))])

    def make(batches):
        for batch in batches:
            for start, texts in in_slices(batch, 1_000_000, 1):
                values = [np.unique(shingles(word_ids(words_of(t)), width)).view(np.int64) for t in texts]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(start, len(texts)), pa.array(values, pa.list_(pa.int64()))], schema=schema)

    return make


def common_counts(xs: list[np.ndarray], ys: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of all x with all y; of sets as arrays of distinct values."""
    if len(xs) * len(ys) <= 16:
        return np.array([[len(np.intersect1d(x, y, assume_unique=True)) for y in ys] for x in xs], np.int64)
    # Only values that both sides have; a few thousand at a time, as columns of two 0/1 matrices.
    sides = [(np.concatenate(s), np.repeat(np.arange(len(s)), [len(v) for v in s])) for s in (xs, ys)]
    vocabulary = np.intersect1d(sides[0][0], sides[1][0])
    out = np.zeros((len(xs), len(ys)), np.float32)
    for k in range(0, len(vocabulary), 4096):
        part = vocabulary[k : k + 4096]
        both = []
        for (values, row), n in zip(sides, (len(xs), len(ys)), strict=True):
            at = np.searchsorted(part, values)
            at[at == len(part)] = 0
            hit = part[at] == values
            m = np.zeros((n, len(part)), np.float32)
            m[row[hit], at[hit]] = 1
            both.append(m)
        out += both[0] @ both[1].T
    return np.rint(out).astype(np.int64)


def _linker(percent: int, id_type: pa.DataType):
    schema = pa.schema([("a", id_type), ("b", id_type)])

    def links(group: list[tuple]):
        xs, ys = [r for r in group if r[0]], [r for r in group if not r[0]]
        if not xs or not ys:
            return
        nx, ny = np.array([len(r[3]) for r in xs]), np.array([len(r[3]) for r in ys])
        common = common_counts([r[3] for r in xs], [r[3] for r in ys])
        good = 100 * common >= percent * (nx[:, None] + ny[None, :] - common)
        joined: dict = {}

        def root(p):
            while joined.get(p, p) != p:
                p = joined[p]
            return p

        for i, j in zip(*np.nonzero(good), strict=True):
            p, q = root(xs[i][2]), root(ys[j][2])
            if p != q:
                joined[max(p, q)] = min(p, q)
                yield (xs[i][1], ys[j][1]) if xs[i][1] < ys[j][1] else (ys[j][1], xs[i][1])

    def link(batches):
        key, group, out = None, [], []
        for batch in batches:
            band, i, j, x, rep, part = (batch.column(k).to_pylist() for k in range(6))
            lists = batch.column(6)
            flat, ends = lists.flatten().to_numpy(), np.concatenate(([0], np.cumsum(lists.value_lengths().to_numpy())))
            for k in range(batch.num_rows):
                if (at := (band[k], i[k], j[k])) != key:
                    out += links(group)
                    key, group = at, []
                group.append((x[k], rep[k], part[k], flat[ends[k] : ends[k + 1]].copy()))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, id_type) for c in zip(*out, strict=True)], schema=schema)
                out = []
        out += links(group)
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, id_type) for c in zip(*out, strict=True)], schema=schema)

    return link


def near_duplicates(docs: DataFrame, id: str = "doc_id", text: str = "text", width: int = 5, percent: int = 80) -> DataFrame:
    """(id, n_shingles, component_id, kept) of every row of docs."""
    kind = docs.schema[id].dataType
    source = docs.select(F.col(f"`{id}`").alias("id"), F.col(f"`{text}`").cast("string").alias("text"))
    signed = written(source.mapInArrow(_signer(width, to_arrow_type(kind)), f"id {kind.simpleString()}, key binary, n long, bands array<long>, sig array<long>"), "signed")
    # One text of each word sequence stands for its copies.
    usable = signed.filter("id is not null and key is not null")
    texts = written(usable.groupBy("key").agg(F.min("id").alias("rep"), F.first("n").alias("n"), F.first("bands").alias("bands"), F.first("sig").alias("sig")), "distinct")
    member = written(usable.select("id", "key").join(texts.select("key", "rep"), "key").select("id", "rep"), "member")
    links = _same_id(member)
    # Buckets with two texts or more, each with its smallest.
    banded = texts.select("rep", F.explode("bands").alias("band"))
    centers = banded.groupBy("band").agg(F.min("rep").alias("center"), F.count("*").alias("size")).filter("size > 1")
    shared = written(banded.join(centers, "band").select("band", "rep", "center", "size"), "buckets")
    own = texts.select("rep", "n", "sig")

    def signatures(name: str) -> DataFrame:
        return own.select(F.col("rep").alias(name), F.struct("n", "sig").alias(f"of_{name}"))

    pairs = shared.filter("rep <> center").select(F.col("center").alias("a"), F.col("rep").alias("b")).distinct()
    likely = written(pairs.join(signatures("b"), "b").join(signatures("a"), "a").filter(plausible(percent, "of_a", "of_b")).select("a", "b"), "likely")
    links = written(links.union(confirmed(source, likely, width, percent)), "confirmed")
    parts = components(links)
    links = written(links.union(missed(source, shared, own, parts, width, percent)), "links")
    parts = components(links)
    found = member.join(parts.withColumnRenamed("node", "rep"), "rep", "left").select("id", F.coalesce("component", "rep").alias("c")).groupBy("id").agg(F.min("c").alias("c"))
    out = signed.select("id", F.col("n").alias("n_shingles")).join(found, "id", "left").select("id", "n_shingles", F.coalesce("c", "id").alias("component_id"))
    return out.select(F.col("id").alias(id), "n_shingles", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))


def _same_id(member: DataFrame) -> DataFrame:
    """Links between texts of rows that share an id."""
    split = member.groupBy("id").agg(F.min("rep").alias("low"), F.max("rep").alias("high")).filter("low <> high").select("id", "low")
    return member.join(split, "id").filter("rep <> low").select(F.col("low").alias("a"), F.col("rep").alias("b"))


def near_duplicate_filter(docs: DataFrame, id: str = "doc_id", text: str = "text", width: int = 5, percent: int = 80) -> DataFrame:
    """One document of each component, with its own columns; rows without id or words all stay.

    Of rows that repeat an id, one stays.
    """
    judged = near_duplicates(docs, id, text, width, percent)
    kept, = fresh(docs, "kept_id")
    gone = judged.filter(F.col(id).isNotNull() & ~F.col("kept")).select(F.col(id).alias(kept)).distinct()
    out = docs.join(gone, F.col(f"`{id}`") == F.col(kept), "left_anti")
    repeated = judged.filter(F.col(id).isNotNull() & F.col("kept")).groupBy(id).count().filter("count > 1")
    if not repeated.limit(1).count():
        return out
    stay = repeated.select(F.col(id).alias(kept))
    whole = [c for c in docs.columns if c != id]
    once = out.join(stay, F.col(f"`{id}`") == F.col(kept), "left_semi").groupBy(F.col(f"`{id}`")).agg(F.min(F.struct(*[F.col(f"`{c}`") for c in whole])).alias(kept))
    once = once.select(F.col(f"`{id}`"), F.col(f"{kept}.*")).select(*[F.col(f"`{c}`") for c in docs.columns])
    return out.join(stay, F.col(f"`{id}`") == F.col(kept), "left_anti").unionByName(once)


def sql(width: int, percent: int) -> str:
    """The same rows in SQL, from all pairs of texts that share a shingle. Ids are not null and not repeated."""
    words = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+')"
    return f"""
WITH RECURSIVE w AS (SELECT doc_id, {words} AS w FROM documents),
t AS (SELECT w, min(doc_id) AS rep FROM w WHERE len(w) > 0 GROUP BY w),
x AS (SELECT rep, unnest(list_distinct(CASE WHEN len(w) < {width} THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - {width - 2}), lambda i: array_to_string(w[i : i + {width - 1}], ' ')) END)) AS s FROM t),
n AS (SELECT rep, count(*) AS n FROM x GROUP BY 1),
p AS (SELECT a.rep AS a, b.rep AS b, count(*) AS shared FROM x a JOIN x b ON a.s = b.s AND a.rep < b.rep GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n x ON x.rep = a JOIN n y ON y.rep = b WHERE 100 * shared >= {percent} * (x.n + y.n - shared)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT rep, rep AS other FROM n UNION SELECT r.rep, e.b FROM r JOIN e ON r.other = e.a),
c AS (SELECT rep, min(other) AS component FROM r GROUP BY 1)
SELECT w.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, coalesce(c.component, w.doc_id) AS component_id, coalesce(c.component, w.doc_id) = w.doc_id AS kept
FROM w LEFT JOIN t ON t.w = w.w LEFT JOIN n ON n.rep = t.rep LEFT JOIN c ON c.rep = t.rep
"""
