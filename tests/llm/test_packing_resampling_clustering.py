"""Packing, resampling and clustering against brute force, with odd rows, ties and clashing columns."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest

from rallyframe.llm import clustering, packing, resampling

public_tokenizers = pytest.importorskip("public_tokenizers")
PATH = public_tokenizers.path("word_bpe_49k.json")
ODD = [None, "", " \t\n", "x", "é" * 3000, "a" * 30_000, "word " * 9000, "It's Mixed Case's WORDS here " * 4, "\U0001f600 smile　é e ́x " * 30, "a\x1cb\x1d \x85c\xa0d", "in<|endoftext|>side <|startoftext|>", "İSTANBUL ΣΣ x y"]


def documents(spark, texts, ids=None):
    rows = list(zip(ids or range(len(texts)), texts, strict=True))
    # Columns with the names of steps and results ride along.
    return spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as group", "'x' as ids", "2.5 as row", "null as start", "7 as score", "'q' as id")


# Packing


def check_packing(pieces, texts_by_id, tokens, capacity):
    """Every id of every document lies in one piece, and sequences are gapless, full, or a power of two. Sizes of sequences."""
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in pieces:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append(r)
    for d, texts in texts_by_id.items():
        want = Counter()
        for t in texts:
            ids = [*tokens(t or ""), 1]
            want[len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())] += 1
        got = sorted(by_doc.pop(d), key=lambda r: r.start)
        if len(texts) == 1:
            assert [r.start for r in got] == [sum(x.length for x in got[:k]) for k in range(len(got))]
            ids = b"".join(r.ids for r in got)
            assert Counter([(got[0].doc_tokens, zlib.crc32(ids))]) == want
        assert sum(r.length for r in got) == sum(n * k for (n, _), k in want.items())
        assert all(len(r.ids) == 4 * r.length for r in got)
    assert not by_doc
    sizes = []
    for group in by_sequence.values():
        group.sort(key=lambda r: r.offset)
        assert [r.offset for r in group] == [sum(x.length for x in group[:k]) for k in range(len(group))]
        sizes.append(sum(r.length for r in group))
    assert all(n == capacity or n < capacity and n & (n - 1) == 0 for n in sizes)
    return sizes


@pytest.mark.parametrize(("capacity", "group"), [(2048, 2048), (64, 40)])
def test_packing_against_the_whole_encoding(spark, monkeypatch, capacity, group):
    from tokenizers import Tokenizer

    monkeypatch.setattr(packing, "GROUP", group)
    rnd = random.Random(4)
    texts = [*ODD, *(" ".join(rnd.choice(("Net", "ball's", "réplay", "42nd", "x-y_z", "qwzx")) for _ in range(rnd.randrange(300))) for _ in range(150))]
    texts += texts[:30]
    ids = [*range(len(texts) - 3), None, None, 5]
    docs = documents(spark, texts, ids)
    tok = Tokenizer.from_file(PATH)
    by_id = defaultdict(list)
    for d, t in zip(ids, texts, strict=True):
        by_id[d].append(t)
    found = packing.sequences(docs, PATH, capacity=capacity).collect()
    sizes = check_packing(found, by_id, lambda t: tok.encode(t, add_special_tokens=False).ids, capacity)
    assert sum(n < capacity for n in sizes) <= 11 * len({r.sequence_id >> 24 for r in found})
    crc = packing.packed(docs, PATH, capacity=capacity)
    assert crc.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    assert Counter(r.ids_crc32 for r in crc.collect()) == Counter(zlib.crc32(r.ids) for r in found)


def test_packing_of_no_documents(spark):
    assert packing.packed(documents(spark, []), PATH).count() == 0
    one = packing.packed(documents(spark, [None]), PATH).collect()
    assert [(r.start, r.length, r.doc_tokens, r.offset) for r in one] == [(0, 1, 1, 0)]


def test_words_like_the_whole_encoding(sf_dir):
    import pyarrow.parquet as pq

    words = packing.words_of(open(PATH, encoding="utf-8").read())
    encoder = words.encoder
    assert words.split
    rnd = random.Random(12)
    ranges = [range(0x21, 0x7F), range(0xA0, 0x180), range(0x21, 0x180), range(0x300, 0x400), range(0x20, 0xD7FF)]
    texts = ["".join(chr(rnd.choice(r)) for _ in range(rnd.randrange(1, 30))) for r in ranges for _ in range(3000)]
    texts += [t for t in ODD if t is not None] + ["ΑΣ ΑΣΑ", "don't WE'LL o'clock's '", "x" * 65, "É" * 64]
    texts += [t for t in pq.read_table(f"{sf_dir}/documents.parquet")["text"].to_pylist() if t is not None]
    for text in texts:
        assert words.ids(text) == np.array(encoder.encode(text, add_special_tokens=False).ids, "<u2").tobytes(), repr(text[:60])


def test_differencing_like_the_plain_method():
    """Against partitions held as whole lists of windows, merged in opposite order."""
    rnd = random.Random(9)
    for _ in range(60):
        sizes = [rnd.choice((rnd.randrange(1, 2048), 1, 700)) for _ in range(rnd.randrange(1, 40))]
        m = rnd.randrange(1, 12)
        got = packing.differencing(sizes, m)
        assert sorted(k for w in got for k in w[2]) == list(range(len(sizes)))
        assert all(s == sum(sizes[k] for k in places) for s, _, places in got)
        # Sums of the plain method; ties may be merged in another order, so spreads are held by a bound.
        parts = [sorted([s] + [0] * (m - 1)) for s in sizes]
        while len(parts) > 1:
            parts.sort(key=lambda p: p[-1] - p[0])
            a, b = parts.pop(), parts.pop()
            parts.append(sorted(x + y for x, y in zip(a, reversed(b), strict=True)))
        sums = sorted([w[0] for w in got] + [0] * (m - len(got)))
        assert abs((sums[-1] - sums[0]) - (parts[0][-1] - parts[0][0])) <= max(sizes)
    assert packing.differencing([8, 7, 6, 5, 4], 2)[-1][0] == 16  # the known outcome: 16 and 14
    assert [w[0] for w in packing.differencing([5] * 9, 3)] == [15, 15, 15]


def test_the_window_count_rises_until_all_fit():
    rnd = random.Random(5)
    for n in (1, 2, 30, 600):
        sizes = [rnd.randrange(1, 2048) for _ in range(n)]
        windows = packing.near_equal(sizes, 2048)
        assert max(w[0] for w in windows) <= 2048
        assert len(windows) <= 1 + 1.25 * sum(sizes) / 2048
        kept = packing.fill(windows, sizes, 2048)
        assert Counter(k for s in kept for k, _, _ in s).keys() == set(range(n))
        # Only the windows over the tokens' need are cut: most pieces stay whole.
        assert sum(len(s) for s in kept) <= n + len(kept)


# Resampling


def brute_weights(docs, target):
    def features(text):
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
        return w, [" ".join(w[i : i + n]) for n in (1, 2, 3) for i in range(len(w) - n + 1)]

    s, t = Counter(), Counter()
    for counts, texts in ((s, docs), (t, target)):
        for x in texts:
            counts.update(zlib.crc32(f.encode()) % 10000 for f in features(x)[1])
    all_s, all_t = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (all_s + 10000) / ((s[b] + 1) * (all_t + 10000))))
    return [(len(w), len(f), sum(gain(zlib.crc32(x.encode()) % 10000) for x in f)) for w, f in map(features, docs)]


def brute_draw(ids, weighed):
    rows = []
    for d, (n, f, w) in zip(ids, weighed, strict=True):
        h = int(hashlib.sha256(f"42:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        rows.append([d, f, w, w + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, n])
    able = sorted((r for r in rows if r[5] >= 20), key=lambda r: (-r[3], r[0] is None, r[0]))
    for k, r in enumerate(able[: 5 * len(able) // 100], 1):
        r[4] = k
    return [tuple(r[:5]) for r in rows]


def test_resampling_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(resampling, "GROUP", 60)  # several salts
    rnd = random.Random(2)
    common = [f"W{k}" for k in range(40)]
    texts = [*ODD, *(" ".join([*rnd.choices(common, k=rnd.randrange(40)), *rnd.choices(("serve", "réturn", "net"), k=rnd.randrange(6))]) for _ in range(400))]
    target = ["serve net réturn", "the serve W1 net", None, ""]
    ids = [*range(len(texts) - 2), None, 3]
    goal = spark.createDataFrame([(t, 1) for t in target], "text string, bucket int")
    got = resampling.resample(documents(spark, texts, ids), goal)
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    key = lambda r: tuple((x is None, x) for x in r)
    want = brute_draw(ids, brute_weights(texts, target))
    assert sum(r[4] is not None for r in want) > 5
    assert sorted((tuple(r) for r in got.collect()), key=key) == sorted(want, key=key)


def test_resampling_of_empty_tables(spark):
    docs, none = documents(spark, ["a b c " * 10, None]), documents(spark, [])
    assert resampling.resample(none, docs).count() == 0
    got = {r.doc_id: (r.n_features, r.weight, r.rank) for r in resampling.resample(docs, none).collect()}
    assert got == {0: (87, brute_weights(["a b c " * 10, None], [])[0][2], None), 1: (0, 0, None)}


def test_more_counts_than_a_byte_holds(spark):
    texts = ["x " * 1000 + "y", "x " * 254, "x " * 255, "x " * 256, "y x"]
    got = {r.id: r.weight for r in resampling.weights(documents(spark, texts).drop("id"), documents(spark, ["y y"])).collect()}
    assert got == {k: w for k, (_, _, w) in enumerate(brute_weights(texts, ["y y"]))}


def test_ranks_over_many_ranges_and_ties(spark):
    rnd = random.Random(1)
    rows = [(k, rnd.choice((0, 5, 5, 9, rnd.randrange(-50, 50))), k % 9 > 0) for k in range(3000)]
    scored = spark.createDataFrame(rows, "id long, score long, drawable boolean")
    got = {r.id: r.rank for r in resampling.ranked(scored, 10).collect()}
    able = sorted((r for r in rows if r[2]), key=lambda r: (-r[1], r[0]))
    drawn = {r[0]: k for k, r in enumerate(able[: len(able) * 10 // 100], 1)}
    assert got == {r[0]: drawn.get(r[0]) for r in rows}


# Clustering


def brute_clusters(rows, dims, k, rounds=10):
    kept = []
    for d, v in rows:
        if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v):
            whole = [math.floor(1024 * x) for x in v]
            if max(map(abs, whole)) < clustering.RANGE:
                kept.append((d, whole))
    start = sorted(kept, key=lambda r: (hashlib.sha256(f"3:{'' if r[0] is None else r[0]}".encode()).hexdigest(), np.array(r[1], np.int32).tobytes()))[:k]
    centroids = [v for _, v in start]
    square = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    near = lambda v: min((square(v, c), j) for j, c in enumerate(centroids))
    for _ in range(rounds):
        own = defaultdict(list)
        for _, v in kept:
            own[near(v)[1]].append(v)
        centroids = [[sum(x) // len(own[j]) for x in zip(*own[j], strict=True)] if own[j] else c for j, c in enumerate(centroids)]
    last = [(d, *near(v)) for d, v in kept]
    sums = Counter()
    for _, s, j in last:
        sums[j] += s
    return sorted(((d, j, s, sums[j], sum(sums.values()), hashlib.sha256(",".join(map(str, centroids[j])).encode()).hexdigest()) for d, s, j in last), key=lambda r: (r[0] is None, r))


def found(df):
    return sorted((tuple(r) for r in df.collect()), key=lambda r: (r[0] is None, r))


@pytest.mark.parametrize("kind", ["float", "double"])
def test_clusters_against_brute_force(spark, kind):
    rnd = random.Random(7)
    # On a coarse grid, so that many distances tie and many vectors repeat.
    rows = [(k, [rnd.randrange(-2, 3) / 2.0 + (k % 3) * 4 for _ in range(4)]) for k in range(300)]
    rows += [(None, [0.5] * 4), (7, [1.0] * 4), (7, [1.0] * 4), (900, None), (901, [1.0] * 3), (902, [1.0, None, 0.0, 0.0]), (903, [math.nan] * 4), (904, [math.inf, 0.0, 0.0, 0.0]), (905, [1e30, 0.0, 0.0, 0.0]), (906, []), (907, [131071.9, -131071.0, 0.0, 0.0])]
    df = spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>").selectExpr("*", "1 as cluster", "2 as vec", "'x' as lower")
    if kind == "float":
        rows = [(d, v and [x if x is None else float(np.float32(x)) for x in v]) for d, v in rows]
    assert found(clustering.clusters(df, dims=4)) == brute_clusters(rows, 4, 8)


def test_fewer_vectors_than_centroids_and_none(spark):
    schema = "vec_id string, embedding array<double>"
    rows = [("a", [0.0, 1.0]), ("b", [0.0, 1.0]), ("c", [5.0, 1.0])]
    assert found(clustering.clusters(spark.createDataFrame(rows, schema), dims=2)) == brute_clusters(rows, 2, 8)
    none = clustering.clusters(spark.createDataFrame([("a", [1.0])], schema), dims=2)
    assert none.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"] and none.count() == 0


def test_bounds_hold_and_save_distances():
    """Clusters are those of all distances in every round, bounds enclose the truth, and most distances are never measured."""
    rng = np.random.default_rng(3)
    centres = rng.integers(-3000, 3000, (8, 16))
    vectors = (centres[rng.integers(0, 8, 4000)] + rng.integers(-300, 300, (4000, 16))).astype(np.int32)
    centroids = vectors[:8].astype(np.int64)
    cluster, upper, lower = clustering.first_bounds(vectors, centroids)
    measured = 0
    for _ in range(10):
        before = centroids
        centroids = np.array([vectors[cluster == c].sum(0) // (cluster == c).sum() if (cluster == c).any() else before[c] for c in range(8)])
        moved = clustering.above(np.sqrt(((centroids - before) ** 2).sum(1).astype(float)))
        cluster, upper, lower, n = clustering.next_bounds(vectors, cluster, upper, lower, centroids, clustering.gaps(centroids), moved)
        measured += n
        truth = np.stack([clustering.distances(vectors, c) for c in centroids], axis=1)
        assert (cluster == truth.argmin(axis=1)).all()
        roots = np.sqrt(truth.astype(np.longdouble))
        assert (upper >= roots[np.arange(len(vectors)), cluster]).all() and (lower <= roots).all()
    assert measured < 0.5 * 10 * vectors.shape[0] * 8


def test_sql_says_the_same(spark, sf_dir):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "embeddings"):
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    read = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
    for df, text in ((clustering.clusters(read("embeddings")), clustering.sql()), (resampling.resample(read("documents"), read("benchmark")), resampling.SQL)):
        rel = con.sql(text)
        assert rel.columns == df.columns
        key = lambda r: tuple((x is None, x) for x in r)
        assert sorted((tuple(r) for r in df.collect()), key=key) == sorted(rel.fetchall(), key=key)


def test_tables_of_words_keep_frequent_ones_and_the_same_ids(monkeypatch):
    """A full table keeps its words for another generation; words of letters alone need no table of parts; ids are the tokenizer's own."""
    import public_tokenizers

    from rallyframe.llm import packing

    monkeypatch.setattr(packing, "MOST_WORDS", 3)
    made = []
    kept = packing.Kept(lambda w: made.append(w) or w.encode())
    for w in "a b c d a d b e".split():
        assert kept[w] == w.encode()
    assert made == ["a", "b", "c", "d", "e"]
    with open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as f:
        words = packing.words_of(f.read())
    text = "Heonea, heonea don't isaneroure. êéç $$$ thsttian 42x ª µm o'er 'sword a's"
    assert words.ids(text) == words.encode(text)
    words.parts.clear()
    words.lower.clear()
    words.ids("thsttian anhereed")
    assert not words.parts
