"""The corpus operators against brute force on small tables, with nulls, long texts, ties and clashing columns."""

import base64
import hashlib
import math
import random
import re
import time
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from rallyframe.llm import components, contamination, langid, minhash, mixing, passages, pii, quality, secrets, urls, warc
from rallyframe.llm.common import fresh_path, likely

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
GAP = re.compile(r"[^\x20\x09-\x0D]+")
LETTERS = "abcdefghijklmnopqrstuvwxyz"


def words(rnd, n, size=4000):
    return [f"w{rnd.randrange(size)}" for _ in range(n)]


def table(spark, texts, **more):
    rows = [(k, t, "en", f"s{k % 3}", len(t or "")) for k, t in enumerate(texts)]
    df = spark.createDataFrame(rows, DOCS)
    for name, value in more.items():
        df = df.withColumn(name, F.lit(value))
    return df


ODD = [None, "", " \t\n", "x", "\u00e9" * 3000, "a" * 200_000, "word " * 3000, "Mixed Case WORDS here " * 4, "\U0001f600 smile " * 30]


# Quality rules


def brute_features(text):
    text = text or ""
    w = GAP.findall(text)
    seen = defaultdict(list)
    for i in range(len(w) - 7):
        seen[tuple(w[i : i + 8])].append(i)
    inside = {i + k for at in seen.values() if len(at) > 1 for i in at for k in range(8)}
    lines = [x for x in text.split("\n") if GAP.search(x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(inside)


def test_quality_features(spark):
    rnd = random.Random(3)
    texts = [*ODD, *(" ".join(words(rnd, rnd.randrange(60), 9)) for _ in range(60)), "a b\na b\n\na b \n#|", "\x1fa\x0bb\u00a0c"]
    docs = table(spark, texts, quality=1, votes="x", kept=False)
    judged, name = quality.judge(docs, "text", ["doc_id"])
    got = {r.doc_id: r for r in judged.select("doc_id", f"{name}.*").collect()}
    for k, t in enumerate(texts):
        want = brute_features(t)
        r = got[k]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want, k
        assert r.base_failed == (want[0] < 20 or 100 * want[4] > 30 * want[0])
        assert not (r.base_failed and r.kept)
    assert quality.quality_filter(docs).columns == docs.columns
    assert quality.quality_filter(docs.limit(0)).count() == 0


def test_votes_find_the_bad(spark):
    rnd = random.Random(0)
    counts, truth = Counter(), {}
    for _ in range(4000):
        good = rnd.random() < 0.85
        votes = [2 if rnd.random() < 0.9 else 1 for _ in range(6)] if good else [0 if rnd.random() < 0.35 else 2 for _ in range(6)]
        p = sum(v * 3**j for j, v in enumerate(votes))
        counts[p] += 1
        truth.setdefault(p, Counter())[good] += 1
    prior, chance = quality.fit(counts, 6)
    right = 0
    for p, n in truth.items():
        a, b = quality.log_odds_parts(quality.digits(p, 6), prior, chance)
        right += n[a >= b]
    assert right / 4000 > 0.95 and abs(prior - 0.85) < 0.06


def test_quality_is_native(spark, sf_dir, monkeypatch):
    plans = plans_of(monkeypatch, quality, lambda: quality.judge(spark.read.parquet(f"{sf_dir}/documents.parquet"), "text", ["doc_id"])[0])
    assert len(plans) == 2 and "regexp_extract_all" in plans[0] and not any(re.search(NOT_NATIVE, p) for p in plans)


def test_quality_counts_characters_without_an_array_of_them(spark, monkeypatch):
    docs = table(spark, ["One, two.\n#|"])
    plans = plans_of(monkeypatch, quality, lambda: quality.judge(docs, "text", ["doc_id"])[0])
    assert set(re.findall(r"regexp_extract_all\([^\[]*(\[[^\]]*\])", plans[0])) == {"[.!?]"}  # only ends of lines


# Near duplicates


def brute_near(texts, width, percent):
    sets = {}
    for d, t in texts.items():
        w = (t or "").encode().lower().split()
        k = min(width, len(w))
        sets[d] = {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if w else set()
    up = {d: d for d in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and (i := len(sets[a] & sets[b])) and 100 * i >= percent * (len(sets[a]) + len(sets[b]) - i):
                x, y = sorted((root(a), root(b)))
                up[y] = x
    return {d: (len(sets[d]), root(d)) for d in ids}


def near_texts():
    rnd = random.Random(8)
    texts = list(ODD)
    for _ in range(14):
        base = words(rnd, rnd.randrange(5, 160))
        for _ in range(rnd.randrange(1, 7)):
            copy = list(base)
            for _ in range(rnd.randrange(0, max(1, len(base) // 18) + 1)):
                copy[rnd.randrange(len(copy))] = f"e{rnd.randrange(99999)}"
            texts.append(("  " if rnd.random() < 0.3 else " ").join(copy).upper() if rnd.random() < 0.3 else " ".join(copy))
    family = words(rnd, 120)  # a large family whose members are only just, or not quite, similar
    for _ in range(90):
        copy = list(family)
        for _ in range(rnd.randrange(3, 9)):
            copy[rnd.randrange(len(copy))] = f"f{rnd.randrange(99999)}"
        texts.append(" ".join(copy))
    return texts


@pytest.mark.parametrize("width", [4, 5])
def test_near_duplicates(spark, width):
    texts = near_texts()
    got = minhash.near_duplicates(table(spark, texts, component_id=7, n=1), width=width).collect()
    assert len(got) == len(texts)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute_near(dict(enumerate(texts)), width, 80)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_near_duplicates_odd_rows(spark):
    long = " ".join(f"x{k}" for k in range(40))
    rows = [(5, long, "en", "s", 1), (5, long, "en", "s", 1), (9, long + " more", None, None, None), (None, long, "en", "s", 1), (3, None, "en", "s", 1), (7, "", "en", "s", 1)]
    docs = spark.createDataFrame(rows, DOCS)
    got = sorted(((r.doc_id, r.component_id, r.kept) for r in minhash.near_duplicates(docs).collect()), key=repr)
    assert got == sorted([(5, 5, True), (5, 5, True), (9, 5, False), (None, None, True), (3, 3, True), (7, 7, True)], key=repr)
    kept = minhash.near_duplicate_filter(docs)
    assert kept.columns == docs.columns and sorted((r.doc_id for r in kept.collect()), key=repr) == sorted([5, None, 3, 7], key=repr)
    assert minhash.near_duplicates(docs.limit(0)).count() == 0


def test_packed_estimate(spark):
    rnd = np.random.default_rng(2)
    both = rnd.integers(0, 2**63, 800, dtype=np.uint64)
    rows = []
    for j in (0.5, 0.8, 0.95):
        n = int(round(800 * j))
        x, y = both, np.concatenate((both[:n], rnd.integers(0, 2**63, 0, dtype=np.uint64)))
        rows.append((j, minhash.packed(minhash.minima(x)).tolist(), minhash.packed(minhash.minima(y)).tolist()))
    df = spark.createDataFrame(rows, "j double, a array<long>, b array<long>")
    for r in df.select("j", minhash.similarity(F.col("a"), F.col("b")).alias("s")).collect():
        assert abs(r.j - r.s) < 0.16


def test_common_counts():
    rnd = np.random.default_rng(4)
    sets = [np.unique(rnd.integers(0, 900, rnd.integers(0, 300))) for _ in range(30)]
    want = [[len(np.intersect1d(a, b)) for b in sets] for a in sets]
    assert minhash.common_counts(sets, sets).tolist() == want


def test_components_of_chains(spark):
    links = [(k, k + 1) for k in range(60)] + [(100, 200), (200, 300), (100, 300)]
    got = {r.node: r.component for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{k: 0 for k in range(61)}, 100: 100, 200: 100, 300: 100}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


# Passages


def test_passages(spark):
    rnd = random.Random(6)
    shared = words(rnd, 60)
    edited = list(shared)
    edited[30] = "edit"
    texts = [*ODD, " ".join(words(rnd, 80) + shared + words(rnd, 50)), " ".join(words(rnd, 33) + shared), " ".join(edited + words(rnd, 90)), " ".join(words(rnd, 300)), " ".join(words(rnd, 49))]
    n = len(ODD)
    got = {r.doc_id: r for r in passages.substring_dedup(table(spark, texts, spans="x", component_id=1)).collect()}
    assert {n, n + 1, n + 2} <= set(got) and not {n + 3, n + 4} & set(got)
    assert {got[k].component_id for k in (n, n + 1, n + 2)} == {n}
    a, b = map(int, got[n].spans.split(":"))
    assert abs(a - 80) <= 1 and abs(b - 140) <= 1 and got[n].n_removable == 0 and got[n + 1].n_removable >= 58
    assert 6 in got  # "word word ..." repeats inside itself
    assert passages.substring_dedup(table(spark, texts).limit(0)).count() == 0


def test_stretches_against_loops():
    rng = np.random.default_rng(0)
    for _ in range(60):
        base = rng.integers(0, 10**6, 60)
        xs, ys = ([np.where(rng.random(60) < rng.random() * 0.4, rng.integers(0, 10**6, 60), base)[: rng.integers(30, 61)].astype(np.int32) for _ in range(rng.integers(1, 6))] for _ in "xy")
        some, much = passages.stretches(xs, ys, 20, 80)
        for i, x in enumerate(xs):
            for j, y in enumerate(ys):
                seen = np.isin(x, y)
                parts = [(seen[a:b].sum(), b - a) for a in range(len(x)) for b in range(a + 20, len(x) + 1)]
                twice = len(np.unique(x)) < len(x)
                assert some[i, j] == (twice or any(100 * k >= 80 * n for k, n in parts))
                assert not some[i, j] or much[i, j] == (twice or any(180 * k >= 160 * n for k, n in parts))


def brute_passage(s, r, least, percent=80):
    """Whether any stretch of s is as similar to one of r of the same length."""
    return any(100 * (n := len(x & y)) >= percent * (len(x) + len(y) - n) for a in range(len(s) - least + 1) for b in range(len(r) - least + 1) for x, y in [(set(s[a : a + least]), set(r[b : b + least]))])


@pytest.mark.parametrize(("line", "size", "edits"), [(15, 55, 0), (20, 60, 0), (25, 80, 0), (30, 100, 0), (15, 70, 1), (40, 60, 0)])
def test_passages_beside_lines_in_another_order(line, size, edits):
    rnd = random.Random(line)
    row, shared, gone, least = words(rnd, line), words(rnd, size), words(rnd, 40), passages.WORDS - 4
    edited = list(shared)
    for k in range(edits):
        edited[size // 2 + k] = "edit"
    tokens = lambda w: passages.shingles(passages.word_ids([x.encode() for x in w]), 5)
    for x, y in [(words(rnd, 60) + row + edited, shared + gone + row), (row + edited + row, shared + gone + row), (row + gone[:20] + edited, shared + row + words(rnd, 90) + row + shared[:30])]:
        for s, r in ((tokens(x), tokens(y)), (tokens(y), tokens(x))):
            assert brute_passage(s.tolist(), r.tolist(), least)
            got = passages.verified(s, r, least, 80, 10)
            assert max(b - a for a, b, _, _ in got) >= size - 4 - 5 * edits
            assert all(100 * len(x & y) >= 80 * len(x | y) and min(b - a, v - u) >= least for a, b, u, v in got for x, y in [(set(s[a:b].tolist()), set(r[u:v].tolist()))])


def test_no_passage_of_lines_alone():
    rnd = random.Random(77)
    rows = [words(rnd, 15) for _ in range(12)]
    tokens = lambda w: passages.shingles(passages.word_ids([x.encode() for y in w for x in y]), 5)
    assert passages.verified(tokens(rows), tokens(rnd.sample(rows, 12) + [words(rnd, 400)]), passages.WORDS - 4, 80, 3) == []


def test_compact_windows_stand_for_every_run():
    rng = np.random.default_rng(3)
    texts = [*(rng.integers(0, 30, n).astype(np.uint64) for n in (60, 10, 37)), np.full(25, 7, np.uint64)]
    of, key, lo, at, hi, _ = passages.compact_windows(texts, 10)
    for k, values in enumerate(texts):
        own = [(w[1], w[2], w[4]) for w in zip(of, key, lo, at, hi, strict=True) if w[0] == k]
        assert all(y - x >= 10 for _, x, y in own)
        for f in range(passages.FUNCTIONS):
            h = passages.hashes(values, f)
            for a in range(len(values) - 9):
                for b in range(a + 10, len(values) + 1):
                    low = h[a:b].min().view(np.int64)
                    assert sum(w == low and x <= a and b <= y for w, x, y in own) == 1


def family(rnd, size, edits, n):
    """Texts around edited copies of one passage."""
    base, out = words(rnd, size), []
    for _ in range(n):
        copy = list(base)
        for _ in range(edits):
            copy[rnd.randrange(size)] = f"e{rnd.randrange(10**6)}"
        out.append(" ".join(words(rnd, rnd.randrange(20, 120)) + copy + words(rnd, rnd.randrange(20, 120))))
    return out


def test_families_of_edited_copies_against_all_pairs(spark):
    rnd = random.Random(31)
    kinds = [(60, 1), (60, 1), (60, 2), (120, 2), (200, 4), (55, 1)]
    texts = [t for size, edits in kinds for t in family(rnd, size, edits, 30)]
    tokens = [passages.shingles(passages.word_ids(passages.words_of(t)), 5) for t in texts]
    pairs = [(i, j) for i in range(len(texts)) for j in range(i) if i // 30 == j // 30 and passages.verified(tokens[i], tokens[j], passages.WORDS - 4, 80, 10)]
    # A line that all texts hold, and copies of whole texts, must neither hide links nor make any.
    line = " ".join(words(rnd, 12))
    texts = [f"{t} {line}" for t in texts] + [f"{texts[0]} {line}", f"{' '.join(words(rnd, 90))} {line} {' '.join(words(rnd, 60))}"]
    got = {r.doc_id: r for r in passages.substring_dedup(table(spark, texts)).collect()}
    linked = [i in got and j in got and got[i].component_id == got[j].component_id for i, j in pairs]
    want = {k for p in pairs for k in p}
    assert len(pairs) > 1500 and sum(linked) >= 0.99 * len(pairs) and len(want & set(got)) >= 0.99 * len(want)
    assert all(r.component_id // 30 == k // 30 for k, r in got.items() if k < 180) and 181 not in got
    assert got[180].component_id == got[0].component_id == 0 and got[180].n_removable == len(texts[0].split()) and got[0].n_removable == 0


@pytest.mark.parametrize(("size", "where"), [(60, 30), (80, 40), (98, 50), (120, 1)])
def test_a_repeat_inside_a_text_with_a_word_put_in(spark, size, where):
    rnd = random.Random(size)
    base = words(rnd, size)
    text = [*words(rnd, 30), *base, *words(rnd, 40), *base[:where], "new", *base[where:], *words(rnd, 20)]
    values = passages.shingles(passages.word_ids([w.encode() for w in text]), 5)
    _, _, _, at, _, _ = passages.compact_windows([values], passages.WORDS - 4)
    got = passages.own_repeats(values, at, 50, passages.WORDS - 4, 80, 10)
    assert max(b - a for a, b, _, _ in got) >= size - 4 - min(where, 10) and all(a - x >= 50 for a, _, x, _ in got)
    assert passages.own_repeats(values[: 30 + size], at[at < 30 + size], 50, passages.WORDS - 4, 80, 10) == []


def test_passages_of_odd_rows(spark):
    rnd = random.Random(15)
    shared = " ".join(words(rnd, 60))
    rows = [(None, shared), (4, shared), (4, shared), (4, " ".join(words(rnd, 70))), (2, f"{shared} more"), (9, None), (8, "")]
    docs = spark.createDataFrame([(k, t, "en", "s", 1) for k, t in rows], DOCS).withColumn("node", F.lit("x")).withColumn("rep", F.lit(1))
    got = [(r.doc_id, r.component_id, r.n_passages, r.n_removable) for r in passages.substring_dedup(docs).orderBy("doc_id").collect()]
    assert got == [(2, 2, 1, 0), (4, 2, 1, 60)]


def test_passages_shuffle_windows_and_texts_once(spark):
    """Of texts in near copies, with all joins shuffled: before, windows went over three times and texts five times."""
    rnd = random.Random(7)
    texts = [" ".join(words(rnd, 1200, 10**6)) for _ in range(200)]
    texts += [t.replace(" ", " x ", 1) for t in texts]
    store = spark.sparkContext._jsc.sc().statusStore()
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        before = store.executorSummary("driver").totalShuffleWrite()
        found = {(r.id, r.rep) for r in passages.repeated_passages(table(spark, texts)).select("id", "rep").collect()}
        moved = store.executorSummary("driver").totalShuffleWrite() - before
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    assert found == {(k + 200, k) for k in range(200)}
    assert moved < 5.5 * sum(map(len, texts)), moved / sum(map(len, texts))


def test_likely_keeps_every_row_asked_for_and_few_others(spark):
    df = spark.range(20_000).select(F.concat(F.lit("k"), "id").alias("k"), F.col("id").alias("place"))
    ids = df.filter("place % 20 = 3").select(F.col("k").alias("x"))
    got = likely(df, ids, "k")
    assert got.columns == df.columns
    kept = {r.place for r in got.collect()}
    assert set(range(3, 20_000, 20)) <= kept and len(kept) < 1500
    assert likely(df, ids.limit(0), "k").count() == 0


# Secrets and personal data

ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)


def base_spans(text, kinds):
    return sorted((m.start(), k, m.end()) for k, (_, p, good) in enumerate(kinds) for m in p.finditer(text or "") if good(m))


def digest(spans, kinds):
    return hashlib.sha256(",".join(f"{kinds[k][0]}:{a}:{b}" for a, k, b in spans).encode()).hexdigest()


SECRETS = [("assign", ASSIGN, lambda m: len(m[2]) >= 6), ("access", re.compile(r"AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 20), ("hex", re.compile(r"[0-9a-f]+"), lambda m: len(m[0]) >= 24)]


def test_secrets(spark):
    rnd = random.Random(4)
    bits = ["token = ", "API_KEY:'", "Password=", "secret=token =abcdefg", "AKIA" + "Q" * 16, "AKIA" + "Q" * 15, "ab" * 12, "ab" * 11 + "c", "\u017fecret: abcdefgh", "é", " ", "zzzzzzz", '"']
    texts = [*ODD, *("".join(rnd.choice(bits) for _ in range(rnd.randrange(12))) for _ in range(300))]
    docs, ledger = table(spark, texts, blob="x", spans=1), fresh_path(spark, "ledger")
    got = secrets.scan_versions(docs, ledger).collect()
    for r in got:
        want = base_spans(texts[r.doc_id], SECRETS)
        assert r.base_sha256 == digest(want, SECRETS), texts[r.doc_id]
        assert [r.n_assign, r.n_access, r.n_hex] == [sum(k == j for _, k, _ in want) for j in range(3)]
    # A second scan finds no unseen blob; a new version is scanned alone, and all paths have findings.
    n = spark.read.parquet(ledger).count()
    more = docs.union(table(spark, ["token = abcdefgh1", texts[-1]], blob="x", spans=1))
    assert secrets.scan_versions(more, ledger).filter("base_sha256 is null").count() == 0
    assert n == len(set(t or "" for t in texts)) and spark.read.parquet(ledger).count() == n + 1
    assert secrets.scan_versions(docs.limit(0), fresh_path(spark, "ledger")).count() == 0
    # Two scans that began before either had appended leave each row twice.
    spark.read.parquet(ledger).write.parquet(twice := fresh_path(spark, "ledger"))
    spark.read.parquet(ledger).write.mode("append").parquet(twice)
    assert sorted(map(repr, secrets.scan_versions(docs, twice).collect())) == sorted(map(repr, got))


JWT = re.compile(r"\beyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}")


def test_web_tokens_equal_the_plain_pattern():
    rnd = random.Random(6)
    bits = ["eyJ", "a" * 10, "-", ".", "b" * 9, "_x", " ", "\u00e9", ".eyJ" + "c" * 10, "z" * 12]
    for _ in range(20_000):
        text = "".join(rnd.choice(bits) for _ in range(rnd.randrange(12)))
        assert list(secrets.Jwt.spans(text)) == [m.span() for m in JWT.finditer(text)], text


@pytest.mark.parametrize("part", ["-eyJaaaaaaaaaaaa", "eyJaaaaaaaaaaaa.", "eyJaaaaaaaaaaaa.bbbbbbbbbbb.", "password ", "token" + " " * 50, "AKIA", "abcdef01", "-----BEGIN A PRIVATE KEY"])
def test_hostile_texts_take_linear_time(part):
    text = part * (10_000_000 // len(part))
    began = time.perf_counter()
    secrets.find(text)
    assert time.perf_counter() - began < 10


def test_secrets_of_odd_rows(spark):
    rows = [(None, "token = abcdefgh"), (1, "token = abcdefgh"), (1, "token = abcdefgh"), (1, None), (2, "AKIA" + "Q" * 16 + "e" * 24)]
    docs = spark.createDataFrame([(k, t, "en", "s", 1) for k, t in rows], DOCS).withColumn("n_assign", F.lit("x")).withColumn("rule_version", F.lit(1))
    got = sorted(((r.doc_id, r.n_assign, r.spans) for r in secrets.scan_versions(docs, fresh_path(spark, "ledger")).collect()), key=repr)
    assert got == sorted([(None, 1, "assign:0:16"), (1, 1, "assign:0:16"), (1, 1, "assign:0:16"), (1, 0, ""), (2, 0, "access:0:20,hex:20:44")], key=repr)


def luhn(d):
    return sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(d))) % 10 == 0


def only_digits(s):
    return re.sub(r"[^0-9]", "", s)


PERSONAL = [
    ("email", re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), lambda m: True),
    ("ip", re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), lambda m: all(int(x) <= 255 for x in m[0].split("."))),
    ("card", re.compile(r"[0-9]([\x20-]?[0-9])+"), lambda m: 12 <= len(only_digits(m[0])) <= 19 and luhn(only_digits(m[0]))),
    ("phone", re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"), lambda m: 9 <= len(only_digits(m[0])) <= 15),
]


def test_personal_data_patterns():
    rnd = random.Random(2)
    bits = ["a@b.co", "a@b", "@", ".", "x.y", "1.2.3.4", "256.1.1.1", "001.2.3.4", ".5", "4111 1111 1111 1111", "4111111111111112", "+1 (017) 555-7713", "+", " ", "-", "7", "12", "é", "٣"]
    for _ in range(6000):
        text = "".join(rnd.choice(bits) for _ in range(rnd.randrange(9)))
        assert pii.find(text) == base_spans(text, PERSONAL), text
    assert pii.find("a" * 300_000) == [] and len(pii.find("1 " * 100_000)) <= 1


def test_personal_data_and_terms(spark):
    rnd = random.Random(5)
    who = "jan.doe@mail.example.com"
    texts = [*ODD, *(" ".join(["plain", *words(rnd, 12), "Zanzibar", who, *words(rnd, 12)]) for _ in range(6)), *(" ".join(words(rnd, 40)) for _ in range(40))]
    docs = table(spark, texts, key="x", near=2)
    got = {r.doc_id: r for r in pii.find_personal_data(docs).collect()}
    for k, t in enumerate(texts):
        want = base_spans(t, PERSONAL)
        assert got[k].base_sha256 == digest(want, PERSONAL)
        assert set(",".join(f"{PERSONAL[j][0]}:{a}:{b}" for a, j, b in want).split(",")) - {""} <= set(got[k].spans.split(","))
    assert all(got[len(ODD) + k].n_term >= 1 for k in range(6)) and all(got[k].n_term == 0 for k in range(len(ODD) + 6, len(texts)))
    clean = {r.doc_id: r.text for r in pii.sanitise(docs).collect()}
    assert clean[0] is None and "Zanzibar" not in clean[len(ODD)] and "[EMAIL]" in clean[len(ODD)] and clean[len(texts) - 1] == texts[-1]
    assert pii.find_personal_data(docs.limit(0)).count() == 0


def brute_terms(texts):
    """Spans of revealing terms of each text, restated with plain loops."""
    edge = ".,;:!?()[]{}\"'"
    rows = []
    for t in texts:
        t = t or ""
        spans = base_spans(t, PERSONAL)
        words_ = [(m[0].strip(edge), m.end() - len(m[0].lstrip(edge))) for m in GAP.finditer(t) if m[0].strip(edge)]
        words_ = [(w.lower(), a, a + len(w)) for w, a in words_]
        free = [w for w in words_ if not any(s < w[2] and w[1] < e for s, _, e in spans)]
        near = []
        for s, k, e in spans:
            around = [w for w in words_ if w[2] <= s][-8:] + [w for w in words_ if w[1] >= e][:8]
            around = tuple(w[0] for w in around if w in free)
            near.append(((k, t[s:e].lower()), around))
        rows.append((words_, free, near))
    contexts, n_term, n_entity, n_pair = defaultdict(set), Counter(), Counter(), Counter()
    for words_, _, near in rows:
        terms = {w[0] for w in words_}
        n_term.update(terms)
        for entity in {e for e, around in near if around}:
            n_entity[entity] += 1
            n_pair.update((entity, x) for x in terms)
        for entity, around in near:
            for x in around:
                contexts[entity, x].add(around)
    n = len(texts)
    reveals = defaultdict(set)
    for (entity, x), seen in contexts.items():
        info = math.log(n / n_entity[entity])
        if len(seen) >= 3 and info > 0 and math.log(n_pair[entity, x] * n / (n_entity[entity] * n_term[x])) / info >= 0.8:
            reveals[entity].add(x)
    out = []
    for _, free, near in rows:
        known = set().union(*(reveals[e] for e, around in near if around))
        out.append([f"term:{a}:{b}" for x, a, b in free if x in known])
    return out


def personal_texts():
    rnd = random.Random(41)
    who = ["jan.doe@mail.example.com", "10.1.2.3", "+1 (017) 555-7713"]
    texts = [*ODD]
    for k in range(24):
        name, entity = [["Zanzibar", "Li"], ["beta\u00a0gamma", "x" * 80], ["\u00c9MILE"] * 2][k % 3][k // 3 % 2], who[k % 3]
        body = [*words(rnd, 9, 40), f"({name}),", entity, *words(rnd, 9, 40)]
        texts.append(" ".join([*words(rnd, rnd.randrange(9), 40), *body, *words(rnd, 30, 40), name.upper() if k % 2 else name, "end."]))
    texts += [" ".join(["Zanzibar"[: rnd.randrange(4, 9)], *words(rnd, 40, 40)]) for _ in range(60)]
    return texts + [texts[len(ODD)]] * 2


@pytest.mark.parametrize("few", [True, False])
def test_terms_equal_plain_loops(spark, monkeypatch, few):
    if not few:
        monkeypatch.setattr(pii, "BROADCAST_TERMS", 0)
        monkeypatch.setattr(pii, "HELD_TERMS", 5)
        monkeypatch.setattr(pii, "FEW_TEXTS", 0)
    texts = personal_texts()
    docs = table(spark, texts, text_key="x", n_term=1)
    docs = docs.withColumn("doc_id", F.when(F.col("doc_id") == 30, None).otherwise(F.col("doc_id")))
    want = brute_terms(texts)
    got = {r.doc_id: r for r in pii.find_personal_data(docs).collect()}
    assert len(got) == len(texts) and sum(map(bool, want)) > 10
    for k, w in enumerate(want):
        r = got[None if k == 30 else k]
        assert sorted(x for x in r.spans.split(",") if x.startswith("term")) == sorted(w) and r.n_term == len(w), k
    clean = {r.doc_id: r for r in pii.sanitise(docs).collect()}
    for k, w in enumerate(want):
        r = clean[None if k == 30 else k]
        left = r.text or ""
        assert r.text_key == "x" and not pii.find(left)
        for x in w:
            _, a, b = x.split(":")
            assert not re.search(rf"(?<!\S)\W*{re.escape(texts[k][int(a) : int(b)])}\W*(?!\S)", left)


# Mixing


def test_mixing_equals_sql(spark):
    rnd = random.Random(1)
    rows = [(rnd.randrange(60), None if rnd.random() < 0.05 else " ".join(words(rnd, rnd.randrange(40))), "en", rnd.choice(["a", "b", "\u00e9", "", None, "null", "snull"]), 1) for _ in range(300)]
    docs = spark.createDataFrame(rows, DOCS).withColumns({"k": F.lit(1), "size": F.lit("x"), "Taken": F.lit("y"), "of_source": F.lit(2)})
    got = sorted(tuple(r) for r in mixing.mix(docs, carry=["doc_id"]).collect())
    assert mixing.mix(docs).columns == [c for c in docs.columns if c not in ("size", "Taken")] + ["size", "source_size", "target", "taken"]
    db = duckdb.connect()
    db.register("documents", docs.toPandas().astype({"doc_id": "int64"}))
    want = sorted(tuple(r) for r in db.sql(mixing.SQL).fetchall())
    assert [g[:3] + g[4:] for g in got] == [w[:3] + w[4:] for w in want]
    assert all(abs(g[3] - w[3]) < 1e-6 for g, w in zip(got, want, strict=True))
    by = defaultdict(lambda: [0, 0.0])
    for r in mixing.mix(docs, carry=["doc_id", "source"]).collect():
        by[r.source][0] += r.taken
        by[r.source][1] = r.target
        assert r.taken <= 3 * r.size
    assert all(abs(taken - target) <= 1 for taken, target in by.values())
    assert mixing.mix(docs.limit(0)).count() == 0
    none = mixing.mix(docs.withColumn("doc_id", F.lit(None).cast("long")))
    assert none.filter("doc_id is null").count() == 300 and none.agg(F.sum("taken")).first()[0] > 0


# URLs


def test_hosts_and_rules(spark):
    cases = {"http://A.Example.ORG/es/x?y": ("a.example.org", "/es/x", "example.org/es/", "block"), "https://example.org/en/12#t": ("example.org", "/en/12", "example.org/en/1", "block"), "x://b.org": ("b.org", "", None, "allow"), "x://b.org/?q": ("b.org", "/", "org/", "allow"), "nothing": ("", "", None, "allow"), None: ("", "", None, "allow"), "a://b.com/de/://c": ("b.com", "/de/://c", "com/de/", "block"), "a://notorg/x": ("notorg", "/x", None, "allow")}
    df = spark.createDataFrame([(k, u, None) for k, u in enumerate(cases)], "page_id long, url string, html string")
    got = {r.page_id: r for r in urls.judge_urls(df).collect()}
    for k, want in enumerate(cases.values()):
        assert (got[k].host, got[k].path, got[k].rule) == want[:3]
        if want[2]:
            assert got[k].verdict == want[3]
    assert urls.judge_urls(df.limit(0)).count() == 0


def made_web(seed, hosts=50, pages=260):
    """Pages of hosts with allowed, blocked and mixed seeds, cycles, hosts without links out and a link to nowhere."""
    rnd = random.Random(seed)
    names = [f"h{k}.{rnd.choice(['com', 'net', 'info'])}" for k in range(hosts)]
    rows = []
    for k in range(pages):
        host = rnd.choice(names)
        to = "" if names.index(host) % 6 == 0 else "".join(f'<a href="http://{rnd.choice([*names, "outside.io"])}/x">y</a>' for _ in range(rnd.randrange(3)))
        rows.append((k, f"http://{host}{rnd.choice(['/de/', '/fr/', '/x/', '/y'])}{k}", to))
    return rows


def brute_verdicts(rows, rounds=2000):
    """Restart, follow links, and give back to the seeds what has no link to follow; until nothing changes."""
    pages = [(k, re.match("http://([^/]*)(.*)", u).groups(), re.findall("//([^/]*)/", h)) for k, u, h in rows]
    said = {k: "block" if p.startswith("/de/") and h.endswith(".com") else "allow" if p.startswith("/fr/") and h.endswith(".com") else None for k, (h, p), _ in pages}
    own = defaultdict(list)
    for k, (h, _), _ in pages:
        own[h].append(said[k])
    links = Counter((h, to) for _, (h, _), out in pages for to in out if to != h)
    hosts = sorted(set(own) | {h for e in links for h in e})
    scores = []
    for what, turn in (("allow", False), ("block", True)):
        seed = {h: own[h].count(what) / len(own[h]) if own.get(h) else 0.0 for h in hosts}
        total, out = sum(seed.values()), Counter()
        edges = Counter({(b, a) if turn else (a, b): n for (a, b), n in links.items()})
        for (a, _), n in edges.items():
            out[a] += n
        now = dict(seed)
        for _ in range(rounds):
            lost = sum(v for h, v in now.items() if not out[h])
            new = {h: 0.15 * seed[h] + 0.85 * (lost * seed[h] / total if total else 0.0) for h in hosts}
            for (a, b), n in edges.items():
                new[b] += 0.85 * now[a] * n / out[a]
            now = new
        scores.append(now)
    verdict = {h: "block" if scores[1][h] > 0 and scores[1][h] >= 0.6 * (scores[0][h] + scores[1][h]) else "allow" for h in hosts}
    return {k: said[k] or verdict[h] for k, (h, _), _ in pages}, scores


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_verdicts_on_a_made_web_equal_iteration_and_sql(spark, seed):
    rows = made_web(seed)
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("host", F.lit(1)).withColumn("trust", F.lit("x"))
    got = {r.page_id: r.verdict for r in urls.judge_urls(df).collect()}
    want, _ = brute_verdicts(rows)
    assert got == want and len(set(got.values())) == 2
    db = duckdb.connect()
    db.register("pages", df.select("page_id", "url", "html").toPandas())
    assert dict(db.sql(f"select page_id, verdict from ({urls.SQL})").fetchall()) == want


def test_scores_add_up_to_the_seeds(spark):
    rows = made_web(4)
    _, (trust, distrust) = brute_verdicts(rows)
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    seen = df.select(urls.host_of(F.col("url")).alias("host"), urls.path_of(F.col("url")).alias("path"))
    said = urls.rule_of(F.col("host"), F.col("path"))[1]
    seeds = seen.withColumn("said", said).groupBy("host").agg(*[F.avg(F.when(F.col("said") == w, 1.0).otherwise(0.0)).alias(n) for w, n in (("allow", "trust0"), ("block", "distrust0"))])
    got = urls.propagate(seeds, urls.host_links(df, "url", "html"), threshold=0.5).collect()
    for c, want in (("trust", trust), ("distrust", distrust)):
        assert math.isclose(sum(r[c] for r in got), sum(want.values()), rel_tol=1e-9)
        assert all(math.isclose(r[c], want[r.host], rel_tol=0.1, abs_tol=1e-4) for r in got)


def test_equal_seeds_do_not_block(spark):
    rows = [(k, f"http://{h}.com/{p}/{k}", None) for h in "ab" for k, p in enumerate(["de", "fr", "x"], 10 * (h == "b"))] + [(90, "http://c.com/de/1", None), (91, "http://c.com/x", None), (91, "http://c.com/x", None), (None, "http://c.com/x", "z" * 300_000)]
    got = urls.judge_urls(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    by = defaultdict(set)
    for r in got:
        by[r.page_id].add(r.verdict)
    assert len(got) == len(rows) and by[2] == by[12] == {"allow"} and by[91] == by[None] == {"block"}


def brute_votes(text):
    """The rules, restated: -1 bad, 0 abstains, 1 good."""
    text = text or ""
    n, chars, symbols, dup, again = brute_features(text)
    rows = [x for x in text.split("\n") if GAP.search(x)]
    upper, punct = sum("A" <= c <= "Z" for c in text), sum(c in ".,;:!?" for c in text)
    ended = sum(bool(re.search(r"[.!?][\x20\x09\x0B-\x0D]*$", x)) for x in text.split("\n"))
    both = [
        (n < 20, n >= 50),
        (chars < 3 * n or 10 * chars > 85 * n, 4 * n <= chars <= 7 * n),
        (10 * symbols > n, symbols == 0),
        (10 * dup > 3 * len(rows), 10 * dup <= len(rows)),
        (10 * again > 3 * n, 20 * again <= n),
        (10 * upper > 3 * chars, 10 * upper <= chars),
        (5 * punct > 4 * n, 100 * punct >= 3 * n and 2 * punct <= n),
        (ended == 0, 2 * ended >= len(rows) > 0),
    ]
    return [-1 if bad else 1 if good else 0 for bad, good in both], n < 20 or 100 * again > 30 * n


def brute_posteriors(votes):
    """Expectation-maximisation over rows, with the bound on false alarms."""
    v = np.array(votes) + 1
    prior, chance = 0.85, np.array([[[0.3, 0.2, 0.5], [0.002, 0.1, 0.898]]] * v.shape[1])
    last = -math.inf
    for _ in range(60):
        like = np.stack([np.log(1 - prior if side == 0 else prior) + sum(np.log(chance[j, side, v[:, j]]) for j in range(v.shape[1])) for side in (0, 1)])
        total = np.logaddexp(*like)
        good = np.exp(like[1] - total)
        prior = min(max((good.sum() + 1) / (len(v) + 2), 0.01), 0.99)
        for j in range(v.shape[1]):
            for side, w in ((0, 1 - good), (1, good)):
                seen = np.array([w[v[:, j] == k].sum() + 0.5 for k in range(3)])
                chance[j, side] = seen / seen.sum()
            bad = min(chance[j, 1, 0], 0.004)
            chance[j, 1] = [bad, *(chance[j, 1, 1:] * (1 - bad) / chance[j, 1, 1:].sum())]
        if total.sum() - last < 1e-7 * abs(total.sum()):
            break
        last = total.sum()
    like = [math.log(1 - prior if side == 0 else prior) + sum(np.log(chance[j, side, v[:, j]]) for j in range(v.shape[1])) for side in (0, 1)]
    return 1 / (1 + np.exp(like[0] - like[1]))


def test_verdicts_equal_fitting_over_rows(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    odd = spark.createDataFrame([(None, "x", "en", "s", 1), (10**6, None, "en", "s", 1), (0, "word " * 40, None, None, None), (10**6 + 1, "Many words here are fine. " * 2000, "en", "s", 1)], DOCS)
    docs = docs.union(odd).union(docs.limit(3)).withColumn("posterior", F.lit("x"))
    rows = docs.collect()
    judged = [brute_votes(r.text) for r in rows]
    want = brute_posteriors([v for v, _ in judged])
    by = defaultdict(list)
    for r, (_, failed), p in zip(rows, judged, want, strict=True):
        by[r.doc_id, r.text].append((round(float(p), 6), bool(not failed and p >= 0.5)))
    out, name = quality.judge(docs, "text", ["doc_id", "text"])
    got = defaultdict(list)
    for r in out.select("doc_id", "text", f"{name}.posterior", f"{name}.kept").collect():
        got[r.doc_id, r.text].append((round(r.posterior, 6), r.kept))
    assert set(got) == set(by) and all(len(got[k]) == len(by[k]) for k in by)
    assert all(abs(a[0] - b[0]) < 1e-4 and a[1] == b[1] for k in by for a, b in zip(got[k], by[k], strict=True))
    kept = quality.quality_filter(docs)
    assert kept.columns == docs.columns and kept.count() == sum(k for x in by.values() for _, k in x)


def plans_of(monkeypatch, module, run):
    """Physical plans of all tables that run() writes and of what it returns."""
    seen, plain = [], module.written

    def written(df, label):
        seen.append(df)
        return plain(df, label)

    monkeypatch.setattr(module, "written", written)
    seen.append(run())
    return [d._jdf.queryExecution().executedPlan().toString() for d in seen]


NOT_NATIVE = "Python|Pandas|Arrow|MapPartitions|ExternalRDD|Scan ExistingRDD"


def test_urls_are_native(spark, tmp_path, monkeypatch):
    spark.createDataFrame(made_web(5), "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    plans = plans_of(monkeypatch, urls, lambda: urls.judge_urls(spark.read.parquet(f"{tmp_path}/pages.parquet")))
    assert len(plans) >= 5 and not any(re.search(NOT_NATIVE, p) for p in plans)


def test_links_carry_blame(spark):
    page = lambda k, host, path, to: (k, f"http://{host}{path}", f'<a href="http://{to}/p">x</a>' if to else "")
    rows = [page(1, "bad.com", "/de/1", None), page(2, "friend.net", "/a", "bad.com"), page(3, "other.net", "/a", "good.org"), page(4, "good.org", "/a", None)]
    got = {r.page_id: r.verdict for r in urls.judge_urls(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {1: "block", 2: "block", 3: "allow", 4: "allow"}


def test_blame_reaches_the_end_of_a_chain_whatever_the_seeds(spark):
    rows = [(k, f"http://s{k}.com/de/1", "") for k in range(1, 400)] + [(0, "http://s0.com/de/1", "")]
    rows += [(1000 + k, f"http://c{k}.net/a", f'<a href="http://{f"c{k - 1}.net" if k else "s0.com"}/">x</a>') for k in range(30)]
    got = {r.page_id: r.verdict for r in urls.judge_urls(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert [k for k in range(30) if got[1000 + k] != "block"] == []


# WARC


def test_warc_round_trip(spark):
    rows = [(1, "http://a/", "same"), (2, "http://b/\r\nX: y", "same"), (3, None, "é\r\n\r\nWARC/1.1"), (4, "u", None), (5, "u", ""), (6, "u", "x" * 300_000), (None, "u", "same"), (7, "u", "last"), (7, "u", "last")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit(1))
    index = warc.write_warc(pages, fresh_path(spark, "warc"))
    got = warc.read_warc(index).collect()
    assert len(got) == len(rows) and all(r.intact for r in got)
    by = defaultdict(list)
    for r in got:
        by[r.page_id].append(r)
    for k, _, html in rows:
        body = (html or "").encode()
        for r in by[k]:
            assert r.payload_bytes == len(body) and r.payload_digest == base64.b32encode(hashlib.sha1(body).digest()).decode()
            assert r.record_type == "revisit" or r.payload == body
    assert by[1][0].refers_to == 2 and by[None][0].refers_to == 2 and by[2][0].refers_to is None and by[4][0].refers_to == 5
    assert [r.record_type for r in by[7]] == ["response", "response"]
    some = warc.read_warc(index.filter("page_id in (3, 6)")).collect()
    assert {r.page_id for r in some} == {3, 6}
    assert warc.round_trip(spark, pages.limit(0)).count() == 0


def test_ranges_merge():
    rows = [("a", 0, 10), ("a", 10, 10), ("a", 10**6, 5), ("b", 0, 5)]
    assert [len(x) for x in warc.ranges(rows)] == [2, 1, 1]


# Contamination


def brute_align(a, b):
    h, best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)], 0
    for i in range(len(a)):
        for j in range(len(b)):
            h[i + 1][j + 1] = max(0, h[i][j] + (2 if a[i] == b[j] else -1), h[i][j + 1] - 1, h[i + 1][j] - 1)
            best = max(best, h[i + 1][j + 1])
    return best


def test_alignment():
    rnd = np.random.default_rng(1)
    for _ in range(200):
        a, b = rnd.integers(0, 5, rnd.integers(1, 15)).astype(np.uint64), rnd.integers(0, 5, rnd.integers(1, 25)).astype(np.uint64)
        score, start, end = contamination.align(a, b)
        assert score == brute_align(a, b) and (not score or brute_align(a, b[start:end]) == score)


def test_contamination(spark):
    rnd = random.Random(9)
    items = [words(rnd, 30) for _ in range(5)]
    edited = list(items[1])
    edited[7], edited[15], edited[16] = "new", "other", "words"
    texts = [*ODD, " ".join(words(rnd, 40) + items[0] + words(rnd, 30)), " ".join(words(rnd, 9) + edited), " ".join(words(rnd, 100)), " ".join(items[2][:6] + words(rnd, 90))]
    docs = table(spark, texts, item_id=3, score=1.0)
    bench = spark.createDataFrame([*((k, " ".join(w)) for k, w in enumerate(items)), (90, None), (91, "")], "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in contamination.contaminated(docs, bench).collect()}
    n = len(ODD)
    assert got == {(n, 0), (n + 1, 1)}
    clean = contamination.decontaminate(docs, bench)
    assert clean.columns == docs.columns and {r.doc_id for r in clean.collect()} == set(range(len(texts))) - {n, n + 1}
    assert contamination.contaminated(docs.limit(0), bench).count() == 0 and contamination.contaminated(docs, bench.limit(0)).count() == 0


def test_contamination_of_frequent_words(spark):
    rnd = random.Random(12)
    item = [f"w{rnd.randrange(40)}" for _ in range(30)]
    item[10] = "unusual"
    copy = [*item[:10], "changed", *item[11:]]
    bench = spark.createDataFrame([(0, " ".join(item))], "item_id long, text string")
    docs = table(spark, [" ".join(words(rnd, 200, 40)) for _ in range(60)] + [" ".join(words(rnd, 50, 40) + copy + words(rnd, 50, 40))])
    got = {r.doc_id: r.score for r in contamination.contaminated(docs, bench).collect()}
    assert got[60] >= brute_align(item, copy) / (2 * len(item)) > 0.9
    assert {r.doc_id for r in contamination.decontaminate(docs, bench).collect()} == set(range(61)) - set(got)


def brute_spans(item, text):
    """The best score of the item anywhere in the text, as a part of its best."""
    return brute_align(item, text) / (2 * len(item))


def test_contamination_against_alignment_with_whole_texts(spark):
    rnd = random.Random(21)
    items = [words(rnd, rnd.randrange(3, 45), 300) for _ in range(25)] + [["one"], ["two", "words"]]
    items[7] = list(items[3])
    texts = [*ODD]
    for _ in range(120):
        copy = list(rnd.choice(items))
        for _ in range(rnd.randrange(0, 1 + len(copy) // 2)):
            k = rnd.randrange(len(copy))
            copy[k : k + rnd.randrange(2)] = [f"e{rnd.randrange(999)}"] * rnd.randrange(4)
            copy = copy or ["x"]
        texts.append(" ".join(words(rnd, rnd.randrange(60), 300) + copy + words(rnd, rnd.randrange(60), 300)))
    bench = spark.createDataFrame([(k, " ".join(w)) for k, w in enumerate(items)], "item_id long, text string")
    docs = table(spark, texts, seeds="x")
    docs = docs.union(docs.filter("doc_id = 20")).union(spark.createDataFrame([(None, texts[20], "en", "s", 1)], DOCS).withColumn("seeds", F.lit("x")))
    got = defaultdict(list)
    for r in contamination.contaminated(docs, bench).collect():
        got[r.doc_id, r.item_id].append(r.score)
    checked = 0
    for d, text in enumerate(texts):
        w = [x.decode() for x in contamination.words(text)]
        grams = lambda x: {tuple(x[i : i + 4]) for i in range(len(x) - 3)}
        for k, item in enumerate(items):
            seed = grams(item) & grams(w) if len(item) >= 4 else w == item
            part = brute_spans(item, w) if seed and len(w) < 500 else 0.0
            checked += part >= 0.5
            # Half the score of fewer words may lie in less than LEAST_WORDS of them.
            assert ((d, k) in got) == (part >= 0.5) or part >= 0.5 and 4 <= len(item) < 16, (d, k, part)
            assert not got.get((d, k)) or all(abs(x - part) < 1e-9 for x in got[d, k])
    assert checked > 60 and all(len(got[20, k]) == 2 for d, k in list(got) if d == 20) and {k for d, k in got if d is None} == {k for d, k in got if d == 20}
    clean = contamination.decontaminate(docs, bench)
    assert sorted((r.doc_id for r in clean.collect()), key=repr) == sorted((r.doc_id for r in docs.collect() if not any(d == r.doc_id for d, k in got if got[d, k])), key=repr)


def test_blocks_of_items_find_the_same(spark, monkeypatch):
    rnd = random.Random(22)
    items = [words(rnd, 20) for _ in range(9)]
    bench = spark.createDataFrame([(k, " ".join(w)) for k, w in enumerate(items)], "item_id long, text string")
    docs = table(spark, [" ".join(words(rnd, 30) + items[k % 9]) for k in range(20)])
    whole = sorted(contamination.contaminated(docs, bench).collect())
    monkeypatch.setattr(contamination, "BLOCK_ITEMS", 2)
    assert len(list(contamination.blocks(bench, "item_id", "text"))) == 5
    assert sorted(contamination.contaminated(docs, bench).collect()) == whole and len(whole) == 20
    assert contamination.decontaminate(docs, bench).count() == 0


# Languages


def test_forward_sums_all_segmentations():
    table_ = langid.Pieces([langid.SPACE + "a", "a", "b", "ab", langid.SPACE + "ab"])
    p = np.random.default_rng(0).random((5, 2))
    at = {n: k for k, n in enumerate(table_.names)}

    def brute(s, lang):
        if not s:
            return 1.0
        total = langid.UNKNOWN * brute(s[1:], lang)
        return total + sum(p[at[s[:k]], lang] * brute(s[k:], lang) for k in range(1, len(s) + 1) if s[:k] in at)

    for word in ("a", "ab", "abab", "aabbx", "x"):
        got = langid.log_chances([word], table_, p)[0]
        assert np.allclose(np.exp(got), [brute(langid.SPACE + word, k) for k in (0, 1)])


def made_pieces():
    return [langid.SPACE, *"abcde", "ab", "bc", "cde", langid.SPACE + "a", langid.SPACE + "abc", "eab"]


def test_long_words_are_summed_whole():
    table_ = langid.Pieces(made_pieces())
    p = np.random.default_rng(3).random((len(table_.names), 3)) / 9
    rnd = random.Random(3)
    for n in (1, 5, 31, 32, 33, 100, 400):
        word = "".join(rnd.choice("abcdex") for _ in range(n))
        text = langid.SPACE + word
        at = {x: k for k, x in enumerate(table_.names)}
        want = []
        for lang in range(3):  # exact fractions would do the same; logs of sums in high precision
            a = [1.0] + [0.0] * len(text)
            log = 0.0
            for end in range(1, len(text) + 1):
                a[end] = a[end - 1] * langid.UNKNOWN + sum(a[end - k] * p[at[text[end - k : end]], lang] for k in range(1, min(4, end) + 1) if text[end - k : end] in at)
                if a[end] < 1e-200:
                    log += math.log(1e-200)
                    a = [x / 1e-200 for x in a]
            want.append(math.log(a[-1]) + log)
        assert np.allclose(langid.log_chances([word], table_, p)[0], want, rtol=1e-9)
    assert np.isfinite(langid.log_chances(["q" * 300_000], table_, p)).all()


def test_counts_of_long_words_equal_those_of_short_ones():
    table_ = langid.Pieces(made_pieces())
    p = np.random.default_rng(4).random((len(table_.names), 2)) / 9
    word = "abcdeabxcde"
    at = {x: k for k, x in enumerate(table_.names)}
    text, want, total = langid.SPACE + word, np.zeros_like(p), np.zeros(2)

    def walk(end, weight, used):
        if end == len(text):
            total[:] += weight
            for k in used:
                want[k] += weight
            return
        walk(end + 1, weight * langid.UNKNOWN, used)
        for n in range(1, 5):
            if text[end : end + n] in at and end + n <= len(text):
                walk(end + n, weight * p[at[text[end : end + n]]], [*used, at[text[end : end + n]]])

    walk(0, np.ones(2), [])
    assert np.allclose(langid.long_counts(word, table_, p, np.array([1.0, 2.0])), want / total * [1.0, 2.0])


def test_predictions_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(langid, "pieces_of", lambda _: made_pieces())
    rnd = random.Random(12)
    rows = []
    for k in range(80):
        lang = "xy"[k % 2]
        text = " ".join("".join(rnd.choice("abcab" if lang == "x" else "cdeab") for _ in range(rnd.choice([2, 5, 40]))) for _ in range(6))
        rows.append((k, text.upper() if k % 5 == 0 else text.replace(" ", "\u00a0", 1), lang if k < 60 else None, "s", 1))
    rows += [(None, "abc", "x", "s", 1), (1, rows[1][1], "y", "s", 1), (900, None, "x", "s", 1), (901, "", None, "s", 1), (902, "123", "x", "s", 1), (903, "\u00e9" * 100, "x", "s", 1), (904, "\u00b2 \u00bd", "x", "s", 1), (905, "\u2460_7 \u0f33", None, "s", 1), (906, "5\u00aa", None, "s", 1)]
    docs = spark.createDataFrame(rows, DOCS).withColumn("score", F.lit("x")).withColumn("held_out", F.lit(1))
    table_, p, langs = langid.train(docs, "doc_id", "text", "lang", sample=10**6)
    at = {x: k for k, x in enumerate(table_.names)}
    got = langid.predict_languages(docs, sample=10**6).collect()
    assert len(got) == len(rows) and langs == ["x", "y"]
    by = {(d, t): None for d, t, *_ in rows}
    for d, t in by:
        total = np.zeros(2)
        for w in re.findall(r"[^\x20\x09-\x0D]+", (t or "").lower()):
            text, a = langid.SPACE + w, [np.ones(2)]
            for end in range(1, len(text) + 1):
                a.append(a[end - 1] * langid.UNKNOWN + sum((a[end - k] * p[at[text[end - k : end]]] for k in range(1, min(4, end) + 1) if text[end - k : end] in at), np.zeros(2)))
            total += np.log(a[-1]) if len(text) < 60 else langid.log_chances([w], table_, p)[0]
        letters = any(c.isalpha() for c in t or "")
        best = max(range(2), key=lambda k: (total[k], -k))
        by[d, t] = (langs[best] if letters else "und", 1 / np.exp(total - total.max()).sum() if letters else 0.0)
    seen = {}
    for r in got:
        seen.setdefault(r.doc_id, []).append((r.lang_pred, round(r.score, 9)))
    for (d, t), (lang, score) in by.items():
        assert (lang, round(score, 9)) in seen[d], (d, t)
    assert langid.predict_languages(docs.limit(0)).count() == 0
    with pytest.raises(ValueError, match="labels"):
        monkeypatch.setattr(langid, "MOST_LANGUAGES", 1)
        langid.predict_languages(docs)


def test_languages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    odd = spark.createDataFrame([(10**6, None, "en", "s", 1), (10**6 + 1, " 12 !", None, "s", 1), (10**6 + 2, "x" * 50_000, None, "s", 1), (None, "the and of", None, "s", 1)], DOCS)
    got = langid.predict_languages(docs.union(odd), sample=60)
    truth = {r.doc_id: r.lang for r in docs.collect()}
    rows = {r.doc_id: r for r in got.collect()}
    held = [r for r in rows.values() if r.held_out and r.doc_id in truth]
    assert sum(r.lang_pred == truth[r.doc_id] for r in held) / len(held) > 0.95
    assert rows[10**6].lang_pred == "und" and rows[10**6 + 1].lang_pred == "und" and all(0 <= r.score <= 1 for r in rows.values())
    none = langid.predict_languages(docs.withColumn("lang", F.lit(None).cast("string")).limit(5))
    assert {r.lang_pred for r in none.collect()} == {"und"}


def test_places_of_terms_in_a_text_full_of_entities():
    rnd = random.Random(6)
    bits = ["Mirabel", "a.b@c.org", "1.2.3.4", "mirabel,", "+49 170 1234567", "x", "(Mirabel)", "to:Mirabel@home.net", "4111 1111 1111 1111"]
    term = [{"term": h, "part": 0.5} for h, _, _ in pii.located("Mirabel")]
    for _ in range(200):
        text = " ".join(rnd.choice(bits) for _ in range(rnd.randrange(30)))
        taken = pii.find(text)
        want = [(a, b, 0.5) for h, a, b in pii.located(text) if h == term[0]["term"] and not any(s < b and a < e for s, _, e in taken)]
        assert pii.places(text, term) == want
    began = time.monotonic()
    assert len(pii.places("Mirabel a.b@c.org 1.2.3.4 " * 40_000, term)) == 40_000
    assert time.monotonic() - began < 20
