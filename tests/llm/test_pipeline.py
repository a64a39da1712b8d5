"""The pipeline: each stage on what the one before it kept, against restatements; and on odd tables."""

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as P
from rallyframe.llm import contamination, mixing, pii
from test_llm import DOCS, ODD, brute_align, brute_near, brute_posteriors, brute_terms, brute_votes


def test_stages_equal_restatements(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = docs.collect()
    judged = [brute_votes(r.text) for r in rows]
    good = P.quality_rules(spark, docs, sf_dir)
    want = {r.doc_id for r, (_, failed), p in zip(rows, judged, brute_posteriors([v for v, _ in judged]), strict=True) if not failed and p >= 0.5}
    kept = {r.doc_id: r.text for r in good.collect()}
    assert set(kept) == want and good.columns == docs.columns
    clean = {r.doc_id for r in spark.read.parquet(f"{sf_dir}/labels.parquet").filter("quality = 1").collect()}
    assert len(clean & set(kept)) > 0.9 * len(clean)
    near = P.near_dedup(spark, good, sf_dir)
    left = {r.doc_id: r.text for r in near.collect()}
    assert set(left) == {root for _, root in brute_near(kept, 5, 80).values()}
    free = P.decontamination(spark, near, sf_dir)
    items = [contamination.words(r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    grams = lambda w: {tuple(w[i : i + 4]) for i in range(len(w) - 3)}
    seeds = [(w, grams(w)) for w in items]
    bad = set()
    for d, t in left.items():
        w = contamination.words(t)
        own = grams(w)
        for item, g in seeds:
            for at in (i for i in range(len(w) - 3) if tuple(w[i : i + 4]) in g) if own & g else ():
                if brute_align(item, w[max(0, at - 2 * len(item)) : at + 2 * len(item)]) >= len(item):
                    bad.add(d)
                    break
    texts = {r.doc_id: r.text for r in free.collect()}
    assert set(texts) == set(left) - bad and free.columns == docs.columns
    masked = P.personal_data(spark, free, sf_dir)
    out = {r.doc_id: r for r in masked.collect()}
    ids = sorted(texts)
    assert set(out) == set(texts) and masked.columns == docs.columns and all(not pii.find(r.text) and r.n_chars == len(r.text) for r in out.values())
    terms = dict(zip(ids, brute_terms([texts[k] for k in ids]), strict=True))
    assert all(out[k].text == texts[k] for k in ids if not terms[k] and not pii.find(texts[k]))
    mixed = P.mixture(spark, masked, sf_dir)
    db = duckdb.connect()
    db.register("documents", masked.toPandas())
    assert {(r.doc_id, r.taken) for r in mixed.collect()} == set(db.sql(f"select doc_id, taken from ({mixing.SQL}) where taken > 0").fetchall())
    assert [n for n, _ in P.STAGES] == ["quality rules", "near-dedup", "decontamination", "personal data", "mixture"]


@pytest.mark.parametrize("stage", [f for _, f in P.STAGES], ids=[n for n, _ in P.STAGES])
def test_stages_on_odd_tables(spark, sf_dir, stage):
    fine = " ".join(f"word{k}, and" for k in range(60)) + "."
    rows = [(k, t, None if k % 2 else "en", None if k % 3 else "s", None) for k, t in enumerate(ODD)] + [(None, fine, "en", "s", 1), (None, None, None, None, None), (50, fine, "en", "s", 1), (50, fine, "en", "s", 1), (51, "mail a@b.example.com " + fine, "en", "t", 1)]
    docs = spark.createDataFrame(rows, DOCS)
    wide = docs.withColumns({c: F.lit("x") for c in ("quality", "terms", "text_key", "votes", "kept_id", "component_id", "node", "score")})
    for table in (docs, wide):
        out = stage(spark, table, sf_dir)
        got = out.collect()
        assert {r.doc_id for r in got} <= {r[0] for r in rows}
        if stage is P.near_dedup or stage is P.quality_rules or stage is P.decontamination:
            assert out.columns == table.columns
        if stage is P.near_dedup:
            assert sum(r.doc_id == 50 for r in got) <= 1 and sum(r.doc_id is None for r in got) == 2
        if stage is P.personal_data:
            assert out.columns == docs.columns and len(got) == len(rows) and sum("[EMAIL]" in (r.text or "") for r in got) == 1
        if stage is P.decontamination:
            assert len(got) == len(rows)
        assert stage(spark, table.limit(0), sf_dir).count() == 0


def test_run(spark, sf_dir):
    assert P.run(spark, sf_dir).count() > 0
