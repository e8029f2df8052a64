"""The pipeline's stages against brute force, and its queries against SQL."""
import random
from collections import Counter

import duckdb

import corpus_pipeline
from rasterloom.llm import common, queries

from .test_operators import check_pieces, slow_components, slow_fingerprint, slow_removal

rng = random.Random(3)


def test_stages_on_a_fixture(spark, docs_of):
    pool = [f"tok{i}" for i in range(4000)]
    texts = [" ".join(rng.choice(pool) for _ in range(rng.randint(70, 140))) for _ in range(40)]
    shared = " ".join(rng.choice(pool) for _ in range(60))
    texts += [texts[0], texts[1], texts[2] + " " + shared, texts[3] + " " + shared, "too short", None]
    docs = docs_of(texts)
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality_rules", "language_id", "simhash_near_dedup", "substring_dedup", "packing"]
    now = docs
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        before = {r["doc_id"]: r["text"] for r in now.collect()} if name != "quality_rules" else dict(enumerate(texts))
        now = common.materialize(stage(spark, now, ""), name)
        seen[name] = rows = now.collect()
        if name != "packing":
            assert now.columns == docs.columns
        if name in ("quality_rules", "language_id"):
            assert {r["doc_id"] for r in rows} == set(range(44))
        elif name == "simhash_near_dedup":
            ids = sorted(before)
            roots = slow_components([slow_fingerprint(before[i]) for i in ids])
            assert {r["doc_id"] for r in rows} == {ids[k] for k in set(roots)}
        elif name == "substring_dedup":
            want = slow_removal(before.items())
            assert {r["doc_id"]: len(r["text"].split()) for r in rows} == {k: n - gone for k, (n, gone, _) in want.items()}
            assert any(gone for _, gone, _ in want.values()) and all(r["n_chars"] == len(r["text"]) for r in rows)
        else:
            check_pieces(rows, before)
    assert {40, 41}.isdisjoint(r["doc_id"] for r in seen["simhash_near_dedup"])


def test_run_equals_stages(spark, sf_dir):
    assert corpus_pipeline.run(spark, sf_dir).count() > 0


def test_sql_twins(spark, sf_dir):
    db = duckdb.connect()
    for t in ("documents", "pages"):
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    for name, sql in queries.ORACLES.items():
        df = queries.QUERIES[name](spark, sf_dir)
        columns = sorted(df.columns)
        want = db.execute(f"SELECT {', '.join(columns)} FROM ({sql})").fetchall()
        assert Counter(map(tuple, df.select(*columns).collect())) == Counter(want), name
