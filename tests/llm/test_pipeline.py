"""The pipeline stage by stage against what its operators say, and every query against its SQL."""

from __future__ import annotations

from collections import Counter

import pytest

import corpus_pipeline
from pagewell.llm.catalog import ENTRIES
from pagewell.llm.mixing import mix_sources
from tests.llm.test_operators import groups, slow_fingerprint
from tests.oracle import compare, connect

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", [n for n, e in ENTRIES.items() if e.sql])
def test_query_agrees_with_sql(spark, name):
    assert compare(spark, connect(FOLDER), name, ENTRIES[name], FOLDER) is None


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    seen = {}
    for name, step in corpus_pipeline.STAGES:
        step(spark, docs, FOLDER).write.parquet(str(tmp_path / name))
        seen[name] = (docs, spark.read.parquet(str(tmp_path / name)))
        docs = seen[name][1]
    for name, (before, after) in list(seen.items())[:-1]:
        assert after.columns == before.columns and after.count()
    ids = {n: [r[0] for r in d[1].select("doc_id").collect()] for n, d in seen.items()}

    scored = {r["doc_id"]: r["predicted"] for r in ENTRIES["op2_quality_rules"].run(spark, FOLDER).collect()}
    assert sorted(ids["quality_rules"]) == sorted(k for k, p in scored.items() if p)

    last = {}
    for r in seen["exact_dedup"][0].collect():
        last[r["text"]] = max(last.get(r["text"], -1), r["doc_id"])
    assert sorted(ids["exact_dedup"]) == sorted(last.values())

    fps = {r["doc_id"]: slow_fingerprint(r["text"]) for r in seen["simhash_near_dedup"][0].collect()}
    root = {k: k for k in fps}
    changed = True
    while changed:
        changed = False
        for a in fps:
            for b in fps:
                if (fps[a] ^ fps[b]).bit_count() <= 2 and root[a] < root[b]:
                    root[b] = root[a]
                    changed = True
    assert sorted(ids["simhash_near_dedup"]) == sorted(k for k, r in root.items() if k == r)

    drawn = Counter()
    for r in mix_sources(seen["mix_sources"][0], cut=False).collect():
        drawn[r["doc_id"]] += len(r["draws"])
    assert Counter(ids["mix_sources"]) == +drawn

    tokens = Counter()
    for r in seen["pack"][1].collect():
        tokens[r["doc_id"]] += r["length"]
        assert r["offset"] + r["length"] <= 2048
    assert set(tokens) == set(ids["mix_sources"])


def test_stages_take_messy_and_empty_tables(spark, messy, none, tmp_path):
    for kind, table in (("messy", messy), ("none", none)):
        for name, step in corpus_pipeline.STAGES:
            out = step(spark, table, FOLDER)
            out.write.parquet(str(tmp_path / f"{kind}-{name}"))
            n = spark.read.parquet(str(tmp_path / f"{kind}-{name}")).count()
            assert n == 0 if kind == "none" else n > 0
    once = corpus_pipeline.drop_exact_copies(spark, messy, FOLDER)
    assert once.count() == len({r["text"] or "" for r in messy.select("text").collect()})
    fps = [slow_fingerprint(r["text"]) for r in messy.select("text").collect()]
    root = groups(fps, lambda a, b: (a ^ b).bit_count() <= 2)
    assert corpus_pipeline.drop_near_copies(spark, messy, FOLDER).count() == len(set(root))
