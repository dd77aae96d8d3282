"""The registered training-data queries and the pipeline on the test tables."""

import re

import pytest

from conftest import TESTDATA
from weftlink.llm.oracle import ORACLE
from weftlink.llm.queries import QUERIES, TOKENIZER

duckdb = pytest.importorskip("duckdb")
pytestmark = pytest.mark.skipif(not TESTDATA.exists(), reason="test tables not found")


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    for path in TESTDATA.glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return con


def test_one_query_for_each_operator():
    assert sorted(int(re.match(r"op(\d+)_", n)[1]) for n in QUERIES) == list(range(1, 14))


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_sql(spark, sql, name):
    frame = QUERIES[name](spark, str(TESTDATA))
    expected = sql.execute(ORACLE[name])
    names = [c[0] for c in expected.description]
    assert sorted(names) == sorted(frame.columns)
    order = sorted(range(len(names)), key=lambda i: names[i])
    got = sorted(repr([r[c] for c in sorted(frame.columns)]) for r in frame.collect())
    assert got == sorted(repr([r[i] for i in order]) for r in expected.fetchall())


def test_pipeline_stages(spark):
    """Each stage against a plain version of it, on what the stage before kept."""
    import corpus_pipeline
    from test_llm_operators import check_packed, jaccard_rows
    from weftlink.llm import mixing, quality

    sf_dir = str(TESTDATA)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = docs.collect()
    for name, stage in corpus_pipeline.STAGES:
        after = stage(spark, spark.createDataFrame(before, docs.schema), sf_dir)
        rows = after.collect()
        if name != "packing":
            assert after.columns == docs.columns and set(rows) <= set(before)
        ids = sorted(r["doc_id"] for r in rows)
        if name == "quality":
            labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
            kept = quality.quality_scores(docs, labels).filter("keep").collect()
            assert ids == sorted(r["doc_id"] for r in kept) and len(rows) < len(before)
        elif name == "exact dedup":
            first = {}
            for r in before:
                key = re.sub(r"[\x20\x09-\x0D]+", " ", r["text"] or "")
                first[key] = min(r["doc_id"], first.get(key, r["doc_id"]))
            assert ids == sorted(first.values())
        elif name == "near dedup":
            order = sorted(before, key=lambda r: r["doc_id"])
            linked = jaccard_rows([r["text"] for r in order], 5, 4, 5)
            assert ids == [order[i]["doc_id"] for i, _, root in sorted(linked) if i == root]
        elif name == "mixing":
            size, taken = {}, {}
            for r in before:
                size[r["source"]] = size.get(r["source"], 0) + len((r["text"] or "").split())
            for r in rows:
                taken[r["source"]] = taken.get(r["source"], 0) + len((r["text"] or "").split())
            longest = max(len((r["text"] or "").split()) for r in before)
            for s, target in mixing.source_targets(size, sum(size.values())).items():
                assert abs(taken.get(s, 0) - float(target)) <= longest / 2 + 1
        else:
            pieces, _ = check_packed(rows, {r["doc_id"]: r["text"] for r in before})
            assert set(pieces) == {r["doc_id"] for r in before}
        before = rows
    assert TOKENIZER
