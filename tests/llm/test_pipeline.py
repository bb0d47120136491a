import math
import re

import pytest

import corpus_pipeline
from cladekit.llm import decontam, rules
from cladekit.llm.queries import ORACLES, QUERIES


def test_registered():
    import __spark_entry__ as entry

    names = set(entry.queries())
    assert "pipeline" in names and {re.match(r"op\d+", n)[0] for n in names if n.startswith("op")} >= {f"op{k}" for k in range(1, 14)}
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_duplicates", "decontamination", "personal_data", "packing"]


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows_as_sql(spark, folder, name):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "benchmark", "conversations", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    df, sql = QUERIES[name](spark, folder), con.execute(ORACLES[name])
    names = [d[0] for d in sql.description]
    assert sorted(df.columns) == sorted(names)
    assert not any(isinstance(v, float) and math.isnan(v) for r in df.take(3) for v in r)
    assert sorted(str([r[c] for c in names]) for r in df.collect()) == sorted(str(list(r)) for r in sql.fetchall())


def test_stages(spark, folder, documents, texts):
    """Each stage does on its input what a plain version does."""
    from test_minhash import brute as components
    from test_pii import brute as personal

    docs, before = documents, texts
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, folder)
        assert out.columns == documents.columns
        rows = out.collect()
        now = {r["doc_id"]: r["text"] for r in rows}
        assert len(now) == len(rows)
        if name == "quality":
            assert set(now) == {r["doc_id"] for r in rules.verdicts(docs).where("kept").collect()}
        elif name == "near_duplicates":
            assert set(now) == {d for d, x in components(sorted(before.items()), 5).items() if x[2]}
        elif name == "decontamination":
            bad = decontam.report(docs, spark.read.parquet(f"{folder}/benchmark.parquet")).where("contaminated").collect()
            assert bad and set(now) == set(before) - {r["doc_id"] for r in bad}
        else:
            assert set(now) == set(before) and not any(personal(t) for t in now.values())
            assert all(now[d] == t for d, t in before.items() if not personal(t) and not re.search(r"[0-9=]", t))
        docs, before = spark.createDataFrame(rows, documents.schema), now
    final = corpus_pipeline.run(spark, folder).collect()
    assert {r["doc_id"] for r in final} == set(before)


def test_odd_and_empty_tables(spark, folder, odd, empty):
    for docs in (odd, empty):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            docs = stage(spark, docs, folder)
            assert docs.columns == odd.columns
        corpus_pipeline.STAGES[-1][1](spark, docs, folder).collect()
