"""The queries against their SQL, and the pipeline stage by stage."""

import os

import duckdb
import pytest

import corpus_pipeline
from waymark.llm import queries

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def duck_llm():
    con = duckdb.connect()
    for name in os.listdir(SF):
        con.sql(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM '{SF}/{name}'")
    return con


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_against_sql(spark, duck_llm, name):
    got, want = queries.QUERIES[name](spark, SF).toPandas(), duck_llm.sql(queries.ORACLE[name]).df()

    def table(frame):
        frame = frame[sorted(frame.columns)].astype(object)
        return sorted(map(str, frame.where(frame.notna(), None).map(lambda x: int(x) if isinstance(x, float) else x).itertuples(index=False, name=None)))

    assert table(got) == table(want)


def test_pipeline_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = docs
        stage(spark, docs, SF).write.parquet(str(tmp_path / str(i)))
        docs = spark.read.parquet(str(tmp_path / str(i)))
        if i < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == before.columns, name
            assert docs.count() <= before.count()
            if name == "exact dedup":
                assert docs.count() == before.selectExpr(r"regexp_replace(text, '[\\x20\\x09-\\x0D]+', ' ') AS t").distinct().count()
    assert docs.select("doc_id").distinct().count() == before.count()
    assert corpus_pipeline.run(spark, SF).count() == docs.count()
