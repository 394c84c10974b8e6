"""Layout on large tables: words go through one shuffle, and pages come whole whatever batches they come in."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from waymark.operators import layout, reading
from waymark.plans import registry

SCHEMA = "doc_id long, page int, pos int, text string, x0 double, x1 double, top double, bottom double"


def plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


@pytest.fixture(scope="module")
def words(spark):
    return spark.range(600).selectExpr("id DIV 200 AS doc_id", "CAST(id % 200 DIV 100 AS INT) AS page", "CAST(id % 100 AS INT) AS pos", "IF(id % 7 = 0, 'São', concat('w', id)) AS text", "(id % 5) * 70D AS x0", "(id % 5) * 70D + 40 AS x1", "(id % 100 DIV 5) * 14D AS top", "(id % 100 DIV 5) * 14D + 10 AS bottom")


def test_pages_come_whole():
    doc, page = [1] * 5 + [2] * 4 + [None] * 3, [0, 0, 0, 1, 1, 1, 1, 1, 2, 2, 2, 2]
    whole = pa.RecordBatch.from_arrays([pa.array(doc), pa.array(page), pa.array(range(12))], names=["doc_id", "page", "n"])
    for size in range(1, 13):
        got = list(reading.whole_pages(iter([whole.slice(i, size) for i in range(0, 12, size)])))
        assert [n for b in got for n in b.column("n").to_pylist()] == list(range(12))
        assert {0, 3, 5, 8, 9} >= {b.column("n")[0].as_py() for b in got}
    assert reading.page_starts(whole).tolist() == [0, 3, 5, 8, 9]


def test_bands_and_lines():
    edges = np.array([0.0, 1.0, 4.5, 9.0, 20.0])
    assert reading.bands(edges, np.array([-1.0, 0.0, 0.5, 1.0, 4.5, 8.0, 20.0, 20.5])).tolist() == [-1, 0, 0, 0, 1, 2, 3, -1]
    assert reading.lines(np.array([0.0, 3.0, 4.0, 7.0, 8.5]), 4.0) == [0, 0, 1, 1, 2]


@pytest.mark.parametrize("work", [layout.mean_lines, layout.anchors, layout.anchored_records])
def test_words_are_read_in_one_pass(spark, words, work):
    seen = plan(work(words))
    assert seen.count("RepartitionByExpression") == 1 and "Join" not in seen and "Window" not in seen
    assert work(words).groupBy("doc_id", "page").count().count() == 6


def test_bands_are_read_in_one_pass(spark):
    boxes = spark.createDataFrame([(1, 0, i, t, x, x + 2.0, y, y + 2.0) for i, (t, x, y) in enumerate([("c", 5.0, 30.0), ("b", 20.0, 20.0), ("a", 5.0, 21.0), ("z", 61.0, 20.0), ("y", 71.0, 20.0), ("out", 900.0, 20.0), ("up", 5.0, 5.0)])], SCHEMA)
    cut = spark.createDataFrame([(1, 0, [10.0, 40.0, 50.0], [0.0, 60.0, 70.0, 80.0], 8.0)], "doc_id long, page int, h array<double>, v array<double>, head double")
    got = layout.band_cells(boxes, cut)
    assert [tuple(r) for r in layout.cells(got).orderBy("col").collect()] == [(1, 0, 0, 0, "a b c"), (1, 0, 0, 1, "z"), (1, 0, 0, 2, "y")]
    assert plan(got).count("RepartitionByExpression") == 1 and "Window" not in plan(got)


def test_coverage_sorts_no_words(spark, words):
    got = layout.coverage_bands(words, least=5)
    assert "Join" not in plan(got) and "Window" not in plan(got)
    assert [(r["low"], r["high"]) for r in got.where("doc_id = 0 AND page = 0").orderBy("band").collect()] == [(0.0, 55.5), (55.5, 125.5), (125.5, 195.5), (195.5, 265.5), (265.5, 321.0)]


def test_lines_keep_the_pages_side(spark, words):
    columns = words.select("doc_id", "page").distinct().withColumn("band", F.explode(F.sequence(F.lit(0), F.lit(5)))).withColumns({"low": F.col("band") * 70.0, "high": (F.col("band") + 1) * 70.0})
    got = layout.line_records(words.withColumn("line", F.floor(F.col("pos") / 5).cast("int")), columns)
    assert plan(got).count("collect_list(struct(band") == 2 and got.count() == 120  # the page's bands and a line's words


def test_continued_rows_are_shuffled_once(spark, tmp_path):
    spark.createDataFrame([(i, f"a b c d e f {i}") for i in range(9)], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = registry.QUERIES["o28e_continued_rows"](spark, str(tmp_path))
    assert got._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1
