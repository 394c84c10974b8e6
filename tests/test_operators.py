import pytest
from pyspark.sql import functions as F

from waymark.functions import geo
from waymark.operators import geojoin, layout, lookup, merge, metrics, pages, search, tables
from waymark.streaming import streams

FAC = "id int, uf string, municipio string, unidade string, endereco string, cnes string, atendimentos_raw string, lat double, lng double"


def rows(df, *columns):
    return sorted(tuple(r) for r in (df.select(*columns) if columns else df).collect())


def test_writes(spark):
    stored = spark.createDataFrame([(1, "a"), (2, "b")], "id int, v string")
    new = spark.createDataFrame([(2, "c", 1), (2, "d", 2), (3, "e", 1)], "id int, v string, seq int")
    assert rows(tables.upsert(stored, new, ["id"], [F.col("seq")])) == [(1, "a"), (2, "d"), (3, "e")]
    assert rows(tables.insert_missing(stored, new, ["id"], [F.col("seq")])) == [(1, "a"), (2, "b"), (3, "e")]
    assert rows(tables.delete(stored, new, ["id"])) == [(1, "a")]
    patch = spark.createDataFrame([(1, None)], "id int, v string")
    assert rows(tables.update(stored, patch, ["id"], ["v"])) == [(1, None), (2, "b")]


def test_quarantine(spark):
    t = spark.createDataFrame([(1, 5), (2, 500), (3, None)], "id int, c int")
    good, bad = tables.quarantine(t, {"range": F.col("c").between(0, 100), "known": F.col("c").isNotNull()})
    assert rows(good, "id") == [(1,)]
    assert rows(bad, "id", "broken") == [(2, ["range"]), (3, ["known"])]


def test_merge_keeps_coordinates_unless_the_address_changed(spark):
    stored = spark.createDataFrame([(1, "SP", "A", "U1", "Rua 1", None, "x", 1.0, 2.0), (2, "SP", "A", "U2", "Rua 2", "7", "x", 1.0, 2.0), (3, "SP", "B", "U3", "Rua 3", "", "x", 1.0, 2.0), (9, "SP", "A", "U1", "Rua 1", "", "x", 5.0, 6.0)], FAC)
    incoming = spark.createDataFrame([(1, "SP", "A", "U1", "Rua 1", "", "x"), (2, "SP", "A", "U2", "Rua 2 novo", "7", "x"), (3, "SP", "C", "U4", None, None, "x"), (4, "SP", "C", "U4", None, None, "x")], "seq int, uf string, municipio string, unidade string, endereco string, cnes string, atendimentos_raw string")
    changes = merge.number_inserts(merge.merge(stored, incoming), 10, 2)
    got = {(r.op, r.id): (r.lat, r.geocode_status, r.address_changed, r.changed) for r in changes.collect()}
    assert got[("update", 9)] == (5.0, "ok", False, False)  # the stored duplicate with the larger id
    assert got[("delete", 1)][0] is None
    assert got[("update", 2)] == (None, "pendente", True, True)
    assert ("delete", 3) in got
    assert ("insert", 10) in got and ("insert", 11) in got  # both incoming duplicates
    assert merge.apply(stored, changes).count() == 4


def test_merge_carries_all_columns_and_keeps_a_failed_status(spark):
    wide = FAC + ", geocode_status string, telefones string, confianca_ocr int, atualizado_em string"
    stored = spark.createDataFrame([(1, "SP", "A", "U1", "Rua 1", "1", "x", None, None, "falhou", "t1", 80, "old"), (2, "SP", "A", "U2", "Rua 2", "2", "x", 1.0, 2.0, "ok", "t2", 90, "old"), (3, "RJ", "B", "U3", "Rua 3", "3", "x", 1.0, 2.0, "ok", "t3", 70, "old")], wide)
    incoming = spark.createDataFrame([(1, "SP", "A", "U1", "Rua 1", "1", "x", "new1"), (2, "SP", "A", "U2", "Rua 9", "2", "x", "t2"), (7, "SP", "A", "U9", "Rua 7", None, "y", "new9")], "seq int, uf string, municipio string, unidade string, endereco string, cnes string, atendimentos_raw string, telefones string")
    after = merge.apply(stored, merge.number_inserts(merge.merge(stored, incoming, F.lit("now")), 10))
    assert after.columns == stored.columns
    got = {r.id: r for r in after.collect()}
    assert set(got) == {1, 2, 10}
    assert (got[1].geocode_status, got[1].telefones, got[1].confianca_ocr, got[1].atualizado_em) == ("falhou", "new1", 80, "now")
    assert (got[2].geocode_status, got[2].lat, got[2].endereco) == ("pendente", None, "Rua 9")
    assert (got[10].geocode_status, got[10].unidade, got[10].confianca_ocr) == ("pendente", "U9", None)


def test_inserts_are_numbered_in_order_without_dense_sequence(spark):
    changes = spark.createDataFrame([("insert", None, i * i * 1000, "SP", "A", str(i), None) for i in range(200)] + [("delete", 5, None, "SP", "A", "x", None)], "op string, id long, seq long, uf string, municipio string, unidade string, cnes string")
    got = merge.number_inserts(changes, 1000, 8)
    assert [r.id for r in got.where("op = 'insert'").orderBy("seq").collect()] == list(range(1000, 1200))
    assert got.where("op = 'delete'").first().id == 5


def test_control_rows_have_hash_and_times(spark):
    incoming = spark.createDataFrame([("SP", 1), ("SP", 1), ("RJ", 2)], "uf string, seq int")
    sources = spark.createDataFrame([("SP", "h1", "t1")], "uf string, pdf_hash string, site_ts string")
    got = merge.control_rows(incoming, F.col("seq") == 2, sources, F.lit("now"))
    assert rows(got, "uf", "total", "status", "pdf_hash", "atualizado_em", "sincronizado_em") == [("RJ", 1, "ok_ocr", None, None, "now"), ("SP", 2, "ok", "h1", "t1", "now")]


def test_origins_have_their_own_reach_state_and_service(spark):
    fac = spark.createDataFrame([(1, "SP", "M", "U", None, None, "Botrópico", 0.0, 0.1), (2, "RJ", "M", "U", None, None, "Crotálico", 0.0, 0.2), (3, "SP", "M", "U", None, None, "Crotálico", 0.0, 1.0)], FAC)
    ori = spark.createDataFrame([(1, 0.0, 0.0, 15_000.0, None, None), (2, 0.0, 0.0, 30_000.0, "rj", None), (3, 0.0, 0.0, None, None, "cascavel"), (4, 0.0, 0.0, 900_000.0, "SP", None), (5, 0.0, 0.0, None, None, "gato")], "origin_id int, lat double, lng double, metres double, uf string, service string")
    assert rows(geojoin.radius_join(ori, fac, 50_000), "origin_id", "id") == [(1, 1), (2, 2), (3, 2), (4, 1), (4, 3)]
    geojoin.register_table_function(fac)
    assert rows(spark.sql("SELECT id FROM facilities_near(0D, 0D, 150000D, NULL, 'Crotálico')")) == [(2,), (3,)]


def test_city_fallback_by_part_of_a_name(spark):
    fac = spark.createDataFrame([(1, "SP", "São Paulo", "A", None, None, "Botrópico", None, None), (2, "SP", "Itu", "B", None, None, "Crotálico", None, None), (3, "RJ", "Paulo", "C", None, None, "", None, None)], FAC)
    asked = spark.createDataFrame([(1, None, "paulo", None, None), (2, None, "TU", "sp", None), (3, None, "", None, "cascavel"), (4, None, "sao paulo x", None, None), (5, 1.0, "paulo", None, None)], "request_id int, lat double, city string, uf string, service string")
    assert rows(search.city_fallback(asked, fac), "request_id", "id", "rank") == [(1, 1, 2), (1, 3, 1), (2, 2, 1), (3, 2, 1)]


def test_memo_asks_once(spark):
    asked = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b")], "id int, query_key string")
    reads = spark.sparkContext.accumulator(0)

    def answer(frames):
        for f in frames:
            reads.add(len(f))
            yield f.assign(lat=1.0, lng=2.0)

    resolver = asked.select("query_key").distinct().mapInPandas(answer, "query_key string, lat double, lng double")
    got = lookup.memoised(asked, resolver)
    assert rows(got, "id", "query_key", "lat", "lookups") == [(1, "a", 1.0, 1), (2, "a", 1.0, 1), (3, "b", 1.0, 1)]
    assert reads.value == 2
    cache = spark.createDataFrame([("a", 5, "2024-01-01"), ("b", 1, "2024-03-01")], "query_key string, hit_count long, ultimo_hit string")
    uses = spark.createDataFrame([("a", "2024-02-01", "hit"), ("a", "2024-02-03", "hit"), ("b", "2024-02-01", "hit"), ("b", "2024-05-01", "miss")], "query_key string, ts string, state string")
    assert rows(lookup.count_usage(cache, uses)) == [("a", 7, "2024-02-03"), ("b", 2, "2024-03-01")]


def test_updated_at_through_tags_and_space(spark):
    html = ["<p>Atualizado em 10/02/2026 18h04</p>", "Atualizado <b>em</b> 10/02/2026 18h04", "ATUALIZADO\n em\xa010/02/2026<br>8h04.", "atualizado em 99/02/2026 18h04", "nada", None]
    got = spark.createDataFrame(list(enumerate(html)), "i int, h string").orderBy("i").select(F.date_format(pages.updated_at(F.col("h")), "dd HH:mm")).collect()
    assert [r[0] for r in got] == ["10 21:04", "10 21:04", "10 11:04", None, None, None]


def test_more_than_a_million_edges(spark):
    one = spark.range(1).select(layout.below(F.transform(F.sequence(F.lit(0), F.lit(2**20 + 5)), lambda x: x.cast("double")), F.lit(1048579.5))).first()
    assert one[0] == 1048580


def test_radius_join_is_the_brute_force(spark):
    fac = spark.range(400).select(F.col("id").cast("int").alias("id"), (F.rand(1) * 4 - 89.9).alias("lat"), (F.rand(2) * 360 - 180).alias("lng"))  # around a pole, over the date line
    ori = spark.range(20).select(F.col("id").alias("origin_id"), (F.rand(3) * 4 - 89.9).alias("lat"), (F.rand(4) * 360 - 180).alias("lng"))
    fac, ori = spark.createDataFrame(fac.collect(), fac.schema), spark.createDataFrame(ori.collect(), ori.schema)
    from waymark.functions.geo import distance

    every = ori.crossJoin(fac.withColumnsRenamed({"lat": "la", "lng": "lo"})).where(distance(F.col("lat"), F.col("lng"), F.col("la"), F.col("lo")) <= 100_000)
    assert rows(geojoin.radius_join(ori, fac, 100_000), "origin_id", "id") == rows(every, "origin_id", "id")
    nearest = geojoin.radius_join(ori, fac, 100_000, 2)
    assert nearest.groupBy("origin_id").count().agg(F.max("count")).first()[0] <= 2


def test_an_origin_meets_what_its_reach_holds(spark):
    """Facilities evenly over a square of 400 km: what an origin meets goes with its own reach, beside origins that look very far."""
    fac = spark.sql("SELECT id AS id, (id % 300 - 150) * 1.8 / 150 AS lat, (id DIV 300 - 150) * 1.8 / 150 AS lng, 'SP' AS uf, '' AS atendimentos_raw FROM range(90000)")
    ori = spark.createDataFrame([(1, 0.003, 0.002, 2_000.0), (2, 0.1, -0.2, 5_000.0), (3, -0.7, 0.4, 30_000.0), (4, 0.0, 0.0, 199_000.0), (5, 0.0, 0.0, -1.0), (6, 0.5, 0.5, None), (7, 89.9999, 10.0, 50_000.0), (8, 0.0, 179.9999, 400.0)], "origin_id int, lat double, lng double, metres double")
    extra = spark.createDataFrame([(90_001, 89.9999, -170.0, "SP", ""), (90_002, 0.0, -179.9999, "SP", ""), (90_003, 0.0, 0.0, "SP", "")], "id long, lat double, lng double, uf string, atendimentos_raw string")
    fac = fac.unionByName(extra)
    every = ori.join(fac.withColumnsRenamed({"lat": "la", "lng": "ln"}), F.lit(True)).where(geo.distance(F.col("lat"), F.col("lng"), F.col("la"), F.col("ln")) <= F.least(F.coalesce("metres", F.lit(10_000.0)), F.lit(200_000.0)))
    want = {r["origin_id"]: (r["n"], r["s"]) for r in every.groupBy("origin_id").agg(F.count("*").alias("n"), F.sum("id").alias("s")).collect()}
    got = geojoin.radius_join(ori, fac, 10_000).groupBy("origin_id").agg(F.count("*").alias("n"), F.sum("id").alias("s")).collect()
    assert {r["origin_id"]: (r["n"], r["s"]) for r in got} == want and {7, 8} <= set(want) and 5 not in want
    met = {r["origin_id"]: r["count"] for r in geojoin.candidates(ori, fac, 10_000).groupBy("origin_id").count().collect()}
    assert all(met[i] <= 12 * want[i][0] + 40 for i in want)


def test_equator_is_a_place(spark):
    fac = spark.createDataFrame([(1, "AP", "M", "U", None, None, "", 0.0, 0.0), (2, "AP", "M", "U", None, None, "", None, 0.0)], FAC)
    assert rows(geojoin.radius_search(fac, 0.0, 0.0), "id") == [(1,)]


def test_search_needs_a_condition(spark):
    fac = spark.createDataFrame([(1, "SP", "São Paulo", "Santa 100%", "Rua", None, "Botrópico", None, None)], FAC)
    with pytest.raises(ValueError):
        search.directory(fac)
    assert rows(search.directory(fac, city="SAO"), "id") == [(1,)]
    assert rows(search.directory(fac, text="100%"), "id") == [(1,)]
    assert rows(search.directory(fac, text="100_"), "id") == []


def test_edges_are_anchored(spark):
    got = spark.createDataFrame([([9.5, 1.0, 4.5, 3.0, 9.0],)], "e array<double>").select(layout.merge_close(F.col("e"))).first()[0]
    assert got == [1.0, 4.5, 9.0]


def test_bands_hold_both_ends(spark):
    edges = [0.0, 1.0, 4.5, 9.0, 20.0]
    values = [-1.0, 0.0, 0.5, 1.0, 4.5, 8.0, 20.0, 20.5]
    got = spark.createDataFrame([(i, edges, v) for i, v in enumerate(values)], "i int, e array<double>, v double").orderBy("i")
    assert [r[0] for r in got.select(layout.band_of(F.col("e"), F.col("v"))).collect()] == [None, 0, 0, 0, 1, 2, 3, None]
    assert [r[0] for r in got.select(layout.below(F.col("e"), F.col("v"), True)).collect()] == [0, 1, 1, 2, 3, 3, 5, 5]
    assert spark.range(1).select(layout.below(F.array().cast("array<double>"), F.lit(1.0))).first()[0] == 0


def test_anchored_records(spark):
    words = [("Bauru", 0, 0), ("Hospital", 100, 0), ("Geral", 160, 0), ("Rua", 220, 0), ("A", 250, 0), ("(14)", 300, 0), ("1234567", 360, 0), ("Crotálico", 420, 0), ("Bom", 0, 40), ("Jesus", 52, 41), ("UPA", 100, 40), ("Lins", 0, 80), ("Santa", 100, 80), ("9", 220, 80)]
    boxes = spark.createDataFrame([(1, 0, i, t, float(x), float(x + 40), float(y), float(y + 10)) for i, (t, x, y) in enumerate(words)], "doc_id int, page int, pos int, text string, x0 double, x1 double, top double, bottom double")
    got = rows(layout.anchored_records(boxes), "anchor", *layout.FIELDS)
    assert got[0] == (0, "Bauru", "Hospital Geral", "Rua A", "(14)", "1234567", "Crotálico")
    assert got[2] == (2, "Lins", "Santa", "9", None, None, None)
    assert got[1][1].startswith("Bom")


def test_cell_lines(spark):
    words = spark.createDataFrame([([(10.0, 50.0, "b"), (11.0, 10.0, "a"), (20.0, 5.0, "c")],)], "w array<struct<top:double,x0:double,text:string>>")
    assert words.select(layout.joined_text(F.col("w"))).first()[0] == "a b c"


def test_continued_rows(spark):
    parts = spark.createDataFrame([(1, 0, 0, None, "x"), (1, 0, 1, "A", "u"), (1, 0, 2, "", "v"), (1, 0, 3, "B", None)], "doc_id int, page int, line int, municipio string, unidade string")
    assert rows(layout.continued(parts).orderBy("line"), "line", "municipio", "unidade") == [(0, None, "x"), (1, "A", "u v"), (3, "B", None)]


def test_lookups(spark):
    fac = spark.createDataFrame([(1, "SP", "A", "U", "Rua X, 10", None, "", None, None), (2, "SP", "B", "U", None, None, "", None, None)], FAC)
    asked = lookup.candidates(fac)
    assert rows(asked.where("id = 2"), "pos", "query_key") == [(2, "B, SP, Brasil")]
    cache = spark.createDataFrame([("Rua X, 10, A, SP, Brasil", None, None, "g"), ("A, SP, Brasil", 1.0, 2.0, "g")], "query_key string, lat double, lng double, fonte string")
    assert rows(lookup.resolve(fac, cache), "id", "lat", "pos") == [(1, 1.0, 2), (2, None, None)]
    assert rows(lookup.work_list(asked, cache)) == [("B, SP, Brasil",), ("Rua X, A, SP, Brasil",)]


def test_rate_limit(spark):
    log = spark.createDataFrame([(i, "a", f"2024-01-01 00:00:{i:02d}") for i in range(20)] + [(99, None, "2024-01-01 00:00:01")], "id int, ip string, t string").select("id", "ip", F.to_timestamp("t").alias("criado_em"))
    got = metrics.allowed(log)
    assert got.where("allowed").count() == 16
    assert got.where("id = 0").first()["remaining"] == 14


def test_stream_limit_counts_over_batches(spark, tmp_path):
    for i in range(2):
        spark.createDataFrame([(i * 10 + j, "a", f"2024-01-01 00:00:{i * 10 + j:02d}") for j in range(10)], "id long, ip string, t string").select("id", "ip", F.to_timestamp("t").alias("criado_em")).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("id long, ip string, criado_em timestamp").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    out = str(tmp_path / "out")
    streams.limit_requests(stream).writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination()
    got = spark.read.parquet(out)
    assert got.count() == 20 and got.where("allowed").count() == 15
    assert sorted(r.n for r in got.collect()) == list(range(1, 21))


def test_empty_tables(spark):
    empty = spark.createDataFrame([], FAC)
    assert metrics.service_grid(empty, F.array().cast("array<string>")).count() == 0
    assert lookup.candidates(empty).count() == 0
    assert merge.merge(empty, empty.withColumn("seq", F.col("id")).drop("id", "lat", "lng")).count() == 0
