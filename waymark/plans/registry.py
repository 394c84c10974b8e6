"""The queries over the given tables, each with SQL that DuckDB can run on them."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from waymark.functions import geo, logs, text
from waymark.operators import geojoin, index, layout, lookup, merge, metrics, pages, resolver, search, stored, tables
from waymark.sources.derived import load, with_tables
from waymark.streaming import streams

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def now_of(log: DataFrame):
    """The log's last time, as a literal."""
    return F.lit(log.agg(F.max("criado_em")).first()[0])


# 2.1 sources and writes


@query(with_tables("fac") + "SELECT id, municipio, unidade FROM fac WHERE uf = 'SP'")
def o01_filtered_scan(spark, d):
    return tables.scan(load(spark, d, "fac"), ["id", "municipio", "unidade"], uf="SP")


NEW_ROWS = "SELECT id, uf, municipio, concat('novo ', unidade) AS unidade, id AS seq FROM {fac} WHERE id % 3 = 0 UNION ALL SELECT id, uf, municipio, concat('outro ', unidade), id + 1 FROM {fac} WHERE id % 6 = 0"
STORED = "SELECT id, uf, municipio, unidade FROM {fac} WHERE id % 2 = 0"


def _new_and_stored(spark, d):
    fac = load(spark, d, "fac")
    return spark.sql(NEW_ROWS, fac=fac), spark.sql(STORED, fac=fac)


def _plain(sql: str) -> str:
    return sql.replace("{fac}", "fac")


@query(
    with_tables("fac", more=f"n AS ({_plain(NEW_ROWS)}), s AS ({_plain(STORED)})")
    + "SELECT id, uf, municipio, unidade FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY new DESC, seq DESC) AS r FROM (SELECT *, 0 AS new, 0 AS seq FROM s UNION ALL SELECT id, uf, municipio, unidade, 1, seq FROM n) u) x WHERE r = 1"
)
def o02_upsert(spark, d):
    new, stored = _new_and_stored(spark, d)
    return tables.upsert(stored, new, ["id"], [F.col("seq")])


@query(
    with_tables("fac", more=f"n AS ({_plain(NEW_ROWS)}), s AS ({_plain(STORED)})")
    + "SELECT * FROM s UNION ALL SELECT id, uf, municipio, unidade FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY seq) AS r FROM n) x WHERE r = 1 AND id NOT IN (SELECT id FROM s)"
)
def o03_insert_missing(spark, d):
    new, stored = _new_and_stored(spark, d)
    return tables.insert_missing(stored, new, ["id"], [F.col("seq")])


@query(with_tables("fac", more=f"n AS ({_plain(NEW_ROWS)}), s AS ({_plain(STORED)})") + "SELECT * FROM s WHERE id NOT IN (SELECT id FROM n)")
def o04_keyed_delete(spark, d):
    new, stored = _new_and_stored(spark, d)
    return tables.delete(stored, new, ["id"])


@query(with_tables("fac", more=f"s AS ({_plain(STORED)})") + "SELECT id, uf, municipio, CASE WHEN id % 3 = 0 THEN concat('novo ', unidade) ELSE unidade END AS unidade FROM s")
def o05_keyed_update(spark, d):
    new, stored = _new_and_stored(spark, d)
    return tables.update(stored, new.where(F.col("unidade").startswith("novo ")), ["id"], ["unidade"])


@query(with_tables("fac") + "SELECT uf, count(*) AS n, min(id) AS first, max(id) AS last FROM fac GROUP BY uf")
def o06_partitioned_sink(spark, d):
    path = _scratch(spark, "sink")
    fac = load(spark, d, "fac")
    tables.write_partitions(fac, path, "uf")
    tables.write_partitions(fac.where("uf = 'SP'"), path, "uf")
    return spark.read.parquet(path).groupBy("uf").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first"), F.max("id").alias("last"))


def _scratch(spark, name: str) -> str:
    """A new folder where executors and driver both write: under the checkpoint folder, else the warehouse."""
    import uuid

    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.sql.warehouse.dir")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def _event_stream(spark, d):
    """The events table as a stream of log rows."""
    events = f"{d}/events.parquet"
    return spark.readStream.schema(spark.read.parquet(events).schema).parquet(_stream_dir(spark, events))


def _stream_dir(spark, path: str) -> str:
    """A folder of the table's rows (a stream reads folders; a table may be one file)."""
    out = _scratch(spark, "stream")
    spark.read.parquet(path).write.parquet(out)
    return out


STATUS = "CASE WHEN k < 70 THEN 200 WHEN k < 80 THEN 404 WHEN k < 88 THEN 429 WHEN k < 95 THEN 400 ELSE 500 END"


def _req_stream(spark, d):
    events = _event_stream(spark, d)
    rows = events.select(F.col("event_id").alias("id"), F.col("ts").cast("timestamp").alias("criado_em"), "event_type", F.concat(F.lit("10.0.0."), F.col("user_id").cast("string")).alias("ip"), F.regexp_extract("props", "([0-9]+)", 1).cast("int").alias("k"))
    return rows.withColumn("status", F.expr(STATUS))


def _raw_log(rows: DataFrame) -> DataFrame:
    i = F.col("id")
    return rows.select(
        "criado_em",
        F.when(i % 4 == 0, F.concat(F.lit("/v1/hospitais/"), i.cast("string"))).when(i % 4 == 1, "/v1/estados/sp").when(i % 4 == 2, F.concat(F.lit("/v1/hospitais?uf="), i.cast("string"))).otherwise("/v1/estados").alias("path"),
        F.when(i % 5 == 0, None).otherwise(F.lit("GET")).alias("method"),
        "status",
        F.when(i % 7 == 0, "unknown").otherwise(F.col("ip")).alias("ip"),
        F.when(i % 3 == 0, "").otherwise(F.repeat(F.lit("ua"), 200)).alias("user_agent"),
        F.when(i % 2 == 0, F.repeat(F.lit("e"), 600)).alias("message"),
        F.when(i % 3 == 1, "true").when(i % 3 == 2, "false").otherwise("x").alias("cache_hit"),
        F.when(i % 9 == 0, None).otherwise(i % 10 == 0).alias("rate_limited"),
    )


RAW_LOG_SQL = """raw AS (SELECT criado_em, CASE WHEN id % 4 = 0 THEN '/v1/hospitais/:id' WHEN id % 4 = 1 THEN '/v1/estados/:uf' WHEN id % 4 = 2 THEN '/v1/hospitais' ELSE '/v1/estados' END AS rota,
  'GET' AS metodo, status, CASE WHEN id % 7 <> 0 THEN substr(sha256(concat('salt', ip)), 1, 16) END AS ip_hash, CASE WHEN id % 3 <> 0 THEN repeat('ua', 128) END AS user_agent,
  CASE WHEN id % 2 = 0 THEN repeat('e', 500) END AS erro_msg, CASE WHEN id % 3 = 1 THEN true WHEN id % 3 = 2 THEN false END AS cache_hit, coalesce(CASE WHEN id % 9 = 0 THEN NULL ELSE id % 10 = 0 END, false) AS rate_limited FROM req)"""


@query(with_tables("req", more=RAW_LOG_SQL) + "SELECT strftime(criado_em, '%Y-%m-%d') AS dia, count(*) AS n, count(ip_hash) AS known, count_if(rate_limited) AS limited FROM raw GROUP BY 1")
def o07_log_sink(spark, d):
    path = _scratch(spark, "log")
    streams.append(streams.shape(_raw_log(_req_stream(spark, d)), "salt"), path, _scratch(spark, "log-state")).awaitTermination()
    return spark.read.parquet(path).groupBy(F.date_format("dia", "yyyy-MM-dd").alias("dia")).agg(F.count(F.lit(1)).alias("n"), F.count("ip_hash").alias("known"), F.count_if("rate_limited").alias("limited"))


@query(
    with_tables("fac", more="s AS (SELECT unnest(['" + "','".join(tables.STATES) + "']) AS uf, unnest(['" + "','".join(tables.STATES.values()) + "']) AS nome)")
    + "SELECT s.uf, nome, count(id) AS units FROM s LEFT JOIN fac USING (uf) GROUP BY s.uf, nome"
)
def o08_state_seed(spark, d):
    units = load(spark, d, "fac").groupBy("uf").agg(F.count(F.lit(1)).alias("units"))
    return tables.state_seed(spark).join(units, "uf", "left").select("uf", "nome", F.coalesce("units", F.lit(0)).alias("units"))


# 2.2 pages


@query(
    with_tables("pg", more=r"t AS (SELECT page_id, lower(regexp_replace(regexp_replace(html, '<[^>]*>', ' ', 'g'), '\s+', ' ', 'g')) AS x FROM pg), u AS (SELECT page_id, strpos(x, 'atualizado em ') AS p, x FROM t), v AS (SELECT page_id, p, substr(x, p + 14, 10) AS d, split_part(substr(x, p + 25, 5), 'h', 1) AS h, substr(split_part(substr(x, p + 25, 5), 'h', 2), 1, 2) AS m FROM u)")
    + "SELECT page_id, CASE WHEN p > 0 THEN try_strptime(concat(d, ' ', lpad(h, 2, '0'), ':', m), '%d/%m/%Y %H:%M') + INTERVAL 3 HOURS END AS updated FROM v"
)
def o09_updated_at(spark, d):
    return load(spark, d, "pg").select("page_id", pages.updated_at(F.col("html")).alias("updated"))


LINKS = r"""l AS (SELECT page_id, url, html, regexp_extract_all(html, 'href="([^"]*)"', 1) AS h FROM pg),
k AS (SELECT page_id, url, html, coalesce(list_filter(h, lambda x: regexp_matches(x, '(?i)(\.pdf|/@@download/file)$'))[1], list_filter(h, lambda x: regexp_matches(x, '(?i)\.xlsx$'))[-1]) AS link FROM l)"""


@query(with_tables("pg", more=LINKS) + "SELECT page_id, link FROM k")
def o10_document_link(spark, d):
    return load(spark, d, "pg").select("page_id", pages.document_link(F.col("html")).alias("link"))


@query(
    with_tables("pg", more=LINKS)
    + r"""SELECT page_id, CASE WHEN regexp_matches(link, '^[a-zA-Z][a-zA-Z0-9+.-]*://') THEN link WHEN starts_with(link, '/') THEN regexp_extract(url, '^([a-zA-Z]+://[^/?#]*)', 1) || link
    WHEN link IS NOT NULL THEN regexp_replace(regexp_replace(url, '[?#].*$', ''), '[^/]*$', '') || link END AS address FROM k"""
)
def o11_resolve_link(spark, d):
    return load(spark, d, "pg").select("page_id", pages.resolve(F.col("url"), pages.document_link(F.col("html"))).alias("address"))


@query(
    with_tables("pg", more=LINKS)
    + r"SELECT page_id, CASE WHEN page_id % 9 = 0 THEN 'direct' WHEN regexp_matches(link, '(?i)\.xlsx$') THEN 'unsupported' WHEN link IS NOT NULL THEN 'link' ELSE 'error' END AS route FROM k"
)
def o12_route_format(spark, d):
    kind = F.when(F.col("page_id") % 9 == 0, "application/PDF").otherwise("text/html")
    return load(spark, d, "pg").select("page_id", pages.route_format(kind, pages.document_link(F.col("html"))).alias("route"))


@query(with_tables("pg") + "SELECT page_id, sha256(html) AS hash FROM pg")
def o13_fingerprint(spark, d):
    return load(spark, d, "pg").select("page_id", pages.fingerprint(F.encode("html", "UTF-8")).alias("hash"))


@query(
    with_tables("pg", more="n AS (SELECT page_id, sha256(html) AS hash, TIMESTAMP '2026-02-10 00:00:00' + CAST(page_id % 5 AS INT) * INTERVAL 1 DAY AS site_ts FROM pg), b AS (SELECT page_id, CASE WHEN page_id % 2 = 0 THEN hash ELSE 'x' END AS hash, CASE WHEN page_id % 5 = 0 THEN NULL ELSE TIMESTAMP '2026-02-12 00:00:00' END AS site_ts FROM n)")
    + "SELECT page_id, (b.site_ts IS NULL OR n.site_ts > b.site_ts OR n.hash IS DISTINCT FROM b.hash) AS changed FROM n JOIN b USING (page_id)"
)
def o14_change_detection(spark, d):
    site = F.to_timestamp(F.lit("2026-02-10 00:00:00")) + F.make_dt_interval((F.col("page_id") % 5).cast("int"))
    now = load(spark, d, "pg").select("page_id", F.sha2("html", 256).alias("hash"), site.alias("site_ts"))
    before = now.select("page_id", F.when(F.col("page_id") % 2 == 0, F.col("hash")).otherwise("x").alias("hash"), F.when(F.col("page_id") % 5 != 0, F.to_timestamp(F.lit("2026-02-12 00:00:00"))).alias("site_ts"))
    return pages.changed(now, before, "page_id").select("page_id", "changed")


@query(
    "WITH p AS (SELECT doc_id, text, unnest(range(CAST(doc_id % 3 + 1 AS BIGINT))) AS page FROM documents) SELECT doc_id, bool_and(doc_id % 4 = 0 AND len(text) % 2 = 0) AS scanned FROM p GROUP BY doc_id"
)
def o15_scanned(spark, d):
    docs = load(spark, d, "documents").select("doc_id", "text", F.explode(F.sequence(F.lit(0), F.col("doc_id") % 3)).alias("page"))
    words = F.when((F.col("doc_id") % 4 == 0) & (F.length("text") % 2 == 0), 0).otherwise(1)
    return pages.scanned(docs.select("doc_id", words.alias("n_words"), F.lit(1).alias("n_images")))


# 2.3 layout

EDGES = """e AS (SELECT DISTINCT doc_id, page, 'h' AS axis, round(top, 1) AS edge FROM shapes WHERE abs(height) < 2 AND width > 30
  UNION SELECT DISTINCT doc_id, page, 'v', round(x0, 1) FROM shapes WHERE abs(width) < 2 AND height > 10),
m AS (SELECT doc_id, page, axis, list_reduce(list_prepend(CAST([] AS DOUBLE[]), list_transform(list_sort(list(edge)), lambda x: [x])), lambda a, b: CASE WHEN len(a) = 0 OR b[1] - a[-1] > 3.0 THEN list_concat(a, b) ELSE a END) AS edges FROM e GROUP BY ALL),
pe AS (SELECT doc_id, page, coalesce(max(edges) FILTER (axis = 'h'), []) AS h, coalesce(max(edges) FILTER (axis = 'v'), []) AS v FROM m GROUP BY ALL),
gp AS (SELECT * FROM pe WHERE len(v) >= 7 AND len(h) >= 2)"""
CUT = """hd AS (SELECT doc_id, page, coalesce(max(bottom) FILTER (trim(upper(strip_accents(text))) IN ('MUNICIPIO', 'ENDERECO', 'TELEFONES', 'CNES')), 0) AS head FROM words GROUP BY ALL),
ct AS (SELECT doc_id, page, head, list_filter(h, lambda x: x > head) AS h, v FROM gp JOIN hd USING (doc_id, page)),
cg AS (SELECT * FROM ct WHERE len(h) >= 2), bw AS (SELECT words.* FROM words JOIN cg USING (doc_id, page) WHERE top > head + 1)"""
PLACED = """pl AS (SELECT bw.*, list_min(list_filter(range(1, len(h)), lambda i: h[i] <= (top + bottom) / 2 AND (top + bottom) / 2 <= h[i + 1])) - 1 AS row,
  list_min(list_filter(range(1, len(v)), lambda i: v[i] <= (x0 + x1) / 2 AND (x0 + x1) / 2 <= v[i + 1])) - 1 AS col FROM bw JOIN cg USING (doc_id, page)),
pw AS (SELECT * FROM pl WHERE row IS NOT NULL AND col IS NOT NULL)"""
CELLS = "c AS (SELECT doc_id, page, row, col, string_agg(text, ' ' ORDER BY top, x0, text) AS text FROM pw GROUP BY ALL)"


@query(with_tables("words", "shapes", more=EDGES) + "SELECT doc_id, page, axis, edge FROM e")
def o16_ruling_edges(spark, d):
    return layout.ruling_edges(load(spark, d, "shapes"))


@query(with_tables("words", "shapes", more=EDGES) + "SELECT doc_id, page, axis, edges FROM m")
def o17_edge_merge(spark, d):
    e = layout.page_edges(load(spark, d, "shapes"))
    both = F.explode(F.array(F.struct(F.lit("h").alias("axis"), F.col("h").alias("edges")), F.struct(F.lit("v").alias("axis"), F.col("v").alias("edges")))).alias("x")
    return e.select("doc_id", "page", both).select("doc_id", "page", "x.*").where(F.size("edges") > 0)


@query(with_tables("words", "shapes", more=EDGES) + "SELECT doc_id, page, len(h) AS h, len(v) AS v FROM gp")
def o18_page_gate(spark, d):
    return layout.gate(layout.page_edges(load(spark, d, "shapes"))).select("doc_id", "page", F.size("h").alias("h"), F.size("v").alias("v"))


def _cut(spark, d):
    return layout.cut_edges(load(spark, d, "words"), layout.gate(layout.page_edges(load(spark, d, "shapes"))))


@query(with_tables("words", "shapes", more=f"{EDGES}, {CUT}") + "SELECT doc_id, page, count(*) AS words, any_value(len(h)) AS edges FROM bw JOIN cg USING (doc_id, page) GROUP BY ALL")
def o19_head_cut(spark, d):
    return layout.below_head(load(spark, d, "words"), _cut(spark, d)).groupBy("doc_id", "page").agg(F.count(F.lit(1)).alias("words"), F.first(F.size("h")).alias("edges"))


@query(
    with_tables("words", "shapes", more=f"{EDGES}, b AS (SELECT doc_id, page, axis, edges, unnest(range(1, len(edges))) AS i FROM m)")
    + "SELECT doc_id, page, axis, i - 1 AS band, edges[i] AS low, edges[i + 1] AS high FROM b"
)
def o20_bands(spark, d):
    return layout.bands(layout.page_edges(load(spark, d, "shapes")))


def _banded(spark, d):
    return layout.band_cells(load(spark, d, "words"), _cut(spark, d))


@query(with_tables("words", "shapes", more=f"{EDGES}, {CUT}, {PLACED}") + "SELECT doc_id, page, row, col, count(*) AS words FROM pw GROUP BY ALL")
def o21_band_join(spark, d):
    return _banded(spark, d).select("doc_id", "page", "row", F.inline("cells")).select("doc_id", "page", "row", "col", F.size("texts").cast("long").alias("words"))


@query(with_tables("words", "shapes", more=f"{EDGES}, {CUT}, {PLACED}, {CELLS}") + "SELECT * FROM c")
def o22_cell_text(spark, d):
    return layout.cells(_banded(spark, d))


@query(
    with_tables("words", "shapes", more=f"{EDGES}, {CUT}, {PLACED}, {CELLS}, r AS (SELECT doc_id, page, row, {', '.join(f'max(text) FILTER (col = {i}) AS c{i}' for i in range(5))}, string_agg(text, ' ' ORDER BY col) FILTER (col >= 5) AS c5 FROM c GROUP BY ALL)")
    + "SELECT doc_id, page, row, c0 AS municipio, c1 AS unidade, c2 AS endereco, c3 AS telefones, c4 AS cnes, c5 AS atendimentos_raw FROM r WHERE coalesce(c0, '') <> '' AND upper(strip_accents(c0)) <> 'MUNICIPIO'"
)
def o23_records(spark, d):
    return layout.extract(load(spark, d, "words"), load(spark, d, "shapes"))


@query(
    with_tables("words")
    + "SELECT doc_id, avg(confidence) AS mean, CAST(round_even(avg(confidence), 0) AS INT) AS confidence FROM words WHERE trim(text) <> '' AND confidence >= 30 GROUP BY doc_id"
)
def o24_confidence(spark, d):
    return layout.confidences(layout.confident(load(spark, d, "words")))


@query(
    with_tables("words", more="g AS (SELECT *, CASE WHEN x0 - lag(x0) OVER (PARTITION BY doc_id, page ORDER BY x0) > 50 THEN 1 ELSE 0 END AS s FROM words), r AS (SELECT *, sum(s) OVER (PARTITION BY doc_id, page ORDER BY x0) AS run FROM g), c AS (SELECT doc_id, page, run, min(x0) AS a, max(x0) AS b, count(*) AS n FROM r GROUP BY ALL)")
    + 'SELECT doc_id, page, arg_min(a, run) - 5 AS "left", arg_min(b, run) + 50 AS "right" FROM c WHERE n >= 3 GROUP BY ALL'
)
def o25_left_column(spark, d):
    return layout.left_column(load(spark, d, "words"))


@query(
    with_tables("words", more="u AS (SELECT doc_id, page, list_sort(list(x0)) AS xs FROM words WHERE regexp_matches(lower(text), '^(hospital|unidade|upa|samu|hc|posto|santa|the|de|en)') GROUP BY ALL)")
    + "SELECT doc_id, page, xs[len(xs) // 2 + 1] AS x FROM u"
)
def o26_unit_start(spark, d):
    words = load(spark, d, "words")
    named = words.withColumn("text", F.when(F.lower("text").rlike("^(the|de|en)"), F.concat(F.lit("unidade "), F.col("text"))).otherwise(F.col("text")))
    return layout.unit_start(named)


#: The boxes' lines are 14 apart, 10 high and 60 wide, so each line is a row of its own, and the left column is its first word on pages of three lines or more.
ANCHORS = f"""np AS (SELECT doc_id, page, count(*) FILTER (x0 = 0) AS n FROM words GROUP BY ALL),
an AS (SELECT w.doc_id AS doc_id, w.page AS page, row_number() OVER (PARTITION BY w.doc_id, w.page ORDER BY top) - 1 AS anchor, 10.0::DOUBLE AS height, -5.0::DOUBLE AS "left", 50.0::DOUBLE AS "right", top AS y_top, bottom AS y_bottom, text
  FROM words w JOIN np ON w.doc_id = np.doc_id AND w.page = np.page WHERE n >= 3 AND x0 = 0 AND lower(text) <> upper(text)
  AND NOT list_contains({layout.HEAD_WORDS}, trim(upper(strip_accents(text)), ',:.')) AND NOT list_contains({layout.FOOT_WORDS}, trim(upper(strip_accents(text)), ',:./')))"""


@query(with_tables("words", more=ANCHORS) + "SELECT * FROM an")
def o27_anchor_rows(spark, d):
    return layout.anchors(load(spark, d, "words"))


TOKEN_SHAPES = [f"{'9' * a}{sep}{'9' * b}{end}" for a in (3, 4, 5) for sep in "-/" for b in (3, 4, 5) for end in ("", "/999", "/9999")]
#: By the shape of a token, each digit a 9: whole numbers with an area code stand in one token only without a space.
TOKEN_SQL = f"""CASE WHEN t = '' THEN NULL WHEN (s LIKE '(%' AND contains(s, '9')) OR list_contains({TOKEN_SHAPES}, s)
  OR regexp_matches(s, '\\(99\\)\\s*(999-?999|999/999|9999-?999|9999/999|99999-?999|99999/999|999999)') THEN 'telefone'
  WHEN s = '9999999' THEN 'cnes' WHEN trim(lower(strip_accents(t)), ',.') IN ('botropico','crotalico','elapidico','laquetico','escorpionico','loxoscelico','foneutrico','lonomico') THEN 'atendimento' END"""
TOKENS = f"tk AS (SELECT *, trim(text, ' ,.|') AS t, regexp_replace(trim(text, ' ,.|'), '[0-9]', '9', 'g') AS s FROM words), kd AS (SELECT *, {TOKEN_SQL} AS kind FROM tk)"


def _joined(rule: str, order: str = "y, x0, pos", sep: str = " ") -> str:
    return f"nullif(trim(regexp_replace(coalesce(string_agg(text, '{sep}' ORDER BY {order}) FILTER ({rule}), ''), '\\s+', ' ', 'g')), '')"


ANCHORED = f"""{ANCHORS}, {TOKENS},
us AS (SELECT doc_id, page, list_sort(list(x0)) AS xs FROM words WHERE regexp_matches(lower(text), '{layout.UNIT_STARTS}') GROUP BY ALL),
lo AS (SELECT an.*, y_top - 2.5 AS low, coalesce(lead(y_top - 2.5) OVER (PARTITION BY doc_id, page ORDER BY anchor), 'Infinity'::DOUBLE) AS high FROM an),
ow AS (SELECT lo.doc_id, lo.page, anchor, lo.text AS city, y_top, y_bottom, coalesce(xs[len(xs) // 2 + 1], 350) AS lim, kd.text AS text, kind, x0, pos, (top + bottom) / 2 AS y
  FROM lo JOIN kd ON kd.doc_id = lo.doc_id AND kd.page = lo.page AND (kd.top + kd.bottom) / 2 >= low AND (kd.top + kd.bottom) / 2 < high LEFT JOIN us ON us.doc_id = lo.doc_id AND us.page = lo.page
  WHERE NOT list_contains({layout.HEAD_WORDS}, trim(upper(strip_accents(kd.text)), ',:.'))),
fr AS (SELECT *, x0 BETWEEN -5 AND 50 AS inl, NOT (x0 BETWEEN -5 AND 50) AND kind IS NULL AS free FROM ow),
ad AS (SELECT *, coalesce(max(CASE WHEN free AND (regexp_matches(text, '[0-9]') OR list_contains({layout.STREET_WORDS}, trim(lower(strip_accents(text)), ',.'))) THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, page, anchor ORDER BY y, x0, pos), 0) = 1 AS addr FROM fr),
rc AS (SELECT doc_id, page, anchor, city, {_joined("abs(y - (y_top + y_bottom) / 2) <= 12 AND x0 > 50 AND x0 < lim AND lower(text) <> upper(text) AND kind IS NULL", "x0, pos")} AS more,
  {_joined("free AND NOT addr")} AS unidade, {_joined("free AND addr")} AS endereco, {_joined("NOT inl AND kind = 'telefone'")} AS telefones,
  arg_min(trim(text, ' |,'), y * 1000000 + x0) FILTER (NOT inl AND kind = 'cnes') AS cnes, {_joined("NOT inl AND kind = 'atendimento'", sep=", ")} AS atendimentos_raw FROM ad GROUP BY ALL),
rd AS (SELECT doc_id, page, anchor, trim(regexp_replace(concat_ws(' ', city, more), '\\s+', ' ', 'g')) AS municipio, unidade, endereco, telefones, cnes, atendimentos_raw FROM rc)"""


@query(with_tables("words", more=ANCHORED) + f"SELECT * FROM rd WHERE len(municipio) >= 3 AND NOT list_contains({layout.NOT_CITIES}, trim(lower(split_part(municipio, ' ', 1)), '.,'))")
def o28_anchored_records(spark, d):
    return layout.anchored_records(load(spark, d, "words"))


#: Lines 13, 13 and 1 apart: of every three, the last and the next one's first are one row.
UNEVEN_ANCHORS = f"""np AS (SELECT doc_id, page, count(*) FILTER (x0 = 0) AS n FROM uneven GROUP BY ALL),
fw AS (SELECT w.*, pos // 12 - pos // 36 AS g FROM uneven w JOIN np ON w.doc_id = np.doc_id AND w.page = np.page WHERE n >= 3 AND x0 = 0 AND lower(text) <> upper(text)
  AND NOT list_contains({layout.HEAD_WORDS}, trim(upper(strip_accents(text)), ',:.')) AND NOT list_contains({layout.FOOT_WORDS}, trim(upper(strip_accents(text)), ',:./'))),
an AS (SELECT doc_id, page, row_number() OVER (PARTITION BY doc_id, page ORDER BY g) - 1 AS anchor, 10.0::DOUBLE AS height, -5.0::DOUBLE AS "left", 50.0::DOUBLE AS "right", min(top) AS y_top, max(bottom) AS y_bottom, string_agg(text, ' ' ORDER BY top, x0, pos) AS text FROM fw GROUP BY doc_id, page, g)"""
UNEVEN_ANCHORED = ANCHORED.replace(ANCHORS, UNEVEN_ANCHORS).replace("FROM words", "FROM uneven")


@query(with_tables("uneven", more=UNEVEN_ANCHORS) + "SELECT * FROM an")
def o27_anchor_rows_uneven(spark, d):
    return layout.anchors(load(spark, d, "uneven"))


@query(with_tables("uneven", more=UNEVEN_ANCHORED) + f"SELECT * FROM rd WHERE len(municipio) >= 3 AND NOT list_contains({layout.NOT_CITIES}, trim(lower(split_part(municipio, ' ', 1)), '.,'))")
def o28_anchored_records_uneven(spark, d):
    return layout.anchored_records(load(spark, d, "uneven"))


@query(with_tables("uneven") + "SELECT doc_id, page, pos // 12 - pos // 36 AS line, pos FROM uneven")
def o28c_mean_lines_uneven(spark, d):
    return layout.mean_lines(load(spark, d, "uneven"))


@query(
    with_tables("words", more="""sp AS (SELECT doc_id, page, min(x0) AS a, max(x1) AS b FROM words GROUP BY ALL),
  wx AS (SELECT DISTINCT doc_id, page, a, floor(x0 - a) AS s, floor(x1 - a) + 1 AS e FROM words JOIN sp USING (doc_id, page)),
  sn AS (SELECT *, max(e) OVER (PARTITION BY doc_id, page ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS f FROM wx),
  gp AS (SELECT *, row_number() OVER (PARTITION BY doc_id, page ORDER BY s - f DESC, f) AS r FROM sn WHERE s - f >= 5),
  li AS (SELECT doc_id, page, a + (f + s) / 2 AS x FROM gp WHERE r < 6 UNION ALL SELECT doc_id, page, a FROM sp UNION ALL SELECT doc_id, page, b + 1 FROM sp)""")
    + "SELECT doc_id, page, row_number() OVER w - 1 AS band, x AS low, lead(x) OVER w AS high FROM li WINDOW w AS (PARTITION BY doc_id, page ORDER BY x) QUALIFY high IS NOT NULL"
)
def o28b_coverage_bands(spark, d):
    return layout.coverage_bands(load(spark, d, "words"), least=5)


@query(with_tables("words") + "SELECT doc_id, page, pos // 12 AS line, pos FROM words")
def o28c_mean_lines(spark, d):
    return layout.mean_lines(load(spark, d, "words"))


def _lined(spark, d):
    return load(spark, d, "words").withColumn("line", F.floor(F.col("pos") / 12).cast("int"))


@query(
    with_tables("words", more=f"""p AS (SELECT w.*, pos // 12 AS line, CASE WHEN (x0 + x1) / 2 <= 120 THEN 0 WHEN (x0 + x1) / 2 <= 240 THEN 1 WHEN (x0 + x1) / 2 <= 360 THEN 2 WHEN (x0 + x1) / 2 <= 480 THEN 3 WHEN (x0 + x1) / 2 <= 600 THEN 4 ELSE 5 END AS band FROM words w),
  r AS (SELECT doc_id, page, line, {', '.join(f"coalesce(trim(regexp_replace(string_agg(text, ' ' ORDER BY x0, pos) FILTER (band = {i}), '\\s+', ' ', 'g')), '') AS c{i}" for i in range(6))} FROM p GROUP BY ALL)""")
    + "SELECT doc_id, page, line, c0 AS municipio, nullif(c1, '') AS unidade, nullif(c2, '') AS endereco, nullif(c3, '') AS telefones, nullif(c4, '') AS cnes, nullif(c5, '') AS atendimentos_raw FROM r WHERE c0 <> '' AND c1 <> ''"
)
def o28d_line_records(spark, d):
    words = _lined(spark, d)
    six = F.explode(F.sequence(F.lit(0), F.lit(5))).alias("band")
    columns = words.select("doc_id", "page").distinct().select("doc_id", "page", six).withColumns({"low": F.col("band") * 120.0, "high": (F.col("band") + 1) * 120.0})
    return layout.line_records(words, columns)


PARTS = "SELECT doc_id, page, CAST(floor(pos / 3) AS INT) AS line, max(CASE WHEN pos % 3 = 0 AND pos % 6 = 0 THEN text END) AS municipio, max(CASE WHEN pos % 3 = 1 THEN text END) AS unidade, max(CASE WHEN pos % 3 = 2 THEN text END) AS endereco FROM {words} GROUP BY doc_id, page, floor(pos / 3)"


@query(
    with_tables("words", more=f"p AS ({PARTS.replace('{words}', 'words')}), g AS (SELECT *, count(nullif(municipio, '')) OVER w AS k, row_number() OVER w AS r FROM p WINDOW w AS (PARTITION BY doc_id, page ORDER BY line)), h AS (SELECT *, CASE WHEN k = 0 THEN -r ELSE k END AS q FROM g)")
    + "SELECT doc_id, page, min(line) AS line, nullif(string_agg(nullif(municipio, ''), ' ' ORDER BY line), '') AS municipio, string_agg(nullif(unidade, ''), ' ' ORDER BY line) AS unidade, string_agg(nullif(endereco, ''), ' ' ORDER BY line) AS endereco FROM h GROUP BY doc_id, page, q"
)
def o28e_continued_rows(spark, d):
    words = load(spark, d, "words").select("doc_id", "page", "pos", "text").repartition("doc_id")  # parts, runs and records of a page keep to this one shuffle
    return layout.continued(spark.sql(PARTS, words=words))


# 2.4 reconciliation

#: `i` and `c` are joined by key; same: the address didn't change.
MERGE = """c AS (SELECT *, coalesce(municipio,'') AS k1, coalesce(unidade,'') AS k2, coalesce(cnes,'') AS k3 FROM cur), i AS (SELECT *, coalesce(municipio,'') AS k1, coalesce(unidade,'') AS k2, coalesce(cnes,'') AS k3 FROM inc),
m AS (SELECT CASE WHEN c.id IS NULL THEN 'insert' WHEN i.seq IS NULL THEN 'delete' ELSE 'update' END AS op, c.id AS old_id, i.seq AS seq, c AS old, i AS new, c.id IS NOT NULL AND coalesce(c.endereco, '') = coalesce(i.endereco, '') AS same
  FROM c FULL OUTER JOIN i ON c.uf = i.uf AND c.k1 = i.k1 AND c.k2 = i.k2 AND c.k3 = i.k3),
mn AS (SELECT *, CASE WHEN op = 'insert' THEN (SELECT max(id) FROM cur) + row_number() OVER (PARTITION BY op ORDER BY seq) ELSE old_id END AS id FROM m)"""


def _merged(spark, d):
    return merge.merge(load(spark, d, "cur"), load(spark, d, "inc"))


@query(with_tables("fac", "cur", "inc", more=MERGE) + "SELECT op, id, seq, op = 'update' AND NOT same AS address_changed FROM mn")
def o29_snapshot_merge(spark, d):
    last = load(spark, d, "cur").agg(F.max("id")).first()[0] or 0
    return merge.number_inserts(_merged(spark, d), last + 1).select("op", "id", "seq", "address_changed")


@query(
    with_tables("fac", "cur", "inc", more=MERGE)
    + "SELECT old_id AS id, CASE WHEN same THEN old.lat END AS lat, CASE WHEN same THEN old.lng END AS lng, CASE WHEN same THEN old.geocode_status ELSE 'pendente' END AS geocode_status, new.telefones AS telefones, old.confianca_ocr AS confianca_ocr FROM m WHERE op = 'update'"
)
def o30_invalidation(spark, d):
    return _merged(spark, d).where("op = 'update'").select("id", "lat", "lng", "geocode_status", "telefones", "confianca_ocr")


DOUBLED = "SELECT * FROM {inc} UNION ALL SELECT seq + 1000000 AS seq, uf, municipio, unidade, concat(coalesce(endereco, ''), ' dup') AS endereco, cnes, atendimentos_raw, telefones, fonte_extracao FROM {inc} WHERE seq % 50 = 3"
STORED_TWICE = "SELECT * FROM {cur} UNION ALL SELECT CAST(id + 1000000 AS INT) AS id, uf, municipio, unidade, endereco, cnes, atendimentos_raw, lat, lng, fonte_extracao, geocode_status, telefones, confianca_ocr FROM {cur} WHERE id % 50 = 7"


@query(
    with_tables("fac", "cur", "inc", more=f"""i2 AS ({DOUBLED.replace('{inc}', 'inc')}), c2 AS ({STORED_TWICE.replace('{cur}', 'cur')}),
  ck AS (SELECT *, row_number() OVER (PARTITION BY uf, municipio, unidade, coalesce(cnes, '') ORDER BY id DESC) AS r FROM c2), ik AS (SELECT *, row_number() OVER (PARTITION BY uf, municipio, unidade, coalesce(cnes, '') ORDER BY seq DESC) AS r FROM i2),
  k AS (SELECT * FROM ck WHERE r = 1)""")
    + """SELECT 'update' AS op, k.id, ik.seq FROM k JOIN ik ON k.uf = ik.uf AND k.municipio = ik.municipio AND k.unidade = ik.unidade AND coalesce(k.cnes, '') = coalesce(ik.cnes, '') AND ik.r = 1
  UNION ALL SELECT 'delete', k.id, NULL FROM k LEFT JOIN ik ON k.uf = ik.uf AND k.municipio = ik.municipio AND k.unidade = ik.unidade AND coalesce(k.cnes, '') = coalesce(ik.cnes, '') WHERE ik.seq IS NULL
  UNION ALL SELECT 'delete', id, NULL FROM ck WHERE r > 1
  UNION ALL SELECT 'insert', NULL, ik.seq FROM ik LEFT JOIN k ON k.uf = ik.uf AND k.municipio = ik.municipio AND k.unidade = ik.unidade AND coalesce(k.cnes, '') = coalesce(ik.cnes, '') WHERE k.id IS NULL"""
)
def o31_duplicate_keys(spark, d):
    stored = spark.sql(STORED_TWICE, cur=load(spark, d, "cur"))
    return merge.merge(stored, spark.sql(DOUBLED, inc=load(spark, d, "inc"))).select("op", "id", "seq")


SOURCES = "SELECT uf, sha2(concat(uf, CAST(min(id) AS STRING)), 256) AS pdf_hash, make_timestamp(2026, 2, CAST(1 + min(id) % 28 AS INT), 0, 0, 0) AS site_ts FROM {fac} GROUP BY uf"


@query(
    with_tables("fac", "inc", more="s AS (SELECT uf, sha256(concat(uf, CAST(min(id) AS VARCHAR))) AS pdf_hash, make_timestamp(2026, 2, CAST(1 + min(id) % 28 AS BIGINT), 0, 0, 0) AS atualizado_em FROM fac GROUP BY uf), t AS (SELECT uf, count(*) AS total, CASE WHEN bool_or(seq % 8 = 0 AND uf = 'SP') THEN 'ok_ocr' ELSE 'ok' END AS status FROM inc GROUP BY uf)")
    + "SELECT uf, total, status, CAST(NULL AS VARCHAR) AS ultimo_erro, pdf_hash, atualizado_em, TIMESTAMP '2026-03-01 00:00:00' AS sincronizado_em FROM t LEFT JOIN s USING (uf)"
)
def o32_control_rows(spark, d):
    sources = spark.sql(SOURCES, fac=load(spark, d, "fac"))
    return merge.control_rows(load(spark, d, "inc"), (F.col("seq") % 8 == 0) & (F.col("uf") == "SP"), sources, F.to_timestamp(F.lit("2026-03-01 00:00:00")))


FAILURES = "SELECT uf, concat(CASE WHEN id % 2 = 0 THEN 'XLSX ' ELSE 'timeout ' END, repeat('x', 600)) AS message FROM {fac}"


@query(with_tables("fac") + "SELECT uf, CASE WHEN id % 2 = 0 THEN 'nao_suportado' ELSE 'erro' END AS status, substr(concat(CASE WHEN id % 2 = 0 THEN 'XLSX ' ELSE 'timeout ' END, repeat('x', 600)), 1, 500) AS ultimo_erro FROM fac")
def o33_error_rows(spark, d):
    return merge.error_rows(spark.sql(FAILURES, fac=load(spark, d, "fac")))


@query(
    with_tables("fac")
    + "SELECT 'cnes' AS rule, count(*) FILTER (cnes IS NULL) AS rows FROM fac UNION ALL SELECT 'fonte', count(*) FILTER (fonte_extracao NOT IN ('pdf_texto')) FROM fac UNION ALL SELECT 'lat', count(*) FILTER (lat NOT BETWEEN -30 AND 0) FROM fac"
)
def o34_constraints(spark, d):
    return tables.violations(load(spark, d, "fac"), {"cnes": F.col("cnes").isNotNull(), "fonte": F.col("fonte_extracao").isin("pdf_texto"), "lat": F.col("lat").between(-30, 0)})


STATUSES = "SELECT uf, CASE min(id) % 4 WHEN 0 THEN 'ok' WHEN 1 THEN 'ok_ocr' WHEN 2 THEN 'erro' ELSE 'nao_suportado' END AS status FROM {fac} GROUP BY uf"


@query(
    with_tables("fac", more=f"s AS ({STATUSES.replace('{fac}', 'fac')})")
    + "SELECT count(*) FILTER (status IN ('ok', 'ok_ocr')) AS successes, count(*) FILTER (status = 'erro') AS errors, count(*) FILTER (status = 'nao_suportado') AS unsupported, coalesce(list(uf ORDER BY uf) FILTER (status = 'ok_ocr'), []) AS ocr_keys, coalesce(list(uf ORDER BY uf) FILTER (status = 'nao_suportado'), []) AS unsupported_keys, coalesce(list(uf ORDER BY uf) FILTER (status = 'erro'), []) AS error_keys, (count(*) FILTER (status IN ('ok', 'ok_ocr')) = 0 AND count(*) FILTER (status IN ('erro', 'nao_suportado')) > 0) AS failed FROM s"
)
def o35_run_summary(spark, d):
    return merge.run_summary(spark.sql(STATUSES, fac=load(spark, d, "fac")))


@query(with_tables("fac") + "SELECT id, fonte_extracao = 'pdf_ocr' AS requer_verificacao FROM fac")
def o36_needs_review(spark, d):
    return load(spark, d, "fac").select("id", merge.needs_review(F.col("fonte_extracao")).alias("requer_verificacao"))


# 2.5 functions


@query(with_tables("fac") + "SELECT id, strip_accents(concat(municipio, ' ', atendimentos_raw)) AS folded FROM fac")
def o37_fold(spark, d):
    return load(spark, d, "fac").select("id", text.fold(F.concat("municipio", F.lit(" "), "atendimentos_raw")).alias("folded"))


@query(with_tables("fac") + f"SELECT id, lower(translate(municipio, '{text.STORED_FROM}', '{text.STORED_TO}')) AS municipio_norm FROM fac")
def o38_fold_stored(spark, d):
    return load(spark, d, "fac").select("id", text.fold_stored(F.col("municipio")).alias("municipio_norm"))


@query(r"SELECT doc_id, trim(regexp_replace(coalesce(text, ''), '[\s\x{0b}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+', ' ', 'g')) AS squeezed FROM documents")
def o39_squeeze(spark, d):
    return load(spark, d, "documents").select("doc_id", text.squeeze(F.col("text")).alias("squeezed"))


SERVICES_SQL = "list_filter(['" + "','".join(text.SERVICES) + "'], lambda s: contains(lower(strip_accents(atendimentos_raw)), lower(strip_accents(s))))"


@query(with_tables("fac") + f"SELECT id, {SERVICES_SQL} AS services FROM fac")
def o40_services(spark, d):
    return load(spark, d, "fac").select("id", text.services(F.col("atendimentos_raw")).alias("services"))


ALIAS_ROWS = ", ".join(f"('{a}', '{s}')" for s, names in text.SERVICE_ALIASES.items() for a in names)
ALIAS_OF = "concat(' ', upper(split_part('jararaca|Cobra|cascavel|CORAL|surucucu|Escorpião|tityus|aranha marrom|armadeira|lagarta|nenhuma|Botrópico', '|', CAST(1 + id % 12 AS INT))), ' ')"


@query(with_tables("fac", more=f"a(alias, service) AS (VALUES {ALIAS_ROWS}), q AS (SELECT id, {ALIAS_OF} AS name FROM fac)") + "SELECT id, service FROM q LEFT JOIN a ON alias = lower(strip_accents(trim(name)))")
def o41_alias(spark, d):
    return load(spark, d, "fac").select("id", text.canonical_service(F.expr(ALIAS_OF)).alias("service"))


# the derived table puts numbers of all shapes, marks and brackets around addresses whose own numbers must stay
@query(with_tables("addr") + "SELECT id, base AS address FROM addr")
def o42_clean_address(spark, d):
    return load(spark, d, "addr").select("id", text.clean_address(F.col("dirty")).alias("address"))


@query(with_tables("fac") + "SELECT id, CASE WHEN regexp_extract(endereco, '^([^,0-9]+)', 1) = '' THEN endereco ELSE trim(regexp_extract(endereco, '^([^,0-9]+)', 1)) END AS street FROM fac")
def o43_street(spark, d):
    return load(spark, d, "fac").select("id", text.street(F.col("endereco")).alias("street"))


@query(with_tables("words", more=TOKENS) + "SELECT doc_id, kind, count(*) AS n FROM kd GROUP BY ALL")
def o44_token_class(spark, d):
    return load(spark, d, "words").groupBy("doc_id", text.token_class(F.col("text")).alias("kind")).agg(F.count(F.lit(1)).alias("n"))


@query(with_tables("fac") + r"SELECT id, CASE WHEN len(regexp_replace(concat(cnes, '-', CAST(id % 10 AS VARCHAR(2)), CASE WHEN id % 3 = 0 THEN 'x9' ELSE '' END), '\D', '', 'g')) = 8 THEN regexp_replace(concat(cnes, '-', CAST(id % 10 AS VARCHAR(2)), CASE WHEN id % 3 = 0 THEN 'x9' ELSE '' END), '\D', '', 'g') END AS cep FROM fac WHERE cnes IS NOT NULL")
def o45_postal_code(spark, d):
    raw = F.concat("cnes", F.lit("-"), (F.col("id") % 10).cast("string"), F.when(F.col("id") % 3 == 0, "x9").otherwise(""))
    return load(spark, d, "fac").where("cnes IS NOT NULL").select("id", text.postal_code(raw).alias("cep"))


@query(with_tables("req") + "SELECT id, CASE WHEN id % 7 <> 0 THEN substr(sha256(concat('salt', ip)), 1, 16) END AS ip_hash FROM req")
def o46_ip_hash(spark, d):
    return load(spark, d, "req").select("id", logs.ip_hash(F.when(F.col("id") % 7 == 0, "unknown").otherwise(F.col("ip")), "salt").alias("ip_hash"))


@query(with_tables("req", more=RAW_LOG_SQL.replace("SELECT criado_em,", "SELECT id, criado_em,")) + "SELECT id, rota FROM raw")
def o47_route(spark, d):
    req = load(spark, d, "req")
    i = F.col("id")
    path = F.when(i % 4 == 0, F.concat(F.lit("/v1/hospitais/"), i.cast("string"))).when(i % 4 == 1, "/v1/estados/sp").when(i % 4 == 2, F.concat(F.lit("/v1/hospitais?uf="), i.cast("string"))).otherwise("/v1/estados")
    return req.select("id", logs.route(path).alias("rota"))


@query(with_tables("req", more=RAW_LOG_SQL) + "SELECT criado_em, metodo, user_agent, erro_msg, cache_hit, rate_limited FROM raw")
def o48_log_fields(spark, d):
    return streams.shape(_raw_log(load(spark, d, "req")), "salt").select("criado_em", "metodo", "user_agent", "erro_msg", "cache_hit", "rate_limited")


@query(with_tables("req") + "SELECT id, CASE WHEN id % 3 = 0 THEN ip WHEN id % 3 = 1 THEN 'real' WHEN id % 2 = 0 THEN 'sock' ELSE 'unknown' END AS client FROM req")
def o49_client_ip(spark, d):
    i = F.col("id")
    forwarded = F.when(i % 3 == 0, F.concat(F.lit(" "), F.col("ip"), F.lit(" , 9.9.9.9")))
    return load(spark, d, "req").select("id", logs.client_ip(forwarded, F.when(i % 3 == 1, "real").otherwise(""), F.when(i % 2 == 0, "sock")).alias("client"))


def duck_distance(a: str, b: str) -> str:
    def p(t):
        return f"cos(radians({t}.lat)) * cos(radians({t}.lng))", f"cos(radians({t}.lat)) * sin(radians({t}.lng))", f"sin(radians({t}.lat))"

    square = " + ".join(f"pow({x} - {y}, 2)" for x, y in zip(p(a), p(b), strict=True))
    return f"(2 * 6378168.0 * asin(least(1.0, sqrt({square}) / 2)))"


HERE = "h AS (SELECT CAST(-23.5 AS DOUBLE) AS lat, CAST(-46.6 AS DOUBLE) AS lng)"


@query(with_tables("fac", more=HERE) + f"SELECT id, round({duck_distance('fac', 'h')}, 1) AS distance_m FROM fac, h WHERE fac.lat IS NOT NULL")
def o50_distance(spark, d):
    return load(spark, d, "fac").where("lat IS NOT NULL").select("id", F.round(geo.distance(F.col("lat"), F.col("lng"), F.lit(-23.5), F.lit(-46.6)), 1).alias("distance_m"))


@query("SELECT o_orderkey AS id, floor(CAST(o_totalprice AS DOUBLE) / 100 + 0.5) / 10 AS km FROM orders")
def o51_km(spark, d):
    return load(spark, d, "orders").select(F.col("o_orderkey").alias("id"), geo.km(F.col("o_totalprice").cast("double")).alias("km"))


@query("SELECT o_orderkey AS id, CASE WHEN k < 1 THEN concat(CAST(CAST(floor(k * 1000 + 0.5) AS BIGINT) AS VARCHAR), ' m') ELSE printf('%.1f km', floor(k * 10 + 0.5) / 10) END AS label FROM (SELECT o_orderkey, (o_orderkey % 4000) / 1024.0::DOUBLE AS k FROM orders) t")
def o52_distance_label(spark, d):
    return load(spark, d, "orders").select(F.col("o_orderkey").alias("id"), text.distance_label((F.col("o_orderkey") % 4000) / F.lit(1024.0)).alias("label"))


@query(with_tables("fac") + "SELECT id, CASE WHEN coalesce(endereco, '') <> '' THEN concat('https://maps.example/?query=', replace(url_encode(concat_ws(' ', unidade, endereco, municipio)), '+', '%20')) END AS link FROM fac")
def o53_map_link(spark, d):
    return load(spark, d, "fac").select("id", text.map_link("https://maps.example/", F.col("unidade"), F.col("endereco"), F.col("municipio")).alias("link"))


# DuckDB's epoch_ms rounds to whole milliseconds, which puts a window's last half millisecond into the next one
@query(with_tables("req") + "SELECT id, CAST(floor(epoch_us(criado_em) / 60000000) AS BIGINT) AS bucket FROM req")
def o54_window_index(spark, d):
    return load(spark, d, "req").select("id", logs.window_index(F.col("criado_em")).alias("bucket"))


@query(with_tables("req") + "SELECT id, date_trunc('hour', criado_em) AS hour FROM req")
def o55_hour(spark, d):
    return load(spark, d, "req").select("id", F.date_trunc("hour", "criado_em").alias("hour"))


CLAMP = "CASE WHEN id % 4 = 0 THEN 'abc' WHEN id % 4 = 1 THEN NULL ELSE CAST(id * 7 - 900 AS VARCHAR(12)) END"


@query(with_tables("fac") + f"SELECT id, greatest(least(coalesce(TRY_CAST({CLAMP} AS INT), 100), 500), 0) AS n, greatest(least(coalesce(TRY_CAST({CLAMP} AS INT), 20), 100), 0) AS near FROM fac")
def o56_clamp(spark, d):
    raw = F.expr(CLAMP)
    return load(spark, d, "fac").select("id", text.clamp(raw, 100, 500).alias("n"), text.clamp(raw, 20, 100).alias("near"))


# 2.6 filters


@query(with_tables("fac") + f"SELECT id, municipio, unidade FROM fac WHERE uf = 'SP' AND contains(lower(strip_accents(municipio)), 'sao') AND list_contains({SERVICES_SQL}, 'Botrópico') AND (contains(lower(unidade), 'santa') OR contains(lower(endereco), 'santa')) ORDER BY municipio, unidade, id LIMIT 100")
def o57_directory(spark, d):
    return search.directory(load(spark, d, "fac"), uf="sp", city="SÃO", service="jararaca", text="Santa").select("id", "municipio", "unidade")


BULK = """SELECT origin_id AS request_id, CASE origin_id % 5 WHEN 0 THEN 'sp' WHEN 1 THEN 'MG' WHEN 2 THEN '' END AS uf,
  CASE WHEN origin_id % 3 = 1 THEN split_part('polis|Jundiaí|SÃO|bom j|u|ão', '|', CAST(1 + origin_id % 6 AS INT)) END AS city,
  CASE origin_id % 7 WHEN 0 THEN 'upa' WHEN 1 THEN 'CA' WHEN 2 THEN concat('customer#', lpad(CAST(origin_id * 3 AS VARCHAR(9)), 9, '0')) WHEN 3 THEN 'Rua' WHEN 4 THEN '' END AS q,
  CASE origin_id % 9 WHEN 1 THEN 'Jararaca' WHEN 2 THEN 'nothing' END AS service, CASE origin_id % 8 WHEN 0 THEN 5 WHEN 1 THEN 700 WHEN 2 THEN -1 END AS "limit", CASE WHEN origin_id % 10 = 3 THEN 2 END AS "offset" FROM {ori}"""


@query(
    with_tables("fac", "ori", more=f"""r AS ({BULK.replace('{ori}', 'ori')}), p AS (SELECT request_id, id, coalesce("limit", 100) AS lim, coalesce("offset", 0) AS off, row_number() OVER (PARTITION BY request_id ORDER BY municipio, unidade, id) AS place FROM r JOIN fac
  ON (coalesce(r.uf, '') = '' OR upper(r.uf) = fac.uf) AND (city IS NULL OR contains(lower(strip_accents(municipio)), lower(strip_accents(city)))) AND (coalesce(q, '') = '' OR contains(lower(unidade), lower(q)) OR coalesce(contains(lower(endereco), lower(q)), false))
  AND (service IS NULL OR (service = 'Jararaca' AND list_contains({SERVICES_SQL}, 'Botrópico'))) WHERE NOT (coalesce(r.uf, '') = '' AND city IS NULL AND coalesce(q, '') = ''))""")
    + "SELECT request_id, id, CAST(place - off AS INT) AS rank FROM p WHERE lim >= 0 AND place > off AND place - off <= least(lim, 500)"
)
def o57_directory_many(spark, d):
    """A table of requests, by the grams of their texts."""
    asks = spark.sql(BULK.replace('"', "`"), ori=load(spark, d, "ori"))
    return search.directory_many(asks, load(spark, d, "fac"))


@query(with_tables("fac") + f"SELECT id FROM fac WHERE list_contains({SERVICES_SQL}, 'Crotálico')")
def o58_service_filter(spark, d):
    return load(spark, d, "fac").where(F.array_contains(text.services(F.col("atendimentos_raw")), "Crotálico")).select("id")


@query(with_tables("fac") + "SELECT id, uf FROM fac WHERE uf = 'MG'")
def o59_optional_predicate(spark, d):
    rows = load(spark, d, "fac")
    return rows.where(geojoin.optional(lambda v: F.col("uf") == v, "MG")).where(geojoin.optional(lambda v: F.col("cnes") == v, None)).select("id", "uf")


@query(with_tables("fac") + "SELECT id, municipio FROM fac WHERE contains(lower(strip_accents(municipio)), lower(strip_accents('POLIS')))")
def o60_folded_contains(spark, d):
    return load(spark, d, "fac").where(search.folded_contains(F.col("municipio"), F.lit("pólis"))).select("id", "municipio")


TOKENS_SQL = "t AS (SELECT id, unnest(list_distinct(list_filter(regexp_split_to_array(lower(strip_accents(trim(concat_ws(' ', unidade, endereco)))), '[^a-z0-9]+'), lambda x: x <> ''))) AS token FROM fac)"
ASKED = {1: ["santa", "rua"], 2: ["hospital", "building"], 3: ["upa", "nada"], 4: ["s", "n"]}


@query(with_tables("fac", more=TOKENS_SQL + ", q(query_id, token) AS (VALUES " + ", ".join(f"({k}, '{t}')" for k, ts in ASKED.items() for t in ts) + ")") + "SELECT query_id, id FROM q JOIN t USING (token) GROUP BY ALL HAVING count(*) = 2")
def o61_inverted_index(spark, d):
    asked = spark.createDataFrame([(k, t) for k, ts in ASKED.items() for t in ts], "query_id int, token string")
    return search.find_all(asked, search.inverted_index(load(spark, d, "fac")))


@query(with_tables("fac", more=TOKENS_SQL + ", rq AS (SELECT id AS query_id, token, row_number() OVER (PARTITION BY id ORDER BY md5(token)) AS r FROM t WHERE id % 10 = 3), q AS (SELECT query_id, token FROM rq WHERE r <= 3 UNION ALL SELECT query_id, 'nowhere' FROM rq WHERE r = 1 AND query_id % 100 = 3), n AS (SELECT query_id, count(*) AS need FROM q GROUP BY 1)") + "SELECT query_id, t.id AS id FROM q JOIN n USING (query_id) JOIN t USING (token) GROUP BY query_id, t.id HAVING count(*) = any_value(need)")
def o61_stored_index(spark, d):
    """Many queries, of three tokens of a facility each, on an index that is built once."""
    import uuid

    def postings_of(fac):
        return search.inverted_index(fac).select(F.col("token").alias("term"), "id")

    fac = load(spark, d, "fac")
    postings, name = postings_of(fac), f"index_{uuid.uuid4().hex}"
    # a table of short rows is few files, and folding a row's text costs far more than sending it
    index.build(postings_of(fac.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")))), name, _scratch(spark, "index"))
    place = F.row_number().over(Window.partitionBy("id").orderBy(F.md5("term")))
    own = postings.where("id % 10 = 3").withColumn("r", place).where("r <= 3")
    asked = own.select(F.col("id").alias("query_id"), "term").unionByName(own.where("r = 1 AND id % 100 = 3").select(F.col("id").alias("query_id"), F.lit("nowhere").alias("term")))
    return index.find_all(asked, name)


@query(with_tables("fac") + "SELECT CAST(o_orderkey AS INT) AS id, uf, unidade, fac.id IS NOT NULL AS found FROM orders LEFT JOIN fac ON fac.id = o_orderkey")
def o62_lookup(spark, d):
    asked = load(spark, d, "orders").select(F.col("o_orderkey").cast("int").alias("id"))
    return search.lookup(asked, load(spark, d, "fac").select("id", "uf", "unidade"))


@query(
    with_tables("fac", "inc", more="s AS (SELECT unnest(['" + "','".join(tables.STATES) + "']) AS uf, unnest(['" + "','".join(tables.STATES.values()) + "']) AS nome), c AS (SELECT uf, count(*) AS total, CASE WHEN bool_or(seq % 8 = 0 AND uf = 'SP') THEN 'ok_ocr' ELSE 'ok' END AS status FROM inc GROUP BY uf)")
    + "SELECT s.uf, nome, total, status, coalesce(status = 'ok_ocr', false) AS requires_review FROM s LEFT JOIN c USING (uf) ORDER BY s.uf"
)
def o63_states(spark, d):
    control = merge.control_rows(load(spark, d, "inc"), (F.col("seq") % 8 == 0) & (F.col("uf") == "SP"))
    return search.states(tables.state_seed(spark).select("uf", "nome"), control)


@query(with_tables("fac") + "SELECT id FROM fac WHERE lat IS NOT NULL AND lng IS NOT NULL")
def o64_located(spark, d):
    return geojoin.located(load(spark, d, "fac")).select("id")


# 2.7 joins


@query(with_tables("fac", more=HERE) + f"SELECT id, round({duck_distance('fac', 'h')}, 1) AS distance_m FROM fac, h WHERE fac.lat IS NOT NULL AND {duck_distance('fac', 'h')} <= 200000 AND list_contains({SERVICES_SQL}, 'Botrópico') ORDER BY {duck_distance('fac', 'h')}, id LIMIT 50")
def o65_radius_search(spark, d):
    return geojoin.radius_search(load(spark, d, "fac"), -23.5, -46.6, 200_000, service="Botrópico").select("id", F.round("distance_m", 1).alias("distance_m"))


NEAR_SQL = f"n AS (SELECT origin_id, fac.id AS id, {duck_distance('fac', 'ori')} AS m FROM ori JOIN fac ON fac.lat IS NOT NULL AND abs(fac.lat - ori.lat) < 1.5)"


@query(with_tables("fac", "ori", more=NEAR_SQL) + "SELECT origin_id, id, round(m, 1) AS distance_m FROM n WHERE m <= 150000")
def o66_radius_join(spark, d):
    return geojoin.radius_join(load(spark, d, "ori"), load(spark, d, "fac"), 150_000, decimals=1)


OWN_REACH = """SELECT *, CASE WHEN origin_id % 3 = 0 THEN NULL ELSE CAST(60000 + 40000 * (origin_id % 5) AS DOUBLE) END AS metres, CASE WHEN origin_id % 4 = 1 THEN 'sp' WHEN origin_id % 4 = 2 THEN 'MG' END AS uf,
  CASE WHEN origin_id % 7 = 1 THEN 'Jararaca' WHEN origin_id % 7 = 2 THEN 'crotálico' WHEN origin_id % 7 = 3 THEN 'none' END AS service FROM {ori}"""
OWN_SQL = f"""o AS ({OWN_REACH.replace('{ori}', 'ori')}), n AS (SELECT o.*, fac.id AS id, fac.uf AS fuf, {SERVICES_SQL} AS sv, {duck_distance('fac', 'o')} AS m FROM o JOIN fac ON fac.lat IS NOT NULL AND abs(fac.lat - o.lat) < 2.5)"""


@query(
    with_tables("fac", "ori", more=OWN_SQL)
    + "SELECT origin_id, id, round(m, 1) AS distance_m, row_number() OVER (PARTITION BY origin_id ORDER BY m, id) AS rank FROM n WHERE m <= least(coalesce(metres, 150000), 200000) AND (uf IS NULL OR upper(uf) = fuf) AND (service IS NULL OR (service = 'Jararaca' AND list_contains(sv, 'Botrópico')) OR (service = 'crotálico' AND list_contains(sv, 'Crotálico'))) QUALIFY rank <= 3"
)
def o66_nearest_join(spark, d):
    """Every origin has a reach, a state and a service of its own, or none."""
    return geojoin.radius_join(spark.sql(OWN_REACH, ori=load(spark, d, "ori")), load(spark, d, "fac"), 150_000, 3, decimals=1)


REACHES = "SELECT *, CAST(500 * CAST(POWER(3, origin_id % 7) AS INT) AS DOUBLE) AS metres FROM {ori}"
REACHES_SQL = f"o AS ({REACHES.replace('{ori}', 'ori')}), n AS (SELECT o.*, fac.id AS id, {duck_distance('fac', 'o')} AS m FROM o JOIN fac ON fac.lat IS NOT NULL AND abs(fac.lat - o.lat) < 2.5)"


@query(with_tables("fac", "ori", more=REACHES_SQL) + "SELECT origin_id, id, round(m, 1) AS distance_m FROM n WHERE m <= least(metres, 200000)")
def o66_levels_join(spark, d):
    """Reaches from 500 m to 364 km (200 km are the most)."""
    return geojoin.radius_join(spark.sql(REACHES, ori=load(spark, d, "ori")), load(spark, d, "fac"), decimals=1)


ASKS = """SELECT origin_id AS request_id, CASE WHEN origin_id % 4 = 0 THEN lat END AS lat, CASE WHEN origin_id % 4 = 0 THEN lng END AS lng,
  CASE WHEN origin_id % 4 IN (0, 1, 2) THEN lpad(CAST(origin_id * CASE WHEN origin_id % 5 = 0 THEN 100000 ELSE 1 END AS VARCHAR(12)), 8, '0') END AS cep,
  CASE WHEN origin_id % 4 = 3 AND origin_id % 3 <> 0 THEN split_part('São|polis|Jundiaí|Bom', '|', CAST(1 + origin_id % 4 AS INT)) END AS cidade, CASE WHEN origin_id % 6 = 0 THEN 'SP' END AS uf, CASE WHEN origin_id % 5 = 1 THEN 'cascavel' END AS service FROM {ori}"""
RESOLVED = """a AS (""" + ASKS.replace("{ori}", "ori") + """), o AS (SELECT a.*, c.cep AS known, c.lat AS clat, c.lng AS clng, c.cidade AS ccity, c.uf AS cuf, CASE WHEN a.lat IS NOT NULL AND a.lng IS NOT NULL THEN 'coords' WHEN a.cep IS NOT NULL AND c.cep IS NOT NULL AND c.lat IS NOT NULL THEN 'cep'
  WHEN a.cep IS NOT NULL AND c.cep IS NOT NULL THEN 'cep_sem_coords' WHEN a.cep IS NOT NULL THEN 'error' WHEN a.cidade IS NOT NULL THEN 'cidade' ELSE 'error' END AS source FROM a LEFT JOIN cep c ON c.cep = a.cep),
  r AS (SELECT request_id, CASE source WHEN 'coords' THEN lat WHEN 'cep' THEN clat END AS lat, CASE source WHEN 'coords' THEN lng WHEN 'cep' THEN clng END AS lng, CASE source WHEN 'cep_sem_coords' THEN ccity WHEN 'cidade' THEN cidade END AS city,
  CASE WHEN source IN ('cep', 'cep_sem_coords') THEN coalesce(uf, cuf) ELSE uf END AS uf, source, service FROM o)"""


def _origins(spark, d):
    return search.resolve_origins(spark.sql(ASKS, ori=load(spark, d, "ori")), load(spark, d, "cep"))


@query(with_tables("fac", "ori", "cep", more=RESOLVED) + "SELECT * FROM r")
def o67_origins(spark, d):
    return _origins(spark, d)


@query(with_tables("fac", "ori", "cep", more=RESOLVED) + f"SELECT request_id, id, row_number() OVER (PARTITION BY request_id ORDER BY municipio, unidade, id) AS rank FROM r JOIN fac ON contains(lower(strip_accents(municipio)), lower(strip_accents(city))) AND (r.uf IS NULL OR r.uf = fac.uf) AND (service IS NULL OR list_contains({SERVICES_SQL}, 'Crotálico')) WHERE r.lat IS NULL AND city IS NOT NULL QUALIFY rank <= 20")
def o68_city_fallback(spark, d):
    return search.city_fallback(_origins(spark, d), load(spark, d, "fac"))


#: The addresses of `fac` hold one phone number and one mark only; o42 has all shapes.
CLEAN_SQL = "trim(regexp_replace(replace(replace(endereco, '(11) 4411-0062', ''), 's/n', ''), ' +', ' ', 'g'), ' ,-')"
CANDS = f"""ca AS (SELECT id, 0 AS pos, concat({CLEAN_SQL}, ', ', municipio, ', ', uf, ', Brasil') AS query_key FROM fac WHERE coalesce(endereco, '') <> ''
  UNION ALL SELECT id, 1, concat(CASE WHEN regexp_extract({CLEAN_SQL}, '^([^,0-9]+)', 1) = '' THEN {CLEAN_SQL} ELSE trim(regexp_extract({CLEAN_SQL}, '^([^,0-9]+)', 1)) END, ', ', municipio, ', ', uf, ', Brasil') FROM fac WHERE coalesce(endereco, '') <> ''
  UNION ALL SELECT id, 2, concat(municipio, ', ', uf, ', Brasil') FROM fac),
  st AS (SELECT ca.*, CASE WHEN gz.query_key IS NULL THEN 'absent' WHEN gz.lat IS NULL OR gz.lng IS NULL THEN 'miss' ELSE 'hit' END AS state, gz.lat AS lat, gz.lng AS lng FROM ca LEFT JOIN gz USING (query_key))"""


@query(with_tables("fac", "gz", more=CANDS) + "SELECT id, pos, query_key, state, lat, lng, CASE WHEN state = 'hit' THEN 'cache' END AS fonte FROM st")
def o69_three_state(spark, d):
    return lookup.three_state(lookup.candidates(load(spark, d, "fac")), load(spark, d, "gz"))


@query(with_tables("fac", "gz", more=CANDS) + "SELECT ca.id, ca.pos, ca.query_key, CASE WHEN ca.id % 50 = 0 OR st.state = 'hit' THEN 'hit' ELSE st.state END AS state, CASE WHEN ca.query_key IN (SELECT query_key FROM ca WHERE id % 50 = 0) THEN 1.5 ELSE st.lat END AS lat FROM ca JOIN st ON st.id = ca.id AND st.pos = ca.pos WHERE ca.id % 50 = 0 OR ca.query_key NOT IN (SELECT query_key FROM ca WHERE id % 50 = 0)")
def o69_bucketed_cache(spark, d):
    """Lookups in a cache that is bucketed by its key, after new answers were merged into it."""
    import uuid

    name, at = f"cache_{uuid.uuid4().hex}", _scratch(spark, "cache")
    asked, gz = lookup.candidates(load(spark, d, "fac")), load(spark, d, "gz")
    lookup.store_bucketed(gz, name, f"{at}/0")
    new = asked.where("id % 50 = 0")
    answers = new.select("query_key", F.lit(1.5).alias("lat"), F.lit(2.5).alias("lng"), F.lit("new").alias("fonte"), F.col("id").alias("ts"))
    lookup.merge_bucketed(name, answers, f"{at}/1")
    rows = asked.where("id % 50 = 0").unionByName(asked.join(new.select("query_key").distinct(), "query_key", "left_anti"))
    return lookup.three_state(rows, spark.table(name)).select("id", "pos", "query_key", "state", "lat")


@query(
    with_tables("fac", "gz", more=CANDS + ", b AS (SELECT id, lat, lng, pos, query_key, row_number() OVER (PARTITION BY id ORDER BY pos, lat, lng) AS r FROM st WHERE state = 'hit')")
    + "SELECT f.id, b.lat AS lat, b.lng AS lng, b.pos AS pos, b.query_key AS query_key FROM fac f LEFT JOIN b ON b.id = f.id AND r = 1"
)
def o70_fallback_geocode(spark, d):
    return lookup.resolve(load(spark, d, "fac"), load(spark, d, "gz"))


@query(
    with_tables("fac", "gz", more=CANDS + ", w AS (SELECT id, min(pos) FILTER (state = 'hit') AS hit, min(pos) FILTER (state = 'absent') AS new, arg_min(query_key, pos) FILTER (state = 'absent') AS k FROM st GROUP BY id)")
    + "SELECT DISTINCT k AS query_key FROM w WHERE new IS NOT NULL AND (hit IS NULL OR new < hit)"
)
def o71_work_list(spark, d):
    return lookup.work_list(lookup.candidates(load(spark, d, "fac")), load(spark, d, "gz"))


@query(
    with_tables("fac", "gz", more=CANDS + ", s AS (SELECT f.id, f.uf, CASE WHEN bool_or(state = 'hit') THEN 'ok' ELSE 'falhou' END AS status FROM fac f LEFT JOIN st ON st.id = f.id WHERE f.lat IS NULL GROUP BY f.id, f.uf)")
    + "SELECT uf, status, count(*) AS n FROM s GROUP BY ALL"
)
def o72_pending(spark, d):
    pending = load(spark, d, "fac").where("lat IS NULL")
    return lookup.settle(pending, lookup.resolve(pending, load(spark, d, "gz"))).groupBy("uf", "status").agg(F.count(F.lit(1)).alias("n"))


REPLIES = """SELECT cep, to_json(named_struct('cep', concat(substring(cep, 1, 5), '-', substring(cep, 6, 3)), 'state', uf, 'city', CASE WHEN TRY_CAST(cep AS INT) % 11 = 0 THEN '' ELSE cidade END,
  'location', named_struct('coordinates', named_struct('latitude', CAST(lat AS STRING), 'longitude', CAST(lng AS STRING))))) AS reply FROM {cep} WHERE TRY_CAST(cep AS INT) % 3 = 0"""


@query(
    with_tables("fac", "cep", more="a AS (SELECT DISTINCT cep FROM cep UNION SELECT 'x')")
    + "SELECT a.cep, CASE WHEN m <> 0 AND m3 = 0 AND m11 = 0 THEN NULL ELSE c.cidade END AS cidade, c.uf, c.lat, c.lng, CASE WHEN m = 0 THEN 'cache' WHEN m3 = 0 THEN 'provider' ELSE 'none' END AS fonte FROM (SELECT cep, TRY_CAST(cep AS INT) % 2 AS m, TRY_CAST(cep AS INT) % 3 AS m3, TRY_CAST(cep AS INT) % 11 AS m11 FROM a) a LEFT JOIN cep c ON c.cep = a.cep AND (m = 0 OR m3 = 0)"
)
def o73_postal_cascade(spark, d):
    codes = load(spark, d, "cep")
    asked = codes.select("cep").unionByName(spark.createDataFrame([("x",)], "cep string"))
    cache = codes.where("TRY_CAST(cep AS INT) % 2 = 0").select("cep", "cidade", "uf", "lat", "lng")
    return lookup.postal_cascade(asked, cache, lookup.parse_provider(spark.sql(REPLIES, cep=codes)))[0]


# st has a request once for each of the gazetteer's rows of its key, ca has it once
@query(
    with_tables("fac", "gz", more=CANDS + ", k AS (SELECT query_key, count(*) AS n, count(*) FILTER (lat IS NOT NULL AND lng IS NOT NULL) AS places FROM gz GROUP BY query_key)")
    + "SELECT ca.query_key AS query_key, count(*) AS requests, count(*) FILTER (places > 0) AS answered, coalesce(any_value(n), 0) AS lookups FROM ca LEFT JOIN k ON k.query_key = ca.query_key GROUP BY ca.query_key"
)
def o74_memo(spark, d):
    asked = lookup.memoised(lookup.candidates(load(spark, d, "fac")), load(spark, d, "gz"))
    return asked.groupBy("query_key").agg(F.count(F.lit(1)).alias("requests"), F.count("lat").alias("answered"), F.max("lookups").alias("lookups"))


@query("SELECT 'orphan' AS kind, count(*) AS n FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0) UNION ALL SELECT 'kept', count(*) FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)")
def o75_references(spark, d):
    facts = load(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey"))
    dimension = load(spark, d, "customer").where("c_acctbal > 0")
    n = F.count(F.lit(1)).alias("n")
    return tables.orphans(facts, dimension, "c_custkey").agg(n).select(F.lit("orphan").alias("kind"), "n").unionByName(tables.cascade(facts, dimension, "c_custkey").agg(n).select(F.lit("kept").alias("kind"), "n"))


# 2.8 metrics

NOW = "t AS (SELECT max(criado_em) AS now FROM req), r24 AS (SELECT req.* FROM req, t WHERE criado_em > now - INTERVAL 24 HOUR)"


@query(
    with_tables("req", more=NOW)
    + "SELECT count(*) AS total, count(*) FILTER (status < 400) AS ok, count(*) FILTER (status >= 400 AND status < 500) AS client_errors, count(*) FILTER (status >= 500) AS server_errors, count(*) FILTER (rate_limited) AS rate_limited, count(DISTINCT ip) AS ips, CAST(round(CAST(avg(duracao_ms) AS DECIMAL(20,6)), 1) AS DOUBLE) AS mean_ms, CAST(round(CAST(quantile_cont(duracao_ms, 0.95) AS DECIMAL(20,6)), 1) AS DOUBLE) AS p95_ms FROM r24"
)
def o76_overview(spark, d):
    log = load(spark, d, "req")
    return metrics.overview(log, now_of(log))


@query(with_tables("req") + "SELECT date_trunc('day', criado_em) AS day, count(*) AS total, count(*) FILTER (status >= 400) AS errors, true AS ips_close, true AS p95_close FROM req GROUP BY 1")
def o76_overview_by_hours(spark, d):
    """Days merged from the sketches of their hours, which are written first: counts exactly, addresses within 3 %, the 95th percentile within a hundredth of the ranks."""
    log, at = load(spark, d, "req"), _scratch(spark, "hours")
    metrics.hour_sketches(log).write.parquet(at)
    day = lambda c: F.date_trunc("day", c).alias("day")
    days = metrics.merged(spark.read.parquet(at), day("hour"))
    known = log.select("*", day("criado_em")).join(days.select("day", "p95_ms"), "day")
    n = F.count("duracao_ms")
    below, upto = F.count_if(F.col("duracao_ms") < F.col("p95_ms")) / n, F.count_if(F.col("duracao_ms") <= F.col("p95_ms")) / n
    exact = known.groupBy("day").agg(F.count_distinct("ip").alias("n"), ((below <= 0.96) & (upto >= 0.94)).alias("p95_close"))
    close = F.abs(F.col("ips") - F.col("n")) <= F.greatest(F.lit(1.0), 0.03 * F.col("n"))
    return days.join(exact, "day").select("day", "total", "errors", close.alias("ips_close"), "p95_close")


@query(with_tables("req", more=NOW) + "SELECT rota, count(*) AS total, count(*) FILTER (status >= 400) AS errors, CAST(round(CAST(100.0 * count(*) FILTER (status >= 400) / count(*) AS DECIMAL(20,6)), 2) AS DOUBLE) AS error_pct, CAST(round(CAST(avg(duracao_ms) AS DECIMAL(20,6)), 1) AS DOUBLE) AS mean_ms FROM r24 GROUP BY rota")
def o77_by_route(spark, d):
    log = load(spark, d, "req")
    return metrics.by_route(log, now_of(log))


@query(with_tables("req", more=NOW) + "SELECT rota, count(*) AS total, count(*) FILTER (cache_hit) AS hits, count(*) FILTER (NOT cache_hit) AS misses, CAST(round(CAST(100.0 * count(*) FILTER (cache_hit) / count(*) AS DECIMAL(20,6)), 2) AS DOUBLE) AS hit_pct FROM r24 WHERE cache_hit IS NOT NULL GROUP BY rota")
def o78_cache_rate(spark, d):
    log = load(spark, d, "req")
    return metrics.cache_rate(log, now_of(log))


@query(with_tables("req") + "SELECT id, criado_em, rota, status, duracao_ms FROM req WHERE status >= 400 ORDER BY criado_em DESC, id DESC LIMIT 100")
def o79_recent_errors(spark, d):
    return metrics.recent_errors(load(spark, d, "req")).select("id", "criado_em", "rota", "status", "duracao_ms")


@query(with_tables("req", more="t AS (SELECT max(criado_em) AS now FROM req)") + "SELECT date_trunc('hour', criado_em) AS hour, count(*) AS total, count(*) FILTER (status >= 400) AS errors, count(DISTINCT ip) AS ips FROM req, t WHERE criado_em > now - INTERVAL 48 HOUR GROUP BY 1")
def o80_hourly(spark, d):
    log = load(spark, d, "req")
    return metrics.hourly(log, now_of(log))


@query(with_tables("req", more="t AS (SELECT max(criado_em) AS now FROM req)") + "SELECT (SELECT count(*) FROM req, t WHERE NOT criado_em < now - INTERVAL 10 DAY) AS kept, (SELECT count(*) FROM req, t WHERE criado_em < now - INTERVAL 10 DAY) AS removed")
def o81_retention(spark, d):
    log = load(spark, d, "req")
    kept, removed = metrics.retain(log, now_of(log), 10)
    return kept.agg(F.count(F.lit(1)).alias("kept")).join(F.broadcast(removed))


@query(with_tables("req", more="t AS (SELECT max(criado_em) AS now FROM req)") + "SELECT (SELECT count(*) FROM req, t WHERE NOT criado_em < now - INTERVAL 10 DAY) AS kept, (SELECT count(*) FROM req, t WHERE criado_em < now - INTERVAL 10 DAY) AS removed, (SELECT count(DISTINCT date_trunc('day', criado_em)) FROM req, t WHERE date_trunc('day', criado_em) < date_trunc('day', now - INTERVAL 10 DAY)) AS dropped")
def o81_retention_by_days(spark, d):
    """The log as it is stored, by day: whole days go with their files."""
    log, at = load(spark, d, "req"), _scratch(spark, "days")
    tables.write_partitions(log.withColumn("dia", F.date_format("criado_em", "yyyy-MM-dd")), at, "dia")
    gone = stored.retain_days(spark, at, now_of(log) - F.expr("INTERVAL 10 DAYS"))
    return spark.read.parquet(at).agg(F.count(F.lit(1)).alias("kept")).join(F.broadcast(gone.select("removed", "dropped")))


USES = "SELECT r.id AS use, g.query_key AS query_key, r.criado_em AS ts, CASE WHEN g.lat IS NULL THEN 'miss' ELSE 'hit' END AS state FROM {req} r JOIN {fac} f ON f.id = 1 + r.id % (SELECT count(*) FROM {fac}) JOIN {gz} g ON g.query_key = concat(f.municipio, ', ', f.uf, ', Brasil')"
CACHE = "SELECT *, CAST(1 AS BIGINT) AS hit_count, TIMESTAMP '2024-01-15 00:00:00' AS ultimo_hit FROM {gz}"


@query(
    with_tables("req", "fac", "gz", more="u AS (" + USES.replace("{req}", "req").replace("{fac}", "fac").replace("{gz}", "gz") + "), h AS (SELECT query_key, count(*) AS n, max(ts) AS t FROM u WHERE state = 'hit' GROUP BY query_key)")
    + "SELECT query_key, 1 + coalesce(n, 0) AS hit_count, greatest(TIMESTAMP '2024-01-15 00:00:00', coalesce(t, TIMESTAMP '2024-01-15 00:00:00')) AS ultimo_hit FROM gz LEFT JOIN h USING (query_key)"
)
def o82_cache_usage(spark, d):
    gz = load(spark, d, "gz")
    uses = spark.sql(USES, req=load(spark, d, "req"), fac=load(spark, d, "fac"), gz=gz)
    return lookup.count_usage(spark.sql(CACHE, gz=gz), uses).select("query_key", "hit_count", "ultimo_hit")


@query(with_tables("fac", "gz") + "SELECT query_key, lat, lng, fonte FROM gz WHERE lat IS NOT NULL")
def o83_purge_misses(spark, d):
    return lookup.purge_misses(load(spark, d, "gz"))


@query(with_tables("fac") + "SELECT uf, municipio, count(*) AS units FROM fac GROUP BY ALL HAVING count(*) > 1")
def o84_cities(spark, d):
    return metrics.cities_with_several(load(spark, d, "fac"))


@query(with_tables("fac") + f"SELECT DISTINCT unnest({SERVICES_SQL}) AS service FROM fac")
def o84_service_set(spark, d):
    return metrics.service_set(load(spark, d, "fac"), text.services(F.col("atendimentos_raw")))


@query(with_tables("fac") + "SELECT id, " + ", ".join(f"list_contains({SERVICES_SQL}, '{s}') AS s{i}" for i, s in enumerate(text.SERVICES)) + " FROM fac")
def o85_service_grid(spark, d):
    return metrics.service_grid(load(spark, d, "fac"), text.services(F.col("atendimentos_raw")))


@query(with_tables("fac") + "SELECT bool_or(fonte_extracao = 'pdf_ocr') AS any_review, bool_or(lat IS NOT NULL AND lng IS NOT NULL) AS any_coords, min(lat) AS south, max(lat) AS north, min(lng) AS west, max(lng) AS east FROM fac")
def o86_extent(spark, d):
    return metrics.extent(load(spark, d, "fac"))


# 2.9 streams and 2.10 functions


@query(with_tables("req", more="b AS (SELECT id, row_number() OVER (PARTITION BY ip, epoch_ms(criado_em) // 86400000 ORDER BY criado_em, id) AS n FROM req)") + "SELECT id, n, n <= 3 AS allowed, greatest(0, 3 - n) AS remaining FROM b")
def o87_rate_limit(spark, d):
    return metrics.allowed(load(spark, d, "req"), 3, 86400).select("id", "n", "allowed", "remaining")


@query(with_tables("req", more="b AS (SELECT ip, row_number() OVER (PARTITION BY ip, epoch_ms(criado_em) // 86400000 ORDER BY criado_em, id) AS n FROM req)") + "SELECT ip, count(*) AS requests, count(*) FILTER (n <= 3) AS allowed FROM b GROUP BY ip")
def o87_rate_limit_stream(spark, d):
    out = _run(spark, streams.limit_requests(_req_stream(spark, d), 3, 86400))
    return out.groupBy("ip").agg(F.count(F.lit(1)).alias("requests"), F.count_if("allowed").alias("allowed"))


def _run(spark, stream: DataFrame, mode: str = "append") -> DataFrame:
    """A stream run to its end into Parquet files, and those."""
    path = _scratch(spark, "out")
    stream.writeStream.format("parquet").outputMode(mode).option("path", path).option("checkpointLocation", _scratch(spark, "state")).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)


@query(with_tables("req") + "SELECT date_trunc('hour', criado_em) AS hour, count(*) AS total, count(*) FILTER (status >= 400) AS errors FROM req GROUP BY 1")
def o88_hourly_stream(spark, d):
    """Every hour, the last ones too, as kept by day; the approximate numbers are o76_overview_by_hours' matter."""
    at = _scratch(spark, "hours")
    streams.keep_hours(streams.hourly(_req_stream(spark, d)), at, _scratch(spark, "hours-state")).awaitTermination()
    return spark.read.parquet(at).select("hour", "total", "errors")


@query(with_tables("req", more=RAW_LOG_SQL) + "SELECT * FROM raw")
def o89_log_stream(spark, d):
    return _run(spark, streams.shape(_raw_log(_req_stream(spark, d)), "salt"))


@query(
    with_tables("fac", "cur", "inc", more=MERGE)
    + "SELECT id, new.uf AS uf, new.municipio AS municipio, new.unidade AS unidade, new.endereco AS endereco, new.cnes AS cnes, new.atendimentos_raw AS atendimentos_raw, CASE WHEN same THEN old.lat END AS lat, CASE WHEN same THEN old.lng END AS lng, new.fonte_extracao AS fonte_extracao, CASE WHEN same THEN old.geocode_status ELSE 'pendente' END AS geocode_status, new.telefones AS telefones, old.confianca_ocr AS confianca_ocr FROM mn WHERE op <> 'delete'"
)
def o90_merge_stream(spark, d):
    incoming, at = _scratch(spark, "incoming"), _scratch(spark, "stored")
    load(spark, d, "inc").write.parquet(incoming)
    tables.write_partitions(load(spark, d, "cur"), at, "uf")
    stream = spark.readStream.schema(spark.read.parquet(incoming).schema).parquet(incoming)
    streams.merge_batches(stream, at, _scratch(spark, "merge-log"), _scratch(spark, "merge-state")).awaitTermination()
    return spark.read.parquet(at)


@query(with_tables("fac", more=HERE) + f"SELECT id, uf, municipio, round({duck_distance('fac', 'h')}, 1) AS distance_m FROM fac, h WHERE fac.lat IS NOT NULL AND uf = 'SP' AND list_contains({SERVICES_SQL}, 'Botrópico') AND {duck_distance('fac', 'h')} <= 900000 ORDER BY {duck_distance('fac', 'h')}, id LIMIT 20")
def o91_table_function(spark, d):
    geojoin.register_table_function(load(spark, d, "fac"))
    return spark.sql("SELECT id, uf, municipio, round(distance_m, 1) AS distance_m FROM facilities_near(-23.5D, -46.6D, 900000D, 'sp', 'Botrópico', 20)")


@query(with_tables("req", more="t AS (SELECT max(criado_em) AS now FROM req)") + "SELECT count(*) AS removed FROM req, t WHERE criado_em < now - INTERVAL 20 DAY")
def o92_cleanup(spark, d):
    log = load(spark, d, "req")
    return metrics.retain(log, now_of(log), 20)[1]


@query(with_tables("fac", "gz", more=CANDS) + "SELECT f.id, min(pos) AS pos FROM fac f LEFT JOIN st ON st.id = f.id AND state = 'hit' GROUP BY f.id")
def o93_resolver(spark, d):
    """Any DataFrame (query_key, lat, lng) resolves; here the gazetteer behind a table of its own."""
    return lookup.resolve(load(spark, d, "fac"), load(spark, d, "gz").select("query_key", "lat", "lng")).select("id", "pos")


def place_of(key: str) -> tuple[float, float] | None:
    """A provider for the query below: by the digits of a key's hash it fails, knows nothing, or gives a place."""
    digest = hashlib.md5(key.encode()).hexdigest()
    if digest[0] in "012":
        raise TimeoutError(key)
    return None if digest[0] in "34567" else (int(digest[1:5], 16) / 1024 - 32, int(digest[5:9], 16) / 1024 - 72)


ASK_SQL = "an AS (SELECT id, pos, query_key, md5(query_key) AS h FROM ca), hit AS (SELECT id, pos, query_key, CAST('0x' || h[2:5] AS BIGINT) / 1024 - 32 AS lat, CAST('0x' || h[6:9] AS BIGINT) / 1024 - 72 AS lng FROM an WHERE h[1] >= '8')"


@query(with_tables("fac", "gz", more=f"{CANDS}, {ASK_SQL}") + "SELECT fac.id AS id, arg_min(hit.lat, pos) AS lat, arg_min(hit.lng, pos) AS lng, min(pos) AS pos, arg_min(query_key, pos) AS query_key FROM fac LEFT JOIN hit ON hit.id = fac.id GROUP BY fac.id")
def o93_resolver_in_tasks(spark, d):
    """A provider that is a function, and fails at times."""
    return resolver.resolve(load(spark, d, "fac"), place_of, _scratch(spark, "answers"), tries=2)[0]
