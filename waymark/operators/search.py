"""Directory search: filters over facilities, point lookups, an inverted index, and requests resolved in bulk."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from waymark.functions.text import canonical_service, search_key, services, squeeze
from waymark.operators import index

GRAM, SLICES = 3, 64


def directory(facilities: DataFrame, uf: str | None = None, city: str | None = None, service: str | None = None, text: str | None = None, limit: int = 100, offset: int = 0) -> DataFrame:
    """Facilities that meet all given conditions, by city and unit; one of uf, city and text is needed."""
    if not (uf or city or text):
        raise ValueError("give uf, city or text")
    if limit < 0 or offset < 0:
        raise ValueError("limit and offset can't be negative")
    rows = facilities
    if uf:
        rows = rows.where(F.col("uf") == uf.upper())
    if city:
        rows = rows.where(folded_contains(F.col("municipio"), F.lit(city)))
    if service:
        rows = rows.where(F.array_contains(services(F.col("atendimentos_raw")), canonical_service(F.lit(service))))
    if text:
        wanted = F.lower(F.lit(text))
        rows = rows.where(F.contains(F.lower("unidade"), wanted) | F.coalesce(F.contains(F.lower("endereco"), wanted), F.lit(False)))
    return rows.orderBy("municipio", "unidade", "id").offset(offset).limit(min(limit, 500))


def text_grams(facilities: DataFrame) -> DataFrame:
    """term, id: the grams of each facility's unit and address, for directory_many."""
    both = F.concat(*[index.grams(F.coalesce(F.lower(c), F.lit(""))) for c in ("unidade", "endereco")])
    return facilities.select(F.explode(F.array_distinct(both)).alias("term"), "id")


def directory_many(requests: DataFrame, facilities: DataFrame, grams: DataFrame | None = None) -> DataFrame:
    """request_id, id, rank (from 1): what directory gives each of many requests (request_id, uf, city, service, q, limit, offset; null or empty asks for nothing).

    Equal requests are answered once. One with a text goes by its rarest gram, one without by the names of cities that contain its city, else by its state: three equi-joins, and then all of its
    conditions in full. Requests with none of the three, or with a service that is none, have no rows; a limit is 100 if it isn't given and 500 at most, and negative ones give nothing.
    What meets a request is ranked in SLICES first, of which only as many go on as some request lists, so that no task reads all that a common text meets. grams: text_grams, if they are stored.
    """
    blank = lambda c: F.nullif(F.col(c), F.lit(""))
    given = requests.select("request_id", F.upper(blank("uf")).alias("uf"), search_key(blank("city")).alias("city"), blank("service").alias("service"), F.lower(blank("q")).alias("q"), F.coalesce("limit", F.lit(100)).alias("limit"), F.coalesce("offset", F.lit(0)).alias("offset"))
    given = given.withColumn("ask", F.struct("uf", "city", "service", "q"))
    asks = given.select("ask").distinct().select("ask", "ask.*").withColumn("wanted", canonical_service(F.col("service")))
    asks = asks.where("service IS NULL OR wanted IS NOT NULL")
    there = facilities.select("id", F.col("uf").alias("_uf"), "municipio", "unidade", "endereco", search_key(F.col("municipio")).alias("_city"), services(F.col("atendimentos_raw")).alias("_services"))

    grams = text_grams(facilities) if grams is None else grams
    texts = asks.where("q IS NOT NULL")
    own = texts.select("q").distinct().select("q", F.explode(index.own_grams(F.col("q"))).alias("term"))
    counts = grams.join(own.select("term").distinct(), "term", "left_semi").groupBy("term").agg(F.count(F.lit(1)).alias("n"))
    rarest = own.join(counts, "term", "left").groupBy("q").agg(F.min_by("term", F.struct(F.coalesce("n", F.lit(0)), F.col("term"))).alias("term"))
    by_text = texts.join(rarest, "q").join(grams, "term").join(there, "id")

    names = there.select("_city").distinct()
    cities = asks.where("q IS NULL AND city IS NOT NULL")
    met = cities.select("city").distinct().withColumn("term", index.own_grams(F.col("city"))[0]).join(names.select("_city", F.explode(index.grams(F.col("_city"))).alias("term")), "term")
    by_city = cities.join(met.where(F.contains("_city", "city")).select("city", "_city"), "city").join(there, "_city")
    states_asked = asks.where("q IS NULL AND city IS NULL AND uf IS NOT NULL")
    by_state = states_asked.join(there, states_asked["uf"] == there["_uf"])

    columns = ["ask", "uf", "city", "wanted", "q", *there.columns]
    pairs = by_text.select(*columns).unionByName(by_city.select(*columns)).unionByName(by_state.select(*columns))
    meets = (F.col("uf").isNull() | (F.col("uf") == F.col("_uf"))) & (F.col("city").isNull() | F.contains("_city", "city")) & (F.col("wanted").isNull() | F.array_contains("_services", F.col("wanted")))
    text = F.col("q").isNull() | F.contains(F.lower("unidade"), F.col("q")) | F.coalesce(F.contains(F.lower("endereco"), F.col("q")), F.lit(False))
    place = F.row_number().over(Window.partitionBy("ask").orderBy("municipio", "unidade", "id"))
    most = given.groupBy("ask").agg(F.max(F.col("offset") + F.least("limit", F.lit(500))).alias("most"))
    bound = given.where("limit >= 0 AND offset >= 0").agg(F.max(F.col("offset") + F.least("limit", F.lit(500)))).first()[0] or 0
    in_slice = F.row_number().over(Window.partitionBy("ask", "slice").orderBy("municipio", "unidade", "id"))
    met = pairs.where(meets & text).select("ask", "municipio", "unidade", "id", F.pmod(F.xxhash64("id"), F.lit(SLICES)).alias("slice"))
    first = met.withColumn("_in_slice", in_slice).where(F.col("_in_slice") <= F.lit(bound)).drop("_in_slice", "slice")
    listed = first.withColumn("place", place).join(most, "ask").where("place <= most").select("ask", "id", "place")
    out = given.where("limit >= 0 AND offset >= 0").join(listed, "ask")
    rank = F.col("place") - F.col("offset")
    return out.where((rank > 0) & (rank <= F.least("limit", F.lit(500)))).select("request_id", "id", rank.cast("int").alias("rank"))


def folded_contains(c: Column, part: Column) -> Column:
    """Whether a text contains another, without regard to accents and case."""
    return F.contains(search_key(c), search_key(part))


def lookup(requests: DataFrame, facilities: DataFrame, key: str = "id") -> DataFrame:
    """Every request with its facility's columns and `found`; not found is a result of its own."""
    return requests.join(facilities.withColumn("_f", F.lit(True)), key, "left").withColumn("found", F.coalesce("_f", F.lit(False))).drop("_f")


def states(dimension: DataFrame, control: DataFrame) -> DataFrame:
    """All states by uf, with whether their rows came from OCR."""
    return dimension.join(control.select("uf", "total", "status"), "uf", "left").withColumn("requires_review", F.coalesce(F.col("status") == "ok_ocr", F.lit(False))).orderBy("uf")


def inverted_index(facilities: DataFrame) -> DataFrame:
    """token, id: a row for each token of each facility's unit and address (a posting; a token's postings can be as many as facilities)."""
    tokens = F.array_distinct(F.filter(F.split(search_key(squeeze(F.concat_ws(" ", "unidade", "endereco"))), "[^a-z0-9]+"), lambda t: t != ""))
    return facilities.select("id", F.explode(tokens).alias("token"))


def find_all(queries: DataFrame, index: DataFrame) -> DataFrame:
    """query_id, id: facilities that have all tokens of a query (query_id, token)."""
    wanted = queries.distinct()
    need = wanted.groupBy("query_id").agg(F.count(F.lit(1)).alias("need"))
    hits = wanted.join(index, "token").groupBy("query_id", "id").agg(F.count(F.lit(1)).alias("have"))
    return hits.join(need, "query_id").where("have = need").select("query_id", "id")


def resolve_origins(requests: DataFrame, codes: DataFrame) -> DataFrame:
    """requests (request_id, lat, lng, cep, cidade, uf, and service if there is one) with the origin: its coordinates, city, uf and source.

    Coordinates come first (0.0 is one), then a postal code with coordinates, then a postal code's city, then the city; source is coords, cep,
    cep_sem_coords, cidade, or error where nothing is given or the code isn't known.
    """
    c = codes.select("cep", F.col("lat").alias("_lat"), F.col("lng").alias("_lng"), F.col("cidade").alias("_city"), F.col("uf").alias("_uf"), F.lit(True).alias("_known"))
    r = requests.join(c, "cep", "left")
    own = F.col("lat").isNotNull() & F.col("lng").isNotNull() & ~F.isnan("lat") & ~F.isnan("lng")
    by_code = F.col("cep").isNotNull()
    placed = F.col("_lat").isNotNull() & F.col("_lng").isNotNull()
    source = F.when(own, "coords").when(by_code & F.col("_known") & placed, "cep").when(by_code & F.col("_known"), "cep_sem_coords").when(by_code, "error").when(F.col("cidade").isNotNull(), "cidade").otherwise("error")
    r = r.withColumn("source", source)
    is_code = F.col("source").isin("cep", "cep_sem_coords")
    return r.select(
        "request_id",
        F.when(F.col("source") == "coords", F.col("lat")).when(F.col("source") == "cep", F.col("_lat")).alias("lat"),
        F.when(F.col("source") == "coords", F.col("lng")).when(F.col("source") == "cep", F.col("_lng")).alias("lng"),
        F.when(F.col("source") == "cep_sem_coords", F.col("_city")).when(F.col("source") == "cidade", F.col("cidade")).alias("city"),
        F.when(is_code, F.coalesce("uf", "_uf")).otherwise(F.col("uf")).alias("uf"),
        "source",
        *[c for c in ("service",) if c in requests.columns],
    )


def city_fallback(origins: DataFrame, facilities: DataFrame, k: int = 20) -> DataFrame:
    """request_id, id, rank: for origins with a city and no coordinates, facilities whose city contains it (and of the origin's state and service, where it names one), by city and unit.

    Distinct names are matched by the first GRAM letters of the asked one, which a city that contains it has somewhere, and then in full: an equi-join. Facilities are ranked once for
    each city, state or any, and asked service or any, of which only the first k go on; equal requests are answered once.
    """
    asked = origins.where(F.col("lat").isNull() & F.col("city").isNotNull()).withColumn("_key", search_key(F.col("city")))
    by_service = "service" in origins.columns
    wanted_service = canonical_service(F.col("service")) if by_service else F.lit(None).cast("string")
    asked = asked.select("request_id", "_key", F.upper("uf").alias("_state"), wanted_service.alias("_service"), *[F.col("service").isNotNull().alias("_named")] * by_service)
    if by_service:
        asked = asked.where(~F.col("_named") | F.col("_service").isNotNull()).drop("_named")  # a service that is none fits nothing
    ask = ["_key", "_state", "_service"]
    asks = asked.select(*ask).distinct()

    there = facilities.withColumn("_city", search_key(F.col("municipio")))
    offered = F.concat(F.array(F.lit(None).cast("string")), F.coalesce(services(F.col("atendimentos_raw")), F.array().cast("array<string>"))) if by_service else F.array(F.lit(None).cast("string"))
    states = F.when(F.col("uf").isNull(), F.array(F.lit(None).cast("string"))).otherwise(F.array(F.lit(None).cast("string"), F.col("uf")))
    listed = there.select("_city", "id", "municipio", "unidade", F.explode(states).alias("_state"), offered.alias("_offered")).select("_city", "id", "municipio", "unidade", "_state", F.explode("_offered").alias("_service"))
    order = ("municipio", "unidade", "id")
    first = listed.withColumn("_place", F.row_number().over(Window.partitionBy("_city", "_state", "_service").orderBy(*order))).where(F.col("_place") <= k).drop("_place")

    starts = F.sequence(F.lit(1), F.greatest(F.length("_city"), F.lit(1)))
    parts = F.concat(F.array(F.lit("")), *[F.transform(starts, _part(n)) for n in range(1, GRAM + 1)])
    cities = there.select("_city").distinct().select("_city", F.explode(F.array_distinct(parts)).alias("_part"))
    wanted = asks.select("_key").distinct().withColumn("_part", F.substring("_key", 1, GRAM))
    names = wanted.join(cities, "_part").where(F.contains("_city", "_key")).select("_key", "_city")

    def same(one: str, other: str, by: str) -> list[Column]:
        return [F.col(f"{one}.{c}").eqNullSafe(F.col(f"{other}.{c}")) for c in (by, "_state", "_service")]

    met = asks.join(names, "_key").alias("a").join(first.alias("f"), same("a", "f", "_city"))
    place = F.row_number().over(Window.partitionBy(*ask).orderBy(*order))
    answers = met.select("a._key", "a._state", "a._service", *order).select(*ask, "id", place.alias("rank")).where(F.col("rank") <= k)
    return asked.alias("q").join(answers.alias("r"), same("q", "r", "_key")).select("request_id", "id", "rank")


def _part(n: int):
    return lambda at: F.substring("_city", at, F.lit(n))
