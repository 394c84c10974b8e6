"""Reconciling a snapshot with the stored table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KEY = ["uf", "municipio", "unidade", "cnes"]
GEO = ["lat", "lng", "geocode_fonte", "geocode_em"]
STATUS = "geocode_status"


def merge(stored: DataFrame, incoming: DataFrame, now: Column | None = None) -> DataFrame:
    """One row for each change: op (insert, update, delete), id, seq, all other columns of stored (and geocode_status), address_changed, changed.

    Keys compare with null as the empty text. Of stored rows that share a key the one with the largest id counts and the others are deleted; of incoming
    rows that share a key of a stored row, the last one does; new ones are all inserted, duplicates too. An update takes the columns that incoming has and
    keeps the others; coordinates and their status stay unless the address changed, then they are null and `pendente`. Inserted rows are `pendente`
    and get ids from number_inserts. Where stored has atualizado_em, now (if given) goes there.
    """
    keys = [f"_k{i}" for i in range(len(KEY))]
    blank = {k: F.coalesce(c, F.lit("")) for k, c in zip(keys, KEY, strict=True)}
    columns = [c for c in stored.columns if c != "id"]
    old, new = stored.withColumns(blank), incoming.withColumns(blank)
    # the last row of each key is a partial aggregate: a key with very many rows sends one row a task
    last_old = old.groupBy(*keys).agg(F.max_by(F.struct("id", *columns), "id").alias("old"))
    last_new = new.groupBy(*keys).agg(F.max_by(F.struct(*incoming.columns), "seq").alias("new"))
    matched = last_old.join(last_new, keys, "left").select("old", "new", F.when(F.col("new").isNull(), "delete").otherwise("update").alias("op"))
    fresh = new.join(last_old.select(*keys), keys, "left_anti").select(F.lit(None).cast(matched.schema["old"].dataType).alias("old"), F.struct(*incoming.columns).alias("new"), F.lit("insert").alias("op"))
    doubled = old.join(last_old.select(F.col("old.id").alias("id")), "id", "left_anti").select(F.struct("id", *columns).alias("old"), F.lit(None).cast(matched.schema["new"].dataType).alias("new"), F.lit("delete").alias("op"))
    rows = matched.unionByName(fresh).unionByName(doubled)

    update, insert, delete = (F.col("op") == op for op in ("update", "insert", "delete"))
    moved = update & (F.coalesce("new.endereco", F.lit("")) != F.coalesce("old.endereco", F.lit("")))
    given = [c for c in columns if c in incoming.columns]
    differs = F.lit(False)
    for c in given:
        differs = differs | ~F.col(f"old.{c}").eqNullSafe(F.col(f"new.{c}"))

    def value(c: str) -> Column:
        if c in GEO:
            return F.when(update & ~moved, F.col(f"old.{c}"))
        if c == "atualizado_em" and now is not None:
            return F.when(delete, F.col(f"old.{c}")).otherwise(now)
        if c in given:
            return F.when(delete, F.col(f"old.{c}")).otherwise(F.col(f"new.{c}"))
        return F.col(f"old.{c}")

    before = F.col(f"old.{STATUS}") if STATUS in columns else F.when(F.col("old.lat").isNotNull(), "ok").otherwise("pendente")
    status = F.when(insert | moved, "pendente").otherwise(before)
    return rows.select("op", F.col("old.id").alias("id"), F.col("new.seq").alias("seq"), *[value(c).alias(c) for c in columns if c != STATUS], status.alias(STATUS), moved.alias("address_changed"), (~update | differs).alias("changed"))


#: The rows that a task numbers.
SLICE_ROWS = 200_000


def number_inserts(changes: DataFrame, first: int, slices: int | None = None) -> DataFrame:
    """changes with ids first, first + 1, ... for inserts in the order of seq: rows are ranked in slices (of about SLICE_ROWS) between sampled quantiles, never all in one task."""
    inserts = changes.where("op = 'insert'")
    slices = slices or 1 + inserts.count() // SLICE_ROWS
    cuts = sorted(set(inserts.approxQuantile("seq", [i / slices for i in range(1, slices)], 0.2 / slices))) if slices > 1 else []
    at = sum((F.when(F.col("seq") > c, 1).otherwise(0) for c in cuts), F.lit(0))
    inserts = inserts.withColumn("_slice", at)
    starts = inserts.groupBy("_slice").count()  # slices rows at most
    starts = starts.select("_slice", F.coalesce(F.sum("count").over(Window.orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_start"))
    numbered = inserts.withColumn("_n", F.row_number().over(Window.partitionBy("_slice").orderBy("seq", *KEY))).join(F.broadcast(starts), "_slice")
    kind = changes.schema["id"].dataType
    return numbered.withColumn("id", (F.lit(first - 1) + F.col("_start") + F.col("_n")).cast(kind)).select(*changes.columns).unionByName(changes.where("op <> 'insert'"))


def apply(stored: DataFrame, changes: DataFrame) -> DataFrame:
    """The stored table, with all its columns, after changes whose inserts have ids; applying them again changes nothing."""
    untouched = stored.join(changes.select("id"), "id", "left_anti").select(*stored.columns)
    return untouched.unionByName(changes.where("op <> 'delete'").select(*stored.columns))


def control_rows(incoming: DataFrame, ocr: Column | None = None, sources: DataFrame | None = None, now: Column | None = None) -> DataFrame:
    """Per uf: total of incoming rows (duplicates too), status ok or ok_ocr, no error; the document's hash and time from sources (uf, pdf_hash, site_ts), and now."""
    from_ocr = F.bool_or(ocr) if ocr is not None else F.lit(False)
    out = incoming.groupBy("uf").agg(F.count(F.lit(1)).alias("total"), F.when(from_ocr, "ok_ocr").otherwise("ok").alias("status"), F.lit(None).cast("string").alias("ultimo_erro"))
    if sources is not None:
        out = out.join(sources.select("uf", "pdf_hash", F.col("site_ts").alias("atualizado_em")), "uf", "left")
    return out if now is None else out.withColumn("sincronizado_em", now)


def error_rows(failures: DataFrame) -> DataFrame:
    """uf, status and message of failed keys: nao_suportado if the message names XLSX, else erro; 500 characters of it."""
    return failures.select("uf", F.when(F.col("message").contains("XLSX"), "nao_suportado").otherwise("erro").alias("status"), F.substring("message", 1, 500).alias("ultimo_erro"))


def run_summary(statuses: DataFrame) -> DataFrame:
    """One row: counts by status, sorted keys read by OCR, unsupported and failed, and whether the run failed."""
    ok, ocr = F.col("status").isin("ok", "ok_ocr", "inalterado"), F.col("status") == "ok_ocr"
    bad, unsupported = F.col("status") == "erro", F.col("status") == "nao_suportado"

    def names(rule: Column) -> Column:
        return F.array_sort(F.collect_list(F.when(rule, F.col("uf"))))

    return statuses.agg(
        F.count_if(ok).alias("successes"),
        F.count_if(bad).alias("errors"),
        F.count_if(unsupported).alias("unsupported"),
        names(ocr).alias("ocr_keys"),
        names(unsupported).alias("unsupported_keys"),
        names(bad).alias("error_keys"),
        ((F.count_if(ok) == 0) & (F.count_if(bad | unsupported) > 0)).alias("failed"),
    )


def needs_review(source: Column) -> Column:
    return source == "pdf_ocr"
