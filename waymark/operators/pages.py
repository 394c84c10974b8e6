"""Metadata of pages and documents: dates, links, formats, fingerprints, change detection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waymark.functions.text import squeeze


def updated_at(html: Column, offset: str = "-03:00") -> Column:
    """The time a page says it was updated at (`atualizado em`, a date, an hour as in 18h04), from local time; null if it doesn't say so or names no real time.

    Tags and white space of any kind may stand between the words.
    """
    text = F.lower(squeeze(F.regexp_replace(html, "<[^>]*>", " ")))
    said = F.regexp_extract(text, "atualizado em ([0-9/]{10} [0-9]{1,2}h[0-9]{2})", 1)
    return F.when(said != "", F.try_to_timestamp(F.concat(said, F.lit(offset)), F.lit("dd/MM/yyyy H'h'mmXXX")))


def document_link(html: Column) -> Column:
    """The first link to a document; if there is none, the last to a spreadsheet; else null."""
    links = F.regexp_extract_all(html, F.lit('href="([^"]*)"'), F.lit(1))
    documents = F.filter(links, lambda x: x.rlike(r"(?i)(\.pdf|/@@download/file)$"))
    sheets = F.filter(links, lambda x: x.rlike(r"(?i)\.xlsx$"))
    return F.coalesce(F.get(documents, F.lit(0)), F.try_element_at(sheets, F.lit(-1)))


def resolve(base: Column, href: Column) -> Column:
    """An absolute address for a link of a page."""
    origin = F.regexp_extract(base, r"^([a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*)", 1)
    path = F.regexp_replace(base, r"[?#].*$", "")
    folder = F.when(path == origin, F.concat(path, F.lit("/"))).otherwise(F.regexp_replace(path, r"[^/]*$", ""))
    return (
        F.when(href.rlike(r"^[a-zA-Z][a-zA-Z0-9+.-]*://"), href)
        .when(href.startswith("//"), F.concat(F.regexp_extract(base, r"^([^:]*:)", 1), href))
        .when(href.startswith("/"), F.concat(origin, href))
        .when(href.isNotNull(), F.concat(folder, href))
    )


def route_format(content_type: Column, link: Column) -> Column:
    """direct, link, unsupported (a spreadsheet alone) or error (nothing)."""
    return (
        F.when(F.lower(content_type).contains("pdf"), "direct")
        .when(link.rlike(r"(?i)\.xlsx$"), "unsupported")
        .when(link.isNotNull(), "link")
        .otherwise("error")
    )


def fingerprint(content: Column) -> Column:
    return F.sha2(content, 256)


def changed(now: DataFrame, before: DataFrame, key: str, force: bool = False, hash_first: bool = False) -> DataFrame:
    """now (key, site_ts, hash) with `changed`: no earlier time, a later one, another hash, or force.

    hash_first: an equal hash settles it, also where no time is known.
    """
    old = before.select(F.col(key), F.col("site_ts").alias("_ts"), F.col("hash").alias("_hash"))
    other = ~F.col("hash").eqNullSafe(F.col("_hash"))
    newer = F.col("_ts").isNull() | F.coalesce(F.col("site_ts") > F.col("_ts"), F.lit(False))
    rule = other if hash_first else newer | other
    return now.join(old, key, "left").withColumn("changed", F.lit(force) | rule).drop("_ts", "_hash")


def scanned(pages: DataFrame, key: str = "doc_id") -> DataFrame:
    """Per document: whether all its pages have images and no words (also true of none)."""
    return pages.groupBy(key).agg(F.coalesce(F.bool_and((F.col("n_words") == 0) & (F.col("n_images") > 0)), F.lit(True)).alias("scanned"))
