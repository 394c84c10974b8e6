"""Column functions on request logs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def ip_hash(ip: Column, salt: str) -> Column:
    """Sixteen hexadecimal digits for an address; null if it is unknown."""
    return F.when(ip.isNotNull() & (ip != "") & (ip != "unknown"), F.substring(F.sha2(F.concat(F.lit(salt), ip), 256), 1, 16))


def route(path: Column) -> Column:
    """The route of a request path: its query string gone, identifiers replaced by their names."""
    path = F.regexp_replace(path, r"\?.*$", "")
    path = F.regexp_replace(path, r"/v1/hospitais/\d+$", "/v1/hospitais/:id")
    return F.regexp_replace(path, r"/v1/estados/[A-Za-z]{2}$", "/v1/estados/:uf")


def text_field(c: Column, most: int) -> Column:
    """At most so many characters; empty is null."""
    return F.nullif(F.substring(c, 1, most), F.lit(""))


def flag(c: Column) -> Column:
    """A log's tri-state flag: anything but true and false is null."""
    return F.when(F.lower(c) == "true", True).when(F.lower(c) == "false", False)


def client_ip(forwarded: Column, real: Column, socket: Column) -> Column:
    first = F.trim(F.get(F.split(forwarded, ","), F.lit(0)))
    return F.coalesce(F.nullif(first, F.lit("")), F.nullif(real, F.lit("")), F.nullif(socket, F.lit("")), F.lit("unknown"))


def window_index(ts: Column, seconds: int = 60) -> Column:
    """Which fixed window since the epoch a time falls into."""
    return F.floor(F.unix_millis(ts) / (seconds * 1000))
