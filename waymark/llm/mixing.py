"""Mixing sources to target weights by Pfair scheduling.

Each source's rows are cut into blocks. With target share w, a whole number of parts out of their total, block k of a source may be placed no sooner than slot
floor(k / w) (its release time) and no later than just before slot ceil((k + 1) / w) (its deadline); taking at every slot the
released block with the earliest deadline keeps each source's placed blocks within one block of w * slots at any slot. Weights become whole parts of
2^40 for the largest one, and all arithmetic on them is exact.

The schedule is laid out in segments, each by itself. A segment starts LOOKBACK slots early, where LOOKBACK is the length of the longest window, from any state in which every source has
the whole part of what is due to it, or one block more: from then on, two schedules that take the earliest deadline differ only by blocks whose windows held that
slot, and these are over when the segment begins. So segments are those of one schedule from slot 0, whatever they started from.

When a source runs out, its later slots stay empty, so that the others go on in their own proportions; `balanced` is true up to
the first such slot. No row is left out or repeated.

Only DataFrame functions run. Sources may hold any share of the rows: places are numbered slice by slice, and a slice learns the slots of its blocks with its first place, so that rows are shuffled
once. There is a schedule's row for each block; its cost is that of slots times sources, and the slots are as many as the source that lasts longest needs.

Defined results: rows with a null source form a source of their own; null and repeated identifiers are ranked in either order; sources without a weight, or with one that isn't a positive number, get the least of
the weights that are (all the same, if none is). An empty table gives an empty result. Any number of sources up to 2^20.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from waymark.llm.common import hash_slice, shuffle_width, stash

BLOCK_ROWS, SEGMENT, LONGEST_SEGMENT, CHUNK = 32, 8192, 262_144, 256
PARTS, SOURCES = 2**40, 2**20


def shares(weights: DataFrame) -> DataFrame:
    """source, share: whole parts, PARTS for the largest weight, one at least."""
    w = F.col("weight").cast("double")
    good = F.when((w > 0) & (w < float("inf")), w)
    every = weights.agg(F.min(good).alias("least"), F.max(good).alias("most"))
    given = weights.select("source", good.alias("w")).join(F.broadcast(every))  # one row
    part = F.when(F.col("most").isNull(), F.lit(1)).otherwise(F.greatest(F.lit(1), F.round(F.coalesce("w", "least") / F.col("most") * PARTS)))
    return given.select("source", part.cast("long").alias("share"))


def _whole(c: Column | str) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("decimal(19,0)")


def schedule(sizes: DataFrame, segment: int | None = None) -> DataFrame:
    """source, k, slot of the blocks 0 .. n of each source (source, share, n): earliest deadline first, equal ones to the smaller source.

    Block n is the first that a source lacks. State is, for each source, u = slot * share - placed blocks * total: a source's next block is released if u + share > 0,
    and its deadline is ceil((total - u) / share) slots away.
    """
    numbered = sizes.agg(F.array_sort(F.collect_list(F.struct("source", "share", "n"))).alias("s"), F.sum("share").alias("total"))
    numbered = stash(numbered.where(F.size("s") > 0).select("s", "s.source", "s.share", "s.n", "total"), "parts")
    need = F.aggregate("s", F.lit(0).cast("long"), lambda a, x: F.greatest(a, _ceil(_whole(x["n"] + 1) * _whole("total"), _whole(x["share"]))))
    longest = F.ceil(F.col("total") / F.array_min("share")).cast("long") + 2
    size = F.least(F.greatest(longest, F.lit(SEGMENT)), F.lit(LONGEST_SEGMENT)) if segment is None else F.lit(segment)
    plan = numbered.select("share", "total", need.alias("slots"), longest.alias("longest"), size.cast("long").alias("size"))
    starts = plan.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("slots") - 1) / F.col("size")))).alias("segment"))
    first = F.greatest(F.lit(0).cast("long"), F.col("segment") * F.col("size") - F.col("longest"))
    starts = starts.withColumn("first", first)

    # the state at a segment's first slot: what is due, and a block more for those with the earliest deadlines, until all slots before are taken
    due = F.transform("share", lambda a: F.pmod(_whole("first") * _whole(a), _whole("total")).cast("long"))
    ahead = F.aggregate("due", F.lit(0).cast("decimal(38,0)"), lambda x, u: (x + u).cast("decimal(38,0)"))
    starts = starts.withColumn("due", due).withColumn("ahead", (ahead / F.col("total")).cast("long"))
    order = F.array_sort(F.array_compact(F.transform("due", lambda u, i: F.when(u > 0, _bid(u, F.get("share", i), i)))))
    starts = starts.withColumn("early", F.slice(order, F.lit(1), F.col("ahead").cast("int")))
    starts = starts.withColumn("u", F.transform("due", lambda u, i: u - F.when(F.array_contains(F.transform("early", _source), i), F.col("total")).otherwise(0)))
    # a task lays out one segment after another
    starts = starts.repartition(shuffle_width(sizes.sparkSession), "segment")

    before = F.col("segment") * F.col("size") - F.col("first")  # slots that only bring the state
    there = F.aggregate(_count(before), F.col("u"), lambda u, _: _step(u, lambda i: _moved(u, i)))
    laid = starts.withColumn("u", there)
    own = F.least(F.col("size"), F.col("slots") - F.col("segment") * F.col("size"))
    none = F.array().cast("array<struct<i:int,u:bigint>>")

    def chunk(state: Column, c: Column) -> Column:
        inner = F.struct(state["u"].alias("u"), none.alias("took"))

        def one(s: Column, _: Column) -> Column:
            return _step(s["u"], lambda i: F.struct(_moved(s["u"], i).alias("u"), F.array_append(s["took"], F.struct(i.alias("i"), F.get(s["u"], i).alias("u"))).alias("took")))

        return _let(F.aggregate(_count(F.least(F.lit(CHUNK).cast("long"), own - c * CHUNK)), inner, one), lambda x: F.struct(x["u"].alias("u"), F.array_append(state["all"], x["took"]).alias("all")))

    begin = F.struct(F.col("u").alias("u"), F.array().cast("array<array<struct<i:int,u:bigint>>>").alias("all"))
    took = F.flatten(F.aggregate(_count(F.ceil(own / CHUNK)), begin, chunk)["all"])
    slots = laid.select("total", (F.col("segment") * F.col("size")).alias("at"), F.posexplode(took).alias("p", "x")).select("total", (F.col("at") + F.col("p")).alias("slot"), F.col("x.i").alias("i"), F.col("x.u").alias("u"))
    sources = numbered.select(F.posexplode("s").alias("i", "x")).select("i", "x.*")
    k = F.expr("CAST(slot AS DECIMAL(19,0)) * CAST(share AS DECIMAL(19,0)) - u").cast("decimal(38,0)")
    placed = slots.join(sources, "i").withColumn("k", _floor(k, _whole("total")))
    return placed.where("k <= n").select("source", "k", "slot")


def _let(value: Column, use) -> Column:
    """use(value), with value worked out once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _count(n: Column) -> Column:
    """The numbers 0 .. n - 1."""
    return F.when(n > 0, F.sequence(F.lit(0).cast("long"), n.cast("long") - 1)).otherwise(F.array().cast("array<bigint>"))


def _floor(x: Column, y: Column) -> Column:
    return F.call_function("div", x, y).cast("long")


def _ceil(x: Column, y: Column) -> Column:
    return F.call_function("div", (x + y - 1).cast("decimal(38,0)"), y).cast("long")


def _bid(u: Column, share: Column, i: Column) -> Column:
    """A source's next deadline and then its number, in one number that compares as both."""
    return F.call_function("div", F.col("total") - u + share - 1, share) * SOURCES + i


def _source(bid: Column) -> Column:
    return (bid % SOURCES).cast("int")


def _step(u: Column, use) -> Column:
    """use(the source that has the slot)."""
    bids = F.transform(u, lambda x, i: _let(F.get("share", i), lambda a: F.when(x + a > 0, _bid(x, a, i))))
    return _let(_source(F.array_min(bids)), use)


def _moved(u: Column, i: Column) -> Column:
    """The state a slot later, when source i has had the slot."""
    return F.transform(u, lambda x, j: x + F.get("share", j) - F.when(i == j, F.col("total")).otherwise(0))


def mix(docs: DataFrame, weights: DataFrame | None = None, block_rows: int = BLOCK_ROWS, id_col: str = "doc_id", source_col: str = "source") -> DataFrame:
    """docs with block, slot, place, release, deadline and balanced (columns of these names are replaced).

    weights: source, weight; without it a source's weight is the square root of its number of rows. Sorting by (slot, place) gives
    the mixture. Within a source, rows come in the order of the MD5 of their identifier, which is as good as shuffled.
    """
    spark = docs.sparkSession
    new = ("block", "slot", "place", "release", "deadline", "balanced")
    docs = docs.drop(*new)
    digest = F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit("")))
    key = F.coalesce(F.concat(F.lit("="), F.col(source_col)), F.lit(""))  # null is a source of its own
    slices = 4 * shuffle_width(spark)
    rows = docs.withColumns({"_key": key, "_digest": digest}).withColumn("_slice", hash_slice(F.col("_digest"), slices))

    counts = stash(rows.groupBy("_key", "_slice").agg(F.count(F.lit(1)).alias("_n")), "counts", few=True)
    sizes = counts.groupBy(F.col("_key").alias("source")).agg(F.sum("_n").alias("rows"))
    if weights is None:
        weights = sizes.select("source", F.sqrt(F.col("rows").cast("double")).alias("weight"))
    else:
        given = weights.groupBy(F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit("")).alias("source")).agg(F.max("weight").alias("weight"))
        weights = sizes.join(given, "source", "left").select("source", "weight")
    parts = shares(weights).join(sizes, "source").select("source", "share", F.ceil(F.col("rows") / block_rows).alias("n"))
    parts = stash(parts, "shares", few=True)
    slots = stash(schedule(parts), "slots")

    ends = slots.join(parts, "source").where("k = n")
    horizon = ends.agg(F.min("slot")).first()[0] or 0  # one number
    total = parts.agg(F.sum("share")).first()[0] or 1

    # a slice's first place and the slots of its blocks
    before = Window.partitionBy("_key").orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("_key", "_slice", "_n", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    blocks = F.explode(F.sequence(F.floor(F.col("_start") / block_rows), F.floor((F.col("_start") + F.col("_n") - 1) / block_rows))).alias("k")
    held = starts.select(F.col("_key").alias("source"), "_slice", "_start", blocks).join(slots, ["source", "k"])
    held = held.groupBy(F.col("source").alias("_key"), "_slice", "_start").agg(F.sort_array(F.collect_list(F.struct("k", "slot"))).alias("_blocks"))
    held = held.join(parts.select(F.col("source").alias("_key"), F.col("share").alias("_share")), "_key")

    order = [F.asc_nulls_first(c) for c in ("_digest", id_col)]
    numbered = rows.withColumn("_in", F.row_number().over(Window.partitionBy("_key", "_slice").orderBy(*order)) - 1)
    at = numbered.join(held, ["_key", "_slice"]).withColumn("_rank", F.col("_start") + F.col("_in")).withColumn("block", F.floor(F.col("_rank") / block_rows))
    slot = F.get("_blocks", (F.col("block") - F.floor(F.col("_start") / block_rows)).cast("int"))["slot"]
    whole = F.lit(total).cast("decimal(19,0)")
    return at.select(
        *docs.columns,
        "block",
        slot.alias("slot"),
        (F.col("_rank") % block_rows).alias("place"),
        _floor(_whole("block") * whole, _whole("_share")).alias("release"),
        _ceil(_whole(F.col("block") + 1) * whole, _whole("_share")).alias("deadline"),
        (slot < F.lit(horizon)).alias("balanced"),
    )


def mixed_order(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", **how) -> DataFrame:
    """docs, with all their own columns, in the order of the mixture: range-partitioned and sorted by (slot, place)."""
    rows = docs.select(F.struct(*docs.columns).alias("_doc"), F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"))
    at = mix(rows, id_col="doc_id", source_col="source", **how)
    return at.repartitionByRange(shuffle_width(docs.sparkSession), "slot", "place").sortWithinPartitions("slot", "place").select("_doc.*")
