"""Near-duplicate vectors: cross-polytope hashing after fast Hadamard rotations, with multiprobe buckets; every pair that buckets propose is verified.

A hash flips signs at random and applies a fast Hadamard transform, three times, and takes the axis closest to the vector: the place and sign of its largest
component. A key joins POLYTOPES such hashes (in 64 dimensions 128^3 buckets for each label); a vector has, in each of TABLES tables, the PROBES keys
that lose least, its own among them, and two vectors are candidates if any of their keys is the same. Of pairs with a cosine of just 0.93 in 64 dimensions, about 84 % share a key in a table and
99.9 % in four (tests measure it); more tables or probes raise it, more hashes a key keep buckets small where a label has more than some 10^7 vectors.

Vectors with equal components are one class with a weight. Vectors within half the angle of the threshold of a centre are a ball: all of its members are linked, so none of them
are compared, and a ball with thousands of members has each of its keys once. Two balls are linked wholly, or not at all, where their centres' angle and radii say so;
otherwise their members are compared in cells of CELL by CELL, which return counts. A class that is in no ball is a ball of radius 0. So no pairs within a
group of near copies are listed; all pairs are compared only of vectors that no ball holds.

Defined results: only vectors of equal labels and lengths are compared. Vectors that are null or zero, or hold null or non-finite components, and those with a null label or identifier link with
nothing; a null identifier has a null component_id. Rows that repeat an identifier are vectors each: they may link with one another, and all of those with the smallest identifier of their component are
kept. Only the three columns are read, so others can't clash. An empty table gives an empty result.
"""

from __future__ import annotations

import functools
import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from waymark.llm.common import stash
from waymark.llm.components import components

LEAST, TABLES, POLYTOPES, PROBES = 0.93, 4, 3, 8
ROTATIONS, NEAREST, ROUNDS = 3, 8, 2
CELL, BLOCK = 1000, 2000
SURE = 1e-6  # radians by which bounds on balls must hold, far beyond rounding
ALL, SOME = 2, 1


def hadamard(x: np.ndarray) -> np.ndarray:
    """Rows times the Hadamard matrix of their width, a power of two."""
    n, width = x.shape
    step = 1
    while step < width:
        x = x.reshape(n, -1, 2, step)
        x = np.stack([x[:, :, 0] + x[:, :, 1], x[:, :, 0] - x[:, :, 1]], 2).reshape(n, width)
        step *= 2
    return x


@functools.cache
def signs(width: int, table: int, polytope: int) -> np.ndarray:
    return np.random.default_rng([12, width, table, polytope]).choice([-1.0, 1.0], (ROTATIONS, width))


def keys(units: np.ndarray, salt: np.ndarray, tables: int, polytopes: int, probes: int) -> np.ndarray:
    """(rows, tables * probes) keys of unit vectors, a table's own key first of its probes; salt sets labels apart."""
    n, width = len(units), 1 << max(0, int(units.shape[1] - 1).bit_length())
    units = np.pad(units, ((0, 0), (0, width - units.shape[1])))
    nearest = min(NEAREST, width)
    out = np.empty((n, tables * probes), np.uint64)
    for t in range(tables):
        code, loss = salt[:, None] + np.uint64(t), np.zeros((n, 1))
        for p in range(polytopes):
            turned = units
            for flip in signs(width, t, p):
                turned = hadamard(turned * flip) / math.sqrt(width)
            size = np.abs(turned)
            axis = np.argsort(-size, 1, kind="stable")[:, :nearest]
            length = np.take_along_axis(size, axis, 1)
            vertex = (2 * axis + (np.take_along_axis(turned, axis, 1) < 0)).astype(np.uint64)
            loss = (loss[:, :, None] + (length[:, None, :1] - length[:, None, :]) ** 2).reshape(n, -1)
            code = _mixed((code[:, :, None] * np.uint64(2 * width + 1) + vertex[:, None, :] + np.uint64(p)).reshape(n, -1))
            best = np.argsort(loss, 1, kind="stable")[:, :probes]
            loss, code = np.take_along_axis(loss, best, 1), np.take_along_axis(code, best, 1)
        out[:, t * probes : (t + 1) * probes] = code[:, np.arange(probes) % code.shape[1]]  # few axes have fewer probes
    return out


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def unit(rows: np.ndarray) -> np.ndarray:
    """Rows of non-zero finite doubles, divided by their length; scaled first, so that no square leaves a double's range."""
    rows = rows / np.abs(rows).max(1, keepdims=True)
    return rows / np.linalg.norm(rows, axis=1, keepdims=True)


def _matrix(lists: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Lists of one length as rows of doubles."""
    lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
    return np.asarray(lists.flatten()).astype(np.float64).reshape(len(lists), -1)


def _by_length(lists: pa.Array) -> Iterator[np.ndarray]:
    """The numbers of rows, BLOCK of one length at a time."""
    length = np.asarray(pc.fill_null(pc.list_value_length(lists), -1))
    for n in np.unique(length):
        own = np.flatnonzero(length == n)
        yield from (own[at : at + BLOCK] for at in range(0, len(own), BLOCK))


def _labelled(vectors: DataFrame) -> DataFrame:
    """id, vector, label and digest (of label and components; null where the vector takes no part)."""
    bad = F.exists("vector", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    zero = ~F.exists("vector", lambda x: x != 0)
    fit = F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("vector").isNotNull() & ~F.coalesce(bad, F.lit(True)) & ~F.coalesce(zero, F.lit(True))
    out = T.StructType([*vectors.schema.fields, T.StructField("digest", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            digests = []
            for label, vector, ok in zip(batch.column("label").to_pylist(), batch.column("vector"), batch.column("fit").to_pylist(), strict=True):
                digests.append(hashlib.blake2b(repr(label).encode() + b"\0" + (np.asarray(vector.values).astype(np.float64) + 0.0).tobytes(), digest_size=16).digest() if ok else None)
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in out.names[:-1]], pa.array(digests, pa.binary())], names=out.names)

    return vectors.withColumn("fit", fit).mapInArrow(run, out)


def _hashed(classes: DataFrame, tables: int, polytopes: int, probes: int) -> DataFrame:
    """classes (id, c, label, vector) with keys."""
    out = T.StructType([*classes.schema.fields, T.StructField("keys", T.ArrayType(T.LongType(), False))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("vector")
            got = np.zeros((batch.num_rows, tables * probes), np.uint64)
            for own in _by_length(lists):
                rows = _matrix(lists.take(pa.array(own)))
                salt = [int.from_bytes(hashlib.blake2b(f"{rows.shape[1]} {x!r}".encode(), digest_size=8).digest(), "little") for x in batch.column("label").take(pa.array(own)).to_pylist()]
                got[own] = keys(unit(rows), np.array(salt, np.uint64), tables, polytopes, probes)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(batch.num_rows + 1) * got.shape[1], pa.int32()), pa.array(got.view(np.int64).ravel()))
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in out.names[:-1]], lists], names=out.names)

    return classes.mapInArrow(run, out)


def _compared(pairs: DataFrame, judge, into: str, kind: str) -> DataFrame:
    """pairs (with vectors v, w of labels lv, lw, which must be equal) with a number made by judge(cosines, batch), without the vectors."""
    pairs = pairs.where("lv = lw").drop("lv", "lw")  # labels share a key by chance alone
    kept = [c for c in pairs.columns if c not in ("v", "w")]
    out = T.StructType([*[pairs.schema[c] for c in kept], T.StructField(into, T.DoubleType() if kind == "double" else T.IntegerType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cosine = np.full(batch.num_rows, -1.0)  # so do vectors of different length
            v, w = batch.column("v"), batch.column("w")
            same = np.asarray(pc.equal(pc.list_value_length(v), pc.list_value_length(w)))
            for own in _by_length(v):
                own = own[same[own]]
                if len(own):
                    cosine[own] = (unit(_matrix(v.take(pa.array(own)))) * unit(_matrix(w.take(pa.array(own))))).sum(1)
            got = judge(cosine, batch)
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], pa.array(got, pa.float64() if kind == "double" else pa.int32())], names=out.names)

    return pairs.mapInArrow(run, out)


def angles(cosine: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(cosine, -1, 1))


def _balls(classes: DataFrame, least: float, probes: int, rounds: int) -> DataFrame:
    """id, ball, angle for the members of balls (without their centres)."""
    half = math.acos(least) / 2 - SURE
    own = F.filter("keys", lambda _, i: i % probes == 0)
    keyed = stash(classes.select("id", F.explode(own).alias("key")), "own-keys")
    left = classes.select("id", F.col("vector").alias("v"), F.col("label").alias("lv"))
    right = classes.select(F.col("id").alias("hub"), F.col("vector").alias("w"), F.col("label").alias("lw"))
    members = None
    for _ in range(rounds):
        hubs = keyed.groupBy("key").agg(F.min("id").alias("hub"), F.max("id").alias("last")).where("hub < last").drop("last")
        stars = keyed.join(hubs, "key").where("hub < id").select("id", "hub").distinct()
        pairs = stars.join(left, "id").join(right, "hub")
        near = stash(_compared(pairs, lambda cosine, _: angles(cosine), "angle", "double").where(F.col("angle") <= half), "stars", few=True)
        centred = near.join(near.select(F.col("id").alias("hub")).distinct(), "hub", "left_anti")  # a centre is no other ball's member
        found = centred.groupBy("id").agg(F.min(F.struct("hub", "angle")).alias("at")).select("id", F.col("at.hub").alias("ball"), F.col("at.angle").alias("angle"))
        found = stash(found, "members", few=True)
        members = found if members is None else members.unionByName(found)
        taken = found.select("id").unionByName(found.select(F.col("ball").alias("id"))).distinct()
        keyed = keyed.join(taken, "id", "left_anti")
    return members


def _cell_counts(part: DataFrame, members: DataFrame, least: float) -> DataFrame:
    """id, a, b, links: for balls a, b that may be linked in part, how many rows of the other each of their members is linked with."""
    sizes = members.groupBy("ball").agg(F.ceil(F.count(F.lit(1)) / CELL).alias("cells"))
    grid = part.join(sizes.select(F.col("ball").alias("a"), F.col("cells").alias("rows")), "a").join(sizes.select(F.col("ball").alias("b"), F.col("cells").alias("columns")), "b")
    grid = stash(grid, "grid", few=True)

    def side(own: str, cells: str, across: str) -> DataFrame:
        i, j = F.pmod(F.xxhash64("id"), F.col(cells)), F.explode(F.sequence(F.lit(0).cast("long"), F.col(across) - 1))
        at = members.withColumnRenamed("ball", own).join(grid, own)
        return at.select(F.col("a").alias(f"{own}_a"), F.col("b").alias(f"{own}_b"), i.alias(f"{own}_own"), j.alias(f"{own}_other"), *[F.col(c).alias(f"{own}_{c}") for c in ("id", "c", "vector")])

    left, right = side("a", "rows", "columns"), side("b", "columns", "rows")
    id_type = members.schema["id"].dataType
    out = T.StructType([T.StructField("id", id_type), T.StructField("a", id_type), T.StructField("b", id_type), T.StructField("links", T.LongType())])

    def count(key: tuple, x: pa.Table, y: pa.Table) -> pa.Table:
        from pyspark.sql.pandas.types import to_arrow_schema

        schema = to_arrow_schema(out)
        if not x.num_rows or not y.num_rows:
            return schema.empty_table()
        linked = unit(_matrix(x.column("a_vector"))) @ unit(_matrix(y.column("b_vector"))).T >= least
        parts = []
        for own, table, links in (("a", x, linked @ np.asarray(y.column("b_c"))), ("b", y, np.asarray(x.column("a_c")) @ linked)):
            some = pa.array(np.flatnonzero(links))
            ids = table.column(f"{own}_id").combine_chunks().take(some)
            ends = [table.column(f"{own}_{c}").combine_chunks().take(some) for c in ("a", "b")]
            parts.append(pa.Table.from_arrays([ids, *ends, pa.array(links[np.asarray(some)].astype(np.int64))], schema=schema))
        return pa.concat_tables(parts)

    return left.groupBy("a_a", "a_b", "a_own", "a_other").cogroup(right.groupBy("b_a", "b_b", "b_other", "b_own")).applyInArrow(count, out)


def near_vectors(vectors: DataFrame, least: float = LEAST, tables: int = TABLES, polytopes: int = POLYTOPES, probes: int = PROBES, rounds: int = ROUNDS, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """vec_id, n_links, component_id and kept for every row of vectors."""
    if not 0 < least <= 1:
        raise ValueError("least is a cosine above 0")
    given = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).alias("vector"), F.col(label_col).alias("label"))
    if not given.where("id IS NOT NULL").groupBy("id").count().where("count > 1").isEmpty():  # such rows are told apart by what they hold
        own = F.struct(F.col("id").alias("id"), F.sha2(F.to_json(F.struct("vector", "label")), 256).alias("sha"))
        given = given.withColumn("id", F.when(F.col("id").isNotNull(), own))
        name = lambda x: F.col(x)["id"]
    else:
        name = F.col
    labelled = _labelled(given)
    rows = stash(labelled.select("id", "digest"), "rows")
    copies = rows.where("digest IS NOT NULL").groupBy("digest").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("c")).where("c > 1")
    copies = stash(copies, "copies", few=True)

    firsts = labelled.where("digest IS NOT NULL").join(copies, "digest", "left").where("rep IS NULL OR id = rep").select("id", F.coalesce("c", F.lit(1)).cast("long").alias("c"), "label", "vector")
    firsts = firsts if name is F.col else firsts.dropDuplicates(["id"])  # rows that repeat everything
    classes = stash(_hashed(firsts, tables, polytopes, probes), "classes")

    members = _balls(classes, least, probes, rounds)
    placed = classes.select("id", "c").join(members, "id", "left").select("id", "c", F.coalesce("ball", "id").alias("ball"), F.coalesce("angle", F.lit(0.0)).alias("angle"))
    placed = stash(placed, "placed")
    balls = stash(placed.groupBy("ball").agg(F.max("angle").alias("radius"), F.sum("c").alias("weight")), "balls")

    # a ball has each of its members' keys once
    keyed = classes.select("id", F.explode("keys").alias("key")).join(members.select("id", "ball"), "id", "left").select("key", F.coalesce("ball", "id").alias("ball"))
    shared = keyed.groupBy("key").agg(F.min("ball").alias("low"), F.max("ball").alias("high")).where("low < high").select("key")
    shared = stash(shared, "shared-keys", few=True)
    held = stash(keyed.join(shared, "key", "left_semi").distinct(), "held", few=True)
    pairs = held.select("key", F.col("ball").alias("a")).join(held.select("key", F.col("ball").alias("b")), "key").where("a < b").select("a", "b").distinct()
    centres = classes.select(F.col("id").alias("ball"), "vector", "label").join(balls.select("ball", "radius"), "ball")
    first = centres.select(F.col("ball").alias("a"), F.col("vector").alias("v"), F.col("label").alias("lv"), F.col("radius").alias("ra"))
    second = centres.select(F.col("ball").alias("b"), F.col("vector").alias("w"), F.col("label").alias("lw"), F.col("radius").alias("rb"))
    reach = math.acos(least)

    def judge(cosine: np.ndarray, batch: pa.RecordBatch) -> np.ndarray:
        radii = np.asarray(batch.column("ra")) + np.asarray(batch.column("rb"))
        angle = angles(cosine)
        bounds = np.where(angle + radii <= reach - SURE, ALL, np.where(angle - radii > reach + SURE, 0, SOME))
        return np.where(radii == 0, np.where(cosine >= least, ALL, 0), bounds)

    judged = stash(_compared(pairs.join(first, "a").join(second, "b"), judge, "how", "int").where("how > 0").select("a", "b", "how"), "judged", few=True)
    wholly = judged.where(F.col("how") == ALL).select("a", "b")
    both = wholly.unionByName(wholly.select(F.col("b").alias("a"), F.col("a").alias("b")))
    linked = both.join(balls.select(F.col("ball").alias("b"), "weight"), "b").groupBy("a").agg(F.sum("weight").alias("linked"))
    part = stash(_cell_counts(judged.where(F.col("how") == SOME).select("a", "b"), placed.select("id", "ball", "c").join(classes.select("id", "vector"), "id"), least), "cells", few=True)

    edges = wholly.unionByName(part.select("a", "b").distinct())
    whole = components(edges, "a", "b").withColumnRenamed("id", "ball")
    counted = part.groupBy("id").agg(F.sum("links").alias("some"))
    at_ball = balls.join(linked.withColumnRenamed("a", "ball"), "ball", "left").join(whole, "ball", "left")
    at_ball = at_ball.select("ball", (F.col("weight") - 1 + F.coalesce("linked", F.lit(0))).alias("links"), F.coalesce("component", "ball").alias("component"))
    at_class = placed.select("id", "ball").join(at_ball, "ball").join(counted, "id", "left").select(F.col("id").alias("rep"), (F.col("links") + F.coalesce("some", F.lit(0))).alias("n_links"), "component")

    out = rows.join(copies, "digest", "left").select("id", F.when(F.col("digest").isNotNull(), F.coalesce("rep", "id")).alias("rep")).join(at_class, "rep", "left")
    own, component = name("id"), F.coalesce(name("component"), name("id"))
    return out.select(own.alias("vec_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(own == component, F.lit(True)).alias("kept"))
