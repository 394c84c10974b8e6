"""Ranked lexical search by pipelined term partitioning.

Items (queries) are put together in bundles. Every term has one owner; owners take the terms by their share of documents, the rarest first. A bundle visits the owners one
after another, in every slice of the documents: it carries its items' sparse accumulators (item, document, score), and at an owner a cogroup meets it with that owner's
postings of the slice, whose integer contributions are added. As rare terms come first, accumulators are few until the last owner, the one with the frequent terms, which
selects each item's k best of the slice; these are merged at the end. Every document is scored for every item.

Two passes read the texts. The first one counts documents, terms and the documents that hold each item's term; the second one writes a document's postings, in a column for each owner. Both know the
items' terms by a table of SLOTS slots of their hash, whatever their number: a slot that another word shares costs a posting that nothing meets. Slices hold
consecutive rows of a task, SLICE_DOCS documents or about SLICE_POSTINGS postings at most, so that no group depends on what documents hold; a bundle has about BUNDLE_ITEMS items.

Terms are runs of ASCII letters and digits and of characters beyond ASCII, only A-Z lower-cased. N documents have a term, L terms altogether; n, df, tf as usual:
a term's weight is floor(1000 ln((2N + 2) / (2df + 1))), a document's m is 100 - B + (B n N) div L, and a term adds weight * ((10^9 tf) div (1000 tf + 20 m)).

Defined results: null and empty texts have no terms and aren't counted. Repeated documents are documents each; of equal scores the smaller identifier is first, null is the
last. Items that repeat an identifier are one item with the terms of all; an item with a null identifier or without terms has no result. Documents without any of an item's terms aren't
returned. Texts are read whole, long ones in blocks. Only identifiers and texts are read, so other columns can't clash. Empty tables give an empty result.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from waymark.llm.common import shuffle_width, sliced, stash

K, B = 50, 50
SLOTS = 2**18
#: The largest share of documents that a term of each owner but the last is in.
SHARES = (0.01, 0.05, 0.2)
BUNDLE_ITEMS, SLICE_DOCS, SLICE_POSTINGS = 512, 4096, 1_000_000
SLICE_BYTES, BLOCK, REMEMBERED = 2_000_000, 1_000_000, 300_000

TO_TERMS = bytes(c + 32 if 65 <= c <= 90 else c if chr(c).isdigit() and c < 128 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def term_counts(text: bytes, block: int = BLOCK) -> Counter:
    """How often each term is in a text."""
    text = text.translate(TO_TERMS)
    if len(text) <= block:
        return Counter(text.split())
    counts, at = Counter(), 0
    while at < len(text):
        to = text.find(b" ", at + block)
        to = len(text) if to < 0 else to
        counts.update(text[at:to].split())
        at = to
    return counts


class Slots:
    """What a table says of a term's slot, with a bounded memory of terms seen."""

    def __init__(self, says: bytes):
        self.says, self.seen = says, {}

    def of(self, term: bytes) -> int:
        got = self.seen.get(term)
        if got is None:
            if len(self.seen) >= REMEMBERED:
                self.seen.clear()
            got = self.seen[term] = self.says[zlib.crc32(term) % len(self.says)]
        return got


def _texts(rows: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return rows.select(F.col(id_col).alias("id"), F.encode(F.coalesce(F.col(text_col), F.lit("")), "UTF-8").alias("text"))


def item_terms(items: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """item_id, term: each of an item's terms once."""
    out = T.StructType([T.StructField("item_id", items.schema[id_col].dataType), T.StructField("term", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, 1, SLICE_BYTES):
            terms = pa.array([list(term_counts(t)) for t in batch.column(1).to_pylist()], pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pc.list_parent_indices(terms)), terms.flatten()], names=out.names)

    return _texts(items.where(F.col(id_col).isNotNull()), id_col, text_col).mapInArrow(run, out).distinct()


def statistics(docs: DataFrame, slots: bytes, id_col: str, text_col: str) -> DataFrame:
    """term, docs, terms: documents that hold a term of a marked slot; at the null term, documents with terms and all their terms."""
    shared = docs.sparkSession.sparkContext.broadcast(slots)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marks, df, whole = Slots(shared.value), Counter(), [0, 0]

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array([None, *df], pa.string()), pa.array([whole[0], *df.values()], pa.int64()), pa.array([whole[1], *[0] * len(df)], pa.int64())], names=["term", "docs", "terms"])
            df.clear()
            whole[:] = 0, 0
            return out

        for batch in sliced(batches, 1, SLICE_BYTES):
            for text in batch.column(1).to_pylist():
                counts = term_counts(text)
                whole[0] += bool(counts)
                whole[1] += counts.total()
                df.update([t for t in counts if marks.of(t)])
            if len(df) >= REMEMBERED:
                yield flush()
        yield flush()

    made = _texts(docs, id_col, text_col).mapInArrow(run, "term string, docs long, terms long")
    return made.groupBy("term").agg(F.sum("docs").alias("docs"), F.sum("terms").alias("terms"))


def postings(docs: DataFrame, owner_of: bytes, owners: int, n_docs: int, n_terms: int, id_col: str, text_col: str) -> DataFrame:
    """slice, place (in the slice), doc_id, m, and for each owner t (terms) and f (their occurrences), for every document with a term of a marked slot."""
    shared = docs.sparkSession.sparkContext.broadcast(owner_of)
    lists = [f for o in range(owners) for f in (T.StructField(f"t{o}", T.ArrayType(T.StringType())), T.StructField(f"f{o}", T.ArrayType(T.LongType())))]
    out = T.StructType([T.StructField("slice", T.LongType()), T.StructField("place", T.IntegerType()), T.StructField("doc_id", docs.schema[id_col].dataType), T.StructField("m", T.LongType()), *lists])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marks = Slots(shared.value)
        at, place, held = TaskContext.get().partitionId() << 32, 0, 0
        for batch in sliced(batches, 1, SLICE_BYTES):
            row, slices, places, ms = [], [], [], []
            terms, tfs, ends = ([[] for _ in range(owners)] for _ in range(3))
            for i, text in enumerate(batch.column(1).to_pylist()):
                counts = term_counts(text)
                found = 0
                for t, tf in counts.items():
                    if o := marks.of(t):
                        terms[o - 1].append(t)
                        tfs[o - 1].append(tf)
                        found += 1
                if not found:
                    continue
                if place == SLICE_DOCS or held and held + found > SLICE_POSTINGS:
                    at, place, held = at + 1, 0, 0
                row.append(i)
                slices.append(at)
                places.append(place)
                ms.append(100 - B + B * counts.total() * n_docs // n_terms)
                for o in range(owners):
                    ends[o].append(len(terms[o]))
                place, held = place + 1, held + found
            made = []
            for o in range(owners):
                offsets = pa.array([0, *ends[o]], pa.int32())
                made += [pa.ListArray.from_arrays(offsets, pa.array(terms[o], pa.string())), pa.ListArray.from_arrays(offsets, pa.array(tfs[o], pa.int64()))]
            yield pa.RecordBatch.from_arrays([pa.array(slices, pa.int64()), pa.array(places, pa.int32()), batch.column(0).take(pa.array(row, pa.int64())), pa.array(ms, pa.int64()), *made], names=out.names)

    return _texts(docs, id_col, text_col).mapInArrow(run, out)


def contributions(postings: pa.Table, owner: int, terms: pa.Array, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The places and contributions of all postings of the terms, ordered by term, and where each term's begin."""
    lists = postings.column(f"t{owner}").combine_chunks()
    own = pc.index_in(lists.flatten(), terms)
    row = np.asarray(pc.list_parent_indices(lists))
    known = np.asarray(pc.is_valid(own))
    term, row = np.asarray(own.drop_null()), row[known]
    tf = np.asarray(postings.column(f"f{owner}").combine_chunks().flatten())[known]
    adds = weights[term] * (1_000_000_000 * tf // (1000 * tf + 20 * np.asarray(postings.column("m"))[row]))
    order = np.argsort(term, kind="stable")
    return np.asarray(postings.column("place"))[row[order]], adds[order], np.searchsorted(term[order], np.arange(len(terms) + 1))


def visit(bundle: dict, owner: int, postings: pa.Table) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """item's number, places and scores of the documents of a slice that have a score after the owner has added its own, item by item."""
    terms = bundle[f"terms{owner}"]
    places, adds, first = contributions(postings, owner, terms, bundle[f"weights{owner}"])
    holds = bundle[f"items{owner}"]  # for each term the numbers of its items
    item = np.asarray(holds.flatten()) if len(holds) else np.zeros(0, np.int32)
    term = np.repeat(np.arange(len(terms)), np.asarray(pc.list_value_length(holds)) if len(holds) else [])
    by_item = np.argsort(item, kind="stable")
    item, term = item[by_item], term[by_item]
    acc_item, acc_place, acc_score = bundle["acc_item"], bundle["acc_place"], bundle["acc_score"]
    width = 1 + max(int(places.max(initial=-1)), int(acc_place.max(initial=-1)))
    room = np.zeros(width, np.int64)
    for i in range(bundle["n_items"]):
        own = slice(*np.searchsorted(acc_item, [i, i + 1]))
        room[acc_place[own]] = acc_score[own]
        for t in term[slice(*np.searchsorted(item, [i, i + 1]))]:
            at = slice(first[t], first[t + 1])
            room[places[at]] += adds[at]  # a document is once in a term's postings
        some = np.flatnonzero(room)
        yield i, some, room[some]
        room[some] = 0


def _bundle_of(row: pa.Table, owner: int) -> dict:
    """What a bundle's only row carries, as arrays."""

    def values(name: str) -> pa.Array:
        return row.column(name).combine_chunks().flatten()

    got = {c: np.asarray(values(c)) for c in ("acc_item", "acc_place", "acc_score", f"weights{owner}")}
    return got | {f"terms{owner}": values(f"terms{owner}"), f"items{owner}": values(f"items{owner}"), "items": values("items"), "n_items": len(values("items"))}


def best_places(scores: np.ndarray, ids: pa.Array, k: int) -> np.ndarray:
    """The k highest scores' numbers, ties to the smaller identifier, null last."""
    if len(scores) <= k:
        return np.arange(len(scores))
    some = np.flatnonzero(scores >= np.partition(scores, len(scores) - k)[-k])
    if len(some) > k:
        table = pa.table({"score": scores[some], "id": ids.take(pa.array(some))})
        some = some[np.asarray(pc.sort_indices(table, sort_keys=[("score", "descending"), ("id", "ascending")]))[:k]]
    return some


def plans(terms: DataFrame, owners: int) -> DataFrame:
    """A row for each bundle: its items, and for every owner its terms, their weights and the numbers of the items that hold them."""
    members = terms.groupBy("bundle").agg(F.sort_array(F.collect_set("item_id")).alias("items"))
    numbered = terms.join(members, "bundle").withColumn("number", (F.array_position("items", F.col("item_id")) - 1).cast("int"))
    held = numbered.groupBy("bundle", "owner", "term").agg(F.max("weight").alias("weight"), F.sort_array(F.collect_list("number")).alias("numbers"))
    columns = []
    for o in range(owners):
        own = F.sort_array(F.collect_list(F.when(F.col("owner") == o + 1, F.struct("term", "weight", "numbers"))))
        columns.append(own.alias(f"own{o}"))
    listed = held.groupBy("bundle").agg(*columns).join(members, "bundle")
    parts = [c for o in range(owners) for c in (F.col(f"own{o}.term").alias(f"terms{o}"), F.col(f"own{o}.weight").alias(f"weights{o}"), F.col(f"own{o}.numbers").alias(f"items{o}"))]
    return listed.select("bundle", "items", *parts)


def search(items: DataFrame, docs: DataFrame, k: int = K, item_col: str = "item_id", id_col: str = "doc_id", text_col: str = "text", shares: tuple[float, ...] = SHARES, bundle_items: int = BUNDLE_ITEMS) -> DataFrame:
    """item_id, rank (from 1), doc_id and score of the k best documents of each item."""
    spark, owners = docs.sparkSession, len(shares) + 1
    asked = stash(item_terms(items, item_col, text_col), "item-terms", few=True)
    slot = F.crc32("term") % SLOTS
    marks = bytearray(SLOTS)
    for r in asked.select(slot.alias("slot")).distinct().toLocalIterator():  # SLOTS rows at most
        marks[r["slot"]] = 1
    counted = stash(statistics(docs, bytes(marks), id_col, text_col), "statistics", few=True)
    whole = counted.where("term IS NULL").first()
    n_docs, n_terms = (whole["docs"], whole["terms"]) if whole else (0, 0)

    df = asked.select("term").distinct().join(counted, "term").select("term", "docs", slot.alias("slot"))
    weight = F.floor(1000 * F.log(F.lit(float(2 * n_docs + 2)) / (2 * F.col("docs") + 1))).cast("long")
    # an owner takes whole slots, so that a task knows it without knowing the items' terms
    share = F.sum("docs").over(Window.partitionBy("slot")) / F.lit(float(max(1, n_docs)))
    owner = sum((F.when(share > x, 1).otherwise(0) for x in shares), F.lit(1))
    known = stash(df.select("term", "slot", weight.alias("weight"), owner.alias("owner")).where("weight > 0"), "terms", few=True)
    owner_of = bytearray(SLOTS)
    for r in known.select("slot", "owner").distinct().toLocalIterator():  # SLOTS rows at most
        owner_of[r["slot"]] = r["owner"]

    n_bundles = max(1, -(-asked.select("item_id").distinct().count() // bundle_items))
    bundled = asked.join(known, "term").withColumn("bundle", F.pmod(F.xxhash64("item_id"), F.lit(n_bundles)).cast("int"))
    plan = stash(plans(bundled, owners), "plans", few=True)
    made = stash(postings(docs, bytes(owner_of), owners, n_docs, max(1, n_terms), id_col, text_col), "postings")

    # every bundle begins in every slice; a plan is copied to `width` places, so that no task has all slices of a bundle
    width = shuffle_width(spark)
    everywhere = F.explode(F.sequence(F.lit(0), F.lit(n_bundles - 1))).alias("bundle")
    starts = made.select("slice").distinct().select(F.col("slice").alias("at"), F.pmod(F.xxhash64("slice"), F.lit(width)).cast("int").alias("salt"), everywhere)
    salted = plan.select("*", F.explode(F.sequence(F.lit(0), F.lit(width - 1))).alias("salt"))
    empty = [F.array().cast(f"array<{kind}>").alias(c) for c, kind in (("acc_item", "int"), ("acc_place", "int"), ("acc_score", "long"))]
    bundles = starts.join(salted.hint("merge"), ["bundle", "salt"])  # copies grow with the cluster's width: not to be broadcast
    bundles = bundles.select("at", "bundle", "items", *[c for c in plan.columns if c not in ("bundle", "items")], *empty)

    for o in range(owners):
        last = o == owners - 1
        columns = ["slice", "place", "m", f"t{o}", f"f{o}"]
        own = made.select(*columns, "doc_id", everywhere) if last else made.where(F.size(f"t{o}") > 0).select(*columns, everywhere)
        if last:
            into = T.StructType([T.StructField("item_id", asked.schema["item_id"].dataType), T.StructField("doc_id", docs.schema[id_col].dataType), T.StructField("score", T.LongType())])
            f = _selecting(o, k, into)
        else:
            into = T.StructType([c for c in bundles.schema if c.name not in (f"terms{o}", f"weights{o}", f"items{o}")])
            f = _carrying(o, into)
        bundles = bundles.groupBy("at", "bundle").cogroup(own.groupBy("slice", "bundle")).applyInArrow(f, into)

    place = Window.partitionBy("item_id").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return bundles.withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")


def _carrying(owner: int, into: T.StructType):
    """An owner that hands the bundle on."""
    names = into.names

    def f(row: pa.Table, postings: pa.Table) -> pa.Table:
        if row.num_rows and postings.num_rows:
            found = list(visit(_bundle_of(row, owner), owner, postings))
            sizes = [len(p) for _, p, _ in found]
            arrays = {
                "acc_item": np.repeat(np.array([i for i, _, _ in found], np.int32), sizes),
                "acc_place": np.concatenate([p for _, p, _ in found]).astype(np.int32),
                "acc_score": np.concatenate([s for _, _, s in found]),
            }
            for c, x in arrays.items():
                row = row.set_column(row.column_names.index(c), c, pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), pa.array(x)))
        return row.select(names)

    return f


def _selecting(owner: int, k: int, into: T.StructType):
    """The last owner, which has all documents of the slice and keeps the best of each item."""
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = to_arrow_schema(into)

    def f(row: pa.Table, postings: pa.Table) -> pa.Table:
        if not row.num_rows or not postings.num_rows:
            return schema.empty_table()
        bundle = _bundle_of(row, owner)
        by_place = np.argsort(np.asarray(postings.column("place")), kind="stable")
        ids = postings.column("doc_id").combine_chunks().take(pa.array(by_place))
        items, docs, scores = [], [], []
        for i, places, score in visit(bundle, owner, postings):
            own = ids.take(pa.array(places))
            keep = best_places(score, own, k)
            items.append(np.full(len(keep), i))
            docs.append(own.take(pa.array(keep)))
            scores.append(score[keep])
        return pa.Table.from_arrays([bundle["items"].take(pa.array(np.concatenate(items))), pa.chunked_array(docs, schema.field("doc_id").type), pa.array(np.concatenate(scores))], schema=schema)

    return f
