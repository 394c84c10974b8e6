"""Near-duplicate documents: MinHash signatures joined by a multi-index over Hamming distance, links confirmed on full sets.

A document's set holds its distinct shingles of `words` words. Its signature has SIZE components of BITS bits, each from the
smallest hash of one permutation; two sets of similarity s differ in a component with probability about 1 - s. The components are split into CHUNKS
chunks, and each chunk is indexed once without each of its components. By the pigeonhole principle, all pairs that differ in at most
2 * CHUNKS - 1 = 19 components have a chunk with at most one error, and so share a key; at a similarity of 0.8 the mean distance is 12.8, and
pairs further apart share a key unless every chunk has two errors (6 in 100,000 pairs of just that similarity, fewer above it). Documents that share a
key with another have a second signature of WIDE two-bit components, cut at six standard deviations (a pair in 10^9 lies beyond), which spares most needless
confirmations. Every link is confirmed on the full sets. Where no pair may be missed, `exact` takes the place of both signatures.

Equal sets are one class, found by digest, and only its smallest identifier goes on. No pairs within a key's group are listed:
first, each member is compared with the group's smallest identifier; after that the members of a group that still belong to different components
are compared, those of the group's largest component only with the others. So all pairs within reach are either compared or known to be
connected, and a group of thousands of near copies costs about as many comparisons.

Defined results: null or empty text, or text of white space alone, has an empty set, is linked with nothing and is kept. A null identifier is
linked with nothing, has a null component_id, and is kept. Rows that repeat an identifier are one node, with the links of all their texts. Texts are read whole, however long.
Only the identifier and the text are read, so other columns can't clash. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from waymark.llm.common import one_of_each, sliced, stash
from waymark.llm.components import components

WORDS, LIKE, OF = 5, 80, 100
SIZE, BITS, CHUNKS = 64, 9, 10
WIDE, WIDE_REACH = 1024, 222
CELL = 1000  # members of a key that a task compares with as many others
SLICE_BYTES, LONG_TEXT = 1_000_000, 2_000_000
GAP = re.compile(rb"[\x20\x09-\x0d]")

_rng = np.random.default_rng(20)


def _odd(n: int) -> np.ndarray:
    return _rng.integers(0, 2**63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


OF_BYTE, OF_PLACE, OF_PART = _odd(256), _odd(64), _odd(SIZE)
STEP = _odd(1)[0]
STEP_BACK = np.uint64(pow(int(STEP), -1, 2**64))
TIMES, PLUS = _odd(WIDE).astype(np.uint32), _odd(WIDE).astype(np.uint32)
PARTS = [np.array(x) for x in np.array_split(np.arange(SIZE), CHUNKS)]


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base)
    out[:1] = 1
    return np.multiply.accumulate(out)


def word_hashes(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of each word, and where words begin; A-Z count as a-z, words end at ASCII white space."""
    raw = np.frombuffer(raw + b" ", np.uint8)
    raw = np.where((raw >= 65) & (raw <= 90), raw + np.uint8(32), raw)
    gap = (raw == 32) | ((raw >= 9) & (raw <= 13))
    edge = np.diff(np.concatenate([[True], gap]).astype(np.int8))
    begin, end = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    summed = np.concatenate([[np.uint64(0)], np.cumsum(OF_BYTE[raw] * _powers(STEP, len(raw)))])
    return mixed((summed[end] - summed[begin]) * _powers(STEP_BACK, len(raw))[begin] + (end - begin).astype(np.uint64)), begin


def long_words(text: bytes) -> np.ndarray:
    """word_hashes of a long text, in blocks that end at white space."""
    parts, at = [], 0
    while at < len(text):
        found = GAP.search(text, at + LONG_TEXT)
        to = found.start() if found else len(text)
        parts.append(word_hashes(text[at:to])[0])
        at = to
    return np.concatenate(parts)


def shingle_sets(texts: list[bytes], words: int) -> Iterator[np.ndarray]:
    """The sorted distinct 64-bit shingle hashes of each text. Short texts are hashed together, long ones in blocks: memory is a few bytes for each byte of the longest text."""
    at = 0
    while at < len(texts):
        if len(texts[at]) > LONG_TEXT:
            word = long_words(texts[at])
            yield from _sets(word, [len(word)], words)
            at += 1
            continue
        to = next((i for i in range(at, len(texts)) if len(texts[i]) > LONG_TEXT), len(texts))
        word, begin = word_hashes(b" ".join(texts[at:to]))
        ends = np.cumsum([len(t) + 1 for t in texts[at:to]])
        yield from _sets(word, np.searchsorted(begin, ends).tolist(), words)
        at = to


def _sets(word: np.ndarray, upto: list[int], words: int) -> Iterator[np.ndarray]:
    """Of texts whose words end at upto."""
    many = max(0, len(word) - words + 1)
    rolled = np.zeros(many, np.uint64)
    for j in range(words):
        rolled += word[j : j + many] * OF_PLACE[j]
    rolled = mixed(rolled)
    a = 0
    for b in upto:
        if b - a >= words:
            yield np.unique(rolled[a : b - words + 1])
        elif b > a:
            short = (word[a:b] * OF_PLACE[: b - a]).sum(dtype=np.uint64)
            yield mixed(np.array([short]) + OF_PLACE[words + b - a])
        else:
            yield np.zeros(0, np.uint64)
        a = b


def signature(hashes: np.ndarray, size: int) -> np.ndarray:
    """The smallest hashes of the first size permutations."""
    least = np.full(size, 0xFFFFFFFF, np.uint32)
    h = (hashes >> np.uint64(32)).astype(np.uint32)
    rows = max(1, 2**17 // size)
    for at in range(0, len(h), rows):
        np.minimum(least, (h[at : at + rows, None] * TIMES[:size] + PLUS[:size]).min(0), out=least)
    return least


def chunks(signatures: np.ndarray) -> np.ndarray:
    """The components of each chunk in one word, BITS bits each."""
    lanes = (signatures[:, :SIZE] & np.uint32(2**BITS - 1)).astype(np.uint64)
    return np.stack([(lanes[:, own] << (np.arange(len(own)) * BITS).astype(np.uint64)).sum(1, dtype=np.uint64) for own in PARTS], 1)


def index_keys(chunks: np.ndarray) -> np.ndarray:
    """For each signature SIZE keys: its chunks, each without one of its components, whose number is in the key's last six bits."""
    keys = np.empty((len(chunks), SIZE), np.uint64)
    for c, own in enumerate(PARTS):
        for i, j in enumerate(own):
            rest = chunks[:, c] & ~np.uint64((2**BITS - 1) << (BITS * i))
            keys[:, j] = (mixed(rest + OF_PART[j]) << np.uint64(6)) | np.uint64(j)
    return keys


def packed(signatures: np.ndarray) -> np.ndarray:
    """Two bits of each component, in WIDE / 32 words."""
    two = (signatures & np.uint32(3)).astype(np.uint64).reshape(len(signatures), WIDE // 32, 32)
    return (two << (2 * np.arange(32, dtype=np.uint64))).sum(2, dtype=np.uint64)


def _lists(rows: np.ndarray) -> pa.Array:
    n, width = rows.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * width, pa.int32()), pa.array(rows.astype(np.int64, copy=False).ravel()))


def prefix_keys(hashes: np.ndarray, like: int, of: int) -> np.ndarray:
    """The smallest hashes of a set, as many as any other set of the least similarity must hold one of: if it held none, too few would be left in common."""
    return hashes[: len(hashes) + (-len(hashes) * like // of) + 1]


def signatures(docs: DataFrame, words: int, id_col: str, text_col: str, exact: tuple[int, int] | None = None) -> DataFrame:
    """doc_id, n_shingles, digest (of the whole set) and keys for every row; with exact (like, of) the keys of prefix_keys."""
    longs = T.ArrayType(T.LongType())
    out = T.StructType([T.StructField("doc_id", docs.schema[id_col].dataType), T.StructField("n_shingles", T.LongType()), T.StructField("digest", T.BinaryType()), T.StructField("keys", longs)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, 1, SLICE_BYTES):
            n, digest, least, prefixes = np.zeros(batch.num_rows, np.int64), [], np.empty((batch.num_rows, SIZE), np.uint32), []
            for i, s in enumerate(shingle_sets(batch.column(1).to_pylist(), words)):
                n[i] = len(s)
                digest.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest())
                if exact:
                    prefixes.append(prefix_keys(s, *exact).view(np.int64))
                else:
                    least[i] = signature(s, SIZE)
            keys = pa.array(prefixes, pa.list_(pa.int64())) if exact else _lists(index_keys(chunks(least)).view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n), pa.array(digest, pa.binary()), keys], names=out.names)

    return docs.select(F.col(id_col).alias("doc_id"), F.encode(F.coalesce(text_col, F.lit("")), "UTF-8").alias("text")).mapInArrow(run, out)


def full_sets(docs: DataFrame, words: int) -> DataFrame:
    """id, n (the set's size), chunks, wide and the shingle hashes, for (doc_id, text)."""
    longs = T.ArrayType(T.LongType())
    out = T.StructType([T.StructField("id", docs.schema["doc_id"].dataType), T.StructField("n", T.LongType()), T.StructField("chunks", longs), T.StructField("wide", longs), T.StructField("shingles", T.ArrayType(T.LongType(), False))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, 1, SLICE_BYTES):
            own = list(shingle_sets(batch.column(1).to_pylist(), words))
            least = np.stack([signature(s, WIDE) for s in own])
            at = np.concatenate([[0], np.cumsum([len(s) for s in own])])
            lists = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(np.concatenate(own).view(np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(at)), _lists(chunks(least).view(np.int64)), _lists(packed(least).view(np.int64)), lists], names=out.names)

    return docs.select("doc_id", F.encode(F.coalesce("text", F.lit("")), "UTF-8").alias("text")).mapInArrow(run, out)


def wide_distance(a: str, b: str) -> Column:
    total = F.lit(0)
    for i in range(WIDE // 32):
        x = F.get(a, F.lit(i)).bitwiseXOR(F.get(b, F.lit(i)))
        total = total + F.bit_count(x.bitwiseOR(F.shiftrightunsigned(x, 1)).bitwiseAND(F.lit(0x5555555555555555)))
    return total


def first_shared(key: Column) -> Column:
    """Of pair rows with chunks, chunks2: whether key is the first of the keys they share, so that a pair counts once."""
    top = sum(1 << (BITS * i + BITS - 1) for i in range(7))
    low = sum((2 ** (BITS - 1) - 1) << (BITS * i) for i in range(7))
    place = key.bitwiseAND(F.lit(SIZE - 1))
    first = None
    for c, own in enumerate(PARTS):
        x = F.get("chunks", F.lit(c)).bitwiseXOR(F.get("chunks2", F.lit(c)))
        errors = F.bit_count((x.bitwiseAND(F.lit(low)) + F.lit(low)).bitwiseOR(x).bitwiseAND(F.lit(top)))
        here = place == int(own[0])  # without errors all of the chunk's keys are shared
        within = place.between(int(own[0]), int(own[-1]))  # with one error, one key is
        first = F.when(errors == 0, here) if first is None else first.when(errors == 0, here)
        first = first.when(errors == 1, within)
    return F.coalesce(first, F.lit(False))


def may_link(like: int, of: int, exact: bool) -> Column:
    """Of pair rows with n, m (set sizes) and wide, wide2: no more than the sizes and signatures (but if it must be exact) allow."""
    sizes = F.least("n", "m") * of >= F.greatest("n", "m") * like
    return sizes if exact else sizes & (wide_distance("wide", "wide2") <= WIDE_REACH)


def confirmed(pairs: DataFrame, sets: DataFrame, like: int, of: int) -> DataFrame:
    """The pairs (a, b) whose sets' intersection is at least like / of of their union."""
    left = sets.select(F.col("id").alias("a"), F.col("shingles").alias("sa"))
    right = sets.select(F.col("id").alias("b"), F.col("shingles").alias("sb"))
    both = pairs.join(left, "a").join(right, "b")
    shared = F.size(F.array_intersect("sa", "sb"))
    return both.where(shared * of >= (F.size("sa") + F.size("sb") - shared) * like).select("a", "b").distinct()


def near_duplicates(docs: DataFrame, words: int = WORDS, like: int = LIKE, of: int = OF, id_col: str = "doc_id", text_col: str = "text", exact: bool = False) -> DataFrame:
    """doc_id, n_shingles, component_id and kept for every row of docs.

    exact: without signatures, by the smallest shingles of each set (prefix filtering), which no pair of the least similarity escapes; a fifth of all shingles are keys then.
    """
    if like * 5 < of * 4 and not exact:
        raise ValueError("the signatures reach down to a similarity of 0.8")
    made = stash(signatures(docs, words, id_col, text_col, (like, of) if exact else None), "signatures")
    linkable = (F.col("n_shingles") > 0) & F.col("doc_id").isNotNull()

    copies = made.where(linkable).groupBy("digest").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("c")).where("c > 1").select("digest", "rep")
    copies = stash(copies, "copies", few=True)

    def with_rep(*columns: str) -> DataFrame:
        same = (made["digest"] == copies["digest"]) & linkable
        return made.join(copies, same, "left").select("doc_id", F.coalesce("rep", "doc_id").alias("rep"), *columns)

    reps = stash(with_rep("keys", "n_shingles").where(linkable & (F.col("rep") == F.col("doc_id"))).select(F.col("doc_id").alias("id"), "keys"), "reps")
    members = with_rep("n_shingles")

    # rows that repeat an identifier, but have different sets
    twice = members.where(linkable).groupBy("doc_id").agg(F.min("rep").alias("a"), F.max("rep").alias("b")).where("a < b").select("doc_id", "a")
    twice = stash(members.where(linkable).join(twice, "doc_id").where("a < rep").select("a", F.col("rep").alias("b")), "twice", few=True)

    # keys that more than one class has, and the smallest identifier of each
    keyed = reps.select("id", F.explode("keys").alias("key"))
    hubs = stash(keyed.groupBy("key").agg(F.min("id").alias("hub"), F.max("id").alias("last")).where("hub < last").select("key", "hub"), "hubs", few=True)
    grouped = stash(keyed.join(hubs, "key"), "grouped", few=True)  # key, id, hub

    found = stash(grouped.select("id").distinct(), "found", few=True)
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    sets = stash(full_sets(texts.join(found, texts["doc_id"] == found["id"], "left_semi"), words), "sets")
    narrow = sets.select("id", "n", "wide")

    def passing(pairs: DataFrame) -> DataFrame:
        a = narrow.select(F.col("id").alias("a"), "n", "wide")
        b = narrow.select(F.col("id").alias("b"), F.col("n").alias("m"), F.col("wide").alias("wide2"))
        return pairs.join(a, "a").join(b, "b").where(may_link(like, of, exact)).select("a", "b")

    stars = grouped.where("hub < id").select(F.col("hub").alias("a"), F.col("id").alias("b")).distinct()
    links = stash(confirmed(passing(stars), sets, like, of).unionByName(twice), "links", few=True)
    part = components(links, "a", "b")

    # what different components still have in common
    labels = part.select("id", "component")
    placed = stash(grouped.join(labels, "id", "left").select("key", "id", F.coalesce("component", "id").alias("component")), "placed", few=True)
    sizes = placed.groupBy("key", "component").agg(F.count(F.lit(1)).alias("c"))
    of_key = sizes.groupBy("key").agg(F.max_by("component", F.struct("c", "component")).alias("major"), F.max("c").alias("most"), F.sum("c").alias("all"), F.count(F.lit(1)).alias("parts")).where("parts > 1")
    # a key's comparisons are a grid of rows and columns, CELL members each, so that no task has more than a cell
    grid = of_key.select("key", "major", F.ceil((F.col("all") - F.col("most")) / CELL).alias("rows"), F.ceil(F.col("all") / CELL).alias("columns"))
    mixed_keys = stash(grid, "mixed", few=True)
    open_keys = stash(placed.join(mixed_keys, "key").join(sets.select("id", "n", "wide", "chunks"), "id"), "open")  # key, id, component, major, rows, columns, n, wide, chunks

    def strewn(own: str, across: str) -> list[Column]:
        """A member's own row or column of the grid, and all of the other."""
        return [F.pmod(F.xxhash64("id"), F.col(own)).alias(own), F.explode(F.sequence(F.lit(0).cast("long"), F.col(across) - 1)).alias(across)]

    minor = open_keys.where("component <> major").select("key", *strewn("rows", "columns"), F.col("id").alias("a"), F.col("component").alias("ca"), "major", "n", "wide", "chunks")
    other = open_keys.select("key", *strewn("columns", "rows"), F.col("id").alias("b"), F.col("component").alias("cb"), F.col("n").alias("m"), F.col("wide").alias("wide2"), F.col("chunks").alias("chunks2"))
    once = (F.col("cb") == F.col("major")) | (F.col("a") < F.col("b"))
    pairs = minor.join(other, ["key", "rows", "columns"]).where((F.col("ca") != F.col("cb")) & once & may_link(like, of, exact) & (F.lit(True) if exact else first_shared(F.col("key"))))
    rest = stash(confirmed(pairs.select("a", "b"), sets, like, of), "links", few=True)

    ends = labels.select("id", "component")
    bridges = rest.join(ends.select(F.col("id").alias("a"), F.col("component").alias("ca")), "a", "left").join(ends.select(F.col("id").alias("b"), F.col("component").alias("cb")), "b", "left")
    bridges = stash(bridges.select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b")), "bridges", few=True)
    joined = components(bridges, "a", "b").select(F.col("id").alias("component"), F.col("component").alias("whole"))
    first = labels.join(joined, "component", "left").select("id", F.coalesce("whole", "component").alias("component"))
    singles = joined.join(labels.select(F.col("id").alias("component")), "component", "left_anti").select(F.col("component").alias("id"), F.col("whole").alias("component"))
    final = stash(first.unionByName(singles), "components", few=True).withColumnRenamed("id", "rep")

    out = members.join(final, "rep", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "rep"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """docs with one document, that of the smallest identifier, of each group; rows without an identifier or without words all stay.

    Where identifiers repeat, rows are told apart by identifier and text, and one row of those that repeat both stays.
    """
    known = F.col(id_col).isNotNull()
    if docs.where(known).groupBy(id_col).count().where("count > 1").isEmpty():
        gone = near_duplicates(docs, id_col=id_col, text_col=text_col, **how).where(~F.col("kept")).select(F.col("doc_id").alias("_gone"))
        return docs.join(gone, docs[id_col] == F.col("_gone"), "left_anti")
    own = F.when(known, F.struct(F.col(id_col).alias("id"), F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256).alias("sha")))
    rows = docs.withColumn("_own", own)
    rows = stash(one_of_each(rows.where(known), ["_own"]).unionByName(rows.where(~known)), "rows")
    gone = near_duplicates(rows, id_col="_own", text_col=text_col, **how).where(~F.col("kept")).select(F.col("doc_id").alias("_gone"))
    return rows.join(gone, rows["_own"] == F.col("_gone"), "left_anti").select(*docs.columns)
