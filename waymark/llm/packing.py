"""Best-fit packing of tokenised documents into sequences of at most `size` tokens.

The tokens of a document are counted once, in tasks. Everything after that works on the histogram of piece lengths, which has
`size` numbers whatever the input: patterns of up to three lengths that fill a sequence are enumerated, their repeat counts are
fitted to the histogram by non-negative least squares and rounded down, and the lengths left over are packed best-fit, longest
first. The plan (pattern, repeats) is a small table; each piece finds its sequence by its place among the pieces of its length.
That place is by hash, or (ordered) by the documents' order in their files: then the repeats of all patterns are spread evenly, and sequence ids follow that order.

Defined results: null text is empty; a document always has its end token, so an empty one is a piece of one token. Identifiers are
not looked at: repeated rows are packed as often as they occur, and a null identifier is kept. Very long texts are tokenised whole, piece by piece.
A special token's own text, such as `<|endoftext|>`, is that token, as in the tokenizer's encoding with add_special_tokens=False. An empty table gives an empty result.
"""

from __future__ import annotations

import functools
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from waymark.llm.common import ranked, shuffle_width, sliced, stash

SIZE, END = 1024, 2
SLICE_BYTES, JOINED = 6_000_000, 1000
GOLDEN = 0.6180339887498949  # steps of it spread evenly over 0 .. 1, so that patterns with few repeats don't meet
REPEATS = 100_000  # of a pattern that one row of a plan's table stands for

#: A space that white space or the end follows: only there can a cut before every space differ from the tokenizer's own.
ODD_SPACE = r" ($|\s|[\x0b\x1c-\x1f\x{85}]|\p{Z})"
CUT = re.compile(r" (?=\S)")
#: Where a run of letters ends, and where one begins a line: the tokenizer always cuts there, too.
BORDER = r"(\p{L})([^\p{L} ])|(\n)(\p{L})"


class WordTokens:
    """Token ids of texts, by way of their distinct words.

    A byte-level tokenizer never joins what stands before a space with the space and the word after it, so texts are cut before each space
    that a character other than white space follows (and after letters, see BORDER), and each distinct chunk of a slice is encoded once: many chunks in
    one text, whose ids are told apart by the bytes that each token stands for. Tokenizers of other kinds encode whole texts.
    """

    def __init__(self, path: str):
        import json
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            how = json.load(f)
        before = how.get("pre_tokenizer") or {}
        self.by_words = how.get("normalizer") is None and before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space")
        vocabulary = self.tokenizer.get_vocab()
        self.bytes_of = np.zeros(max(vocabulary.values(), default=0) + 1, np.int64)
        for token, i in vocabulary.items():  # a byte is a character there
            self.bytes_of[i] = len(token)
        self.added = [x["content"] for x in how.get("added_tokens", [])]
        for x in how.get("added_tokens", []):
            self.bytes_of[x["id"]] = len(x["content"].encode())
            self.by_words = self.by_words and not (x.get("lstrip") or x.get("rstrip") or x.get("single_word") or any(c.isspace() for c in x["content"]))

    def each(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, and where each text's ids end."""
        ids = [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        return np.concatenate([np.zeros(0, np.uint32), *ids]), np.cumsum([len(x) for x in ids], dtype=np.int64)

    def spaced(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of each word with a space before it, and where each word's ids end."""
        starts = np.arange(0, len(words) + JOINED, JOINED).clip(max=len(words))
        lines = pc.binary_join(pa.LargeListArray.from_arrays(pa.array(starts, pa.int64()), words), pa.scalar(" ", words.type)).to_pylist()
        ids, _ = self.each([f" {x}" for x in lines])
        upto, byte_ends = np.cumsum(self.bytes_of[ids]), np.cumsum(pc.binary_length(words).to_numpy(zero_copy_only=False).astype(np.int64) + 1)
        ends = np.searchsorted(upto, byte_ends) + 1
        if len(ends) and not (len(upto) >= ends[-1] and (upto[ends - 1] == byte_ends).all()):
            raise ValueError("the tokenizer doesn't cut texts before the spaces between words")
        return ids, ends

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, and where each text's ids end."""
        if not self.by_words:
            return self.each(texts.to_pylist())
        odd = pc.match_substring_regex(texts, ODD_SPACE)
        whole = odd
        for token in self.added:
            whole = pc.or_(whole, pc.match_substring(texts, token))
        # a border becomes two spaces, so that an empty chunk says that no space stands before the next one
        parts = pc.split_pattern(pc.if_else(whole, texts, pc.replace_substring_regex(texts, BORDER, r"\1\3  \2\4")), " ")
        if pc.any(odd).as_py():
            cut = iter([CUT.split(t) for t in texts.filter(odd).to_pylist()])
            spliced = [next(cut) if o else p for o, p in zip(odd.to_pylist(), parts.to_pylist(), strict=True)]
            parts = pa.array(spliced, pa.large_list(pa.large_string()))
        starts = np.asarray(parts.offsets, np.int64)
        starts = starts - starts[0]
        coded = parts.flatten().dictionary_encode()
        codes, n = np.asarray(coded.indices, np.int64), len(coded.dictionary)
        no_space = np.zeros(len(codes), bool)
        no_space[starts[:-1]] = True  # a text has at least one chunk; its first has no space before it
        sizes = pc.binary_length(coded.dictionary).to_numpy(zero_copy_only=False)
        border = (sizes[codes] == 0) & ~no_space
        no_space[1:] |= border[:-1]
        spaced = ~no_space & ~border
        heads = np.flatnonzero(np.bincount(codes[no_space], minlength=n))
        words = np.flatnonzero(np.bincount(codes[spaced], minlength=n))
        head_ids, head_ends = self.each(coded.dictionary.take(pa.array(heads)).to_pylist())
        ids, ends = self.spaced(coded.dictionary.take(pa.array(words)))
        ids, ends = np.concatenate([head_ids, ids]), np.concatenate([[0, 0], head_ends, len(head_ids) + ends])
        place = np.zeros((2, n), np.int64)
        place[0, words] = 1 + len(heads) + np.arange(len(words))
        place[1, heads] = 1 + np.arange(len(heads))
        entry = place[no_space.astype(np.int8), codes]
        entry[border] = 0
        begin, length = ends[entry], ends[entry + 1] - ends[entry]
        upto = np.cumsum(length)
        total = int(upto[-1]) if len(upto) else 0
        flat = ids[np.repeat(begin - (upto - length), length) + np.arange(total)]
        return flat, upto[starts[1:] - 1]


@functools.cache
def word_tokens(path: str) -> WordTokens:
    """One for each worker process."""
    return WordTokens(path)


def pieces(docs: DataFrame, tokenizer: str, size: int = SIZE, end: int = END, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 and the columns of keep: each document's ids and the end token, cut so that only the first piece is shorter than size."""
    columns = ["doc_id", "piece", "start", "length", "ids_crc32"]
    kind = docs.schema[id_col].dataType
    out = T.StructType([T.StructField("doc_id", kind), T.StructField("piece", T.IntegerType()), *[T.StructField(c, T.LongType()) for c in columns[2:]], *[docs.schema[c] for c in keep]])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = word_tokens(tokenizer)
        for batch in sliced(batches, 1, SLICE_BYTES):
            flat, ends = words.encode(batch.column(1).cast(pa.large_string()))
            where, number, start, length, crc = [], [], [], [], []
            begin = 0
            for i, e in enumerate(ends.tolist()):
                own = np.append(flat[begin:e], np.uint32(end)).astype("<u4")
                begin, n, a = e, len(own), 0
                b = n % size or min(n, size)
                while a < n:
                    where.append(i)
                    number.append(0 if a == 0 else number[-1] + 1)
                    start.append(a)
                    length.append(b - a)
                    crc.append(zlib.crc32(own[a:b].tobytes()))
                    a, b = b, b + size
            rows = pa.array(where, pa.int64())
            kept = [batch.column(2 + i).take(rows) for i in range(len(keep))]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(rows), pa.array(number, pa.int32()), *[pa.array(x, pa.int64()) for x in (start, length, crc)], *kept], names=[*columns, *keep])

    return docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), *keep).mapInArrow(cut, out)


def patterns(size: int) -> np.ndarray:
    """All ways to fill size with one, two or three lengths, largest first, 0 for none."""
    two = [(size - b, b, 0) for b in range(1, size // 2 + 1)]
    three = []
    for c in range(1, size // 3 + 1):
        b = np.arange(c, (size - c) // 2 + 1)
        three.append(np.stack([size - b - c, b, np.full(len(b), c)], 1))
    return np.concatenate([np.array([(size, 0, 0), *two]).reshape(-1, 3), *three])


def fit(histogram: np.ndarray, rows: np.ndarray, steps: int = 300) -> np.ndarray:
    """Repeat counts x >= 0 of the patterns with little (A x - histogram)^2: accelerated projected gradient, the step from a power iteration.

    Misses are weighted so that long pieces, which few patterns can take, fit best.
    """
    n = len(histogram)
    weight = np.linspace(0.2, 1.0, n)

    def ahead(x):
        return np.bincount(rows.ravel(), np.repeat(x, 3), n)[:n] * live

    live = np.ones(n)
    live[0] = 0
    x = np.ones(len(rows))
    for _ in range(12):
        y = (weight * ahead(x))[rows].sum(1)
        top = np.linalg.norm(y)
        x = y / top
    x = np.zeros(len(rows))
    z, t = x, 1.0
    usable = (histogram[rows] > 0) | (rows == 0)
    usable = usable.all(1)
    for _ in range(steps):
        slope = ((ahead(z) - histogram) * weight * live)[rows].sum(1)
        new = np.maximum(0, z - slope / top) * usable
        t, was = (1 + (1 + 4 * t * t) ** 0.5) / 2, t
        z, x = new + (was - 1) / t * (new - x), new
    return x


def plan(histogram: np.ndarray) -> list[tuple[int, list[int]]]:
    """(repeats, lengths of the pattern): covers the histogram (index: length) exactly; as long for a thousand as for 10^12 pieces."""
    size = len(histogram) - 1
    left = histogram.astype(np.int64).copy()
    left[0] = 0
    out: list[tuple[int, list[int]]] = []
    if left[size]:
        out.append((int(left[size]), [size]))
        left[size] = 0
    rows = patterns(size)
    x = fit(left.astype(float), rows)
    order = np.argsort(-x, kind="stable")
    for j in order[: int((x >= 1).sum())]:
        need: dict[int, int] = {}
        for v in rows[j]:
            if v:
                need[int(v)] = need.get(int(v), 0) + 1
        k = min([int(x[j]), *[int(left[v]) // m for v, m in need.items()]])
        if k > 0:
            out.append((k, [int(v) for v in rows[j] if v]))
            for v, m in need.items():
                left[v] -= k * m
    return out + best_fit(left)


def best_fit(left: np.ndarray) -> list[tuple[int, list[int]]]:
    """Best-fit decreasing over a histogram; bins that are alike are handled together."""
    size = len(left) - 1
    room: dict[int, list[tuple[int, list[int]]]] = {}  # by free tokens: (bins, their lengths)
    free: list[int] = []  # keys of room, ascending
    import bisect

    def put(r: int, n: int, has: list[int]) -> None:
        if r not in room:
            room[r] = []
            bisect.insort(free, r)
        room[r].append((n, has))

    for v in range(size, 0, -1):
        n = int(left[v])
        while n:
            i = bisect.bisect_left(free, v)
            if i == len(free):
                each = size // v
                if n >= each:
                    put(size - v * each, n // each, [v] * each)
                    n %= each
                else:
                    put(size - v * n, 1, [v] * n)
                    n = 0
                continue
            r = free[i]
            bins, has = room[r].pop()
            if not room[r]:
                del room[r]
                free.pop(i)
            each = min(r // v, n)
            full = min(bins, n // each)
            put(r - v * each, full, has + [v] * each)
            n -= full * each
            if bins > full:
                put(r, bins - full, has)
    return [(n, has) for groups in room.values() for n, has in groups]


def assign(cut: DataFrame, steps: list[tuple[int, list[int]]]) -> DataFrame:
    """cut (pieces) with sequence_id and offset by a plan."""
    spark = cut.sparkSession
    taken: dict[int, int] = {}
    rows, first = [], 0
    for repeats, lengths in steps:
        at = 0
        for v in sorted(set(lengths), reverse=True):
            times = lengths.count(v)
            from_rank = taken.get(v, 0)
            taken[v] = from_rank + repeats * times
            rows.append((v, from_rank, taken[v], times, first, at))
            at += v * times
        first += repeats
    schema = "_length long, _from long, _to long, _times long, _first long, _at long"
    by_length = F.array_sort(F.collect_list(F.struct("_from", "_to", "_times", "_first", "_at")))
    spans = spark.createDataFrame(rows, schema).groupBy("_length").agg(by_length.alias("_spans"))
    place = ranked(cut, ["length"], F.pmod(F.xxhash64("doc_id", "piece"), F.lit(4 * shuffle_width(spark))), [F.asc_nulls_first("doc_id"), F.asc("piece"), F.asc("ids_crc32")], "_rank")
    joined = place.join(F.broadcast(spans), F.col("length") == F.col("_length"))  # a row for each length, the size of the plan
    span = F.filter("_spans", lambda s: (s["_from"] <= F.col("_rank")) & (F.col("_rank") < s["_to"]))[0]
    joined = joined.withColumn("_s", span)
    within = F.col("_rank") - F.col("_s._from")
    return joined.select(
        *cut.columns,
        (F.col("_s._first") + F.floor(within / F.col("_s._times"))).alias("sequence_id"),
        (F.col("_s._at") + within % F.col("_s._times") * F.col("length")).alias("offset"),
    )


def in_order(docs: DataFrame, columns: list[str], out: str) -> tuple[DataFrame, int]:
    """columns of docs with out, a row's place in the order of the files (by part number, then name) and the rows in them, and a bound of the places."""
    rows = docs.select(*columns, F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_row"))
    sizes = rows.groupBy("_file").agg((F.max("_row") + 1).alias("_n"))
    name = F.element_at(F.split("_file", "/"), -1)
    number = F.regexp_extract(name, r"^part-(\d+)", 1).try_cast("long")
    upto = Window.orderBy(F.asc_nulls_first(number), name, "_file").rowsBetween(Window.unboundedPreceding, 0)  # a row for each file
    starts = stash(sizes.select("_file", "_n", F.sum("_n").over(upto).alias("_upto")), "files")
    total = starts.agg(F.max("_upto")).first()[0] or 0
    starts = starts.select("_file", (F.col("_upto") - F.col("_n")).alias("_start"))
    # starts: a row for each file
    return rows.join(F.broadcast(starts), "_file").withColumn(out, F.col("_start") + F.col("_row")).drop("_file", "_row", "_start"), total


def sequences(spark: SparkSession, steps: list[tuple[int, list[int]]]) -> DataFrame:
    """length, sequence_id, offset: the places of a plan. Repeats of a pattern are spread evenly over the sequences, so that every part of them holds all patterns."""
    rows = []
    for i, (repeats, lengths) in enumerate(steps):
        offsets = [sum(lengths[:j]) for j in range(len(lengths))]
        rows += [(i, repeats, at, min(at + REPEATS, repeats), lengths, offsets) for at in range(0, repeats, REPEATS)]
    chunks = spark.createDataFrame(rows, "_step int, _repeats long, _from long, _to long, _lengths array<long>, _offsets array<long>").repartition(shuffle_width(spark))
    each = chunks.select("*", F.explode(F.sequence(F.col("_from"), F.col("_to") - 1)).alias("_repeat")).withColumn("_at", (F.col("_repeat") + F.col("_step") * GOLDEN % 1) / F.col("_repeats"))
    slices = 4 * shuffle_width(spark)
    each = ranked(each, [], F.floor(F.col("_at") * slices), [F.asc(c) for c in ("_at", "_step", "_repeat")], "sequence_id")
    both = F.explode(F.arrays_zip(F.col("_lengths").alias("length"), F.col("_offsets").alias("offset"))).alias("_x")
    return each.select("sequence_id", both).select("_x.length", "sequence_id", "_x.offset")


def assign_in_order(cut: DataFrame, steps: list[tuple[int, list[int]]], place: str, places: int) -> DataFrame:
    """cut (pieces with a column place, under places) with sequence_id and offset by a plan: of each length, earlier pieces come to earlier sequences."""
    spark = cut.sparkSession
    slices, total = 4 * shuffle_width(spark), max(1, sum(n for n, _ in steps))
    by_place = ranked(cut, ["length"], F.floor(F.col(place) * slices / max(1, places)), [F.asc(place), F.asc("piece")], "_rank")
    free = ranked(sequences(spark, steps), ["length"], F.floor(F.col("sequence_id") * slices / total), [F.asc("sequence_id"), F.asc("offset")], "_rank")
    return by_place.join(free, ["length", "_rank"]).select(*[c for c in cut.columns if c != place], "sequence_id", "offset")


def pack(docs: DataFrame, tokenizer: str, size: int = SIZE, end: int = END, id_col: str = "doc_id", text_col: str = "text", ordered: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset for every piece of docs.

    ordered: sequence ids follow the order in which docs, read from files, stand there; else pieces are placed by hash.
    """
    places, keep = 0, ()
    if ordered:
        (docs, places), keep = in_order(docs, [id_col, text_col], "_place"), ("_place",)
    cut = stash(pieces(docs, tokenizer, size, end, id_col, text_col, keep), "pieces")
    counts = np.zeros(size + 1, np.int64)
    for row in cut.groupBy("length").count().collect():  # size rows at most
        counts[row["length"]] = row["count"]
    return assign_in_order(cut, plan(counts), "_place", places) if ordered else assign(cut, plan(counts))
