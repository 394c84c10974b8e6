"""Tables on pages: from word boxes and ruling lines to records. Keys are (doc_id, page); a page is the unit that a task needs whole."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from waymark.functions.text import blank_to_null, fold, squeeze, token_class
from waymark.operators import reading

PAGE = ["doc_id", "page"]
TOLERANCE, HEAD = 3.0, ["MUNICIPIO", "ENDERECO", "TELEFONES", "CNES"]
#: Words of table heads and page feet, street words, and beginnings of unit names.
HEAD_WORDS = ["MUNICIPIO", "UNIDADE", "ENDERECO", "TELEFONE", "TELEFONES", "CNES", "ATENDIMENTO", "ATENDIMENTOS", "SOROTERAPIA"]
FOOT_WORDS = ["GOV.BR", "GOV.BR/SAUDE", "SUS", "MINISTERIO", "SAUDE", "PATRIA", "BRASIL"]
STREET_WORDS = ["rua", "av", "avenida", "praca", "travessa", "tv", "estrada", "rodovia", "alameda", "largo", "km"]
UNIT_STARTS = r"^(hospital|unidade|upa|samu|hc|posto|santa)"
NOT_CITIES = ["hosp", "hospital", "unidade", "upa", "samu", "posto", "santa"]
FIELDS = ["municipio", "unidade", "endereco", "telefones", "cnes", "atendimentos_raw"]


def is_head(text: Column) -> Column:
    return F.btrim(F.upper(fold(text)), F.lit(",:.")).isin(HEAD_WORDS)


def is_foot(text: Column) -> Column:
    return F.btrim(F.upper(fold(text)), F.lit(",:./")).isin(FOOT_WORDS)


def middle(a: str, b: str) -> Column:
    return (F.col(a) + F.col(b)) / 2


def ruling_edges(shapes: DataFrame) -> DataFrame:
    """doc_id, page, axis (h or v), edge: distinct positions of thin long shapes, to one decimal."""
    flat = (F.abs(F.coalesce("height", F.lit(0.0))) < 2) & (F.coalesce("width", F.lit(0.0)) > 30)
    tall = (F.abs(F.coalesce("width", F.lit(0.0))) < 2) & (F.coalesce("height", F.lit(0.0)) > 10)
    both = F.array_compact(F.array(F.when(flat, F.struct(F.lit("h").alias("axis"), F.round("top", 1).alias("edge"))), F.when(tall, F.struct(F.lit("v").alias("axis"), F.round("x0", 1).alias("edge")))))
    return shapes.select(*PAGE, F.explode(both).alias("e")).select(*PAGE, "e.*").distinct()


def merge_close(edges: Column, tolerance: float = TOLERANCE) -> Column:
    """Of ascending values those over tolerance beyond the last one kept."""

    def keep(kept: Column, e: Column) -> Column:
        return F.when((F.size(kept) == 0) | (e - F.try_element_at(kept, F.lit(-1)) > tolerance), F.concat(kept, F.array(e))).otherwise(kept)

    return F.aggregate(F.sort_array(edges), F.array().cast("array<double>"), keep)


def page_edges(shapes: DataFrame) -> DataFrame:
    """doc_id, page, h, v: merged edges of each page, as arrays."""
    edges = ruling_edges(shapes)
    one = edges.groupBy(*PAGE).agg(F.collect_set(F.when(F.col("axis") == "h", F.col("edge"))).alias("h"), F.collect_set(F.when(F.col("axis") == "v", F.col("edge"))).alias("v"))
    return one.select(*PAGE, merge_close(F.col("h")).alias("h"), merge_close(F.col("v")).alias("v"))


def gate(edges: DataFrame) -> DataFrame:
    """Pages with the lines of a table of six columns."""
    return edges.where((F.size("v") >= 7) & (F.size("h") >= 2))


def cut_edges(words: DataFrame, edges: DataFrame) -> DataFrame:
    """doc_id, page, h, v, head: edges below the bottom of each page's table head; pages with under two horizontal ones left are gone."""
    heads = words.where(F.trim(F.upper(fold(F.col("text")))).isin(HEAD)).groupBy(*PAGE).agg(F.max("bottom").alias("head"))
    cut = edges.join(heads, PAGE, "left").withColumn("head", F.coalesce("head", F.lit(0.0)))
    return cut.withColumn("h", F.filter("h", lambda e: e > F.col("head"))).where(F.size("h") >= 2)


def below_head(words: DataFrame, cut: DataFrame) -> DataFrame:
    """Words below the head of the pages that cut has, with the pages' edges (h, v)."""
    return words.join(cut.hint("shuffle_hash"), PAGE).where(F.col("top") > F.col("head") + 1).drop("head")  # a row for each page is the side that is kept


def bands(edges: DataFrame) -> DataFrame:
    """doc_id, page, axis, band, low, high: consecutive edges."""
    parts = []
    for axis in "hv":
        pairs = F.arrays_zip(F.slice(axis, 1, F.size(axis) - 1), F.slice(axis, 2, F.size(axis) - 1))
        parts.append(edges.select(*PAGE, F.lit(axis).alias("axis"), F.posexplode(pairs).alias("band", "x")).select(*PAGE, "axis", "band", F.col("x").getField("0").alias("low"), F.col("x").getField("1").alias("high")))
    return parts[0].unionByName(parts[1])


def below(values: Column, value: Column, or_equal: bool = False) -> Column:
    """How many of ascending values lie below value (or at it), by binary search: a step for each power of two up to the number of values."""
    largest = F.floor(F.log2(F.greatest(F.size(values), F.lit(1)).cast("double"))).cast("int")

    def step(n: Column, back: Column) -> Column:
        power = F.pow(F.lit(2.0), largest - back).cast("int")
        there = F.get(values, n + power - 1)
        return F.when(there <= value if or_equal else there < value, n + power).otherwise(n)

    return F.aggregate(F.sequence(F.lit(0), largest), F.lit(0), step)


def band_of(edges: Column, value: Column) -> Column:
    """The first band (0-based) that holds a value, both ends included; null if none does."""
    inside = below(edges, value)
    at_first = F.get(edges, F.lit(0)) == value
    return F.when((inside > 0) & (inside < F.size(edges)), inside - 1).when(at_first & (F.size(edges) > 1), 0).cast("int")


def band_cells(words: DataFrame, cut: DataFrame, gap: float = 4.0) -> DataFrame:
    """doc_id, page, row, cells: for each row of the pages that cut has its cells, by col, and their texts in reading order.

    Words below the heads fall into the first bands that hold their centres, both ends included. Words of a cell are read by lines as in joined_text. Words are shuffled
    once, together with a row of edges for each page; each word looks up its bands among them.
    """
    boxes = words.dropna(subset=["top", "bottom", "x0", "x1"]).select(*PAGE, "top", "bottom", "x0", "x1", "text")
    both = boxes.unionByName(cut.select(*PAGE, "h", "v", "head"), allowMissingColumns=True)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x0, x1, top, bottom, head = reading.numbers(batch, "x0", "x1", "top", "bottom", "head")
            row, col, line = (np.full(batch.num_rows, -1) for _ in range(3))
            page = np.zeros(batch.num_rows, np.int64)
            starts = reading.page_starts(batch)
            for a, b in zip(starts, [*starts[1:], batch.num_rows], strict=True):
                page[a:b] = a
                edges = np.flatnonzero(~np.isnan(head[a:b]))
                if len(edges):
                    e = a + int(edges[0])
                    h, v = (np.array(batch.column(c)[e].as_py()) for c in "hv")
                    under = top[a:b] > head[e] + 1  # false for the row of edges
                    row[a:b] = np.where(under, reading.bands(h, (top[a:b] + bottom[a:b]) / 2), -1)
                    col[a:b] = np.where(under, reading.bands(v, (x0[a:b] + x1[a:b]) / 2), -1)
            at = np.flatnonzero((row >= 0) & (col >= 0))
            if not len(at):
                continue
            at = at[np.lexsort((top[at], col[at], row[at], page[at]))]
            cell = np.flatnonzero(reading.changes(page[at], row[at], col[at]))
            for a, b in zip(cell, [*cell[1:], len(at)], strict=True):
                line[at[a:b]] = 0 if top[at[b - 1]] - top[at[a]] < gap else reading.lines(top[at[a:b]], gap)
            at = reading.ordered(batch.column("text"), at, page, row, col, line, x0)
            sizes = np.diff(np.append(cell, len(at)))
            rows = np.flatnonzero(reading.changes(page[at[cell]], row[at[cell]]))
            texts = reading.lists(batch.column("text"), [at], [sizes])
            cells = pa.StructArray.from_arrays([pa.array(col[at[cell]], pa.int32()), texts], names=["col", "texts"])
            cells = pa.ListArray.from_arrays(pa.array(np.append(rows, len(cell)), pa.int32()), cells)
            keys = pa.array(at[cell[rows]])
            yield pa.RecordBatch.from_arrays([batch.column(c).take(keys) for c in PAGE] + [pa.array(row[at[cell[rows]]], pa.int32()), cells], names=[*PAGE, "row", "cells"])

    kinds = {f.name: f.dataType.simpleString() for f in both.schema.fields}
    return reading.by_page(both, read, f"doc_id {kinds['doc_id']}, page {kinds['page']}, row int, cells array<struct<col: int, texts: array<string>>>")


def joined_text(words: Column, gap: float = 4.0) -> Column:
    """The text of (top, x0, text) structs: lines begin where top is gap or more beyond the line's first, and are read by x0."""
    state = F.struct(F.lit(0).alias("line"), F.lit(None).cast("double").alias("first"), F.array().cast("array<struct<line:int,x0:double,text:string>>").alias("out"))

    def step(s: Column, w: Column) -> Column:
        new = s["first"].isNull() | (F.abs(w["top"] - s["first"]) >= gap)
        line = s["line"] + F.when(new, 1).otherwise(0)
        return F.struct(line.alias("line"), F.when(new, w["top"]).otherwise(s["first"]).alias("first"), F.concat(s["out"], F.array(F.struct(line.alias("line"), w["x0"].alias("x0"), w["text"].alias("text")))).alias("out"))

    lines = F.sort_array(F.aggregate(F.sort_array(words), state, step)["out"])
    tops = words["top"]
    one = F.array_max(tops) - F.array_min(tops) < gap  # most cells have one line, which needs no fold
    return F.when(F.size(words) == 1, words[0]["text"]).when(one, F.array_join(F.sort_array(F.arrays_zip(words["x0"], words["text"]))["text"], " ")).otherwise(F.array_join(F.transform(lines, lambda x: x["text"]), " "))


def cells(banded: DataFrame) -> DataFrame:
    """doc_id, page, row, col, text of every cell that has words."""
    return banded.select(*PAGE, "row", F.inline("cells")).select(*PAGE, "row", "col", F.array_join("texts", " ").alias("text"))


def records(banded: DataFrame) -> DataFrame:
    """Records of rows that have a city: cells from the sixth on are the services, blank fields but the city null."""

    def text_of(i: int) -> Column:
        return F.array_join(F.get(F.filter("cells", lambda c: c["col"] == i), F.lit(0))["texts"], " ")

    rest = F.array_join(F.transform(F.filter("cells", lambda c: c["col"] >= 5), lambda c: F.array_join(c["texts"], " ")), " ").alias("c5")
    rows = banded.select(*PAGE, "row", *[text_of(i).alias(f"c{i}") for i in range(5)], rest)
    rows = rows.where((F.coalesce("c0", F.lit("")) != "") & (F.upper(fold(F.col("c0"))) != "MUNICIPIO"))
    return rows.select(*PAGE, "row", squeeze(F.col("c0")).alias("municipio"), *[blank_to_null(squeeze(F.col(f"c{i}"))).alias(FIELDS[i]) for i in range(1, 6)])


def extract(words: DataFrame, shapes: DataFrame) -> DataFrame:
    """All records of ruled pages. Words are shuffled once, by page."""
    return records(band_cells(words, cut_edges(words, gate(page_edges(shapes)))))


def confident(words: DataFrame, least: int = 30) -> DataFrame:
    """Words with a text and a confidence of at least least; one that is no number is -1."""
    return words.where((F.trim(F.coalesce("text", F.lit(""))) != "") & (F.coalesce(F.col("confidence").cast("string").try_cast("double"), F.lit(-1.0)) >= least))


def confidences(words: DataFrame) -> DataFrame:
    """doc_id, mean and (halves to even) rounded confidence over a document's words."""
    return words.groupBy("doc_id").agg(F.avg("confidence").alias("mean"), F.bround(F.avg("confidence"), 0).cast("int").alias("confidence"))


def left_column(words: DataFrame, gap: float = 50.0, least: int = 3) -> DataFrame:
    """doc_id, page, left, right: the leftmost run of beginnings without a gap that has enough words."""
    by_x = Window.partitionBy(*PAGE).orderBy("x0")
    starts = F.when(F.col("x0") - F.lag("x0").over(by_x) > gap, 1).otherwise(0)
    runs = words.withColumn("_s", starts).withColumn("_run", F.sum("_s").over(by_x)).groupBy(*PAGE, "_run").agg(F.min("x0").alias("a"), F.max("x0").alias("b"), F.count(F.lit(1)).alias("n"))
    first = runs.where(F.col("n") >= least).groupBy(*PAGE).agg(F.min_by(F.struct("a", "b"), "_run").alias("r"))
    return first.select(*PAGE, (F.col("r.a") - 5).alias("left"), (F.col("r.b") + 50).alias("right"))


def unit_start(words: DataFrame) -> DataFrame:
    """doc_id, page, x: the upper median of the beginnings of words that start like a unit's name."""
    named = words.where(F.lower("text").rlike(UNIT_STARTS))
    xs = F.sort_array(F.collect_list("x0"))
    return named.groupBy(*PAGE).agg(F.get(xs, F.floor(F.size(xs) / 2).cast("int")).alias("x"))


def mean_height() -> Column:
    return F.coalesce(F.avg(F.when(F.col("bottom") > F.col("top"), F.col("bottom") - F.col("top"))), F.lit(20.0))


def starts(levels: Column, tolerance: Column) -> Column:
    """Of ascending values those over tolerance beyond the last one kept."""

    def keep(kept: Column, e: Column) -> Column:
        return F.when((F.size(kept) == 0) | (e - F.try_element_at(kept, F.lit(-1)) > tolerance), F.concat(kept, F.array(e))).otherwise(kept)

    return F.aggregate(levels, F.array().cast("array<double>"), keep)


def measures(words: DataFrame, gap: float = 50.0, least: int = 3) -> DataFrame:
    """doc_id, page, height (mean), left and right (as left_column has them, null where there is none) and unit_x (as unit_start has it), from one pass over words."""
    tall = F.when(F.col("bottom") > F.col("top"), F.col("bottom") - F.col("top"))
    by_x = words.groupBy(*PAGE, "x0").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.lower("text").rlike(UNIT_STARTS)).alias("units"), F.sum(tall).alias("tall"), F.count(tall).alias("heights"))
    page = by_x.groupBy(*PAGE).agg((F.sum("tall") / F.nullif(F.sum("heights"), F.lit(0))).alias("height"), F.sum("units").alias("units"), F.sort_array(F.collect_list(F.struct("x0", "n", "units"))).alias("xs"))
    nothing = F.struct(*[F.lit(None).cast("double").alias(c) for c in ("a", "b")], F.lit(0).cast("long").alias("n"))

    def run(s: Column, x: Column) -> Column:
        over = s["n"] >= least  # the first run that is long enough stays, once a gap has ended it
        new = s["b"].isNull() | (x["x0"] - s["b"] > gap)
        longer = F.struct(s["a"].alias("a"), x["x0"].alias("b"), (s["n"] + x["n"]).alias("n"))
        begun = F.struct(x["x0"].alias("a"), x["x0"].alias("b"), x["n"].alias("n"))
        return F.when(~new, longer).when(over, s).otherwise(begun)

    def median(s: Column, x: Column) -> Column:
        upto = s["n"] + x["units"]
        return F.struct(F.when((s["n"] <= F.col("half")) & (upto > F.col("half")), x["x0"]).otherwise(s["x"]).alias("x"), upto.alias("n"))

    page = page.withColumn("half", F.floor(F.col("units") / 2)).withColumn("run", F.aggregate("xs", nothing, run))
    unit_x = F.aggregate("xs", F.struct(F.lit(None).cast("double").alias("x"), F.lit(0).cast("long").alias("n")), median)["x"]
    enough = F.col("run.n") >= least
    return page.select(*PAGE, F.coalesce("height", F.lit(20.0)).alias("height"), F.when(enough, F.col("run.a") - 5).alias("left"), F.when(enough, F.col("run.b") + 50).alias("right"), unit_x.alias("unit_x"))


def anchors(words: DataFrame, ratio: float = 1.2) -> DataFrame:
    """doc_id, page, anchor (0-based), height, left, right, y_top, y_bottom, text: rows that begin in the left column.

    A word joins the row whose first word's centre lies within ratio times the page's mean height. Rows are found among a page's distinct centres.
    """
    rows = _anchors(words, ratio, False)
    return rows.select(*PAGE, "anchor", "height", "left", "right", "y_top", "y_bottom", F.array_join("names", " ").alias("text"))


#: What a word is by its text alone: marks that a task reads as bits, and the kinds of token above them.
MARKS = ["fit", "unit", "head", "letter", "street"]
KINDS = ["telefone", "cnes", "atendimento"]
PARTS = ["names", "more", "unit_texts", "address", *KINDS]


def _anchors(words: DataFrame, ratio: float, owned: bool, gap: float = 50.0, least: int = 3) -> DataFrame:
    """Rows of the left column with lists of texts in reading order: their own words (names) and, if owned, the words of each part of their records.

    An anchor owns the words from a quarter of a height above it to the next one, but heads; the address begins with the first free word that is a number or a street word.
    """
    w = F.col("text")
    head, letter = is_head(w), w.rlike(r"\p{L}")
    marks = {"fit": letter & ~head & ~is_foot(w), "unit": F.lower(w).rlike(UNIT_STARTS)}
    if owned:
        marks |= {"head": head, "letter": letter, "street": w.rlike(r"\d") | F.btrim(F.lower(fold(w)), F.lit(",.")).isin(STREET_WORDS)}
    bits = [F.when(rule, 1 << MARKS.index(m)).otherwise(0) for m, rule in marks.items()]
    if owned:
        kind = token_class(w)
        bits.append(F.when(kind.isNull(), 0).when(kind == KINDS[0], 32).when(kind == KINDS[1], 64).otherwise(96))
    marked = words.dropna(subset=[*PAGE, "top", "bottom"]).select(*PAGE, "x0", "pos", "text", "top", "bottom", sum(bits[1:], bits[0]).alias("marks"))
    parts = PARTS if owned else PARTS[:1]
    values = ["height", "left", "right", "y_top", "y_bottom"]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x0, top, bottom, pos = reading.numbers(batch, "x0", "top", "bottom", "pos")
            batch = reading.sorted_within(batch, (top + bottom) / 2, x0, pos)
            x0, top, bottom, pos, bits = reading.numbers(batch, "x0", "top", "bottom", "pos", "marks")
            is_ = {m: bits >> i & 1 > 0 for i, m in enumerate(MARKS)}
            kind, y = bits >> 5, (top + bottom) / 2
            first_rows = reading.page_starts(batch)
            page, anchor, figures = [], [], []
            at, sizes = {p: [] for p in parts}, {p: [] for p in parts}
            for a, b in zip(first_rows, [*first_rows[1:], batch.num_rows], strict=True):
                run = reading.left_run(np.sort(x0[a:b]), gap, least)
                if run is None:
                    continue
                height, left, right = reading.mean_height(top[a:b], bottom[a:b]), run[0] - 5, run[1] + 50
                in_left = (x0[a:b] >= left) & (x0[a:b] <= right)
                fit = a + np.flatnonzero(is_["fit"][a:b] & in_left)
                if not len(fit):
                    continue
                ys = y[fit]
                begins = np.searchsorted(ys, reading.apart(np.unique(ys), height * ratio))
                y_top, y_bottom = np.minimum.reduceat(top[fit], begins), np.maximum.reduceat(bottom[fit], begins)
                n = len(begins)
                if owned:
                    units = np.sort(x0[a:b][is_["unit"][a:b]])
                    limit = units[len(units) // 2] if len(units) else right + 300
                    order = np.argsort(y_top - height / 4, kind="stable")  # tops needn't rise as centres do
                    mine = np.arange(a, b)
                    owner = np.searchsorted((y_top - height / 4)[order], y[a:b], side="right") - 1
                    has = (owner >= 0) & ~is_["head"][a:b]
                    mine, owner, away = mine[has], order[owner[has]], ~in_left[has]
                    other, free = kind[mine] > 0, away & (kind[mine] == 0)
                    street = np.cumsum(free & is_["street"][mine])
                    reached = np.zeros(n, np.int64)
                    new = np.flatnonzero(np.diff(owner, prepend=-1))  # an anchor's words are together
                    reached[owner[new]] = street[new] - (free & is_["street"][mine])[new]
                    late = street > reached[owner]
                    near = np.abs(y[mine] - ((y_top + y_bottom) / 2)[owner]) <= height * ratio
                    more = np.flatnonzero(near & (x0[mine] > right) & (x0[mine] < limit) & is_["letter"][mine] & ~other)
                    more = more[np.lexsort((pos[mine[more]], x0[mine[more]], owner[more]))]
                    found = {"more": more, "unit_texts": np.flatnonzero(free & ~late), "address": np.flatnonzero(free & late)}
                    found |= {k: np.flatnonzero(away & (kind[mine] == i + 1)) for i, k in enumerate(KINDS)}
                    for p, f in found.items():
                        f = f[np.argsort(owner[f], kind="stable")]
                        at[p].append(mine[f])
                        sizes[p].append(np.bincount(owner[f], minlength=n))
                    keep = np.bincount(owner, minlength=n) > 0
                else:
                    keep = np.ones(n, bool)
                at["names"].append(fit)
                sizes["names"].append(np.diff(np.append(begins, len(fit))))
                page.append(np.where(keep, a, -1))
                anchor.append(np.arange(n))
                figures.append(np.stack([*[np.full(n, v) for v in (height, left, right)], y_top, y_bottom]))
            if page:
                keys = np.concatenate(page)
                rows = pa.array(np.maximum(keys, 0), pa.int64())
                columns = [batch.column(c).take(rows) for c in PAGE] + [pa.array(np.concatenate(anchor), pa.int32())]
                columns += [pa.array(f) for f in np.concatenate(figures, axis=1)] + [reading.lists(batch.column("text"), at[p], sizes[p]) for p in parts]
                yield pa.RecordBatch.from_arrays(columns, names=[*PAGE, "anchor", *values, *parts]).filter(pa.array(keys >= 0))

    kinds = {f.name: f.dataType.simpleString() for f in marked.schema.fields}
    schema = f"doc_id {kinds['doc_id']}, page {kinds['page']}, anchor int, {', '.join(f'`{v}` double' for v in values)}, {', '.join(f'{p} array<string>' for p in parts)}"
    return reading.by_page(marked, read, schema)


def anchored_records(words: DataFrame, ratio: float = 1.2) -> DataFrame:
    """Records of pages without lines: each anchor owns the words from a quarter of a height above it to the next one."""
    rows = _anchors(words, ratio, True)
    city = squeeze(F.concat_ws(" ", F.array_join("names", " "), F.nullif(F.array_join("more", " "), F.lit(""))))
    texts = {"unidade": F.array_join("unit_texts", " "), "endereco": F.array_join("address", " "), "telefones": F.array_join("telefone", " ")}
    cnes = F.btrim(F.get("cnes", F.lit(0)), F.lit(" |,")).alias("cnes")
    services = blank_to_null(squeeze(F.array_join("atendimento", ", "))).alias("atendimentos_raw")
    out = rows.select(*PAGE, "anchor", city.alias("municipio"), *[blank_to_null(squeeze(t)).alias(c) for c, t in texts.items()], cnes, services)
    return out.where(valid_city(F.col("municipio")))


def valid_city(city: Column) -> Column:
    """At least three letters, and not the beginning of a unit's name."""
    first = F.btrim(F.lower(F.get(F.split(F.trim(city), r"\s+"), F.lit(0))), F.lit(".,"))
    return (F.length(F.trim(city)) >= 3) & ~first.isin(NOT_CITIES)


def coverage_bands(words: DataFrame, columns: int = 6, least: int = 20) -> DataFrame:
    """doc_id, page, band, low, high: columns divided at the middles of the widest empty stretches (in whole points)."""
    boxes = words.select(*PAGE, "x0", "x1").distinct()  # as few as a page's columns where words are in line
    pages = boxes.groupBy(*PAGE).agg(F.min("x0").alias("a"), F.max("x1").alias("b"), F.collect_list(F.struct("x0", "x1")).alias("x"))
    rounded = F.transform("x", lambda w: F.struct(F.floor(w["x0"] - F.col("a")).alias("s"), (F.floor(w["x1"] - F.col("a")) + 1).alias("e")))
    state = F.struct(F.lit(None).cast("long").alias("upto"), F.array().cast("array<struct<width:bigint,from:bigint,to:bigint>>").alias("gaps"))

    def step(s: Column, w: Column) -> Column:
        gap = F.struct((s["upto"] - w["s"]).alias("width"), s["upto"].alias("from"), w["s"].alias("to"))  # negative, so that the widest comes first
        wider = F.slice(F.sort_array(F.concat(s["gaps"], F.array(gap))), 1, columns - 1)
        return F.struct(F.greatest(s["upto"], w["e"]).alias("upto"), F.when(w["s"] - s["upto"] >= least, wider).otherwise(s["gaps"]).alias("gaps"))

    gaps = F.aggregate(F.sort_array(rounded), state, step)["gaps"]
    cuts = F.transform(gaps, lambda g: F.col("a") + (g["from"] + g["to"]) / 2)
    limits = pages.select(*PAGE, F.sort_array(F.concat(F.array("a", F.col("b") + 1), cuts)).alias("x"))
    pairs = F.arrays_zip(F.slice("x", 1, F.size("x") - 1), F.slice("x", 2, F.size("x") - 1))
    return limits.select(*PAGE, F.posexplode(pairs).alias("band", "p")).select(*PAGE, "band", F.col("p").getField("0").alias("low"), F.col("p").getField("1").alias("high"))


def mean_lines(words: DataFrame, ratio: float = 1.2) -> DataFrame:
    """doc_id, page, line, pos: a word joins the current line if its centre lies within ratio mean heights of the line's mean centre.

    Words of one centre go together (once the first has joined a line, its mean is nearer still), so lines are folded from a page's distinct centres and their counts.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            top, bottom = reading.numbers(batch, "top", "bottom")
            y, line = (top + bottom) / 2, np.empty(batch.num_rows, np.int32)
            starts = reading.page_starts(batch)
            for a, b in zip(starts, [*starts[1:], batch.num_rows], strict=True):
                levels, counts = np.unique(y[a:b], return_counts=True)
                firsts = reading.mean_starts(levels, counts, reading.mean_height(top[a:b], bottom[a:b]) * ratio)
                line[a:b] = np.searchsorted(firsts, y[a:b], side="right") - 1
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("page"), pa.array(line), batch.column("pos")], names=[*PAGE, "line", "pos"])

    kinds = {f.name: f.dataType.simpleString() for f in words.schema.fields}
    return reading.by_page(words.select(*PAGE, "pos", "top", "bottom"), read, f"doc_id {kinds['doc_id']}, page {kinds['page']}, line int, pos {kinds['pos']}")


def line_records(lined: DataFrame, columns: DataFrame) -> DataFrame:
    """Records of lines (words with `line`) by column bands: under two head words, six columns, a city and a unit."""
    limits = columns.groupBy(*PAGE).agg(F.sort_array(F.collect_list(F.struct("band", "low", "high"))).alias("bands")).where(F.size("bands") >= 6)
    x = middle("x0", "x1")
    hit = F.filter("bands", lambda b: (b["low"] <= x) & (x <= b["high"]))
    placed = lined.join(limits.hint("shuffle_hash"), PAGE).withColumn("band", F.get(hit, F.lit(0))["band"])
    words = F.sort_array(F.collect_list(F.struct("band", "x0", "pos", "text"))).alias("words")
    rows = placed.groupBy(*PAGE, "line").agg(F.count_if(is_head(F.col("text"))).alias("_heads"), words)

    def text_of(rule) -> Column:
        return squeeze(F.array_join(F.transform(F.filter("words", rule), lambda w: w["text"]), " "))

    def held_by(i: int):
        return lambda w: w["band"] == i if i < 5 else w["band"] >= 5

    parts = [text_of(held_by(i)).alias(f) for i, f in enumerate(FIELDS)]
    rows = rows.select(*PAGE, "line", "_heads", *parts)
    return rows.where((F.col("_heads") < 2) & (F.col("municipio") != "") & (F.col("unidade") != "")).select(*PAGE, "line", "municipio", *[blank_to_null(F.col(f)).alias(f) for f in FIELDS[1:]])


def continued(rows: DataFrame, key: str = "municipio", order: str = "line") -> DataFrame:
    """Rows without a city appended, field by field, to the row with one that they follow; leading ones stand alone."""
    has = F.coalesce(F.col(key), F.lit("")) != ""
    upto = Window.partitionBy(*PAGE).orderBy(order)
    marked = rows.withColumn("_g", F.sum(F.when(has, 1).otherwise(0)).over(upto))
    marked = marked.withColumn("_g", F.when(F.col("_g") == 0, -F.row_number().over(upto)).otherwise(F.col("_g")))

    def run(c: str) -> Column:
        parts = F.sort_array(F.collect_list(F.when(F.coalesce(F.col(c), F.lit("")) != "", F.struct(order, c))))
        return blank_to_null(F.array_join(F.transform(parts, lambda x: x[c]), " "))

    out = marked.groupBy(*PAGE, "_g").agg(F.min(order).alias(order), *[run(c).alias(c) for c in FIELDS if c in rows.columns])
    return out.drop("_g")
