"""Pages read in order in tasks: Spark shuffles and sorts words by page, a small numpy function sees one page at a time and says where it is cut.

Pages come whole, whatever batches Arrow makes of them. Words leave as they came, as lists of a page's parts: texts are not touched.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

PAGE = ["doc_id", "page"]


def by_page(words: DataFrame, read: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """What read makes of batches of whole pages of words. Words are shuffled and sorted once, by page."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return read(whole_pages(batches))

    return words.repartition(*PAGE).sortWithinPartitions(*PAGE).mapInArrow(run, schema)


def page_starts(batch: pa.RecordBatch) -> np.ndarray:
    """The rows at which another page begins than the row before is of; 0 is one of them."""
    new = np.zeros(max(batch.num_rows - 1, 0), bool)
    for name in PAGE:
        c = batch.column(name)
        differs = pc.not_equal(c[1:], c[:-1])
        nulls = pc.xor(c[1:].is_null(), c[:-1].is_null())
        new |= pc.or_(pc.fill_null(differs, False), nulls).to_numpy(zero_copy_only=False)
    return np.concatenate([[0], np.flatnonzero(new) + 1])


def changes(*keys: np.ndarray) -> np.ndarray:
    """Where a row's keys are not those of the row before; the first row's are not."""
    return np.append(True, np.logical_or.reduce([k[1:] != k[:-1] for k in keys]))


def ordered(texts: pa.Array, at: np.ndarray, *keys: np.ndarray) -> np.ndarray:
    """Some rows in the order of keys, and of texts where all keys are equal."""
    keys = tuple(k[at] for k in reversed(keys))
    order = np.lexsort(keys)
    if not changes(*(k[order] for k in keys)).all():
        order = np.lexsort((np.unique(np.array(texts.take(pa.array(at)).fill_null("").to_pylist(), object), return_inverse=True)[1], *keys))
    return at[order]


def sorted_within(batch: pa.RecordBatch, *keys: np.ndarray) -> pa.RecordBatch:
    """Whole pages with their rows in the order of keys, and of texts where all keys are equal."""
    page = np.zeros(batch.num_rows, np.int64)
    page[page_starts(batch)[1:]] = 1
    return batch.take(pa.array(ordered(batch.column("text"), np.arange(batch.num_rows), np.cumsum(page), *keys)))


def lines(tops: np.ndarray, gap: float) -> list[int]:
    """The line of each of ascending tops: one begins where a top is gap or more beyond its first."""
    out, first, line = [], None, -1
    for t in tops.tolist():
        if first is None or t - first >= gap:
            first, line = t, line + 1
        out.append(line)
    return out


def joined(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
    return batches[0] if len(batches) == 1 else pa.concat_batches(batches)


def whole_pages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows in batches that end where pages do. Rows of a page that goes on are held as they came until it ends."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        last = int(page_starts(batch)[-1])
        if last:
            yield joined([*held, batch.slice(0, last)])
            held = []
        elif held and len(page_starts(joined([held[-1].slice(held[-1].num_rows - 1), batch.slice(0, 1)]))) > 1:
            yield joined(held)
            held = []
        held.append(batch.slice(last))
    if held:
        yield joined(held)


def numbers(batch: pa.RecordBatch, *names: str) -> list[np.ndarray]:
    """Columns as numpy arrays; a missing number is NaN, a missing mark false."""
    return [(pc.fill_null(c, False) if pa.types.is_boolean(c.type) else c).to_numpy(zero_copy_only=False) for c in (batch.column(n) for n in names)]


def lists(values: pa.Array, at: list[np.ndarray], sizes: list[np.ndarray]) -> pa.ListArray:
    """Lists of the values at some places, as many in each as sizes say."""
    places, n = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (at, sizes))
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]), pa.int32()), values.take(pa.array(places, pa.int64())))


def rows_of(batch: pa.RecordBatch, names: list[str]) -> pa.StructArray:
    return pa.StructArray.from_arrays([batch.column(n) for n in names], names=names)


def apart(levels: np.ndarray, tolerance: float) -> np.ndarray:
    """Of ascending values those over tolerance beyond the last one kept."""
    kept: list[float] = []
    for e in levels.tolist():
        if not kept or e - kept[-1] > tolerance:
            kept.append(e)
    return np.array(kept)


def mean_starts(levels: np.ndarray, counts: np.ndarray, tolerance: float) -> np.ndarray:
    """The first level of each line: a level joins the current line if it lies within tolerance of the line's mean."""
    kept, total, n = [], 0.0, 0
    for y, k in zip(levels.tolist(), counts.tolist(), strict=True):
        if n and abs(y - total / n) <= tolerance:
            total, n = total + y * k, n + k
        else:
            kept.append(y)
            total, n = y * k, k
    return np.array(kept)


def mean_height(top: np.ndarray, bottom: np.ndarray) -> float:
    tall = (bottom - top)[bottom > top]
    return float(tall.mean()) if len(tall) else 20.0


def left_run(xs: np.ndarray, gap: float, least: int) -> tuple[float, float] | None:
    """The leftmost run of ascending beginnings without a gap that has enough of them."""
    xs = xs[~np.isnan(xs)]
    ends = np.concatenate([[0], np.flatnonzero(np.diff(xs) > gap) + 1, [len(xs)]])
    long = np.flatnonzero(np.diff(ends) >= least)
    return (float(xs[ends[long[0]]]), float(xs[ends[long[0] + 1] - 1])) if len(long) else None


def bands(edges: np.ndarray, values: np.ndarray) -> np.ndarray:
    """The first band (0-based) that holds each value, both ends included; -1 if none does."""
    inside = np.searchsorted(edges, values)
    out = np.where((inside > 0) & (inside < len(edges)), inside - 1, -1)
    if len(edges) > 1:
        out[values == edges[0]] = 0
    return out
