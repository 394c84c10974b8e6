"""Fill-in-middle transformation with a sparse index of multibyte characters.

A text is cut into prefix, middle and suffix at units: runs of ASCII letters and single other characters (unit "word"), or code points (unit "char").
Work is on UTF-8 bytes. The index of a block of text records its multibyte characters only: where they are and how many bytes
each has beyond the first. A cut becomes code points or bytes by one searchsorted in these positions; the ASCII between them is arithmetic, and
a text without multibyte characters has an empty index. Texts are read in blocks of BLOCK bytes: a first pass counts units,
a second one indexes only the blocks that the two cuts lie in, so that a worker's memory is that of the text itself.

Draws are the first four groups of eight digits of the SHA-256 of `seed:id`: the smaller and the larger of the first two, modulo units + 1, are
the units before the middle and before the suffix; the third decides whether a text is left plain, the fourth between the two orders.
Rows are independent: nothing is shuffled.

Defined results: null and empty texts are plain and empty. A text that holds a sentinel is plain, so that every output can be undone. A null identifier is
drawn as an empty one; repeated identifiers have the same draws, rows that repeat stay. Empty prefix, middle or suffix are allowed. Texts may be of any length.
Only identifier and text are read, so other columns can't clash. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from waymark.llm.common import sliced

SENTINELS = ("<P>", "<S>", "<M>")
SEED, RATE, SPM = 1, 90, 20
BLOCK, SLICE_BYTES = 1_000_000, 2_000_000


class SparseIndex:
    """Where a block of UTF-8 has multibyte characters, and the bytes that they have in excess of one."""

    def __init__(self, raw: np.ndarray):
        self.size = len(raw)
        self.at = np.flatnonzero(raw >= 0xC0)  # lead bytes
        lead = raw[self.at]
        excess = 1 + (lead >= 0xE0).astype(np.int64) + (lead >= 0xF0)
        self.upto = np.concatenate([[0], np.cumsum(excess)])  # excess of the first i exceptions

    def chars(self, byte: int) -> int:
        """Code points before a byte that begins one (or before the end)."""
        return byte - int(self.upto[np.searchsorted(self.at, byte)])

    def bytes(self, char: int) -> int:
        """Bytes before a code point."""
        return char + int(self.upto[np.searchsorted(self.at - self.upto[:-1], char)])


def unit_starts(raw: np.ndarray, after_letter: bool, unit: str) -> np.ndarray:
    """A mask of the bytes that begin a unit; after_letter: whether a letter precedes the block."""
    starts = (raw & 0xC0) != 0x80
    if unit == "word":
        letter = ((raw | 0x20) - np.uint8(97)) < 26
        starts[1:] &= ~(letter[1:] & letter[:-1])
        if after_letter and len(raw):
            starts[0] &= not letter[0]
    return starts


def blocks(raw: np.ndarray, size: int) -> list[tuple[int, int]]:
    """Bounds of blocks that end where a code point does."""
    bounds, at = [], 0
    while at < len(raw):
        to = min(at + size, len(raw))
        while to < len(raw) and raw[to] & 0xC0 == 0x80:
            to += 1
        bounds.append((at, to))
        at = to
    return bounds


class Cutter:
    """Units of a text, and the bytes and code points before a number of them."""

    def __init__(self, text: bytes, unit: str = "word", block: int = BLOCK):
        self.raw, self.unit = np.frombuffer(text, np.uint8), unit
        self.bounds = blocks(self.raw, block)
        counts = [(int(np.count_nonzero(self._starts(a, b))), int(np.count_nonzero((self.raw[a:b] & 0xC0) != 0x80))) for a, b in self.bounds]
        self.before = np.concatenate([np.zeros((1, 2), np.int64), np.cumsum(np.array(counts, np.int64).reshape(-1, 2), 0)])  # units and code points before each block
        self.units = int(self.before[-1, 0])

    def _starts(self, a: int, b: int) -> np.ndarray:
        after_letter = a > 0 and (int(self.raw[a - 1]) | 0x20) - 97 in range(26)
        return unit_starts(self.raw[a:b], after_letter, self.unit)

    def cut(self, units: int) -> tuple[int, int]:
        """Bytes and code points before the unit of this number, or before the end."""
        if units == self.units:
            return len(self.raw), int(self.before[-1, 1])
        i = int(np.searchsorted(self.before[:, 0], units, side="right")) - 1
        (a, b), within = self.bounds[i], units - int(self.before[i, 0])
        index = SparseIndex(self.raw[a:b])
        if self.unit == "char":
            byte = index.bytes(within)
        else:
            byte = int(np.flatnonzero(self._starts(a, b))[within])
        return a + byte, int(self.before[i, 1]) + index.chars(byte)


def rearranged(text: bytes, draws: list[int], rate: int, spm: int, unit: str, sentinels: tuple[bytes, bytes, bytes], block: int = BLOCK) -> tuple[int, str, int | None, int | None, bytes]:
    """n, form, prefix_chars, middle_chars and output of a text."""
    cutter = Cutter(text, unit, block)
    n, (p, s, m) = cutter.units, sentinels
    if not text or any(x in text for x in sentinels) or draws[2] % 100 >= rate:
        return n, "plain", None, None, text
    (a, a_chars), (b, b_chars) = (cutter.cut(k) for k in sorted((draws[0] % (n + 1), draws[1] % (n + 1))))
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    if draws[3] % 100 < spm:
        return n, "spm", a_chars, b_chars - a_chars, b"".join([s, suffix, p, prefix, m, middle])
    return n, "psm", a_chars, b_chars - a_chars, b"".join([p, prefix, s, suffix, m, middle])


def draws_of(identifier: Column, seed: int) -> Column:
    """Four numbers of 32 bits."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(identifier.cast("string"), F.lit(""))), 256)
    return F.array(*[F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 10).cast("long") for i in range(4)])


def transform(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = SEED, rate: int = RATE, spm: int = SPM, unit: str = "word", sentinels: tuple[str, str, str] = SENTINELS) -> DataFrame:
    """doc_id, n (units), form (plain, psm or spm), prefix_chars, middle_chars and output for every row of docs.

    rate: of 100 texts, those that aren't left plain; spm: of 100 of these, those with the suffix first.
    """
    if unit not in ("word", "char"):
        raise ValueError(f"unit is word or char, not {unit}")
    marks = tuple(x.encode() for x in sentinels)
    out = T.StructType([T.StructField("doc_id", docs.schema[id_col].dataType), T.StructField("n", T.LongType()), T.StructField("form", T.StringType()), T.StructField("prefix_chars", T.LongType()), T.StructField("middle_chars", T.LongType()), T.StructField("output", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, 1, SLICE_BYTES):
            rows = [rearranged(text, draws, rate, spm, unit, marks) for text, draws in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
            n, form, prefix, middle, output = zip(*rows, strict=True) if rows else ((), (), (), (), ())
            longs = [pa.array(x, pa.int64()) for x in (n, prefix, middle)]
            yield pa.RecordBatch.from_arrays([batch.column(0), longs[0], pa.array(form, pa.string()), *longs[1:], pa.array(output, pa.string())], names=out.names)

    given = docs.select(F.col(id_col).alias("doc_id"), F.encode(F.coalesce(F.col(text_col), F.lit("")), "UTF-8").alias("text"), draws_of(F.col(id_col), seed).alias("draws"))
    return given.mapInArrow(run, out)


def restored(form: Column, output: Column, sentinels: tuple[str, str, str] = SENTINELS) -> Column:
    """The text that an output was made from."""
    p, s, m = sentinels

    def parts(first: str, second: str, third: str) -> tuple[Column, Column, Column]:
        rest = F.substr(output, F.lit(len(first) + 1))
        one = F.substring_index(rest, second, 1)
        rest = F.substr(rest, F.length(one) + len(second) + 1)
        two = F.substring_index(rest, third, 1)
        return one, two, F.substr(rest, F.length(two) + len(third) + 1)

    prefix, suffix, middle = parts(p, s, m)
    psm = F.concat(prefix, middle, suffix)
    suffix, prefix, middle = parts(s, p, m)
    return F.when(form == "psm", psm).when(form == "spm", F.concat(prefix, middle, suffix)).otherwise(output)
