"""Language identification by a bidirectional gated recurrent network over bytes.

A text's bytes are read in stretches of CORE bytes, each with SIDE bytes of the text on either side, so that the states have come through
the neighbouring words before the first position that counts (beyond the ends of a text stands EDGE, a byte that UTF-8 hasn't). Every
position is labelled with a distribution over the languages, and a document's probabilities are the mean over all its positions that hold a
byte of a letter (an ASCII letter, or any byte beyond ASCII). A text of any length needs bounded memory.

The network is trained in numpy, by backpropagation through time and Adam, on a bounded sample of labelled rows: PIECES stretches of PIECE
characters from about DOCS_PER_LANG documents per language, at most TRAIN_PIECES, all chosen by hash.

Defined results: null text, or text without a letter, is `und` with score 0; so is every text if nothing labelled was found. Null and
repeated identifiers keep their rows. Very long texts are read whole. Ties between languages go to the smaller name.
Other columns aren't read. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from waymark.llm.common import sliced, stash

UNKNOWN = "und"
HIDDEN, CORE, SIDE, EDGE, MOST_LANGS = 12, 112, 8, 255, 1000
DOCS_PER_LANG, PIECES, PIECE, TRAIN_PIECES, STEPS, BATCH = 400, 16, 48, 40_000, 300, 128
SLICE_BYTES, ROWS = 2_000_000, 1024

#: Whether a byte belongs to a letter, as far as a single byte can tell.
LETTER = np.array([chr(i).isalpha() or i >= 128 for i in range(128)] + [True] * 128, "f4")
LETTER[EDGE] = 0


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


class ByteGru:
    """Two gated recurrent layers, one from each side, and a softmax over languages at every position."""

    def __init__(self, langs: list[str], hidden: int = HIDDEN, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.langs, self.h = langs, hidden
        self.p = {}
        for side in "fb":
            self.p[f"x{side}"] = rng.normal(0, 0.3, (256, 3 * hidden)).astype("f4")
            self.p[f"u{side}"] = rng.normal(0, 1 / hidden**0.5, (hidden, 3 * hidden)).astype("f4")
        self.p["v"] = rng.normal(0, 0.3, (2 * hidden, len(langs))).astype("f4")
        self.p["c"] = np.zeros(len(langs), "f4")

    def _side(self, side: str, b: np.ndarray, keep: list | None = None) -> np.ndarray:
        """States (steps, rows, hidden) of one direction; b: (steps, rows)."""
        h, x, u = self.h, self.p[f"x{side}"], self.p[f"u{side}"]
        state = np.zeros((b.shape[1], h), "f4")
        out = np.empty((*b.shape, h), "f4")
        for t in range(b.shape[0]) if side == "f" else range(b.shape[0] - 1, -1, -1):
            g, r = x[b[t]], state @ u
            zr = sigmoid(g[:, : 2 * h] + r[:, : 2 * h])
            z, reset = zr[:, :h], zr[:, h:]
            n = np.tanh(g[:, 2 * h :] + reset * r[:, 2 * h :])
            if keep is not None:
                keep.append((t, state, z, reset, n, r[:, 2 * h :]))
            state = n + z * (state - n)
            out[t] = state
        return out

    def positions(self, b: np.ndarray) -> np.ndarray:
        """Probabilities (steps, rows, languages)."""
        both = np.concatenate([self._side("f", b), self._side("b", b)], 2)
        return self._soft(both @ self.p["v"] + self.p["c"])

    @staticmethod
    def _soft(y: np.ndarray) -> np.ndarray:
        e = np.exp(y - y.max(-1, keepdims=True))
        return e / e.sum(-1, keepdims=True)

    def gradients(self, b: np.ndarray, lang: np.ndarray, weight: np.ndarray) -> dict[str, np.ndarray]:
        """Of the weighted cross-entropy of all positions; weight is for rows, or for steps and rows."""
        h, kept = self.h, {"f": [], "b": []}
        both = np.concatenate([self._side(s, b, kept[s]) for s in "fb"], 2)
        d = self._soft(both @ self.p["v"] + self.p["c"])
        d[:, np.arange(b.shape[1]), lang] -= 1
        weight = np.broadcast_to(weight, b.shape)
        d *= (weight / weight.sum())[:, :, None]
        g = {"v": np.einsum("trh,trc->hc", both, d), "c": d.sum((0, 1))}
        dboth = d @ self.p["v"].T
        for i, s in enumerate("fb"):
            u, gx, gu = self.p[f"u{s}"], np.zeros_like(self.p[f"x{s}"]), np.zeros_like(self.p[f"u{s}"])
            gates = np.empty((*b.shape, 3 * h), gx.dtype)
            back = np.zeros((b.shape[1], h), "f4")
            for t, state, z, reset, n, rn in reversed(kept[s]):
                back = back + dboth[t, :, i * h : (i + 1) * h]
                dz = back * (state - n) * z * (1 - z)
                dn = back * (1 - z) * (1 - n * n)
                dr = dn * rn * reset * (1 - reset)
                gates[t] = np.concatenate([dz, dr, dn], 1)
                through = np.concatenate([dz, dr, dn * reset], 1)
                gu += state.T @ through
                back = back * z + through @ u.T
            order = np.argsort(b.ravel(), kind="stable")
            found, first = np.unique(b.ravel()[order], return_index=True)
            gx[found] = np.add.reduceat(gates.reshape(-1, 3 * h)[order], first, axis=0)
            g[f"x{s}"], g[f"u{s}"] = gx, gu
        return g

    def train(self, pieces: list[bytes], lang: np.ndarray, steps: int = STEPS, seed: int = 11) -> None:
        """Adam over batches of pieces, cut and filled up to PIECE bytes; languages count alike."""
        rng = np.random.default_rng(seed)
        filled = np.full((PIECE, len(pieces)), EDGE, np.uint8)
        for i, piece in enumerate(pieces):
            filled[: min(len(piece), PIECE), i] = np.frombuffer(piece[:PIECE], np.uint8)
        own = [np.flatnonzero(lang == i) for i in range(len(self.langs))]
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        q = {k: np.zeros_like(v) for k, v in self.p.items()}
        for step in range(1, steps + 1):
            y = rng.integers(0, len(own), BATCH)
            pick = np.array([own[i][rng.integers(0, len(own[i]))] for i in y])
            b = filled[:, pick]
            rate = 0.02 * min(1, step / 20) * (1 - 0.95 * step / steps)
            for k, g in self.gradients(b, y, LETTER[b] + 1e-3).items():
                m[k] += 0.1 * (g - m[k])
                q[k] += 0.01 * (g * g - q[k])
                self.p[k] -= (rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(q[k] / (1 - 0.99**step)) + 1e-7)).astype("f4")

    def _gates(self, side: str) -> list[np.ndarray]:
        """Input and state weights of the update, reset and new gates; halved where a sigmoid is taken as a tanh of the half."""
        h, x, u = self.h, self.p[f"x{side}"], self.p[f"u{side}"]
        return [np.ascontiguousarray(w[:, i * h : (i + 1) * h] * (0.5 if i < 2 else 1)) for w in (x, u) for i in range(3)]

    def logits(self, b: np.ndarray) -> np.ndarray:
        """Unnormalised log-probabilities (steps, rows, languages): positions() without the softmax and with memory for one step only."""
        (steps, rows), h = b.shape, self.h
        out = np.empty((steps, rows, len(self.langs)), "f4")
        out[:] = self.p["c"]
        g, r, zr, new = (np.empty((rows, h), "f4") for _ in range(4))
        for i, side in enumerate("fb"):
            xz, xr, xn, uz, ur, un = self._gates(side)
            v = np.ascontiguousarray(self.p["v"][i * h : (i + 1) * h])
            state = np.zeros((rows, h), "f4")
            for t in range(steps) if side == "f" else range(steps - 1, -1, -1):
                at = b[t]

                def half(x: np.ndarray, u: np.ndarray, into: np.ndarray, at=at, state=state) -> None:
                    np.take(x, at, axis=0, out=g, mode="clip")
                    np.dot(state, u, out=into)
                    np.add(into, g, out=into)
                    np.tanh(into, out=into)
                    np.multiply(into, 0.5, out=into)
                    np.add(into, 0.5, out=into)

                half(xr, ur, zr)
                np.dot(state, un, out=r)
                np.multiply(r, zr, out=r)
                np.take(xn, at, axis=0, out=g, mode="clip")
                np.add(r, g, out=new)
                np.tanh(new, out=new)
                half(xz, uz, zr)
                np.subtract(state, new, out=state)
                np.multiply(state, zr, out=state)
                np.add(state, new, out=state)
                out[t] += state @ v
        return out

    def texts(self, raw: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each of the texts that raw holds one after the other, the summed probabilities of its letters' positions, and their number."""
        n, starts = len(ends), np.concatenate([[0], ends[:-1]]).astype(np.int64)
        parts = -(-(ends - starts) // CORE)
        of = np.repeat(np.arange(n), parts)
        first = np.cumsum(parts) - parts
        begin = starts[of] + (np.arange(len(of)) - first[of]) * CORE - SIDE
        total, count = np.zeros((len(of), len(self.langs))), np.zeros(len(of))
        span = np.arange(CORE + 2 * SIDE)[:, None]
        for a in range(0, len(of), ROWS):
            own = slice(a, a + ROWS)
            at = begin[own] + span
            inside = (at >= starts[of[own]]) & (at < ends[of[own]])
            b = np.where(inside, raw[at.clip(0, len(raw) - 1)], EDGE).astype(np.intp)
            y = self.logits(b)[SIDE:-SIDE]
            weight = LETTER[b[SIDE:-SIDE]]
            y -= y.max(-1, keepdims=True)
            np.exp(y, out=y)
            y *= (weight / y.sum(-1))[:, :, None]
            total[own], count[own] = y.sum(0), weight.sum(0)
        by_text = np.zeros((n, len(self.langs))), np.zeros(n)
        full = np.flatnonzero(parts)
        if len(full):
            by_text[0][full] = np.add.reduceat(total, first[full], axis=0)
            by_text[1][full] = np.add.reduceat(count, first[full])
        return by_text


def has_letter(text: Column) -> Column:
    return F.coalesce(text.rlike(r"\p{L}"), F.lit(False))


def training_pieces(labelled: DataFrame, docs_per_lang: int = DOCS_PER_LANG, limit: int = TRAIN_PIECES) -> DataFrame:
    """lang, piece of a bounded sample of labelled (doc_id, text, lang)."""
    labelled = labelled.where(F.col("lang").isNotNull() & has_letter(F.col("text")))
    sizes = stash(labelled.groupBy("lang").agg(F.count(F.lit(1)).alias("rows")), "languages")
    if sizes.count() > MOST_LANGS:
        raise ValueError(f"more than {MOST_LANGS} languages")
    share = F.lit(2.0**31) * docs_per_lang / F.col("rows")
    sample = labelled.join(F.broadcast(sizes), "lang").where(F.abs(F.hash("doc_id", F.lit("sample"))) <= share)  # a row for each language
    k = F.explode(F.sequence(F.lit(0), F.lit(PIECES - 1))).alias("k")
    place = F.pmod(F.xxhash64("doc_id", "k"), F.greatest(F.length("text") - PIECE, F.lit(0)) + 1).cast("int") + 1
    pieces = sample.select("lang", "doc_id", "text", k).select("lang", "doc_id", "k", F.substring("text", place, F.lit(PIECE)).alias("piece"))
    pieces = pieces.where(has_letter(F.col("piece"))).dropDuplicates(["lang", "piece"])
    return pieces.orderBy(F.xxhash64("lang", "piece"), "lang", "piece").limit(limit).select("lang", "piece")


def learn(labelled: DataFrame, **bounds) -> ByteGru | None:
    """A network trained on the sample of labelled rows; None if there is none."""
    rows = training_pieces(labelled, **bounds).toPandas()
    if not len(rows):
        return None
    langs = sorted(set(rows["lang"]))
    net = ByteGru(langs)
    if len(langs) > 1:
        net.train([x.encode() for x in rows["piece"]], np.searchsorted(langs, rows["lang"].to_numpy().astype(str)))
    return net


def identify(docs: DataFrame, net: ByteGru | None, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = (), names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """doc_id, the columns of keep, lang_pred and score (the mean probability of that language over all letters' positions); names: what these two are called."""
    kinds = [T.StructField(id_col, docs.schema[id_col].dataType), *[docs.schema[c] for c in keep]]
    out = T.StructType([*kinds, T.StructField(names[0], T.StringType()), T.StructField(names[1], T.DoubleType())])
    width, at_text = len(kinds), [id_col, *keep, text_col].index(text_col)
    shared = docs.sparkSession.sparkContext.broadcast((net.langs, net.h, net.p) if net else None)  # some thousand numbers

    def judge(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        langs, hidden, p = shared.value
        own = ByteGru.__new__(ByteGru)
        own.langs, own.h, own.p = langs, hidden, p
        letters = np.asarray(pc.match_substring_regex(texts, r"\p{L}"), bool)
        texts = texts.cast(pa.large_string())
        at = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        raw = np.frombuffer(texts.buffers()[2], np.uint8)[at[0] : at[-1]] if at[-1] > at[0] else np.zeros(1, np.uint8)
        total, count = own.texts(raw, at[1:] - at[0])
        mean = total / np.maximum(count, 1)[:, None]
        return mean.argmax(1), np.where(letters, mean.max(1), -1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, at_text, SLICE_BYTES):
            best, score = np.zeros(batch.num_rows, int), np.full(batch.num_rows, -1.0)
            if shared.value is not None:
                best, score = judge(pc.fill_null(batch.column(at_text), ""))
            pred = [shared.value[0][b] if s >= 0 else UNKNOWN for b, s in zip(best.tolist(), score.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:width], pa.array(pred, pa.string()), pa.array(score.clip(0, 1))], names=out.names)

    return docs.select(id_col, *keep, *[text_col] * (text_col not in keep)).mapInArrow(run, out)

