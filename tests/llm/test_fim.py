"""Fill-in-middle: against a version that works on code points, on small blocks, and on odd rows."""

import hashlib
import re

import numpy as np
from pyspark.sql import functions as F

from waymark.llm import fim

DOCS = "doc_id long, text string, source string, n string, form string, output string"


def by_code_points(text, identifier, rate=90, spm=20, unit="word", seed=1):
    units = re.findall(r"[A-Za-z]+|[^A-Za-z]" if unit == "word" else r"(?s).", text)
    digest = hashlib.sha256(f"{seed}:{identifier}".encode()).hexdigest()
    h = [int(digest[i : i + 8], 16) for i in range(0, 32, 8)]
    n = len(units)
    if not text or any(x in text for x in fim.SENTINELS) or h[2] % 100 >= rate:
        return n, "plain", None, None, text
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    prefix, middle, suffix = ("".join(x) for x in (units[:a], units[a:b], units[b:]))
    if h[3] % 100 < spm:
        return n, "spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}"
    return n, "psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}"


def made_up(rng, n):
    return "".join(rng.choice(list("abZ  .\n7<>PS") + ["é", "ß", "漢", "字", "😀", "́", "\x00"], n))


def test_index_converts_both_ways():
    rng = np.random.default_rng(4)
    for _ in range(100):
        text = made_up(rng, rng.integers(0, 60))
        index = fim.SparseIndex(np.frombuffer(text.encode(), np.uint8))
        assert len(index.at) == sum(ord(c) > 127 for c in text)  # nothing is recorded of ASCII
        for i in range(len(text) + 1):
            byte = len(text[:i].encode())
            assert index.chars(byte) == i and index.bytes(i) == byte


def test_cuts_do_not_depend_on_blocks():
    rng = np.random.default_rng(5)
    for _ in range(60):
        text = made_up(rng, rng.integers(1, 80))
        for unit, pattern in (("word", r"[A-Za-z]+|[^A-Za-z]"), ("char", r"(?s).")):
            units = re.findall(pattern, text)
            for block in (1, 2, 7, 1000):
                cutter = fim.Cutter(text.encode(), unit, block)
                assert cutter.units == len(units)
                for k in range(len(units) + 1):
                    before = "".join(units[:k])
                    assert cutter.cut(k) == (len(before.encode()), len(before))


def test_rows_against_code_points(spark):
    rng = np.random.default_rng(6)
    rows = [(i, made_up(rng, rng.integers(0, 200))) for i in range(300)]
    rows += [(1000, None), (1001, ""), (1002, "a<P>b"), (1003, "<S>"), (1004, "x<M>"), (1005, "<P <S <M"), (None, "one two"), (7, "again"), (7, "again"), (1006, "Zoë " * 300_000), (1007, "漢" * 700_000)]
    docs = spark.createDataFrame([(i, t, None, "own", "own", "own") for i, t in rows], DOCS)
    for how in ({}, {"unit": "char", "rate": 100, "spm": 50, "seed": 3}):
        made = fim.transform(docs, **how)
        got = made.withColumn("back", fim.restored(F.col("form"), F.col("output"))).collect()
        want = [(i, *by_code_points(t or "", "" if i is None else i, **how)) for i, t in rows]
        assert sorted((tuple(r)[:-1] for r in got), key=str) == sorted(want, key=str)
        texts = {}
        for i, t in rows:
            texts.setdefault(i, set()).add(t or "")
        assert all(r["back"] in texts[r["doc_id"]] for r in got)
        assert {r["form"] for r in got} == {"plain", "psm", "spm"}
    assert fim.transform(docs.where("false")).count() == 0


def test_other_sentinels(spark):
    marks = ("<|fim_prefix|>", "<|fim_suffix|>", "<|fim_middle|>")
    docs = spark.createDataFrame([(i, f"Über {i} <P> one <M> two\n") for i in range(40)], "doc_id long, text string")
    got = fim.transform(docs, rate=100, spm=50, sentinels=marks).withColumn("back", fim.restored(F.col("form"), F.col("output"), marks)).collect()
    assert {r["form"] for r in got} == {"psm", "spm"}
    assert all(r["back"] == f"Über {r['doc_id']} <P> one <M> two\n" and sum(r["output"].count(x) for x in marks) == 3 for r in got)
