"""Ranked lexical search against a plain loop, with small bundles and slices, and on odd rows."""

import math
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from waymark.llm import lexical

DOCS = "doc_id long, text string, score long, slice string, bundle string, place string"
ITEMS = "item_id long, text string, term string, owner string"


def terms_of(text):
    lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", lowered)


def by_loop(items, docs, k=50):
    """{item: [(doc_id, score), ...]}"""
    asked = {}
    for i, t in items:
        if i is not None:
            asked.setdefault(i, set()).update(terms_of(t))
    held = [(i, Counter(terms_of(t))) for i, t in docs]
    held = [(i, c) for i, c in held if c]
    n_docs, n_terms = len(held), sum(c.total() for _, c in held)
    df = Counter(t for _, c in held for t in c)
    out = {}
    for item, terms in asked.items():
        scored = []
        for i, c in held:
            m = 100 - 50 + 50 * c.total() * n_docs // n_terms
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 20 * m)) for t in terms if c[t])
            if score > 0:
                scored.append((i, score))
        scored.sort(key=lambda x: (-x[1], math.inf if x[0] is None else x[0]))
        if scored:
            out[item] = scored[:k]
    return out


def searched(items, docs, **how):
    out = {}
    for r in lexical.search(items, docs, **how).orderBy("item_id", "rank").collect():
        out.setdefault(r["item_id"], []).append((r["doc_id"], r["score"]))
        assert r["rank"] == len(out[r["item_id"]])
    return out


def given(spark, items, docs):
    clash = [None] * 4
    return spark.createDataFrame([(i, t, "x", "y") for i, t in items], ITEMS), spark.createDataFrame([(i, t, *clash) for i, t in docs], DOCS).repartition(3)


def test_terms_and_blocks():
    rng = np.random.default_rng(2)
    for _ in range(100):
        text = "".join(rng.choice(list("aB zé漢7_-\n\x7f@[`{0É"), rng.integers(0, 50)))
        for block in (1, 3, 1000):
            assert lexical.term_counts(text.encode(), block) == Counter(t.encode() for t in terms_of(text))


@pytest.mark.parametrize(("sizes", "how"), [((4096, 1_000_000), {"k": 50, "shares": ()}), ((7, 1_000_000), {"k": 5, "bundle_items": 3}), ((4096, 60), {"k": 7, "shares": (0.05, 0.3)})])
def test_against_a_loop(spark, monkeypatch, sizes, how):
    monkeypatch.setattr(lexical, "SLICE_DOCS", sizes[0])
    monkeypatch.setattr(lexical, "SLICE_POSTINGS", sizes[1])
    rng = np.random.default_rng(9)
    words = np.array([f"w{i}" for i in range(60)])
    share = 1 / (1 + np.arange(60.0))
    text = lambda n: " ".join(rng.choice(words, n, p=share / share.sum()))
    docs = [(i, text(rng.integers(0, 40))) for i in range(250)]
    items = [(i, text(rng.integers(1, 9))) for i in range(20)]
    assert searched(*given(spark, items, docs), **how) == by_loop(items, docs, how["k"])


def test_odd_rows(spark):
    docs = [(1, None), (2, ""), (3, " ... "), (4, "One two"), (4, "One two"), (None, "one two"), (5, "ONE, two!"), (6, "one " * 300_000 + "three"), (7, "Éa éa"), (8, "x" * 2_000_000 + " four"), (9, "five five six")]
    docs += [(100 + i, "tie two") for i in range(80)]  # more equal scores than places
    items = [(1, "one TWO"), (2, None), (3, ""), (None, "one"), (4, "éa"), (5, "Éa"), (6, "four"), (7, "one"), (7, "three six"), (8, "nowhere"), (9, "tie"), (9, "tie")]
    want = by_loop(items, docs)
    assert set(want) == {1, 4, 5, 6, 7, 9} and [i for i, _ in want[9]] == list(range(100, 150))
    assert searched(*given(spark, items, docs)) == want
    few, none = given(spark, items, docs)
    assert searched(few, none.where("false")) == {} and searched(few.where("false"), none) == {}
    assert searched(few, none.where("doc_id < 4")) == {}


def test_frequent_terms_come_last(spark):
    """A term's owner follows its share of documents, and a term in nearly all documents weighs nothing."""
    docs = [(i, "all " + ("half " if i % 2 else "") + ("rare" if i == 7 else "")) for i in range(100)]
    items, table = given(spark, [(1, "rare half all")], docs)
    seen = []
    plans = lexical.plans

    def watched(terms, owners):
        seen.extend((r["term"], r["owner"]) for r in terms.collect())
        return plans(terms, owners)

    lexical.plans = watched
    try:
        got = searched(items, table)
    finally:
        lexical.plans = plans
    assert dict(seen) == {"rare": 1, "half": 4, "all": 4} or dict(seen) == {"rare": 1, "half": 4}
    assert got == by_loop([(1, "rare half all")], docs)


def test_string_identifiers(spark):
    docs = spark.createDataFrame([(f"d{i}", "a b" if i % 2 else "a") for i in range(9)], "name string, body string")
    items = spark.createDataFrame([("q", "b")], "item string, body string")
    got = lexical.search(items, docs, 3, "item", "name", "body").select("doc_id", F.col("rank")).collect()
    assert [r["doc_id"] for r in sorted(got, key=lambda r: r["rank"])] == ["d1", "d3", "d5"]
