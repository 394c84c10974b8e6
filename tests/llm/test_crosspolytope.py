"""Near-duplicate vectors against brute force: recall at the threshold, balls, cells, copies and odd rows."""

import numpy as np
import pytest

from waymark.llm import crosspolytope as cp

VECTORS = "vec_id long, embedding array<float>, label int, keys string, ball string"


def brute_force(rows, least=0.93):
    """{position in rows: (n_links, component_id)}"""
    fit = [i for i, (n, v, label) in enumerate(rows) if n is not None and label is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    links = {i: set() for i in range(len(rows))}
    for i in fit:
        for j in fit:
            a, b = rows[i], rows[j]
            if i != j and a[2] == b[2] and len(a[1]) == len(b[1]):
                x, y = (np.array(v, "f4").astype("f8") for v in (a[1], b[1]))
                if x @ y / np.sqrt((x @ x) * (y @ y)) >= least:
                    links[i].add(j)
    out = {}
    for i, (name, _, _) in enumerate(rows):
        reached, todo = {i}, [i]
        while todo:
            todo += (new := links[todo.pop()] - reached)
            reached |= new
        out[i] = (len(links[i]), None if name is None else min(rows[j][0] for j in reached))
    return out


def found(spark, rows, **how):
    return cp.near_vectors(spark.createDataFrame([(*r, "x", "y") for r in rows], VECTORS).repartition(3), **how).collect()


def checked(spark, rows, **how):
    got, want = found(spark, rows, **how), brute_force(rows)
    assert sorted(((r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in got), key=str) == sorted(((rows[i][0], n, c, rows[i][0] is None or c == rows[i][0]) for i, (n, c) in want.items()), key=str)
    return got


def at_cosine(rng, x, cosine):
    """A vector at just this cosine from a unit vector."""
    z = rng.normal(size=x.shape)
    z -= (z @ x) * x
    return cosine * x + np.sqrt(1 - cosine**2) * z / np.linalg.norm(z)


def test_hadamard_is_orthogonal_and_fast():
    for width in (1, 2, 8, 64):
        h = cp.hadamard(np.eye(width))
        assert (np.abs(h) == 1).all() and np.allclose(h @ h.T, width * np.eye(width))


@pytest.mark.parametrize(("width", "cosine", "least_recall"), [(64, 0.93, 0.995), (64, 0.97, 1.0), (100, 0.93, 0.99), (8, 0.93, 0.999)])
def test_recall_of_keys(width, cosine, least_recall):
    rng = np.random.default_rng(width)
    x = rng.normal(size=(3000, width))
    x /= np.linalg.norm(x, axis=1)[:, None]
    y = np.stack([at_cosine(rng, row, cosine) for row in x])
    a, b = (cp.keys(z, np.zeros(3000, np.uint64), cp.TABLES, cp.POLYTOPES, cp.PROBES) for z in (x, y))
    assert (a[:, :, None] == b[:, None, :]).any((1, 2)).mean() >= least_recall
    if width >= 64:  # and of unrelated vectors few share a key
        assert (a[:, :, None] == np.roll(b, 1, 0)[:, None, :]).any((1, 2)).mean() < 0.01


def test_against_brute_force(spark):
    """Tight and loose groups, chains, copies, scaled copies, labels and a pair just below the threshold."""
    rng = np.random.default_rng(7)
    rows = []

    def add(v, label):
        rows.append((len(rows) * 3 % 1009, [float(x) for x in np.asarray(v, "f4")], label))

    unit = lambda: (lambda x: x / np.linalg.norm(x))(rng.normal(size=16))
    for spread, n in ((0.02, 40), (0.12, 40), (0.2, 30)):
        x = unit()
        for _ in range(n):
            add(x + spread * unit(), 1)
    x = unit()
    for i in range(12):  # a chain of which only neighbours are linked
        add(x, 2)
        x = at_cosine(rng, x, 0.96)
    x = unit()
    for label in (1, 2, 2, None):
        add(x, label)
    add(5 * x, 2)
    add(at_cosine(rng, x, 0.9299), 2)
    for _ in range(60):
        add(unit(), int(rng.integers(0, 3)))
    got = checked(spark, rows)
    assert any(r["n_links"] > 30 for r in got)
    cell, cp.CELL = cp.CELL, 7
    try:
        checked(spark, rows, rounds=1)
    finally:
        cp.CELL = cell


def test_odd_rows(spark):
    inf, nan = float("inf"), float("nan")
    rows = [(1, [1.0, 0.0], 0), (2, [1.0, 0.1], 0), (2, [0.0, 1.0], 0), (2, [0.0, 1.0], 0), (3, [0.1, 1.0], 0), (4, None, 0), (5, [], 0), (6, [0.0, -0.0], 0), (7, [1.0, None], 0), (8, [nan, 1.0], 0), (9, [inf, 1.0], 0)]
    rows += [(None, [1.0, 0.0], 0), (10, [1.0, 0.0], None), (11, [1.0, 0.0], 1), (12, [1.0, 0.0, 0.0], 0), (13, [1.0], 0), (14, [2.0], 0), (15, [-1.0], 0), (16, [1e-38, 0.0], 0), (17, [3e38, 3e38], 3), (18, [1e-30, 1e-30], 3), (1, [1.0, 0.0], 0)]
    checked(spark, rows)
    checked(spark, [r for r in rows if r[0] not in (1, 2)])  # no identifier is repeated
    assert found(spark, []) == []
    with pytest.raises(ValueError):
        found(spark, rows, least=0)


def test_a_large_group_of_copies_is_not_compared(spark):
    rows = [(i, [1.0, 0.5, 0.25, 0.0], 0) for i in range(3000)] + [(5000 + i, [1.0, 0.5, 0.25, 0.01 * i], 0) for i in range(1, 40)]
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in found(spark, rows)}
    x = np.array([v for _, v, _ in rows], "f4").astype("f8")
    x /= np.linalg.norm(x, axis=1)[:, None]
    n = (x @ x[2999:].T >= 0.93)[:, 0] * 2999 + (x @ x[3000:].T >= 0.93).sum(1) + (x @ x[0] >= 0.93) - 1
    assert [got[i][0] for i, _, _ in rows] == n.tolist() and {c for _, c in got.values()} == {0}
