"""Hard negatives against a version that scores every pair."""

import math
import random

import numpy as np
import pytest
from awkward import listed
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from trackgrid.llm import negatives, queries

SCHEMA = "vec_id long, embedding array<float>, label int"


def plain(rows, is_anchor, positives=5, wanted=10, low=30, high=90, scale=256):
    whole = []
    for i, v, label in rows:
        if None in (i, v, label) or any(x is None or not math.isfinite(x) for x in v):
            continue
        whole.append((i, tuple(math.floor(scale * float(np.float32(x))) for x in v), label))
    out = []
    for a, av, al in {r for r in whole if is_anchor(r[0])}:
        scored = [(-sum(x * y for x, y in zip(av, v)), i, label == al) for i, v, label in whole if i != a and len(v) == len(av)]
        for s, p, _ in sorted(r for r in scored if r[2])[:positives]:
            fits = sorted(r for r in scored if not r[2] and -low * s <= -100 * r[0] <= -high * s)
            out += [(a, p, k, n, -s, -t) for k, (t, n, _) in enumerate(fits[:wanted], 1)]
    return sorted(out)


def vectors(n=600, dim=12, seed=0):
    draw = random.Random(seed)
    rows = [(k, [draw.gauss(0.4, 1) for _ in range(dim)], draw.randrange(3)) for k in range(n)]
    same = [0.25 * k for k in range(dim)]
    rows += [(n + k, same, k % 2) for k in range(150)]
    rows += [(None, same, 1), (9001, None, 1), (9002, same, None), (9003, [*same[:-1], None], 1), (9004, [*same[:-1], math.nan], 0), (9005, [*same[:-1], math.inf], 0),
             (9100, [], 1), (9110, [], 2), (9101, [1.0, 2.0], 1), (9102, [1.0, 1.5], 1), (9103, [0.9, 1.0], 2), (9200, [1.0, 2.0], 1), (100, rows[100][1], 5), (100, same, 0), (30, same, 0), (30, same, 0),
             (300, *rows[300][1:]), (9300, [-x for x in same], 0), (9301, [0.0] * dim, 0), (9302, [0.0] * dim, 1)]
    return rows


ROWS = vectors()


def mined(df, **parameters):
    found = negatives.mine(df, F.col("vec_id") % 10 == 0, **parameters)
    return listed(found, "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


@pytest.mark.parametrize("rows, anchors, sparse, block", [(4096, 1024, 1 / 16, 8 << 20), (64, 7, 0.0, 8 << 20), (64, 7, 1.0, 8 << 20), (500, 50, 0.2, 4000)])
def test_every_pair_counts(spark, monkeypatch, rows, anchors, sparse, block):
    # Steps and blocks of any size give the same result; tasks read the module's settings, so they are passed on.
    for name, value in (("ROWS", rows), ("ANCHORS", anchors), ("SPARSE", sparse), ("BLOCK_OF_ANCHORS", block)):
        monkeypatch.setattr(negatives, name, value)
    df = spark.createDataFrame(ROWS, SCHEMA).repartition(5)
    assert mined(df) == sorted(plain(ROWS, lambda i: i % 10 == 0), key=repr)


def search(block, k, same, rows, low=None, high=None):
    import pyarrow as pa

    state = negatives._Search(block, k, same, low, high)
    x = np.array([r[1] for r in rows], float)
    state.rows(np.array([r[0] for r in rows]), pa.array([r[2] for r in rows]), (x.ravel(), np.arange(len(x)) * x.shape[1], np.full(len(x), x.shape[1]), np.ones(len(x), bool)))
    return sorted((int(block.ids[a]), -int(s), int(i)) for found in state.found() for a, _, i, s in zip(*found))


@pytest.mark.parametrize("sizes", [(4096, 1024, 1 / 16), (32, 3, 0.0), (32, 3, 1.0), (50, 5, 0.3)])
@pytest.mark.parametrize("scale", [1, 1000, 10**7])
def test_steps_in_a_task(monkeypatch, sizes, scale):
    import pyarrow as pa

    for name, value in zip(("ROWS", "ANCHORS", "SPARSE"), sizes):
        monkeypatch.setattr(negatives, name, value)
    draw = random.Random(scale)
    rows = [(k, [draw.randrange(-9 * scale, 9 * scale) for _ in range(6)], draw.randrange(2)) for k in range(300)] + [(k, [scale] * 6, k % 2) for k in range(300, 400)]
    chosen = rows[::37]
    block = negatives.AnchorBlock(np.array([r[0] for r in chosen]), pa.array([r[2] for r in chosen]), [np.array(r[1], float) for r in chosen])
    expected = []
    for a, av, al in chosen:
        scored = sorted((-sum(x * y for x, y in zip(av, v)), i) for i, v, label in rows if label == al and i != a)
        expected += [(a, s, i) for s, i in scored[:5]]
    assert search(block, 5, True, rows) == sorted(expected)


@settings(max_examples=200, deadline=None)
@given(st.integers(1, 70), st.integers(0, 10**6), st.sampled_from([1, 100, 10**5]))
def test_bounds_hold(dim, seed, size):
    draw = np.random.default_rng(seed)
    x, y = (np.floor(draw.normal(draw.normal(), 1, (9, dim)) * size) for _ in range(2))
    exact = x @ y.T
    widths = []
    for a, b in zip(negatives._summaries(x), negatives._summaries(y)):
        under, over = negatives._bounds(a, b, None)
        assert (under <= exact).all() and (exact <= over).all()
        r, c = np.nonzero(np.ones_like(exact, bool))
        one, two = negatives._bounds(a, b, (r, c))
        assert np.allclose(one, under.ravel()) and np.allclose(two, over.ravel())
        widths.append(over - under)
    if dim % 16 == 0:
        assert (widths[1] <= widths[0] + 1e-6 * np.abs(exact).max() + 1).all()


def test_other_types_columns_and_limits(spark):
    rows = [(i, v and [None if x is None or not math.isfinite(x) else round(8 * x) / 8 for x in v], None if label is None else str(label)) for i, v, label in ROWS]
    df = spark.createDataFrame(rows, "vec_id int, embedding array<double>, label string").withColumns({c: F.lit("own") for c in ("anchor", "range", "id", "score", "rank", "negative_id")})
    got = mined(df, positives=2, negatives=3, low=10, high=95)
    assert got == sorted(plain(rows, lambda i: i % 10 == 0, 2, 3, 10, 95), key=repr) and got


def test_empty_tables(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert mined(none) == []
    assert mined(spark.createDataFrame([(1, [1.0], 1), (3, [1.0], 2)], SCHEMA)) == []
    assert mined(spark.createDataFrame([(10, [3e38] * 4, 1), (20, [3e38] * 4, 1), (1, [1.0] * 4, 2)], SCHEMA)) == []


def test_query(spark, tmp_path):
    rows = [(i, v, label) for i, v, label in vectors(900, 16, 3)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/embeddings.parquet")
    shifted = [(i, v, label if i is None or label is None or i % 7 else (label + 1) % 10) for i, v, label in rows]
    got = listed(queries.op12_segment_summary_negatives(spark, str(tmp_path)), "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
    assert got == sorted(plain(shifted, lambda i: i % 100 == 0), key=repr) and got
