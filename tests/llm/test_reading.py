from __future__ import annotations

import os
import random

import numpy as np
import pytest

from symloom.llm import reading

DATA = "/root/testdata/sf0.1"
EASY = "the dog runs. we see a cat. it is red. you go home. the sun is hot.".split(". ")
HARD = "the characterisation of heterogeneous implementations, which necessitates considerable generalisation, remains inconsistent; the corresponding interpretation is approximated by subsequent investigations.".split("; ")


def text(rng, level):
    parts = [rng.choice(HARD if rng.random() < (level - 1) / 4 else EASY) for _ in range(12)]
    return ". ".join(parts) + "."


def graded(n, seed):
    rng = random.Random(seed)
    ys = [rng.choice((1, 2, 3, 4, 5)) for _ in range(n)]
    return [text(rng, y) for y in ys], ys


def test_held_out_accuracy():
    model = reading.fit(*graded(300, 1))
    texts, ys = graded(200, 2)
    got = model.level(texts)
    assert np.abs(got - ys).mean() < 0.75
    assert np.mean((got >= 3.5) == (np.array(ys) >= 4)) > 0.85
    order = model.level([text(random.Random(9), y) for y in (1, 3, 5)])
    assert order[0] < order[1] < order[2]


def test_sums_over_all_pairs():
    rng = np.random.default_rng(3)
    z, y, w = rng.normal(size=(70, 4)), rng.integers(1, 6, 70).astype(float), rng.normal(size=4)
    reading.PAIR_ROWS, was = 16, reading.PAIR_ROWS
    try:
        n, gradient, curve = reading.pair_sums(z, y, w)
    finally:
        reading.PAIR_ROWS = was
    a, b = (v.ravel() for v in np.meshgrid(np.arange(70), np.arange(70)))
    keep = y[a] > y[b]
    d = z[a[keep]] - z[b[keep]]
    p = 1 / (1 + np.exp(-d @ w))
    assert n == len(d)
    assert np.allclose(gradient, d.T @ (1 - p), rtol=1e-3, atol=1e-2)
    assert np.allclose(curve, (d * (p * (1 - p))[:, None]).T @ d, rtol=1e-3, atol=1e-2)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
def test_cross_validated_on_given_labels(spark):
    docs, labels = (spark.read.parquet(f"{DATA}/{t}.parquet") for t in ("documents", "level_labels"))
    rows = sorted(tuple(r) for r in reading.labelled_texts(docs, labels).collect())
    got = reading.cross_validated([t for _, t, _ in rows], [y for _, _, y in rows])
    truth = np.array([y for _, _, y in rows]) >= 3.5
    hits = ((got >= 3.5) & truth).sum()
    precision, recall = hits / (got >= 3.5).sum(), hits / truth.sum()
    print(f"p10 cross-validated on {len(rows)} labelled texts: precision {precision:.3f}, recall {recall:.3f}")
    assert precision > 0.9 and recall > 0.85


def test_isotonic_rises():
    x = np.arange(50.0)
    y = np.sin(x) + x / 10
    knots, levels = reading.isotonic(x, y)
    assert (np.diff(knots) > 0).all() and (np.diff(levels) > 0).all()
    assert abs(reading.isotonic(x, np.ones(50))[1][0] - 1) < 1e-12


def test_rows(spark):
    texts, ys = graded(60, 4)
    docs = spark.createDataFrame([(i, t, "a") for i, t in enumerate(texts)] + [(900, None, "a"), (901, "  \n", "a"), (902, "long " * 100_000, "a"), (None, "x", "a")], "doc_id long, text string, level string")
    labels = spark.createDataFrame([(i, f"r{k}", y, None) for i, y in enumerate(ys) for k in range(2)] + [(0, "r0", None, None), (5000, "r1", 3, None), (1, "r0", ys[1], None)], "doc_id long, rater string, level int, text string")
    model = reading.train(docs, labels)
    got = {r.doc_id: r.level for r in reading.levels(docs, model).collect()}
    assert set(got) == {*range(60), 902}
    assert all(1 <= v <= 5 for v in got.values())
    assert reading.levels(docs.where("false"), model).count() == 0
