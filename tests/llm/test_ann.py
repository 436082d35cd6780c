"""Learned partitions in Spark at their default mass: several parts, repeated ids, recall against brute force."""

import os

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from tidelog.llm import ann


def brute(ids, x, where, k):
    """(query row, k best (score, id)) with ties to the smaller id."""
    for i in np.flatnonzero(where):
        score = (x * x[i]).sum(1)
        order = [j for j in np.lexsort((ids, -score)).tolist() if j != i][:k]
        yield i, [(int(ids[j]), float(score[j])) for j in order]


def recall(spark, rows, k=20, **how):
    """Recall of queries whose id is divisible by 20, with every answer checked for form."""
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, row string, part string")
    got: dict = {}
    for r in ann.search(table, F.col("vec_id") % 20 == 0, k, **how).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    ids, x = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], float)
    found = total = 0
    for i, best in brute(ids, x, ids % 20 == 0, k):
        mine = sorted(got[int(ids[i])])
        assert [r for r, *_ in mine] == list(range(1, len(best) + 1))
        assert all(abs(s - (x[ids == v] @ x[i]).max()) < 1e-9 for _, v, s in mine)
        found += len({v for _, v, _ in mine} & {v for v, _ in best})
        total += len(best)
    return found / total


@pytest.mark.parametrize("clustered", [True, False])
@pytest.mark.parametrize("how", [{"part_rows": 100}, {"part_rows": 30, "max_parts": 8}])
def test_recall_with_many_parts(spark, clustered, how):
    rng = np.random.default_rng(6)
    x = rng.standard_normal((1200, 16))
    if clustered:
        x = rng.standard_normal((30, 16))[rng.integers(0, 30, 1200)] + 0.3 * x
    assert recall(spark, [(i, v.tolist(), "r", "p") for i, v in enumerate(x)], **how) >= 0.9


def test_rows_are_told_apart(spark):
    rng = np.random.default_rng(7)
    x = rng.standard_normal((90, 4))
    rows = [(i // 3 * 20, v.tolist()) for i, v in enumerate(x)]  # each id three times, all queries
    rows += [(None, [1.0] * 4), (1, [0.0] * 4), (2, None), (3, [1.0, 2.0]), (20, [3.0, 4.0]), (5, [float("inf"), 1.0])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = [tuple(r) for r in ann.search(table, F.col("vec_id") % 20 == 0, 5, mass=1.1).collect()]
    ids = np.array([r[0] for r in rows[:90]])
    want = [(int(ids[i]), n + 1, v, s) for i, best in brute(ids, x, ids >= 0, 5) for n, (v, s) in enumerate(best)]
    want.append((20, 1, 3, 11.0))  # the other vector of two dimensions
    form = lambda rows: sorted((q, r, v, round(s, 9)) for q, r, v, s in rows)
    assert form(got) == form(want)


def test_hot_vector_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(ann, "BLOCK", 64)
    monkeypatch.setattr(ann, "QUERIES", 7)
    rng = np.random.default_rng(8)
    x = rng.standard_normal((600, 8))
    x[:250] = x[0]
    assert recall(spark, [(i, v.tolist(), "r", "p") for i, v in enumerate(x)], mass=1.1) == 1


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.1"])
def test_recall_on_tables(spark, sf):
    path = f"/root/testdata/{sf}/embeddings.parquet"
    if not os.path.exists(path):
        pytest.skip("no test tables")
    t = pq.read_table(path).to_pydict()
    rows = [(i, [float(c) for c in v], "r", "p") for i, v in zip(t["vec_id"], t["embedding"], strict=True) if v]
    assert recall(spark, rows) >= 0.9


def test_share_of_rows_read():
    """Routing reads a share of the rows; clustered vectors need few parts."""
    rng = np.random.default_rng(5)
    x = rng.standard_normal((40, 16))[rng.integers(0, 40, 3000)] + 0.2 * rng.standard_normal((3000, 16))
    model = ann.Model(ann.learn(x.tolist(), 20))
    probes = ann._probes(model.probabilities(x), ann.MASS, ann.MIN_PROBES)
    sizes = np.bincount(model.assign(x), minlength=model.parts)
    assert model.parts == 20 and np.mean([sizes[p].sum() for p in probes]) < 0.35 * len(x)
