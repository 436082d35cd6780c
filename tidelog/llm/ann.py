"""Approximate nearest neighbours by learned partitions (operator 4).

After Dong et al., "Learning Space Partitions for Nearest Neighbor Search" (ICLR
2020). Fit, on at most ``MAX_FIT`` vectors (those of smallest hash): the exact
neighbour graph of the sample is cut into balanced parts by capacity-bound label
propagation, and a small softmax classifier learns which part a vector's neighbours
lie in. There is a part for every ``PART_ROWS`` rows, two at least; beyond
``MAX_PARTS`` each part is cut again in the same way, by a sample of its own rows.
Index: the classifier assigns every vector of the table to its most probable part.
Search: each query goes to its most probable parts until their probabilities sum to
``MASS`` (``MIN_PROBES`` at least), and the candidates there are reranked by exact
inner products in double precision.

A part's rows are dealt in blocks of about ``BLOCK`` and the queries that probe it in
blocks of about ``QUERIES``; a task holds one of each, so equal vectors, however many,
never meet in one task. Each returns a query's best k as one packed row; those of a
query are merged where they meet. The model (MAX_PARTS + 1 classifiers at most) is
the only thing broadcast.

Defined cases: vectors that are null, zero or hold null or non-finite components take
no part, as query or candidate, nor do rows without an id; vectors of several
dimensions are searched among their own kind; rows are told apart whatever their
vec_id, so each row of a repeated id is a query, and a candidate of the others; ties
go to the smaller vec_id; fewer candidates than k in the probed parts send the query
to all parts; fewer than ``LEAST`` different vectors in the sample make one part; an
empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, parallelism

MAX_FIT = 8192
PART_ROWS = 500
MAX_PARTS = 256
LEAST = 32
BLOCK = 8192
QUERIES = 2048
GRAPH_K = 20
MASS = 0.95
MIN_PROBES = 2
K = 20


def clean(table: DataFrame, id_col: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(vec_id, v): rows whose vectors take part, as arrays of doubles."""
    v = F.col(vector).cast("array<double>")
    rows = table.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v")).where("vec_id is not null and v is not null and size(v) > 0")
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    return rows.where(fine)


def neighbour_graph(x: np.ndarray, k: int) -> np.ndarray:
    """Indexes of the k nearest others of each row, by inner product, in blocks."""
    k = min(k, len(x) - 1)
    out = np.zeros((len(x), max(k, 0)), np.int64)
    for at in range(0, len(x) if k > 0 else 0, 1024):
        score = x[at : at + 1024] @ x.T
        score[np.arange(len(score)), at + np.arange(len(score))] = -np.inf
        out[at : at + 1024] = np.argpartition(-score, k - 1, axis=1)[:, :k]
    return out


def balanced_parts(x: np.ndarray, graph: np.ndarray, parts: int, rounds: int = 30) -> np.ndarray:
    """Parts of about equal size that cut few edges: moves by gain under a capacity."""
    n = len(x)
    rng = np.random.default_rng(11)
    centres = x[rng.choice(n, parts, replace=False)]
    unit = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
    capacity = math.ceil(1.1 * n / parts)
    label = np.zeros(n, np.int64)
    for _ in range(12):  # a balanced k-means start
        norm = centres / np.maximum(np.linalg.norm(centres, axis=1, keepdims=True), 1e-12)
        label = _fill(unit @ norm.T, capacity)
        for p in range(parts):
            if (label == p).any():
                centres[p] = unit[label == p].mean(0)
    for _ in range(rounds):
        votes = np.zeros((n, parts))
        np.add.at(votes, (np.arange(n)[:, None], label[graph]), 1)
        np.add.at(votes, (graph.ravel(), np.repeat(label, graph.shape[1])), 1)  # edges count both ways
        votes[np.arange(n), label] += 0.5
        moved = _fill(votes, capacity)
        if (moved == label).mean() > 0.999:
            break
        label = moved
    return label


def _fill(wish: np.ndarray, capacity: int) -> np.ndarray:
    """Each row takes its best column with room; rows with most to lose choose first."""
    order = np.argsort(-wish, axis=1)
    two = np.take_along_axis(wish, order[:, :2], 1)
    regret = two[:, 0] - (two[:, 1] if wish.shape[1] > 1 else 0)
    room = np.full(wish.shape[1], capacity)
    label = np.full(len(wish), -1)
    for i in np.argsort(-regret, kind="stable").tolist():
        for p in order[i]:
            if room[p]:
                label[i] = p
                room[p] -= 1
                break
    return label


def train(x: np.ndarray, graph: np.ndarray, label: np.ndarray, parts: int, steps: int = 400) -> dict:
    """A one-layer softmax on unit vectors; targets: where a vector and its neighbours lie."""
    n = len(x)
    target = np.zeros((n, parts), np.float32)
    np.add.at(target, (np.arange(n)[:, None], label[graph]), 1)
    target[np.arange(n), label] += max(1, graph.shape[1] // 4)
    target /= target.sum(1, keepdims=True)
    z = (x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)).astype(np.float32)
    z = np.concatenate([z, np.ones((n, 1), np.float32)], 1)
    w = np.zeros((z.shape[1], parts), np.float32)
    m, s = np.zeros_like(w), np.zeros_like(w)
    for t in range(1, steps + 1):
        p = _softmax(z @ w)
        g = z.T @ (p - target) / n + 1e-6 * w
        m = 0.9 * m + 0.1 * g
        s = 0.99 * s + 0.01 * g * g
        w -= 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(s / (1 - 0.99**t)) + 1e-8)
    return {"w": w, "dim": x.shape[1], "parts": parts}


def _softmax(a: np.ndarray) -> np.ndarray:
    e = np.exp(a - a.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def route(model: dict, x: np.ndarray) -> np.ndarray:
    """Probabilities of the parts for each row."""
    z = (x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)).astype(np.float32)
    return _softmax(np.concatenate([z, np.ones((len(z), 1), np.float32)], 1) @ model["w"])


def learn(rows: list, parts: int) -> dict | None:
    """The classifier of one cut of sampled vectors; None if they are too few for two parts."""
    distinct = np.unique(np.array(rows), axis=0)  # equal vectors are one vertex
    parts = min(parts, len(distinct) // (LEAST // 2))
    if parts < 2:
        return None
    graph = neighbour_graph(distinct, GRAPH_K)
    return train(distinct, graph, balanced_parts(distinct, graph, parts), parts)


class Model:
    """A cut into parts, and cuts of parts; leaves are numbered through."""

    def __init__(self, top: dict | None, below: dict[int, dict] | None = None) -> None:
        self.top, self.below = top, below or {}
        sizes = [self.below[p]["parts"] if p in self.below else 1 for p in range(top["parts"] if top else 1)]
        self.first = np.concatenate(([0], np.cumsum(sizes))).astype(np.int64)
        self.parts = int(self.first[-1])

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        """Of the leaves, for each row."""
        if self.top is None:
            return np.ones((len(x), 1), np.float32)
        p = route(self.top, x)
        if not self.below:
            return p
        out = np.empty((len(x), self.parts), np.float32)
        for i in range(p.shape[1]):
            share = route(self.below[i], x) if i in self.below else 1
            out[:, self.first[i] : self.first[i + 1]] = p[:, i : i + 1] * share
        return out

    def assign(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each row: its best part, and there the best again."""
        if self.top is None:
            return np.zeros(len(x), np.int32)
        part = route(self.top, x).argmax(1)
        leaf = self.first[part]
        for i in np.unique(part).tolist():
            if i in self.below:
                at = part == i
                leaf[at] += route(self.below[i], x[at]).argmax(1)
        return leaf.astype(np.int32)


def fit(vectors: DataFrame, rows: int, max_fit: int = MAX_FIT, part_rows: int = PART_ROWS, max_parts: int = MAX_PARTS) -> Model:
    """The model for vectors of one dimension."""
    by_hash = F.xxhash64("vec_id", "v")
    sample = vectors.orderBy(by_hash, "vec_id").limit(max_fit).collect()  # max_fit rows at most
    want = max(2, round(rows / part_rows))
    top = learn([r.v for r in sample], min(want, max_parts))
    if top is None or want <= max_parts:
        return Model(top)
    finer = min(max_parts, -(-want // top["parts"]))
    shared = vectors.sparkSession.sparkContext.broadcast(Model(top))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column(1).flatten().to_numpy().reshape(batch.num_rows, -1)
            yield pa.RecordBatch.from_arrays([pa.array(shared.value.assign(x)), *batch.columns], names=["part", "vec_id", "v"])

    dealt = vectors.select("vec_id", "v").mapInArrow(assign, "part int, vec_id long, v array<double>")
    rank = F.row_number().over(Window.partitionBy("part").orderBy(by_hash, "vec_id"))
    held = dealt.withColumn("nth", rank).where(F.col("nth") <= max_fit)  # limited before and after the shuffle

    def cut(pdf: pd.DataFrame) -> pd.DataFrame:
        model = learn(pdf.v.tolist(), finer)
        return pd.DataFrame({"part": pdf.part[:1], "w": [model and model["w"].tobytes()], "parts": [model["parts"] if model else 1]})

    found = held.groupBy("part").applyInPandas(cut, "part int, w binary, parts int").where("parts > 1").collect()  # max_parts rows at most
    return Model(top, {r.part: {"w": np.frombuffer(r.w, np.float32).reshape(-1, r.parts), "dim": top["dim"], "parts": r.parts} for r in found})


def _probes(p: np.ndarray, mass: float, least: int) -> list[np.ndarray]:
    order = np.argsort(-p, axis=1, kind="stable")
    total = np.cumsum(np.take_along_axis(p, order, 1), 1)
    count = np.maximum((total < mass).sum(1) + 1, least)
    return [o[:c] for o, c in zip(order, count.tolist(), strict=True)]


_RESULT = "query_id long, rank int, vec_id long, score double"


def search(
    table: DataFrame,
    query_where: F.Column,
    k: int = K,
    mass: float = MASS,
    min_probes: int = MIN_PROBES,
    id_col: str = "vec_id",
    vector: str = "embedding",
    part_rows: int = PART_ROWS,
    max_parts: int = MAX_PARTS,
) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best found for every query row."""
    vectors = clean(table, id_col, vector)
    found = table.sparkSession.createDataFrame([], _RESULT)
    for size, rows in sorted(vectors.groupBy(F.size("v").alias("size")).count().collect()):  # one row per dimension
        own = vectors.where(F.size("v") == size)
        found = found.unionByName(_search(own, query_where, k, mass, min_probes, fit(own, rows, part_rows=part_rows, max_parts=max_parts)))
    return found


def _vectors(column: pa.Array) -> np.ndarray:
    return np.stack([np.frombuffer(x.as_buffer(), np.float64) for x in column])


def _search(vectors: DataFrame, query_where: F.Column, k: int, mass: float, min_probes: int, model: Model) -> DataFrame:
    spark = vectors.sparkSession
    shared = spark.sparkContext.broadcast(model)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column(1).flatten().to_numpy().reshape(batch.num_rows, -1)
            yield pa.RecordBatch.from_arrays([*batch.columns[::2], pa.array([v.tobytes() for v in x], pa.binary()), pa.array(shared.value.assign(x))], names=["vec_id", "row", "v", "part"])

    numbered = vectors.select("vec_id", "v", F.monotonically_increasing_id().alias("row"))
    index = materialize(numbered.mapInArrow(assign, "vec_id long, row long, v binary, part int"))
    sizes = dict(index.groupBy("part").count().collect())  # one row per part

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        have = np.array([sizes.get(p, 0) for p in range(shared.value.parts)])
        for batch in batches:
            if not batch.num_rows:
                continue
            chosen = _probes(shared.value.probabilities(_vectors(batch.column(2))), mass, min_probes)
            # Never fewer than k other candidates while there are any.
            chosen = [c[have[c] > 0] if have[c].sum() > k else np.flatnonzero(have) for c in chosen]
            owner = np.repeat(np.arange(batch.num_rows), [len(c) for c in chosen])
            yield pa.RecordBatch.from_arrays([*(c.take(pa.array(owner)) for c in batch.columns), pa.array(np.concatenate(chosen).astype(np.int32))], names=["query_id", "asker", "q", "part"])

    asked = index.where(query_where).select("vec_id", "row", "v").mapInArrow(ask, "query_id long, asker long, q binary, part int")
    asked = materialize(asked)
    probes = dict(asked.groupBy("part").count().collect())  # one row per part
    blocks = {p: (math.ceil(n / BLOCK), math.ceil(probes[p] / QUERIES)) for p, n in sizes.items() if p in probes}
    if not blocks:
        return spark.createDataFrame([], _RESULT)
    dealt = F.broadcast(spark.createDataFrame([(p, *n) for p, n in blocks.items()], "part int, blocks int, lots int"))
    # Every block of a part meets every lot of its queries.
    spread = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    own = lambda name, n: F.pmod(F.xxhash64(name), F.col(n)).cast("int")
    candidates = index.join(dealt, "part").select("part", own("row", "blocks").alias("block"), spread("lots").alias("lot"), "vec_id", "row", "v")
    queries = asked.join(dealt, "part").select("part", spread("blocks").alias("block"), own("asker", "lots").alias("lot"), "query_id", "asker", "q")

    def meet(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        """The k best of a block for each query of a lot, one packed row per query."""
        out = []
        if len(left) and len(right):
            right = right.sort_values(["vec_id", "row"], kind="stable")
            ids, rows = right.vec_id.to_numpy(), right.row.to_numpy()
            x = np.stack([np.frombuffer(b, np.float64) for b in right.v])
            for at in range(0, len(left), 256):
                part = left.iloc[at : at + 256]
                q = np.stack([np.frombuffer(b, np.float64) for b in part.q])
                rough = q @ x.T
                for i, (qid, asker) in enumerate(zip(part.query_id.tolist(), part.asker.tolist(), strict=True)):
                    score = rough[i]
                    score[rows == asker] = -np.inf
                    least = np.partition(score, -k)[-k] if len(score) > k else -np.inf
                    near = np.flatnonzero((score >= least - 1e-9 * (1 + abs(least))) & (score > -np.inf)) if least > -np.inf else np.flatnonzero(score > -np.inf)
                    exact = (x[near] * q[i]).sum(1)  # equal vectors get equal scores
                    best = np.argsort(-exact, kind="stable")[:k]
                    out.append((qid, asker, ids[near[best]].tobytes(), exact[best].tobytes()))
        return pd.DataFrame(out, columns=["query_id", "asker", "ids", "scores"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows sorted by query row -> its k best, ties to the smaller vec_id."""
        out: list = []

        def close(qid: int, held: list) -> None:
            ids = np.concatenate([np.frombuffer(a, np.int64) for a, _ in held])
            scores = np.concatenate([np.frombuffer(b, np.float64) for _, b in held])
            best = np.lexsort((ids, -scores))[:k]
            out.append((np.full(len(best), qid), np.arange(1, len(best) + 1, dtype=np.int32), ids[best], scores[best]))

        def flush() -> pa.RecordBatch:
            columns = [pa.array(np.concatenate(c)) for c in zip(*out, strict=True)]
            out.clear()
            return pa.RecordBatch.from_arrays(columns, names=["query_id", "rank", "vec_id", "score"])

        now, held = None, []
        for batch in batches:
            for qid, asker, ids, scores in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (qid, asker) != now:
                    if held:
                        close(now[0], held)
                    now, held = (qid, asker), []
                held.append((ids, scores))
            if out:
                yield flush()
        if held:
            close(now[0], held)
        if out:
            yield flush()

    keys = ("part", "block", "lot")
    met = queries.groupBy(*keys).cogroup(candidates.groupBy(*keys)).applyInPandas(meet, "query_id long, asker long, ids binary, scores binary")
    sorted_rows = met.repartition(parallelism(spark), "asker").sortWithinPartitions("asker")
    return sorted_rows.mapInArrow(merge, _RESULT)


def ann_query(embeddings: DataFrame) -> DataFrame:
    return search(embeddings, F.col("vec_id") % 20 == 0)
