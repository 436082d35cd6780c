"""Quality classifier by nearest-neighbour voting in latent-semantic space (operator 10).

Fit: at most ``MAX_FIT`` labelled documents (smallest hash of doc_id first, so the
choice is the same on every run) are turned into hashed feature counts, weighted by
log-tf and idf, and reduced by a truncated SVD. Their unit vectors and labels are
broadcast: MAX_FIT x RANK floats, a fixed bound. Score: every document is projected,
its cosine with every labelled vector is computed exactly in blocks, and the labels
of the NEIGHBOURS nearest vote with similarity^POWER as weight.

Features are counts, up to 65,535 each, of hashed byte bigrams of the text, words,
word endings, word shapes and repeats of the previous word: fixed width, so one pass
of numpy per text.

Defined cases: a null or empty text is projected to the zero vector and gets the
share of label 1 in the fit; labels without document or with null quality are
ignored; several labels of one document count as their rounded mean; of rows with
equal doc_id each is scored by its own text, and the smallest text is the one that is
fitted; no labels at all give the score 0.5; an empty table gives an empty result;
other columns are not read, and keep their values where rows are dropped.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import wordbytes
from .common import chunks, discard, id_and_text, materialize

MAX_FIT = 6000
RANK = 64
NEIGHBOURS = 25
#: Chosen by cross-validation among training rows.
POWER = 16
THRESHOLD = 0.3
#: Buckets of byte bigrams, words and word endings.
_PAIRS, _LEXICON, _ENDINGS = 2048, 2048, 2048
_TAIL = _PAIRS + _LEXICON + _ENDINGS
WIDTH = _TAIL + 64
#: Largest count that a feature takes, in the fit as in scores.
MOST = 65535
_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True
#: Per byte: one in a 21-bit field for capitals, digits or other ASCII signs.
_FIELD = np.zeros(256, np.int64)
_FIELD[33:127] = 1 << 42
_FIELD[97:123], _FIELD[65:91], _FIELD[48:58] = 0, 1, 1 << 21
_BUCKET = (np.arange(65536, dtype=np.uint32) * np.uint32(2654435761) >> np.uint32(20)).astype(np.intp)


def features(text: bytes) -> np.ndarray:
    """Feature counts of one text, float32[WIDTH]."""
    out = np.zeros(WIDTH, np.float32)
    if not text:
        return out
    raw = np.frombuffer(text, np.uint8)
    wide = raw.astype(np.intp)
    out[:_PAIRS] = np.bincount(_BUCKET[wide[:-1] << 8 | wide[1:]] >> 1, minlength=_PAIRS)
    word = np.zeros(len(raw) + 2, np.int8)
    word[1:-1] = ~_SPACE[raw]
    edge = np.flatnonzero(np.diff(word))
    starts, ends = edge[::2], edge[1::2]
    n = len(starts)
    if not n:
        return np.minimum(out, MOST)
    size = ends - starts
    mark = wordbytes.span_hashes(wordbytes.prefix_hashes(raw), starts, ends)
    out[_PAIRS : _PAIRS + _LEXICON] = np.bincount((mark >> np.uint64(53)).astype(np.intp), minlength=_LEXICON)
    last = wide[ends - 1] << 8 | wide[np.maximum(ends - 2, starts)]
    out[_PAIRS + _LEXICON : _TAIL] = np.bincount(_BUCKET[last] >> 1, minlength=_ENDINGS)
    packed = np.zeros(len(raw) + 1, np.int64)
    np.cumsum(_FIELD[raw], out=packed[1:])
    packed = packed[ends] - packed[starts]
    upper, digit, other = packed & 0x1FFFFF, packed >> 21 & 0x1FFFFF, packed >> 42
    tail = out[_TAIL:]
    tail[0] = np.count_nonzero(mark[1:] == mark[:-1])
    tail[1], tail[2], tail[3] = (upper == size).sum(), (other == size).sum(), (other >= 2).sum()
    tail[4], tail[5] = (digit > 0).sum(), (upper >= 2).sum()
    tail[6], tail[7] = n - len(np.unique(mark)), np.count_nonzero(raw == 10)
    tail[8:24] = np.bincount(np.minimum(size, 15), minlength=16)
    tail[24:36] = np.bincount(np.minimum(other, 11), minlength=12)
    return np.minimum(out, MOST)


def weigh(x: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Counts to log-tf x idf blocks of unit length each, side by side, in place (zero blocks stay zero)."""
    tail = x[:, _TAIL:] * _TAIL_WEIGHT
    np.log1p(x, out=x)
    x *= idf
    x[:, _TAIL:] = tail
    for block, weight in ((slice(0, _PAIRS), 0.5), (slice(_PAIRS, _PAIRS + _LEXICON), 0.5), (slice(_PAIRS + _LEXICON, _TAIL), 0.5), (slice(_TAIL, None), 1.0)):
        part = x[:, block]
        part *= weight / np.maximum(np.sqrt(np.einsum("ij,ij->i", part, part)), 1e-12)[:, None]
    return x


#: Signs of repetition, shouting and symbols count more than plain word lengths.
_TAIL_WEIGHT = np.full(64, 0.5, np.float32)
_TAIL_WEIGHT[:7] = 3


def _unit(x: np.ndarray) -> np.ndarray:
    norm = np.linalg.norm(x, axis=1, keepdims=True)
    return np.where(norm > 1e-9, x / np.maximum(norm, 1e-9), 0).astype(np.float32)


def labelled(docs: DataFrame, labels: DataFrame, max_fit: int, train: F.Column | None) -> DataFrame:
    """(text, label): the bounded fit sample, by smallest hash of doc_id."""
    label = labels.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.avg("quality").alias("quality"))
    label = label.where("quality is not null").select("doc_id", (F.col("quality") >= 0.5).cast("int").alias("label"))
    if train is not None:
        label = label.where(train)
    # Top-k by hash: each task keeps max_fit rows at most.
    chosen = label.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_fit)
    ids = F.broadcast(chosen)  # max_fit rows at most
    return id_and_text(docs).join(ids, "doc_id").groupBy("doc_id", "label").agg(F.min("text").alias("text")).select("doc_id", "text", "label")


def fit(docs: DataFrame, labels: DataFrame, max_fit: int = MAX_FIT, rank: int = RANK, train: F.Column | None = None) -> dict:
    """The model: idf, projection, unit vectors, labels and the prior."""
    sample = labelled(docs, labels, max_fit, train)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [features(x.as_py()).astype("<u2").tobytes() for x in batch.column(1).cast(pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.binary()), batch.column(2)], names=["doc_id", "f", "label"])

    # Counted by all tasks at once; an iterator over the lazy plan would run them one after another.
    counted = materialize(sample.mapInArrow(count, "doc_id long, f binary, label int"))
    # One matrix of max_fit x WIDTH floats on the driver, filled row by row.
    x, y, ids = np.zeros((max_fit, WIDTH), np.float32), np.zeros(max_fit, np.float32), []
    for r in counted.toLocalIterator():
        x[len(ids)], y[len(ids)] = np.frombuffer(r.f, "<u2"), r.label
        ids.append(r.doc_id)
    discard(counted)
    n = len(ids)
    if not n:
        return {"prior": 0.5, "vectors": None}
    x, y = x[:n], y[:n]
    idf = np.log((1 + n) / (1 + np.count_nonzero(x, axis=0))).astype(np.float32) + 1
    weigh(x, idf)
    k = min(rank, *x.shape)
    # Truncated SVD by subspace iteration with a fixed start.
    q = np.random.default_rng(7).standard_normal((x.shape[1], k + 8)).astype(np.float32)
    for _ in range(5):
        q = np.linalg.qr(x.T @ (x @ q))[0].astype(np.float32)
    _, _, vt = np.linalg.svd(x @ q, full_matrices=False)
    basis = (q @ vt.T)[:, :k].astype(np.float32)
    return {"prior": float(y.mean()), "idf": idf, "basis": basis, "vectors": _unit(x @ basis), "labels": y}


def score_block(model: dict, texts: list[bytes], neighbours: int = NEIGHBOURS) -> np.ndarray:
    """Scores of some texts: exact cosines with all labelled vectors, weighted votes."""
    if model["vectors"] is None:
        return np.full(len(texts), 0.5)
    vectors, labels = model["vectors"], model["labels"]
    k = min(neighbours, len(vectors))
    out = np.empty(len(texts))
    for at in range(0, len(texts), 256):
        x = np.stack([features(t) for t in texts[at : at + 256]])
        z = _unit(weigh(x, model["idf"]) @ model["basis"])
        cos = z @ vectors.T
        near = np.argpartition(-cos, k - 1, axis=1)[:, :k]
        weight = np.maximum(np.take_along_axis(cos, near, 1).astype(np.float64), 0) ** POWER
        total = weight.sum(1)
        vote = (weight * labels[near]).sum(1) / np.maximum(total, 1e-12)
        out[at : at + 256] = np.where(total > 1e-12, vote, model["prior"])
    return np.clip(out, 0.0, 1.0)


def train_rows(doc_id: str = "doc_id") -> F.Column:
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % 5 != 0


def score_documents(docs: DataFrame, model: dict) -> DataFrame:
    """(doc_id, score) of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in chunks(batches):
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(score_block(shared.value, texts), pa.float64())], names=["doc_id", "score"])

    return id_and_text(docs).mapInArrow(run, "doc_id long, score double")


def quality_query(docs: DataFrame, labels: DataFrame) -> DataFrame:
    model = fit(docs, labels, train=train_rows())
    return score_documents(docs, model).select(
        "doc_id",
        (~train_rows()).alias("held_out"),
        "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
    )


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` without the rows scored below the threshold; columns as they were."""
    model = fit(docs, labels, train=train_rows())
    shared = docs.sparkSession.sparkContext.broadcast(model)
    text_at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [x.as_py() or b"" for x in batch.column(text_at).cast(pa.binary())]
            if texts:
                yield batch.filter(pa.array(score_block(shared.value, texts) >= threshold))

    return docs.mapInArrow(run, docs.schema)
