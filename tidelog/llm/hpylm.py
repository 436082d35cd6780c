"""Language-model scores from a hierarchical Pitman-Yor model (operator 7).

A restaurant per context serves words: P(w|u) = ((c - d t) + (theta + d T) P(w)) /
(theta + C). The context is the word before, or the start of the text. Restaurants are
numbered by a hash of that word to WIDTH - 1 numbers, so at a large vocabulary rare
words share theirs; the table of (word, context) pairs grows with the corpus, and what
is kept of all contexts at once, two counts each, does not. All contexts share as
parent the restaurant of P(w), whose base spells words. Spell is itself a hierarchy:
the restaurant of a context of four bytes within the word has as parent the one of its
last three, shared by all contexts that end so, and on to the restaurant without
context, whose base is uniform over 256 bytes and the end of a word. The customers of
each parent are the tables of its children (Teh 2006; Mochihashi et al. 2009). So every
word, known or not, has a probability.

Gibbs: in turn the customers of each dish leave together and are seated again one
after another by the Chinese-restaurant rule, given the parent's predictive
probabilities and the other dishes' tables. After BURN_IN rounds the predictive
probabilities of SAMPLES rounds are averaged. Discounts are n1 / (n1 + 2 n2).

Spark: texts are cut into chunks, and each sends its distinct (word, context) pairs
once to a partition of the vocabulary by the word's hash, with counts. There is a
partition for every PART_BYTES of text. A partition's vocabulary is one packed row,
kept as a table in the shared folder. In a round each partition sends its distinct byte
contexts to one of BUCKETS buckets by their last two bytes, where all contexts that
share parents meet; the bucket samples its restaurants and sends back probabilities.
Restaurants of one byte of context and of none, 257 x 257 counts, are sampled on the
driver; they and WIDTH counts of tables are all that reaches it or is broadcast.
Scores: each chunk's pairs get their values back by partition and chunk, and each text
sums them. A very common word is sent once per chunk, a very common context once per
partition.

Defined cases: null text is empty and has one token, the end; no training documents
give counts of zero and the uniform spelling; equal rows are documents each; a null
doc_id counts as the empty text for the choice of training rows; an empty table gives
an empty result; other columns are not read.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, discard, id_and_text, materialize, parallelism, release
from .wordbytes import mix

BURN_IN, SAMPLES = 2, 3
S = 257  # bytes and the end (as context: the start) of a word
#: Bytes of context.
ORDER = 4
STRENGTH = 1.0
WORD_STRENGTH = 1.0
#: Numbers of contexts; 0 is the start of a text.
WIDTH = 1 << 16
CHUNK = 8 << 20
#: Text for which there is a partition of the vocabulary, and buckets of byte contexts.
PART_BYTES = 32 << 20
BUCKETS = 128
HOLD_OUT = 10


def _names(schema: str) -> list[str]:
    return [x.split()[0] for x in schema.split(", ")]


def is_held_out(doc_id) -> bool:
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % HOLD_OUT == 0


def seat(count: np.ndarray, pull: np.ndarray, discount: float, rng: np.random.Generator) -> np.ndarray:
    """Tables after seating ``count`` customers of each dish; pull = (strength + discount T) x base.

    A customer opens a table with probability pull / (pull + seated - discount tables).
    Where few tables open, the next opening is drawn at once, by inverting the
    probability that none opens before; where many do, runs of customers of a
    fiftieth of those seated are drawn together.
    """
    tables = (count > 0).astype(np.int64)
    seated = tables.copy()
    todo = np.flatnonzero(count > 1)
    while len(todo):
        n, t, c, a = seated[todo].astype(float), tables[todo], count[todo], np.maximum(pull[todo], 1e-300)
        rest = n - discount * t
        few = a < 20
        with np.errstate(over="ignore", divide="ignore"):
            shift = (a - 1) / 2
            ahead = np.maximum(rest + shift, 1e-9) * np.exp(np.minimum(-np.log(1 - rng.random(len(todo))) / a, 600)) - shift - rest
        jump = np.maximum(np.ceil(np.minimum(ahead, 4e18)), 1)
        run = np.maximum(1, np.minimum(n // 50, c - n))
        many = rng.binomial(run.astype(np.int64), np.minimum(a / (a + rest), 1))
        step = np.where(few, jump, run)
        opened = np.where(few, (n + jump <= c).astype(np.int64), many)
        tables[todo] = t + opened
        seated[todo] = np.minimum(n + step, c).astype(np.int64)
        todo = todo[seated[todo] < count[todo]]
    return tables


def _codes(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(each byte or end with its ORDER signs of context, base 257, latest last; where words start)."""
    size = np.fromiter(map(len, words), np.int64, len(words)) + 1
    start = np.concatenate(([0], np.cumsum(size)[:-1]))
    out = np.full(int(size.sum()), 256, np.int64)
    inside = np.ones(len(out), bool)
    inside[start + size - 1] = False
    out[inside] = np.frombuffer(b"".join(words), np.uint8)
    code, sign = out.copy(), out
    for k in range(1, ORDER + 1):
        sign = np.concatenate(([256], sign[:-1]))
        sign[start] = 256
        code += sign * S**k
    return code, start


def _discount(n: np.ndarray) -> float:
    once, twice = int((n == 1).sum()), int((n == 2).sum())
    return float(np.clip(once / max(1, once + 2 * twice), 0.1, 0.95))


class Level:
    """All restaurants of one context length: dishes ``key``, grouped by context."""

    def __init__(self, key: np.ndarray, customers: np.ndarray) -> None:
        self.key = key
        _, self.own = np.unique(key // S, return_inverse=True)
        self.set(customers)
        self.tables = (customers > 0).astype(np.int64)

    def set(self, customers: np.ndarray) -> None:
        self.customers = customers
        self.total = np.bincount(self.own, customers)

    def seat(self, parent: np.ndarray, rng: np.random.Generator) -> None:
        self.tables = seat(self.customers, self._reach() * parent, self.discount, rng)

    def _reach(self) -> np.ndarray:
        return (STRENGTH + self.discount * np.bincount(self.own, self.tables))[self.own]

    def predict(self, parent: np.ndarray) -> np.ndarray:
        kept = np.maximum(self.customers - self.discount * self.tables, 0)
        return (kept + self._reach() * parent) / (STRENGTH + self.total[self.own])

    @property
    def discount(self) -> float:
        return _discount(self.customers)


def sample_contexts(code: np.ndarray, n: np.ndarray, pairs: np.ndarray, rng: np.random.Generator, sweeps: int = 2) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Restaurants of two to ORDER bytes of context, under ``pairs`` = P(sign | last byte).

    code: distinct, sorted; n: customers, zero for contexts that are only asked for.
    Returns the probability of each code, and (key, customers) for the one-byte level.
    """
    levels, up = [Level(code, n)], []
    for k in range(ORDER - 1, 1, -1):
        key, inverse = np.unique(levels[-1].key % S ** (k + 1), return_inverse=True)
        up.append(inverse)
        levels.append(Level(key, np.bincount(inverse, levels[-1].tables, minlength=len(key)).astype(np.int64)))
    last = levels[-1].key % (S * S)
    base = pairs.ravel()[last]

    def predictive() -> list[np.ndarray]:
        out = [levels[-1].predict(base)]
        for level, inverse in zip(levels[-2::-1], up[::-1], strict=True):
            out.append(level.predict(out[-1][inverse]))
        return out[::-1]

    for _ in range(sweeps):
        p = predictive()
        for i, level in enumerate(levels):
            level.seat(p[i + 1][up[i]] if i < len(up) else base, rng)
            if i < len(up):
                levels[i + 1].set(np.bincount(up[i], level.tables, minlength=len(levels[i + 1].key)).astype(np.int64))
    key, inverse = np.unique(last, return_inverse=True)
    return predictive()[0], key, np.bincount(inverse, levels[-1].tables, minlength=len(key)).astype(np.int64)


def sample_top(customers: np.ndarray, root: np.ndarray, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """Restaurants of one byte of context and of none -> their predictive probabilities."""
    key = np.arange(S * S)
    level = Level(key, customers)
    level.seat(root[key % S], rng)
    top = Level(np.arange(S), np.bincount(key % S, level.tables, minlength=S).astype(np.int64))
    top.seat(np.full(S, 1 / S), rng)
    root = top.predict(np.full(S, 1 / S))
    return level.predict(root[key % S]).reshape(S, S), root


_CUT = "kind int, chunk long, part int, ids binary, sizes binary, index binary, words binary, owner binary, context binary, counts binary"


def _pack(x: np.ndarray) -> bytes:
    """Compressed by byte planes: the high bytes of small numbers cost next to nothing."""
    return zstandard.compress(np.ascontiguousarray(np.ascontiguousarray(x).view(np.uint8).reshape(len(x), -1).T).tobytes(), 1)


def _load(data: bytes, kind: str) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(data), np.uint8).reshape(np.dtype(kind).itemsize, -1)
    return np.ascontiguousarray(planes.T).view(kind).ravel()


def _rounded(x: np.ndarray) -> np.ndarray:
    """float32 with 15 bits of fraction, so that they compress."""
    return ((x.astype("<f4").view("<u4") + np.uint32(128)) & np.uint32(0xFFFFFF00)).view("<f4")


def contexts_of(crc: np.ndarray) -> np.ndarray:
    """Numbers of the contexts that words make, by their CRC-32."""
    return (crc.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(32)).astype(np.int64) % (WIDTH - 1) + 1


def _cut(batches: Iterator[pa.RecordBatch], parts: int) -> Iterator[pa.RecordBatch]:
    """Texts -> one row of token indexes per chunk, and its distinct (word, context) by partition."""
    for ids, texts in chunks(batches, CHUNK):
        chunk = uuid.uuid4().int >> 65
        known: dict[bytes, int] = {}
        sizes, index, train = [], [], []
        for doc_id, text in zip(ids, texts, strict=True):
            words = text.lower().split()
            words.append(b"")
            index.append(np.array([known.setdefault(w, len(known)) for w in words], np.int32))
            sizes.append(len(words))
            train.append(not is_held_out(doc_id))
        every = np.concatenate(index).astype(np.int64)
        words = list(known)
        crc = np.fromiter(map(zlib.crc32, words), np.int64, len(words))
        context = np.concatenate(([0], contexts_of(crc)[every[:-1]]))
        context[np.concatenate(([0], np.cumsum(sizes)[:-1]))] = 0
        pair, own = np.unique(every * WIDTH + context, return_inverse=True)
        learnt = np.repeat(np.array(train), sizes)
        count = np.bincount(own[learnt], minlength=len(pair))
        part = (crc % parts)[pair // WIDTH]
        order = np.argsort(part, kind="stable")
        rank = np.empty(len(pair), np.int32)
        rank[order] = np.arange(len(pair), dtype=np.int32)
        bound = np.searchsorted(part[order], np.arange(parts + 1))
        raw_ids = np.array([0 if i is None else i for i in ids], "<i8")
        flags = np.array([2 * (i is None) + (not t) for i, t in zip(ids, train, strict=True)], "<i4")
        rows = [(0, chunk, -1, raw_ids.tobytes(), np.array(sizes, "<i4").tobytes() + flags.tobytes(), _pack(rank[own]), None, None, None, None)]
        for p in np.flatnonzero(np.diff(bound)).tolist():
            at = order[bound[p] : bound[p + 1]]
            used, owner = np.unique(pair[at] // WIDTH, return_inverse=True)
            # Pairs are in order of their words, so the owners are told by how many each has.
            many = np.bincount(owner).astype("<u4")
            rows.append((1, chunk, p, None, None, None, _packed(words[i] for i in used.tolist()), _pack(many), (pair[at] % WIDTH).astype("<u2").tobytes(), _pack(count[at].astype("<u4"))))
        kinds = (pa.int32(), pa.int64(), pa.int32(), *[pa.binary()] * 7)
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=_names(_CUT))


def _packed(words) -> bytes:
    return zstandard.compress(b" ".join(words), 1)


def _split(data: bytes) -> list[bytes]:
    return zstandard.decompress(data).split(b" ")


#: Of a partition: its words; how many pairs each has, and their contexts, sorted; counts and tables by pair; tops
#: (tables of the parent) by word; and log10 of the sum of P(w) over sampled rounds by word, then of each the tables by pair.
_VOCAB = "part int, words binary, many binary, contexts binary, counts binary, tables binary, tops binary, kept array<binary>"


def _row(*values) -> pa.RecordBatch:
    kinds = (pa.int32(), *[pa.binary()] * 6, pa.list_(pa.binary()))
    return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds, strict=True)], names=_names(_VOCAB))


def _vocabulary(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Word rows sorted by part -> a packed vocabulary per part."""

    def merge(held: list) -> list:
        pair, own = np.unique(np.concatenate([p for p, _ in held]), return_inverse=True)
        return [(pair, np.bincount(own, np.concatenate([n for _, n in held]), minlength=len(pair)).astype(np.int64))]

    def close(part: int, known: dict[bytes, int], held: list) -> pa.RecordBatch:
        ((pair, count),) = merge(held)
        word = pair // WIDTH
        served = np.bincount(word, count > 0, minlength=len(known)) > 0
        many = np.bincount(word, minlength=len(known)).astype("<u4")
        tables = (count > 0).astype("<u4")
        return _row(part, _packed(known), _pack(many), (pair % WIDTH).astype("<u2").tobytes(), _pack(count.astype("<u4")), _pack(tables), _pack(served.astype("<u4")), [])

    part, known, held = None, {}, []
    for batch in batches:
        for p, words, many, context, counts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if p != part:
                if part is not None:
                    yield close(part, known, held)
                part, known, held = p, {}, []
            at = np.array([known.setdefault(w, len(known)) for w in _split(words)], np.int64)
            held.append((np.repeat(at, _load(many, "<u4")) * WIDTH + np.frombuffer(context, "<u2"), _load(counts, "<u4")))
            if sum(len(x) for x, _ in held[1:]) > max(1 << 21, len(held[0][0])):
                held = merge(held)
    if part is not None:
        yield close(part, known, held)


class Totals:
    """Sums over the vocabulary, by context where it matters."""

    def __init__(self, vocab: DataFrame) -> None:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums = np.zeros(2 * WIDTH + 8, np.int64)
            for batch in batches:
                for many, contexts, counts, tables, tops in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    many, c, t, top = (_load(x, "<u4") for x in (many, counts, tables, tops))
                    context = np.frombuffer(contexts, "<u2")
                    sums[:WIDTH] += np.bincount(context, c, minlength=WIDTH).astype(np.int64)
                    sums[WIDTH : 2 * WIDTH] += np.bincount(context, t, minlength=WIDTH).astype(np.int64)
                    word = np.repeat(np.arange(len(many)), many)
                    up = np.bincount(word, t, minlength=len(top))
                    served = np.bincount(word, c, minlength=len(top)) > 0
                    sums[2 * WIDTH :] += [int(x.sum()) for x in (c, served, t, top, c == 1, c == 2, up == 1, up == 2)]
            at = np.flatnonzero(sums)
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(sums[at])], names=["i", "n"])

        # Some partitions a task: each sends WIDTH sums.
        some = vocab.coalesce(max(1, min(parallelism(vocab.sparkSession), -(-vocab.count() // 8))))
        got = some.select("many", "contexts", "counts", "tables", "tops").mapInArrow(run, "i long, n long").groupBy("i").agg(F.sum("n").alias("n"))
        sums = np.zeros(2 * WIDTH + 8, np.int64)
        found = got.toArrow()  # 2 WIDTH + 8 sums
        sums[found.column("i").to_numpy()] = found.column("n").to_numpy()
        self.customers, self.tables = sums[:WIDTH], sums[WIDTH : 2 * WIDTH]
        self.n, self.v, self.parent_customers, self.parent_tables, one, two, up_one, up_two = sums[2 * WIDTH :].tolist()
        self.discount = float(np.clip(one / max(1, one + 2 * two), 0.1, 0.95))
        self.parent_discount = float(np.clip(up_one / max(1, up_one + 2 * up_two), 0.1, 0.95))

    def reach(self) -> np.ndarray:
        """The weight of the parent in each context: theta + d T."""
        return WORD_STRENGTH + self.discount * self.tables


def seat_words(word: np.ndarray, context: np.ndarray, count: np.ndarray, table: np.ndarray, top: np.ndarray, spell: np.ndarray, totals: Totals, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs, then the parent's dishes, seated again -> (tables, the parent's tables, P(w))."""
    d0, d1 = totals.parent_discount, totals.discount
    base = (WORD_STRENGTH + d0 * totals.parent_tables) * spell

    def parent(table: np.ndarray, top: np.ndarray) -> np.ndarray:
        up = np.bincount(word, table, minlength=len(top))
        return (np.maximum(up - d0 * top, 0) + base) / (WORD_STRENGTH + totals.parent_customers)

    table = seat(count, totals.reach()[context] * parent(table, top)[word], d1, rng)
    top = seat(np.bincount(word, table, minlength=len(top)).astype(np.int64), base, d0, rng)
    return table, top, parent(table, top)


_ASKED = "bucket int, part int, codes binary, n binary"


def _bucket(code: np.ndarray, buckets: int) -> np.ndarray:
    return (mix((code // S % (S * S)).astype(np.uint64)) % np.uint64(buckets)).astype(np.int64)


def _ask(vocab: DataFrame, buckets: int) -> DataFrame:
    """Each partition's distinct codes by bucket, with the word tables spelled through them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, words, tables in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                code, start = _codes(_split(words))
                weight = np.repeat(_load(tables, "<u4").astype(np.int64), np.diff(np.concatenate((start, [len(code)]))))
                key, own = np.unique(code, return_inverse=True)
                n = np.bincount(own, weight).astype(np.int64)
                bucket = _bucket(key, buckets)
                order = np.argsort(bucket, kind="stable")
                edge = np.flatnonzero(np.diff(bucket[order], prepend=-1))
                rows = [(int(bucket[at[0]]), part, key[at].tobytes(), _pack(n[at])) for at in np.split(order, edge[1:])]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), (pa.int32(), pa.int32(), pa.binary(), pa.binary()), strict=True)], names=["bucket", "part", "codes", "n"])

    return vocab.select("part", "words", "tops").mapInArrow(run, _ASKED)


def _sample_buckets(batches: Iterator[pa.RecordBatch], pairs: np.ndarray, seed: int) -> Iterator[pa.RecordBatch]:
    """Rows sorted by bucket -> (part, bucket, values), and part -1 for the one-byte level."""

    def close(bucket: int, rows: list) -> pa.RecordBatch:
        codes = [np.frombuffer(c, np.int64) for _, c, _ in rows]
        code, own = np.unique(np.concatenate(codes), return_inverse=True)
        n = np.bincount(own, np.concatenate([_load(x, "<i8") for *_, x in rows]), minlength=len(code)).astype(np.int64)
        p, key, customers = sample_contexts(code, n, pairs, np.random.default_rng([seed, bucket]))
        at = np.split(own, np.cumsum([len(c) for c in codes])[:-1])
        out = [(part, bucket, np.log10(p[i]).astype("<f4").tobytes()) for (part, *_), i in zip(rows, at, strict=True)]
        out.append((-1, bucket, np.concatenate((key, customers)).tobytes()))
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), (pa.int32(), pa.int32(), pa.binary()), strict=True)], names=["part", "bucket", "values"])

    now, rows = None, []
    for batch in batches:
        for bucket, part, codes, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if bucket != now:
                if rows:
                    yield close(now, rows)
                now, rows = bucket, []
            rows.append((part, codes, n))
    if rows:
        yield close(now, rows)


def _reseat(batches: Iterator[pa.RecordBatch], buckets: int, totals: Totals, seed: int, keep: bool) -> Iterator[pa.RecordBatch]:
    """A part's vocabulary, then its answers by bucket -> the vocabulary seated again."""

    def close(state: tuple, values: dict[int, bytes]) -> pa.RecordBatch:
        part, words, many, contexts, counts, tables, tops, kept = state
        rng = np.random.default_rng([seed, part])
        code, start = _codes(_split(words))
        key, own = np.unique(code, return_inverse=True)
        order = np.argsort(_bucket(key, buckets), kind="stable")
        p = np.empty(len(key))
        p[order] = np.concatenate([np.frombuffer(values[b], "<f4") for b in sorted(values)])
        size = _load(many, "<u4")
        word, context = np.repeat(np.arange(len(size)), size), np.frombuffer(contexts, "<u2")
        count, table, top = (_load(x, "<u4").astype(np.int64) for x in (counts, tables, tops))
        spell = 10.0 ** np.add.reduceat(p[own], start)
        table, top, parent = seat_words(word, context, count, table, top, spell, totals, rng)
        tables = _pack(table.astype("<u4"))
        if keep:
            summed = parent + (10.0 ** _load(kept[0], "<f4").astype(float) if kept else 0)
            kept = [_pack(np.log10(np.maximum(summed, 1e-300)).astype("<f4")), *kept[1:], tables]
        return _row(part, words, many, contexts, counts, tables, _pack(top.astype("<u4")), kept)

    state, values = None, {}
    for batch in batches:
        for bucket, answer, *vocab in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if bucket < 0:
                if state:
                    yield close(state, values)
                state, values = vocab, {}
            else:
                values[bucket] = answer
    if state:
        yield close(state, values)


def _round(vocab: DataFrame, pairs: np.ndarray, totals: Totals, seed: int, keep: bool) -> tuple[DataFrame, np.ndarray]:
    """One round: the next vocabulary and the customers of the one-byte restaurants."""
    spark = vocab.sparkSession
    deal = parallelism(spark)
    shared, sums = spark.sparkContext.broadcast(pairs), spark.sparkContext.broadcast(totals)
    asked = _ask(vocab, BUCKETS).repartition(deal, "bucket").sortWithinPartitions("bucket", "part")
    told = materialize(asked.mapInArrow(lambda it: _sample_buckets(it, shared.value, seed), "part int, bucket int, values binary"))
    customers = np.zeros(S * S, np.int64)
    for row in told.where("part = -1").select("values").toLocalIterator():  # 257 x 257 counts in all
        key, n = np.frombuffer(row[0], np.int64).reshape(2, -1)
        customers[key] += n
    blank = [F.lit(None).cast(x.split()[1]).alias(x.split()[0]) for x in _VOCAB.split(", ")[1:]]
    state = vocab.select(F.lit(-1).alias("bucket"), F.lit(None).cast("binary").alias("answer"), *_names(_VOCAB))
    answers = told.where("part >= 0").select("bucket", F.col("values").alias("answer"), "part", *blank)
    met = state.unionByName(answers).repartition(deal, "part").sortWithinPartitions("part", "bucket")
    seated = materialize(met.mapInArrow(lambda it: _reseat(it, BUCKETS, sums.value, seed, keep), _VOCAB))
    discard(told)
    discard(vocab)
    return seated, customers


def train(vocab: DataFrame, burn_in: int = BURN_IN, samples: int = SAMPLES) -> tuple[DataFrame, list[Totals]]:
    """The vocabulary with the tables of sampled rounds, and the totals of each of them."""
    release(vocab.sparkSession)
    totals, kept = Totals(vocab), []
    root = np.full(S, 1 / S)
    pairs = np.full((S, S), 1 / S)
    for r in range(burn_in + samples):
        vocab, customers = _round(vocab, pairs, totals, r, r >= burn_in)
        pairs, root = sample_top(customers, root, np.random.default_rng([r, 999]))
        release(vocab.sparkSession)  # this round's shuffles
        totals = Totals(vocab)
        if r >= burn_in:
            kept.append(totals)
    return vocab, kept


def predictive(word: np.ndarray, context: np.ndarray, count: np.ndarray, kept: list[bytes], totals: list[Totals]) -> np.ndarray:
    """P(w|u) of each pair, averaged over the sampled rounds; P(w), that varies least, is averaged beforehand."""
    out = np.zeros(len(word))
    if not kept:
        return out
    up = 10.0 ** _load(kept[0], "<f4").astype(float)[word] / len(totals)
    for tables, own in zip(kept[1:], totals, strict=True):
        out += (np.maximum(count - own.discount * _load(tables, "<u4"), 0) + own.reach()[context] * up) / (WORD_STRENGTH + own.customers)[context]
    return out / len(totals)


def _answers(batches: Iterator[pa.RecordBatch], totals: list[Totals]) -> Iterator[pa.RecordBatch]:
    """Vocabulary then word rows of each part -> each chunk's values: counts by word, log10 P by pair."""
    known: dict[bytes, int] = {}
    pair = seen = value = None
    for batch in batches:
        out = []
        for chunk, part, words, many, contexts, counts, kept in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            size = _load(many, "<u4")
            context = np.frombuffer(contexts, "<u2")
            if chunk is None:
                known = {w: i for i, w in enumerate(_split(words))}
                word, count = np.repeat(np.arange(len(size)), size), _load(counts, "<u4")
                pair = word * WIDTH + context
                seen = np.bincount(word, count, minlength=len(known)).astype("<u4")
                value = _rounded(np.log10(np.maximum(predictive(word, context, count, kept, totals), 1e-300)))
            else:
                own = np.array([known[w] for w in _split(words)], np.int64)
                at = np.searchsorted(pair, np.repeat(own, size) * WIDTH + context)
                out.append((chunk, part, _pack(seen[own]), many, _pack(value[at])))
        if out:
            kinds = (pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=["chunk", "part", "count", "many", "value"])


_RESULT = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def _sum_up(batches: Iterator[pa.RecordBatch], n: int, v: int) -> Iterator[pa.RecordBatch]:
    """A chunk's token row (part -1), then its values by part -> a row per document."""

    def close(held: list) -> pa.RecordBatch:
        ids, sizes, index, counts, values = held
        ids, index = np.frombuffer(ids, "<i8"), _load(index, "<i4")
        both = np.frombuffer(sizes, "<i4")
        sizes, flags = both[: len(ids)], both[len(ids) :]
        count = np.concatenate([np.repeat(_load(c, "<u4"), _load(m, "<u4")) for c, m in counts]).astype(np.int64)
        value = np.concatenate([_load(v, "<f4") for v in values]).astype(np.float64)
        base = np.log10((count + 0.1) / (n + 0.1 * (v + 1)))
        start = np.concatenate(([0], np.cumsum(sizes)[:-1]))
        known, base, score = (np.add.reduceat(x[index], start) for x in ((count > 0).astype(np.int64), base, value))
        columns = [pa.array(ids, mask=flags & 2 > 0), pa.array(flags & 1 > 0), pa.array(sizes.astype(np.int64)), pa.array(known), pa.array(np.full(len(ids), n, np.int64)), pa.array(base), pa.array(score)]
        return pa.RecordBatch.from_arrays(columns, names=_names(_RESULT))

    held = None
    for batch in batches:
        for part, ids, sizes, index, count, many, value in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if part < 0:
                if held:
                    yield close(held)
                held = [ids, sizes, index, [], []]
            else:
                held[3].append((count, many))
                held[4].append(value)
    if held:
        yield close(held)


def _told(words: DataFrame, vocab: DataFrame, totals: list[Totals]) -> DataFrame:
    """(chunk, part, count, many, value): what each chunk's pairs are worth."""
    spark = vocab.sparkSession
    shared, nothing = spark.sparkContext.broadcast(totals), F.lit(None)
    asked = words.select("chunk", "part", "words", F.col("owner").alias("many"), F.col("context").alias("contexts"), nothing.cast("binary").alias("counts"), nothing.cast("array<binary>").alias("kept"))
    both = vocab.select(nothing.cast("long").alias("chunk"), "part", "words", "many", "contexts", "counts", "kept").unionByName(asked)
    ordered = both.repartition(parallelism(spark), "part").sortWithinPartitions("part", F.col("chunk").asc_nulls_first())
    return materialize(ordered.mapInArrow(lambda it: _answers(it, shared.value), "chunk long, part int, count binary, many binary, value binary"))


def score_documents(docs: DataFrame, burn_in: int = BURN_IN, samples: int = SAMPLES) -> DataFrame:
    """One row per document: tokens, base score and the model's log10 probability."""
    deal = parallelism(docs.sparkSession)
    rows = id_and_text(docs)
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(4, -(-size // PART_BYTES))
    cut = materialize(rows.mapInArrow(lambda it: _cut(it, parts), _CUT))
    words = cut.where("kind = 1")
    asked = words.select("part", "words", "owner", "context", "counts")
    vocab = materialize(asked.repartition(deal, "part").sortWithinPartitions("part").mapInArrow(_vocabulary, _VOCAB))
    vocab, totals = train(vocab, burn_in, samples)
    release(docs.sparkSession)
    answers = _told(words, vocab, totals)
    discard(vocab)
    release(docs.sparkSession)
    blank = lambda *names: [F.lit(None).cast("binary").alias(c) for c in names]
    texts = cut.where("kind = 0").select("chunk", "part", "ids", "sizes", "index", *blank("count", "many", "value"))
    back = texts.unionByName(answers.select("chunk", "part", *blank("ids", "sizes", "index"), "count", "many", "value"))
    n, v = (totals[-1].n, totals[-1].v) if totals else (0, 0)
    dealt = back.repartition(deal, "chunk").sortWithinPartitions("chunk", "part").select("part", "ids", "sizes", "index", "count", "many", "value")
    return dealt.mapInArrow(lambda it: _sum_up(it, n, v), _RESULT)
