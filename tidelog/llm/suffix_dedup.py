"""Removal of repeated byte strings by a hash-compared suffix sort (operator 6).

A byte goes if it is covered by a LENGTH-byte string that also starts anywhere else.

Sparse suffixes. Each LENGTH-byte window has an anchor: the leftmost of its GRAM-byte
substrings with the smallest hash. Equal windows have equal anchors at equal places,
so only suffixes at anchors need sorting, about 2 in LENGTH - GRAM + 2 positions, and
only against suffixes with the same anchor hash. A suffix is carried with the bytes
of the windows that it anchors, so no comparison needs another document.

1. Anchor hashes, once per document, are dealt by hash; those met twice come back.
2. Documents send the suffixes of such anchors, equal ones of a document once.
3. Per anchor hash, rows arrive sorted by bytes. Equal rows repeat whole and are
   reported as they stream by; one of them is kept. The different ones are sorted
   rightwards and leftwards from the anchor by mergesort, where a comparison finds
   the common extension by binary search over prefix polynomial hashes and then
   verifies it on the bytes. Joining sets along the leftward order, from the deepest
   common left extension to the shallowest, and keeping each set in rightward order,
   every suffix meets its best partners: exact, in O(m log^2 m) comparisons.
4. Spans go back to their documents, which are cut and hashed.

An anchor that occurs over HOT times is dealt by its windows instead, where equal
rows stream, so no group grows with the corpus. Nothing is capped.

Rows are named by a hash of doc_id and text, so neither null nor repeated ids gather.

Defined cases: null text is empty; texts under LENGTH bytes keep all; rows that
repeat a doc_id, or have none, are documents of their own; an empty table gives an
empty result; other columns are not read.
"""

from __future__ import annotations

import bisect
import functools
import hashlib
from array import array
from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, id_and_text, parallelism
from .wordbytes import mix, powers, prefix_hashes

LENGTH = 200
GRAM = 100
HOT = 50_000
#: Positions in one packed comparison; longer texts go by overlapping segments.
_SEGMENT = 1 << 22
_MASK = (1 << 64) - 1


def anchors(text: bytes, length: int = LENGTH, gram: int = GRAM) -> list[tuple[int, int, int, int]]:
    """(hash, anchor position, first window, last window) for each anchor of a text, in order."""
    out: list[tuple[int, int, int, int]] = []
    for base in range(0, max(len(text) - length + 1, 0), _SEGMENT):
        raw = np.frombuffer(text, np.uint8)[base : base + _SEGMENT + length - 1]
        prefix = prefix_hashes(raw)
        n = len(raw) - gram + 1
        h = mix((prefix[gram:] - prefix[:-gram]) * powers(len(prefix), inverse=True)[:n])
        width = length - gram + 1
        key = (h >> np.uint64(24) << np.uint64(24)) | np.arange(n, dtype=np.uint64)
        blocks = -(-n // width)
        padded = np.full(blocks * width, _MASK, np.uint64)
        padded[:n] = key
        grid = padded.reshape(blocks, width)
        ahead = np.minimum.accumulate(grid, axis=1).ravel()
        back = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
        count = n - width + 1
        least = np.minimum(back[:count], ahead[width - 1 : width - 1 + count]) & np.uint64((1 << 24) - 1)
        first = np.flatnonzero(np.concatenate(([True], least[1:] != least[:-1])))
        last = np.concatenate((first[1:], [count])) - 1
        at = least[first].astype(np.int64)
        out += zip(h[at].view(np.int64).tolist(), (at + base).tolist(), (first + base).tolist(), (last + base).tolist(), strict=True)
    return out


class Suffixes:
    """Different suffixes of one anchor hash: bytes, and where the anchor stands in them."""

    def __init__(self, rows: list[tuple[bytes, int]]) -> None:
        self.rows = rows
        # Packed, 8 bytes a position: up to HOT suffixes are held.
        self.prefix = [array("Q", prefix_hashes(np.frombuffer(c, np.uint8)).tobytes()) for c, _ in rows]
        longest = max(len(c) for c, _ in rows) + 1
        self.inverse = powers(longest, inverse=True).tolist()

    def _same(self, i: int, a: int, j: int, b: int, n: int) -> bool:
        p, q = self.prefix[i], self.prefix[j]
        return ((p[a + n] - p[a]) * self.inverse[a] - (q[b + n] - q[b]) * self.inverse[b]) & _MASK == 0

    def right(self, i: int, j: int) -> int:
        """Common extension rightwards from the anchors."""
        (c, a), (d, b) = self.rows[i], self.rows[j]
        low, high = 0, min(len(c) - a, len(d) - b)
        while low < high:
            mid = (low + high + 1) // 2
            low, high = (mid, high) if self._same(i, a, j, b, mid) else (low, mid - 1)
        if c[a : a + low] != d[b : b + low]:  # hashes met by chance
            low = next(k for k in range(low) if c[a + k] != d[b + k])
        return low

    def left(self, i: int, j: int) -> int:
        """Common extension leftwards from the anchors."""
        (c, a), (d, b) = self.rows[i], self.rows[j]
        low, high = 0, min(a, b)
        while low < high:
            mid = (low + high + 1) // 2
            low, high = (mid, high) if self._same(i, a - mid, j, b - mid, mid) else (low, mid - 1)
        if c[a - low : a] != d[b - low : b]:
            low = next(k for k in range(low) if c[a - 1 - k] != d[b - 1 - k])
        return low

    def _order(self, reach: Callable[[int, int], int], step: int) -> list[int]:
        """Mergesort by the extension in one direction; an end sorts first."""

        def compare(i: int, j: int) -> int:
            n = reach(i, j)
            (c, a), (d, b) = self.rows[i], self.rows[j]
            x, y = (a + n, b + n) if step > 0 else (a - 1 - n, b - 1 - n)
            u = c[x] if 0 <= x < len(c) else -1
            v = d[y] if 0 <= y < len(d) else -1
            return u - v or i - j

        return sorted(range(len(self.rows)), key=functools.cmp_to_key(compare))

    def repeats(self, length: int) -> dict[int, list[tuple[int, int]]]:
        """Suffix -> (start, end) in its bytes, of common strings of ``length`` or more around the anchor."""
        found: dict[int, list[tuple[int, int]]] = defaultdict(list)
        rightward = self._order(self.right, 1)
        rank = {i: r for r, i in enumerate(rightward)}
        leftward = self._order(self.left, -1)
        depth = sorted(((self.left(i, j), k) for k, (i, j) in enumerate(zip(leftward, leftward[1:], strict=False))), reverse=True)
        sets: list[list[int]] = [[rank[i]] for i in leftward]
        root = list(range(len(leftward)))

        def find(x: int) -> int:
            while root[x] != x:
                root[x] = root[root[x]]
                x = root[x]
            return x

        def note(i: int, j: int, left: int) -> None:
            right = self.right(i, j)
            if left + right >= length:
                for x in (i, j):
                    at = self.rows[x][1]
                    if not found[x] or found[x][-1] != (at - left, at + right):
                        found[x].append((at - left, at + right))

        for left, k in depth:
            a, b = find(k), find(k + 1)
            if len(sets[a]) < len(sets[b]):
                a, b = b, a
            many, few = sets[a], sets[b]
            for r in few:
                at = bisect.bisect(many, r)
                if at:
                    note(rightward[many[at - 1]], rightward[r], left)
                if at < len(many):
                    note(rightward[many[at]], rightward[r], left)
                many.insert(at, r)
            sets[b] = []
            root[b] = a
        return found


def _runs(batches: Iterator[pa.RecordBatch], hot: int) -> Iterator[pa.RecordBatch]:
    """(h, k, n) sorted by h -> (k, h, total) for hashes met twice.

    Only a run that may go on is held, as numbers, and only until it is hot.
    """

    def of(h: np.ndarray, k: np.ndarray, total: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(k), pa.array(h), pa.array(total)], names=["k", "h", "total"])

    def flush(parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        h, k, n = (np.concatenate(x) for x in zip(*parts, strict=True))
        edge = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1])))
        total = np.repeat(np.add.reduceat(n, edge), np.diff(np.concatenate((edge, [len(h)]))))
        keep = total > 1
        return of(h[keep], k[keep], total[keep])

    held: list = []
    streamed = None  # the hot hash whose rows pass at once
    for batch in batches:
        if not batch.num_rows:
            continue
        h, k, n = (batch.column(i).to_numpy() for i in range(3))
        if streamed is not None:
            cut = int(np.searchsorted(h, streamed, "right"))
            if cut:
                yield of(h[:cut], k[:cut], np.full(cut, hot + 1))
            h, k, n = h[cut:], k[cut:], n[cut:]
            if not len(h):
                continue
            streamed = None
        cut = int(np.searchsorted(h, h[-1]))  # the last run may go on
        if cut:
            yield flush([*held, (h[:cut], k[:cut], n[:cut])])
            held = []
        held.append((h[cut:], k[cut:], n[cut:]))
        if sum(int(x[2].sum()) for x in held) > hot:
            streamed = int(h[-1])
            yield flush(held)
            held = []
    if held:
        yield flush(held)


def _suffix_rows(batches: Iterator[pa.RecordBatch], length: int, gram: int, hot: int) -> Iterator[pa.RecordBatch]:
    """(k, text, row, hashes, totals) -> suffixes of those anchors, equal ones of a document once."""
    kinds = (pa.int64(), pa.binary(), pa.int32(), pa.int64(), pa.int64(), pa.binary())
    names = ["h", "content", "at", "k", "row", "starts"]
    for batch in batches:
        rows, size = [], 0
        for k, scalar, row, hashes, totals in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()), batch.column(2).to_pylist(), batch.column(3), batch.column(4), strict=True):
            if not hashes.is_valid:
                continue
            text = scalar.as_py()
            wanted = dict(zip(hashes.values.to_pylist(), totals.values.to_pylist(), strict=True))
            mine: dict[tuple[int, bytes, int], list[int]] = defaultdict(list)
            for h, at, first, last in anchors(text, length, gram):
                total = wanted.get(h)
                if total is None:
                    continue
                if total <= hot:
                    mine[h, text[first : last + length], at - first].append(first)
                else:  # by windows: only equal rows can meet
                    for w in range(first, last + 1):
                        window = text[w : w + length]
                        mine[int.from_bytes(hashlib.blake2b(window, digest_size=8).digest(), "little", signed=True), window, -1].append(w)
            for (h, content, at), starts in mine.items():
                rows.append((h, content, at, k, row, np.array(starts, "<i8").tobytes()))
                size += len(content)
            if size > 1 << 22:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)
                rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)


def _compare(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """Suffixes sorted by (h, content, at) -> (k, row, start, end) of repeated spans."""
    out: list[tuple[int, int, int, int]] = []
    group = None
    single: list = []  # different suffixes of the group: (content, at, k, row, start or None if it repeats)
    current = None  # [content, at, k, row, starts, reported]

    def report(k: int, row: int, starts: list[int], size: int) -> None:
        out.extend((k, row, s, s + size) for s in starts)

    def close_suffix() -> None:
        if current is not None and current[1] >= 0:
            single.append((current[0], current[1], current[2], current[3], None if current[5] else current[4][0]))

    def close_group() -> None:
        if len(single) > 1:
            for i, spans in Suffixes([(c, a) for c, a, *_ in single]).repeats(length).items():
                _, _, k, row, start = single[i]
                if start is not None:
                    out.extend((k, row, start + a, start + b) for a, b in spans)
        single.clear()

    def batch_of() -> pa.RecordBatch:
        table = np.array(out, np.int64).reshape(-1, 4)
        out.clear()
        return pa.RecordBatch.from_arrays([pa.array(table[:, i]) for i in range(4)], names=["k", "row", "start", "stop"])

    for batch in batches:
        for h, content, at, k, row, starts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            places = np.frombuffer(starts, "<i8").tolist()
            if h == group and current is not None and content == current[0] and at == current[1]:
                if not current[5]:
                    report(current[2], current[3], current[4], len(content))
                    current[5] = True
                report(k, row, places, len(content))
                continue
            close_suffix()
            if h != group:
                close_group()
                group = h
            current = [content, at, k, row, places, len(places) > 1]
            if len(places) > 1:
                report(k, row, places, len(content))
        if out:
            yield batch_of()
    close_suffix()
    close_group()
    if out:
        yield batch_of()


def union(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Maximal runs of the union; touching spans are one."""
    out: list[list[int]] = []
    for start, stop in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1][1] = max(out[-1][1], stop)
        else:
            out.append([start, stop])
    return [tuple(x) for x in out]


_RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def _cut(batches: Iterator[pa.RecordBatch], with_text: bool) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for doc_id, scalar, row, found in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()), batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
            text = scalar.as_py()
            runs = union([(x["start"], x["stop"]) for x in found or () if x["row"] == row])
            kept, at = [], 0
            for start, stop in runs:
                kept.append(text[at:start])
                at = stop
            kept.append(text[at:])
            rest = b"".join(kept)
            rows.append((doc_id, len(text), len(text) - len(rest), len(runs), hashlib.sha256(rest).hexdigest(), *([rest] if with_text else [])))
        if rows:
            kinds = (pa.int64(),) * 4 + (pa.string(),) + (pa.binary(),) * with_text
            names = [x.split()[0] for x in _RESULT.split(", ")] + ["kept"] * with_text
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)


def remove_repeats(docs: DataFrame, length: int = LENGTH, gram: int | None = None, hot: int = HOT, with_text: bool = False) -> DataFrame:
    """One row per document: sizes, maximal removed runs and the hash (or bytes) of what is left."""
    gram = length // 2 if gram is None else gram
    parts = parallelism(docs.sparkSession)
    rows = id_and_text(docs).withColumn("k", F.xxhash64("doc_id", "text")).withColumn("row", F.xxhash64("text"))
    long = F.octet_length("text") >= length

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in chunks(batches):
            hs, ks, ns = [], [], []
            for k, text in zip(ids, texts, strict=True):
                h, n = np.unique(np.array([a[0] for a in anchors(text, length, gram)], np.int64), return_counts=True)
                hs.append(h)
                ks.append(np.full(len(h), k))
                ns.append(n)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (hs, ks, ns)], names=["h", "k", "n"])

    sent = rows.where(long).select("k", "text").mapInArrow(send, "h long, k long, n long")
    met = sent.repartition(parts, "h").sortWithinPartitions("h").mapInArrow(lambda it: _runs(it, hot), "k long, h long, total long")
    # Sets, so that rows equal in all do not lengthen them: no more entries than a text has anchors.
    pairs = met.groupBy("k").agg(F.collect_set(F.struct("h", "total")).alias("met"))
    wanted = pairs.select("k", F.col("met.h").alias("hashes"), F.col("met.total").alias("totals"))
    joined = rows.join(wanted.withColumnRenamed("k", "wanted_k"), F.col("k") == F.col("wanted_k"), "left")
    # Both joins with the texts read the same columns and drop no row, so Spark deals the texts once.
    suffixes = joined.select("k", "text", "row", "hashes", "totals", "doc_id").mapInArrow(
        lambda it: _suffix_rows(it, length, gram, hot), "h long, content binary, at int, k long, row long, starts binary"
    )
    dealt = suffixes.repartition(parts, "h").sortWithinPartitions("h", "content", "at")
    spans = dealt.mapInArrow(lambda it: _compare(it, length), "k long, row long, start long, stop long")
    per_doc = spans.groupBy("k").agg(F.collect_set(F.struct("row", "start", "stop")).alias("spans")).withColumnRenamed("k", "spans_k")
    final = rows.join(per_doc, F.col("k") == F.col("spans_k"), "left").select("doc_id", "text", "row", "spans", "k")
    return final.mapInArrow(lambda it: _cut(it, with_text), _RESULT + (", kept binary" if with_text else ""))
