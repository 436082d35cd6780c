"""Benchmark decontamination by template canonicalisation (operator 5).

Numbers, names and units in documents and benchmark items become typed placeholders,
so a question asked again with other figures keeps its template. A capitalised word
that begins a sentence may be a name or not, so there are two templates, without and
with it as a slot, and windows of ``WINDOW`` tokens of both are matched by hash.
Windows that are slots only carry no template; they match by their values.

A hit puts item and document in line. Along that line the tokens are compared one by
one, and the values in the slots must map one to one over the whole occurrence: each
value of the item to the value that most of its places show, and back. Lines up to
half an item apart join in one occurrence, if their values agree, so a lost or
inserted word does not break it; the longest piece must cover ``PIECE`` of the item.
A document is contaminated if an occurrence covers ``COVERAGE`` of an item's tokens.

The benchmark meets the documents in blocks of at most ``MAX_BROADCAST_WINDOWS``
tokens (or one item), about 60 bytes a token, each broadcast in a pass of its own. So
every size goes the same way, and one pass is enough for all usual benchmarks.

Defined cases: null text is empty; empty texts and items match nothing; an item or
document of fewer than WINDOW tokens is one window of all its tokens; benchmark rows
each count, under their own item_id, equal or null ids and equal texts included; rows
with equal doc_id get a row each; an empty benchmark leaves every document clean;
other columns are not read, and keep their values where rows are dropped.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import wordbytes
from .common import chunks, discard, id_and_text, materialize

WINDOW = 5
#: Bytes of text canonicalised at once.
_ROOM = 1 << 20
COVERAGE = 0.8
PIECE = 0.2
MAX_BROADCAST_WINDOWS = 2_000_000
UNITS = frozenset(
    "mm cm m km in ft yd mi mg g kg lb lbs oz ml l s sec secs ms min mins h hr hrs hour hours day days week weeks month months year years "
    "meter meters metre metres kilometer kilometers mile miles inch inches foot feet gram grams kilogram kilograms pound pounds liter liters "
    "litre litres second seconds minute minutes percent dollar dollars euro euros usd eur cent cents degrees degree hz khz mhz ghz w kw kb mb gb tb".split()
)
_MEASURE_TOKEN = re.compile(rb"\d+([a-z]+)$")
_WORD = np.zeros(256, bool)
_WORD[[*range(48, 58), *range(65, 91), 95, *range(97, 123), *range(128, 256)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_JOINS = np.zeros(256, bool)
_JOINS[list(b".,:/-")] = True
#: Per byte: one in a 21-bit field for digits or, further up, for ends of sentences.
_FIELD = np.zeros(256, np.int64)
_FIELD[48:58], _FIELD[list(b".!?:\n")] = 1, 1 << 42
_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)
_NUM, _NAMED, _UNIT, _MEASURE = (np.uint64(x) for x in (0x6E756D626572AA01, 0x6E616D65AAAA0003, 0x756E6974AAAA0005, 0x6D65617375726507))
#: Of code points: whether they are capitals; of those of two bytes also their small letter.
_CAPITAL = np.fromiter((chr(c).isupper() or chr(c).istitle() for c in range(0x20000)), bool, 0x20000)
_SMALL = np.arange(0x800)
for _c in range(0x80, 0x800):
    if len(_s := chr(_c).lower()) == 1 and 0x80 <= ord(_s) < 0x800:
        _SMALL[_c] = ord(_s)


def _letters(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes with small letters, whether a capital starts at each byte, bytes of the sign that starts there)."""
    low, capital, size = _LOWER[raw], _CAPITAL[:128][np.minimum(raw, 127)] & (raw < 128), np.ones(len(raw), np.int64)
    lead = np.flatnonzero(raw >= 0xC2)
    if len(lead):
        at = lambda k: raw[np.minimum(lead + k, len(raw) - 1)].astype(np.int64) & 63
        first = raw[lead].astype(np.int64)
        long = np.where(first < 0xE0, 2, np.where(first < 0xF0, 3, 4))
        code = np.where(long == 2, (first & 31) << 6 | at(1), np.where(long == 3, (first & 15) << 12 | at(1) << 6 | at(2), (first & 7) << 18 | at(1) << 12 | at(2) << 6 | at(3)))
        capital[lead], size[lead] = _CAPITAL[np.minimum(code, 0x1FFFF)], long
        two = lead[(long == 2) & (lead + 1 < len(raw))]
        small = _SMALL[code[(long == 2) & (lead + 1 < len(raw))] & 0x7FF]
        low[two], low[two + 1] = small >> 6 | 0xC0, small & 63 | 0x80
    return low, capital, size


def _unit_hashes() -> np.ndarray:
    raw, at = wordbytes.join([u.encode() for u in sorted(UNITS)])
    return np.sort(wordbytes.span_hashes(wordbytes.prefix_hashes(raw), at[:-1], at[1:] - 1))


_UNITS_SORTED = _unit_hashes()


class Words:
    """Template tokens of some texts: arrays over all tokens, ``first`` indexes texts.

    ``template`` leaves words that begin a sentence as they are, ``wider`` takes
    capitalised ones for names; ``slot`` and ``wider_slot`` say which tokens are slots.
    """

    def __init__(self, texts: list[bytes]) -> None:
        raw, offsets = wordbytes.join(texts)
        low, capital, width = _letters(raw)
        starts, ends = wordbytes.spans(_WORD[raw])
        n = len(starts)
        prefix = wordbytes.prefix_hashes(low)
        value = wordbytes.span_hashes(prefix, starts, ends)
        fields = np.zeros(len(raw) + 1, np.int64)
        np.cumsum(_FIELD[raw], out=fields[1:])
        capitals = np.zeros(len(raw) + 1, np.int64)
        np.cumsum(capital, out=capitals[1:])
        digits = (fields[ends] - fields[starts]) & 0x1FFFFF
        size = ends - starts
        gap = np.ones(n, bool)  # a sentence ends before the token
        if n:
            gap[1:] = (fields[starts[1:]] - fields[ends[:-1]]) >> 42 > 0
        number = (digits == size) & (size > 0)
        measure = np.zeros(n, bool)
        for i in np.flatnonzero((digits > 0) & ~number & (raw[starts] - np.uint8(48) < 10)).tolist():
            token = low[starts[i] : ends[i]].tobytes()
            if (m := _MEASURE_TOKEN.match(token)) and m[1].decode("ascii", "replace") in UNITS:
                measure[i] = True
        name = capital[starts] & (capitals[ends] - capitals[starts] == 1) & (size > width[starts])
        after = np.zeros(n, bool)
        after[1:] = number[:-1]
        unit = np.zeros(n, bool)
        near = np.flatnonzero(after & ~number)
        if len(near):
            at = np.minimum(np.searchsorted(_UNITS_SORTED, value[near]), len(_UNITS_SORTED) - 1)
            unit[near] = _UNITS_SORTED[at] == value[near]
        template, wider = value.copy(), value.copy()
        template[name & ~gap], wider[name] = _NAMED, _NAMED
        for t in (template, wider):
            t[unit], t[number], t[measure] = _UNIT, _NUM, _MEASURE
        slot = unit | number | measure
        wider_slot, slot = slot | name, slot | (name & ~gap)
        # 1,234.56 is one number: parts that one sign joins.
        part = np.zeros(n, bool)
        if n:
            part[1:] = number[1:] & number[:-1] & (starts[1:] - ends[:-1] == 1) & _JOINS[raw[ends[:-1]]]
            whole = np.flatnonzero(~part)
            value = np.add.reduceat(value, whole)
            template, wider, slot, wider_slot, starts = (x[whole] for x in (template, wider, slot, wider_slot, starts))
        self.template, self.raw, self.slot, self.wider, self.wider_slot = template, value, slot, wider, wider_slot
        self.first = np.searchsorted(starts, offsets)

    def of(self, k: int) -> tuple[np.ndarray, ...]:
        """(template hash, raw hash, is slot, wider template hash, is slot there) of each token of one text."""
        a, b = self.first[k], self.first[k + 1]
        return tuple(x[a:b] for x in (self.template, self.raw, self.slot, self.wider, self.wider_slot))


def canonical(text: str) -> tuple[np.ndarray, ...]:
    return Words([text.encode("utf-8", "replace")]).of(0)


def windows(template: np.ndarray, raw: np.ndarray, slot: np.ndarray) -> np.ndarray:
    """Hash of the window that starts at each token; all-slot windows by their values."""
    n = len(template)
    if not n:
        return np.zeros(0, np.uint64)
    width = min(WINDOW, n)
    count = n - width + 1
    out = np.full(count, width, np.uint64)
    bare = np.ones(count, bool)
    values = out.copy()
    for k in range(width):
        out = (out ^ template[k : k + count]) * _MIX[k]
        out ^= out >> np.uint64(29)
        values = (values ^ raw[k : k + count]) * _MIX[k]
        values ^= values >> np.uint64(31)
        bare &= slot[k : k + count]
    return np.where(bare, values, out)


class _Line:
    """Item and document put in line: which tokens are covered, and how slot values map."""

    def __init__(self, item: tuple, doc: tuple, d: int) -> None:
        n, m = len(item[0]), len(doc[0])
        self.low, high = max(0, -d), min(n, m - d)
        t1, r1, s1, w1, v1 = (x[self.low : high] for x in item)
        t2, r2, s2, w2, v2 = (x[self.low + d : high + d] for x in doc)
        plain = t1 == t2
        wide = ~plain & (w1 == w2)
        self.same = plain | wide | (r1 == r2)
        self.slot = self.same & np.where(wide, v1 & v2, s1 & s2)
        self.a, self.b = r1, r2
        # A window counts if all its tokens agree and one of them is no slot, or all values are equal.
        width = min(WINDOW, n)
        run = lambda x: np.convolve(x.astype(np.int32), np.ones(width, np.int32), "valid") if len(x) >= width else np.zeros(0, np.int32)
        self.width = width
        self.window = (run(self.same) == width) & ((run(self.slot) < width) | (run(r1 == r2) == width))

    def covered(self, ahead: dict | None = None, back: dict | None = None) -> tuple[np.ndarray, dict, dict]:
        """(positions of the item, bindings): of windows whose slots agree with given bindings, new ones by majority."""
        ahead, back = dict(ahead or {}), dict(back or {})
        inside = np.zeros(len(self.a), bool)
        for k in range(self.width):
            inside[k : k + len(self.window)] |= self.window
        at = np.flatnonzero(self.slot & inside)
        counts: dict[tuple[int, int], int] = defaultdict(int)
        for pair in zip(self.a[at].tolist(), self.b[at].tolist(), strict=True):
            counts[pair] += 1
        for (a, b), _ in sorted(counts.items(), key=lambda x: -x[1]):
            if a not in ahead and b not in back:
                ahead[a], back[b] = b, a
        wrong = np.zeros(len(self.a), bool)
        bad = {p for p in counts if ahead.get(p[0]) != p[1]}
        if bad:
            wrong[at] = [p in bad for p in zip(self.a[at].tolist(), self.b[at].tolist(), strict=True)]
        clash = np.convolve(wrong.astype(np.int32), np.ones(self.width, np.int32), "valid") > 0 if len(wrong) >= self.width else np.zeros(0, bool)
        start = np.flatnonzero(self.window & ~clash)
        mask = np.zeros(len(self.a), bool)
        for k in range(self.width):
            mask[start + k] = True
        return np.flatnonzero(mask) + self.low, ahead, back


def verify(item: tuple, doc: tuple, hits: list[tuple[int, int]], coverage: float = COVERAGE) -> float:
    """Largest share of the item's tokens that one consistent occurrence covers.

    hits: (item position, document position) of matching windows, at least the first
    of each run. Every line that a hit sets is compared over the whole item. Pieces on
    several lines are put together only where they could reach ``coverage``.
    """
    n = len(item[0])
    lines, own, best = {}, {}, 0.0
    for d in sorted({j - i for i, j in hits}):
        lines[d] = _Line(item, doc, d)
        own[d] = lines[d].covered()
        best = max(best, len(own[d][0]) / n)
        if best == 1:
            break
    if best >= coverage or len(lines) < 2:
        return best
    order = sorted(lines)
    for d in sorted(order, key=lambda x: (-len(own[x][0]), x)):
        at, ahead, back = own[d]
        if len(at) < PIECE * n:
            break
        near = sorted((x for x in order if x != d and abs(x - d) <= max(1, n // 2)), key=lambda x: (-len(own[x][0]), abs(x - d), x))
        found = np.zeros(n, bool)
        found[at] = True
        possible = found.copy()
        for x in near:
            possible[own[x][0]] = True
        if possible.mean() < coverage:
            continue
        for x in near:
            at, ahead, back = lines[x].covered(ahead, back)
            found[at] = True
        best = max(best, float(found.mean()))
        if best >= coverage:
            break
    return best


def item_tokens(bench: DataFrame) -> DataFrame:
    """(item_id, n, tokens): each benchmark row once, with its token arrays side by side."""
    rows = bench.select(F.col("item_id").cast("long").alias("item_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in chunks(batches):
            words = Words(texts)
            tokens = [[np.ascontiguousarray(x).tobytes() for x in words.of(k)] for k in range(len(texts))]
            size = [len(t[0]) // 8 for t in tokens]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(size, pa.int64()), pa.array([b"".join(t) for t in tokens], pa.binary())], names=["item_id", "n", "tokens"])

    return rows.mapInArrow(run, "item_id long, n long, tokens binary").where("n > 0")


def _unpacked(tokens: bytes, n: int) -> tuple[np.ndarray, ...]:
    at = np.cumsum([0, 8 * n, 8 * n, n, 8 * n, n]).tolist()
    return tuple(np.frombuffer(tokens[a:b], k) for a, b, k in zip(at, at[1:], (np.uint64, np.uint64, bool, np.uint64, bool), strict=False))


class Bench:
    """The broadcast form: items, and their sorted window hashes with places.

    With a place goes the hash of the window before it. Where document and item agree
    there too, the hit goes on a line that has been set, so only the first of each run
    is taken; that keeps the work near linear in texts that repeat themselves.
    """

    def __init__(self, items: list[tuple[int | None, tuple]]) -> None:
        self.items = items
        hashes, places, before = [np.zeros(0, np.int64)], [np.zeros((0, 2), np.int32)], [np.zeros(0, np.int64)]
        self.short = defaultdict(list)
        for k, (_, (t, r, s, w, v)) in enumerate(items):
            plain = windows(t, r, s).view(np.int64)
            wide = windows(w, r, v).view(np.int64)
            at = np.arange(len(plain))
            for h, where in ((plain, at), (wide, at[plain != wide])):
                hashes.append(h[where])
                before.append(np.where(where > 0, h[where - 1], 0))
                places.append(np.stack([np.full(len(where), k), where], 1).astype(np.int32))
            if len(t) < WINDOW:
                self.short[len(t)].append(k)
        every = np.concatenate(hashes)
        order = np.argsort(every, kind="stable")
        self.places, self.before = np.concatenate(places)[order], np.concatenate(before)[order]
        self.hashes, edge = np.unique(every[order], return_index=True)
        self.edge = np.concatenate((edge, [len(order)]))
        self.likely = np.zeros(1 << 20, bool)  # by the top bits: most windows need no search
        self.likely[self.hashes.view(np.uint64) >> np.uint64(44)] = True

    def coverages(self, texts: list[bytes]) -> list[dict]:
        """For each text: item (by place in the block) -> share of it that the text covers."""
        words = Words(texts)
        hits: list[dict] = [defaultdict(list) for _ in texts]
        for k in np.flatnonzero(np.diff(words.first) < WINDOW).tolist():
            t, r, s, w, v = words.of(k)
            for h in (windows(t, r, s), windows(w, r, v)):
                self._meet(h.view(np.int64), np.arange(len(h)), k, words.first, hits)
        plain = windows(words.template, words.raw, words.slot).view(np.int64)
        wide = windows(words.wider, words.raw, words.wider_slot).view(np.int64)
        self._meet(plain, np.arange(len(plain)), None, words.first, hits)
        self._meet(wide, np.flatnonzero(plain != wide), None, words.first, hits)
        for width, items in self.short.items():
            self._meet_short(words, width, items, hits)
        return [{item: verify(self.items[item][1], words.of(k), at) for item, at in found.items()} for k, found in enumerate(hits)]

    def _meet(self, found: np.ndarray, where: np.ndarray, text: int | None, first: np.ndarray, hits: list) -> None:
        if not len(self.hashes) or not len(where):
            return
        near = where[self.likely[found[where].view(np.uint64) >> np.uint64(44)]]
        at = np.minimum(np.searchsorted(self.hashes, found[near]), len(self.hashes) - 1)
        good = self.hashes[at] == found[near]
        for j, p in zip(near[good].tolist(), at[good].tolist(), strict=True):
            k = int(np.searchsorted(first, j, "right")) - 1 if text is None else text
            start = int(first[k]) if text is None else 0
            if text is None and j + WINDOW > first[k + 1]:
                continue  # a window doesn't cross texts
            a, b = self.edge[p], self.edge[p + 1]
            rows = self.places[a:b]
            if b - a > 4 and j > start:
                rows = rows[(self.before[a:b] != found[j - 1]) | (rows[:, 1] == 0)]
            for item, i in rows.tolist():
                hits[k][item].append((i, j - start))

    def _meet_short(self, words: Words, width: int, items: list, hits: list) -> None:
        """Items shorter than a window: every run of as many tokens."""
        count = len(words.template) - width + 1
        for item in items:
            t, r, s, w, _ = self.items[item][1]
            same = np.ones(max(count, 0), bool)
            for k in range(width):
                raw = words.raw[k : k + count] == r[k]
                same &= raw if s.all() else raw | (words.template[k : k + count] == t[k]) | (words.wider[k : k + count] == w[k])
            for j in np.flatnonzero(same).tolist():
                k = int(np.searchsorted(words.first, j, "right")) - 1
                if j + width <= words.first[k + 1]:
                    hits[k][item].append((0, int(j - words.first[k])))


def _passes(bench: DataFrame, most: int) -> Iterator[Bench]:
    """The benchmark in blocks of at most ``most`` tokens, or one item; the driver holds one."""
    table = materialize(item_tokens(bench))
    held, size, first = [], 0, True
    for row in table.toLocalIterator():
        if held and size + row.n > most:
            yield Bench(held)
            held, size, first = [], 0, False
        held.append((row.item_id, _unpacked(bytes(row.tokens), row.n)))
        size += row.n
    discard(table)
    if held or first:
        yield Bench(held)


_RESULT = "doc_id long, contaminated boolean, item_ids array<long>, coverage double"


def _judge(bench: Bench, texts: list[bytes]) -> list[tuple[list, float]]:
    """For each text the item_ids found in it, and the largest coverage."""
    out = []
    for found in bench.coverages(texts):
        out.append(([bench.items[i][0] for i, c in found.items() if c >= COVERAGE], max(found.values(), default=0.0)))
    return out


def contaminated(docs: DataFrame, bench: DataFrame, max_broadcast: int = MAX_BROADCAST_WINDOWS) -> DataFrame:
    """One row per document: contaminated, the items found in it, the largest coverage."""
    rows = id_and_text(docs).select("doc_id", "text", F.array().cast("array<long>").alias("items"), F.lit(0.0).alias("best"))
    schema, ahead = "doc_id long, text string, items array<long>, best double", None
    for block in _passes(bench, max_broadcast):
        shared = docs.sparkSession.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                texts = [x.as_py() for x in batch.column(1).cast(pa.binary())]
                judged = [x for part in _parts(texts) for x in _judge(shared.value, part)]
                items = [a + b for a, (b, _) in zip(batch.column(2).to_pylist(), judged, strict=True)]
                best = [max(a, b) for a, (_, b) in zip(batch.column(3).to_pylist(), judged, strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(items, pa.list_(pa.int64())), pa.array(best, pa.float64())], names=["doc_id", "text", "items", "best"])

        rows, ahead = (materialize(rows) if ahead else rows).mapInArrow(run, schema), True
    return rows.select("doc_id", (F.size("items") > 0).alias("contaminated"), F.sort_array("items").alias("item_ids"), F.col("best").alias("coverage"))


def _parts(texts: list[bytes]) -> Iterator[list[bytes]]:
    """Texts in lists of about _ROOM bytes."""
    held, size = [], 0
    for text in texts:
        held.append(text)
        size += len(text)
        if size >= _ROOM:
            yield held
            held, size = [], 0
    if held:
        yield held


def drop_contaminated(docs: DataFrame, bench: DataFrame, max_broadcast: int = MAX_BROADCAST_WINDOWS) -> DataFrame:
    """``docs`` without contaminated documents; columns as they were."""
    text_at, ahead = docs.columns.index("text"), None
    rows = docs
    for block in _passes(bench, max_broadcast):
        shared = docs.sparkSession.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                texts = [x.as_py() or b"" for x in batch.column(text_at).cast(pa.binary())]
                keep = [not found for part in _parts(texts) for found, _ in _judge(shared.value, part)]
                yield batch.filter(pa.array(keep, pa.bool_()))

        rows, ahead = (materialize(rows) if ahead else rows).mapInArrow(run, docs.schema), True
    return rows


def decontam_query(docs: DataFrame, bench: DataFrame) -> DataFrame:
    return contaminated(docs, bench)
