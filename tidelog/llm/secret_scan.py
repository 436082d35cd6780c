"""Secret scans with a recursive decoding worklist (operator 8).

The plain text is scanned for three kinds of secrets. Then a worklist unwraps
layers: URL escapes, ``\\uXXXX``/``\\xXX`` escapes, base64 and gzip/zlib data, the
last with all its members and whatever compressed data its content holds. Each decoded
layer is scanned again and its own encoded regions go back on the list until nothing
new decodes. A layer whose content was already seen at its place is skipped (cycle
detection). A percent sign or backslash that is itself escaped many times over loses
all levels but the last at once, so deep nesting takes linear time.

A secret found inside a layer is mapped back: through escapes to the signs that spell
it, through base64 or compressed data to the whole encoded region.

Defined cases: null text is empty; empty text has no spans; equal spans of one
kind are listed once; compressed data of any size is read to its end as a stream, in
pieces cut only where neither a secret nor an encoded region can cross (``_CUT``), so
the spans do not depend on its size; a stretch without such a place is held whole. What
base64 spells is read by its printable stretches too, whatever else it holds.
Content that is compressed itself waits in a file beyond ``MAX_INFLATED`` bytes, and what
comes before an error counts. ``truncated`` only marks documents with more than
``MAX_INFLATED`` bytes inflated: nothing is left out. In compressed data a run of one
hexadecimal digit repeated is padding and not listed, at any size. Base64 is looked
for at every sign of its run, and over line ends. Equal rows are treated alike, and
columns other than doc_id and text are not read, and keep their values where texts are
redacted; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
import hashlib
import re
import tempfile
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, id_and_text

#: Order of kinds in span lists.
KINDS = ("assign", "access", "hex")
ASSIGN = re.compile(
    r"(?:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.IGNORECASE | re.ASCII
)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
MAX_INFLATED = 16 << 20
#: Signs of the shortest secret, ``token=`` and six more; a shorter layer is not opened.
SHORTEST = 12
#: Bytes inflated at once, and read at once.
PIECE, STEP = 1 << 20, 1 << 16

# A region starts where its run of signs does, so a long run is read once.
_PERCENT = re.compile(r"(?<![A-Za-z0-9_.~+/=:&?;,@!$'()*\"-])[A-Za-z0-9_.~+/=:&?;,@!$'()*\"-]*+(?:%[0-9A-Fa-f]{2}[A-Za-z0-9_.~+/=:&?;,@!$'()*\"-]*)+")
_ESCAPED = re.compile(r"(?<![\x21-\x5b\x5d-\x7e])[\x21-\x5b\x5d-\x7e]*+(?:\\u[0-9A-Fa-f]{4}[\x21-\x5b\x5d-\x7e]*|\\x[0-9A-Fa-f]{2}[\x21-\x5b\x5d-\x7e]*)+")
_BASE64 = re.compile(r"[A-Za-z0-9+/_-]{16,}={0,2}")
_SIGN = "[A-Za-z0-9+/_-]"
#: The same over lines: all but the last of 16 signs or more, the last to the end of its line or a quote. Bytes that no
#: pattern has end it, so a text and its printable stretches have the same regions.
_WRAPPED = re.compile(rf"{_SIGN}{{16,}}+(?:[\x20\t]*+\r?\n[\x20\t]*+{_SIGN}{{16,}}+(?!(?![=\"'`,;)])[\x21-\x7e]))*+(?:[\x20\t]*+\r?\n[\x20\t]*+{_SIGN}++(?==|[\x20\t\r]*(?![\t\r\x20-\x7e])|[\"'`,;)]))?={{0,2}}")
_BREAKS = re.compile(r"\s+")
_PACKED = re.compile(rb"\x1f\x8b\x08|\x78[\x01\x5e\x9c\xda]")
_STRETCH = re.compile(rb"[\t\n\r\x20-\x7e]{%d,}" % SHORTEST)
#: Where content may be cut: after bytes that no pattern has; after a line that wrapped base64 can't go on from; after a
#: word that is neither the first of its line (of which wrapped base64 may end in) nor the start of an assignment.
_CUT = re.compile(
    rb"[^\t\n\r\x20-\x7e]+|(?=[\x20\t\r\n])(?<![\x20\t\r])(?<![A-Za-z0-9+/_-]{16})[\x20\t\r]*+\n"
    rb"|(?:\A|(?<=[\x21-\x7e][\x20\t]))[\x20\t]*+[\x21-\x7e]++(?<![:=])"
    + b"".join(b"(?<!%s%s)" % (name, quote) for name in (b"password", b"passwd", b"secret", b"token", b"api_key", b"apikey") for quote in (b"", b"[\"']"))
    + rb"(?:[\x20\t]++(?=[\x21-\x7e])|(?<![A-Za-z0-9+/_-]{16})[\x20\t]++)",
    re.IGNORECASE,
)
# Runs of escapes that spell a sign each, and of those of which several may spell one: so each sign of a secret has its place.
_ESCAPE_RUN = re.compile(r"(?:\\u(?![dD][89A-Fa-f])[0-9A-Fa-f]{4})+|(?:\\u[dD][89A-Fa-f][0-9A-Fa-f]{2})+|(?:\\x[0-9A-Fa-f]{2})+")
_PERCENT_RUN = re.compile(r"(?:%[0-7][0-9A-Fa-f])+|(?:%[89A-Fa-f][0-9A-Fa-f])+")
#: Escaped escapes: a sign and its levels, and any other escape.
_DEEP = {"url": (re.compile(r"%((?:25)+)"), 2, re.compile(r"%(?!25)[0-9A-Fa-f]{2}")), "unicode": (re.compile(r"\\((?:u005[cC])+)"), 5, re.compile(r"\\(?:u(?!005[cC])[0-9A-Fa-f]{4}|x[0-9A-Fa-f]{2})"))}


def scan(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) in code points: leftmost, non-overlapping per kind."""
    found = []
    if "=" in text or ":" in text:
        found += [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if m.end(1) - m.start(1) >= 6]
    if "AKIA" in text:
        found += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text)]
    found += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    return found


#: Parts of a region that decode: (start, end, what they spell).
Pieces = list[tuple[int, int, str]]


def _pieces(region: str, how: str) -> Pieces:
    """One level of escapes; levels of escaped escapes are taken off together where nothing else decodes."""
    sign, width, others = _DEEP[how]
    depths = [(m.start(1), m.end(1)) for m in sign.finditer(region)]
    least = min(((e - s) // width for s, e in depths), default=0)
    if least > 1 and not others.search(region):
        return [(s, s + (least - 1) * width, "") for s, _ in depths]
    if how == "url":
        return [(m.start(), m.end(), bytes.fromhex(m[0].replace("%", "")).decode("utf-8", "replace")) for m in _PERCENT_RUN.finditer(region)]
    out = []
    for m in _ESCAPE_RUN.finditer(region):
        codes = [chr(int(x, 16)) for x in m[0].replace("\\u", " ").replace("\\x", " ").split()]
        out.append((m.start(), m.end(), "".join(codes).encode("utf-16", "surrogatepass").decode("utf-16", "replace")))
    return out


def _decoded(region: str, pieces: Pieces) -> str:
    out, at = [], 0
    for start, end, text in pieces:
        out += [region[at:start], text]
        at = end
    return "".join(out) + region[at:]


def _places(region: str, pieces: Pieces) -> tuple[np.ndarray, np.ndarray]:
    """Where each sign of the decoded region starts and ends in the region."""
    first, last, at = [], [], 0

    def plain(start: int, end: int) -> None:
        first.append(np.arange(start, end))
        last.append(np.arange(start + 1, end + 1))

    for start, end, text in pieces:
        plain(at, start)
        step = (end - start) // len(text) if text and (end - start) % len(text) == 0 else 0
        if step in (3, 4, 6):  # an escape a sign
            first.append(np.arange(start, end, step))
            last.append(np.arange(start + step, end + 1, step))
        else:
            first.append(np.full(len(text), start))
            last.append(np.full(len(text), end))
        at = end
    plain(at, len(region))
    return np.concatenate(first), np.concatenate(last)


def _header(data: bytes) -> int:
    """zlib's window bits of gzip or zlib data, 0 if it is neither."""
    if data[:2] == b"\x1f\x8b":
        return 31
    return 15 if len(data) > 2 and data[0] & 0x0F == 8 and (data[0] << 8 | data[1]) % 31 == 0 else 0


def _inflated(source: Iterator[bytes]) -> Iterator[bytes]:
    """Content of all members, by ``PIECE`` at most; what comes before an error counts."""
    data = next(source, b"")
    while True:
        while len(data) < 3 and (more := next(source, b"")):
            data += more
        if not (bits := _header(data)):
            return
        machine, size, begun = zlib.decompressobj(bits), PIECE, False
        while not machine.eof:
            before = machine.copy() if begun else None
            try:
                out = machine.decompress(data, size)
            except zlib.error:  # again from before, in smaller steps
                machine, size = before or zlib.decompressobj(bits), size // 2
                if not size:
                    return
                continue
            begun = True
            if out:
                yield out
            data = machine.unconsumed_tail
            if not machine.eof and not data and len(out) < size and not (data := next(source, b"")):
                return
        data = machine.unused_data


def _last_cut(held: bytearray, since: int) -> int:
    for start in (max(since, len(held) - 4096), since):
        cut = 0
        for m in _CUT.finditer(held, start):
            cut = m.end()
        if cut:
            break
    return cut


def _stretches(data: bytes | bytearray) -> Iterator[str]:
    """Printable stretches with a secret or a further layer."""
    for m in _STRETCH.finditer(data):
        piece = m[0].decode("ascii")
        if _holds(piece):
            yield piece


def _parts(content: Iterator[bytes]) -> Iterator[str]:
    """``_stretches`` of a stream, cut only at ``_CUT``."""
    held, seen = bytearray(), 0
    for out in content:
        held += out
        if len(held) - seen < PIECE:
            continue
        if not seen:
            held = held.lstrip()
        if cut := _last_cut(held, seen):
            yield from _stretches(held[:cut])
            held = held[cut:].lstrip()
        seen = len(held)
    yield from _stretches(held)


class _Content:
    """A stream with its digest and size; what may be compressed itself is kept."""

    def __init__(self, stream: Iterator[bytes]) -> None:
        self.stream, self.digest, self.size, self.kept = stream, hashlib.blake2b(digest_size=16), 0, tempfile.SpooledTemporaryFile(MAX_INFLATED)

    def __iter__(self) -> Iterator[bytes]:
        head = b""
        for out in self.stream:
            head = (head + out[:3])[:3]
            self.digest.update(out)
            self.size += len(out)
            if self.kept and len(head) == 3 and not _header(head):
                self.kept = None
            if self.kept:
                self.kept.write(out)
            yield out


def _opened(data: bytes, starts: list[int], contents: dict[bytes, tuple[int, bool]]) -> Iterator[tuple[str, int]]:
    """(text, start) of what is compressed in ``data`` at ``starts``, and in that, until nothing new opens.

    ``contents`` gets the digest and size of each content, and whether it has a secret or a further layer.
    """
    for start in starts:
        source = (data[i : i + STEP] for i in range(start, len(data), STEP))
        while True:
            content, found = _Content(_inflated(source)), False
            for text in _parts(iter(content)):
                found = True
                yield text, start
            digest = content.digest.digest()
            if not content.size or digest in contents:
                break
            contents[digest] = content.size, found
            if not content.kept:
                break
            content.kept.seek(0)
            source = iter(lambda file=content.kept: file.read(STEP), b"")


def _base64_layers(region: str, contents: dict[bytes, tuple[int, bool]]) -> Iterator[tuple[str, bool]]:
    """(layer, was compressed) of a run of base64 signs that start anywhere in it: signs before may shift it, or be no base64."""
    run = _BREAKS.sub("", region).rstrip("=").replace("-", "+").replace("_", "/")
    for shift in range(4):
        body = run[shift:]
        if len(body) % 4 == 1:
            body = body[:-1]
        data = base64.b64decode(body + "=" * (-len(body) % 4))
        starts = [0] if not shift and _header(data) else []
        starts += [m.start() for m in _PACKED.finditer(data) if m.start() % 3 == 0 and (m.start() or shift)]
        opened = False
        for text, start in _opened(data, starts, contents):
            opened |= not start
            yield text, True
        if opened:
            continue
        for text in _stretches(data):
            yield text, False


def regions(text: str) -> Iterator[tuple[int, int, str]]:
    """Encoded regions of one layer: (start, end, how)."""
    if "%" in text:
        yield from ((m.start(), m.end(), "url") for m in _PERCENT.finditer(text))
    if "\\" in text:
        yield from ((m.start(), m.end(), "unicode") for m in _ESCAPED.finditer(text))
    yield from ((m.start(), m.end(), "base64") for m in _BASE64.finditer(text))
    if "\n" in text:
        yield from ((m.start(), m.end(), "base64") for m in _WRAPPED.finditer(text) if "\n" in m[0])


def _holds(text: str) -> bool:
    """Whether a text has a secret or a further layer that may have one."""
    return bool(scan(text)) or any(end - start >= SHORTEST for start, end, _ in regions(text))


class _Layer:
    """A decoded text and where its signs stand in the document, worked out when asked."""

    def __init__(self, text: str, place: Callable[[], tuple[np.ndarray, np.ndarray]] | tuple[int, int] | None) -> None:
        self.text, self._place = text, place

    def span(self, start: int, end: int) -> tuple[int, int]:
        if self._place is None:  # the document itself
            return start, end
        if callable(self._place):
            self._place = self._place()
        first, last = self._place
        return (int(first[start]), int(last[end - 1])) if isinstance(first, np.ndarray) else (first, last)

    def inner(self, at: int, pieces: Pieces, region: str) -> Callable[[], tuple[np.ndarray, np.ndarray]] | tuple[int, int]:
        """Places of what a region of this layer spells."""
        if self._place is not None and not callable(self._place) and not isinstance(self._place[0], np.ndarray):
            return self._place

        def work_out() -> tuple[np.ndarray, np.ndarray]:
            first, last = _places(region, pieces)
            if self._place is None:
                return first + at, last + at
            self.span(at, at + 1)
            return self._place[0][first + at], self._place[1][last + at - 1]

        return work_out


def worklist(text: str) -> tuple[list[tuple[int, int, str]], int, bool]:
    """Spans from decoded layers, mapped to the document; layers (of base64 and compressed data those with a secret or a further layer); whether over ``MAX_INFLATED`` bytes were inflated."""
    todo = [_Layer(text, None)]
    seen: set[bytes] = set()
    spans: set[tuple[int, int, str]] = set()
    layers, contents = 0, {}
    while todo:
        outer = todo.pop()
        for s, e, how in regions(outer.text):
            region = outer.text[s:e]
            start, end = outer.span(s, e)
            if how == "base64":
                found = ((layer, packed, (start, end)) for layer, packed in _base64_layers(region, contents.setdefault((start, end), {})))
            else:
                pieces = _pieces(region, how)
                found = iter([(_decoded(region, pieces), False, outer.inner(s, pieces, region))])
            for layer, packed, place in found:
                if len(layer) < SHORTEST or layer == region:
                    continue
                digest = hashlib.blake2b(f"{start}:{end}:{packed}:{layer}".encode("utf-8", "replace"), digest_size=16).digest()
                if digest in seen:
                    continue
                seen.add(digest)
                layers += not packed
                inside = _Layer(layer, place)
                spans.update((*inside.span(a, b), kind) for a, b, kind in scan(layer) if not (packed and kind == "hex" and layer.count(layer[a], a, b) == b - a))
                todo.append(inside)
    opened = [x for place in contents.values() for x in place.values()]
    return sorted(spans), layers + sum(found for _, found in opened), sum(size for size, _ in opened) > MAX_INFLATED


def listed(spans: list[tuple[int, int, str]]) -> str:
    ordered = sorted(spans, key=lambda x: (x[0], KINDS.index(x[2]), x[1]))
    return ",".join(f"{kind}:{start}:{end}" for start, end, kind in ordered)


_OUT = "doc_id long, n_assign long, n_access long, n_hex long, base_spans string, spans string, n_layers int, truncated boolean, redacted string"


def redact(text: str, spans: list[tuple[int, int, str]], mark: str = "[SECRET]") -> str:
    """Text with the union of spans replaced by one mark per merged run."""
    out, at = [], 0
    for start, end, _ in sorted(spans):
        if start >= at:
            out += [text[at:start], mark]
        at = max(at, end)
    return "".join(out) + text[at:]


def scan_documents(docs: DataFrame, redacted: bool = False) -> DataFrame:
    """One row per document: base counts, base spans, all spans; with ``redacted`` also the cleaned text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in chunks(batches):
            rows = []
            for doc_id, raw in zip(ids, texts, strict=True):
                text = raw.decode("utf-8", "replace")
                base = scan(text)
                more, layers, cut = worklist(text)
                spans = list(set(base) | set(more))
                count = [sum(k == kind for _, _, k in base) for kind in KINDS]
                rows.append((doc_id, *count, listed(base), listed(spans), layers, cut, redact(text, spans) if redacted and spans else None))
            yield pa.RecordBatch.from_arrays(
                [pa.array(col, kind) for col, kind in zip(zip(*rows, strict=True), (pa.int64(),) * 4 + (pa.string(), pa.string(), pa.int32(), pa.bool_(), pa.string()), strict=True)],
                names=[x.split()[0] for x in _OUT.split(", ")],
            )

    out = id_and_text(docs).mapInArrow(run, _OUT)
    return out if redacted else out.drop("redacted")


def secret_query(docs: DataFrame) -> DataFrame:
    """The contract's columns, derived from the operator's spans."""
    return scan_documents(docs).select(
        "doc_id", "n_assign", "n_access", "n_hex", F.sha2("base_spans", 256).alias("base_sha256"), "spans", "n_layers", "truncated"
    )


def redact_documents(docs: DataFrame) -> DataFrame:
    """``docs`` with every span found replaced; all rows and columns stay."""
    names = docs.columns
    text_at = names.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for text in batch.column(text_at).to_pylist():
                if text:
                    spans = scan(text) + worklist(text)[0]
                    text = redact(text, spans) if spans else text
                texts.append(text)
            columns = list(batch.columns)
            columns[text_at] = pa.array(texts, batch.schema.field(text_at).type)
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    return docs.mapInArrow(run, docs.schema)
