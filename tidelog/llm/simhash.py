"""SimHash near-duplicates with BK-trees (operator 9).

Every document gets a 64-bit fingerprint: bit b is 1 if it is set in over half of
the XXH64 values of its word shingles. Distinct fingerprints that differ in at most
``radius`` bits are linked and documents take the smallest doc_id of their component.

Search: two fingerprints within ``radius`` bits agree in at least one of radius + 1
blocks, so the trees are built per shard = (block, value of the block). In a shard's
BK-tree children are keyed by their integer Hamming distance to the parent; a query
follows only edges within the radius of its own distance. The named method broadcasts
the shard trees; here a tree travels by shuffle to the task that queries it, since
fingerprints of all documents must not pass through the driver and have no size
bound. Shards with over ``SHARD_ROWS`` fingerprints are split again by blocks of the
remaining bits, which again loses no link. Of a shard's links only those that join
two of its components are emitted: as many as fingerprints at most.

``keep_one``, the pipeline's stage, takes word 5-shingles and a Jaccard similarity of
0.8; see ``similar_keepers``. There too the cases below hold.

Defined cases: null text is empty; without words the fingerprint is zero, and is
linked like any other; fewer words than a shingle give one shingle of them all; rows
that share a doc_id get one row each, with the same component; a null doc_id takes
part, and is never the smallest; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import chunks, id_and_text, join_back, materialize, parallelism
from .components import components

SEED = 42
BITS = 64
#: Fingerprints in a shard before it is split by further blocks.
SHARD_ROWS = 2000
#: Wide fingerprints: words of 64 bits; bands of MinHash values that shard them, and values in a band.
LANES, BANDS, BAND_ROWS = 4, 12, 4
#: Shingles of the texts compared in one task.
SHARD_SHINGLES = 4_000_000
#: Standard deviations that the radius of a similarity is widened by; small sets, where majorities tie, need over 4.
SLACK = 5.5
# Odd multipliers and an increment that mix a hash into the next lane's.
MIX = np.array([0x9E3779B97F4A7C15, 0x632BE59BD9B4E019, 0xD6E8FEB86659FD93], np.uint64)
_MULTIPLIERS = np.random.default_rng(SEED).integers(0, 1 << 63, BANDS * BAND_ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_hashes(text: bytes, words: int) -> np.ndarray:
    """XXH64 of each word shingle, repeats included; none without words."""
    tokens = text.lower().split()
    if not tokens:
        return np.zeros(0, np.uint64)
    joined = b" ".join(tokens)
    ends = np.cumsum([len(t) + 1 for t in tokens]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    if len(tokens) > words:
        starts, ends = starts[: 1 - words or None], ends[words - 1 :]
    else:
        starts, ends = starts[:1], ends[-1:]
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(joined[s:e], SEED) for s, e in zip(starts.tolist(), ends.tolist(), strict=True)), "<u8", len(starts))


def majority_bits(hashes: np.ndarray) -> bytes:
    """64 bits, little-endian: a bit is 1 if it is set in over half of the hashes."""
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        part = np.ascontiguousarray(hashes[at : at + (1 << 16)]).view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(0, dtype=np.int64)
    return np.packbits(ones * 2 > len(hashes), bitorder="little").tobytes()


def fingerprint(text: bytes, words: int = 3) -> int:
    """The SimHash of one text, as an unsigned integer."""
    return int.from_bytes(majority_bits(shingle_hashes(text, words)), "little")


def fingerprints(docs: DataFrame, words: int = 3) -> DataFrame:
    """(doc_id, fp): one row per document, fp the fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in chunks(batches):
            found = np.array([fingerprint(t, words) for t in texts], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(found)], names=["doc_id", "fp"])

    return id_and_text(docs).mapInArrow(run, "doc_id long, fp long")


class BKTree:
    """Nodes with children keyed by Hamming distance to the parent."""

    def __init__(self) -> None:
        self.values: list[int] = []
        self.children: list[dict[int, int]] = []

    def add(self, value: int) -> None:
        self.values.append(value)
        self.children.append({})
        new = len(self.values) - 1
        at = 0
        while at != new:
            at = self.children[at].setdefault((self.values[at] ^ value).bit_count(), new)

    def within(self, value: int, radius: int) -> list[int]:
        """Indexes of the nodes at most ``radius`` bits away."""
        if not self.values:
            return []
        found, todo = [], [0]
        values, children = self.values, self.children
        while todo:
            at = todo.pop()
            far = (values[at] ^ value).bit_count()
            if far <= radius:
                found.append(at)
            edges = children[at]
            if len(edges) > 2 * radius:
                todo += [edges[k] for k in range(far - radius, far + radius + 1) if k in edges]
            else:
                todo += [child for k, child in edges.items() if far - radius <= k <= far + radius]
        return found


def shard_links(values: list[int], radius: int) -> list[tuple[int, int]]:
    """Links of one shard that join its components: a spanning forest."""
    tree, links = BKTree(), []
    root = list(range(len(values)))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for i, value in enumerate(values):
        for j in tree.within(value, radius):
            a, b = find(i), find(j)
            if a != b:
                root[a] = b
                links.append((value, values[j]))
        tree.add(value)
    return links


def _blocks(bits: list[int], parts: int) -> list[list[int]]:
    return [list(map(int, x)) for x in np.array_split(np.array(bits), parts)]


def _mask(bits: list[int]) -> int:
    value = sum(1 << b for b in bits)
    return value - (1 << 64) if value >> 63 else value


def _sharded(fps: DataFrame, radius: int) -> DataFrame:
    """(shard, fp): each fingerprint once per block, or per two blocks in large shards."""
    blocks = _blocks(list(range(BITS)), radius + 1)
    masks = [F.lit(_mask(b)) for b in blocks]
    keyed = fps.select("fp", F.explode(F.array(*[F.struct(F.lit(i).alias("block"), F.col("fp").bitwiseAND(m).alias("value")) for i, m in enumerate(masks)])).alias("s"))
    keyed = keyed.select("fp", "s.block", "s.value")
    large = keyed.groupBy("block", "value").count().where(F.col("count") > SHARD_ROWS).select("block", "value", F.lit(True).alias("large"))
    keyed = keyed.join(large, ["block", "value"], "left")
    finer = F.lit(None).cast("array<struct<sub:int,subvalue:long>>")
    for i, block in enumerate(blocks):
        rest = [b for b in range(BITS) if b not in block]
        subs = [F.struct(F.lit(k).alias("sub"), F.col("fp").bitwiseAND(F.lit(_mask(x))).alias("subvalue")) for k, x in enumerate(_blocks(rest, radius + 1))]
        finer = F.when(F.col("block") == i, F.array(*subs)).otherwise(finer)
    whole = F.array(F.struct(F.lit(-1).alias("sub"), F.lit(0).cast("long").alias("subvalue")))
    keyed = keyed.withColumn("f", F.explode(F.when(F.col("large"), finer).otherwise(whole)))
    return keyed.select("block", "value", "f.sub", "f.subvalue", "fp")


def links(fps: DataFrame, radius: int = 3) -> DataFrame:
    """(u, v) pairs of distinct fingerprints within ``radius`` bits, enough to connect all that are linked."""
    shards = _sharded(fps.select("fp").distinct(), radius)
    keys = ["block", "value", "sub", "subvalue"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        # Rows arrive sorted by shard, so one shard is held at a time.
        held_key, held = None, []
        for batch in batches:
            out = []
            for *key, fp in batch.itertuples(index=False, name=None):
                if key != held_key:
                    if len(held) > 1:
                        out += shard_links(held, radius)
                    held_key, held = key, []
                held.append(fp & 0xFFFFFFFFFFFFFFFF)
            yield _signed(out)
        if len(held) > 1:
            yield _signed(shard_links(held, radius))

    dealt = shards.repartition(parallelism(fps.sparkSession), *keys).sortWithinPartitions(*keys, "fp")
    return dealt.select(*keys, "fp").mapInPandas(run, "u long, v long").distinct()


def _signed(pairs: list[tuple[int, int]]) -> pd.DataFrame:
    table = np.array(pairs, np.uint64).reshape(-1, 2).view(np.int64)
    return pd.DataFrame({"u": table[:, 0], "v": table[:, 1]})


def _lowest(classes: DataFrame, pairs: DataFrame) -> DataFrame:
    """(fp, component_id) of classes (fp, low) and links between fps."""
    joined = components(pairs)
    heads = joined.groupBy("component").agg(F.count("*").alias("n"))
    nodes = joined.select(F.col("node").alias("fp"), "component").unionByName(heads.select(F.col("component").alias("fp"), "component"))
    # A class is one row, so this join has no hot key; a component may hold very many classes.
    named = materialize(nodes.join(classes.select("fp", "low"), "fp"))
    least = named.groupBy("component").agg(F.min("low").alias("least"))
    moved = join_back(named.select("fp", "component"), least, "component", heads).select("fp", "least")
    return classes.select("fp", "low").join(moved, "fp", "left").select("fp", F.coalesce("least", "low").alias("component_id"))


def near_duplicates(docs: DataFrame, words: int = 3, radius: int = 3) -> DataFrame:
    """(doc_id, fp, component_id): component_id is the smallest doc_id reachable by links."""
    rows = materialize(fingerprints(docs, words))
    classes = materialize(rows.groupBy("fp").agg(F.min("doc_id").alias("low"), F.count("*").alias("n")))
    lowest = materialize(_lowest(classes, links(classes, radius)))
    return join_back(rows, lowest, "fp", classes).select("doc_id", "fp", "component_id")


def simhash_query(docs: DataFrame) -> DataFrame:
    return near_duplicates(docs).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def wide_bits(hashes: np.ndarray) -> bytes:
    """The SimHash of ``64 * LANES`` bits of a set of shingles."""
    lanes = [hashes]
    for _ in range(LANES - 1):
        mixed = lanes[-1] * MIX[0] + MIX[1]
        mixed ^= mixed >> np.uint64(29)
        mixed *= MIX[2]
        lanes.append(mixed ^ (mixed >> np.uint64(32)))
    return b"".join(map(majority_bits, lanes))


def wide_fingerprint(text: bytes, words: int = 5) -> tuple[bytes, int, bytes, list[int]]:
    """Of a text's set of shingles: a digest, its size, the SimHash of ``64 * LANES`` bits, and a shard key for each band of MinHash values."""
    hashes = np.unique(shingle_hashes(text, words))
    name = xxhash.xxh3_128_digest(hashes.tobytes())
    if not len(hashes):
        return name, 0, wide_bits(hashes), [-1 - b for b in range(BANDS)]
    least = np.array([(hashes * m).min() for m in _MULTIPLIERS], "<u8").reshape(BANDS, -1)
    keys = [xxhash.xxh64_intdigest(row.tobytes(), b) for b, row in enumerate(least)]
    return name, len(hashes), wide_bits(hashes), np.array(keys, np.uint64).view(np.int64).tolist()


def _text_hash() -> Column:
    return F.unhex(F.sha2(F.coalesce(F.col("text").cast("string"), F.lit("")), 256))


def wide_fingerprints(docs: DataFrame, words: int = 5) -> DataFrame:
    """(row, name, size, fp, bands): one row per document; row is (no_id, doc_id, text_hash)."""
    kind = pa.struct([("no_id", pa.bool_()), ("doc_id", pa.int64()), ("text_hash", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, texts in chunks(batches):
            found = list(zip(*(wide_fingerprint(t, words) for t in texts), strict=True))
            kinds = (pa.binary(), pa.int64(), pa.binary(), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(rows, kind), *(pa.array(c, k) for c, k in zip(found, kinds, strict=True))], names=["row", "name", "size", "fp", "bands"])

    row = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_hash")
    keyed = id_and_text(docs, _text_hash().alias("text_hash")).select(row.alias("row"), "text")
    return keyed.mapInArrow(run, "row struct<no_id:boolean,doc_id:long,text_hash:binary>, name binary, size long, fp binary, bands array<long>")


def shard_forest(values: list[int], radius: int) -> list[tuple[int, int]]:
    """Indexes of links that join a shard's components, by a BK-tree.

    A subtree known to lie in one component is left out once the query is part of it,
    so a large group of near copies costs about one comparison a member.
    """
    children: list[dict[int, int]] = []
    root, label, links = list(range(len(values))), list(range(len(values))), []

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for i, value in enumerate(values):
        todo = [0] if i else []
        while todo:
            at = todo.pop()
            far = (values[at] ^ value).bit_count()
            if far <= radius and find(at) != find(i):
                root[find(i)] = find(at)
                links.append((i, at))
            mine = find(i)
            for k, child in children[at].items():
                if far - radius <= k <= far + radius and (label[child] < 0 or find(label[child]) != mine):
                    todo.append(child)
        children.append({})
        at, mine = 0, find(i)
        while at != i:
            if label[at] >= 0 and find(label[at]) != mine:
                label[at] = -1
            at = children[at].setdefault((values[at] ^ value).bit_count(), i)
    return links


def _dealt(parts: Column, name: Column) -> Column:
    """Pairs of blocks that one of ``parts`` blocks goes to: any two rows meet in at least one pair."""
    block = F.pmod(F.xxhash64(name), parts)
    others = F.filter(F.sequence(F.lit(0).cast("long"), parts - 1), lambda k: k != block)
    pairs = F.transform(others, lambda k: F.struct(F.least(k, block).alias("a"), F.greatest(k, block).alias("b")))
    return F.when(parts > 1, pairs).otherwise(F.array(F.struct(F.lit(0).cast("long").alias("a"), F.lit(0).cast("long").alias("b"))))


def _parts(share: Column) -> Column:
    """Blocks for a group: two of them make a share of 1 at most."""
    return F.when(share > 1, F.ceil(2 * share)).otherwise(1).cast("long")


def similar_links(classes: DataFrame, radius: int) -> DataFrame:
    """(u, v) names of fingerprints within ``radius`` bits that share a band, enough to connect all such.

    A shard is a band; one of over ``SHARD_ROWS`` classes is cut in blocks, of which
    every two meet in a task.
    """
    keyed = materialize(classes.select("name", "fp", F.explode("bands").alias("band")))
    large = keyed.groupBy("band").count().where(F.col("count") > SHARD_ROWS).select("band", _parts(F.col("count") / SHARD_ROWS).alias("parts"))
    shards = keyed.join(large, "band", "left").select("band", F.explode(_dealt(F.coalesce("parts", F.lit(1).cast("long")), F.col("name"))).alias("pair"), "name", "fp")

    def forest(held: list[tuple]) -> list[tuple[bytes, bytes]]:
        return [(held[i][0], held[j][0]) for i, j in shard_forest([int.from_bytes(f, "little") for _, f in held], radius)]

    return _linked(shards.select("band", "pair.a", "pair.b", "name", "fp"), "band", forest)


def _linked(dealt: DataFrame, group: str, forest: Callable[[list[tuple]], list[tuple[bytes, bytes]]]) -> DataFrame:
    """(u, v) that ``forest`` finds in each (group, a, b) of rows (group, a, b, name, ...); of equal names one row counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Rows arrive sorted by shard, so one shard is held at a time.
        held_key, held = None, []
        for batch in batches:
            out = []
            for *key, name, one in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if key != held_key:
                    out += forest(held) if len(held) > 1 else []
                    held_key, held = key, []
                if not held or held[-1][0] != name:
                    held.append((name, one))
            yield _pairs(out)
        yield _pairs(forest(held) if len(held) > 1 else [])

    spread = dealt.repartition(parallelism(dealt.sparkSession), group, "a", "b").sortWithinPartitions(group, "a", "b", "name")
    return spread.mapInArrow(run, "u binary, v binary").distinct()


def exact_forest(sets: list[np.ndarray], fps: list[bytes], radius: int, similarity: float) -> list[tuple[int, int]]:
    """Indexes of links that join the components of sets with that Jaccard similarity."""
    wide = np.frombuffer(b"".join(fps), np.uint64).reshape(len(fps), -1)
    size = np.array([len(x) for x in sets])
    root, links = np.arange(len(sets)), []
    for i in range(1, len(sets)):
        far = np.bitwise_count(wide[:i] ^ wide[i]).sum(1)
        fits = np.minimum(size[:i], size[i]) >= similarity * np.maximum(size[:i], size[i])
        near = np.flatnonzero((far <= radius) & fits)
        for j in near[np.argsort(far[near], kind="stable")].tolist():
            if root[i] != root[j]:
                both = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
                if both >= similarity * (size[i] + size[j] - both) - 1e-9:
                    links.append((i, j))
                    root[: i + 1][root[: i + 1] == root[i]] = root[j]
    return links


def exact_links(docs: DataFrame, classes: DataFrame, loose: DataFrame, radius: int, words: int, similarity: float) -> DataFrame:
    """(u, v) names of classes whose sets have that Jaccard similarity, within components of the loose links.

    Only the texts of such components travel, once each; a large component is cut in
    blocks, of which every two meet in a task.
    """
    found = components(loose)
    members = materialize(found.unionByName(found.select(F.col("component").alias("node"), "component").distinct()))
    members = materialize(members.join(classes, F.col("node") == F.col("name")).select("component", "name", "size", "low"))
    share = F.greatest(F.count("*") / SHARD_ROWS, F.sum("size") / SHARD_SHINGLES)
    parts = members.groupBy("component").agg(_parts(share).alias("parts"))
    members = members.join(parts, "component").select("component", "parts", "name", F.col("low.doc_id").alias("low_id"), F.col("low.text_hash").alias("low_hash"))
    texts = id_and_text(docs, _text_hash().alias("text_hash"))
    joined = texts.join(members, F.col("doc_id").eqNullSafe(F.col("low_id")) & (F.col("text_hash") == F.col("low_hash")))
    dealt = joined.select("component", F.explode(_dealt(F.col("parts"), F.col("name"))).alias("pair"), "name", "text").select("component", "pair.a", "pair.b", "name", "text")

    def forest(held: list[tuple]) -> list[tuple[bytes, bytes]]:
        sets, fps = [], []
        for _, text in held:
            raw = text.encode("utf-8", "replace")
            sets.append(np.unique(shingle_hashes(raw, words)))
            fps.append(wide_bits(sets[-1]))
        return [(held[i][0], held[j][0]) for i, j in exact_forest(sets, fps, radius, similarity)]

    return _linked(dealt, "component", forest)


def _pairs(found: list[tuple[bytes, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([p[k] for p in found], pa.binary()) for k in (0, 1)], names=["u", "v"])


def similarity_radius(similarity: float) -> int:
    """Bits that wide fingerprints of that Jaccard similarity differ in, and SLACK more for chance."""
    cosine = 2 * similarity / (1 + similarity)
    share = math.acos(cosine) / math.pi
    return round(64 * LANES * share + SLACK * math.sqrt(64 * LANES * share * (1 - share)))


def similar_keepers(docs: DataFrame, words: int = 5, similarity: float = 0.8) -> DataFrame:
    """(doc_id, text_hash) of the smallest row of each group, with links between texts whose shingle sets are that similar.

    At a similarity of 0.8 fingerprints differ in 15 % of their bits, where blocks of
    bits shard nothing. So the shards are bands of MinHash values, each with a BK-tree
    of wide fingerprints, whose radius is so wide that it only filters. Within the
    components of these links, pairs are linked by the Jaccard similarity of their sets.
    """
    rows = materialize(wide_fingerprints(docs, words))
    classes = materialize(rows.groupBy("name").agg(F.min("row").alias("low"), F.first("size").alias("size"), F.first("fp").alias("fp"), F.first("bands").alias("bands")))
    radius = similarity_radius(similarity)
    links = exact_links(docs, classes, similar_links(classes, radius), radius, words, similarity)
    return _lowest(classes.select(F.col("name").alias("fp"), "low"), links).select("component_id.doc_id", "component_id.text_hash").distinct()


def keep_one(docs: DataFrame, words: int = 5, similarity: float = 0.8, by_row: bool = False) -> DataFrame:
    """``docs`` with one document of each group: the smallest doc_id, and of those the smallest hash of the text.

    ``by_row``: a row is a document of its own, named by its doc_id and text, so one row
    of every group stays whatever the ids. Otherwise a doc_id that is not null names one
    document, and of groups whose smallest ids are equal one row stays.
    """
    kept = similar_keepers(docs, words, similarity)
    if not by_row:
        own = F.when(F.col("doc_id").isNull(), F.col("text_hash")).alias("own")
        kept = kept.groupBy("doc_id", own).agg(F.min("text_hash").alias("text_hash"))
    kept = kept.select(F.col("doc_id").alias("_tidelog_id"), F.col("text_hash").alias("_tidelog_kept"))
    marked = docs.withColumn("_tidelog_hash", _text_hash())
    rows = marked.join(kept, F.col("_tidelog_hash").eqNullSafe(F.col("_tidelog_kept")) & F.col("doc_id").cast("long").eqNullSafe(F.col("_tidelog_id")), "left_semi")
    return rows.dropDuplicates(["doc_id", "_tidelog_hash"]).drop("_tidelog_hash")
