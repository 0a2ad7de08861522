"""SimHash near-duplicate detection by tiled exact comparison.

Fingerprints are 64-bit majority votes over hashed word shingles. Copies meet
first: one row per distinct fingerprint goes on. Distinct fingerprints are
dealt to buckets by every pair of six equal bit blocks (two fingerprints that
differ in at most four bits agree in two blocks at least). Inside a bucket,
fingerprints sorted by population count are cut into tiles, and tile is
compared with tile by exclusive-or and bit counts; tile pairs whose population
counts differ by more than the radius are skipped. A bucket of more than MOST
fingerprints is never held: its tiles are dealt out, each pair in reach as a
task's group of its own. Tiles emit a spanning forest of their links rather
than all pairs, and components are joined on Spark.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomspan.llm.common import connected_components, in_small_batches, staged, unstaged

_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
TILE = 1024
MOST = 8 * TILE  # rows of a bucket that are compared where they stream by; beyond, tile pairs are dealt out
HELD = 1 << 27  # bytes of shingle hashes of a bucket that one task compares; of more, tiles of a quarter of that are cut


def fingerprint(text: str | None, shingle: int, seed: int = 42) -> int:
    """64-bit SimHash of one text; zero when it has no word."""
    words = (text or "").encode().translate(_LOWER).split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    k = min(shingle, len(words))
    starts = np.concatenate(([0], ends[:-1] + 1))
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(joined[s:e], seed) for s, e in zip(starts[: len(words) - k + 1].tolist(), ends[k - 1 :].tolist())], dtype="<u8")
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        part = hashes[at : at + (1 << 16)]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = 2 * ones > len(hashes)
    return int(np.packbits(bits, bitorder="little").view("<u8")[0])


def with_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4) -> DataFrame:
    """(id, fingerprint as signed 64-bit long) per row; null text has fingerprint zero."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_small_batches(batches, 256):
            prints = np.array([fingerprint(x, shingle) for x in batch.column(1).to_pylist()], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints.view(np.int64))], names=["id", "fingerprint"])

    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return source.mapInArrow(run, "id long, fingerprint long")


def _blocks(radius: int) -> list[tuple[int, int]]:
    """(shift, width) of radius + 2 bit blocks that cover 64 bits."""
    n = radius + 2
    cuts = [64 * i // n for i in range(n + 1)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:])]


def _far(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Differing bits between every row of ``a`` and every row of ``b``."""
    out = np.zeros((len(a), len(b)), np.uint16)
    for x, y in zip(a.T, b.T):
        out += np.bitwise_count(x[:, None] ^ y[None, :])
    return out


class Exact:
    """Test of Jaccard similarity on sorted distinct shingle hashes, one array a row.

    ``reach`` has the radii of similarity_radius, beyond which no test is made.
    """

    def __init__(self, sets: list[np.ndarray], similarity: float, reach: tuple[int, int]):
        self.sets, self.similarity, self.reach = sets, similarity, reach
        self.sizes = np.fromiter(map(len, sets), np.int64, len(sets))

    def part(self, start: int, end: int) -> Exact:
        return Exact(self.sets[start:end], self.similarity, self.reach)

    def similar(self, row: int, others: np.ndarray) -> np.ndarray:
        """Which of ``others`` are as similar to ``row`` as is asked."""
        own, sizes = self.sets[row], self.sizes[others]
        least, most = np.minimum(sizes, len(own)), np.maximum(sizes, len(own))
        out = np.zeros(len(others), bool)
        todo = np.flatnonzero(least >= self.similarity * most - 1e-9)
        while len(todo):
            n = max(1, int(np.searchsorted(np.cumsum(sizes[todo]), 1 << 20)))
            at, todo = todo[:n], todo[n:]
            found = np.concatenate([self.sets[i] for i in others[at].tolist()])
            same = own[np.minimum(np.searchsorted(own, found), len(own) - 1)] == found
            common = np.add.reduceat(same, np.cumsum(sizes[at]) - sizes[at], dtype=np.int64)
            out[at] = common >= self.similarity * (sizes[at] + len(own) - common) - 1e-9
        return out

    def near(self, far: np.ndarray, tile: np.ndarray, other: np.ndarray) -> np.ndarray:
        """Which pairs of rows are candidates: those within the radius for their sizes."""
        tiny, wide = self.reach
        return far <= np.where(np.maximum(self.sizes[tile][:, None], self.sizes[other][None, :]) > TINY, wide, tiny)


def _forest(prints: np.ndarray, radius: int, exact: Exact | None = None, split: int = 0) -> list[tuple[int, int]]:
    """Spanning forest, as pairs of row numbers, of the links among fingerprints.

    With ``split``, only links between the rows before it and those from it on
    are looked for. With ``exact``, pairs within the radius are candidates that
    have to pass it, unless one tree holds both already.
    """
    edges: list[tuple[int, int]] = []
    counts = np.bitwise_count(prints).sum(axis=1, dtype=np.int64)
    label = np.arange(len(prints))
    order = np.argsort(counts[: split or None], kind="stable")
    others = split + np.argsort(counts[split:], kind="stable") if split else order
    for i in range(0, len(order), TILE):
        tile = order[i : i + TILE]
        for j in range(0 if split else i, len(others), TILE):
            other = others[j : j + TILE]
            if counts[other[0]] - counts[tile[-1]] > radius:
                break
            if counts[tile[0]] - counts[other[-1]] > radius:
                continue
            far = _far(prints[tile], prints[other])
            near = far <= radius if exact is None else exact.near(far, tile, other)
            if not split and i == j:
                near = np.triu(near, 1)
            for row in np.flatnonzero(near.any(axis=1)).tolist():
                at, to = int(tile[row]), other[near[row]]
                to = to[label[to] != label[at]]
                if exact is not None and len(to):
                    to = to[exact.similar(at, to)]
                if len(to):
                    trees, first = np.unique(label[to], return_index=True)
                    edges += [(at, x) for x in to[first].tolist()]
                    label[np.isin(label, trees)] = label[at]
    return edges


def _bucket_links(keys: np.ndarray, prints: np.ndarray, radius: int, exact: Exact | None = None) -> Iterator[np.ndarray]:
    """Links, as pairs of row numbers, of whole buckets; rows are sorted by key."""
    bounds = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1], [True])))
    sizes = np.diff(bounds)
    small = np.repeat(sizes <= 8, sizes)
    for lag in range(1, 8):
        if len(keys) <= lag:
            break
        at = np.flatnonzero((keys[lag:] == keys[:-lag]) & small[lag:])
        at = at[np.bitwise_count(prints[at] ^ prints[at + lag]).sum(axis=1, dtype=np.int64) <= radius]
        if exact is not None:
            at = at[[exact.similar(i, np.array([i + lag]))[0] for i in at.tolist()]] if len(at) else at
        if len(at):
            yield np.stack((at, at + lag), axis=1)
    for start, size in zip(bounds[:-1][sizes > 8].tolist(), sizes[sizes > 8].tolist()):
        if edges := _forest(prints[start : start + size], radius, exact and exact.part(start, start + size)):
            yield np.array(edges) + start


def _rows_of(batch: pa.RecordBatch, sets: list[np.ndarray] | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys, nodes and prints of a batch; its shingle sets, if any, are added to ``sets``."""
    prints = batch.column(2).flatten().to_numpy().view(np.uint64).reshape(batch.num_rows, -1)
    if sets is not None:
        values = [np.frombuffer(x, "<u8") for x in batch.column(3).to_pylist()]
        ends = np.cumsum([len(x) for x in values]).tolist()
        values = np.concatenate(values)
        sets += [values[a:b] for a, b in zip([0, *ends], ends)]
    return batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False), prints


def _linked(dealt: DataFrame, radius: int, similar: tuple[float, tuple[int, int]] | None = None, grouped: bool = False) -> DataFrame:
    """Distinct links (a, b) between nodes that share a bucket and lie within the radius.

    ``dealt`` has rows (bucket, node, print as array of longs). Buckets
    stream through their task, sorted by population count. One of at most MOST
    rows and HELD bytes is compared there; of a larger one only tiles are cut, and every pair
    of tiles in reach of their population counts becomes a group of two tiles,
    so that no task holds more however large a bucket is. With
    ``similar``, a similarity and its radii, rows also have sorted distinct
    shingle ``hashes`` (binary), and links pass the exact test. With
    ``grouped``, the result is (bucket, node) of the trees of links; trees of
    the same nodes are one bucket.
    """
    payload = ["print", *(["hashes"] if similar else [])]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.list_(pa.int64()), pa.binary()]
    names = ["a", "b", "bucket", "tile", "low", "high", "print", "hashes"]
    schema = "a long, b long, bucket long, tile int, low int, high int, print array<long>, hashes binary"

    def links(pairs: Iterator[np.ndarray], nodes: np.ndarray) -> Iterator[pa.RecordBatch]:
        def rows(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), *(pa.nulls(len(a), k) for k in kinds[2:])], names=names)

        if grouped:
            for members in _trees(pairs):
                found = np.sort(nodes[members])
                yield rows(np.full(len(found), xxhash.xxh64_intdigest(found.tobytes()), np.uint64).view(np.int64), found)
            return
        for pair in pairs:
            yield rows(nodes[pair[:, 0]], nodes[pair[:, 1]])

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, nodes, prints, sets = np.empty(0, np.int64), np.empty(0, np.int64), None, [] if similar else None
        large, tiles = None, 0  # the bucket whose tiles are being cut, and how many there are

        def cut(n: int) -> None:
            nonlocal keys, nodes, prints, sets
            keys, nodes, prints, sets = keys[n:], nodes[n:], prints[n:], sets and sets[n:]

        def full() -> bool:
            return len(keys) >= MOST or bool(sets) and 8 * sum(map(len, sets)) > HELD

        def of_tile(end: int) -> tuple[int, bool]:
            """Rows of the next tile among the first ``end``, and whether it can take no more."""
            n, room = min(end, TILE), HELD // 4
            if sets:
                room_for = int(np.searchsorted(8 * np.cumsum([len(x) for x in sets[:n]]), room, side="right"))
                return max(1, min(n, room_for)), room_for < n or n == TILE
            return n, n == TILE

        def tile(n: int) -> pa.RecordBatch:
            counts = np.bitwise_count(prints[:n]).sum(axis=1, dtype=np.int32)
            fixed = [pa.array(np.full(n, x, np.int32)) for x in (tiles, counts.min(), counts.max())]
            hashes = pa.array([x.tobytes() for x in sets[:n]], pa.binary()) if similar else pa.nulls(n, pa.binary())
            return pa.RecordBatch.from_arrays([pa.nulls(n, pa.int64()), pa.array(nodes[:n]), pa.array(keys[:n]), *fixed, pa.array(list(prints[:n].view(np.int64)), kinds[6]), hashes], names=names)

        def settled(last: bool) -> Iterator[pa.RecordBatch]:
            """Deal with what is known whole."""
            nonlocal large, tiles
            while len(keys):
                if large is not None:
                    end = int(np.searchsorted(keys, large, side="right"))
                    over = last or end < len(keys)
                    n, whole_tile = of_tile(end) if end else (0, False)
                    if whole_tile or end and over:
                        yield tile(n)
                        tiles += 1
                        cut(n)
                        continue
                    if not over:
                        return
                    large = None
                whole = len(keys) if last else int(np.searchsorted(keys, keys[-1]))
                if last and full():
                    whole = int(np.searchsorted(keys, keys[-1]))
                if whole:
                    exact = Exact(sets[:whole], *similar) if similar else None
                    yield from links(_bucket_links(keys[:whole], prints[:whole], radius, exact), nodes)
                    cut(whole)
                elif full():
                    large, tiles = int(keys[0]), 0
                else:
                    return

        for batch in batches:
            if not batch.num_rows:
                continue
            fresh = _rows_of(batch, sets)
            keys, nodes = np.concatenate((keys, fresh[0])), np.concatenate((nodes, fresh[1]))
            prints = fresh[2] if prints is None else np.concatenate((prints, fresh[2]))
            yield from settled(False)
        yield from settled(True)

    def compared_tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, nodes, prints, sets = np.empty(0, np.int64), np.empty(0, np.int64), None, [] if similar else None

        def settled(n: int) -> Iterator[pa.RecordBatch]:
            """Groups, each of the rows of one tile or of two; the lowest bit of a key tells them apart."""
            bounds = np.flatnonzero(np.concatenate(([True], keys[1:n] >> 1 != keys[: n - 1] >> 1, [True])))
            for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
                exact = Exact(sets[a:b], *similar) if similar else None
                if pairs := _forest(prints[a:b], radius, exact, int(np.searchsorted(keys[a:b], keys[a], side="right")) % (b - a)):
                    yield from links(iter([np.array(pairs)]), nodes[a:b])

        for batch in batches:
            if not batch.num_rows:
                continue
            fresh = _rows_of(batch, sets)
            keys, nodes = np.concatenate((keys, fresh[0])), np.concatenate((nodes, fresh[1]))
            prints = fresh[2] if prints is None else np.concatenate((prints, fresh[2]))
            whole = int(np.searchsorted(keys >> 1, keys[-1] >> 1))
            if whole:
                yield from settled(whole)
                keys, nodes, prints, sets = keys[whole:], nodes[whole:], prints[whole:], sets and sets[whole:]
        if len(keys):
            yield from settled(len(keys))

    ones = F.aggregate("print", F.lit(0), lambda n, x: n + F.bit_count(x))
    by_bucket = dealt.select("bucket", "node", *payload, ones.alias("ones")).repartition("bucket").sortWithinPartitions("bucket", "ones", "node").drop("ones")
    found = staged(by_bucket.mapInArrow(compared, schema))
    done, held = found.where("tile IS NULL").select("a", "b"), []
    later = found.where("tile IS NOT NULL").select("bucket", "tile", "low", "high", F.col("b").alias("node"), *payload)
    if not later.isEmpty():
        tiles = later.groupBy("bucket", "tile").agg(F.first("low").alias("low"), F.first("high").alias("high"))
        right = tiles.select("bucket", F.col("tile").alias("other"), F.col("low").alias("from"))
        pairs = tiles.join(right, "bucket").where((F.col("tile") <= F.col("other")) & (F.col("from") - F.col("high") <= radius))
        group = F.shiftleft(F.shiftright(F.xxhash64("bucket", "tile", "other"), 2), 1)
        sides = F.when(F.col("tile") == F.col("other"), F.array(F.struct(F.col("tile").alias("tile"), group.alias("group")))).otherwise(
            F.array(F.struct(F.col("tile").alias("tile"), group.alias("group")), F.struct(F.col("other").alias("tile"), (group + 1).alias("group")))
        )
        dealt_out = staged(pairs.select("bucket", F.explode(sides).alias("x")).select("bucket", "x.tile", "x.group"))
        held.append(dealt_out)
        members = later.join(dealt_out, ["bucket", "tile"]).select("group", "node", *payload, F.shiftright("group", 1).alias("pair"))
        ordered = members.repartition("pair").sortWithinPartitions("group", "node").drop("pair")
        done = done.union(ordered.mapInArrow(compared_tiles, schema).select("a", "b"))
    out = staged((done.toDF("bucket", "node") if grouped else done).distinct())
    unstaged(found, *held)
    return out


def _trees(links: Iterator[np.ndarray]) -> Iterator[list[int]]:
    """Row numbers of each tree of two or more that the links form."""
    above: dict[int, int] = {}

    def root(x: int) -> int:
        while above.setdefault(x, x) != x:
            above[x] = x = above.setdefault(above[x], above[x])
        return x

    for pairs in links:
        for a, b in pairs.tolist():
            above[root(a)] = root(b)
    members: dict[int, list[int]] = {}
    for x in list(above):
        members.setdefault(root(x), []).append(x)
    yield from members.values()


def fingerprint_links(prints: DataFrame, radius: int = 4) -> DataFrame:
    """Links (a, b) that connect distinct fingerprints within ``radius`` bits.

    ``prints`` has one column ``fingerprint`` of distinct longs. Every pair in
    reach is connected by the links of the result, directly or through others.
    """
    bands = []
    for i, pair in enumerate(combinations(_blocks(radius), 2)):
        key = F.lit(i).cast("long")
        for shift, width in pair:
            part = F.shiftrightunsigned("fingerprint", shift).bitwiseAND((1 << width) - 1)
            key = F.shiftleft(key, width).bitwiseOR(part)
        bands.append(key)

    return _linked(prints.select(F.explode(F.array(*bands)).alias("bucket"), F.col("fingerprint").alias("node"), F.array("fingerprint").alias("print")), radius)


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, radius: int = 4) -> DataFrame:
    """(id, fingerprint long, component) per input row.

    Documents are linked when their fingerprints differ in at most ``radius``
    bits; ``component`` is the smallest id reachable, the own id included.
    Documents without words (null, empty, blank) all have fingerprint zero and
    are linked to each other. Repeated rows stay repeated. Rows whose id is
    null get the component of their fingerprint, null if no id is there.
    An empty table gives an empty result.
    """
    rows = staged(with_fingerprints(docs, id_col, text_col, shingle))
    distinct = staged(rows.groupBy("fingerprint").agg(F.min("id").alias("low")))
    links = fingerprint_links(distinct.select("fingerprint"), radius)
    groups = connected_components(links).withColumnsRenamed({"node": "fingerprint"})
    named = distinct.join(groups, "fingerprint", "left").withColumn("component", F.coalesce("component", "fingerprint"))
    lows = named.groupBy("component").agg(F.min("low").alias("component_id"))
    known = named.join(lows, "component").select("fingerprint", "component_id")
    return rows.join(known, "fingerprint").select("id", "fingerprint", F.col("component_id").alias("component"))


def shingle_hashes(text: str | None, shingle: int) -> np.ndarray:
    """Sorted distinct hashes of a text's word shingles; a shorter text is one shingle."""
    parts = (text or "").encode().translate(_LOWER).split()
    if not parts:
        return np.empty(0, np.uint64)
    k = min(shingle, len(parts))
    digest = xxhash.xxh64_intdigest
    return np.array(sorted({digest(b" ".join(parts[i : i + k])) for i in range(len(parts) - k + 1)}), dtype=np.uint64)


def wide_fingerprint(hashes: np.ndarray, words: int, anchors: int) -> tuple[np.ndarray, list[int]]:
    """A SimHash of ``words`` 64-bit words over distinct shingle hashes, and anchor hashes.

    An anchor is the least shingle hash under one of ``anchors`` orders.
    """
    if not len(hashes):
        return np.zeros(words, np.uint64), []
    out = np.empty(words, "<u8")
    for w in range(words):
        mixed, ones = _mixed(hashes, w), np.zeros(64, np.int64)
        for at in range(0, len(hashes), 1 << 16):
            ones += np.unpackbits(mixed[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        out[w] = np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0]
    return out, [int(_mixed(hashes, words + i).min().view(np.int64)) for i in range(anchors)]


def _mixed(hashes: np.ndarray, order: int) -> np.ndarray:
    x = (hashes ^ np.uint64(order * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(29))


TINY = 5  # shingles; with so few, a tied vote flips bits most often


def _flips(common: int, a: int, b: int) -> float:
    """Probability that a bit differs between sets of ``common`` shared and ``a`` and ``b`` other shingles."""
    share = lambda n: np.array([math.comb(n, k) for k in range(n + 1)]) / 2.0**n
    votes = lambda n: (2 * np.add.outer(np.arange(common + 1), np.arange(n + 1)) > common + n) @ share(n)
    p, q = votes(a), votes(b)
    return float(share(common) @ (p * (1 - q) + q * (1 - p)))


@lru_cache
def similarity_radius(similarity: float, bits: int) -> tuple[int, int]:
    """Most differing bits, with four standard deviations to spare, at a Jaccard similarity.

    The first is for sets of at most TINY shingles, the second for larger
    ones: few shingles are counted out, for many there is a limit.
    """
    worst = {True: 0.0, False: math.acos(2 * similarity / (1 + similarity)) / math.pi}
    for union in range(1, 65):
        common = math.ceil(similarity * union - 1e-9)
        for a in range(union - common + 1):
            b = union - common - a
            tiny = common + max(a, b) <= TINY
            worst[tiny] = max(worst[tiny], _flips(common, a, b))
    return tuple(int(bits * p + 4 * math.sqrt(bits * p * (1 - p))) for p in (worst[True], worst[False]))


def _near_groups(docs: DataFrame, id_col: str, text_col: str, shingle: int, similarity: float, words: int, anchors: int, keep: list[str]) -> tuple[DataFrame, DataFrame]:
    """All rows, numbered (row, node, id, text, kept), and (node, component, lead): each text's group and its first row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 40
        for batch in in_small_batches(batches, 256):
            hashes = [shingle_hashes(x, shingle) for x in batch.column(1).to_pylist()]
            found = [wide_fingerprint(x, words, anchors) for x in hashes]
            nodes = np.array([xxhash.xxh64_intdigest(x.tobytes()) for x in hashes], np.uint64).view(np.int64)
            prints, least = pa.array([p.view(np.int64) for p, _ in found], pa.list_(pa.int64())), pa.array([x for _, x in found], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(row, row + batch.num_rows)), pa.array(nodes), prints, least, *batch.columns], names=["row", "node", "print", "anchors", "id", "text", "kept"])
            row += batch.num_rows

    def with_hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_small_batches(batches, 256):
            hashes = [shingle_hashes(x, shingle).tobytes() for x in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(hashes, pa.binary()), batch.column(3)], names=["node", "print", "hashes", "buckets"])

    kept = F.struct(F.lit(0).alias("_none"), *[F.col(c) for c in keep])
    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"), kept.alias("kept"))
    rows = staged(source.mapInArrow(run, f"row long, node long, print array<long>, anchors array<long>, id long, text string, kept {source.schema['kept'].dataType.simpleString()}"))
    order = F.struct(F.col("id").isNull().alias("none"), "id", "row")
    distinct = staged(rows.groupBy("node").agg(F.min(order).alias("least"), F.first("print").alias("print"), F.first("anchors").alias("anchors")))
    dealt = distinct.select(F.posexplode("anchors").alias("i", "anchor"), "node", "print").withColumn("bucket", F.xxhash64("i", "anchor"))
    reach = similarity_radius(similarity, 64 * words)
    grouped = _linked(dealt, max(reach), grouped=True)
    wanted = grouped.groupBy("node").agg(F.collect_list("bucket").alias("buckets"))
    asked = distinct.join(wanted, "node").select("node", "print", F.col("least.row").alias("row"), "buckets")
    candidates = rows.select("row", "text").join(asked, "row").select("node", "print", "text", "buckets").mapInArrow(with_hashes, "node long, print array<long>, hashes binary, buckets array<long>")
    links = _linked(candidates.select(F.explode("buckets").alias("bucket"), "node", "print", "hashes"), max(reach), (similarity, reach))
    groups = connected_components(links)
    named = distinct.select("node", "least").join(groups, "node", "left").withColumn("group", F.coalesce("component", "node")).drop("component")
    firsts = named.groupBy("group").agg(F.min("least").alias("lowest"))
    known = staged(named.join(firsts, "group").select("node", F.col("lowest.id").alias("component"), F.col("lowest.row").alias("lead")))
    unstaged(distinct, grouped, links)
    return rows, known


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, similarity: float = 0.8, words: int = 8, anchors: int = 8, keep: list[str] = ()) -> DataFrame:
    """(id, text, ``keep`` columns, component, first) per row: groups of documents of given similarity.

    Documents are linked when their distinct ``shingle``-word shingles have a
    Jaccard similarity of ``similarity`` or more. Fingerprints meet in the tiles
    of their anchors (at 0.8, two documents share none of eight in three of a
    million cases); those within a wide radius are candidates (at 0.8, under one
    pair in ten thousand lies beyond). Each tile's candidates go on in groups,
    equal groups once, and there the shingles themselves are compared.
    Rows are told apart by their place, so rows of one id may be in different
    groups. ``component`` is the smallest id reachable, null where a group has
    no id. ``first`` is true for one row of each group: that of the smallest
    id, or without any id the first row. All texts without words are one
    group; repeated rows stay repeated and are of one group. An empty table
    gives an empty result.
    """
    rows, known = _near_groups(docs, id_col, text_col, shingle, similarity, words, anchors, keep)
    return rows.join(known, "node").select("id", "text", *[f"kept.{c}" for c in keep], "component", (F.col("row") == F.col("lead")).alias("first"))


def without_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, similarity: float = 0.8, words: int = 8, anchors: int = 8, keep: list[str] = ()) -> DataFrame:
    """(id, text, ``keep`` columns) of the first row of each group of ``near_duplicates``."""
    rows, known = _near_groups(docs, id_col, text_col, shingle, similarity, words, anchors, keep)
    leads = known.select(F.col("lead").alias("row")).distinct()
    return rows.join(leads, "row", "left_semi").select("id", "text", *[f"kept.{c}" for c in keep])


def op8_simhash(spark, sf_dir: str) -> DataFrame:
    found = simhash_components(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select(
        F.col("id").alias("doc_id"),
        F.lpad(F.lower(F.hex("fingerprint")), 16, "0").alias("fingerprint"),
        F.col("component").alias("component_id"),
    )
