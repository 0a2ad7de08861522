"""Substring deduplication with one compressed FM-index per shard.

A window is a run of consecutive words; windows that occur earlier (in a
smaller document, or further up) are cut out. Windows are routed so that equal
ones meet: a window's key is the least hash among its short word runs, so
neighbouring windows mostly share a key and travel as one segment. Keys that
occur once in the corpus cannot hide a repeat, and only segments of other keys
go on. A shard's text is the different segments of its keys, each once, with
the place where it stands first; a key of too many different segments parts
into keys of single windows. The shard's FM-index keeps that text as a wavelet
tree of its Burrows-Wheeler transform, the lengths that neighbouring suffixes
share, and the earliest place of every class of suffixes that agree over a
window. Segments stream through it: backward search computes their matching
statistics, and stretches of matches as long as a window are reported with
their earliest place. Every occurrence of a segment takes up the report and
gives up what it holds later than that place.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomspan.llm.common import in_small_batches, staged, unstaged

_BASE = np.uint64(0xD6E8FEB86659FD93)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
RUN = 5  # words of the short runs that make keys
MANY = 4096  # different segments of a key that one index takes; beyond, the key parts by window
SHARD_WORDS = 1 << 18  # words of an FM-index, but for a key that has more
CHUNK = 1 << 18  # bytes of text that are hashed at once, but for a longer word
WORD_BYTES = 6  # of a word's hash, kept in the index


def _mix(x: np.ndarray) -> np.ndarray:
    """Bijective scrambling of 64-bit words."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@lru_cache(maxsize=1)
def _kept_powers() -> tuple[np.ndarray, np.ndarray]:
    return _new_powers(CHUNK + 1)


def _new_powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    out = np.full((2, n), np.array([[_BASE], [_INVERSE]]))
    out[:, 0] = 1
    return tuple(np.multiply.accumulate(out, axis=1))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, up to n; those of long texts are not kept."""
    return _kept_powers() if n <= CHUNK else _new_powers(n + 1)


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words of all texts, and the number of words of each text."""
    data = np.frombuffer(b"\n".join([*texts, b""]), np.uint8)
    space = _SPACE[data]
    edges = np.flatnonzero(np.diff(np.concatenate(([1], space.view(np.int8), [1]))))
    starts, ends = edges[::2], edges[1::2]
    hashes = np.empty(len(starts), np.uint64)
    at = 0
    while at < len(starts):  # whole words of about CHUNK bytes in turn
        to = max(at + 1, int(np.searchsorted(ends, starts[at] + CHUNK, side="right")))
        first, last = starts[at], ends[to - 1]
        up, down = _powers(int(last - first))
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum((data[first:last].astype(np.uint64) + np.uint64(1)) * up[: last - first])))
        hashes[at:to] = _mix((sums[ends[at:to] - first] - sums[starts[at:to] - first]) * down[starts[at:to] - first] ^ (ends[at:to] - starts[at:to]).astype(np.uint64))
        at = to
    bounds = np.cumsum([len(t) + 1 for t in texts])
    counts = np.diff(np.concatenate(([0], np.searchsorted(starts, bounds))))
    return hashes, counts


def _runs(words: np.ndarray, n: int) -> np.ndarray:
    """Hash of every run of n words."""
    last = len(words) - n + 1
    if last <= 0:
        return np.empty(0, np.uint64)
    out = np.zeros(last, np.uint64)
    for i in range(n):
        out = out * _BASE + words[i : i + last]
    return _mix(out)


def _spans(words: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of each span of words."""
    up, down = _powers(len(words) + 1)
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(words * up[: len(words)])))
    return _mix((sums[ends] - sums[starts]) * down[starts] ^ (ends - starts).astype(np.uint64))


def segments(words: np.ndarray, counts: np.ndarray, window: int) -> tuple[np.ndarray, ...]:
    """Segments of consecutive windows whose key stands at one place.

    The windows of a segment all differ, since the key's first occurrence has
    another offset in each; a segment has window - RUN + 1 windows at most.
    Returns the text number, start word, number of windows, key and content
    hash of each.
    """
    none = np.empty(0, np.int64)
    if len(words) < window:
        return (none,) * 5
    keys = _runs(words, RUN)
    place = np.arange(len(keys))  # of the first run with the least hash
    need, have = window - RUN + 1, 1
    while have < need:
        step = min(have, need - have)
        left = keys[:-step] <= keys[step:]
        keys, place = np.where(left, keys[:-step], keys[step:]), np.where(left, place[:-step], place[step:])
        have += step
    firsts = np.cumsum(counts) - counts
    text = np.repeat(np.arange(len(counts)), np.maximum(counts - window + 1, 0))
    at = np.concatenate([np.arange(f, f + c - window + 1) for f, c in zip(firsts, counts) if c >= window] or [none])
    if not len(at):
        return (none,) * 5
    keys, place = keys[at], place[at]
    starts = np.flatnonzero(np.concatenate(([True], (place[1:] != place[:-1]) | (text[1:] != text[:-1]))))
    sizes = np.diff(np.concatenate((starts, [len(at)])))
    content = _spans(words, at[starts], at[starts] + sizes + window - 1)
    return text[starts], at[starts] - firsts[text[starts]], sizes, keys[starts].view(np.int64), content.view(np.int64)


# A place is one long: 32 bits of start word and 7 bits of window count. It
# holds within its document, which is an id (doc) and the text's hash (bits).


def _text_bits(texts: list[bytes]) -> np.ndarray:
    return np.array([xxhash.xxh3_64_intdigest(t) for t in texts], np.uint64).view(np.int64)


def _small(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Slices of few rows with the bytes of their texts, null as empty."""
    for batch in in_small_batches(batches, 256):
        yield batch, [x or b"" for x in batch.column(column).cast(pa.binary()).to_pylist()]


def _documents(docs: DataFrame, id_col: str, text_col: str, keep: list[str] = ()) -> DataFrame:
    """(doc, text, kept as one struct); a null id stands before all others."""
    doc = F.coalesce(F.col(id_col).cast("long"), F.lit(-(1 << 63)).cast("long"))
    kept = F.struct(F.lit(0).alias("_none"), *[F.col(c) for c in keep])
    return docs.select(doc.alias("doc"), F.col(text_col).cast("string").alias("text"), kept.alias("kept"))


def _found_segments(docs: DataFrame, window: int) -> DataFrame:
    """(key, content, doc, bits, place) of all segments."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in _small(batches, 1):
            text, start, size, key, content = segments(*word_hashes(texts), window)
            if not len(text):
                continue
            doc = batch.column(0).to_numpy(zero_copy_only=False)
            place = (start << 7) | size
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (key, content, doc[text], _text_bits(texts)[text], place)], names=["key", "content", "doc", "bits", "place"])

    return docs.select("doc", "text").mapInArrow(run, "key long, content long, doc long, bits long, place long")


def _packed_texts(docs: DataFrame) -> DataFrame:
    """(doc, bits, packed, kept): rows with their text compressed for the shuffle."""
    kept = docs.schema["kept"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=3).compress
        for batch, texts in _small(batches, 1):
            bits = pa.array(_text_bits(texts))
            packed = pa.array([pack(t) for t in texts], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), bits, packed, batch.column(2)], names=["doc", "bits", "packed", "kept"])

    return docs.mapInArrow(run, f"doc long, bits long, packed binary, kept {kept}")


class WaveletTree:
    """Pointerless wavelet tree (levels as bit rows) over symbols below 2**levels."""

    def __init__(self, symbols: np.ndarray):
        self.levels = max(1, int(symbols.max()).bit_length()) if len(symbols) else 1
        self.bits, self.ranks, self.zeros = [], [], []
        for level in range(self.levels - 1, -1, -1):
            bit = (symbols >> level) & 1
            words = np.packbits(np.concatenate((bit, np.zeros(-len(bit) % 64 + 64, bit.dtype))).astype(np.uint8), bitorder="little").view("<u8")
            self.bits.append(words)
            self.ranks.append(np.concatenate(([0], np.cumsum(np.bitwise_count(words), dtype=np.int64))).astype(np.uint32))
            self.zeros.append(int(len(bit) - bit.sum()))
            symbols = np.concatenate((symbols[bit == 0], symbols[bit == 1]))

    def _ones(self, level: int, at: np.ndarray) -> np.ndarray:
        word = at >> 6
        below = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return self.ranks[level][word].astype(np.int64) + np.bitwise_count(self.bits[level][word] & below)

    def bottom(self, symbols: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Where position ``at`` ends up on the last level on the way of ``symbols``."""
        for level in range(self.levels):
            ones = self._ones(level, at)
            bit = (symbols >> (self.levels - 1 - level)) & 1
            at = np.where(bit == 1, self.zeros[level] + ones, at - ones)
        return at


class FMIndex:
    """Compressed index of segments of word codes for matches up to ``depth`` words.

    Symbols are ranks of words from 1; 0 separates segments. The text and its
    suffix array are not kept: beside the wavelet tree there is a byte a row,
    the words that it shares with the row before (up to ``depth``), and for each
    class of rows that share ``depth`` words the least of ``values``.
    """

    def __init__(self, text: np.ndarray, depth: int, values: np.ndarray | None = None):
        n = self.size = len(text)
        self.depth = depth
        rank, reach = text.astype(np.int64), 1
        while True:  # prefix doubling, as far as matches can reach
            after = np.concatenate((rank[reach:], np.full(min(reach, n), -1)))[:n]
            both = rank * (n + 2) + after + 1
            order = np.argsort(both, kind="stable")
            step = np.concatenate(([False], both[order][1:] != both[order][:-1]))
            fresh = np.empty(n, np.int64)
            fresh[order] = np.cumsum(step)
            rank, reach = fresh, 2 * reach
            if reach >= depth or rank[order[-1]] == n - 1:
                break
        # what agrees over the reach keeps its order of text; later words play no part
        self.common = np.zeros(n + 1, np.uint8)
        same, padded = np.ones(n - 1, bool), np.concatenate((text, np.full(depth, -1)))
        for i in range(depth):  # a separator equals no other
            here = padded[order + i]
            same = same & (here[1:] == here[:-1]) & (here[1:] > 0)
            self.common[1:n] += same
        self.counts = np.concatenate(([0], np.cumsum(np.bincount(text, minlength=int(text.max()) + 1))))
        self.tree = WaveletTree(text[order - 1])
        alphabet = np.arange(len(self.counts) - 1)
        self.starts = self.tree.bottom(alphabet, np.zeros(len(alphabet), np.int64))
        self.heads = np.flatnonzero(self.common[:n] < depth)  # first row of each class
        self.least = None if values is None else np.minimum.reduceat(values[order], self.heads)
        self._bounds: dict[int, np.ndarray] = {}

    def extend(self, symbols: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Intervals after one more word to the left."""
        base = self.counts[symbols] - self.starts[symbols]
        return base + self.tree.bottom(symbols, low), base + self.tree.bottom(symbols, high)

    def widen(self, low: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Intervals of all rows that share their first ``length`` words with row ``low``."""
        out = np.zeros(len(low), np.int64), np.full(len(low), self.size)
        for n in np.unique(length[length > 0]).tolist():
            if n not in self._bounds:
                self._bounds[n] = np.concatenate((np.flatnonzero(self.common[: self.size] < n), [self.size]))
            at = length == n
            place = np.searchsorted(self._bounds[n], low[at], side="right")
            out[0][at], out[1][at] = self._bounds[n][place - 1], self._bounds[n][place]
        return out

    def matching_statistics(self, codes: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each word of streams of given sizes: the longest match that starts there, up to ``depth``, and its first row.

        Streams go from right to left, all in step: a match grows by a word to
        the left, or is shortened to the next length at which more rows agree.
        Code 0 is a word that the index lacks.
        """
        lengths, rows = np.zeros(len(codes), np.int64), np.zeros(len(codes), np.int64)
        begin = np.cumsum(sizes) - sizes
        live = np.flatnonzero(sizes > 0)
        begin, at = begin[live], (begin + sizes - 1)[live]
        low, high, length = np.zeros(len(live), np.int64), np.full(len(live), self.size), np.zeros(len(live), np.int64)
        while len(at):
            symbol = codes[at]
            below, above = self.extend(symbol, low, high)
            grown = (above > below) & (symbol > 0)
            low, high, length = np.where(grown, below, low), np.where(grown, above, high), length + grown
            if (over := length > self.depth).any():
                length[over] = self.depth
                low[over], high[over] = self.widen(low[over], length[over])
            if (stuck := ~grown & (length > 0)).any():
                length[stuck] = np.maximum(self.common[low[stuck]], self.common[high[stuck]])
                low[stuck], high[stuck] = self.widen(low[stuck], length[stuck])
            known = ~stuck
            lengths[at[known]], rows[at[known]] = length[known], low[known]
            at = at - known
            more = at >= begin
            begin, at, low, high, length = begin[more], at[more], low[more], high[more], length[more]
        return lengths, rows


def reported_spans(words: list[np.ndarray], docs: np.ndarray, bits: np.ndarray, places: np.ndarray, window: int) -> tuple[np.ndarray, ...]:
    """Stretches of windows of each segment, and where they stand earliest: (segment, offset, size, of, start).

    ``of`` is the segment that holds the earliest occurrence of the
    stretch's first window and ``start`` that window's word in its document;
    the stretch's other windows follow there. Every window of every segment is
    in one stretch, if only in its own place.
    """
    sizes = np.array([len(w) for w in words])
    firsts = np.cumsum(sizes + 1) - sizes - 1
    codes = np.unique(np.concatenate(words), return_inverse=True)[1] + 1
    text = np.zeros(int((sizes + 1).sum()), np.int64)
    text[np.arange(len(codes)) + np.repeat(np.arange(len(words)), sizes)] = codes
    windows = sizes - window + 1
    segment = np.repeat(np.arange(len(words)), windows)
    offset = np.arange(len(segment)) - np.repeat(np.cumsum(windows) - windows, windows)
    start = (places >> 7)[segment] + offset
    order = np.lexsort((start, bits[segment], docs[segment]))
    time = np.full(len(text), np.iinfo(np.int64).max)
    time[(firsts[segment] + offset)[order]] = np.arange(len(order))
    index = FMIndex(text, window, time)
    lengths, rows = index.matching_statistics(codes, sizes)
    here = np.flatnonzero(lengths >= window)  # of the words as they stream: where a window starts
    found = order[index.least[np.searchsorted(index.heads, rows[here], side="right") - 1]]
    own = np.repeat(np.arange(len(words)), sizes)[here]
    at = here - (firsts - np.arange(len(words)))[own]
    fresh = np.ones(len(here), bool)
    fresh[1:] = (own[1:] != own[:-1]) | (segment[found[1:]] != segment[found[:-1]]) | (start[found[1:]] != start[found[:-1]] + 1)
    heads = np.flatnonzero(fresh)
    return own[heads], at[heads], np.diff(np.concatenate((heads, [len(here)]))), segment[found[heads]], start[found[heads]]


def _extracted(docs: DataFrame, wanted: DataFrame, window: int) -> DataFrame:
    """Fetch from the texts what the wanted segments (key, content, doc, bits, place, split) hold.

    Gives (key, content, doc, bits, place, split, words); of segments to split
    one row per window, with the window's hash as key and content.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor().decompress
        for batch in in_small_batches(batches, 64):
            out: list[tuple] = []
            for doc, bits, packed, rows in zip(*(c.to_pylist() for c in batch.columns)):
                hashes, _ = word_hashes([unpack(packed)])
                short = np.ascontiguousarray(hashes.view("<u2").reshape(-1, 4)[:, : WORD_BYTES // 2])
                for row in rows:
                    place = row["place"]
                    start, size = place >> 7, place & 127
                    if not row["split"]:
                        out.append((row["key"], row["content"], doc, bits, place, False, short[start : start + size + window - 1].tobytes()))
                        continue
                    starts = np.arange(size)
                    found = _spans(hashes[start : start + size + window - 1], starts, starts + window).view(np.int64).tolist()
                    out += [(h, h, doc, bits, ((start + i) << 7) | 1, True, short[start + i : start + i + window].tobytes()) for i, h in enumerate(found)]
                    if len(out) >= 1 << 14:
                        yield rows_of(out)
                        out = []
            if out:
                yield rows_of(out)

    def rows_of(out: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names=["key", "content", "doc", "bits", "place", "split", "words"])

    kinds = [pa.int64()] * 5 + [pa.bool_(), pa.binary()]
    lists = wanted.groupBy("doc", "bits").agg(F.collect_list(F.struct("key", "content", "place", "split")).alias("rows"))
    joined = _packed_texts(docs).join(lists, ["doc", "bits"]).select("doc", "bits", "packed", "rows")
    return joined.mapInArrow(run, "key long, content long, doc long, bits long, place long, split boolean, words binary")


def _indexed(contents: DataFrame, window: int) -> DataFrame:
    """(key, content, spans) of different segments (key, content, doc, bits, place, words), from one FM-index a shard.

    A task's segments, sorted by key, fill one index after the other; a key is
    never parted. ``spans`` are the segment's stretches (offset, size, doc, bits,
    start) with their earliest places.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, held = [], 0

        def closed() -> pa.RecordBatch:
            key, content, doc, bits, place = (np.array(x, np.int64) for x in list(zip(*rows))[:5])
            segment, offset, size, of, start = reported_spans([_wide(r[5]) for r in rows], doc, bits, place, window)
            spans = pa.StructArray.from_arrays([pa.array(x) for x in (offset, size, doc[of], bits[of], start)], names=["offset", "size", "doc", "bits", "start"])
            ends = pa.array(np.searchsorted(segment, np.arange(len(rows) + 1)).astype(np.int32))
            return pa.RecordBatch.from_arrays([pa.array(key), pa.array(content), pa.ListArray.from_arrays(ends, spans)], names=["key", "content", "spans"])

        for batch in in_small_batches(batches, 4096):
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if held >= SHARD_WORDS and row[0] != rows[-1][0]:
                    yield closed()
                    rows, held = [], 0
                rows.append(row)
                held += len(row[5]) // WORD_BYTES
        if rows:
            yield closed()

    ordered = contents.select("key", "content", "doc", "bits", "place", "words").repartition("key").sortWithinPartitions("key", "doc", "bits", "place")
    return ordered.mapInArrow(run, "key long, content long, spans array<struct<offset: long, size: long, doc: long, bits: long, start: long>>")


def _wide(words: bytes) -> np.ndarray:
    """Word hashes from their kept bytes."""
    out = np.zeros((len(words) // WORD_BYTES, 4), "<u2")
    out[:, : WORD_BYTES // 2] = np.frombuffer(words, "<u2").reshape(-1, WORD_BYTES // 2)
    return out.view("<u8").ravel()


def repeated_places(docs: DataFrame, window: int = 20) -> DataFrame:
    """(doc, bits, place) of segments all of whose windows occur earlier. ``docs``: (doc, text).

    Keys, contents and words are compared by hash: 64 bits of a run, 64 of a
    segment, 48 of each of a window's words.
    """
    found = _found_segments(docs, window)
    shared = staged(found.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key"))
    occurrences = staged(found.join(shared, "key"))
    contents = staged(occurrences.groupBy("key", "content").agg(F.min(F.struct("doc", "bits", "place")).alias("first")))
    crowded = staged(contents.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > MANY).select("key"))
    firsts = contents.join(crowded, "key", "left_anti").select("key", "content", "first.*", F.lit(False).alias("split"))
    to_part = occurrences.join(crowded, "key", "left_semi").select("key", "content", "doc", "bits", "place", F.lit(True))
    fetched = staged(_extracted(docs, firsts.union(to_part), window))
    once = fetched.where("split").groupBy("key", "content").agg(F.min(F.struct("doc", "bits", "place", "words")).alias("first")).select("key", "content", "first.*")
    spans = _indexed(fetched.where("NOT split").drop("split").union(once), window)
    whole = occurrences.join(crowded, "key", "left_anti").select("key", "content", "doc", "bits", "place")
    every = whole.union(fetched.where("split").select("key", "content", "doc", "bits", "place"))
    reported = every.join(spans, ["key", "content"]).select("doc", "bits", F.shiftright("place", 7).alias("start"), F.explode("spans").alias("x"))
    own = F.col("start") + F.col("x.offset")
    later = F.struct("x.doc", "x.bits", "x.start") < F.struct("doc", "bits", own.alias("start"))
    out = staged(reported.where(later).select("doc", "bits", F.shiftleft(own, 7).bitwiseOR(F.col("x.size")).alias("place")))
    unstaged(shared, occurrences, contents, crowded, fetched)
    return out


def dedup_substrings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 20, keep: list[str] = ()) -> DataFrame:
    """(id, n_words, n_removed, kept_sha256, text) per row, with the ``keep`` columns.

    A word goes if a window of ``window`` words that covers it also starts
    earlier: in a row of smaller id (null ids first; rows of one id by hash of
    the text) or further up in its text. Windows are judged on the input. Rows
    that repeat id and text are one document and get one verdict each. Null
    and empty texts have no words. ``text`` is the input where nothing is
    removed, else the kept words and what stands around them, cut at the gaps.
    ``kept_sha256`` digests the kept words joined by single spaces.
    """
    if not RUN < window < 128:
        raise ValueError(f"a window has more than {RUN} and less than 128 words")
    source = _documents(docs, id_col, text_col, keep)
    places = repeated_places(source, window)
    lists = places.groupBy("doc", "bits").agg(F.collect_list("place").alias("places"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor().decompress
        for batch in in_small_batches(batches, 256):
            out = []
            for doc, packed, places in zip(*(c.to_pylist() for c in batch.columns[:3])):
                text = unpack(packed)
                out.append((None if doc == -(1 << 63) else doc, *cut(text, places or [], window)))
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            arrays = [*(pa.array(c, t) for c, t in zip(zip(*out), kinds)), batch.column(3)]
            yield pa.RecordBatch.from_arrays(arrays, names=["id", "n_words", "n_removed", "kept_sha256", "text", "kept"])

    joined = _packed_texts(source).join(lists, ["doc", "bits"], "left").select("doc", "packed", "places", "kept")
    kept = source.schema["kept"].dataType.simpleString()
    done = joined.mapInArrow(run, f"id long, n_words long, n_removed long, kept_sha256 string, text string, kept {kept}")
    return done.select("id", "n_words", "n_removed", "kept_sha256", "text", *[f"kept.{c}" for c in keep])


def cut(text: bytes, places: list[int], window: int) -> tuple[int, int, str, str]:
    """Words, removed words, digest of the kept words and the text that is left."""
    words = text.split()
    if not places:
        return len(words), 0, hashlib.sha256(b" ".join(words)).hexdigest(), text.decode()
    at = np.array(places)
    edges = np.zeros(len(words) + 1, np.int64)
    np.add.at(edges, at >> 7, 1)
    np.add.at(edges, (at >> 7) + (at & 127) + window - 1, -1)
    gone = np.cumsum(edges)[:-1] > 0
    kept = [w for w, g in zip(words, gone.tolist()) if not g]
    bounds = np.flatnonzero(np.diff(np.concatenate(([0], _SPACE[np.frombuffer(text, np.uint8)] ^ True, [0])).astype(np.int8)))
    starts, ends = bounds[::2], bounds[1::2]
    runs = np.flatnonzero(np.diff(np.concatenate(([0], gone.view(np.int8), [0]))))
    parts, before = [], 0
    for a, b in zip(runs[::2].tolist(), runs[1::2].tolist()):  # a removed run goes with the space before it
        parts.append(text[before : ends[a - 1] if a else starts[0]])
        before = int(ends[b - 1])
    parts.append(text[before:])
    return len(words), int(gone.sum()), hashlib.sha256(b" ".join(kept)).hexdigest(), b"".join(parts).decode()


def op3_substring_dedup(spark, sf_dir: str) -> DataFrame:
    found = dedup_substrings(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select(F.col("id").alias("doc_id"), "n_words", "n_removed", "kept_sha256")


OP3_SQL = r"""
WITH w AS (
  SELECT doc_id, unnest(regexp_extract_all(coalesce(text, ''), '[^ 	-
]+')) AS word, generate_subscripts(regexp_extract_all(coalesce(text, ''), '[^ 	-
]+'), 1) AS pos
  FROM documents
), win AS (
  SELECT doc_id, pos, word, list(word) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND 19 FOLLOWING) AS seq FROM w
), full_win AS (
  SELECT doc_id, pos, md5(array_to_string(seq, ' ')) AS seq FROM win WHERE len(seq) = 20
), repeats AS (
  SELECT doc_id, pos FROM (SELECT *, row_number() OVER (PARTITION BY seq ORDER BY doc_id, pos) AS n FROM full_win) WHERE n > 1
), marked AS (
  SELECT w.doc_id, w.pos, w.word,
    max(CASE WHEN r.pos IS NULL THEN 0 ELSE 1 END) OVER (PARTITION BY w.doc_id ORDER BY w.pos ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS gone
  FROM w LEFT JOIN repeats r ON r.doc_id = w.doc_id AND r.pos = w.pos
), summed AS (
  SELECT doc_id, count(*) AS n_words, CAST(sum(gone) AS BIGINT) AS n_removed,
    sha256(coalesce(string_agg(CASE WHEN gone = 0 THEN word END, ' ' ORDER BY pos), '')) AS kept_sha256
  FROM marked GROUP BY doc_id
)
SELECT d.doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed, coalesce(kept_sha256, sha256('')) AS kept_sha256
FROM documents d LEFT JOIN summed USING (doc_id)
"""