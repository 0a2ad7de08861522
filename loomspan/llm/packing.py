"""Sequence packing by first-fit decreasing over a tournament tree of bins.

Documents are tokenised where they are read and cut into full sequences plus at
most one remainder. A full piece is a sequence of its own and moves no further.
The documents' remainders are dealt to randomised groups of bounded size, and
each group is packed on its own: pieces in decreasing length, each into the
first open bin with room, found in O(log n) by walking a tournament tree that
keeps the largest free capacity below every node.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomspan.llm.common import byte_letters, in_small_batches, staged, texts_of

SEQUENCE = 2048
END_ID = 1
#: Documents to expect in a group.
GROUP_DOCS = 4096

# Texts of these characters only are lower-cased and split here exactly as the
# tokenizer's normalizer and pre-tokenizer would; all others go to the library whole.
_OTHER = re.compile("[^\t\n\x0b\x0c\r -~À-ÖØ-öø-ÿ]")
_WORDS = re.compile(r"[a-zß-öø-ÿ]+|'(?:s|t|re|ve|m|ll|d)|[0-9]|[^\sa-z0-9ß-öø-ÿ]+")


class WordTokenizer:
    """Token ids of texts; the ids of a word are looked up once and kept.

    The memo is emptied at ``memo_words`` entries, so memory stays bounded.
    """

    def __init__(self, path: str, memo_words: int = 262_144):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.special = sorted(t.content for t in self.library.get_added_tokens_decoder().values())
        self.letters = byte_letters()
        self.memo: dict[str, bytes] = {}
        self.memo_words = memo_words

    def __call__(self, text: str) -> bytes:
        """Little-endian unsigned 32-bit ids, as ``encode(text)`` gives them."""
        if _OTHER.search(text) or any(x in text for x in self.special):
            return _packed(self.library.encode(text, add_special_tokens=False).ids)
        words = _WORDS.findall(text.lower())
        memo = self.memo
        new = set(words).difference(memo)
        if new:
            if len(memo) + len(new) > self.memo_words:
                memo.clear()
                new = set(words)
            tokenize = self.library.model.tokenize
            for word in new:  # the pre-tokenizer's last step writes bytes as letters
                memo[word] = _packed([x.id for x in tokenize(word if word.isascii() else "".join([self.letters[b] for b in word.encode()]))])
        return b"".join(map(memo.__getitem__, words))


def _packed(ids: list[int]) -> bytes:
    return b"".join(i.to_bytes(4, "little") for i in ids)


@lru_cache(maxsize=2)
def _tokenizer(path: str) -> WordTokenizer:
    return WordTokenizer(path)


def tokenized_pieces(
    docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", sequence: int = SEQUENCE, end_id: int = END_ID, keep_ids: bool = False
) -> DataFrame:
    """Cut every document's ids, with ``end_id`` appended, at multiples of ``sequence``.

    Returns (row, id, start, length, ids_crc32, doc_tokens) per piece, and the ids
    as little-endian 32-bit binary in ``ids`` if ``keep_ids``. ``row`` numbers
    documents by partition and place, the same in a rerun. Null and empty texts
    give one piece that holds ``end_id`` alone.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end = _tokenizer(tokenizer_path), end_id.to_bytes(4, "little")
        row = (TaskContext.get().partitionId() << 40) - 1
        for batch in in_small_batches(batches, 256):
            out: list[tuple] = []
            for doc, text in zip(batch.column(0).to_pylist(), texts_of(batch.column(1))):
                ids, row = encode(text) + end, row + 1
                total = len(ids) // 4
                for start in range(0, total, sequence):
                    piece = ids[4 * start : 4 * (start + sequence)]
                    out.append((row, doc, start, len(piece) // 4, zlib.crc32(piece), total, piece)[: 7 if keep_ids else 6])
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names=names)

    names = ["row", "id", "start", "length", "ids_crc32", "doc_tokens", "ids"][: 7 if keep_ids else 6]
    kinds = [pa.int64()] * 6 + [pa.binary()]
    schema = ", ".join(f"{n} {'binary' if n == 'ids' else 'long'}" for n in names)
    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return source.mapInArrow(run, schema)


class Bins:
    """Open bins in order of opening, over a tournament tree of free capacity."""

    def __init__(self, most: int, capacity: int):
        self.leaves = 1
        while self.leaves < max(1, most):
            self.leaves *= 2
        self.free = [capacity] * (2 * self.leaves)

    def put(self, size: int) -> int:
        """Index of the first bin with room for ``size``, which it then takes."""
        free, at = self.free, 1
        while at < self.leaves:
            at *= 2
            if free[at] < size:
                at += 1
        found = at - self.leaves
        free[at] -= size
        while at > 1:
            at //= 2
            best = max(free[2 * at], free[2 * at + 1])
            if free[at] == best:
                break
            free[at] = best
        return found


def first_fit_decreasing(sizes: list[int], capacity: int) -> list[tuple[int, int]]:
    """(bin, offset) of every size, in the given order. Ties keep that order."""
    bins, placed = Bins(len(sizes), capacity), [(0, 0)] * len(sizes)
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        found = bins.put(sizes[i])
        placed[i] = found, capacity - bins.free[bins.leaves + found] - sizes[i]
    return placed


def pack_pieces(pieces: DataFrame, groups: int, sequence: int = SEQUENCE, seed: int = 0) -> DataFrame:
    """Add (sequence_id, offset) to pieces shorter than ``sequence`` tokens.

    Groups are drawn by hash of id, start, content and ``row``, so that equal
    rows part too; a rerun on the same table agrees.
    ``sequence_id`` is unique over all groups and not negative; offsets are
    gapless from 0. Repeated rows are packed as often as they occur.
    """

    def run(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["length", "id", "start", "ids_crc32", "row"], ascending=[False, True, True, True, True], kind="stable")
        placed = first_fit_decreasing(group["length"].tolist(), sequence)
        group["sequence_id"] = [key[0] * (1 << 32) + b for b, _ in placed]
        group["offset"] = [o for _, o in placed]
        return group

    dealt = pieces.withColumn("pack_group", F.pmod(F.xxhash64(F.lit(seed), "id", "start", "ids_crc32", "row"), F.lit(groups)))
    fields = [f"{f.name} {f.dataType.simpleString()}" for f in pieces.schema.fields]
    packed = dealt.groupBy("pack_group").applyInPandas(run, ", ".join([*fields, "pack_group long", "sequence_id long", "offset long"]))
    return packed.drop("pack_group")


def pack_documents(docs: DataFrame, tokenizer_path: str | None = None, id_col: str = "doc_id", text_col: str = "text", sequence: int = SEQUENCE, keep_ids: bool = False) -> DataFrame:
    """Pack whole documents into sequences; one row per piece.

    A document has at most one piece that is not full, so a group of pieces is
    a group of documents, about GROUP_DOCS of them however long they are. Full
    pieces have negative sequence ids, numbered by partition and place in a
    staged table; ``row`` tells the pieces of a repeated row apart. An empty table gives an empty result; a null text packs as an
    empty one; repeated rows are packed as often as they occur.
    """
    import public_tokenizers

    pieces = staged(tokenized_pieces(docs, tokenizer_path or public_tokenizers.path("word_bpe_49k.json"), id_col, text_col, sequence, keep_ids=keep_ids))
    full, parts = pieces.where(F.col("length") == sequence), pieces.where(F.col("length") < sequence)
    whole = full.withColumns({"sequence_id": -1 - F.monotonically_increasing_id(), "offset": F.lit(0).cast("long")})
    return whole.unionByName(pack_pieces(parts, max(1, -(-parts.count() // GROUP_DOCS)), sequence))


def op2_packing(spark, sf_dir: str) -> DataFrame:
    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet")).withColumnRenamed("id", "doc_id")
