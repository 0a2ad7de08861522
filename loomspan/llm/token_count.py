"""Token counts from distinct pre-tokens.

A document becomes its pre-token frequencies. The pieces of a pre-token are
counted once: for the most frequent ones, taken from a bounded sample, in a
small broadcast table; for all others in a distinct table that the remaining
frequencies join. Ids are never kept.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomspan.llm.common import byte_letters, in_small_batches, staged, texts_of

#: Documents to expect in the sample that the broadcast table comes from, its most entries and bytes of text.
SAMPLE_DOCS, HEAD_ENTRIES, HEAD_BYTES = 12_288, 400_000, 1 << 24

# Texts of these characters only are split by the expression below just as the
# library does; all others go through the library's own pre-tokenizer.
_OTHER = re.compile("[^\t\n\x0b\x0c\r -~À-ÖØ-öø-ÿ]")
_SPLIT = re.compile(r" ?[A-Za-zÀ-ÖØ-öø-ÿ]+| ?[0-9]+|'(?:s|t|re|ve|m|ll|d)| ?[^\sA-Za-z0-9À-ÖØ-öø-ÿ]+|\s+(?!\S)|\s+")


class PreTokens:
    """Splits texts into pre-tokens and counts a pre-token's pieces."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.special = re.compile("|".join(map(re.escape, sorted(special, key=len, reverse=True))) or "(?!)")
        self.letters = byte_letters()
        self.bytes = {x: b for b, x in enumerate(self.letters)}

    def split(self, text: str) -> tuple[list[str], int]:
        """Pre-tokens, and how many special strings stood between them."""
        parts, out = self.special.split(text), []
        for part in parts:
            if not _OTHER.search(part):
                out += _SPLIT.findall(part)
            else:
                out += [bytes(map(self.bytes.__getitem__, x)).decode() for x, _ in self.library.pre_tokenizer.pre_tokenize_str(part)]
        return out, len(parts) - 1

    def pieces(self, tokens: list[str]) -> list[int]:
        tokenize, letters = self.library.model.tokenize, self.letters
        return [len(tokenize("".join([letters[b] for b in x.encode()]))) for x in tokens]


@lru_cache(maxsize=2)
def _pre_tokens(path: str) -> PreTokens:
    return PreTokens(path)


def _piece_counts(distinct: DataFrame, path: str) -> DataFrame:
    """(token, pieces) of a column of distinct pre-tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = _pre_tokens(path)
        for batch in in_small_batches(batches, 8192):
            counts = own.pieces(batch.column(0).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64())], names=["token", "pieces"])

    return distinct.mapInArrow(run, "token string, pieces long")


def _frequencies(docs: DataFrame, path: str, known: dict[str, int]) -> DataFrame:
    """What documents hold, in rows of two kinds.

    One per document (token null): id, n_bytes and the sum over known
    pre-tokens. One per other pre-token of it: token and its frequency n.
    ``row`` numbers documents by partition and place, the same in a rerun.
    """
    shared = docs.sparkSession.sparkContext.broadcast(known)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, head = _pre_tokens(path), shared.value
        row = TaskContext.get().partitionId() << 40
        for batch in in_small_batches(batches, 256):
            docs, rare = [], []
            for doc, text in zip(batch.column(0).to_pylist(), texts_of(batch.column(1))):
                row += 1
                found, total = own.split(text)
                for token, n in Counter(found).items():
                    if (pieces := head.get(token)) is not None:
                        total += n * pieces
                    else:
                        rare.append((row, None, None, None, token, n))
                docs.append((row, doc, len(text.encode()), total, None, None))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*docs, *rare), kinds)], names=names)

    names = ["row", "id", "n_bytes", "known", "token", "n"]
    kinds = [pa.int64()] * 4 + [pa.string(), pa.int64()]
    return docs.mapInArrow(run, "row long, id long, n_bytes long, known long, token string, n long")


def head_pieces(docs: DataFrame, path: str, sample_docs: int = SAMPLE_DOCS, entries: int = HEAD_ENTRIES) -> dict[str, int]:
    """Piece counts of the most frequent pre-tokens of a bounded sample, however long, HEAD_BYTES of them at most.

    Its content never changes a result: a pre-token that it lacks is counted
    in the distinct table.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = _pre_tokens(path)
        for batch in in_small_batches(batches, 256):
            found = Counter()
            for text in texts_of(batch.column(0)):
                found.update(own.split(text)[0])
            yield pa.RecordBatch.from_arrays([pa.array(found.keys(), pa.string()), pa.array(found.values(), pa.int64())], names=["token", "n"])

    share = min(1.0, sample_docs / max(1, docs.count()))
    sample = docs.select("text").sample(share, seed=0).mapInArrow(run, "token string, n long")
    top = sample.groupBy("token").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "token").limit(entries)
    sizes = F.sum(F.octet_length("token").cast("long")).over(Window.orderBy(F.desc("n"), "token"))  # at most ``entries`` rows
    top = top.withColumn("size", sizes).where(F.col("size") <= HEAD_BYTES)
    return {r.token: r.pieces for r in _piece_counts(top.select("token"), path).collect()}


def count_tokens(docs: DataFrame, tokenizer_path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, n_tokens) per row, as the tokenizer's plain encoding gives them.

    Null and empty texts count 0. Repeated rows are returned as often as they
    occur. An empty table gives an empty result.
    """
    import public_tokenizers

    path = tokenizer_path or public_tokenizers.path("byte_bpe_50k.json")
    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    counts = staged(_frequencies(source, path, head_pieces(source, path)))
    rare = counts.where("token IS NOT NULL").select("row", "token", "n")
    pieces = _piece_counts(rare.select("token").distinct(), path)
    sums = rare.join(pieces, "token").groupBy("row").agg(F.sum(F.col("n") * F.col("pieces")).alias("rest"))
    known = counts.where("token IS NULL").select("row", "id", "n_bytes", "known")
    return known.join(sums, "row", "left").select("id", "n_bytes", (F.col("known") + F.coalesce("rest", F.lit(0))).alias("n_tokens"))


def op9_token_counts(spark, sf_dir: str) -> DataFrame:
    counted = count_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return counted.select(F.col("id").alias("doc_id"), "n_bytes", "n_tokens", (F.col("n_tokens") > 1024).alias("over_limit"))
