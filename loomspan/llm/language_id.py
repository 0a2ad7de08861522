"""Language identification with language-bitmask n-gram filters.

Every language has a Bloom filter over its typical character n-grams. The
filters share size and hash functions and are stored bit-sliced: slot j holds
one bit per language, so the conjunction of an n-gram's slots is the set of all
languages that contain it. A text's n-grams are looked up together; hits per
language, corrected for the filters' false positives and for how much of a
language its filter covers, decide.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomspan.llm.common import held_out, in_small_batches, staged, texts_of

ORDERS = (2, 3, 4)
#: Most training documents and n-grams per language.
SAMPLE_DOCS, GRAMS = 2000, 20_000
#: Most picked texts, of 16 bytes and a language's name each, that are broadcast; more are joined by a shuffle.
BROADCAST_PICKS = 500_000
_MIX = np.uint64(0x9E3779B97F4A7C15)


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


def _grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the n-grams of all texts, and the number of the text of each.

    Lower-cased; anything but a letter is a word boundary, and n-grams do not
    reach over one.
    """
    codes = np.frombuffer("\n".join(["", *texts, ""]).lower().encode("utf-32-le", "surrogatepass"), "<u4")
    lengths = np.array([len(x.lower()) + 1 for x in texts], np.int64)
    letter = _letters()[codes]
    codes = np.where(letter, codes, 0).astype(np.uint64)
    owner = np.repeat(np.arange(len(texts)), lengths)
    hashes, owners = [], []
    for n in ORDERS:
        last = max(0, len(codes) - n + 1)
        inner = np.ones(last, bool)
        for i in range(1, n - 1):
            inner &= letter[i : i + last]
        if n == 2:
            inner &= letter[:last] | letter[1 : 1 + last]
        at = np.flatnonzero(inner)
        h = np.full(len(at), n, np.uint64)
        for i in range(n):
            h = (h ^ codes[at + i]) * _MIX
            h ^= h >> np.uint64(29)
        hashes.append(h)
        owners.append(owner[np.clip(at, 0, len(owner) - 1)] if len(owner) else at)
    return np.concatenate(hashes), np.concatenate(owners)


class LanguageFilter:
    """Bit-sliced Bloom filters; a slot has as many words as its languages need."""

    def __init__(self, languages: list[str], grams: list[np.ndarray], covers: list[float]):
        self.languages, self.covers = languages, np.array(covers)
        most = max([len(g) for g in grams], default=1)
        self.bits = max(12, int(np.ceil(np.log2(16 * max(1, most)))))
        kind = next(t for t, n in ((np.uint8, 8), (np.uint16, 16), (np.uint32, 32), (np.uint64, 1 << 30)) if len(languages) <= n)
        self.width = 8 * np.dtype(kind).itemsize
        self.slots = np.zeros((max(1, -(-len(languages) // self.width)), 1 << self.bits), kind)
        for i, g in enumerate(grams):
            for at in self._places(g.view(np.uint64)):
                np.bitwise_or.at(self.slots[i // self.width], at, kind(1 << i % self.width))
        self.false_rate = np.array([np.mean(self._bit(self.slots, i)) for i in range(len(languages))]) ** 2

    def _bit(self, masks: np.ndarray, language: int) -> np.ndarray:
        kind = masks.dtype.type
        return (masks[language // self.width] >> kind(language % self.width)) & kind(1)

    def _places(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Slots of each n-gram under the two hash functions: its top and its low bits."""
        return (hashes >> np.uint64(64 - self.bits)).astype(np.int64), (hashes & np.uint64((1 << self.bits) - 1)).astype(np.int64)

    def languages_of(self, hashes: np.ndarray) -> np.ndarray:
        """Bitmasks, one row a word of languages, of those that contain each n-gram."""
        first, second = self._places(hashes)
        return self.slots[:, first] & self.slots[:, second]

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        """Language and score of each text; ``und`` and 0 where no letter is."""
        hashes, owners = _grams(texts)
        totals = np.bincount(owners, minlength=len(texts)).astype(float)
        if not self.languages:
            return ["und"] * len(texts), np.zeros(len(texts))
        masks = self.languages_of(hashes)
        rates = np.zeros((len(texts), len(self.languages)))
        for i in range(len(self.languages)):
            hit = owners[self._bit(masks, i) == 1]
            hits = np.bincount(hit, minlength=len(texts))
            wrong = self.false_rate[i]
            rates[:, i] = np.maximum(hits - wrong * totals, 0) / (1 - min(wrong, 0.999)) / max(self.covers[i], 1e-9)
        best = rates.argmax(axis=1)
        sums = rates.sum(axis=1)
        scores = np.divide(rates.max(axis=1), sums, out=np.full(len(texts), 1.0 / len(self.languages)), where=sums > 0)
        scores[totals == 0] = 0
        return [self.languages[b] if n else "und" for b, n in zip(best.tolist(), totals.tolist())], scores


def train(labelled: DataFrame, sample_docs: int = SAMPLE_DOCS, grams: int = GRAMS) -> LanguageFilter:
    """Learn filters from (text, lang) rows; null languages are left out.

    At most ``sample_docs`` different texts a language are learned from, chosen
    by hash, each once however many copies it has, and at most ``grams``
    n-grams a language kept. An n-gram belongs to a language if its share
    there is at least a third of its largest share anywhere.
    """
    rows = labelled.where("lang IS NOT NULL AND text IS NOT NULL").select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text")).withColumn("pick", F.xxhash64("text"))
    picks = staged(rows.select("lang", "pick").distinct())
    # a common language is thinned by hash before its picks meet for their ranks; two times what is wanted leaves too few in no real case
    share = F.ceil(float((2 * sample_docs + 100) << 20) / F.col("n"))
    sizes = staged(picks.groupBy("lang").agg(F.count("*").alias("n")))
    if sizes.count() <= BROADCAST_PICKS:  # so that thinning comes before any shuffle by language
        sizes = F.broadcast(sizes)
    thin = picks.join(sizes, "lang").where(F.pmod("pick", F.lit(1 << 20)) < share)
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("pick"))
    picks = staged(thin.withColumn("rank", rank).where(F.col("rank") <= sample_docs).select("lang", "pick"))
    if picks.count() <= BROADCAST_PICKS:
        picks = F.broadcast(picks)
    sample = rows.join(picks, ["lang", "pick"]).groupBy("lang", "pick").agg(F.min("text").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_small_batches(batches, 256):
            langs = np.array(batch.column(0).to_pylist(), dtype=object)
            texts = texts_of(batch.column(1))
            for lang in sorted(set(langs)):
                hashes, counts = np.unique(_grams([t for t, x in zip(texts, langs) if x == lang])[0], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(hashes), pa.string()), pa.array(hashes.view(np.int64)), pa.array(counts)], names=["lang", "gram", "n"])

    counted = sample.select("lang", "text").mapInArrow(run, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    share = counted.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("lang")))
    typical = share.withColumn("most", F.max("share").over(Window.partitionBy("gram"))).where("3 * share >= most")
    top = typical.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))).where(F.col("rank") <= grams)
    kept = top.groupBy("lang").agg(F.collect_list("gram").alias("grams"), F.sum("share").alias("cover")).orderBy("lang").collect()
    return LanguageFilter([r.lang for r in kept], [np.array(r.grams, np.int64) for r in kept], [r.cover for r in kept])


def identify(docs: DataFrame, model: LanguageFilter, text_col: str = "text", keep: list[str] = ("doc_id",)) -> DataFrame:
    """``keep`` columns with (lang_pred, score) for every row.

    ``und`` with score 0 for null texts and texts without a letter; ties go to
    the language that sorts first.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    source = docs.select(F.col(text_col).cast("string").alias("text"), *keep)
    fields = [f for f in source.schema.fields[1:]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_small_batches(batches, 256):
            langs, scores = shared.value.predict(texts_of(batch.column(0)))
            arrays = [*batch.columns[1:], pa.array(langs, pa.string()), pa.array(scores)]
            yield pa.RecordBatch.from_arrays(arrays, names=[*batch.schema.names[1:], "lang_pred", "score"])

    schema = ", ".join([*(f"{f.name} {f.dataType.simpleString()}" for f in fields), "lang_pred string, score double"])
    return source.mapInArrow(run, schema)


def op6_language_id(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").withColumn("held_out", held_out("doc_id"))
    model = train(docs.where("NOT held_out").select("text", "lang"))
    return identify(docs, model, keep=["doc_id", "held_out"])
