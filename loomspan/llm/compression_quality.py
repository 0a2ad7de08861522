"""Quality by compression: how much better do good texts' patterns shorten a text than bad texts' do?

One zstandard dictionary is built from pieces of texts labelled good, one from
pieces of texts labelled bad. A text is compressed whole with either; the
difference of the two sizes, normalised by the sizes and by the text, becomes a
score by a logistic calibration that is fitted on labelled rows whose texts the
dictionaries have not seen.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomspan.llm.common import held_out, in_small_batches, staged, table, texts_of, unstaged

#: Most labelled rows that are read to learn.
SAMPLE_ROWS = 16_384
#: Bytes of a dictionary, of a piece of text it is built from, and most pieces a label.
DICTIONARY_BYTES, PIECE_BYTES, PIECES = 65_536, 1024, 3000
LEVEL = 3


def built_dictionary(pieces: list[bytes]) -> bytes:
    """Dictionary of what the pieces share; of too few pieces for that, the pieces themselves."""
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, pieces, level=LEVEL).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b"\n".join(pieces)[-DICTIONARY_BYTES:]


def _compressor(dictionary: bytes) -> zstandard.ZstdCompressor:
    """Compressor whose frames hold nothing but the text."""
    held = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
    if held is not None:
        held.precompute_compress(level=LEVEL)
    return zstandard.ZstdCompressor(level=LEVEL, dict_data=held, write_content_size=False, write_checksum=False, write_dict_id=False)


def features(good: np.ndarray, bad: np.ndarray, size: np.ndarray) -> np.ndarray:
    """What the calibration sees of compressed sizes: the difference over both sizes and over the text's
    bytes, and, as a difference means less in a text that hardly shrinks, the rate and the length."""
    whole = np.maximum(size, 1)
    return np.column_stack([(bad - good) / (good + bad), (bad - good) / whole, good / whole, np.log(whole)])


@dataclass
class Calibration:
    """Logistic regression on standardised features."""

    middle: np.ndarray
    spread: np.ndarray
    weights: np.ndarray  # the last is the intercept

    def scores(self, x: np.ndarray) -> np.ndarray:
        z = (x - self.middle) / self.spread @ self.weights[:-1] + self.weights[-1]
        return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def fit_calibration(x: np.ndarray, labels: np.ndarray, ridge: float = 1e-2) -> Calibration:
    """Newton steps; without rows of both labels every score is the share of label 1, or one half without rows."""
    if len(set(labels.tolist())) < 2:
        share = float(np.clip(labels.mean(), 0.01, 0.99)) if len(labels) else 0.5
        none = np.zeros(x.shape[1])
        return Calibration(none, none + 1, np.append(none, np.log(share / (1 - share))))
    middle, spread = x.mean(axis=0), x.std(axis=0) + 1e-9
    a = np.column_stack([(x - middle) / spread, np.ones(len(x))])
    w = np.zeros(a.shape[1])
    penalty = np.array([ridge] * x.shape[1] + [1e-9])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        step = np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + np.diag(penalty + 1e-9), a.T @ (p - labels) + penalty * w)
        w -= step * min(1.0, 5.0 / max(1e-9, np.abs(step).max()))
        if np.abs(step).max() < 1e-8:
            break
    return Calibration(middle, spread, w)


@dataclass
class QualityModel:
    good: bytes
    bad: bytes
    calibration: Calibration | None = None


def _sized(docs: DataFrame, model: QualityModel, keep: list[str]) -> DataFrame:
    """``keep`` columns with n_bytes, good_bytes and bad_bytes, and the score if the model is calibrated."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    source = docs.select(F.col("text").cast("string").alias("scored_text"), *keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        good, bad = _compressor(own.good), _compressor(own.bad)
        for batch in in_small_batches(batches):
            texts = [t.encode() for t in texts_of(batch.column(0))]
            sizes = [np.array([len(f(t)) for t in texts], np.int64) for f in (len_of, good.compress, bad.compress)]
            columns = [*batch.columns[1:], *map(pa.array, sizes)]
            if own.calibration is not None:
                columns.append(pa.array(own.calibration.scores(features(sizes[1], sizes[2], sizes[0]))))
            yield pa.RecordBatch.from_arrays(columns, names=names)

    def len_of(text: bytes) -> bytes:
        return text

    fields = [f"{f.name} {f.dataType.simpleString()}" for f in source.schema.fields[1:]]
    fields += ["n_bytes long", "good_bytes long", "bad_bytes long"] + (["score double"] if model.calibration is not None else [])
    names = [f.split(" ")[0] for f in fields]
    return source.mapInArrow(run, ", ".join(fields))


def _pieces(sample: DataFrame, quality: int) -> list[bytes]:
    """At most PIECES pieces of the sample's texts of one label, chosen by hash over whole texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_small_batches(batches):
            texts = [t.encode() for t in texts_of(batch.column(0))]
            found = [t[i : i + PIECE_BYTES] for t in texts for i in range(0, len(t), PIECE_BYTES)]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.binary())], names=["piece"])

    pieces = sample.where(F.col("quality") == quality).select("text").mapInArrow(run, "piece binary")
    return [bytes(r.piece) for r in pieces.distinct().orderBy(F.xxhash64("piece"), "piece").limit(PIECES).collect()]


def train(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> QualityModel:
    """Learn from the rows of ``docs`` (doc_id, text) that ``labels`` marks quality 0 or 1.

    At most ``sample_rows`` rows are learned from, chosen by hash of the id, one
    of each id (the least text); of several labels of an id the greatest
    counts. One half of the texts, by hash so that copies stay together, makes
    the dictionaries, the other the calibration. A label without pieces has an
    empty dictionary; without rows of both labels scores are constant.
    """
    marks = labels.where("quality IN (0, 1) AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.max("quality").cast("long").alias("quality"))
    marks = marks.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows)
    sample = docs.select("doc_id", F.col("text").cast("string").alias("text")).where("text IS NOT NULL").join(F.broadcast(marks), "doc_id")
    sample = staged(sample.groupBy("doc_id").agg(F.min("text").alias("text"), F.first("quality").alias("quality")))
    seen = F.pmod(F.xxhash64("text"), F.lit(2)) == 0
    model = QualityModel(*(built_dictionary(_pieces(sample.where(seen), quality)) for quality in (1, 0)))
    rows = _sized(sample.where(~seen), model, ["quality"]).collect()  # at most sample_rows rows of sizes
    unstaged(sample)
    good, bad, size, label = (np.array([r[c] for r in rows], float) for c in ("good_bytes", "bad_bytes", "n_bytes", "quality"))
    model.calibration = fit_calibration(features(good, bad, size), label)
    return model


def score(docs: DataFrame, model: QualityModel, keep: list[str], threshold: float = 0.3) -> DataFrame:
    """``keep`` columns, n_bytes, good_bytes, bad_bytes, ``score`` (0 to 1) and ``predicted`` (1 from ``threshold`` on).

    Null texts are scored as empty ones, whose two sizes agree. Every row is
    scored on its own, on its whole text; repeated rows get the same score. An
    empty table gives an empty result.
    """
    return _sized(docs, model, keep).withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def op12_compression_quality(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("held_out", held_out("doc_id"))
    model = train(docs.where("NOT held_out"), table(spark, sf_dir, "labels"))
    return score(docs, model, ["doc_id", "held_out"]).select("doc_id", "held_out", "score", "predicted", "n_bytes", "good_bytes", "bad_bytes")
