"""Quality by compression: held-out accuracy, and awkward inputs."""

import math
import random

import numpy as np
from pyspark.sql import functions as F

from loomspan.llm import compression_quality as cq
from loomspan.llm.common import held_out

from conftest import SMALL


def test_held_out_rows_are_told_apart(spark):
    sf = SMALL.replace("0.001", "0.01")
    got = cq.op12_compression_quality(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out").toPandas()
    assert got.score.between(0, 1).all() and (got.predicted == (got.score >= 0.3)).all()
    right = got.predicted == got.quality
    assert right.mean() > 0.93 and right[got.quality == 1].mean() > 0.96


def test_labels_lang_source_and_ids_are_no_inputs(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    model = cq.train(docs.where(~held_out("doc_id")), spark.read.parquet(f"{SMALL}/labels.parquet"))
    plain = {r.doc_id: r.score for r in cq.score(docs, model, ["doc_id"]).collect()}
    other = docs.withColumns({"doc_id": -F.col("doc_id"), "lang": F.lit("x"), "source": F.lit("y")})
    assert {-r.doc_id: r.score for r in cq.score(other, model, ["doc_id"]).collect()} == plain


def test_sizes_are_those_of_whole_texts(spark):
    rng = random.Random(4)
    good, bad = ([" ".join(rng.choices(words, k=40)) for _ in range(200)] for words in (["alpha", "beta", "gamma", "delta"], ["@@zip", "@@zap", "@@zop", "@@zup"]))
    docs = spark.createDataFrame([*enumerate(good + bad)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i < 200)) for i in range(400)], "doc_id long, quality int")
    model = cq.train(docs, labels)
    late = "alpha beta " * 20 + "@@zip @@zop @@zap " * 50_000  # what follows a good beginning counts
    rows = {r.doc_id: r for r in cq.score(spark.createDataFrame([(1, late), (2, "gamma delta alpha " * 12), (3, "@@zup @@zip @@zap " * 12)], "doc_id long, text string"), model, ["doc_id"]).collect()}
    assert rows[1].n_bytes == len(late) and rows[2].predicted == 1 and rows[3].predicted == 0 and rows[3].good_bytes > rows[3].bad_bytes
    assert {rows[1].good_bytes, rows[1].bad_bytes} == {len(cq._compressor(d).compress(late.encode())) for d in (model.good, model.bad)}


def test_odd_rows_and_missing_labels(spark):
    rows = [(1, None), (2, ""), (3, " \n\t"), (4, "one"), (4, "one"), (None, "no id"), (5, "½ 中文 \U0001f642 é"), (6, "x " * 300_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("clash") for c in ("score", "n_bytes", "quality", "piece", "scored_text", "good_bytes")})
    empty = spark.createDataFrame([], "doc_id long, quality int")
    model = cq.train(docs, empty)
    got = cq.score(docs, model, ["doc_id"]).collect()
    assert len(got) == len(rows) and {r.score for r in got} == {0.5}
    one = cq.train(docs, spark.createDataFrame([(1, 1), (2, 1), (4, 1), (4, 0), (5, None), (6, 7)], "doc_id long, quality int"))
    assert {0.5 < r.score <= 0.99 for r in cq.score(docs, one, ["doc_id"]).collect()} == {True}
    both = cq.train(docs, spark.createDataFrame([(2, 1), (3, 0), (4, 1), (5, 0), (6, 1)], "doc_id long, quality int"))
    scored = cq.score(docs, both, ["doc_id"]).collect()
    assert all(0 <= r.score <= 1 and math.isfinite(r.score) for r in scored) and len({r.score for r in scored if r.doc_id in (1, 2)}) == 1
    assert len({r.score for r in scored if r.doc_id == 4}) == 1 and cq.score(docs.limit(0), both, ["doc_id"]).count() == 0


def test_calibration_is_ordered_and_bounded():
    x = np.random.default_rng(0).normal(size=(500, 2))
    labels = (x[:, 0] + 0.3 * np.random.default_rng(1).normal(size=500) > 0).astype(float)
    fit = cq.fit_calibration(x, labels)
    scores = fit.scores(np.array([[-3.0, 0], [0, 0], [3.0, 0]]))
    assert scores[0] < 0.05 < scores[1] < 0.95 < scores[2] and abs(fit.scores(x).mean() - labels.mean()) < 0.01
    assert fit.scores(x * 1e6).max() <= 1
