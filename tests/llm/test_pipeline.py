"""The pipeline's stages, each against what its own input holds."""

import hashlib
import zlib
from collections import Counter

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from loomspan.llm.common import staged, table

from test_operators import SMALL, brute_substrings, words


@pytest.fixture(scope="module")
def stages(spark):
    docs = [table(spark, SMALL, "documents")]
    for _, stage in corpus_pipeline.STAGES:
        docs.append(staged(stage(spark, docs[-1], SMALL)))
    return [x.toPandas() for x in docs]


def test_all_but_the_last_keep_the_columns(stages):
    assert all(set(x.columns) == set(corpus_pipeline.COLUMNS) for x in stages[:-1])


def test_toxic_documents_go_and_clean_ones_stay(spark, stages):
    labels = table(spark, SMALL, "labels").toPandas().set_index("doc_id").toxic
    kept = set(stages[1].doc_id)
    clean, toxic = labels[labels == 0].index, labels[labels == 1].index
    assert sum(i in kept for i in clean) >= 0.98 * len(clean) and sum(i in kept for i in toxic) <= 0.25 * len(toxic)


def shingles(text):
    w = text.lower().split()
    return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()


def test_one_of_each_group_of_near_copies_stays(stages):
    before, after = stages[1], set(stages[2].doc_id)
    sets = {r.doc_id: shingles(r.text or "") for r in before.itertuples()}
    alike = lambda a, b: len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])
    kept = sorted(after)
    assert not [(a, b) for a in kept for b in kept if a < b and alike(a, b)]
    lonely = [i for i in sets if all(i == j or len(sets[i] & sets[j]) < 0.6 * len(sets[i] | sets[j]) for j in sets)]
    assert set(lonely) <= after


def test_repeats_are_cut(stages):
    before, after = stages[2], stages[3].set_index("doc_id").text
    want = {doc: (n, gone, digest) for doc, n, gone, digest in brute_substrings(list(zip(before.doc_id, before.text)), 20)}
    for doc, (n, gone, digest) in want.items():
        if gone and gone == n:
            assert doc not in after.index
        else:
            assert hashlib.sha256(b" ".join(after[doc].encode().split())).hexdigest() == digest


def test_the_mix_takes_its_targets(stages):
    before, after = stages[3], stages[4]
    size = before.assign(n=[len(words(t)) for t in before.text]).groupby("source").n.sum()
    took = after.assign(n=[len(words(t)) for t in after.text]).groupby("source").n.sum()
    assert abs(took.sum() - 1.5 * size.sum()) <= len(size) and (took <= 2 * size).all()


def test_all_is_packed(stages):
    pieces = stages[5]
    assert set(pieces.doc_id) == set(stages[4].doc_id)
    assert pieces.groupby("sequence_id").length.sum().max() <= 2048
    starts = pieces[pieces.start == 0].groupby("doc_id").size()
    assert (starts == stages[4].groupby("doc_id").size()).all()
    assert (pieces.ids.map(len) == 4 * pieces.length).all() and (pieces.ids.map(zlib.crc32) == pieces.ids_crc32).all()
    assert not pieces.duplicated(["row", "start"]).any() and pieces["row"].nunique() == len(stages[4])
    by_row = pieces.groupby("row").agg(n=("length", "sum"), told=("doc_tokens", "first"), ids=("doc_id", "nunique"))
    assert (by_row.n == by_row.told).all() and (by_row.ids == 1).all()


ODD_ROWS = [
    (1, "some words of one id", "en", "a", 1), (1, "quite another text under that id", "en", "a", 1), (2, None, "en", None, 0), (3, "", None, "b", 0),
    (None, "no id here at all", "en", "b", 1), (None, "nor is there one here", "en", "b", 1), (4, "the same row", "en", "a", 1), (4, "the same row", "en", "a", 1), (5, "x " * 6000, "en", "c", 1),
]


def test_stages_on_odd_rows(spark):
    docs = spark.createDataFrame(ODD_ROWS, "doc_id long, text string, lang string, source string, n_chars long").withColumns({c: F.lit("clash") for c in ("id", "row", "kept", "key", "mix_key", "component", "score", "sequence_id")})
    texts = lambda df: Counter((r.doc_id, (r.text or "").strip()) for r in df.collect())
    whole = texts(docs)
    assert texts(corpus_pipeline.drop_toxic(spark, docs, SMALL)) == whole
    first = texts(corpus_pipeline.drop_near_copies(spark, docs, SMALL))
    assert first == Counter({k: 1 for k in whole if k[0] != 3})  # the texts without words are one group
    cut = texts(corpus_pipeline.cut_repeats(spark, docs, SMALL))
    assert sum(cut.values()) == len(ODD_ROWS) and cut[(1, "quite another text under that id")] == 1
    mixed = texts(corpus_pipeline.mix_sources(spark, docs, SMALL))
    assert {k for k in mixed if k[0] in (1, 4, None)} <= set(whole) and sum(n for k, n in mixed.items() if k[0] == 1) >= 2
    packed = corpus_pipeline.pack(spark, docs, SMALL).toPandas()
    assert len(packed[(packed.doc_id == 4) & (packed.start == 0)]) == 2 and packed[packed.doc_id == 4]["row"].nunique() == 2
    assert packed.doc_id.isna().sum() == 2


def test_stages_on_an_empty_table(spark):
    docs = table(spark, SMALL, "documents").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = staged(stage(spark, docs, SMALL))
        assert docs.count() == 0
