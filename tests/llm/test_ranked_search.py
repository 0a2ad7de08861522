"""Ranked search against brute force, and its blocks against all ways to cut a list."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomspan.llm import ranked_search as rs

TERM = re.compile("[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+")
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return TERM.findall((text or "").translate(UPPER))


def brute(docs, items, k=20):
    counted = [(i, Counter(terms(t))) for i, t in docs if terms(t)]
    n_docs, n_terms = len(counted), sum(sum(c.values()) for _, c in counted)
    df = Counter(t for _, c in counted for t in c)
    out = []
    for item, text in items:
        scored = []
        for doc, c in counted:
            m = 100 - 25 + (25 * sum(c.values()) * n_docs) // n_terms
            s = sum(times * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 12 * m)) for t, times in Counter(terms(text)).items() if t in c)
            if s > 0:
                scored.append((-s, (doc is not None, doc or 0), doc))
        out += [(item, rank, doc, -s) for rank, (s, _, doc) in enumerate(sorted(scored)[:k], 1)]
    return sorted(map(str, out))


def corpus(seed, n=400):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(120)]
    weights = [1 / (i + 1) for i in range(120)]
    docs = [(rng.randrange(n), " ".join(rng.choices(vocabulary, weights, k=rng.choice([1, 3, 20, 60])))) for _ in range(n)]
    docs += [(None, "w0 w1 w50"), (None, "w0 w1 w50"), (n + 1, None), (n + 2, ""), (n + 3, " .,; "), (n + 4, "W3-w3_W3 É w3é"), (n + 5, "w7 " * 9000), (n + 6, "w0 w1 w50")]
    items = [(i, " ".join(rng.choices(vocabulary, k=rng.choice([1, 2, 8, 30])))) for i in range(25)]
    return docs, items + [(3, "w50 w50 w50 w1"), (90, None), (91, "unheard of"), (92, ""), (None, "w3é É")]


@pytest.mark.parametrize("shard, size", [(8192, 1 << 22), (20, 1 << 22), (3, 300)])
def test_search_equals_brute_force(spark, shard, size):
    docs, items = corpus(shard)
    clash = {c: F.lit("clash") for c in ("id", "n", "terms", "tfs", "row", "item", "query", "score", "rank", "shard", "group")}
    frames = [spark.createDataFrame(r, f"{k} long, text string").withColumns(clash) for r, k in ((docs, "doc_id"), (items, "item_id"))]
    got = rs.ranked_search(*frames, shard_docs=shard, query_bytes=size).collect()
    assert sorted(str((r["item"], r["rank"], r["id"], r["score"])) for r in got) == brute(docs, items)


def test_empty_tables(spark):
    docs, items = (spark.createDataFrame([(1, "a b")], f"{k} long, text string") for k in ("doc_id", "item_id"))
    assert rs.ranked_search(docs.limit(0), items).count() == 0 and rs.ranked_search(docs, items.limit(0)).count() == 0
    assert [tuple(r) for r in rs.ranked_search(docs, items).collect()] == [(1, 1, 1, 2 * math.floor(1000 * math.log(4 / 3)) * (10**9 // (1000 + 12 * 100)))]


def test_terms_are_the_pattern():
    text = "".join(map(chr, range(0x250))) + " ÉcOLE x_Y-z 9 \x85中文.A"
    assert [t.decode() for t in rs.terms_of(text)] == terms(text)


def overstated(impacts, ends):
    starts = [0, *ends[:-1]]
    return sum(max(impacts[a:b]) * (b - a) - sum(impacts[a:b]) for a, b in zip(starts, ends)) + rs.PRICE * max(impacts) * len(ends)


def test_blocks_are_the_best_of_all(monkeypatch):
    monkeypatch.setattr(rs, "CELL", 2), monkeypatch.setattr(rs, "MOST_CELLS", 4), monkeypatch.setattr(rs, "PRICE", 1)
    rng = random.Random(8)
    lists = [[rng.choice([1, 2, 50, 100]) for _ in range(rng.randint(1, 18))] for _ in range(40)]
    bounds = np.cumsum([0, *map(len, lists)])
    ends = rs.block_ends(np.array(sum(lists, [])), bounds).tolist()
    for a, b, impacts in zip(bounds[:-1].tolist(), bounds[1:].tolist(), lists):
        mine = [e - a for e in ends if a < e <= b]
        cuts = list(range(2, len(impacts), 2))
        ways = [[c for j, c in enumerate(cuts) if i >> j & 1] + [len(impacts)] for i in range(1 << len(cuts))]
        held = [w for w in ways if all(y - x <= 8 for x, y in zip([0, *w], w))]
        assert mine[-1] == len(impacts) and overstated(impacts, mine) == min(overstated(impacts, w) for w in held)


def test_walk_skips_blocks():
    # one long common list, and a rare term that stands in few documents
    rng = np.random.default_rng(9)
    docs = np.concatenate([np.arange(200_000), np.arange(30) * 6000])
    which = np.concatenate([np.zeros(200_000, np.int64), np.ones(30, np.int64)])
    index = rs.ShardIndex(np.full(200_000, 100), docs, which, rng.integers(1, 3, len(docs)), 20)
    found = index.search([(0, 5), (1, 9000)], 20)
    scores = np.zeros(200_000, np.int64)
    np.add.at(scores, index.keys % index.span, index.impacts * np.where(index.keys < index.span, 5, 9000))
    best = np.lexsort((np.arange(200_000), -scores))[:20]
    assert found == list(zip(scores[best].tolist(), best.tolist())) and index.scored < 20_000
