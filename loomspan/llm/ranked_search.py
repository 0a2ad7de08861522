"""Exact ranked lexical search: variable-block-max WAND, one index a shard.

Documents are dealt evenly to shards. A shard's posting lists are cut into
blocks whose boundaries a dynamic program chooses: they minimise what the
blocks' bounds overstate, plus a price a block. A query walks the documents in
order. Its pivot is the first document that the lists up to there could lift
over the threshold by their greatest impacts; unless the bounds of the blocks
that hold the pivot could do so too, the walk skips to where a block ends that
lets them. Only what is left is scored, a stretch between block ends at a time,
and the threshold rises with the k-th best score so far. The best of all shards
are merged.
"""

from __future__ import annotations

import heapq
import math
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomspan.llm.common import in_small_batches, staged, table, texts_of, unstaged

#: Documents and postings of a shard, to expect, and bytes of query texts that are searched in one pass.
SHARD_DOCS, SHARD_POSTINGS, QUERY_BYTES = 8192, 1 << 22, 1 << 22
#: Postings of a cell, between which block boundaries lie, most cells of a block, and a block's price in postings at its list's greatest impact.
CELL, MOST_CELLS, PRICE = 8, 32, 2
#: Stretches of greatest bound that a query scores first.
SEEDS = 12
#: A-Z as a-z, other ASCII but digits and a-z as space.
_FOLDED = bytes(c + 32 if 65 <= c <= 90 else c if c > 127 or chr(c).isalnum() else 32 for c in range(256))


def terms_of(text: str) -> list[bytes]:
    """Maximal runs of digits, letters and anything beyond ASCII; only A-Z are lower-cased."""
    return text.encode().translate(_FOLDED).split()


def term_weight(df: int, n_docs: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The whole numbers of all [start, start + size), one after the other."""
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - sizes), sizes)


def block_ends(impacts: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Where blocks end, for lists of impacts that stand one after the other between ``bounds``.

    For each list, blocks of at most MOST_CELLS cells that minimise the sum of
    (greatest impact - impact) over postings plus PRICE greatest impacts of the
    list a block. All lists go through the program together, cell by cell.
    """
    sizes = np.diff(bounds)
    cells = -(-sizes // CELL)
    at = np.repeat(bounds[:-1], cells) + CELL * ranges(np.zeros(len(cells), np.int64), cells)
    ends = np.minimum(at + CELL, np.repeat(bounds[1:], cells))
    top, price = np.maximum.reduceat(impacts, at).astype(float), PRICE * np.maximum.reduceat(impacts, bounds[:-1]).astype(float)
    # longest lists first, so that those with an i-th cell stand together
    order = np.argsort(-cells, kind="stable")
    moved = ranges((np.cumsum(cells) - cells)[order], cells[order])
    at, ends, top, price, cells = at[moved], ends[moved], top[moved], price[order], cells[order]
    first = np.cumsum(cells) - cells
    # cost[i + first + rank] is the least cost of a list's first i cells, less the impacts themselves
    cost, since = np.zeros(len(top) + len(cells)), np.zeros(len(top), np.int64)
    rank = np.arange(len(cells))
    for i in range(int(cells[0])):
        active = int(np.searchsorted(-cells, -i, side="left"))
        back = min(i + 1, MOST_CELLS)
        cell = first[:active, None] + i - np.arange(back)
        bound = np.maximum.accumulate(top[cell], axis=1)
        length = ends[cell[:, :1]] - at[cell]
        total = cost[cell + rank[:active, None]] + bound * length + price[:active, None]
        best = total.argmin(axis=1)
        cost[first[:active] + rank[:active] + i + 1] = total[rank[:active], best]
        since[first[:active] + i] = best
    out = []
    todo = first + cells - 1  # the last cell of each list's last block
    while len(todo):
        out.append(ends[todo])
        before = todo - since[todo] - 1
        lists = np.searchsorted(first, todo, side="right") - 1
        todo = before[before >= first[lists]]
    return np.sort(np.concatenate(out))


class ShardIndex:
    """Posting lists of one shard: documents, impacts and variable blocks.

    A posting's impact is (1000000000 * tf) div (1000 * tf + 12 * m); a term's
    part of a score is its weight times that.
    """

    def __init__(self, m: np.ndarray, docs: np.ndarray, terms: np.ndarray, tfs: np.ndarray, k: int):
        order = np.lexsort((docs, terms))
        docs, terms, tfs = docs[order], terms[order], tfs[order]
        self.size, self.span = len(m), len(m) + 1
        self.impacts = (10**9 * tfs) // (1000 * tfs + 12 * m[docs])
        known, first = np.unique(terms, return_index=True)
        bounds = np.append(first, len(docs))
        self.lists = {t: i for i, t in enumerate(known.tolist())}
        self.first, self.end = bounds[:-1], bounds[1:]
        #: list and document of a posting in one number
        self.keys = np.repeat(np.arange(len(known)), np.diff(bounds)) * self.span + docs
        self.top = np.maximum.reduceat(self.impacts, first) if len(known) else np.empty(0, np.int64)
        #: k-th greatest impact of lists that have one: no k-th best score is less
        self.kth = np.array([np.partition(self.impacts[a:b], b - a - k)[b - a - k] if b - a >= k else 0 for a, b in zip(bounds[:-1], bounds[1:])], np.int64)
        ends = block_ends(self.impacts, bounds) if len(known) else np.empty(0, np.int64)
        starts = np.concatenate(([0], ends[:-1])) if len(ends) else ends
        most = np.maximum.reduceat(self.impacts, starts) if len(ends) else ends
        #: a block's bound holds from the end of the block before to its own last document
        self.block_first = np.searchsorted(starts, self.first)
        self.block_end = np.searchsorted(starts, self.end)
        self.step_at = docs[ends - 1] + 1 if len(ends) else ends
        after = np.append(most[1:], 0) if len(ends) else ends
        after[self.block_end - 1] = 0
        self.step_by = after - most
        self.block_top = most[self.block_first]
        self.blocks = len(ends)
        self.scored = 0  # postings that searches have scored

    def _scores(self, base: np.ndarray, weights: np.ndarray, low: int, high: int, exact: bool) -> tuple[np.ndarray, np.ndarray]:
        """Scores of the documents from ``low`` to before ``high``, and where the lists go on after that."""
        start, after = np.searchsorted(self.keys, base + low), np.searchsorted(self.keys, base + high)
        sizes = after - start
        posting = ranges(start, sizes)
        self.scored += len(posting)
        place = self.keys[posting] - np.repeat(base, sizes) - low
        part = self.impacts[posting] * np.repeat(weights, sizes)
        if exact:
            return np.bincount(place, weights=part, minlength=1), after
        scores = np.zeros(high - low, np.int64)
        np.add.at(scores, place, part)
        return scores, after

    def search(self, asked: list[tuple[int, int]], k: int) -> list[tuple[int, int]]:
        """Up to k best (score, document) with a score above 0 for (term, weight times repeats); ties go to the smaller document."""
        found = [(self.lists[t], w) for t, w in asked if t in self.lists and w > 0]
        if not found:
            return []
        which, weights = np.array([f[0] for f in found]), np.array([f[1] for f in found], np.int64)
        tops = weights * self.top[which]
        exact = float(tops.sum()) < 2**53
        theta = max(0, int((weights * self.kth[which]).max()) - 1)  # a score has to exceed it
        # the blocks' bounds together: steps at the documents where a block ends
        n_steps = self.block_end[which] - self.block_first[which]
        steps = ranges(self.block_first[which], n_steps)
        places, by = np.unique(self.step_at[steps], return_inverse=True)
        change = np.zeros(len(places), np.int64)
        np.add.at(change, by, np.repeat(weights, n_steps) * self.step_by[steps])
        bound = (int((weights * self.block_top[which]).sum()) + np.concatenate(([0], np.cumsum(change)))).tolist()
        edges = [0, *places.tolist()]
        base, last = which * self.span, self.end[which]
        # the stretches of greatest bound first: the k-th best score there is no more than that of all
        seeds: list[int] = []
        for i in sorted(range(len(edges) - 1), key=lambda i: -bound[i])[:SEEDS]:
            scores, _ = self._scores(base, weights, edges[i], edges[i + 1], exact)
            seeds = heapq.nlargest(k, [*seeds, *scores[scores > theta].astype(np.int64).tolist()])
            if len(seeds) == k:
                theta = max(theta, seeds[-1] - 1)
        at = self.first[which]
        best: list[tuple[int, int]] = []
        while True:
            here = np.where(at < last, self.keys[np.minimum(at, last - 1)] - base, self.size)
            order = np.argsort(here, kind="stable")
            pivot = int(np.searchsorted(np.cumsum(tops[order]), theta, side="right"))
            if pivot == len(order) or here[order[pivot]] == self.size:
                break
            doc = int(here[order[pivot]])
            i = bisect_right(edges, doc) - 1
            while i < len(bound) and bound[i] <= theta:  # skip to where blocks end that bound more
                i += 1
            if i >= len(edges) - 1:
                break
            low, high = max(doc, edges[i]), edges[i + 1]
            if low > doc:  # the cursors leap; the pivot is chosen anew
                at = np.searchsorted(self.keys, base + low)
                continue
            scores, at = self._scores(base, weights, low, high, exact)
            for j in np.flatnonzero(scores > theta).tolist():
                score = int(scores[j])
                if score <= theta:
                    continue
                heapq.heappush(best, (score, -(low + j)))
                if len(best) > k:
                    heapq.heappop(best)
                if len(best) == k:
                    theta = max(theta, best[0][0])
        return sorted(((s, -d) for s, d in best), key=lambda x: (-x[0], x[1]))


def _matched(docs: DataFrame, vocabulary: dict[bytes, int], id_col: str, text_col: str) -> DataFrame:
    """(id, n, terms, tfs) of documents with a term: how many terms, and which of the vocabulary how often."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = shared.value
        for batch in in_small_batches(batches):
            ids, sizes, ends, terms, tfs = [], [], [0], [], []
            for doc, text in zip(batch.column(0).to_pylist(), texts_of(batch.column(1))):
                words = terms_of(text)
                if not words:
                    continue
                ids.append(doc), sizes.append(len(words))
                for word, tf in Counter(words).items():
                    if word in number:
                        terms.append(number[word]), tfs.append(tf)
                ends.append(len(terms))
            lists = [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(x, t)) for x, t in ((terms, pa.int32()), (tfs, pa.int64()))]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(sizes, pa.int64()), *lists], names=["id", "n", "terms", "tfs"])

    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return source.mapInArrow(run, "id long, n long, terms array<int>, tfs array<long>")


def shard_index(ids: list[int | None], n: np.ndarray, counts: np.ndarray, terms: np.ndarray, tfs: np.ndarray, n_docs: int, n_terms: int, k: int) -> tuple[list[int | None], ShardIndex]:
    """Documents in order of id, null first, and the index over them; ``counts`` are postings a document."""
    order = sorted(range(len(ids)), key=lambda i: (ids[i] is not None, ids[i] or 0))
    place = np.empty(len(ids), np.int64)
    place[order] = np.arange(len(ids))
    if 25 * n_docs * int(n.max(initial=0)) < 2**63:
        m = 75 + 25 * n * n_docs // n_terms
    else:
        m = np.array([75 + 25 * x * n_docs // n_terms for x in n.tolist()], np.int64)
    return [ids[i] for i in order], ShardIndex(m[order], np.repeat(place, counts), terms, tfs, k)


def _searched(matched: DataFrame, queries: list[tuple[int, list[tuple[int, int]]]], n_docs: int, n_terms: int, k: int, shards: int) -> DataFrame:
    """(query, shard, id, score): the k best documents of each shard for each query."""
    shared = matched.sparkSession.sparkContext.broadcast(queries)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = pa.Table.from_batches(list(batches), schema)
        if not found.num_rows:
            return
        found = found.combine_chunks()
        lists = found.column("terms").chunk(0)
        counts = np.diff(np.asarray(lists.offsets))
        ids, index = shard_index(
            found.column("id").to_pylist(), found.column("n").to_numpy(), counts,
            np.asarray(lists.flatten()).astype(np.int64), np.asarray(found.column("tfs").chunk(0).flatten()), n_docs, n_terms, k,
        )
        shard = TaskContext.get().partitionId()
        for query, asked in shared.value:
            best = index.search(asked, k)
            columns = [[query] * len(best), [shard] * len(best), [ids[d] for _, d in best], [s for s, _ in best]]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["query", "shard", "id", "score"])

    schema = pa.schema([("id", pa.int64()), ("n", pa.int64()), ("terms", pa.list_(pa.int32())), ("tfs", pa.list_(pa.int64()))])
    return matched.repartition(shards).mapInArrow(run, "query long, shard long, id long, score long")


def _best(found: DataFrame, k: int, *groups: str) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy(*groups).orderBy(F.desc("score"), F.asc_nulls_first("id")))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def ranked_search(
    docs: DataFrame, items: DataFrame, k: int = 20, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", shard_docs: int = SHARD_DOCS, query_bytes: int = QUERY_BYTES
) -> DataFrame:
    """(item, rank, id, score) of each item's k best documents with a score above 0.

    Null texts have no terms: such a document is in no count, such an item has
    no rows. Every row of ``docs`` is a document and every row of ``items`` a
    query of its own, whatever its id; ties go to the smaller id, null first. Items have fewer rows where fewer documents score above
    0; an empty table gives an empty result. Items are searched in passes of
    about ``query_bytes`` of text, so what is broadcast doesn't grow with them.
    """
    asked = staged(items.select(F.col(item_col).cast("long").alias("item"), F.col(item_text_col).cast("string").alias("text"), F.monotonically_increasing_id().alias("row")).where("text IS NOT NULL"))
    passes = max(1, -(-(asked.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // query_bytes))
    out = None
    for i in range(passes):
        found = _one_pass(docs, asked.where(F.pmod(F.xxhash64("row"), F.lit(passes)) == i), k, id_col, text_col, shard_docs)
        out = found if out is None else out.unionByName(found)
    return out


def _one_pass(docs: DataFrame, asked: DataFrame, k: int, id_col: str, text_col: str, shard_docs: int) -> DataFrame:
    items = [(r.row, r.item, Counter(terms_of(r.text))) for r in asked.collect()]  # about QUERY_BYTES of text
    vocabulary = {t: i for i, t in enumerate(sorted(set().union(*(c for _, _, c in items))))}
    matched = staged(_matched(docs, vocabulary, id_col, text_col))
    whole = matched.agg(F.count("*").alias("docs"), F.coalesce(F.sum("n"), F.lit(0)).alias("terms"), F.sum(F.size("terms")).alias("postings")).first()
    df = {r.term: r["count"] for r in matched.select(F.explode("terms").alias("term")).groupBy("term").count().collect()}  # terms of the queries
    weight = {t: term_weight(df[i], whole.docs) for t, i in vocabulary.items() if i in df}
    queries = [(row, [(vocabulary[t], weight[t] * c) for t, c in counted.items() if t in weight]) for row, _, counted in items]
    shards = max(1, -(-whole.docs // shard_docs), -(-(whole.postings or 0) // SHARD_POSTINGS))
    found = _searched(matched, queries, whole.docs, max(1, whole.terms), k, shards)
    if shards > 64:  # an item's rows meet in groups of shards first
        found = _best(found.withColumn("group", F.pmod("shard", F.lit(math.isqrt(shards)))), k, "query", "group").drop("rank", "group")
    best = staged(_best(found, k, "query"))
    unstaged(matched)
    named = asked.select("row", "item")
    return best.join(named, best.query == named.row).select("item", "rank", "id", "score")


def op13_ranked_search(spark, sf_dir: str) -> DataFrame:
    found = ranked_search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(F.col("item").alias("item_id"), F.col("rank").cast("int").alias("rank"), F.col("id").alias("doc_id"), "score")


OP13_SQL = r"""
WITH d AS (
  SELECT doc_id, row_number() OVER () AS d, list_filter(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'), lambda x: x <> '') AS terms
  FROM documents WHERE text IS NOT NULL
), sized AS (SELECT doc_id, d, terms, CAST(len(terms) AS BIGINT) AS n FROM d WHERE len(terms) > 0),
whole AS (SELECT CAST(count(*) AS BIGINT) AS nd, CAST(sum(n) AS BIGINT) AS l FROM sized),
b AS (
  SELECT item_id, row_number() OVER () AS b, list_filter(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'), lambda x: x <> '') AS terms
  FROM benchmark WHERE text IS NOT NULL
), asked AS (SELECT item_id, b, term, CAST(count(*) AS BIGINT) AS times FROM (SELECT item_id, b, unnest(terms) AS term FROM b) GROUP BY ALL),
postings AS (
  SELECT doc_id, d, n, term, CAST(count(*) AS BIGINT) AS tf
  FROM (SELECT doc_id, d, n, unnest(terms) AS term FROM sized) WHERE term IN (SELECT term FROM asked) GROUP BY ALL
), weights AS (SELECT term, CAST(floor(1000 * ln((2 * any_value(nd) + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM postings, whole GROUP BY term),
scores AS (
  SELECT b, item_id, d, doc_id, CAST(sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * nd) // l)))) AS BIGINT) AS score
  FROM postings JOIN asked USING (term) JOIN weights USING (term), whole GROUP BY ALL
)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY b ORDER BY score DESC, doc_id NULLS FIRST) AS rank FROM scores WHERE score > 0
) WHERE rank <= 20
"""
