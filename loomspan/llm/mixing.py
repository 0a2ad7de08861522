"""Mixing sources to target weights with a multivariate-hypergeometric splitting tree.

Weights give every source a target in words, at most twice its size. A target
is whole passes over the source plus a part of one. Documents stand in blocks
by hash; a pass takes blocks in a permuted order, the part ends inside a block
and inside a document, to the word. Which output shard gets how many blocks of
which source is drawn top down: each node of a binary tree splits its exact
source quotas between its halves by a multivariate-hypergeometric draw. Shards
then take disjoint runs of each source's permuted blocks and order their rows
by hash. Everything is DataFrame work; all draws are hashes, so reruns agree.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomspan.functions.draws import draw
from loomspan.llm.common import WORD_SPACE, staged

WEIGHTS = (5, 2, 1)
SHARE, MOST_REPEATS = 1.5, 2
#: Documents a block, and most blocks a source (a larger source has larger blocks).
BLOCK_DOCS, MOST_BLOCKS = 256, 1 << 16
#: Documents an output shard, and most levels of the tree that splits the mix among shards.
SHARD_DOCS, MOST_LEVELS = 16_384, 16


def hypergeometric(total: Column, marked: Column, drawn: Column, u: Column) -> Column:
    """How many of ``marked`` among ``total`` fall in a draw of ``drawn``: inverse of u.

    Walks the distribution by the ratio of neighbours over its support, where
    that is wider than ten standard deviations around the mode over those.
    """
    low, high = F.greatest(F.lit(0).cast("long"), drawn + marked - total), F.least(marked, drawn)
    mode = F.floor((drawn + 1) * (marked + 1) / (total + 2))
    spread = F.sqrt(drawn * (marked / total) * (1 - marked / total) * ((total - drawn) / F.greatest(total - 1, F.lit(1)).cast("double")))
    reach = F.ceil(10 * spread) + 10
    first, last = F.greatest(low, mode - reach), F.least(high, mode + reach)
    steps = F.sequence(first, last)

    def ratio(x: Column) -> Column:
        """Weight at x over the weight at x - 1."""
        up = (marked - x + 1).cast("double") * (drawn - x + 1)
        return up / (x.cast("double") * (total - marked - drawn + x))

    start = F.struct(F.lit(1.0).alias("weight"), F.lit(0.0).alias("sum"), F.lit(-1).cast("long").alias("found"))

    def walk(limit: Column | None) -> Column:
        def step(acc: Column, x: Column) -> Column:
            weight = F.when(x == first, F.lit(1.0)).otherwise(acc["weight"] * ratio(x))
            total_weight = acc["sum"] + weight
            found = F.lit(-1).cast("long") if limit is None else F.when(acc["found"] >= 0, acc["found"]).when(total_weight > limit, x).otherwise(F.lit(-1).cast("long"))
            return F.struct(weight.alias("weight"), total_weight.alias("sum"), found.alias("found"))

        return F.aggregate(steps, start, step)

    picked = walk(u * walk(None)["sum"])["found"]
    return F.when((marked <= 0) | (drawn <= 0) | (total <= 0), F.lit(0).cast("long")).when(first >= last, first).otherwise(F.when(picked < 0, last).otherwise(picked))


def source_targets(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST_REPEATS) -> DataFrame:
    """(source, source_size, docs, target) from rows (source, size).

    Sources in code-point order, null last, take the weights in turn. All
    targets that the cap stops are those of least cap per weight; what they
    leave goes to the others by weight.
    """
    by_source = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("docs"))
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1  # one row a source
    weight = F.element_at(F.array(*map(F.lit, weights)), F.pmod(place, F.lit(len(weights))) + 1).cast("double")
    ranked = by_source.select("*", place.alias("place"), weight.alias("weight"), (F.lit(most) * F.col("source_size")).cast("double").alias("cap"))
    whole = share * F.sum("source_size").over(Window.partitionBy())
    tight = Window.orderBy(F.col("cap") / F.col("weight"), "place")
    before = tight.rowsBetween(Window.unboundedPreceding, -1)
    left = whole - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    rest = F.sum("weight").over(Window.partitionBy()) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    level = ranked.withColumn("level", left / rest)
    free = level.withColumn("final", F.min(F.when(F.col("cap") >= F.col("weight") * F.col("level"), F.struct(F.col("cap") / F.col("weight"), "place", "level"))).over(Window.partitionBy())["level"])
    target = F.when(F.col("final").isNull(), F.col("cap")).otherwise(F.least("cap", F.col("weight") * F.col("final")))
    return free.select("source", "source_size", "docs", "place", target.alias("target"))


def shard_quotas(draws: DataFrame, levels: int, seed: int = 0) -> DataFrame:
    """(place, ends): for each source the running sum of its quotas over 2**levels shards.

    ``draws`` has (place, draws): exact numbers of blocks to deal. One row per
    tree node holds the quotas of all sources.
    """
    nodes = draws.agg(F.sort_array(F.collect_list(F.struct("place", F.col("draws").alias("n")))).alias("quotas")).select(F.lit(1).cast("long").alias("node"), "quotas")
    for _ in range(levels):
        size = F.aggregate("quotas", F.lit(0).cast("long"), lambda acc, x: acc + x["n"])
        start = F.struct(size.alias("left"), F.floor(size / 2).alias("want"), F.expr("cast(array() as array<struct<place:int,n:bigint>>)").alias("out"))

        def split(acc: Column, x: Column) -> Column:
            got = hypergeometric(acc["left"], x["n"], acc["want"], draw(seed, F.col("node"), x["place"]))
            out = F.concat(acc["out"], F.array(F.struct(x["place"].alias("place"), got.alias("n"))))
            return F.struct((acc["left"] - x["n"]).alias("left"), (acc["want"] - F.element_at(out, -1)["n"]).alias("want"), out.alias("out"))

        half = staged(nodes.withColumn("half", F.aggregate("quotas", start, split)["out"]))
        rest = F.zip_with("quotas", "half", lambda a, b: F.struct(a["place"].alias("place"), (a["n"] - b["n"]).alias("n")))
        both = F.array(F.struct((2 * F.col("node")).alias("node"), F.col("half").alias("quotas")), F.struct((2 * F.col("node") + 1).alias("node"), rest.alias("quotas")))
        nodes = half.select(F.explode(both).alias("x")).select("x.*")
    leaves = nodes.select("node", F.explode("quotas").alias("q")).select("node", "q.place", "q.n")
    run = F.sum("n").over(Window.partitionBy("place").orderBy("node"))
    in_order = leaves.select("place", F.struct("node", run.alias("end")).alias("x"))
    return in_order.groupBy("place").agg(F.transform(F.sort_array(F.collect_list("x")), lambda x: x["end"]).alias("ends"))


def in_blocks(sized: DataFrame, targets: DataFrame, seed: int = 0) -> DataFrame:
    """Rows (source, id, size, row) with what is known of their source and the ``block`` of it that a hash deals them to.

    ``row`` is the row's place, so rows that share source, id and size part too.
    """
    known = targets.withColumnRenamed("source", "its_source")
    placed = sized.join(known, sized.source.eqNullSafe(known.its_source))
    return placed.withColumn("hash", F.xxhash64(F.lit(seed), "id", "size", "row")).withColumn("block", F.pmod("hash", "blocks"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", levels: int | None = None, seed: int = 0) -> DataFrame:
    """(id, source, size, source_size, target, draws) per input row.

    ``draws`` lists the document's places in the mix as (pass, shard, order,
    words): whole passes first, then what the last, partial pass takes of it
    (the document where that pass ends gives its first ``words`` words).
    There are 2**levels shards, by default one for every SHARD_DOCS documents.
    Null texts and texts without words have size 0 and draws of 0 words; null
    sources are one source; repeated rows are documents of their own. An empty
    table gives an empty result.
    """
    words = F.coalesce(F.regexp_count(F.col(text_col).cast("string"), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")
    row = F.monotonically_increasing_id().alias("row")  # parts rows that share an id and a size
    sized = staged(docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), words.alias("size"), row))
    if levels is None:
        levels = min(MOST_LEVELS, max(1, math.ceil(math.log2(max(1, sized.count()) / SHARD_DOCS))))
    targets = source_targets(sized)
    blocks = F.least(F.ceil(F.col("docs") / BLOCK_DOCS), F.lit(MOST_BLOCKS)).cast("long")
    quota = F.round("target").cast("long")
    passes = F.when(F.col("source_size") > 0, F.floor(quota / F.col("source_size"))).otherwise(0)
    targets = staged(targets.withColumns({"blocks": blocks, "quota": quota, "passes": passes}).withColumn("part", F.col("quota") - F.col("passes") * F.col("source_size")))
    placed = in_blocks(sized, targets, seed)

    whole = placed.groupBy("place", "block").agg(F.sum("size").alias("words"), F.first("passes").alias("passes"), F.first("part").alias("part"), F.first("blocks").alias("blocks"))
    turns = whole.withColumn("pass", F.explode(F.sequence(F.lit(0).cast("long"), F.col("passes"))))
    permuted = Window.partitionBy("place", "pass").orderBy(F.xxhash64(F.lit(seed), "pass", "block"), "block")  # at most MOST_BLOCKS rows
    before = F.sum("words").over(permuted) - F.col("words")
    taken = turns.withColumns({"at": F.row_number().over(permuted) - 1, "left": F.col("part") - before})
    taken = staged(taken.where("pass < passes OR left > 0").withColumn("position", F.col("pass") * F.col("blocks") + F.col("at")))
    ends = shard_quotas(taken.groupBy("place").agg(F.count("*").alias("draws")), levels, seed)
    # sparse blocks leave gaps in positions, so shards deal by rank
    rank = F.row_number().over(Window.partitionBy("place").orderBy("position")) - 1
    dealt = taken.withColumn("rank", rank).join(ends, "place")
    shard = F.size(F.filter("ends", lambda e: e <= F.col("rank")))
    cut = (F.col("pass") == F.col("passes")) & (F.col("left") < F.col("words"))
    plan = dealt.groupBy("place", "block").agg(F.sort_array(F.collect_list(F.struct("pass", shard.alias("shard"), F.when(cut, F.col("left")).alias("left")))).alias("plan"))  # passes + 1 at most
    plan = staged(plan.withColumn("ends_here", F.exists("plan", lambda x: x["left"].isNotNull())))

    rows = placed.join(plan, ["place", "block"], "left")
    inside = Window.partitionBy("place", "block").orderBy("hash", "row")
    ahead = F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, -1))
    ending = rows.where("ends_here").withColumn("ahead", F.coalesce(ahead, F.lit(0)))
    others = rows.where("ends_here IS NULL OR NOT ends_here").withColumn("ahead", F.lit(0).cast("long"))

    def place(x: Column) -> Column:
        part = F.greatest(F.lit(0).cast("long"), F.least(F.col("size"), x["left"] - F.col("ahead")))
        count = F.when(x["left"].isNull(), F.col("size")).otherwise(part)
        return F.struct(x["pass"].alias("pass"), x["shard"].alias("shard"), F.xxhash64(F.lit(seed), x["pass"], "id", "row").alias("order"), count.alias("words"))

    draws = F.coalesce(F.transform("plan", place), F.expr("cast(array() as array<struct<pass:bigint,shard:int,order:bigint,words:bigint>>)"))
    return ending.unionByName(others).select("id", "source", "size", "source_size", "target", draws.alias("draws"))


def mixed_rows(docs: DataFrame, mixed: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The mix itself: a row of ``docs`` (one per id) for every draw that has words.

    Rows come in their shards, each in its own shuffled order, with ``text``
    cut to the words drawn where the mix ends inside a document.
    """
    drawn = mixed.select(F.col("id").alias("__mix_id"), F.col("size").alias("__mix_size"), F.explode("draws").alias("__mix_draw")).where("__mix_draw.words > 0")
    words = F.filter(F.split("text", WORD_SPACE), lambda w: w != "")
    count = F.col("__mix_draw.words")
    text = F.when(count < F.col("__mix_size"), F.array_join(F.slice(words, 1, count.cast("int")), " ")).otherwise(F.col("text"))
    kept = docs.join(drawn, F.col(id_col) == F.col("__mix_id")).withColumn("text", text)
    shards = kept.repartition("__mix_draw.shard").sortWithinPartitions("__mix_draw.shard", "__mix_draw.order", "__mix_draw.pass")
    return shards.select(*docs.columns)


def op4_mixing(spark, sf_dir: str) -> DataFrame:
    mixed = mix(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    taken = F.aggregate("draws", F.lit(0).cast("long"), lambda acc, x: acc + x["words"])
    return mixed.select(F.col("id").alias("doc_id"), "size", "source_size", "target", taken.alias("taken"), "source")
