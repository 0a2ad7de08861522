"""Quality rules: learned decision lists over text statistics.

Statistics of a text are DataFrame expressions. From labelled rows, sequential
covering grows one conjunction of thresholds after another against the bad
rows not yet covered (information gain on the growing part), prunes it on the
held-back part, and stops when no conjunction is precise enough. The ordered
rules become one conditional expression that Spark evaluates.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomspan.llm.common import WORD_SPACE, staged, table

#: Most labelled rows read to learn; thresholds tried per statistic; list limits.
SAMPLE_ROWS, THRESHOLDS = 16_384, 48
MOST_RULES, MOST_CONDITIONS, LEAST_PRECISION, LEAST_COVER = 10, 4, 0.9, 4

_SPACES = " \t\n\x0b\x0c\r"
_SYMBOLS = "#*$%&|<>"
WINDOW = 5
#: Statistics that rules may test.
FEATURES = ["n_words", "mean_word", "symbol_share", "duplicate_share", "repeat_share", "distinct_share", "upper_share", "digit_share", "mark_share", "lines_per_word"]


def _without(text: Column, characters: str) -> Column:
    return F.translate(text, characters, "")


def _count(text: Column, characters: str) -> Column:
    return (F.char_length(text) - F.char_length(_without(text, characters))).cast("long")


def text_statistics(docs: DataFrame, text_col: str = "text", keep: list[str] = ("doc_id",)) -> DataFrame:
    """The ``keep`` columns with the statistics of the text; no others of ``docs``.

    Null texts count as empty: all counts and shares 0. Texts without repeated
    windows or lines never enter the sort that finds the repeats.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    base = docs.select(*keep, text.alias("_t"))
    split = base.select("*", F.filter(F.split("_t", WORD_SPACE), lambda w: w != "").alias("_w"), F.filter(F.split("_t", "\n"), lambda x: _without(x, _SPACES) != "").alias("_l"))
    gram = F.transform(F.sequence(F.lit(0), F.size("_w") - WINDOW), lambda i: F.xxhash64(*[F.get("_w", i + k) for k in range(WINDOW)]))
    counted = split.select(
        *keep,
        F.size("_w").cast("long").alias("n_words"),
        F.char_length(_without(F.col("_t"), _SPACES)).cast("long").alias("word_chars"),
        _count(F.col("_t"), _SYMBOLS).alias("n_symbols"),
        F.size("_l").cast("long").alias("_lines"),
        (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"),
        F.size(F.array_distinct("_w")).alias("_distinct"),
        F.regexp_count(F.col("_t"), F.lit(r"\p{Lu}")).alias("_upper"),
        _count(F.col("_t"), "0123456789").alias("_digits"),
        _count(F.col("_t"), "!?.,;:").alias("_marks"),
        F.when(F.size("_w") >= WINDOW, gram).otherwise(F.expr("cast(array() as array<bigint>)")).alias("_g"),
    )
    repeats = counted.withColumn("_s", F.when(F.size(F.array_distinct("_g")) < F.size("_g"), F.array_sort(F.transform("_g", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    twice = F.filter("_s", lambda x, i: (x["h"] == F.get("_s", i - 1)["h"]) | (x["h"] == F.get("_s", i + 1)["h"]))
    found = repeats.withColumn("_p", F.array_sort(F.transform(twice, lambda x: x["i"])))
    start = F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n"))
    covered = F.aggregate("_p", start, lambda acc, p: F.struct((p + WINDOW).alias("end"), (acc["n"] + p + WINDOW - F.greatest(p, acc["end"])).alias("n")))["n"]
    whole = found.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0).cast("long")))

    def per(a: str, b: str) -> Column:
        return F.coalesce(F.try_divide(F.col(a).cast("double"), F.col(b).cast("double")), F.lit(0.0))

    return whole.select(
        *keep, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        per("word_chars", "n_words").alias("mean_word"), per("n_symbols", "word_chars").alias("symbol_share"),
        per("n_dup_lines", "_lines").alias("duplicate_share"), per("n_repeat_words", "n_words").alias("repeat_share"),
        per("_distinct", "n_words").alias("distinct_share"), per("_upper", "word_chars").alias("upper_share"),
        per("_digits", "word_chars").alias("digit_share"), per("_marks", "word_chars").alias("mark_share"),
        per("_lines", "n_words").alias("lines_per_word"),
    )


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    threshold: float

    def column(self) -> Column:
        return F.col(self.feature) > self.threshold if self.above else F.col(self.feature) <= self.threshold

    def __str__(self) -> str:
        return f"{self.feature} {'>' if self.above else '<='} {self.threshold:g}"


Rule = tuple[Condition, ...]


def rule_column(rule: Rule) -> Column:
    whole = rule[0].column()
    for condition in rule[1:]:
        whole &= condition.column()
    return whole


def decision_list(rules: list[Rule]) -> Column:
    """True where no rule rejects: the rules in order as one conditional expression."""
    if not rules:
        return F.lit(True)
    verdict = F.when(rule_column(rules[0]), F.lit(False))
    for rule in rules[1:]:
        verdict = verdict.when(rule_column(rule), F.lit(False))
    return verdict.otherwise(F.lit(True))


def _gain(bad: int, good: int, bad_before: int, good_before: int) -> float:
    if not bad:
        return 0.0
    return bad * (math.log2(bad / (bad + good)) - math.log2(bad_before / (bad_before + good_before)))


def _best_condition(rows: DataFrame, cuts: dict[str, list[float]]) -> tuple[Condition | None, int, int]:
    """The condition of most gain on ``rows`` (features, bad), with its bad and good rows.

    Rows are counted per statistic and threshold step; only those counts, a
    number fixed by the parameters, reach the driver.
    """
    def passed(feature: str) -> Column:
        return F.size(F.filter(F.array(*map(F.lit, cuts[feature])), lambda t: F.col(feature) > t))

    steps = [F.struct(F.lit(f).alias("feature"), passed(f).alias("step")) for f in FEATURES if cuts[f]]
    counts = rows.select(F.explode(F.array(*steps)).alias("x"), "bad").groupBy("x.feature", "x.step").agg(F.sum("bad").alias("bad"), F.sum(1 - F.col("bad")).alias("good")).collect()
    by: dict[str, dict[int, tuple[int, int]]] = {}
    for r in counts:
        by.setdefault(r.feature, {})[r.step] = (r.bad, r.good)
    best: tuple[float, Condition | None, int, int] = (0.0, None, 0, 0)
    for feature in sorted(by):
        all_bad, all_good = (sum(x[i] for x in by[feature].values()) for i in (0, 1))
        bad = good = 0
        for i, cut in enumerate(cuts[feature]):
            bad, good = bad + by[feature].get(i, (0, 0))[0], good + by[feature].get(i, (0, 0))[1]
            for above, b, g in ((False, bad, good), (True, all_bad - bad, all_good - good)):
                if (gain := _gain(b, g, all_bad, all_good)) > best[0] + 1e-9:
                    best = gain, Condition(feature, above, cut), b, g
    return best[1:]


def learn(labelled: DataFrame) -> list[Rule]:
    """Ordered rules from rows of statistics with ``bad`` (0 or 1) and ``growing`` (boolean).

    Without rows of both kinds there are no rules.
    """
    at = [i / THRESHOLDS for i in range(THRESHOLDS + 1)]
    cuts: dict[str, list[float]] = {f: [] for f in FEATURES}
    for bad in (0, 1):  # thresholds from both kinds, so that rare bad values have some
        found = labelled.where(F.col("bad") == bad).agg(*[F.percentile_approx(f, at, 1000).alias(f) for f in FEATURES]).first()
        for f in FEATURES:
            cuts[f] += [float(x) for x in found[f] or []]
    for f, x in cuts.items():  # half-way between neighbours, so that a cut keeps a margin to both
        values = sorted(set(x))
        cuts[f] = [(a + b) / 2 for a, b in zip(values, values[1:])]
    rules: list[Rule] = []

    def counts(rows: DataFrame, rule: Rule) -> tuple[int, int]:
        r = rows.where(rule_column(rule)).agg(F.sum("bad").alias("bad"), F.count("*").alias("n")).first()
        return r.bad or 0, r.n - (r.bad or 0)

    while len(rules) < MOST_RULES:
        left = labelled.where(decision_list(rules))
        growing, pruning = left.where("growing"), left.where("NOT growing")
        rule: Rule = ()
        while len(rule) < MOST_CONDITIONS:
            condition, bad, good = _best_condition(growing.where(rule_column(rule)) if rule else growing, cuts)
            if condition is None:
                break
            rule += (condition,)
            if not good:
                break
        if not rule:
            break
        worth = []
        for n in range(len(rule), 0, -1):  # drop last conditions while that is no worse on the held-back part
            bad, good = counts(pruning, rule[:n])
            worth.append(((bad - good) / max(1, bad + good), -n, rule[:n]))
        rule = max(worth)[2]
        bad, good = counts(left, rule)
        if bad < LEAST_COVER or bad < LEAST_PRECISION * (bad + good):
            break
        rules.append(rule)
    return rules


def train(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> list[Rule]:
    """Rules from the documents (doc_id, text) whose label ``quality`` is 0 or 1.

    At most ``sample_rows`` labelled rows are read, chosen by hash of the id.
    Rows that fail the base checks are left out, since no rule has to find them.
    """
    marks = labels.where("quality IN (0, 1) AND doc_id IS NOT NULL").groupBy("doc_id").agg((1 - F.min("quality")).cast("int").alias("bad"))
    marks = marks.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows)
    sample = docs.select("doc_id", "text").join(F.broadcast(marks), "doc_id")
    measured = staged(text_statistics(sample, keep=["doc_id", "bad"]))  # a filter on what is computed would be pushed below it and compute it again
    growing = F.pmod(F.xxhash64(F.lit("grow"), "doc_id"), F.lit(3)) > 0
    return learn(staged(measured.where(~base_failed()).select(*FEATURES, "bad", growing.alias("growing")).coalesce(1)))


def judged(docs: DataFrame, rules: list[Rule], text_col: str = "text", keep: list[str] = ("doc_id",)) -> DataFrame:
    """The ``keep`` columns with statistics, ``base_failed`` and ``kept``.

    Repeated rows are judged alike; an empty table gives an empty result.
    """
    measured = text_statistics(docs, text_col, keep).withColumn("base_failed", base_failed())
    return measured.withColumn("kept", ~F.col("base_failed") & decision_list(rules))


def op5_quality_rules(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    rules = train(docs, table(spark, sf_dir, "labels"))
    return judged(docs, rules).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
