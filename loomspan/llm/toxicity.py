"""Toxicity by a weighted finite-state pattern grammar.

Words and marks become symbols (insult, harm, intent, target, negation, verb
of speech, quotation mark, ...); small transducers rewrite the symbols in turn,
and their composition is one table of states. The first reads phrases (an
intent and a verb of harm make a threat), the next marks what is negated, the
next what is only reported (after a verb of speech, and in the quotation it
opens, even over sentences), and the last takes a clause together: it notes
targets on either side and writes, where the clause ends, the one pattern that
the clause matches. Documents are scored by their matched clauses, never by
single words. Insult words beyond the built-in seeds are learned from labelled
rows as word beginnings, and so are the weights of the patterns.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomspan.llm.common import held_out, in_small_batches, staged, table, texts_of, unstaged

#: Most labelled rows that are read to learn, and most learned word beginnings.
SAMPLE_ROWS, LEARNED = 16_384, 4096
#: What a negated or reported pattern weighs of the plain one.
MUTED = 0.1
#: Words that one worker keeps the symbols of.
MEMO_WORDS = 131_072

SEEDS = {
    "HARM": "kill hurt destroy burn stab shoot murder strangle töten umbringen erschießen tuer frapper matar golpear".split(),
    "INTENT": "will gonna shall ll going werde werden wird vais va allons voy vamos".split(),
    "TARGET": "you your yours u he she they them him her du dich dir euch ihr tu te toi vous tú usted ustedes".split(),
    "NEGATION": "not never no isn aren wasn don doesn nicht nie kein keine pas jamais nunca".split(),
    "REPORT": "said says say wrote quoted reported claimed alleged sagte schrieb berichtete dit écrit rapporté dijo escribió".split(),
    "FIRST": "shut drop go rot".split(),
    "LAST": "up dead hell".split(),
}
SEED_INSULTS = "idiot moron scum stupid loser worthless pathetic disgusting trash".split()

_TOKEN = re.compile("[^\\W\\d_]+|[\"“”„«»]|[.!?;\n]+")
_WORD = re.compile(r"[^\W\d_]+")
SYMBOLS = ["OTHER", "INSULT", "HARM", "INTENT", "TARGET", "NEGATION", "REPORT", "FIRST", "LAST", "QUOTE", "END"]
_NUMBER = {s: i for i, s in enumerate(SYMBOLS)}
#: What a clause can be found to hold, and the marks it can bear.
KINDS = ["INSULT", "THREAT", "HARM"]


class Transducer:
    """Deterministic transducer: (state, symbol) gives (symbol, state).

    Symbols without an arc pass unchanged and leave the state as it is.
    """

    def __init__(self, start, arcs: dict):
        self.start, self.arcs = start, arcs

    def step(self, state, symbol):
        return self.arcs.get((state, symbol), (symbol, state))

    def then(self, other: Transducer, symbols: list) -> Transducer:
        """Composition: what this one writes is what ``other`` reads."""
        start, arcs, todo, seen = (self.start, other.start), {}, [(self.start, other.start)], set()
        while todo:
            state = todo.pop()
            if state in seen:
                continue
            seen.add(state)
            for symbol in symbols:
                middle, a = self.step(state[0], symbol)
                out, b = other.step(state[1], middle)
                arcs[state, symbol] = out, (a, b)
                todo.append((a, b))
        return Transducer(start, arcs)


def _phrases(reach: int = 3) -> Transducer:
    """An intent makes harm within ``reach`` words a threat; two-word phrases become insults."""
    plain = ("OTHER", "TARGET", "NEGATION", "INTENT")
    arcs = {("none", "INTENT"): ("OTHER", ("intent", reach)), ("none", "FIRST"): ("OTHER", ("first", 2)), ("none", "LAST"): ("OTHER", "none")}
    for kind, most in (("intent", reach), ("first", 2)):
        for n in range(1, most + 1):
            after = (kind, n - 1) if n > 1 else "none"
            arcs |= {((kind, n), x): (x if x != "INTENT" else "OTHER", ("intent", reach) if x == "INTENT" else after) for x in plain}
            arcs |= {((kind, n), "FIRST"): ("OTHER", ("first", 2)), ((kind, n), "END"): ("END", "none")}
            arcs[(kind, n), "LAST"] = ("INSULT" if kind == "first" else "OTHER", "none")
            arcs[(kind, n), "HARM"] = ("THREAT" if kind == "intent" else "HARM", "none")
    return Transducer("none", arcs)


def _negation(reach: int = 3) -> Transducer:
    """Marks what follows a negation within ``reach`` words of its clause."""
    arcs = {(n, "NEGATION"): ("OTHER", reach) for n in range(reach + 1)}
    for n in range(1, reach + 1):
        arcs |= {(n, x): (x, n - 1) for x in ("OTHER", "TARGET", "REPORT")}
        arcs |= {(n, x): (f"{x}-", 0) for x in KINDS}
        arcs[n, "END"] = ("END", 0)
    return Transducer(0, arcs)


def _reported() -> Transducer:
    """Marks what follows a verb of speech in its clause, or stands in the quotation that it opens."""
    arcs = {("own", "QUOTE"): ("OTHER", "own"), ("reported", "QUOTE"): ("OTHER", "quoted"), ("quoted", "QUOTE"): ("OTHER", "own"), ("reported", "END"): ("END", "own")}
    arcs |= {(s, "REPORT"): ("OTHER", "reported" if s == "own" else s) for s in ("own", "reported", "quoted")}
    arcs |= {(s, x): (f"{x}'", s) for s in ("reported", "quoted") for x in (*KINDS, *(f"{k}-" for k in KINDS))}
    return Transducer("own", arcs)


#: Patterns that a clause can match: its kind, ``+`` if the kind stands there more than once, ``-`` if
#: negated, ``'`` if reported, ``>`` if it names a target. A document's features are their counts.
PATTERNS = [f"{k}{m}{n}{r}{t}" for k, m, n, r, t in product(KINDS, ("", "+"), ("", "-"), ("", "'"), ("", ">"))]


def _clause() -> Transducer:
    """Takes a clause together and writes its pattern in place of its END.

    What is neither negated nor reported outweighs what is, and a threat
    outweighs an insult and that mere harm.
    """
    marks = [f"{k}{n}{r}" for k, n, r in product(KINDS, ("", "-"), ("", "'"))]
    weight = {x: ("-" not in x and "'" not in x, "-" not in x, -("HARM", "INSULT", "THREAT")[::-1].index(x.rstrip("-'"))) for x in marks}
    arcs = {}
    for held, more, aimed in product([None, *marks], (False, True), (False, True)):
        state = held, more, aimed
        arcs[state, "TARGET"] = "OTHER", (held, more, True)
        for x in marks:
            best = x if held is None or weight[x] > weight[held] else held
            arcs[state, x] = "OTHER", (best, best == held and (more or x == held), aimed)
        kind = held and held.rstrip("-'")
        arcs[state, "END"] = (f"{kind}{'+' if more else ''}{held[len(kind):]}{'>' if aimed else ''}" if held else "END"), (None, False, False)
    return Transducer((None, False, False), arcs)


class ClauseGrammar:
    """The composed transducers as one table over integer states."""

    def __init__(self, insults: list[str]):
        whole = _phrases().then(_negation(), SYMBOLS).then(_reported(), SYMBOLS).then(_clause(), SYMBOLS)
        names = {s: i for i, s in enumerate(dict.fromkeys([whole.start, *(s for s, _ in whole.arcs)]))}
        number = {p: i for i, p in enumerate(PATTERNS)}
        self.table = [[(0, -1)] * len(SYMBOLS) for _ in names]
        for (state, symbol), (out, after) in whole.arcs.items():
            self.table[names[state]][_NUMBER[symbol]] = names[after], number.get(out, -1)
        self.start = names[whole.start]
        self.words = {w: _NUMBER[kind] for kind, words in SEEDS.items() for w in words}
        self.words |= {w: _NUMBER["INSULT"] for w in SEED_INSULTS}
        self.begins = set(insults)
        self.lengths = sorted({len(b) for b in insults})
        self.memo: dict[str, int] = {}

    def __getstate__(self) -> dict:
        return self.__dict__ | {"memo": {}}

    def symbol(self, token: str) -> int:
        found = self.memo.get(token)
        if found is None:
            if len(self.memo) >= MEMO_WORDS:
                self.memo.clear()
            if token[0].isalpha():
                found = _NUMBER["INSULT"] if any(token[:n] in self.begins for n in self.lengths) else self.words.get(token, 0)
            else:
                found = _NUMBER["END" if token[0] in ".!?;\n" else "QUOTE"]
            self.memo[token] = found
        return found

    def counts(self, text: str) -> list[int]:
        """How many of the text's clauses match each pattern."""
        out, symbol = [0] * len(PATTERNS), self.symbol
        text = text.lower()
        found = set(map(symbol, set(_WORD.findall(text))))
        if not (found & {_NUMBER["INSULT"], _NUMBER["HARM"]} or found >= {_NUMBER["FIRST"], _NUMBER["LAST"]}):  # no clause can match
            return out
        state, table = self.start, self.table
        for token in _TOKEN.finditer(text):
            state, match = table[state][symbol(token[0])]
            if match >= 0:
                out[match] += 1
        match = table[state][_NUMBER["END"]][1]  # the text's end closes its last clause
        if match >= 0:
            out[match] += 1
        return out


def learn_insults(sample: DataFrame, learned: int = LEARNED) -> list[str]:
    """Word beginnings that stand in toxic rows of ``sample`` (text, toxic) only.

    A word counts once per pair of neighbouring words, so copies of a text add
    nothing. Beginnings of 4 to 10 letters are tested by likelihood ratio;
    the shortest that hold are kept, each made longer while that loses at most
    a fifth of what it stands for.
    """
    words = F.filter(F.split(F.lower("text"), r"[^\p{L}]+"), lambda w: w != "")
    rows = sample.select("toxic", words.alias("w")).where(F.size("w") > 0)
    place = F.transform("w", lambda w, i: F.struct(w.alias("word"), F.xxhash64(F.get("w", i - 1), F.get("w", i + 1)).alias("near")))
    seen = rows.select("toxic", F.explode(place).alias("x")).select("toxic", "x.*").distinct()
    by_word = seen.groupBy("word").agg(F.sum("toxic").alias("a"), F.sum(1 - F.col("toxic")).alias("c"))
    by_word = staged(by_word)
    total = by_word.agg(F.sum("a").alias("a"), F.sum("c").alias("c")).first()
    if not total.a or not total.c:
        unstaged(by_word)
        return []
    share = total.a / (total.a + total.c)
    begins = by_word.where("length(word) >= 3").select(F.explode(F.expr("transform(sequence(3, least(length(word), 10)), n -> substr(word, 1, n))")).alias("begin"), "a", "c")
    tested = begins.groupBy("begin").agg(F.sum("a").alias("a"), F.sum("c").alias("c")).where("a >= 3 AND a >= 4 * c")
    n = F.col("a") + F.col("c")
    ratio = F.col("a") * F.log(F.col("a") / (n * share)) + F.when(F.col("c") > 0, F.col("c") * F.log(F.col("c") / (n * (1 - share)))).otherwise(0)
    found = tested.withColumn("ratio", ratio).where("ratio >= 12").orderBy(F.desc("ratio"), "begin").limit(learned).collect()
    unstaged(by_word)
    held = {r.begin: (r.a, r.c) for r in found}
    longer = defaultdict(list)
    for begin in sorted(held):
        longer[begin[:-1]].append(begin)
    kept: set[str] = set()
    for begin in sorted(held, key=lambda b: (len(b), b)):
        if any(begin[:n] in kept for n in range(3, len(begin) + 1)):
            continue
        while more := [b for b in longer[begin] if held[b][0] >= 0.8 * held[begin][0]]:
            begin = more[0]
        kept.add(begin)
    return sorted(kept)


def _steps() -> np.ndarray:
    """How the weights of the patterns are made of steps, which are not negative: a row a pattern.

    A kind has four steps: what it weighs plain, how much more aimed, repeated
    and both. So plain never outweighs aimed nor aimed repeated, but repeated
    harm that nobody is to suffer stands apart. What is negated or reported
    weighs MUTED of its plain kind, however often and at whom.
    """
    out = np.zeros((len(PATTERNS), 4 * len(KINDS)))
    for row, p in zip(out, PATTERNS):
        kind = next(k for k in KINDS if p.startswith(k))
        own = row[4 * KINDS.index(kind) :]
        if "-" in p or "'" in p:
            own[0] = MUTED
            continue
        own[0], own[1], own[2] = 1, ">" in p or ("+" in p and kind != "HARM"), "+" in p
        own[3] = "+" in p and ">" in p
    return out


#: Built-in steps of each kind and the intercept: what counts where the labels say nothing.
PRIOR_STEPS = {"INSULT": (5.0, 1.0, 0.0, 1.0), "THREAT": (6.0, 1.0, 0.0, 1.0), "HARM": (0.3, 5.7, 0.0, 1.0)}
PRIOR_INTERCEPT = -3.0


def fit_weights(features: np.ndarray, labels: np.ndarray, ridge: float = 1e-2) -> np.ndarray:
    """Weights of the patterns, the last is the intercept: logistic regression over the steps, drawn to the built-in ones.

    Newton steps over those that aren't held at zero. Patterns that the
    labelled rows don't hold keep their built-in steps; without both labels
    all do.
    """
    steps = _steps()
    prior = np.array([*(x for k in KINDS for x in PRIOR_STEPS[k]), PRIOR_INTERCEPT])
    if len(set(labels.tolist())) < 2:
        return np.append(steps @ prior[:-1], prior[-1])
    x = np.hstack([features @ steps, np.ones((len(features), 1))])
    low = np.append(np.zeros(steps.shape[1]), -np.inf)
    penalty = np.append(np.full(steps.shape[1], ridge), 1e-6)

    def loss(s: np.ndarray) -> float:
        z = x @ s
        return float((np.logaddexp(0, z) - labels * z).sum() + 0.5 * (penalty * (s - prior) ** 2).sum())

    s = prior.copy()
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ s, -30, 30)))
        slope = x.T @ (p - labels) + penalty * (s - prior)
        free = np.flatnonzero((s > low) | (slope < 0))
        bend = (x[:, free] * (p * (1 - p))[:, None]).T @ x[:, free] + np.diag(penalty[free] + 1e-9)
        move, length, before = np.zeros(len(s)), 1.0, loss(s)
        move[free] = -np.linalg.solve(bend, slope[free])
        while length > 1e-6 and loss(np.maximum(low, s + length * move)) > before:
            length /= 2
        after = np.maximum(low, s + length * move)
        done = np.abs(after - s).max() < 1e-7
        s = after
        if done:
            break
    return np.append(steps @ s[:-1], s[-1])


def _matched(docs: DataFrame, grammar: ClauseGrammar, weights: np.ndarray | None, keep: list[str]) -> DataFrame:
    """``keep`` columns with the pattern counts, and the score if there are weights."""
    shared = docs.sparkSession.sparkContext.broadcast((grammar, weights))
    source = docs.select(F.col("text").cast("string").alias("scored_text"), *keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, w = shared.value
        for batch in in_small_batches(batches, 256):
            counts = [own.counts(t) for t in texts_of(batch.column(0))]
            columns = [*batch.columns[1:], pa.array(counts, pa.list_(pa.int64()))]
            if w is not None:
                x = np.array(counts, float).reshape(-1, len(PATTERNS)) @ w[:-1] + w[-1]
                columns.append(pa.array(1 / (1 + np.exp(-np.clip(x, -500, 500)))))
            yield pa.RecordBatch.from_arrays(columns, names=names)
        own.memo.clear()

    fields = [f"{f.name} {f.dataType.simpleString()}" for f in source.schema.fields[1:]]
    fields += ["matches array<long>"] + (["score double"] if weights is not None else [])
    names = [f.split(" ")[0] for f in fields]
    return source.mapInArrow(run, ", ".join(fields))


def train(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> tuple[ClauseGrammar, np.ndarray]:
    """Learn from the rows of ``docs`` (doc_id, text) that ``labels`` marks toxic 0 or 1.

    At most ``sample_rows`` rows are learned from, chosen by hash of the id, one
    of each id (the least text). Without usable labels the built-in words and
    weights are used.
    """
    marks = labels.where("toxic IN (0, 1) AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").cast("long").alias("toxic"))
    marks = marks.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows)
    sample = docs.select("doc_id", F.col("text").cast("string").alias("text")).where("text IS NOT NULL").join(F.broadcast(marks), "doc_id")
    sample = staged(sample.groupBy("doc_id").agg(F.min("text").alias("text"), F.first("toxic").alias("toxic")))
    grammar = ClauseGrammar(learn_insults(sample))
    rows = _matched(sample, grammar, None, ["toxic"]).collect()  # at most sample_rows rows of counts
    unstaged(sample)
    counts = np.array([r.matches for r in rows], float).reshape(-1, len(PATTERNS))
    return grammar, fit_weights(counts, np.array([r.toxic for r in rows], float))


def score(docs: DataFrame, grammar: ClauseGrammar, weights: np.ndarray, keep: list[str]) -> DataFrame:
    """``keep`` columns, ``matches`` per pattern, ``score`` (0 to 1) and ``predicted``.

    Null and empty texts match nothing and get the score of the intercept.
    Every row is scored on its own; repeated rows get the same score.
    """
    return _matched(docs, grammar, weights, keep).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def op1_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("held_out", held_out("doc_id"))
    grammar, weights = train(docs.where("NOT held_out"), table(spark, sf_dir, "labels"))
    return score(docs, grammar, weights, ["doc_id", "held_out"]).select("doc_id", "held_out", "score", "predicted", "matches")
