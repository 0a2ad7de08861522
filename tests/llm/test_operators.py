"""The training-data operators against brute force, and on awkward inputs."""

import hashlib
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pandas as pd
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from loomspan.llm import chat_format, common, knn, language_id, mixing, packing, quality_rules, simhash, substring_dedup, token_count, toxicity
from loomspan.llm import queries as registered

SMALL = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
#: Nulls, empty and odd texts, repeated rows and ids; columns whose names the operators use inside.
ODD = [
    (1, None, "a"), (2, "", None), (3, " \t\n ", "a"), (4, "one", "b"), (5, "one", "b"), (5, "one", "b"), (5, "two words", "b"), (None, "no id at all", "c"),
    (6, "héé ½ ² <|endoftext|> 中文字 \x1c İ \U0001f642 é", "c"), (7, "x " * 5000, "d"), (8, "<|startoftext|><|endoftext|>", "d"),
]


def frame(spark, rows=ODD):
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    clash = {c: F.lit("clash") for c in ("id", "row", "key", "doc", "size", "score", "words", "kept", "bucket", "node", "n_words", "fingerprint", "place", "hash", "target")}
    return docs.withColumns(clash | {"lang": F.lit("en"), "n_chars": F.lit(0).cast("long")})


def small(spark, name="documents"):
    return spark.read.parquet(f"{SMALL}/{name}.parquet")


def words(text):
    return WORD.findall(text or "")


@pytest.mark.parametrize("name", sorted(registered.queries()))
def test_query_runs_and_matches_its_sql(spark, name):
    got = registered.queries()[name](spark, SMALL)
    rows = got.collect()
    assert rows
    if sql := registered.oracle_sql().get(name):
        con = duckdb.connect()
        for t in ("documents", "embeddings", "conversations", "labels", "benchmark"):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
        want = con.execute(sql)
        names = [x[0] for x in want.description]
        assert sorted(names) == sorted(got.columns)
        assert sorted(map(tuple, want.fetchall())) == sorted(tuple(r[n] for n in names) for r in rows)
    if name not in ("op2_packing", "op7_chat_format", "op10_kdtree_topk", "op11_whitening", "op13_ranked_search"):
        assert len(rows) == small(spark).count()


# ------------------------------------------------------------------ toxicity


def toxic_docs(spark, n=400):
    rng = random.Random(5)
    plain = ["".join(rng.choices("abcdefgh", k=6)) for _ in range(300)]
    docs, labels = [], []
    for i in range(n):
        text, toxic = rng.choices(plain, k=60), int(i % 5 == 0)
        if toxic:
            for _ in range(3):
                text.insert(rng.randrange(60), rng.choice(["zork" + x for x in ("ish", "ed", "al", "ing")]))
        docs.append((i, " ".join(text) + ".")), labels.append((i, toxic))
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")


def test_toxicity_learns_word_beginnings_and_holds_out(spark):
    docs, labels = toxic_docs(spark)
    docs = docs.withColumn("held_out", common.held_out("doc_id"))
    grammar, weights = toxicity.train(docs.where("NOT held_out"), labels)
    assert grammar.begins == {"zork"}
    got = toxicity.score(docs, grammar, weights, ["doc_id", "held_out"]).join(labels, "doc_id").toPandas()
    assert (got.predicted == got.toxic).all() and got.score.between(0, 1).all() and got.held_out.any()


def test_clauses_are_matched_not_words():
    grammar = toxicity.ClauseGrammar(["zork"])
    count = lambda text: {toxicity.PATTERNS[i]: n for i, n in enumerate(grammar.counts(text)) if n}
    assert count("You are a zorker. A zork.") == {"INSULT>": 1, "INSULT": 1}
    assert count("zork, you") == {"INSULT>": 1} and count("A zork and zork!") == {"INSULT+": 1}
    assert count("She is not a zork") == {"INSULT->": 1} and count("not at all, yes. zork") == {"INSULT": 1}
    assert count("they said: zork") == count("he said zork") == {"INSULT'>": 1}
    assert count("never said you zork") == {"INSULT-'>": 1}
    assert count('he wrote "A zork. Zork you." Zork.') == {"INSULT'>": 2, "INSULT": 1} and count('a "zork" of words') == {"INSULT": 1}
    assert count("I will kill you") == {"THREAT>": 1} and count("kill you") == {"HARM>": 1} and count("I will not kill you") == {"THREAT->": 1}
    assert count("kill the process") == {"HARM": 1} and count("shut up") == {"INSULT": 1} and count("what the hell") == {}
    assert count("") == {} and count("fine words only") == {}


def brute_clauses(symbols):
    """The grammar, clause by clause, without transducers."""
    symbols, quoted, out = [*symbols, "END"], False, Counter()
    while symbols:
        end = symbols.index("END")
        clause, symbols = symbols[:end], symbols[end + 1 :]
        found, aimed, reported, denied, waiting = [], False, quoted, 0, (None, 0)
        for x in clause:
            kind = x
            if x == "INTENT":
                kind, waiting = "OTHER", ("intent", 4)
            elif x == "FIRST":
                kind, waiting = "OTHER", ("first", 3)
            elif x == "LAST":
                kind, waiting = ("INSULT" if waiting[0] == "first" else "OTHER"), (None, 0)
            elif x == "HARM":
                kind, waiting = ("THREAT" if waiting[0] == "intent" else "HARM"), (None, 0)
            if x in ("INTENT", "FIRST", "OTHER", "TARGET", "NEGATION") and waiting[0]:
                waiting = (waiting[0], waiting[1] - 1) if waiting[1] > 1 else (None, 0)
            if kind == "NEGATION":
                denied = 3
                continue
            mark = ""
            if kind in toxicity.KINDS:
                mark, denied = "-" * bool(denied), 0
                found.append((kind, mark + "'" * reported))
            elif kind in ("OTHER", "TARGET", "REPORT") and denied:
                denied -= 1
            if kind == "REPORT":
                reported = True
            elif kind == "QUOTE":
                quoted = reported and not quoted
                reported = quoted
            aimed |= kind == "TARGET"
        if found:
            rank = lambda x: (x[1] == "", "-" not in x[1], ["HARM", "INSULT", "THREAT"].index(x[0]))
            best = max(found, key=rank)
            out[best[0] + "+" * (found.count(best) > 1) + best[1] + ">" * aimed] += 1
    return out


def test_grammar_equals_brute_force_on_random_clauses():
    grammar = toxicity.ClauseGrammar([])
    words = {"OTHER": "fine", "INSULT": "idiot", "HARM": "kill", "INTENT": "will", "TARGET": "you", "NEGATION": "not", "REPORT": "said", "FIRST": "shut", "LAST": "up", "QUOTE": '"', "END": "."}
    rng = random.Random(12)
    for _ in range(3000):
        symbols = rng.choices(list(words), k=rng.randint(1, 14))
        got = grammar.counts(" ".join(words[x] for x in symbols))
        assert Counter({toxicity.PATTERNS[i]: n for i, n in enumerate(got) if n}) == brute_clauses(symbols), symbols


def test_composition_is_the_transducers_in_turn():
    one, two = toxicity._negation(), toxicity._reported()
    both = one.then(two, toxicity.SYMBOLS)
    rng = random.Random(1)
    for _ in range(200):
        a, b, ab = one.start, two.start, both.start
        for symbol in rng.choices(toxicity.SYMBOLS, k=8):
            middle, a = one.step(a, symbol)
            out, b = two.step(b, middle)
            got, ab = both.step(ab, symbol)
            assert got == out


def test_the_clause_decides_not_the_number_of_insults(spark):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    grammar, weights = toxicity.train(frame(spark), none)
    texts = ["You idiot.", "They said you are an idiot and a moron.", "She is not an idiot, never a moron.", "I will kill you.", "Kill the process.", 'He wrote: "Idiot. Moron. Loser."', "idiot"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.predicted for r in toxicity.score(docs, grammar, weights, ["doc_id"]).collect()}
    assert [got[i] for i in range(len(texts))] == [1, 0, 0, 1, 0, 0, 1]


def test_labels_cannot_turn_the_order_of_patterns():
    # labels that speak against the grammar: toxic rows hold negated insults, clean ones plain and repeated
    number = {p: i for i, p in enumerate(toxicity.PATTERNS)}
    rng, rows, labels = np.random.default_rng(3), [], []
    for i in range(600):
        row, toxic = np.zeros(len(number)), i % 2
        for p in rng.choice(["INSULT-", "INSULT->", "THREAT'"] if toxic else ["INSULT", "INSULT+", "INSULT>", "HARM>"], 2):
            row[number[p]] += 1
        rows.append(row), labels.append(toxic)
    for w in (toxicity.fit_weights(np.array(rows), np.array(labels, float)), toxicity.fit_weights(np.array(rows), 1 - np.array(labels, float)), toxicity.fit_weights(np.zeros((0, len(number))), np.zeros(0))):
        at = lambda p: w[number[p]]
        for k in toxicity.KINDS:
            muted = [at(f"{k}{m}{n}{r}{t}") for m in ("", "+") for n in ("", "-") for r in ("", "'") for t in ("", ">") if n or r]
            assert 0 <= min(muted) <= max(muted) <= at(k) <= at(f"{k}>") <= at(f"{k}+>") and at(k) <= at(f"{k}+") <= at(f"{k}+>")
            assert at(k) == 0 or max(muted) < at(k)
        assert at("INSULT>") <= at("INSULT+") and at("THREAT>") <= at("THREAT+")


def test_negation_and_report_lower_a_learned_score(spark):
    grammar, weights = toxicity.train(small(spark), small(spark, "labels"))
    texts = ["This is stupid. That is stupid.", "This is not stupid. That is not stupid.", "They said this is stupid. They said that is stupid.", "fine words " * 5 + "stupid. " * 12]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.score for r in toxicity.score(docs, grammar, weights, ["doc_id"]).collect()}
    assert got[1] < got[0] and got[2] < got[0] and got[3] > got[0]  # each of many clauses counts


def test_toxicity_learns_from_one_row_of_an_id(spark):
    docs = spark.createDataFrame([(1, "b"), (1, "a"), (1, "a"), (2, "c")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (2, 0), (2, 0)], "doc_id long, toxic int")
    seen = []
    real = toxicity.learn_insults
    try:
        toxicity.learn_insults = lambda sample: seen.extend(sample.collect()) or []
        toxicity.train(docs, labels)
    finally:
        toxicity.learn_insults = real
    assert sorted((r.text, r.toxic) for r in seen) == [("a", 1), ("c", 0)]


def test_toxicity_without_labels_and_on_odd_rows(spark):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    grammar, weights = toxicity.train(frame(spark), none)
    got = toxicity.score(frame(spark), grammar, weights, ["doc_id"]).collect()
    assert len(got) == len(ODD) and all(0 <= r.score <= 1 and r.predicted == 0 for r in got)
    assert toxicity.score(frame(spark, []), grammar, weights, ["doc_id"]).count() == 0


# ------------------------------------------------------------------ packing


def test_first_fit_decreasing_is_first_fit():
    rng = random.Random(2)
    sizes = [rng.randint(1, 50) for _ in range(300)]
    got, free, want = packing.first_fit_decreasing(sizes, 64), [], {}
    for i in sorted(range(300), key=lambda i: -sizes[i]):
        at = next((b for b, f in enumerate(free) if f >= sizes[i]), len(free))
        if at == len(free):
            free.append(64)
        want[i] = at, 64 - free[at]
        free[at] -= sizes[i]
    assert dict(enumerate(got)) == want


def test_packing_keeps_every_id_once(spark):
    docs = small(spark).select("doc_id", "text").union(frame(spark).select("doc_id", "text"))
    got = packing.pack_documents(docs, keep_ids=True).toPandas()
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = Counter()
    for doc, text in docs.collect():
        ids = np.array(library.encode(text or "", add_special_tokens=False).ids + [1], "<u4").tobytes()
        for start in range(0, len(ids) // 4, 2048):
            piece = ids[4 * start : 4 * start + 8192]
            want[(doc, start, len(piece) // 4, zlib.crc32(piece), len(ids) // 4, bytes(piece))] += 1
    key = lambda x: None if pd.isna(x) else int(x)
    assert Counter((key(r.id), r.start, r.length, r.ids_crc32, r.doc_tokens, bytes(r.ids)) for r in got.itertuples()) == want
    got = got.sort_values(["sequence_id", "offset"])
    ends = (got.offset + got.length).groupby(got.sequence_id)
    assert (ends.shift(1).fillna(0) == got.offset).all() and ends.max().max() <= 2048
    assert got.length.sum() / (2048 * got.sequence_id.nunique()) > 0.97
    assert packing.pack_documents(frame(spark, [])).count() == 0


def test_packing_parts_equal_rows(spark):
    one = F.when(F.col("i") >= 30_000, F.col("i"))
    docs = spark.range(40_000).withColumnRenamed("id", "i").select(one.alias("doc_id"), F.when(one.isNotNull(), F.concat(F.lit("word "), one)).alias("text"))
    got = packing.pack_documents(docs).groupBy(F.shiftright("sequence_id", 32).alias("g")).count().toPandas()
    assert got["count"].sum() == 40_000 and len(got) == 10 and got["count"].max() < 2 * packing.GROUP_DOCS


# ------------------------------------------------------------------ substring dedup


def brute_substrings(rows, window):
    seen, out = {}, []
    for doc, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        w = (text or "").encode().split()
        gone = [False] * len(w)
        for k in range(len(w) - window + 1):
            s = tuple(w[k : k + window])
            if s in seen:
                gone[k : k + window] = [True] * window
            seen[s] = 1
        kept = [x for x, g in zip(w, gone) if not g]
        out.append((doc, len(w), sum(gone), hashlib.sha256(b" ".join(kept)).hexdigest()))
    return out


def repeating(seed, docs=60):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(40)]
    passages = [rng.choices(vocabulary, k=rng.randint(15, 60)) for _ in range(8)]
    rows = []
    for i in range(docs):
        text = []
        for _ in range(rng.randint(0, 5)):
            text += rng.choices(vocabulary, k=rng.randint(0, 30)) if rng.random() < 0.5 else rng.choice(passages)
        if rng.random() < 0.1:
            text = ["same"] * 70
        rows.append((i, rng.choice([" ", "\n", " \t"]).join(text)))
    return rows


@pytest.mark.parametrize("many, shard", [(4096, 1 << 17), (2, 200), (8, 4000)])
def test_substring_dedup_equals_brute_force(spark, monkeypatch, many, shard):
    monkeypatch.setattr(substring_dedup, "MANY", many)
    monkeypatch.setattr(substring_dedup, "SHARD_WORDS", shard)
    rows = repeating(3)
    got = substring_dedup.dedup_substrings(spark.createDataFrame(rows, "doc_id long, text string"), window=12)
    found = got.collect()
    assert sorted((r.id, r.n_words, r.n_removed, r.kept_sha256) for r in found) == sorted(brute_substrings(rows, 12))
    for r in found:
        assert hashlib.sha256(b" ".join(r.text.encode().split())).hexdigest() == r.kept_sha256


def test_substring_dedup_on_odd_rows(spark):
    got = substring_dedup.dedup_substrings(frame(spark), keep=["source"]).collect()
    assert len(got) == len(ODD)
    by = {(r.id, r.n_words): r for r in got}
    assert by[(7, 5000)].n_removed == 4999 and by[(None, 4)].n_removed == 0 and by[(None, 4)].source == "c"
    assert by[(1, 0)].kept_sha256 == hashlib.sha256(b"").hexdigest()
    assert substring_dedup.dedup_substrings(frame(spark, [])).count() == 0
    twice = [(1, "a b c " * 20)] * 2  # one document that is given twice
    rows = substring_dedup.dedup_substrings(spark.createDataFrame(twice, "doc_id long, text string")).collect()
    assert len(rows) == 2 and rows[0] == rows[1] and 0 < rows[0].n_removed < rows[0].n_words


def test_substring_dedup_tells_rows_without_id_apart(spark):
    seen, pair = {}, None  # texts of one key that agree in the low 24 bits of their hash, of which one repeats itself
    for i in range(40_000):
        text = " ".join([*(f"p{i}x{k}" for k in range(25))] * (1 + i % 2))
        other = seen.setdefault(xxhash.xxh3_64_intdigest(text.encode()) & 0xFFFFFF, (i, text))
        if (other[0] + i) % 2:
            pair = [other[1], text]
            break
    assert pair
    docs = spark.createDataFrame([(None, t) for t in pair], "doc_id long, text string")
    got = sorted((r.n_words, r.n_removed, r.text) for r in substring_dedup.dedup_substrings(docs).collect())
    once, twice = sorted(pair, key=len)
    assert got == [(25, 0, once), (50, 25, " ".join(twice.split()[:25]))]


def test_wavelet_tree_and_index():
    rng = np.random.default_rng(4)
    symbols = rng.integers(0, 37, 500)
    tree = substring_dedup.WaveletTree(symbols)
    for c in (0, 5, 36):
        for at in (0, 1, 63, 64, 65, 500):
            low, high = (tree.bottom(np.array([c]), np.array([x]))[0] for x in (0, at))
            assert high - low == (symbols[:at] == c).sum()
    text = np.concatenate((rng.integers(1, 4, 150), [0], rng.integers(1, 4, 149), [0]))
    values = rng.permutation(len(text))
    index = substring_dedup.FMIndex(text, 6, values)
    sizes = np.array([40, 0, 1, 300])
    codes = np.concatenate((text[30:70], [9], rng.integers(0, 4, 300)))
    codes[40] = 0
    lengths, rows = index.matching_statistics(codes, sizes)
    ends = np.repeat(np.cumsum(sizes), sizes)
    for at, (length, row) in enumerate(zip(lengths.tolist(), rows.tolist())):
        held = lambda n: [i for i in range(len(text) - n + 1) if (text[i : i + n] == codes[at : at + n]).all() and (codes[at : at + n] > 0).all()]  # noqa: B023, E731
        want = max(n for n in range(min(6, ends[at] - at) + 1) if n == 0 or held(n))
        assert length == want
        if length == 6:
            assert index.least[np.searchsorted(index.heads, row, side="right") - 1] == values[held(6)].min()


def test_long_texts_hash_as_short_ones_do(monkeypatch):
    rng = random.Random(2)
    texts = [" ".join("".join(rng.choices("abé", k=rng.randint(1, 30))) for _ in range(400)).encode(), b"", b" x " * 300]
    want = substring_dedup.word_hashes(texts)
    monkeypatch.setattr(substring_dedup, "CHUNK", 16)
    substring_dedup._kept_powers.cache_clear()
    got = substring_dedup.word_hashes(texts)
    substring_dedup._kept_powers.cache_clear()
    assert np.array_equal(got[0], want[0]) and got[1].tolist() == want[1].tolist() == [400, 0, 300]


# ------------------------------------------------------------------ mixing


def test_mixing_hits_its_targets_to_the_word(spark):
    docs = small(spark)
    got = mixing.op4_mixing(spark, SMALL).toPandas()
    sizes = {r.doc_id: len(words(r.text)) for r in docs.collect()}
    assert (got["size"] == got.doc_id.map(sizes)).all() and (got.taken <= 2 * got["size"]).all()
    by = got.groupby("source").agg(size=("size", "sum"), told=("source_size", "first"), target=("target", "first"), taken=("taken", "sum"))
    names, total, targets = sorted(by.index), 1.5 * by["size"].sum(), {}
    weights, free = {n: (5, 2, 1)[i % 3] for i, n in enumerate(names)}, set(names)
    while True:
        rest, weight = total - sum(targets.values()), sum(weights[n] for n in free)
        full = [n for n in free if rest * weights[n] / weight > 2 * by.loc[n, "size"]]
        targets |= {n: 2 * by.loc[n, "size"] for n in full} or {n: rest * weights[n] / weight for n in free}
        free -= set(full)
        if not full:
            break
    assert (by["size"] == by.told).all() and np.allclose(by.target, pd.Series(targets)[by.index]) and (abs(by.taken - by.target) <= 0.5).all()
    assert got.equals(got) and sorted(map(str, mixing.op4_mixing(spark, SMALL).collect())) == sorted(map(str, mixing.op4_mixing(spark, SMALL).collect()))


def test_mixing_parts_equal_rows(spark):
    rows = spark.range(20_000).select(F.when(F.col("id") >= 15_000, F.col("id")).alias("id"), F.lit("a").alias("source"), F.lit(7).cast("long").alias("size"), F.col("id").alias("row"))
    targets = mixing.source_targets(rows).withColumn("blocks", F.lit(79).cast("long"))
    held = [r["count"] for r in mixing.in_blocks(rows, targets).groupBy("block").count().collect()]
    assert len(held) == 79 and max(held) < 2 * 20_000 / 79
    docs = rows.select(F.col("id").alias("doc_id"), F.lit("a b c d e f g").alias("text"), "source")
    got = mixing.mix(docs).toPandas()
    taken = got.draws.map(lambda draws: sum(d["words"] for d in draws))
    assert len(got) == 20_000 and taken.sum() == 210_000 and taken.max() <= 14


def test_mixed_rows_and_odd_rows(spark):
    docs = small(spark)
    mixed = mixing.mix(docs)
    rows = mixing.mixed_rows(docs, mixed).collect()
    taken = {r.id: sum(d.words for d in r.draws) for r in mixed.collect()}
    got = Counter()
    for r in rows:
        got[r.doc_id] += len(words(r.text))
    assert got == Counter({k: v for k, v in taken.items() if v})
    odd = mixing.mix(frame(spark)).collect()
    assert len(odd) == len(ODD) and {r["size"] for r in odd if r.id in (1, 2, 3)} == {0}
    assert mixing.mix(frame(spark, [])).count() == 0 and len(mixing.mix(frame(spark, [(1, None, None), (2, "", "a")])).collect()) == 2


def test_hypergeometric_draws(spark):
    from math import comb

    total, marked, drawn, n = 40, 15, 12, 20_000
    args = [F.lit(x).cast("long") for x in (total, marked, drawn)]
    got = Counter(r.x for r in spark.range(n).select(mixing.hypergeometric(*args, mixing.draw(F.col("id"))).alias("x")).collect())
    for x in range(drawn + 1):
        assert abs(got[x] / n - comb(marked, x) * comb(total - marked, drawn - x) / comb(total, drawn)) < 0.015


def test_quotas_add_up(spark):
    draws = spark.createDataFrame([(1, 1000), (2, 7), (3, 0), (4, 250)], "place int, draws long")
    for r in mixing.shard_quotas(draws, 3).collect():
        assert len(r.ends) == 8 and r.ends == sorted(r.ends) and r.ends[-1] == {1: 1000, 2: 7, 3: 0, 4: 250}[r.place]


# ------------------------------------------------------------------ quality rules


def brute_statistics(text):
    w, lines = words(text), [x for x in (text or "").split("\n") if WORD.search(x)]
    grams = Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4))
    covered = {j for k in range(len(w) - 4) if grams[tuple(w[k : k + 5])] > 1 for j in range(k, k + 5)}
    return len(w), sum(map(len, w)), sum((text or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered)


def test_statistics_equal_brute_force(spark):
    docs = small(spark).select("doc_id", "text").union(frame(spark).select("doc_id", "text"))
    got = quality_rules.text_statistics(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words").collect()
    want = [(r.doc_id, *brute_statistics(r.text)) for r in docs.collect()]
    assert Counter(map(tuple, got)) == Counter(want)


def test_rules_are_learned_and_ordered(spark):
    rng = random.Random(6)
    rows = []
    for i in range(900):
        bad = int(i % 4 == 0)
        symbols = rng.uniform(0.2, 0.6) if bad and i % 8 else rng.uniform(0, 0.05)
        upper = rng.uniform(0.7, 1.0) if bad and not i % 8 else rng.uniform(0, 0.3)
        rows.append((*(float(rng.random()) for _ in quality_rules.FEATURES[:2]), symbols, 0.0, 0.0, 1.0, upper, 0.0, 0.0, 0.1, bad, i % 3 > 0))
    schema = ", ".join([*(f"{f} double" for f in quality_rules.FEATURES), "bad int", "growing boolean"])
    data = spark.createDataFrame(rows, schema).cache()
    rules = quality_rules.learn(data)
    assert {r[0].feature for r in rules} >= {"symbol_share", "upper_share"}
    assert data.where((F.col("bad") == 1) == quality_rules.decision_list(rules)).count() <= 9
    assert quality_rules.learn(data.where("bad = 0")) == [] and quality_rules.decision_list([]) is not None


def test_quality_on_odd_rows(spark):
    rules = [(quality_rules.Condition("n_words", True, 100.0),)]
    got = quality_rules.judged(frame(spark), rules).collect()
    assert len(got) == len(ODD) and not any(r.kept for r in got)
    assert quality_rules.judged(frame(spark, []), rules).count() == 0


# ------------------------------------------------------------------ language identification


def test_language_identification_holds_out(spark):
    got = language_id.op6_language_id(spark, SMALL).join(small(spark).select("doc_id", "lang"), "doc_id").toPandas()
    held = got[got.held_out]
    assert (held.lang == held.lang_pred).mean() > 0.95 and got.score.between(0, 1).all()


def test_filters_return_every_language_of_a_gram():
    grams = [np.random.default_rng(i).integers(-(2**62), 2**62, 3000) for i in range(5)]
    grams[1][:50] = grams[0][:50]
    model = language_id.LanguageFilter(list("abcde"), grams, [1.0] * 5)
    for i, g in enumerate(grams):
        assert (model.languages_of(g.view(np.uint64))[0] >> i & 1).all()
    assert (model.languages_of(grams[0][:50].view(np.uint64))[0] & 3 == 3).all()
    other = np.random.default_rng(9).integers(-(2**62), 2**62, 20_000).view(np.uint64)
    for i in range(5):
        assert abs((model.languages_of(other)[0] >> i & 1).mean() - model.false_rate[i]) < 0.01


def test_filters_have_room_for_many_languages():
    grams = [np.random.default_rng(i).integers(-(2**62), 2**62, 400) for i in range(150)]
    model = language_id.LanguageFilter([str(i) for i in range(150)], grams, [1.0] * 150)
    for i, g in enumerate(grams):
        masks = model.languages_of(g.view(np.uint64))
        assert masks.shape[0] == 3 and (masks[i // 64] >> np.uint64(i % 64) & np.uint64(1)).all()


def test_filters_agree_with_exact_sets_of_grams(spark):
    rows = [r for r in small(spark).select("text", "lang").collect() if r.text][:150]
    langs = sorted({r.lang for r in rows if r.lang})
    sets = [np.unique(language_id._grams([r.text for r in rows if r.lang == lang][:20])[0]).view(np.int64) for lang in langs]
    model = language_id.LanguageFilter(langs, sets, [1.0] * len(langs))
    got, _ = model.predict([r.text for r in rows])
    same = 0
    for r, lang in zip(rows, got):
        grams = language_id._grams([r.text])[0].view(np.int64)
        same += langs[int(np.argmax([np.isin(grams, s).sum() for s in sets]))] == lang
    assert same >= 0.98 * len(rows)


def test_copies_do_not_fill_the_sample(spark, monkeypatch):
    rows = [("aaa bbb ccc", "x")] * 3000 + [(f"text number {i} q{i}", "x") for i in range(40)] + [("zzz yyy", "y")]
    data = spark.createDataFrame(rows, "text string, lang string")
    want = language_id.train(data.distinct())
    got = language_id.train(data)
    assert got.languages == want.languages and np.array_equal(got.slots, want.slots) and np.allclose(got.covers, want.covers)


def test_languages_on_odd_rows(spark):
    model = language_id.train(small(spark).select("text", "lang"))
    got = language_id.identify(frame(spark), model).toPandas()
    assert len(got) == len(ODD) and (got[got.doc_id.isin([1, 2, 3])].lang_pred == "und").all() and (got[got.doc_id.isin([1, 2, 3])].score == 0).all()
    none = language_id.train(frame(spark, []).select("text", "lang"))
    assert set(language_id.identify(frame(spark), none).toPandas().lang_pred) == {"und"}
    assert language_id.identify(frame(spark, []), model).count() == 0


# ------------------------------------------------------------------ chat formatting


def test_chat_round_trip(spark):
    rng, alphabet = random.Random(1), ["<s>", "</s>", "[INST]", "[/INST]", "\\", "\n", "<", "[", "é", "x", " ", "中"]
    rows = [(i % 40, i, rng.choice(["user", "assistant", "system", None, "a\nb\\", "<s>", "\\\\\n"]), None if i % 17 == 0 else "".join(rng.choices(alphabet, k=rng.randint(0, 12)))) for i in range(300)]
    formatted = chat_format.format_turns(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    want = {r[1]: (r[2] or "", r[3] or "") for r in rows}
    for r in formatted.collect():
        assert chat_format.read_turn(r.formatted) == want[r.turn]
        inner = r.formatted[3:-6]
        assert not any(x in inner.replace("[INST] ", "", 1).removesuffix(" [/INST]") for x in chat_format.CONTROLS) or want[r.turn][0] == "user"
        if want[r.turn][0] == "assistant":
            assert chat_format.unescaped(r.formatted[r.loss_start : r.loss_start + r.loss_length]) == want[r.turn][1]
        else:
            assert r.loss_length == 0
    assert chat_format.digest_conversations(chat_format.format_turns(small(spark, "conversations").limit(0))).count() == 0


def test_chat_formatting_on_odd_rows(spark):
    rows = [(None, 1, "user", "no id"), (None, 1, "user", "no id"), (1, None, None, None), (1, None, "assistant", ""), (2, 0, "assistant", "x" * 3_000_000), (3, 1, "b", "tie"), (3, 1, "a", "tie")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({c: F.lit("clash") for c in ("formatted", "loss_start", "n_turns", "id")})
    got = {r.conv_id: r for r in chat_format.digest_conversations(chat_format.format_turns(turns)).collect()}
    digest = lambda *pairs: hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in pairs).encode()).hexdigest()
    assert got[None].n_turns == 2 and got[None].turns_sha256 == digest(*[("user", "no id")] * 2)
    assert got[1].turns_sha256 == digest(("", ""), ("assistant", "")) and got[1].loss_chars == 0
    assert got[2].loss_chars == 3_000_000 and got[3].turns_sha256 == digest(("a", "tie"), ("b", "tie"))
    assert chat_format.format_turns(turns.limit(0)).count() == 0


# ------------------------------------------------------------------ SimHash


def brute_print(text, k):
    w = text.encode().translate(simhash._LOWER).split()
    if not w:
        return 0
    grams = [b" ".join(w[i : i + k]) for i in range(max(1, len(w) - k + 1))]
    h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash_equals_brute_force(spark):
    docs = small(spark).select("doc_id", "text").where("doc_id < 120").union(frame(spark).select("doc_id", "text").where("doc_id IS NOT NULL"))
    rows = docs.collect()
    got = simhash.simhash_components(docs).collect()
    prints = [brute_print(r.text or "", 4) for r in rows]
    label = [r.doc_id for r in rows]
    while True:
        new = [min(label[j] for j in range(len(rows)) if bin(prints[i] ^ prints[j]).count("1") <= 4) for i in range(len(rows))]
        if new == label:
            break
        label = new
    want = Counter((r.doc_id, p, c) for r, p, c in zip(rows, prints, label))
    assert Counter((r.id, r.fingerprint % 2**64, r.component) for r in got) == want
    assert simhash.simhash_components(frame(spark, [])).count() == 0


@pytest.mark.parametrize("most", [8192, 16])
def test_links_connect_all_in_reach(spark, monkeypatch, most):
    monkeypatch.setattr(simhash, "MOST", most)
    monkeypatch.setattr(simhash, "TILE", most // 8)
    rng = np.random.default_rng(3)
    centres = rng.integers(0, 2**63, 30, dtype=np.uint64)
    prints = set()
    for c in centres.tolist():
        for _ in range(40):
            x = c
            for b in rng.integers(0, 64, rng.integers(0, 4)).tolist():
                x ^= 1 << b
            prints.add(x)
    prints = np.array(sorted(prints), dtype=np.uint64)
    frame_ = spark.createDataFrame([(int(x),) for x in prints.view(np.int64)], "fingerprint long")
    labels = {r.node: r.component for r in common.connected_components(simhash.fingerprint_links(frame_, 4)).collect()}
    near = np.bitwise_count(prints[:, None] ^ prints[None, :]) <= 4
    signed = prints.view(np.int64).tolist()
    for i, j in zip(*np.nonzero(np.triu(near, 1))):
        assert labels[signed[i]] == labels[signed[j]]
    assert len(set(labels.values())) >= 30


def test_components_of_chains(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, 101), (7, 7)]
    got = {r.node: r.component for r in common.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(61)} | {100: 100, 101: 100}


def test_near_duplicates(spark):
    rng = random.Random(8)
    vocabulary = [f"w{i}" for i in range(2000)]
    rows, group = [], {}
    for g in range(40):
        base = rng.choices(vocabulary, k=200)
        for k in range(4):
            text = list(base)
            if k:
                text[rng.randrange(200)] = "changed"
            group[4 * g + k] = g
            rows.append((4 * g + k, " ".join(text)))
    rows += [(500, None), (501, ""), (502, "one"), (502, "one")]
    rows += [(None, rows[0][1]), (None, "none has an id"), (None, "none has an id"), (502, "another of the id")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("clash") for c in ("id", "row", "node", "print", "kept", "component", "first")})
    got = simhash.near_duplicates(docs, keep=["row"]).collect()
    assert len(got) == len(rows) and all(r.row == "clash" for r in got)
    assert all(r.component == 4 * group[r.id] for r in got if r.id is not None and r.id < 500)
    assert sorted((r.id, r.component) for r in got if r.id is not None and r.id >= 500) == [(500, 500), (501, 500), (502, 502), (502, 502), (502, 502)]
    assert sorted(str(r.component) for r in got if r.id is None) == ["0", "None", "None"]
    assert sum(r["first"] for r in got) == 40 + 4 and all(r.id == r.component for r in got if r["first"] and r.component is not None)
    left = simhash.without_near_duplicates(docs, keep=["row"]).collect()
    assert Counter((r.id, r.text) for r in left) == Counter((r.id, r.text) for r in got if r["first"])
    assert simhash.near_duplicates(docs.limit(0)).count() == 0


def jaccard(a, b):
    a, b = ({tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} for w in (a.split(), b.split()))
    return len(a & b) / len(a | b)


def test_near_duplicates_link_at_the_similarity_exactly(spark):
    rows, texts = [], {}
    for common in (156, 160, 164, 4):  # of 200 or, in tiny texts, of five shingles: 0.78, 0.80, 0.82 and 0.80
        union = 200 if common > 4 else 5
        for k in range(80):
            word = lambda side, n: [f"{common}x{k}{side}{i}" for i in range(n)]
            shared, more = word("s", common + 4), union - common
            texts[common, k] = [" ".join(shared + word("a", more // 2)), " ".join(shared + word("b", more - more // 2))]
            rows += [(len(rows) + i, t) for i, t in enumerate(texts[common, k])]
    for (common, _), (a, b) in texts.items():
        assert jaccard(a, b) == {156: 0.78, 160: 0.8, 164: 0.82, 4: 0.8}[common]
    got = {r.id: r.component for r in simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    linked = Counter(common for n, (common, _) in enumerate(texts) if got[2 * n + 1] == 2 * n)
    assert linked == {160: 80, 164: 80, 4: 80}


@pytest.mark.parametrize("held, most", [(1 << 27, 8192), (1000, 8192), (1 << 27, 24)])
def test_near_duplicates_equal_brute_force_in_large_tiles(spark, monkeypatch, held, most):
    monkeypatch.setattr(simhash, "HELD", held)
    monkeypatch.setattr(simhash, "MOST", most)
    monkeypatch.setattr(simhash, "TILE", most // 8)
    rng = random.Random(11)
    texts = []
    for g in range(4):  # many variants of one text, near the similarity and in one bucket
        base = [f"g{g}w{i}" for i in range(150)]
        for _ in range(60):
            text = list(base)
            for _ in range(rng.randint(0, 7)):
                text[rng.randrange(150)] = f"v{rng.randrange(10**9)}"
            texts.append(" ".join(text))
    want = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if want[i] != want[j] and i // 60 == j // 60 and jaccard(texts[i], texts[j]) >= 0.8:
                low, high = sorted((want[i], want[j]))
                want = [low if x == high else x for x in want]
    assert len(set(want)) > 8
    got = {r.id: r.component for r in simhash.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert [got[i] for i in range(len(texts))] == want


# ------------------------------------------------------------------ token counts


def test_token_counts_equal_the_library(spark):
    docs = small(spark).select("doc_id", "text").union(frame(spark).select("doc_id", "text"))
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = Counter((r.doc_id, len((r.text or "").encode()), len(library.encode(r.text or "", add_special_tokens=False).ids)) for r in docs.collect())
    assert Counter(map(tuple, token_count.count_tokens(docs).select("id", "n_bytes", "n_tokens").collect())) == want
    assert token_count.count_tokens(frame(spark, [])).count() == 0


def test_long_common_pre_tokens_are_in_the_head_table(spark, monkeypatch):
    rule = "=" * 500
    docs = spark.createDataFrame([(i, f"word{i} {rule} " + "-" * (400 + i)) for i in range(300)], "doc_id long, text string")
    path = public_tokenizers.path("byte_bpe_50k.json")
    head = token_count.head_pieces(docs, path)
    assert any(rule in token for token in head)
    want = {r.id: r.n_tokens for r in token_count.count_tokens(docs).collect()}
    monkeypatch.setattr(token_count, "HEAD_BYTES", 2000)
    few = token_count.head_pieces(docs, path)
    assert 0 < sum(len(t.encode()) for t in few) <= 2000 and len(few) < len(head)
    assert {r.id: r.n_tokens for r in token_count.count_tokens(docs).collect()} == want


def test_head_table_changes_nothing(spark, monkeypatch):
    docs = small(spark).where("doc_id < 60")
    a = sorted(map(tuple, token_count.count_tokens(docs).collect()))
    monkeypatch.setattr(token_count, "head_pieces", lambda *_: {})
    assert sorted(map(tuple, token_count.count_tokens(docs).collect())) == a


# ------------------------------------------------------------------ exact search


def brute_top(rows, k=5):
    good = [(i, np.floor(256 * np.array(v, float)).astype(int)) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for q, x in {(i, tuple(v.tolist())) for i, v in good if i % 50 == 0}:
        best = sorted((-int(np.array(x) @ v), i) for i, v in good if i != q and len(v) == len(x))[:k]
        out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(best)]
    return sorted(out)


@pytest.mark.parametrize("shards", [1, 3, 40])
def test_top_k_equals_brute_force(spark, shards):
    rng = np.random.default_rng(5)
    rows = [(i, rng.normal(size=8).round(1).tolist()) for i in range(700)]
    rows += [(1000, None), (1050, [1.0, None] + [0.0] * 6), (1100, [float("nan")] * 8), (1150, [float("inf")] * 8), (1200, []), (None, [1.0] * 8), (350, rows[350][1]), (2000, [1.0, 2.0])]
    rows += [(3000 + i, [1.5] * 8) for i in range(40)]  # ties
    rows += [(351, rows[351][1]), (4000, [2.0] * 8), (4000, [2.0] * 8), (4001, [-(2.0**20)] * 8)]  # repeated rows, and one of large components
    data = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("id", F.lit("clash"))
    got = knn.exact_top_k(data, data.where("vec_id % 50 = 0"), shards=shards)
    assert sorted(map(tuple, got.select("query_id", "rank", "vec_id", "score").collect())) == brute_top(rows)
    none = data.limit(0)
    assert knn.exact_top_k(none, none).count() == 0


def test_tree_prunes():
    rng = np.random.default_rng(6)
    points = np.floor(rng.normal(size=(20_000, 2)) * 256)
    tree = knn.KDTree(np.arange(20_000), points)
    got = tree.search(points[7], 7, 5, None)
    scores = points @ points[7]
    want = sorted(((-s, i) for i, s in enumerate(scores) if i != 7))[:5]
    assert sorted((-s, i) for s, i in got) == [(a, b) for a, b in want]
    worst = min(s for s, _ in got)
    assert tree.search(points[7], 7, 5, worst) and not tree.search(points[7], 7, 5, int(scores.max()) * 10)
