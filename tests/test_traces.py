import json
import re
import threading
from http.server import BaseHTTPRequestHandler, HTTPServer

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomspan.functions import draws, ids, numbers, objects, samplers, strings
from loomspan.operators import payloads, timeline
from loomspan.plans import shape
from loomspan.plans.queries import NOW, OVER, SHAPE
from loomspan.plans.shape import Choice, Maybe, Repeat, Span, generate, shape_events
from loomspan.sources import inputs, sinks


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_draws_depend_on_their_address_only(spark):
    rows = spark.range(1000).select(draws.draw(1, F.col("id"), "a").alias("x"))
    a, b = rows.repartition(7).toPandas().x, rows.coalesce(1).toPandas().x
    assert sorted(a) == sorted(b)
    assert 0 <= a.min() and a.max() < 1 and abs(a.mean() - 0.5) < 0.05


def test_samplers_keep_their_bounds(spark):
    u, v = draws.draw(1, F.col("id"), "u"), draws.draw(1, F.col("id"), "v")
    x = spark.range(4000).select(
        samplers.range_int(-2, 2, u).alias("r"), samplers.normal(5, 2, u, v).alias("n"), samplers.pareto(2, 3, u).alias("p"), samplers.poisson(4, u).alias("k"),
        samplers.weighted([(F.lit("a"), 1), (F.lit("b"), 0), (F.lit("c"), 3)], u).alias("w"), samplers.chance(0, u).alias("never"), samplers.chance(1, u).alias("always"),
    ).toPandas()
    assert set(x.r) == {-2, -1, 0, 1, 2} and x.p.min() >= 2 and set(x.w) == {"a", "c"}
    assert abs(x.n.mean() - 5) < 0.2 and abs(x.n.std() - 2) < 0.2 and abs(x.k.mean() - 4) < 0.2 and abs(x.k.var() - 4) < 0.5
    assert not x.never.any() and x.always.all() and abs((x.w == "c").mean() - 0.75) < 0.05


def test_samplers_beyond_the_jvm(spark):
    u = lambda i: draws.draw("s", F.col("id"), i)
    made = spark.range(2000).select(samplers.beta(2, 5, u).alias("whole"), samplers.beta(2.0001, 5, u).alias("b"), samplers.poisson(900, u(0)).alias("p"), samplers.poisson(1e12, u(0)).alias("large"))
    x = made.toPandas()
    for b in (x.whole, x.b):
        assert b.between(0, 1).all() and abs(b.mean() - 2 / 7) < 0.02 and abs(b.var() - 10 / 49 / 8) < 0.004
    assert abs(x.p.mean() - 900) < 5 and abs(x.p.var() - 900) < 150 and abs(x.large.mean() / 1e12 - 1) < 1e-6
    assert "Python" not in made._jdf.queryExecution().executedPlan().toString()
    assert x.equals(made.repartition(5).orderBy("p", "b").toPandas().pipe(lambda y: y.set_index("b").loc[x.b].reset_index()[x.columns]))


@pytest.mark.parametrize("a, b", [(0.5, 0.5), (0.05, 2.5), (3.7, 1.2), (40.5, 60.25)])
def test_beta_has_its_distribution(spark, a, b):
    x = np.sort(spark.range(6000).select(samplers.beta(a, b, lambda i: draws.draw("b", F.col("id"), i)).alias("x")).toPandas().x.to_numpy())
    want = np.sort(np.random.default_rng(1).beta(a, b, 200_000))
    assert abs(x.mean() - a / (a + b)) < 5 * np.sqrt(want.var() / 6000) and x.min() >= 0 and x.max() <= 1
    assert max(abs(np.searchsorted(want, np.quantile(x, q)) / len(want) - q) for q in np.linspace(0.05, 0.95, 19)) < 0.025


@pytest.mark.parametrize("mean", [501.0, 2500.5, 1e9])
def test_large_poisson_has_its_distribution(spark, mean):
    x = np.sort(spark.range(6000).select(samplers.poisson(mean, lambda i: draws.draw("p", F.col("id"), i)).alias("x")).toPandas().x.to_numpy())
    want = np.sort(np.random.default_rng(2).poisson(mean, 200_000))
    assert abs(x.mean() - mean) < 5 * np.sqrt(mean / 6000) and abs(x.var() / mean - 1) < 0.1
    assert max(abs(np.searchsorted(want, np.quantile(x, q)) / len(want) - q) for q in np.linspace(0.05, 0.95, 19)) < 0.03


@pytest.mark.parametrize("wrong", [lambda u: samplers.range_int(2, 1, u), lambda u: samplers.choice([], u), lambda u: samplers.weighted([(F.lit(1), 0)], u), lambda u: samplers.chance(1.5, u), lambda u: samplers.poisson(0, u), lambda u: samplers.pareto(0, 1, u), lambda u: samplers.exponential(0, u)])
def test_samplers_refuse_wrong_parameters(spark, wrong):
    with pytest.raises(ValueError):
        wrong(F.lit(0.5))


def test_strings(spark):
    assert one(spark, strings.trim(F.lit("  a b \n"))) == "a b"
    assert one(spark, strings.split(F.lit("a.b..c"), ".")) == ["a", "b", "", "c"]
    assert one(spark, strings.split(F.lit("a\\Eb"), "\\E")) == ["a", "b"]
    assert one(spark, strings.replace(F.lit("aa"), "", "b")) == "aa"
    assert one(spark, strings.length(F.lit("é𝄞"))) == 2
    assert one(spark, strings.format("{}-{}", F.lit(1), F.lit("x"))) == "1-x"
    assert one(spark, strings.float_text(F.lit(7.0))) == "7.0" and one(spark, strings.float_text(F.lit(12345678.0))) == "12345678.0"
    with pytest.raises(Exception, match="null element"):
        one(spark, strings.join(F.array(F.lit("a"), F.lit(None).cast("string")), ","))


def test_numbers(spark):
    assert [one(spark, numbers.round_half_away(F.lit(x))) for x in (2.5, -2.5, 0.4)] == [3, -3, 0]
    assert one(spark, numbers.divide(F.lit(-7), F.lit(2))) == -3 and one(spark, numbers.remainder(F.lit(-7), F.lit(2))) == -1
    with pytest.raises(Exception, match="DIVIDE_BY_ZERO|zero"):
        one(spark, numbers.divide(F.lit(1), F.lit(0)))


def test_ids(spark):
    x = spark.range(500).select(ids.uuid(1, F.col("id")).alias("u"), ids.hex_digits(5, 1, F.col("id")).alias("h"), ids.alphanumeric(8, 1, F.col("id")).alias("a"), ids.hex_digits(0, 1).alias("none")).toPandas()
    assert x.u.is_unique and x.u.str.fullmatch(r"[0-9a-f]{8}-[0-9a-f]{4}-4[0-9a-f]{3}-[89ab][0-9a-f]{3}-[0-9a-f]{12}").all()
    assert x.h.str.fullmatch("[0-9a-f]{5}").all() and x.a.str.fullmatch("[0-9A-Za-z]{8}").all() and (x.none == "").all()


def test_repeat_of_zero_and_below(spark):
    count = lambda n: shape_events(inputs.trace_range(spark, 3), Span("task", "root", children=[Repeat("r", n, [Span("llm", "a")])]), 1)
    assert count(lambda x: F.lit(0)).where("name = 'a'").count() == 0
    assert count(lambda x: F.col("trace_index")).where("name = 'a'").count() == 3
    assert count(lambda x: F.parse_json(F.lit("2"))).where("name = 'a'").count() == 6
    for wrong, kind in ((F.lit(-1), "NegativeRepeatCount"), (F.lit(2.0), "NonIntegerRepeatCount"), (F.parse_json(F.lit("2.5")), "NonIntegerRepeatCount"), (F.parse_json(F.lit('"2"')), "RefShapeMismatch")):
        with pytest.raises(Exception, match=kind):
            count(lambda x, wrong=wrong: wrong).count()
    with pytest.raises(Exception, match="ChanceOutOfRange"):
        shape_events(inputs.trace_range(spark, 3), Span("task", "root", children=[Maybe("m", [Span("llm", "a")], 2.0)]), 1).collect()


def events(spark, shape=SHAPE, n=40, seed=3, **more):
    made = generate(inputs.trace_range(spark, n), shape, seed, NOW, OVER, **more)
    return made.withColumns({f: F.col(f).cast("string") for f in ("input", "output", "expected", "error")})


def test_events_are_linked_and_timed(spark):
    rows = events(spark).toPandas()
    by_id = rows.set_index("span_id")
    assert by_id.index.is_unique and rows.id.is_unique
    for r in rows.itertuples():
        if len(r.span_parents):
            parent = by_id.loc[r.span_parents[0]]
            assert parent.trace_index == r.trace_index and parent.ordinal < r.ordinal <= parent["last"]
            assert parent.start_micros <= r.start_micros and r.end_micros <= parent.end_micros
        else:
            assert r.root_span_id == r.span_id and r.ordinal == 0 and r.type == "task"
    first = rows[rows.ordinal == 0].sort_values("trace_index")
    assert first.start_micros.is_monotonic_increasing and first.start_micros.iloc[0] == NOW - OVER and rows.end_micros.max() <= NOW
    answers = rows[rows.name == "answer"].set_index("trace_index").output
    assert (first.set_index("trace_index").output == answers).all()


def test_ids_of_spans_and_parents_take_one_digest_each(spark):
    rows = spark.range(3).select(F.lit(5).cast("bigint").alias("trace_index"), F.element_at(F.array(F.lit(""), F.lit("0"), F.lit("0.1")), (F.col("id") + 1).cast("int")).alias("place"), F.element_at(F.array(F.lit(None), F.lit(""), F.lit("0")), (F.col("id") + 1).cast("int")).alias("parent"))
    of = lambda place: ids.uuid("run", F.lit(5), F.lit(place))
    made = timeline.linked(rows.withColumn("root_span_id", of("")), "run").select("place", "span_id", "span_parents")
    root, first, second = spark.range(1).select(of(""), of("0"), of("0.1")).first()
    assert sorted(map(tuple, made.collect())) == [("", root, []), ("0", first, [root]), ("0.1", second, [first])]
    assert made._jdf.queryExecution().optimizedPlan().toString().count("md5(") == 2


def test_same_seed_same_events_other_seed_others(spark):
    key = ["trace_index", "ordinal"]
    a, b, other = (events(spark, seed=s).select(*key, "name", "input", "output").orderBy(*key).collect() for s in (3, 3, 4))
    assert a == b and a != other


def test_editing_one_field_leaves_the_others(spark):
    def shape(extra):
        fields = {"input": lambda x: samplers.range_int(0, 999, x.draw("input"))} | extra
        return Span("task", "root", fields, children=[Repeat("r", lambda x: samplers.range_int(0, 3, x.draw("count")), [Span("llm", "call", {"output": lambda x: samplers.range_int(0, 999, x.draw("output"))})])])

    plain = events(spark, shape({})).select("trace_index", "ordinal", "input", "output").collect()
    edited = events(spark, shape({"error": lambda x: samplers.range_int(0, 9, x.draw("error"))})).select("trace_index", "ordinal", "input", "output").collect()
    assert sorted(map(str, plain)) == sorted(map(str, edited))


def test_choice_and_maybe_emit_no_span_of_their_own(spark):
    shape = Span("task", "root", children=[Choice("c", [Span("tool", "a"), Span("tool", "b")]), Maybe("m", [Span("task", "n")], 0.5)])
    rows = events(spark, shape, n=200).toPandas()
    per = rows.groupby("trace_index").name.agg(list)
    assert all(sum(x in ("a", "b") for x in names) == 1 for names in per)
    assert 60 < sum("n" in names for names in per) < 140 and set(rows.name) == {"root", "a", "b", "n"}


def test_window_too_short(spark):
    with pytest.raises(Exception, match="too short"):
        generate(inputs.trace_range(spark, 2), SHAPE, 1, NOW, 1000).select("created").collect()


def test_sine_spread_and_single_trace(spark):
    assert one(spark, F.round(timeline.sine(F.lit(0.5)), 9)) == 0.5
    rows = events(spark, Span("task", "root"), n=1).collect()
    assert rows[0].end_micros == NOW


def test_payloads_pack_greedily(spark):
    rows = spark.createDataFrame([(0, i, "x" * n) for i, n in enumerate([10, 10, 30, 5, 40])] + [(1, 9, "")], "lane long, seq long, body string")
    got = {(r.lane, r.seq): r.payload for r in payloads.packed(rows, "lane", "seq", "body", 53).collect()}
    assert got == {(0, 0): 0, (0, 1): 0, (0, 2): 1, (0, 3): 1, (0, 4): 2, (1, 9): 0}
    with pytest.raises(Exception, match="exceeds"):
        payloads.packed(rows, "lane", "seq", "body", 50).collect()


class Stub(BaseHTTPRequestHandler):
    seen, failures, most = [], 0, 10**9

    def do_POST(self):
        body = self.rfile.read(int(self.headers["Content-Length"]))
        if Stub.failures:
            Stub.failures -= 1
            self.send_response(503)
            self.send_header("Retry-After", "0")
            self.end_headers()
            return
        found = json.loads(body)["events"]
        if len(found) > Stub.most:
            self.send_response(413)
            self.end_headers()
            return
        Stub.seen += found
        self.send_response(200)
        self.end_headers()
        self.wfile.write(json.dumps({"row_ids": [str(i) for i in range(len(found))]}).encode())

    def log_message(self, *a):
        pass


def test_http_sink_retries_and_halves(spark):
    server = HTTPServer(("127.0.0.1", 0), Stub)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    Stub.seen, Stub.failures, Stub.most = [], 2, 3
    rows = events(spark, n=6)
    sent = sinks.write_http(rows, f"http://127.0.0.1:{server.server_port}", "key", workers=2, timeout=5)
    server.shutdown()
    assert sent == rows.count() == len(Stub.seen)
    assert {e["id"] for e in Stub.seen} == {r.id for r in rows.select("id").collect()}
    assert all("error" not in e for e in Stub.seen)


def test_settings_and_durations(tmp_path):
    assert inputs.duration_micros("30s") == 30_000_000 and inputs.duration_micros("7d") == 7 * 86_400_000_000
    for wrong in ("0s", "1w", "-1s", "s", "1.5h"):
        with pytest.raises(ValueError):
            inputs.duration_micros(wrong)
    assert inputs.settings(tmp_path / "none.toml") == inputs.DEFAULTS
    (tmp_path / "a.toml").write_text('[log]\nkeep_runs = 3\n[http]\nrequest_timeout = "5s"\n')
    assert inputs.settings(tmp_path / "a.toml")["log"] == {"level": "info", "keep_runs": 3}
    (tmp_path / "b.toml").write_text("[log]\nunknown = 1\n")
    with pytest.raises(ValueError):
        inputs.settings(tmp_path / "b.toml")


def test_run_logs(spark, tmp_path):
    lines = {"a.jsonl": [("1", "INFO", "fine", None), ("2", "ERROR", "broke", "first\nsecond"), ("3", "INFO", "end", None)], "b.jsonl": [("1", "INFO", "fine", None)], "c.jsonl": [("9", "ERROR", "x" * 90, None), ("1", "ERROR", "x" * 81, None)], "d.jsonl": [("1", "ERROR", None, None)]}
    for name, rows in lines.items():
        (tmp_path / name).write_text("\n".join(json.dumps({"timestamp": t, "level": level, "fields": {"message": m, "error": e}, "target": "x"}) for t, level, m, e in rows))
    got = {r.run: r.verdict for r in inputs.verdicts(inputs.run_logs(spark, str(tmp_path))).collect()}
    assert got == {"a.jsonl": "failed: first", "b.jsonl": "ok", "c.jsonl": "failed: " + "x" * 80 + "…", "d.jsonl": "failed: unknown error"}
    assert [r.fields.message for r in inputs.run_logs(spark, str(tmp_path)).where("run = 'a.jsonl'").orderBy("line").collect()] == ["fine", "broke", "end"]


def test_streamed_events_equal_the_batch(spark, tmp_path):
    spark.range(20).write.parquet(str(tmp_path / "ticks"))
    ticks = spark.readStream.schema("id long").parquet(str(tmp_path / "ticks"))
    stream = shape_events(ticks.select(F.col("id").cast("bigint").alias("trace_index")), SHAPE, 5).select("trace_index", "ordinal", "name", F.col("input").cast("string"), F.col("output").cast("string"))
    query = stream.writeStream.format("memory").queryName("streamed").option("checkpointLocation", str(tmp_path / "state")).start()
    query.processAllAvailable()
    query.stop()
    batch = shape_events(inputs.trace_range(spark, 20), SHAPE, 5).select("trace_index", "ordinal", "name", F.col("input").cast("string"), F.col("output").cast("string"))
    assert sorted(map(str, spark.table("streamed").collect())) == sorted(map(str, batch.collect()))


def test_run_log_keeps_the_newest_and_logs_errors(spark, tmp_path):
    folder = tmp_path / "logs"
    for i in range(4):
        with inputs.RunLog(folder, keep=3) as log, log.phase("plan"):
            log.write("info", f"run {i}")
            log.write("debug", "too fine")
    with pytest.raises(ValueError), inputs.RunLog(folder, keep=3) as log:
        raise ValueError("first line\nsecond")
    found = inputs.run_logs(spark, str(folder))
    assert found.select("run").distinct().count() == 3 and (folder / ".gitignore").read_text() == "*\n"
    got = inputs.verdicts(found).join(found.select("run", "modified").distinct(), "run")
    assert inputs.last_run(got, "modified", "run").first().verdict == "failed: first line"
    assert inputs.retained(got, "modified", "run", 3).count() == 2
    assert inputs.ranked(got, "modified", "run").where("newest = 1").first().verdict == "failed: first line"
    times = found.where("fields.phase IS NOT NULL").select(F.col("fields.phase").alias("phase"), F.col("fields.micros").alias("micros"), "line")
    report = inputs.perf_report(times, "phase", "micros", "line").first()
    assert report.path == "plan" and 0 <= report.least <= report["mean"] <= report.most


def test_environment_and_project_root(tmp_path):
    given = {"X_API_KEY": "k", "X_PROJECT_ID": "12345678-1234-5678-1234-567812345678", "X_URL": "", "X_LOG_LEVEL": "WARN"}
    assert inputs.environment("X", given) == {"api_key": "k", "project_id": given["X_PROJECT_ID"], "url": None, "log_level": "WARN"}
    for wrong in ({"X_PROJECT_ID": "7"}, {"X_LOG_LEVEL": "loud"}):
        with pytest.raises(ValueError):
            inputs.environment("X", wrong)
    (tmp_path / ".own").mkdir()
    (tmp_path / "a" / "b").mkdir(parents=True)
    assert inputs.project_root(tmp_path / "a" / "b", ".own") == tmp_path.resolve() and inputs.project_root("/", ".own-not-there") is None


def test_sinks_keep_the_order_and_sum_up(spark, tmp_path):
    rows = events(spark, n=6)
    sinks.write_files(rows, str(tmp_path / "dry"))
    assert spark.read.text(str(tmp_path / "dry")).count() == rows.count()
    server = HTTPServer(("127.0.0.1", 0), Stub)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    Stub.seen, Stub.failures, Stub.most = [], 0, 10**9
    sent = sinks.sent_payloads(rows, f"http://127.0.0.1:{server.server_port}", "key", workers=1, timeout=5, limit=3000).orderBy("worker", "payload").collect()
    server.shutdown()
    assert [r.payload for r in sent] == list(range(len(sent))) and len(sent) > 1 and sum(r.events for r in sent) == rows.count()
    want = [r.id for r in rows.orderBy("trace_index", "ordinal").select("id").collect()]
    assert [e["id"] for e in Stub.seen] == want
    done = sinks.summary(rows, 3, "p", len(want), 12).first()
    assert (done.seed, done.traces, done.events, done.rows, done.project, done.ms, done.log) == (3, 6, len(want), len(want), "p", 12, None)


# ------------------------------------------------------------------ shapes


def read(spark, *children, n=200, name="reader", **root):
    shape = Span("task", "root", children=list(children), **root)
    rows = shape_events(inputs.trace_range(spark, n), shape, 9).withColumns({f: F.col(f).cast("string") for f in ("input", "output")})
    return rows.where(F.col("name") == name).orderBy("trace_index", "ordinal").collect(), rows


OUT = {"output": lambda x: samplers.range_int(0, 999, x.draw("output"))}


def test_a_branch_that_is_not_taken_reads_as_null(spark):
    way = Choice("way", [Span("tool", "search", {"output": lambda x: F.lit("found")}), Span("tool", "other", {"output": lambda x: F.lit("else")})])
    got, rows = read(spark, way, Span("llm", "reader", {"input": lambda x: x.child("way").child("search").field("output")}), n=200)
    taken = {r.trace_index for r in rows.select("trace_index", "name").where("name = 'search'").collect()}
    assert 60 < len(taken) < 140 and {r.trace_index for r in got if r.input == "found"} == taken and all(r.input in (None, "found") for r in got)


def test_siblings_of_one_name_draw_apart_and_need_a_position(spark):
    two = [Span("llm", "a", OUT), Span("llm", "a", OUT)]
    got, _ = read(spark, *two, name="a")
    assert len({(r.trace_index, r.output) for r in got}) > 390
    got, rows = read(spark, *two, Span("tool", "a", {"output": lambda x: F.lit("tool")}), Span("llm", "reader", {"input": lambda x: x.child("a", "llm", 1).field("output"), "output": lambda x: x.child("a", "tool").field("output")}))
    second = {r.trace_index: r.output for r in rows.where("name = 'a' AND ordinal = 2").collect()}
    assert all(r.input == second[r.trace_index] and r.output == "tool" for r in got)
    with pytest.raises(ValueError, match="name a position"):
        read(spark, *two, Span("llm", "reader", {"input": lambda x: x.child("a").field("output")}))
    with pytest.raises(IndexError):
        read(spark, *two, Span("llm", "reader", {"input": lambda x: x.child("a", position=2).field("output")}))
    with pytest.raises(Exception, match="out of bounds"):
        read(spark, *two, Span("llm", "reader", {"input": lambda x: x.child("a", position=F.lit(5)).field("output")}))


def turns(*children, count=3):
    return Repeat("turn", lambda x: F.lit(count), list(children))


def test_iterations(spark):
    with pytest.raises(ValueError, match="name an iteration"):
        read(spark, turns(Span("llm", "reply", OUT)), Span("llm", "reader", {"input": lambda x: x.child("turn").child("reply").field("output")}))
    with pytest.raises(Exception, match="out of bounds"):
        read(spark, turns(Span("llm", "reply", OUT)), Span("llm", "reader", {"input": lambda x: x.child("turn").iteration(3).child("reply").field("output")}))
    with pytest.raises(Exception, match="negative"):
        read(spark, turns(Span("llm", "reply", OUT)), Span("llm", "reader", {"input": lambda x: x.child("turn").iterations(-1).child("reply").field("output")}))
    slices = {"input": lambda x: F.to_json(x.child("turn").iterations(1, 9).child("reply").field("output")), "output": lambda x: F.to_json(x.child("turn").iterations(2, 1).child("reply").field("output"))}
    got, rows = read(spark, turns(Span("llm", "reply", OUT)), Span("llm", "reader", slices), n=20)
    replies = {}
    for r in rows.where("name = 'reply'").orderBy("ordinal").collect():
        replies.setdefault(r.trace_index, []).append(int(r.output))
    assert all(json.loads(r.input) == replies[r.trace_index][1:] and json.loads(r.output) == [] for r in got)


def test_a_growing_history(spark):
    said = lambda x: x.child("turn").iterations(0, x.index()).child("reply").field("output")
    reply = Span("llm", "reply", {"input": lambda x: F.to_json(said(x))} | OUT, {"seen": lambda x: F.size(said(x))})
    _, rows = read(spark, turns(reply), n=10)
    before = {}
    for r in rows.where("name = 'reply'").orderBy("trace_index", "ordinal").collect():
        history = before.setdefault(r.trace_index, [])
        assert json.loads(r.input) == history and r.metrics["seen"].toPython() == len(history)
        history.append(int(r.output))


def test_references_in_nested_repeats(spark):
    inner = Repeat("call", lambda x: x.index("turn") + 1, [Span("tool", "use", OUT), Span("llm", "reader", {"input": lambda x: x.child("use").field("output"), "output": lambda x: F.to_json(x.child("call").iterations().child("use").field("output"))}, {"at": lambda x: x.index("turn") * 10 + x.index(), "of": lambda x: x.count("call")})])
    got, rows = read(spark, turns(inner), n=15)
    uses = {}
    for r in rows.where("name = 'use'").collect():
        turn, call = map(int, re.fullmatch(r"0\.(\d)\.0\.(\d)\.0", r.place).groups())
        uses[r.trace_index, turn, call] = int(r.output)
    assert len(got) == 15 * 6
    for r in got:
        turn, call = divmod(r.metrics["at"].toPython(), 10)
        assert int(r.input) == uses[r.trace_index, turn, call] and json.loads(r.output) == [uses[r.trace_index, turn, k] for k in range(turn + 1)] and r.metrics["of"].toPython() == turn + 1


def test_variables(spark):
    shape = [Repeat("turn", lambda x: F.lit(2), [Span("llm", "reader", {"input": lambda x: x.var("once"), "output": lambda x: x.var("each")})], {"each": lambda x: samplers.range_int(0, 999, x.draw("v"))})]
    got, _ = read(spark, *shape, n=50, vars={"once": lambda x: samplers.range_int(0, 999, x.draw("v"))})
    by = {}
    for r in got:
        by.setdefault(r.trace_index, []).append((r.input, r.output))
    assert all(a[0] == b[0] for a, b in by.values()) and sum(a[1] != b[1] for a, b in by.values()) > 45
    with pytest.raises(KeyError):
        read(spark, Span("llm", "reader", {"input": lambda x: x.var("nowhere")}))


def test_values_keep_their_kinds(spark):
    fields = {"input": lambda x: F.struct(F.lit(1).alias("a"), F.array(F.lit("x")).alias("b")), "output": lambda x: F.lit(None).cast("string")}
    span = Span("llm", "reader", fields, {"n": lambda x: F.lit(3), "half": lambda x: F.lit(0.5)}, metadata={})
    rows = generate(inputs.trace_range(spark, 2), Span("task", "root", children=[span]), 1, NOW, OVER).where("name = 'reader'")
    got = json.loads(sinks.event_json(rows).first().json)
    assert got["input"] == {"a": 1, "b": ["x"]} and got["output"] is None and "expected" not in got and got["metadata"] == {} and "tags" not in got
    assert got["metrics"]["n"] == 3 and isinstance(got["metrics"]["n"], int) and got["metrics"]["half"] == 0.5 and got["metrics"]["end"] > got["metrics"]["start"]


@pytest.mark.parametrize("wrong", [
    Span("llm", "root"), Span("task", "root", {"inputs": lambda x: F.lit(1)}), Span("task", "root", metrics={"start": lambda x: F.lit(1)}), Span("task", "root", children=[Repeat("r", lambda x: F.lit(1), [])]),
    Span("task", "root", children=[Span("other", "a")]), Span("task", "root", children=["a"]), Span("task", "root", vars={"v": lambda x: F.lit(1)}, children=[Span("llm", "a", vars={"v": lambda x: F.lit(1)})]),
    Span("task", "root", {"input": lambda x: x.field("output"), "output": lambda x: x.field("input")}),
])
def test_shapes_that_make_no_sense_are_refused(spark, wrong):
    with pytest.raises(ValueError):
        shape_events(inputs.trace_range(spark, 1), wrong, 1)


def test_unknown_references_are_refused(spark):
    for field in (lambda x: x.child("none").field("output"), lambda x: x.field("none"), lambda x: x.trace.child("reader").child("reader"), lambda x: x.index("turn"), lambda x: x.chosen):
        with pytest.raises(KeyError):
            read(spark, Span("llm", "reader", {"input": field}))


def test_templates_take_turns_and_indices_must_be_dense(spark):
    shapes = [Span("task", "a"), Span("task", "b", children=[Span("llm", "c")])]
    rows = events(spark, shapes, n=5).orderBy("trace_index", "ordinal").collect()
    assert [(r.trace_index, r.name) for r in rows] == [(0, "a"), (1, "b"), (1, "c"), (2, "a"), (3, "b"), (3, "c"), (4, "a")]
    with pytest.raises(Exception, match="without a gap"):
        generate(spark.range(3, 9).select(F.col("id").alias("trace_index")), shapes, 1, NOW, OVER).select("created").collect()


def test_groups_of_blocks_change_nothing(spark, monkeypatch):
    many = Span("task", "root", {"input": lambda x: F.lit("r")}, children=[Span(("llm", "tool")[i % 2], f"b{i}", OUT if i % 3 else {}, {"n": lambda x, i=i: F.lit(i)} if i % 5 else {}) for i in range(70)])
    plain = lambda: [tuple(map(str, r)) for r in events(spark, many, n=3).orderBy("trace_index", "ordinal").collect()]
    want = plain()
    for size in (1, 200):
        monkeypatch.setattr(shape, "GROUP_BLOCKS", size)
        assert plain() == want


def test_a_chain_of_references_does_not_grow(spark):
    metrics = {"m0": lambda x: samplers.range_int(0, 3, x.draw("m0"))}
    for i in range(1, 30):
        metrics[f"m{i}"] = lambda x, i=i: x.field(f"m{i - 1}") + x.field(f"m{i - 1}")
    rows = shape_events(inputs.trace_range(spark, 3), Span("task", "root", metrics=metrics), 1).collect()
    assert all(r.metrics["m29"].toPython() == 2**29 * r.metrics["m0"].toPython() for r in rows)


def test_objects_indexes_and_slices(spark):
    array = F.array(*map(F.lit, range(5)))
    assert one(spark, objects.index(array, 0)) == 0 and one(spark, objects.index(array, 4)) == 4
    assert [one(spark, objects.part(array, a, b)) for a, b in ((1, 3), (None, 2), (3, None), (4, 9), (7, 9), (3, 1))] == [[1, 2], [0, 1], [3, 4], [4], [], []]
    for wrong in (objects.index(array, -1), objects.index(array, 5), objects.part(array, -1), objects.key(F.create_map(F.lit("a"), F.lit(1)), "b"), objects.drill(F.parse_json(F.lit('{"a": [1]}')), "a", 1)):
        with pytest.raises(Exception, match="out of bounds|negative|no key"):
            one(spark, wrong)
    assert one(spark, objects.spread({"a": F.lit(1), "b": F.lit(2)}, {"a": F.lit(3)})).asDict() == {"a": 3, "b": 2}
    assert one(spark, objects.drill(F.parse_json(F.lit('{"a": [1, {"b": "x"}]}')), "a", 1, "b", kind="string")) == "x"


def test_tokens_of_texts_and_containers(spark, tmp_path):
    import base64

    (tmp_path / "v").write_text("\n".join(f"{base64.b64encode(bytes([i])).decode()} {i}" for i in range(256)))
    count = lambda x: one(spark, strings.tokens(x, str(tmp_path / "v"), r"\w+|\W"))
    assert count(F.lit("ab c")) == 4 and count(F.lit("")) == 0 and count(F.lit(None).cast("string")) is None
    assert one(spark, strings.container_tokens(F.array(F.lit("a"), F.lit(1).cast("string")), str(tmp_path / "v"), r"\w+|\W")) == len('["a","1"]')
