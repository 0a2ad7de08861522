"""Data sources, requests in flight, whole runs and their timing."""

import json
import threading
import time
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest
from pyspark.sql import functions as F

from loomspan.functions import objects
from loomspan.plans import runs
from loomspan.plans.failures import GenerationError
from loomspan.plans.queries import NOW, OVER, SHAPE
from loomspan.plans.shape import Span, generate
from loomspan.sources import formats, inputs, sinks


class Slow(BaseHTTPRequestHandler):
    """Acknowledges after a while; counts what is under way."""

    def do_POST(self):
        own = self.server
        events = json.loads(self.rfile.read(int(self.headers["Content-Length"])))["events"]
        with own.lock:
            own.now += 1
            own.most = max(own.most, own.now)
            own.seen += events
        time.sleep(own.delay)
        with own.lock:
            own.now -= 1
        refused = own.refuse and any(own.refuse in json.dumps(e) for e in events)
        self.send_response(400 if refused else 200)
        self.end_headers()
        self.wfile.write(json.dumps({"row_ids": [e["id"] for e in events[: len(events) - own.short]]}).encode())

    def log_message(self, *args):
        pass


@pytest.fixture
def server():
    own = ThreadingHTTPServer(("127.0.0.1", 0), Slow)
    own.lock, own.now, own.most, own.seen, own.delay, own.refuse, own.short = threading.Lock(), 0, 0, [], 0.0, None, 0
    own.url = f"http://127.0.0.1:{own.server_port}"
    threading.Thread(target=own.serve_forever, daemon=True).start()
    yield own
    own.shutdown()


def made(spark, n=20):
    return generate(inputs.trace_range(spark, n), SHAPE, 5, NOW, OVER)


def test_requests_in_flight_save_time_and_keep_order(server):
    server.delay = 0.1
    payloads = [[json.dumps({"id": i, "n": k}).encode() for k in range(2)] for i in range(24)]
    took = {}
    for window in (1, 4):
        server.most, began = 0, time.perf_counter()
        done = list(sinks.in_order(lambda p: (json.loads(p[0])["id"], sinks.send_payload(server.url, "k", p, 5)), iter(payloads), window))
        took[window] = time.perf_counter() - began
        assert done == [(i, 2) for i in range(24)] and server.most == window
    assert took[4] < took[1] / 2
    with pytest.raises(ValueError):
        list(sinks.in_order(len, iter(payloads), 0))


def test_the_first_failure_stops_what_is_queued():
    sent = []

    def send(payload):
        sent.append(payload[0])
        time.sleep(0.02)
        if payload[0] == 5:
            raise RuntimeError("refused")
        return payload[0]

    got = []
    with pytest.raises(RuntimeError, match="refused"):
        for x in sinks.in_order(send, iter([[i] for i in range(1000)]), 3):
            got.append(x)
    assert got == list(range(5)) and len(sent) < 12


def test_payloads_keep_the_order_and_the_limit():
    events = [b"x" * n for n in (10, 50, 30, 20, 70, 5)]
    parts = list(sinks.payloads_of(iter(events), 100))
    assert sum(parts, []) == events and all(13 + sum(map(len, p)) + len(p) - 1 <= 100 for p in parts) and len(parts) == 3
    with pytest.raises(ValueError, match="exceeds"):
        list(sinks.payloads_of(iter([b"x" * 88]), 100))


def test_window_of_a_sink(spark, server):
    rows = made(spark)
    sent = sinks.sent_payloads(rows, server.url, "k", workers=1, timeout=5, limit=4000, in_flight=5).orderBy("worker", "payload").collect()
    assert [r.payload for r in sent] == list(range(len(sent))) and len(sent) > 5 and sum(r.events for r in sent) == rows.count() == len(server.seen)


def test_traces_are_a_source(spark):
    formats.register(spark)
    read = lambda **o: spark.read.format("traces").options(**o).load()
    rows = read(count=200_003, partitions=7)
    assert rows.rdd.getNumPartitions() == 7 and rows.agg(F.min("trace_index"), F.max("trace_index"), F.count("*"), F.countDistinct("trace_index")).first() == (0, 200_002, 200_003, 200_003)
    assert sorted(r.trace_index for r in read(count=3).collect()) == [0, 1, 2]
    same = lambda roots: [r.span_id for r in generate(roots, SHAPE, 5, NOW, OVER).orderBy("trace_index", "ordinal").select("span_id").collect()]
    assert same(read(count=30)) == same(inputs.trace_range(spark, 30))
    for wrong in ({}, {"count": 0}, {"count": 5, "partitions": 0}):
        with pytest.raises(Exception, match="count"):
            read(**wrong).collect()


def test_traces_are_a_stream_that_goes_on_where_it_was(spark, tmp_path):
    formats.register(spark)

    def go(count):
        source = spark.readStream.format("traces").options(startSeconds=time.time() - 1000, tracesPerSecond=10, count=count, partitions=3).load()
        query = source.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
        query.awaitTermination(120)

    go(25)
    go(40)  # a later query from the same checkpoint adds what has come since
    assert sorted(r.trace_index for r in spark.read.parquet(str(tmp_path / "out")).collect()) == list(range(40))
    stream = formats.TraceStream(formats._Options({"startSeconds": str(time.time() - 3), "tracesPerSecond": "2"}))
    assert 6 <= stream.latestOffset()["traces"] <= 8 and stream.initialOffset() == {"traces": 0}
    assert [(p.first, p.end) for p in stream.partitions({"traces": 5}, {"traces": 7})] == [(5, 6), (6, 7)]


def test_events_are_written_through_a_format(spark, server):
    formats.register(spark)
    rows = made(spark, 10)
    write = lambda: sinks.sorted_json(rows, 3).write.format("event_http").options(url=server.url, key="k", limit=4000, inFlight=2).mode("append").save()
    write()
    assert sorted(e["id"] for e in server.seen) == sorted(r.id for r in rows.select("id").collect())
    first = {e["id"] for e in server.seen}
    write()  # a job or task that runs again sends the same ids
    assert {e["id"] for e in server.seen} == first
    server.short = 1
    with pytest.raises(Exception, match="acknowledged"):
        write()
    writer = formats.HttpWriter({"url": server.url, "key": "k"})
    with pytest.raises(ValueError, match="2 events sent, 1 acknowledged by 1 of 2 tasks"):
        writer.commit([formats.Sent(1, 2, 1), None])


def test_a_whole_run(spark, server, tmp_path):
    with inputs.RunLog(tmp_path / "logs") as log:
        done = runs.run(spark, SHAPE, 12, "24h", seed=5, now_micros=NOW, url=server.url, key="k", project="p", log=log, profile=True)
    assert (done["seed"], done["traces"], done["events"], done["rows"], done["project"]) == (5, 12, len(server.seen), len(server.seen), "p") and set(done["phases"]) == {"generate", "write"}
    lines = inputs.run_logs(spark, str(tmp_path / "logs"))
    assert [r.p for r in lines.where("fields.phase IS NOT NULL").orderBy("line").select(F.col("fields.phase").alias("p")).collect()] == ["generate", "write"] and inputs.verdicts(lines).first().verdict == "ok"
    dry = runs.run(spark, SHAPE, 12, "24h", seed=5, now_micros=NOW, spread="sine", dry_run=str(tmp_path / "dry"))
    assert dry["rows"] is None and dry["events"] == done["events"] and {json.loads(r.value)["span_id"] for r in spark.read.text(str(tmp_path / "dry")).collect()} == {e["span_id"] for e in server.seen}
    assert runs.run(spark, Span("task", "a"), 1, "1s", dry_run=str(tmp_path / "free"))["seed"] >= 0
    for wrong in ({}, {"dry_run": "x", "url": "y"}, {"dry_run": "x", "spread": "none"}):
        with pytest.raises(ValueError):
            runs.run(spark, SHAPE, 1, "1h", **wrong)
    bad = Span("task", "a", {"input": lambda x: objects.index(F.array(F.lit(1)), F.col("trace_index") - 3)})
    with pytest.raises(GenerationError, match="IndexOutOfBounds in trace 0, block /, input"):
        runs.run(spark, bad, 9, "1h", seed=1, dry_run=str(tmp_path / "bad"))


def test_phases_are_timed(spark):
    report = inputs.perf_report(runs.timed(spark, SHAPE, 5, "1h", 2), "path", "micros", "seq").orderBy("first_seen").collect()
    assert [r.path for r in report] == ["run", "run/generate", "run/generate/plan", "run/write"] and all(0 < r.least <= r.mean <= r.most for r in report)
    assert report[0].least > report[1].least > report[2].least
    with pytest.raises(ValueError):
        runs.timed(spark, SHAPE, 5, "1h", 0)


def test_kinds_of_write_errors(server, monkeypatch):
    monkeypatch.setattr(sinks, "FIRST_WAIT", 0.01)

    def kind(events, url=server.url):
        with pytest.raises(sinks.SendError) as e:
            sinks.send_payload(url, "k", events, 5)
        assert e.value.kind in sinks.SendError.KINDS and str(e.value).startswith(e.value.kind)
        return e.value.kind, e.value.status

    server.refuse = "bad"
    assert kind([b'{"id": "bad"}']) == ("Rejected", 400)
    server.refuse, server.short = None, 1
    assert kind([b'{"id": "a"}', b'{"id": "b"}']) == ("UnexpectedRowCount", None)
    assert kind([b'{"id": "a"}'], "http://127.0.0.1:9") == ("RetriesExhausted", None)
    with pytest.raises(sinks.SendError, match="EventTooLarge"):
        list(sinks.payloads_of(iter([b"x" * 100]), 50))
    monkeypatch.setattr(sinks.urllib.request, "urlopen", lambda *a, **k: __import__("io").BytesIO(b"<html>"))
    assert kind([b'{"id": "a"}']) == ("DecodeResponse", None)


def test_logs_are_shown_a_line_an_event(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"timestamp":"2025-01-02T03:04:05.678901Z","level":"INFO","fields":{"message":"m","b":[1,"x"],"a":"y"},"spans":[{"name":"run"},{"id":3}],"span":{"name":"write"}}\nplain text\n{"fields":{}}\n{"level":"WARNING","fields":{"message":"w"}}\n')
    got = [r.text for r in inputs.log_text(spark, str(tmp_path)).orderBy("run", "line").collect()]
    assert got == ['03:04:05.678  INFO  [run/write] m a="y" b=[1,"x"]', "plain text", "  ?     ", "  WARNING w"]


def test_settings_have_types(tmp_path):
    for i, text in enumerate(('[log]\nkeep_runs = "x"\n', '[log]\nlevel = "loud"\n', "[log]\nlevel = 3\n", "[log]\nkeep_runs = 0\n", "[http]\nwrite_concurrency = true\n", '[http]\nrequest_timeout = 5\n')):
        (tmp_path / f"{i}.toml").write_text(text)
        with pytest.raises(ValueError):
            inputs.settings(tmp_path / f"{i}.toml")
