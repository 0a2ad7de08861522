"""Data sources of Spark's own API: ``traces`` to read, batch or stream, and ``event_http`` to write.

    register(spark)
    roots = spark.read.format("traces").option("count", 1_000_000).load()
    sorted_json(events, 8).write.format("event_http").options(url=..., key=...).mode("append").save()
"""

from __future__ import annotations

import time
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, DataSourceWriter, InputPartition, WriterCommitMessage

from loomspan.operators.payloads import PAYLOAD_LIMIT
from loomspan.sources.sinks import SendError, in_order, payloads_of, send_payload

#: Indices of a batch of rows.
BATCH = 1 << 16


@dataclass
class Span(InputPartition):
    """Trace indices from ``first`` to before ``end``."""

    first: int
    end: int


def _rows(part: Span) -> Iterator[pa.RecordBatch]:
    for at in range(part.first, part.end, BATCH):
        yield pa.RecordBatch.from_arrays([pa.array(range(at, min(at + BATCH, part.end)), pa.int64())], names=["trace_index"])


def _parts(first: int, end: int, most: int) -> list[Span]:
    """Ranges of about one size, none empty but where there is nothing at all."""
    n = max(1, min(most, end - first))
    edges = [first + (end - first) * i // n for i in range(n + 1)]
    return [Span(a, b) for a, b in zip(edges, edges[1:])]


class _Options:
    def __init__(self, options: dict):
        self.count = int(options["count"]) if "count" in options else None
        self.partitions = int(options.get("partitions", 8))
        self.per_second, self.start = float(options.get("tracesPerSecond", 10)), float(options.get("startSeconds", "nan"))
        if self.partitions < 1 or (self.count is not None and self.count < 1):
            raise ValueError("traces need a count and partitions above 0")


class TraceReader(DataSourceReader):
    def __init__(self, options: _Options):
        if options.count is None:
            raise ValueError("the option count says how many traces there are")
        self.options = options

    def partitions(self) -> list[Span]:
        return _parts(0, self.options.count, self.options.partitions)

    def read(self, partition: Span) -> Iterator[pa.RecordBatch]:
        return _rows(partition)


class TraceStream(DataSourceStreamReader):
    """Trace indices as time goes: as many as are due since ``startSeconds``, up to ``count``.

    An offset is a number of traces that the clock alone decides, so a query that
    starts again from its checkpoint goes on where it was.
    """

    def __init__(self, options: _Options):
        if options.start != options.start:
            raise ValueError("the option startSeconds says when, in seconds since 1970, the first trace is due")
        self.options = options

    def initialOffset(self) -> dict:
        return {"traces": 0}

    def latestOffset(self) -> dict:
        due = max(0, int((time.time() - self.options.start) * self.options.per_second))
        return {"traces": due if self.options.count is None else min(due, self.options.count)}

    def partitions(self, start: dict, end: dict) -> list[Span]:
        return _parts(start["traces"], max(start["traces"], end["traces"]), self.options.partitions)

    def read(self, partition: Span) -> Iterator[pa.RecordBatch]:
        return _rows(partition)

    def commit(self, end: dict) -> None:
        pass


class TraceSource(DataSource):
    """Options: count, partitions (8); for streams tracesPerSecond (10) and startSeconds."""

    @classmethod
    def name(cls) -> str:
        return "traces"

    def schema(self) -> str:
        return "trace_index bigint"

    def reader(self, schema) -> TraceReader:
        return TraceReader(_Options(self.options))

    def streamReader(self, schema) -> TraceStream:
        return TraceStream(_Options(self.options))


@dataclass
class Sent(WriterCommitMessage):
    """What one task has sent and had acknowledged."""

    payloads: int
    events: int
    acknowledged: int


class HttpWriter(DataSourceWriter):
    def __init__(self, options: dict):
        self.url, self.key, self.timeout = options["url"], options["key"], float(options.get("timeout", 30))
        self.limit, self.in_flight = int(options.get("limit", PAYLOAD_LIMIT)), int(options.get("inFlight", 1))

    def write(self, iterator) -> Sent:
        taken = 0

        def events() -> Iterator[bytes]:
            nonlocal taken
            for row in iterator:
                taken += 1
                yield row[0].encode()

        done = list(in_order(lambda payload: send_payload(self.url, self.key, payload, self.timeout), payloads_of(events(), self.limit), self.in_flight))
        return Sent(len(done), taken, sum(done))

    def commit(self, messages: list[Sent | None]) -> None:
        told = [m for m in messages if m is not None]
        if len(told) < len(messages) or any(m.events != m.acknowledged for m in told):
            raise SendError("UnexpectedRowCount", f"{sum(m.events for m in told)} events sent, {sum(m.acknowledged for m in told)} acknowledged by {len(told)} of {len(messages)} tasks")

    def abort(self, messages: list[Sent | None]) -> None:
        pass  # what was acknowledged stays; ids come from addresses, so sending again replaces it


class EventHttp(DataSource):
    """Writes the first column, events as JSON, in payloads. Options: url, key, timeout, limit, inFlight."""

    @classmethod
    def name(cls) -> str:
        return "event_http"

    def writer(self, schema, overwrite: bool) -> HttpWriter:
        return HttpWriter(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(TraceSource)
    spark.dataSource.register(EventHttp)
