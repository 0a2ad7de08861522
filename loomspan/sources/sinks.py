"""Where events go: JSON rows, files, or an HTTP endpoint."""

from __future__ import annotations

import json
import time
import urllib.error
import urllib.request
from collections import deque
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomspan.operators.payloads import ENVELOPE, PAYLOAD_LIMIT

ATTEMPTS, FIRST_WAIT, LONGEST_WAIT = 4, 0.5, 30.0


def event_json(events: DataFrame) -> DataFrame:
    """(trace_index, ordinal, json): events as JSON objects without what is unset; a null that is set stays."""
    attributes = F.struct("name", "type").alias("span_attributes")
    fields = ["id", "span_id", "root_span_id", "span_parents", "created", attributes, "input", "output", "expected", "error", "metadata", "metrics", "tags"]
    return events.select("trace_index", "ordinal", F.to_json(F.struct(*fields)).alias("json"))


class SendError(ValueError):
    """Why events could not be written: ``kind`` is one of KINDS, ``status`` that of a rejecting endpoint."""

    #: The kinds of errors that a writing run can end in.
    KINDS = ["EventTooLarge", "SendRequest", "Rejected", "DecodeResponse", "UnexpectedRowCount", "RetriesExhausted"]

    def __init__(self, kind: str, message: str, status: int | None = None, retry_after: float | None = None):
        super().__init__(f"{kind}: {message}")
        self.kind, self.status, self.retry_after = kind, status, retry_after

    def __reduce__(self):
        return SendError, (self.kind, str(self).removeprefix(f"{self.kind}: "), self.status, self.retry_after)

    @property
    def passing(self) -> bool:
        """Whether trying again may help: nothing came back, or 429 or 5xx did."""
        return self.kind == "SendRequest" or self.kind == "Rejected" and (self.status == 429 or self.status >= 500)


def _posted(url: str, key: str, body: bytes, timeout: float) -> int:
    """One request; rows acknowledged."""
    request = urllib.request.Request(url, body, {"Content-Type": "application/json", "Authorization": f"Bearer {key}"})
    try:
        with urllib.request.urlopen(request, timeout=timeout) as reply:
            answer = reply.read()
    except urllib.error.HTTPError as e:
        pause = e.headers.get("Retry-After") or ""
        raise SendError("Rejected", f"status {e.code}: {e.read(200).decode(errors='replace')}", e.code, float(pause) if pause.isdigit() else None) from e
    except (urllib.error.URLError, TimeoutError, ConnectionError) as e:
        raise SendError("SendRequest", str(e)) from e
    try:
        return len(json.loads(answer)["row_ids"])
    except (ValueError, KeyError, TypeError) as e:
        raise SendError("DecodeResponse", f"no row ids in {answer[:200]!r}") from e


def _post(url: str, key: str, body: bytes, timeout: float) -> int:
    """Send one payload; timeouts, 429 and 5xx are tried again. Returns rows acknowledged."""
    wait = FIRST_WAIT
    for attempt in range(1, ATTEMPTS + 1):
        try:
            return _posted(url, key, body, timeout)
        except SendError as e:
            if not e.passing:
                raise
            if attempt == ATTEMPTS:
                raise SendError("RetriesExhausted", f"{attempt} attempts, the last: {e}", e.status) from e
            time.sleep(min(wait if e.retry_after is None else e.retry_after, LONGEST_WAIT))
            wait = min(2 * wait, LONGEST_WAIT)
    raise AssertionError("unreachable")


def send_payload(url: str, key: str, events: list[bytes], timeout: float) -> int:
    """Send events; where the endpoint finds them too large, halves go in turn."""
    try:
        done = _post(url, key, b'{"events":[' + b",".join(events) + b"]}", timeout)
    except SendError as e:
        if e.status != 413 or len(events) == 1:
            raise
        half = len(events) // 2
        return send_payload(url, key, events[:half], timeout) + send_payload(url, key, events[half:], timeout)
    if done != len(events):
        raise SendError("UnexpectedRowCount", f"{len(events)} events sent, {done} acknowledged")
    return done


def write_files(events: DataFrame, folder: str) -> None:
    """A dry run: the events as files of JSON lines."""
    event_json(events).select("json").write.text(folder)


def payloads_of(events: Iterator[bytes], limit: int = PAYLOAD_LIMIT) -> Iterator[list[bytes]]:
    """Events in order, in payloads of at most ``limit`` bytes; an event that alone exceeds it is an error."""
    held, used = [], ENVELOPE
    for event in events:
        if ENVELOPE + len(event) > limit:
            raise SendError("EventTooLarge", f"an event of {len(event)} bytes exceeds the payload limit")
        if held and used + 1 + len(event) > limit:
            yield held
            held, used = [], ENVELOPE
        used += len(event) + (1 if held else 0)
        held.append(event)
    if held:
        yield held


def in_order(send: Callable[[list[bytes]], int], payloads: Iterator[list[bytes]], in_flight: int) -> Iterator[int]:
    """What ``send`` says of each payload, in their order, with at most ``in_flight`` of them under way.

    The first that fails ends it: what is queued is cancelled, and no further
    payload is taken.
    """
    if in_flight < 1:
        raise ValueError("a payload has to be in flight")
    with ThreadPoolExecutor(in_flight) as pool:
        waiting: deque = deque()
        try:
            for payload in payloads:
                if len(waiting) == in_flight:
                    yield waiting.popleft().result()
                waiting.append(pool.submit(send, payload))
            while waiting:
                yield waiting.popleft().result()
        finally:
            for future in waiting:
                future.cancel()


def sorted_json(events: DataFrame, workers: int) -> DataFrame:
    """Events as JSON in ``workers`` partitions, each a range of traces in order of trace and event."""
    return event_json(events).repartitionByRange(workers, "trace_index").sortWithinPartitions("trace_index", "ordinal").select("json")


def sent_payloads(events: DataFrame, url: str, key: str, workers: int = 8, timeout: float = 30.0, limit: int = PAYLOAD_LIMIT, in_flight: int = 1) -> DataFrame:
    """Sends the events when it is evaluated: (worker, payload, events), each payload as it is acknowledged.

    ``workers`` partitions send at a time, each its range of traces in order of
    trace and event, so that order by worker and payload is the order of
    submission. Of a partition's payloads ``in_flight`` may be under way at
    once; they are reported in order all the same. The first payload that fails
    for good fails the job. Ids come from addresses, so a task that runs again
    sends the same events.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        events = (text.encode() for batch in batches for text in batch.column(0).to_pylist())
        worker = TaskContext.get().partitionId()
        for number, done in enumerate(in_order(lambda payload: send_payload(url, key, payload, timeout), payloads_of(events, limit), in_flight)):
            yield pa.RecordBatch.from_arrays([pa.array([x], pa.int64()) for x in (worker, number, done)], names=["worker", "payload", "events"])

    return sorted_json(events, workers).mapInArrow(run, "worker bigint, payload bigint, events bigint")


def write_http(events: DataFrame, url: str, key: str, workers: int = 8, timeout: float = 30.0, limit: int = PAYLOAD_LIMIT, in_flight: int = 1) -> int:
    """Send events in payloads under ``limit``; returns rows written."""
    return sent_payloads(events, url, key, workers, timeout, limit, in_flight).agg(F.sum("events")).first()[0] or 0


def summary(events: DataFrame, seed: int, project: str | None = None, rows: int | None = None, millis: int | None = None, log: str | None = None) -> DataFrame:
    """One row: seed, traces, events, rows written, project, milliseconds and the run's log."""
    given = [F.lit(x).cast(kind).alias(name) for name, x, kind in (("rows", rows, "bigint"), ("project", project, "string"), ("ms", millis, "bigint"), ("log", log, "string"))]
    return events.agg(F.count_if(F.col("ordinal") == 0).alias("traces"), F.count("*").alias("events")).select(F.lit(seed).cast("bigint").alias("seed"), "traces", "events", *given)
