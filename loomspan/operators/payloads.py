"""Greedy packing of serialised events into size-capped payloads."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes a payload may have.
PAYLOAD_LIMIT = 2_621_440
#: ``{"events":[`` and ``]}``.
ENVELOPE = 13


def packed(events: DataFrame, lane: str, order: str, body: str, limit: int = PAYLOAD_LIMIT) -> DataFrame:
    """(lane, order, bytes, payload): each lane packed in order into payloads.

    An event joins the open payload while envelope, events and the commas
    between stay within ``limit``; an event that alone exceeds it is an error.
    A lane streams through one task; payloads never cross lanes, so the number
    of lanes sets how far the work spreads.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, number, used = None, 0, 0
        for batch in batches:
            out = []
            for key, size in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist()):
                if ENVELOPE + size > limit:
                    raise ValueError(f"an event of {size} bytes exceeds the payload limit")
                if key != at:
                    at, number, used = key, 0, ENVELOPE + size
                elif used + 1 + size > limit:
                    number, used = number + 1, ENVELOPE + size
                else:
                    used += 1 + size
                out.append(number)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.int64())], names=["lane", "seq", "bytes", "payload"])

    rows = events.select(F.col(lane).cast("bigint").alias("lane"), F.col(order).cast("bigint").alias("seq"), F.octet_length(body).cast("bigint").alias("bytes"))
    return rows.repartition("lane").sortWithinPartitions("lane", "seq").mapInArrow(run, "lane bigint, seq bigint, bytes bigint, payload bigint")


def pack_stats(payloads: DataFrame) -> DataFrame:
    """(lane, payload, events, body_bytes)."""
    grouped = payloads.groupBy("lane", "payload").agg(F.count("*").alias("events"), F.sum("bytes").alias("content"))
    return grouped.select("lane", "payload", "events", (F.col("content") + F.col("events") - 1 + ENVELOPE).alias("body_bytes"))
