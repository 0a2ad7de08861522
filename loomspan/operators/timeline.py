"""Placement of traces and their events in a past window."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomspan.functions.draws import address
from loomspan.functions.ids import uuid, uuid_of
from loomspan.functions.values import once

SLOT_MICROS = 100_000


def linear(r: Column) -> Column:
    return r


def sine(r: Column) -> Column:
    return F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), 1 - 2 * r))) / math.pi


def totals(events: DataFrame) -> DataFrame:
    """One row: events of the longest trace, and traces. Reads no field of the events."""
    return checked_totals(events.groupBy("trace_index").agg(F.count("*").alias("events")))


def checked_totals(counts: DataFrame) -> DataFrame:
    """One row, longest and traces, of (trace_index, events); indices have to run from 0 without a gap."""
    found = counts.agg(F.max("events").alias("longest"), F.count("*").alias("traces"), F.min("trace_index").alias("low"), F.max("trace_index").alias("high"))
    dense = (F.col("traces") == 0) | ((F.col("low") == 0) & (F.col("high") == F.col("traces") - 1))
    return found.select("longest", F.when(dense, F.col("traces")).otherwise(F.raise_error(F.lit("trace indices have to run from 0 without a gap")).cast("bigint")).alias("traces"))


def anchored(rows: DataFrame, whole: DataFrame, place: Column, now_micros: int, over_micros: int, spread=linear) -> DataFrame:
    """Adds ``anchor`` in micros, from each trace's place (from 0) among all.

    ``whole`` is the one row of ``totals``. The longest trace must fit the window.
    """
    usable = F.lit(over_micros) - F.col("longest") * SLOT_MICROS
    checked = F.when(usable < 0, F.raise_error(F.lit("the window is too short")).cast("bigint")).otherwise(usable)
    ratio = F.when(F.col("traces") == 1, F.lit(1.0)).otherwise(place / (F.col("traces") - 1))
    at = F.lit(now_micros - over_micros) + F.floor(checked * spread(ratio))
    return rows.crossJoin(F.broadcast(whole)).withColumn("anchor", at).drop("longest", "traces")  # one row


def slots(events: DataFrame) -> DataFrame:
    """Start and end micros of each event from anchor, ordinal and last."""
    return events.withColumns({"start_micros": F.col("anchor") + F.col("ordinal") * SLOT_MICROS, "end_micros": F.col("anchor") + (F.col("last") + 1) * SLOT_MICROS})


def created(micros: Column) -> Column:
    """RFC 3339 text in UTC with microseconds; the session's zone must be UTC."""
    return F.date_format(F.timestamp_micros(micros), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")


def linked(events: DataFrame, salt: str) -> DataFrame:
    """Ids by address: the own and the parents' span ids, without a join.

    ``place`` and ``parent`` are the addresses of the event's span and of the
    span above it; ``root_span_id`` is the id of the root, whose address is empty.
    """
    # digests are columns of their own, as each piece of an id reads them; taking one in a lambda keeps
    # the wide projection below out of one generated method, which would be too long for the JVM to compile
    digest = lambda place: F.when(place != "", F.md5(address(salt, F.col("trace_index"), place)))
    rows = events.withColumns({"_own": digest(F.col("place")), "_above": once(F.col("parent"), digest)})
    root = F.col("root_span_id")
    ids = {"span_id": F.when(F.col("place") == "", root).otherwise(uuid_of(F.col("_own"))), "_above": F.when(F.col("parent") == "", root).otherwise(uuid_of(F.col("_above")))}
    parents = F.when(F.col("_above").isNull(), F.expr("cast(array() as array<string>)")).otherwise(F.array("_above"))
    named = rows.withColumns({"id": uuid(f"{salt}/event", F.col("trace_index"), F.col("place"))} | ids)
    return named.withColumn("span_parents", parents).drop("_own", "_above")
