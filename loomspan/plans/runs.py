"""Whole runs: generate and write with one call, and time the phases of generation."""

from __future__ import annotations

import secrets
import time
from collections.abc import Sequence
from contextlib import contextmanager, nullcontext

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from loomspan.operators import timeline
from loomspan.plans.failures import located
from loomspan.plans.shape import Span, generate
from loomspan.sources import sinks
from loomspan.sources.inputs import DEFAULTS, RunLog, duration_micros, trace_range

SPREADS = {"linear": timeline.linear, "sine": timeline.sine}


def run(
    spark: SparkSession, shapes: Span | Sequence[Span], count: int, over: str, *, spread: str = "linear", seed: int | None = None, now_micros: int | None = None,
    dry_run: str | None = None, url: str | None = None, key: str | None = None, project: str | None = None, settings: dict = DEFAULTS, log: RunLog | None = None, profile: bool = False,
) -> dict:
    """Generate ``count`` traces over the past ``over`` (30s, 7d, ...) and write them: to files under ``dry_run``, or to ``url``.

    Returns the run's summary: seed (drawn where none is given), traces, events,
    rows acknowledged, project, milliseconds and the log, and with ``profile``
    the micros of each phase. Errors of generation name the first failing value
    in the order of traces.
    """
    if (dry_run is None) == (url is None):
        raise ValueError("a run writes to files or to an endpoint")
    if spread not in SPREADS:
        raise ValueError(f"no spread {spread}")
    began, phases = time.perf_counter(), {}
    seed = secrets.randbits(63) if seed is None else seed
    now = time.time_ns() // 1000 if now_micros is None else now_micros
    roots = trace_range(spark, count)

    @contextmanager
    def phase(name: str):
        at = time.perf_counter()
        with log.phase(name) if log else nullcontext():
            yield
        phases[name] = round(1e6 * (time.perf_counter() - at))

    with located(roots, shapes, seed):
        with phase("generate"):
            events = generate(roots, shapes, seed, now, duration_micros(over), SPREADS[spread])
        with phase("write"):
            if dry_run is not None:
                seen, rows = Observation("events"), None
                sinks.write_files(events.observe(seen, F.count("*").alias("events")), dry_run)
                written = seen.get["events"]
            else:  # all that is sent has been acknowledged
                http = settings["http"]
                written = rows = sinks.write_http(events, url, key, http["write_concurrency"], duration_micros(http["request_timeout"]) / 1e6)
    out = {"seed": seed, "traces": count, "events": written, "rows": rows, "project": project, "ms": round(1e3 * (time.perf_counter() - began)), "log": str(log.path) if log else None}
    if log:
        log.write("info", "the run is written", **{k: str(v) for k, v in out.items()})
    return out | ({"phases": phases} if profile else {})


def timed(spark: SparkSession, shapes: Span | Sequence[Span], count: int, over: str, iterations: int, seed: int = 0) -> DataFrame:
    """(path, micros, rows, seq) of the phases of ``iterations`` runs: fit for ``perf_report``.

    ``run/generate`` builds the plan, ``run/generate/plan`` has Spark optimise
    it, ``run/write`` evaluates all columns of all events.
    """
    if iterations < 1:
        raise ValueError("a report needs an iteration")
    found: list[tuple[str, int, int | None]] = []
    for i in range(iterations):
        start = time.perf_counter()
        events = generate(trace_range(spark, count), shapes, seed, time.time_ns() // 1000, duration_micros(over))
        built = time.perf_counter()
        seen = Observation(f"timed {i}")
        counted = events.observe(seen, F.count("*").alias("events"))
        counted._jdf.queryExecution().executedPlan()
        planned = time.perf_counter()
        counted.write.format("noop").mode("overwrite").save()
        end = time.perf_counter()
        for path, a, b, rows in (("run", start, end, None), ("run/generate", start, planned, None), ("run/generate/plan", built, planned, None), ("run/write", planned, end, seen.get["events"])):
            found.append((path, round(1e6 * (b - a)), rows))
    return spark.createDataFrame([(p, m, r, i) for i, (p, m, r) in enumerate(found)], "path string, micros bigint, rows bigint, seq bigint")
