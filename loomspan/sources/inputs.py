"""Where traces, logs and settings come from."""

from __future__ import annotations

import json
import os
import re
import time
import tomllib
import uuid
from collections.abc import Iterator, Mapping
from contextlib import contextmanager
from datetime import UTC, datetime
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_UNITS = {"ms": 1_000, "s": 1_000_000, "m": 60_000_000, "h": 3_600_000_000, "d": 86_400_000_000}

LEVELS = ["error", "warn", "info", "debug", "trace"]
#: A line of a run log.
LOG_LINE = "timestamp string, level string, target string, fields struct<message:string,error:string,phase:string,micros:bigint>, span struct<name:string>, spans array<struct<name:string>>"
VERDICT_CHARS = 80

DEFAULTS = {"log": {"level": "info", "keep_runs": 20}, "http": {"request_timeout": "30s", "write_concurrency": 8}}


def traces(keys: DataFrame, key: str) -> DataFrame:
    """Roots, one trace a row of ``keys``."""
    return keys.select(F.col(key).cast("bigint").alias("trace_index"))


def trace_range(spark: SparkSession, count: int) -> DataFrame:
    """Root instances 0..count-1."""
    if count < 1:
        raise ValueError("a run needs a trace")
    return traces(spark.range(count), "id")


def duration_micros(text: str) -> int:
    """Micros of a whole positive duration such as 100ms, 30s, 5m, 24h or 7d."""
    found = re.fullmatch(r"(\d+)(ms|s|m|h|d)", text)
    if not found or not int(found[1]):
        raise ValueError(f"not a duration: {text!r}")
    micros = int(found[1]) * _UNITS[found[2]]
    if micros >= 1 << 63:
        raise ValueError(f"too long: {text!r}")
    return micros


def settings(path: str | Path) -> dict:
    """Settings of a TOML file over the defaults; unknown keys are refused."""
    found = tomllib.loads(Path(path).read_text()) if Path(path).exists() else {}
    out = {k: dict(v) for k, v in DEFAULTS.items()}
    for section, values in found.items():
        for key, value in values.items():
            if key not in out.get(section, {}):
                raise ValueError(f"unknown setting {section}.{key}")
            if type(value) is not type(DEFAULTS[section][key]):
                raise ValueError(f"setting {section}.{key} has to be of type {type(DEFAULTS[section][key]).__name__}")
            out[section][key] = value
    duration_micros(out["http"]["request_timeout"])
    if out["log"]["level"].lower() not in LEVELS:
        raise ValueError(f"no log level {out['log']['level']}")
    if out["log"]["keep_runs"] < 1:
        raise ValueError("keep_runs must be above 0")
    if out["http"]["write_concurrency"] < 1:
        raise ValueError("write_concurrency must be above 0")
    return out


def environment(prefix: str, values: Mapping[str, str] = os.environ) -> dict[str, str | None]:
    """Key, project, url and level of the HTTP sink and the log from <prefix>_API_KEY, _PROJECT_ID, _URL and _LOG_LEVEL.

    A project has to be a UUID, a level one of the known; what is unset is None.
    """
    out = {name: values.get(f"{prefix}_{name.upper()}") or None for name in ("api_key", "project_id", "url", "log_level")}
    if out["project_id"]:
        out["project_id"] = str(uuid.UUID(out["project_id"]))
    if out["log_level"] and out["log_level"].lower() not in LEVELS:
        raise ValueError(f"no log level {out['log_level']}")
    return out


def project_root(start: str | Path, marker: str) -> Path | None:
    """The nearest folder, from ``start`` upwards, that holds a folder ``marker``."""
    at = Path(start).resolve()
    return next((p for p in (at, *at.parents) if (p / marker).is_dir()), None)


def parsed(lines: DataFrame, schema: str = LOG_LINE) -> DataFrame:
    """The columns of ``lines`` with the fields of their JSON text ``value`` in place of it; null where it isn't JSON."""
    return lines.withColumn("_line", F.from_json("value", schema)).select(*[c for c in lines.columns if c != "value"], "_line.*")


def run_logs(spark: SparkSession, folder: str) -> DataFrame:
    """Lines of all run logs in order (run, modified, line), with what they hold."""
    text = spark.read.option("pathGlobFilter", "*.jsonl").text(folder)
    place = F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row"))
    return parsed(text.select("value", F.col("_metadata.file_name").alias("run"), F.col("_metadata.file_modification_time").alias("modified"), place.alias("line")))


def rendered(text: F.Column) -> F.Column:
    """A log's line of JSON as people read it: time, level, spans, message and the other fields by key; other text as it is."""
    event = F.try_parse_json(text)
    told = lambda path, kind="string": F.try_variant_get(event, path, kind)
    time = F.substring(F.rtrim(F.coalesce(F.get(F.split(told("$.timestamp"), "T"), F.lit(1)), F.lit("")), F.lit("Z")), 1, 12)
    level = F.coalesce(told("$.level"), F.lit("?"))
    around = F.transform(F.coalesce(told("$.spans", "array<variant>"), F.expr("cast(array() as array<variant>)")), lambda s: F.try_variant_get(s, "$.name", "string"))
    spans = F.array_compact(F.concat(around, F.array(told("$.span.name"))))
    fields = F.coalesce(told("$.fields", "map<string,variant>"), F.expr("cast(map() as map<string,variant>)"))
    others = F.filter(F.array_sort(F.map_keys(fields)), lambda k: k != "message")
    extra = F.array_join(F.transform(others, lambda k: F.concat(F.lit(" "), k, F.lit("="), F.to_json(F.element_at(fields, k)))), "")
    context = F.when(F.size(spans) > 0, F.concat(F.lit("["), F.array_join(spans, "/"), F.lit("] "))).otherwise("")
    padded = F.when(F.char_length(level) < 5, F.rpad(level, 5, " ")).otherwise(level)
    line = F.concat(time, F.lit("  "), padded, F.lit(" "), context, F.coalesce(told("$.fields.message"), F.lit("")), extra)
    return F.when(event.isNull(), text).otherwise(line)


def log_text(spark: SparkSession, folder: str) -> DataFrame:
    """(run, line, text) of all run logs, one readable line an event, in order of run and line."""
    text = spark.read.option("pathGlobFilter", "*.jsonl").text(folder)
    place = F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row"))
    return text.select(F.col("_metadata.file_name").alias("run"), place.alias("line"), rendered(F.col("value")).alias("text"))


def verdicts(lines: DataFrame) -> DataFrame:
    """(run, verdict): ``failed: `` and the first line of the last error, cut at 80 characters with an ellipsis, else ``ok``."""
    message = F.coalesce("fields.error", "fields.message", F.lit("unknown error"))
    last = F.max_by(F.when(F.col("level") == "ERROR", message), F.when(F.col("level") == "ERROR", F.col("line")))
    first = F.regexp_replace(F.substring_index(F.col("last"), "\n", 1), "\r$", "")
    short = F.when(F.char_length(first) > VERDICT_CHARS, F.concat(F.substring(first, 1, VERDICT_CHARS), F.lit("…"))).otherwise(first)
    found = lines.groupBy("run").agg(last.alias("last"))
    return found.select("run", F.when(F.col("last").isNull(), F.lit("ok")).otherwise(F.concat(F.lit("failed: "), short)).alias("verdict"))


def ranked(runs: DataFrame, modified: str, run: str, within: list[str] = ()) -> DataFrame:
    """Adds ``newest``: 1 for the most recent run, later names first among those of one time."""
    newest = Window.partitionBy(*[F.col(c) for c in within]).orderBy(F.desc(modified), F.desc(run))
    return runs.withColumn("newest", F.row_number().over(newest).cast("bigint"))


def last_run(runs: DataFrame, modified: str, run: str) -> DataFrame:
    return runs.orderBy(F.desc(modified), F.desc(run)).limit(1)


def retained(runs: DataFrame, modified: str, run: str, keep: int, within: list[str] = ()) -> DataFrame:
    """Runs that stay when a new one begins: the newest ``keep`` - 1."""
    return ranked(runs, modified, run, within).where(F.col("newest") <= keep - 1).drop("newest")


def perf_report(timings: DataFrame, path: str, duration: str, order: str) -> DataFrame:
    """(path, mean, least, most, first_seen) of durations by span path; ``order`` says what came first."""
    return timings.groupBy(F.col(path).alias("path")).agg(F.avg(duration).alias("mean"), F.min(duration).alias("least"), F.max(duration).alias("most"), F.min(order).alias("first_seen"))


class RunLog:
    """A run's log of JSON lines in ``folder``, of which the newest ``keep`` logs stay.

    The folder ignores itself for version control. Used as a context; errors
    that leave it are logged.
    """

    def __init__(self, folder: str | Path, keep: int = 20, level: str = "info"):
        self.folder, self.keep, self.level, self.began = Path(folder), keep, LEVELS.index(level), time.monotonic()

    def __enter__(self) -> RunLog:
        self.folder.mkdir(parents=True, exist_ok=True)
        (self.folder / ".gitignore").write_text("*\n")
        old = sorted(self.folder.glob("*.jsonl"), key=lambda p: (p.stat().st_mtime, p.name), reverse=True)
        for path in old[self.keep - 1 :]:
            path.unlink()
        self.path = self.folder / f"{datetime.now(UTC):%Y%m%dT%H%M%S%f}.jsonl"
        self.file = self.path.open("w")
        return self

    def write(self, level: str, message: str, **fields) -> None:
        if LEVELS.index(level) <= self.level:
            line = {"timestamp": f"{datetime.now(UTC):%Y-%m-%dT%H:%M:%S.%fZ}", "level": level.upper(), "fields": {"message": message} | fields, "target": "loomspan"}
            self.file.write(json.dumps(line) + "\n")
            self.file.flush()

    @contextmanager
    def phase(self, name: str) -> Iterator[None]:
        """Logs how long what is done inside takes."""
        began = time.perf_counter()
        yield
        self.write("info", "phase", phase=name, micros=round(1e6 * (time.perf_counter() - began)))

    def __exit__(self, kind, error, trace) -> None:
        if error is not None:
            self.write("error", "the run failed", error=str(error))
        self.file.close()
