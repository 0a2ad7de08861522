"""Registered queries of the trace engine and their SQL.

Rows of the tables stand for traces: an order is a trace, its draws are
addressed by its key. The SQL is written from the semantics, not derived.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspan.functions import ids, numbers, objects, samplers, strings, values
from loomspan.functions.draws import draw
from loomspan.operators import payloads, timeline
from loomspan.plans.shape import Choice, Maybe, Repeat, Span, generate, shape_events
from loomspan.sources import inputs, sinks

SEED = 7
NOW, OVER = 1_750_000_000_000_000, 86_400_000_000
Query = Callable[[SparkSession, str], DataFrame]

_FOUND: dict[str, tuple[Query, str | None]] = {}


def _u(*parts: str) -> str:
    """SQL of a draw; parts are SQL expressions."""
    return f"(CAST(CAST('0x' || substr(md5(concat_ws('|', '{SEED}', {', '.join(parts)})), 1, 13) AS BIGINT) AS DOUBLE) / 4503599627370496::DOUBLE)"


def _add(name: str, sql: str | None):
    def keep(query: Query) -> Query:
        _FOUND[name] = (query, sql)
        return query

    return keep


def _table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _roots(spark: SparkSession, d: str) -> DataFrame:
    return _rooted(spark, d, "orders", "o_orderkey").select("trace_index")


def _rooted(spark: SparkSession, d: str, table: str, key: str) -> DataFrame:
    """A trace for each row of a table, whose columns the fields can read."""
    return _table(spark, d, table).withColumn("trace_index", F.col(key).cast("bigint"))


def _shaped(name: str, table: str, key: str, shape: Span, columns: dict[str, tuple[Callable[[], Column], str]], sql_from: str | None = None, where: str = "ordinal = 0") -> None:
    """Columns of the events that a shape gives over a table, and their SQL."""
    sql = f"{sql_from or ''} SELECT {', '.join(f'{x} AS {c}' for c, (_, x) in columns.items())} FROM {table if sql_from is None else 'x'}"

    @_add(name, sql)
    def _(spark, d):
        return shape_events(_rooted(spark, d, table, key), shape, SEED).where(where).select(*[f().alias(c) for c, (f, _) in columns.items()])


def _key() -> Column:
    return F.col("trace_index")


def _dr(*parts) -> Column:
    return draw(SEED, _key(), *parts)


_TURNS = f"""turns AS (SELECT trace_index, n AS count_turn, unnest(range(n)) AS index_turn FROM
  (SELECT o_orderkey AS trace_index, CAST(floor({_u('o_orderkey', "'/turn'", "'count'", "'0'")} * 4) AS BIGINT) AS n FROM orders))"""


def _turn(*children, **more) -> Repeat:
    return Repeat("turn", lambda x: samplers.range_int(0, 3, x.draw("count")), list(children), **more)


def _told(spark: SparkSession, d: str, *children, **fields) -> DataFrame:
    """Events of a shape over the orders."""
    return shape_events(_roots(spark, d), Span("task", "root", fields, children=list(children)), SEED)


def _path() -> dict:
    return {"input": lambda x: x.path}


def _text(name: str) -> Column:
    return F.col(name).cast("string")


def _metric(name: str) -> Column:
    return F.col("metrics")[name].cast("bigint")


# ---------------------------------------------------------------- sources


@_add("src_trace_range", "SELECT o_orderkey AS trace_index, 0 AS depth FROM orders")
def _(spark, d):
    return _told(spark, d).select("trace_index", F.char_length("place").alias("depth"))


@_add("src_template_cycle", "SELECT o_orderkey AS trace_index, CAST(o_orderkey % 3 AS INTEGER) AS template FROM orders")
def _(spark, d):
    shapes = [Span("task", str(t)) for t in range(3)]
    return shape_events(_roots(spark, d), shapes, SEED).select("trace_index", c("name").cast("int").alias("template"))


@_add("set_union_templates", "SELECT CAST(o_orderkey % 2 AS INTEGER) AS template, count(*) AS traces FROM orders GROUP BY 1")
def _(spark, d):
    shapes = [Span("task", str(t)) for t in range(2)]
    return shape_events(_roots(spark, d), shapes, SEED).groupBy(c("name").cast("int").alias("template")).agg(F.count("*").alias("traces"))


@_add("scan_json_props", "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def _(spark, d):
    return inputs.parsed(_table(spark, d, "events").select("event_id", F.col("props").alias("value")), "k bigint")


# a log line from each event, as it is shown
_LINE = """'{"timestamp":"2025-01-02T03:04:05.' || lpad(CAST(event_id % 1000000 AS VARCHAR), 6, '0') || 'Z","level":"' || upper(event_type) || '","fields":{"user":' || user_id || ',"message":"seen ' || event_id || '","half":0.5},"span":{"name":"write"},"spans":[{"name":"run"}]}'"""


@_add("scan_log_text", """SELECT event_id, CASE event_id % 3 WHEN 0 THEN 'no json ' || event_id ELSE '03:04:05.' || substr(lpad(CAST(event_id % 1000000 AS VARCHAR), 6, '0'), 1, 3) || '  ' || rpad(upper(event_type), CAST(greatest(5, length(event_type)) AS INTEGER), ' ') || ' [run/write] seen ' || event_id || ' half=0.5 user=' || user_id END AS text FROM events""")
def _(spark, d):
    line = F.when(c("event_id") % 3 == 0, F.concat(F.lit("no json "), c("event_id"))).otherwise(F.expr(_LINE.replace("AS VARCHAR", "AS STRING")))
    return _table(spark, d, "events").select("event_id", inputs.rendered(line).alias("text"))


# ---------------------------------------------------------------- sinks


def _uuid_sql(*parts: str) -> str:
    h = f"md5(concat_ws('|', {', '.join(parts)}))"
    variant = f"substr('89ab', CAST(('0x' || substr({h}, 17, 1)) AS INTEGER) % 4 + 1, 1)"
    return f"substr({h}, 1, 8) || '-' || substr({h}, 9, 4) || '-4' || substr({h}, 14, 3) || '-' || {variant} || substr({h}, 18, 3) || '-' || substr({h}, 21, 12)"


_ORDER = Span(
    "task", "order", {"input": lambda x: F.struct(F.col("o_custkey").alias("customer"), F.array(F.lit("a"), F.lit(None).cast("string")).alias("items")), "output": lambda x: F.when(F.col("o_orderstatus") == "F", F.upper("o_orderpriority"))},
    {"tokens": lambda x: F.col("o_custkey") * 2}, ["synthetic", lambda x: F.lower("o_orderstatus")], metadata={"status": lambda x: F.col("o_orderstatus")},
)


@_add("sink_event_json", f"""WITH p AS (SELECT *, {NOW - OVER} + CAST(floor(({OVER} - 100000) * (CAST(o_orderkey AS DOUBLE) / ((SELECT count(*) FROM orders) - 1))) AS BIGINT) AS anchor FROM orders)
SELECT o_orderkey AS trace_index, '{{"id":"' || {_uuid_sql("'run/event'", "o_orderkey", "''")} || '","span_id":"' || {_uuid_sql("'run'", "o_orderkey", "''")} || '","root_span_id":"' || {_uuid_sql("'run'", "o_orderkey", "''")}
  || '","span_parents":[],"created":"' || strftime(make_timestamp(anchor), '%Y-%m-%dT%H:%M:%S.%fZ') || '","span_attributes":{{"name":"order","type":"task"}},"input":{{"customer":' || o_custkey || ',"items":["a",null]}},"output":'
  || CASE WHEN o_orderstatus = 'F' THEN '"' || upper(o_orderpriority) || '"' ELSE 'null' END || ',"metadata":{{"status":"' || o_orderstatus || '"}},"metrics":{{"tokens":' || o_custkey * 2 || ',"start":0,"end":0}},"tags":["synthetic","' || lower(o_orderstatus) || '"]}}' AS json FROM p""")
def _(spark, d):
    events = generate(_rooted(spark, d, "orders", "o_orderkey"), _ORDER, SEED, NOW, OVER)
    # how many digits a double is written with differs between engines
    return sinks.event_json(events).select("trace_index", F.regexp_replace("json", '"(start|end)":[-0-9.E]+', '"$1":0').alias("json"))


_LANE_DOCS, _LIMIT = 2000, payloads.PAYLOAD_LIMIT  # lanes grow with the table
_PACKED = f"""RECURSIVE src AS (
  SELECT CAST(doc_id // {_LANE_DOCS} AS BIGINT) AS lane, CAST(doc_id AS BIGINT) AS seq, CAST(octet_length(encode(coalesce(text, ''))) AS BIGINT) AS bytes,
    row_number() OVER (PARTITION BY doc_id // {_LANE_DOCS} ORDER BY doc_id) AS n FROM documents
), walk AS (
  SELECT lane, seq, bytes, n, CAST(0 AS BIGINT) AS payload, bytes + 13 AS used FROM src WHERE n = 1
  UNION ALL
  SELECT s.lane, s.seq, s.bytes, s.n, CASE WHEN w.used + 1 + s.bytes > {_LIMIT} THEN w.payload + 1 ELSE w.payload END,
    CASE WHEN w.used + 1 + s.bytes > {_LIMIT} THEN 13 + s.bytes ELSE w.used + 1 + s.bytes END
  FROM walk w JOIN src s ON s.lane = w.lane AND s.n = w.n + 1
)"""


def _packed(spark, d):
    docs = _table(spark, d, "documents").withColumn("lane", F.floor(F.col("doc_id") / _LANE_DOCS)).withColumn("body", F.coalesce("text", F.lit("")))
    return payloads.packed(docs, "lane", "doc_id", "body", _LIMIT)


@_add("sink_pack_payloads", f"WITH {_PACKED} SELECT lane, seq, bytes, payload FROM walk")
def _(spark, d):
    return _packed(spark, d)


@_add("sink_pack_stats", f"WITH {_PACKED} SELECT lane, payload, count(*) AS events, CAST(sum(bytes) + count(*) - 1 + 13 AS BIGINT) AS body_bytes FROM walk GROUP BY lane, payload")
def _(spark, d):
    return payloads.pack_stats(_packed(spark, d))


# ---------------------------------------------------------------- blocks


@_add("blk_trace_root", "SELECT o_orderkey AS trace_index, '' AS path, 'task' AS type FROM orders")
def _(spark, d):
    return _told(spark, d, **_path()).select("trace_index", _text("input").alias("path"), "type")


def _span_query(kind: str) -> None:
    @_add(f"blk_span_{kind}", f"SELECT o_orderkey AS trace_index, '/step/inner' AS path, '2.0' AS place, '{kind}' AS type FROM orders")
    def _(spark, d):
        events = _told(spark, d, Span("llm", "a"), Span("llm", "b"), Span("task", "step", children=[Span(kind, "inner", _path())]))
        return events.where("name = 'inner'").select("trace_index", _text("input").alias("path"), "place", "type")


for _kind in ("task", "llm", "tool", "function"):
    _span_query(_kind)


@_add("blk_repeat", f"WITH {_TURNS} SELECT trace_index, index_turn, count_turn, '/turn#' || index_turn || '/reply' AS path FROM turns")
def _(spark, d):
    reply = Span("llm", "reply", _path(), {"i": lambda x: x.index(), "n": lambda x: x.count()})
    return _told(spark, d, _turn(reply)).where("name = 'reply'").select("trace_index", _metric("i").alias("index_turn"), _metric("n").alias("count_turn"), _text("input").alias("path"))


_PICK = f"""CAST(floor({_u('o_orderkey', "'/way'", "'pick'", "'0'")} * 3) AS BIGINT)"""


@_add("blk_choice", f"SELECT o_orderkey AS trace_index, {_PICK} AS chosen, ['a', 'b', 'c'][{_PICK} + 1] AS child FROM orders")
def _(spark, d):
    events = _told(spark, d, Choice("way", [Span("tool", n, {"input": lambda x: x.trace.child("way").chosen}) for n in "abc"]))
    return events.where("name <> 'root'").select("trace_index", c("input").cast("bigint").alias("chosen"), c("name").alias("child"))


@_add("blk_maybe", f"""SELECT o_orderkey AS trace_index FROM orders WHERE {_u('o_orderkey', "'/aside'", "'chance'", "'0'")} < 0.25""")
def _(spark, d):
    return _told(spark, d, Maybe("aside", [Span("task", "note")], 0.25)).where("name = 'note'").select("trace_index")


_TURNS0 = f"""turns AS (SELECT *, unnest(range(n)) AS i FROM (SELECT o_orderkey AS t, *, CAST(floor({_u('o_orderkey', "'/turn'", "'count'", "'0'")} * 4) AS BIGINT) AS n FROM orders))"""


_INPUT, _TOKENS = (lambda: F.col("input").cast("string")), (lambda: F.col("metrics")["tokens"].cast("bigint"))
_TRACE_INDEX = (lambda: F.col("trace_index"))


# a variable of the trace is drawn once, one of the repeat once an iteration
_shaped(
    "blk_vars_scoped", "orders", "o_orderkey",
    Span("task", "root", vars={"size": lambda x: samplers.range_int(1, 9, x.draw("var:size"))}, children=[
        _turn(Span("llm", "call", {"input": lambda x: x.var("step"), "output": lambda x: x.var("size")}, {"tokens": lambda x: x.index("turn")}),
              vars={"step": lambda x: x.var("size") * 10 + samplers.range_int(0, 4, x.draw("var:step"))}),
    ]),
    {"trace_index": (_TRACE_INDEX, "t"), "index_turn": (_TOKENS, "i"), "size": (lambda: F.col("output").cast("bigint"), "size"), "step": (lambda: F.col("input").cast("bigint"), f"""size * 10 + CAST(floor({_u('t', "'/turn#' || i", "'var:step'", "'0'")} * 5) AS BIGINT)""")},
    f"""WITH {_TURNS0}, x AS (SELECT *, 1 + CAST(floor({_u('t', "''", "'var:size'", "'0'")} * 9) AS BIGINT) AS size FROM turns)""", "name = 'call'",
)


@_add("blk_nested_redraw", f"""WITH {_TURNS} SELECT trace_index, index_turn, unnest(range(CAST(floor({_u('trace_index', "'/turn#' || index_turn || '/call'", "'count'", "'0'")} * 3) AS BIGINT))) AS index_call FROM turns""")
def _(spark, d):
    call = Repeat("call", lambda x: samplers.range_int(0, 2, x.draw("count")), [Span("tool", "use", {}, {"i": lambda x: x.index("turn"), "j": lambda x: x.index("call")})])
    return _told(spark, d, _turn(call)).where("name = 'use'").select("trace_index", _metric("i").alias("index_turn"), _metric("j").alias("index_call"))


@_add("blk_preorder", f"""WITH {_TURNS}, e AS (
  SELECT o_orderkey AS trace_index, 'root' AS name, [] :: INTEGER[] AS p FROM orders
  UNION ALL SELECT trace_index, 'turn', [0, CAST(index_turn AS INTEGER)] FROM turns
  UNION ALL SELECT trace_index, 'reply', [0, CAST(index_turn AS INTEGER), 0] FROM turns
  UNION ALL SELECT o_orderkey, 'close', [1] FROM orders
) SELECT trace_index, name, CAST(row_number() OVER (PARTITION BY trace_index ORDER BY p) - 1 AS INTEGER) AS ordinal FROM e""")
def _(spark, d):
    return shape_events(_roots(spark, d), _TREE, SEED).select("trace_index", "name", "ordinal")


_TREE = Span("task", "root", children=[_turn(Span("task", "turn", children=[Span("llm", "reply")])), Span("llm", "close")])


# ---------------------------------------------------------------- fields and expressions


def _simple(name: str, table: str, columns: dict[str, tuple[Callable[[], Column], str]], keys: list[str]) -> None:
    """A projection of one table: keys and named expressions, each with its SQL."""
    sql = f"SELECT {', '.join([*keys, *(f'{s} AS {c}' for c, (_, s) in columns.items())])} FROM {table}"

    @_add(name, sql)
    def _(spark, d):
        return _table(spark, d, table).select(*keys, *[f().alias(c) for c, (f, _) in columns.items()])


c = F.col
_STATE = lambda f: (lambda: F.when(F.col(f).isNull(), F.lit("unset")).when(F.is_variant_null(f), F.lit("null")).otherwise(F.schema_of_variant(f)))


def _field_query(name: str, field: str, value: Callable, value_sql: str, kind_sql: str) -> None:
    columns = {"trace_index": (_TRACE_INDEX, "o_orderkey"), field: (lambda: F.col(field).cast("string"), value_sql), "kind": (_STATE(field), kind_sql), "other": (_STATE("error" if field != "error" else "input"), "'unset'")}
    _shaped(name, "orders", "o_orderkey", Span("task", "order", {field: value}), columns)


_field_query("fld_input", "input", lambda x: strings.template("Order ", c("o_orderkey"), " of ", c("o_custkey")), "'Order ' || o_orderkey || ' of ' || o_custkey", "'STRING'")
_field_query("fld_output", "output", lambda x: F.when(c("o_orderstatus") == "F", F.upper("o_orderpriority")), "CASE WHEN o_orderstatus = 'F' THEN upper(o_orderpriority) END", "CASE WHEN o_orderstatus = 'F' THEN 'STRING' ELSE 'null' END")
_field_query("fld_expected", "expected", lambda x: c("o_totalprice") > 1000, "CASE WHEN o_totalprice > 1000 THEN 'true' ELSE 'false' END", "'BOOLEAN'")
_field_query("fld_error", "error", lambda x: F.when(c("o_orderkey") % 14 == 0, c("o_orderkey")), "CASE WHEN o_orderkey % 14 = 0 THEN CAST(o_orderkey AS VARCHAR) END", "CASE WHEN o_orderkey % 14 = 0 THEN 'BIGINT' ELSE 'null' END")
_shaped("fld_metadata", "customer", "c_custkey", Span("task", "account", metadata={"segment": lambda x: c("c_mktsegment"), "site": lambda x: c("c_nationkey"), "again": lambda x: x.field("metadata.site") + 1}),
        {"c_custkey": (_TRACE_INDEX, "c_custkey"), "metadata": (lambda: F.to_json("metadata"), """'{"segment":"' || c_mktsegment || '","site":' || c_nationkey || ',"again":' || (c_nationkey + 1) || '}'""")})
_shaped("fld_metrics_sum", "part", "p_partkey", Span("task", "part", metrics={"prompt": lambda x: c("p_size").cast("bigint") * 3, "total": lambda x: x.field("prompt") + 11, "cost": lambda x: x.field("metrics.total") * 0.5}),
        {"p_partkey": (_TRACE_INDEX, "p_partkey"), "prompt": (lambda: c("metrics")["prompt"].cast("bigint"), "CAST(p_size AS BIGINT) * 3"), "total": (lambda: c("metrics")["total"].cast("bigint"), "CAST(p_size AS BIGINT) * 3 + 11"),
         "cost": (lambda: c("metrics")["cost"].cast("double"), "(CAST(p_size AS BIGINT) * 3 + 11) * 0.5::DOUBLE"), "kind": (lambda: F.schema_of_variant(c("metrics")["total"]), "'BIGINT'")})
_shaped("fld_tags", "customer", "c_custkey", Span("task", "account", tags=["synthetic", lambda x: F.lower("c_mktsegment")]), {"c_custkey": (_TRACE_INDEX, "c_custkey"), "tags": (lambda: F.array_join("tags", ","), "'synthetic,' || lower(c_mktsegment)")})
_simple("expr_object", "nation", {"json": (lambda: F.to_json(F.struct(c("n_name").alias("name"), F.struct(c("n_regionkey").alias("key")).alias("region"))), """'{"name":"' || n_name || '","region":{"key":' || n_regionkey || '}}'""")}, ["n_nationkey"])
_simple("expr_array", "nation", {"items": (lambda: strings.join(F.array(c("n_nationkey"), c("n_regionkey"), F.lit(5)), "-"), "n_nationkey || '-' || n_regionkey || '-5'")}, ["n_nationkey"])
_simple("expr_literals", "region", {"whole": (lambda: F.lit(7).cast("bigint"), "CAST(7 AS BIGINT)"), "part": (lambda: F.lit(7.5), "CAST(7.5 AS DOUBLE)"), "yes": (lambda: F.lit(True), "true"), "nothing": (lambda: F.lit(None).cast("string"), "CAST(NULL AS VARCHAR)"), "text": (lambda: F.lit("${kept}"), "'${kept}'")}, ["r_regionkey"])
_simple("expr_template", "supplier", {"text": (lambda: strings.template("#", c("s_suppkey"), ": ", c("s_name"), " @", c("s_nationkey")), "'#' || s_suppkey || ': ' || s_name || ' @' || s_nationkey")}, ["s_suppkey"])
_simple("expr_conditional", "part", {"label": (lambda: F.when(c("p_size") > 25, F.lit("big")).otherwise(F.when(c("p_size") > 10, F.lit("mid")).otherwise("small")), "CASE WHEN p_size > 25 THEN 'big' WHEN p_size > 10 THEN 'mid' ELSE 'small' END")}, ["p_partkey"])
_simple("expr_unary", "lineitem", {"negated": (lambda: -c("l_linenumber").cast("bigint"), "-CAST(l_linenumber AS BIGINT)"), "other": (lambda: ~(c("l_returnflag") == "R"), "NOT (l_returnflag = 'R')")}, ["l_orderkey"])
_simple(
    "expr_arithmetic", "lineitem",
    {
        "quotient": (lambda: numbers.divide(c("l_partkey") - 1000, F.lit(7).cast("bigint")), "CAST(trunc((l_partkey - 1000) / 7.0::DOUBLE) AS BIGINT)"),
        "remainder": (lambda: numbers.remainder(c("l_partkey") - 1000, F.lit(7).cast("bigint")), "(l_partkey - 1000) % 7"),
        "mixed": (lambda: c("l_extendedprice") * 2 - c("l_partkey"), "l_extendedprice * 2 - l_partkey"),
    }, ["l_orderkey", "l_linenumber"],
)
_simple("expr_index", "part", {"third": (lambda: objects.index(strings.split(c("p_name"), " "), 1), "string_split(p_name, ' ')[2]")}, ["p_partkey"])
_simple("expr_slice", "documents", {"words": (lambda: F.array_join(objects.part(strings.split(c("text"), " "), 1, 4), "_"), "array_to_string(string_split(text, ' ')[2:4], '_')")}, ["doc_id"])
_simple("expr_array_spread", "part", {"all": (lambda: strings.join(F.concat(F.array(c("p_brand")), strings.split(c("p_type"), " "), F.array(F.lit("end"))), "/"), "p_brand || '/' || replace(p_type, ' ', '/') || '/end'")}, ["p_partkey"])
_simple("expr_object_spread", "supplier", {"json": (lambda: F.to_json(objects.spread({"name": c("s_name"), "site": c("s_nationkey")}, {"site": c("s_nationkey") + 1}, {"more": F.lit("x")})), """'{"name":"' || s_name || '","site":' || (s_nationkey + 1) || ',"more":"x"}'""")}, ["s_suppkey"])
_simple("expr_for_array", "part", {"doubled": (lambda: F.array_join(F.transform(F.sequence(F.lit(0), c("p_size") % 4), lambda x: (x * 2 + c("p_size")).cast("string")), ","), "array_to_string(list_transform(range(p_size % 4 + 1), lambda x: x * 2 + p_size), ',')")}, ["p_partkey"])
_simple("expr_for_filter", "part", {"kept": (lambda: F.array_join(F.transform(F.filter(F.sequence(F.lit(0), c("p_size") % 9), lambda x: x % 2 == 0), lambda x: x.cast("string")), ","), "array_to_string(list_filter(range(p_size % 9 + 1), lambda x: x % 2 = 0), ',')")}, ["p_partkey"])
_simple("expr_for_object", "region", {"json": (lambda: F.to_json(F.map_from_entries(F.transform(F.array(F.lit("a"), F.lit("b")), lambda k: F.struct(k, F.concat(k, F.lit("-"), c("r_name")))))), """'{"a":"a-' || r_name || '","b":"b-' || r_name || '"}'""")}, ["r_regionkey"])
_simple("pred_equality", "orders", {"same": (lambda: c("o_orderstatus").eqNullSafe(F.lit("O")), "o_orderstatus IS NOT DISTINCT FROM 'O'"), "unlike": (lambda: c("o_custkey") != 7, "o_custkey <> 7")}, ["o_orderkey"])
_simple("pred_compare", "customer", {"low": (lambda: c("c_acctbal") < 100, "c_acctbal < 100"), "high": (lambda: c("c_acctbal") >= 5000, "c_acctbal >= 5000")}, ["c_custkey"])
_simple("pred_logical", "customer", {"both": (lambda: F.when(c("c_nationkey") > 5, c("c_acctbal") > 0).otherwise(False), "c_nationkey > 5 AND c_acctbal > 0"), "any": (lambda: F.when(c("c_nationkey") > 20, F.lit(True)).otherwise(c("c_acctbal") > 9000), "c_nationkey > 20 OR c_acctbal > 9000")}, ["c_custkey"])
_simple("pred_not", "customer", {"other": (lambda: ~(c("c_mktsegment") == "BUILDING"), "NOT (c_mktsegment = 'BUILDING')")}, ["c_custkey"])

# ---------------------------------------------------------------- references

_shaped("ref_self", "part", "p_partkey", Span("task", "part", metrics={"own": lambda x: c("p_size").cast("bigint") * 2, "read": lambda x: x.this.field("own") + 1}),
        {"p_partkey": (_TRACE_INDEX, "p_partkey"), "own": (lambda: c("metrics")["own"].cast("bigint"), "CAST(p_size AS BIGINT) * 2"), "read": (lambda: c("metrics")["read"].cast("bigint"), "CAST(p_size AS BIGINT) * 2 + 1")})
_X = f"WITH {_TURNS0}, x AS (SELECT * FROM turns)"


def _ref(name: str, shape: Span, sql: str, where: str, sql_from: str = _X, index: bool = True) -> None:
    """The input that events of a shape over the orders read, by trace and iteration."""
    columns = {"trace_index": (_TRACE_INDEX, "t"), "input": (_INPUT, sql)} | ({"i": (_TOKENS, "i")} if index else {})
    _shaped(name, "orders", "o_orderkey", shape, columns, sql_from, where)


def _reader(read: Callable, kind: str = "llm", name: str = "reader") -> Span:
    return Span(kind, name, {"input": read}, {"tokens": lambda x: x.index()})


def _drawn(path: str, slot: str = "'output'", most: int = 100, trace: str = "t") -> str:
    return f"CAST(floor({_u(trace, path, slot, chr(39) + '0' + chr(39))} * {most}) AS BIGINT)"


_OUT = {"output": lambda x: samplers.range_int(0, 99, x.draw("output"))}
_ref("ref_trace", Span("task", "root", {"input": lambda x: c("o_orderpriority")}, children=[_turn(_reader(lambda x: strings.template(x.trace.field("input"), "/", x.index("turn"))))]), "o_orderpriority || '/' || i", "name = 'reader'")
_ref("ref_block", Span("task", "root", children=[_turn(Span("tool", "search", _OUT), _reader(lambda x: strings.template("v", x.child("search", "tool").field("output"))))]), f"""'v' || {_drawn("'/turn#' || i || '/search'")}""", "name = 'reader'")
_ref("ref_descend", Span("task", "root", children=[_turn(Span("task", "plan", children=[Span("llm", "step", metrics={"tokens": lambda x: samplers.range_int(1, 50, x.draw("tokens"))})]), _reader(lambda x: x.child("plan").child("step").field("tokens")))]),
     f"""CAST(1 + {_drawn("'/turn#' || i || '/plan/step'", "'tokens'", 50)} AS VARCHAR)""", "name = 'reader'")
_ref("ref_position", Span("task", "root", children=[_turn(Span("tool", "probe", _OUT), Span("tool", "probe", _OUT), _reader(lambda x: strings.template(x.child("probe", position=1).field("output"), ",", x.child("probe", position=x.index() % 2).field("output"))))]),
     f"""{_drawn("'/turn#' || i || '/probe[1]'")} || ',' || CASE i % 2 WHEN 0 THEN {_drawn("'/turn#' || i || '/probe'")} ELSE {_drawn("'/turn#' || i || '/probe[1]'")} END""", "name = 'reader'")
_ref("ref_prev_iteration", Span("task", "root", children=[_turn(Span("llm", "reply", _OUT), _reader(lambda x: F.when(x.index() > 0, x.child("turn", "repeat").iteration(x.index() - 1).child("reply").field("output"))))]),
     f"""CASE WHEN i > 0 THEN CAST({_drawn("'/turn#' || (i - 1) || '/reply'")} AS VARCHAR) END""", "name = 'reader'")
_ref("ref_history_window", Span("task", "root", children=[_turn(Span("llm", "reply", _OUT), _reader(lambda x: F.array_join(x.child("turn").iterations(0, x.index()).child("reply").field("output").cast("array<string>"), ">")))]),
     f"""coalesce((SELECT string_agg({_drawn("'/turn#' || h.i || '/reply'", trace='x.t')}, '>' ORDER BY h.i) FROM (SELECT unnest(range(3)) AS i) h WHERE h.i < x.i), '')""", "name = 'reader'")
_ref("ref_named_index", Span("task", "root", children=[_turn(_reader(lambda x: strings.template(x.index("turn") + 1, " of ", x.count("turn"))))]), "(i + 1) || ' of ' || n", "name = 'reader'")

# values that read themselves through earlier iterations
_SUMMED = Span("llm", "reader", {"input": lambda x: F.when(x.index() > 0, x.child("turn").iteration(x.index() - 1).child("reader").field("input") * 2).otherwise(F.lit(0).cast("bigint")) + samplers.range_int(0, 99, x.draw("input"))}, {"tokens": lambda x: x.index()})
_ref("ref_recurrence", Span("task", "root", children=[_turn(_SUMMED)]), "CAST(total AS VARCHAR)", "name = 'reader'", f"""WITH RECURSIVE {_TURNS0}, x AS (
  SELECT t, i, n, {_drawn("'/turn#0/reader'", "'input'")} AS total FROM turns WHERE i = 0
  UNION ALL SELECT t, i + 1, n, 2 * total + {_drawn("'/turn#' || (i + 1) || '/reader'", "'input'")} FROM x WHERE i + 1 < n
)""")
_SAID = lambda x: F.array_join(x.child("turn").iterations(0, x.index()).child("reader").field("output"), ";")
_ref(
    "ref_mutual_history",
    Span("task", "root", children=[_turn(Span("llm", "reader", {"input": lambda x: F.concat(F.lit("so far "), _SAID(x)), "output": lambda x: strings.template(samplers.range_int(0, 99, x.draw("output")), " after ", F.char_length(x.field("input")))}, {"tokens": lambda x: x.index()}))]),
    "'so far ' || said", "name = 'reader'", f"""WITH RECURSIVE {_TURNS0}, x AS (
  SELECT t, i, n, '' AS said FROM turns WHERE i = 0
  UNION ALL SELECT t, i + 1, n, said || CASE WHEN i > 0 THEN ';' ELSE '' END || {_drawn("'/turn#' || i || '/reader'")} || ' after ' || (7 + length(said)) FROM x WHERE i + 1 < n
)""",
)
_STEPS = Repeat("step", lambda x: x.index("turn") + 1, [Span("tool", "use", _OUT)])
_ref("ref_nested_slice", Span("task", "root", children=[_turn(_STEPS), Span("llm", "reader", {"input": lambda x: F.to_json(x.child("turn").iterations().child("step").iterations(1).child("use").field("output"))})]),
     f"""replace(CAST(to_json(list_transform(range(n), lambda i: list_transform(range(1, i + 1), lambda j: {_drawn("'/turn#' || i || '/step#' || j || '/use'")}))) AS VARCHAR), ' ', '')""", "name = 'reader'",
     f"""WITH x AS (SELECT o_orderkey AS t, CAST(floor({_u('o_orderkey', "'/turn'", "'count'", "'0'")} * 4) AS BIGINT) AS n FROM orders)""", index=False)

_FACTS = Span("tool", "facts", {"output": lambda x: F.struct(F.array(*[F.struct((c("o_custkey") + i).alias("id"), F.array(F.lit("a"), c("o_orderstatus"), F.lit("z")).alias("marks")) for i in range(3)]).alias("items"), c("o_orderpriority").alias("x"), F.lit(None).cast("string").alias("y"))},
              {"cost": lambda x: c("o_custkey") * 2}, ["kept", lambda x: F.lower("o_orderstatus")], metadata={"who": lambda x: c("o_custkey"), "how": lambda x: c("o_orderstatus"), "none": lambda x: F.lit(None)})


def _facts(name: str, columns: dict[str, tuple[Callable, str]]) -> None:
    """What a reader gets of one tool's values, each column one of its metadata."""
    shape = Span("task", "root", children=[_FACTS, Span("llm", "reader", metadata={k: f for k, (f, _) in columns.items()})])
    _shaped(name, "orders", "o_orderkey", shape, {"trace_index": (_TRACE_INDEX, "o_orderkey")} | {k: ((lambda k=k: F.to_json(F.col("metadata")[k])), s) for k, (_, s) in columns.items()}, where="name = 'reader'")


_output = lambda *steps: (lambda x: x.child("facts").field("output", *[f() if callable(f) else f for f in steps]))
_facts("ref_drill_slice", {"mark": (_output("items", slice(1, None), 0, "marks", 1), "'\"' || o_orderstatus || '\"'"), "some": (_output("items", 2, "marks", slice(0, 9)), "'[\"a\",\"' || o_orderstatus || '\",\"z\"]'"), "none": (_output("items", slice(2, 1)), "'[]'"), "null": (_output("y"), "'null'")})
_facts("ref_drill_dynamic", {
    "mark": (_output("items", lambda: c("o_orderkey") % 3, "marks", lambda: c("o_custkey") % 2), "'\"' || CASE o_custkey % 2 WHEN 0 THEN 'a' ELSE o_orderstatus END || '\"'"),
    "id": (_output("items", lambda: c("o_orderkey") % 3, lambda: F.concat(F.lit("i"), F.lit("d"))), "CAST(o_custkey + o_orderkey % 3 AS VARCHAR)"),
    "key": (_output(lambda: F.when(c("o_orderkey") % 2 == 0, "x").otherwise("y")), "CASE o_orderkey % 2 WHEN 0 THEN '\"' || o_orderpriority || '\"' ELSE 'null' END"),
    "part": (_output("items", 0, "marks", lambda: slice(c("o_orderkey") % 4, c("o_orderkey") % 4 + 1)), "CASE o_orderkey % 4 WHEN 0 THEN '[\"a\"]' WHEN 1 THEN '[\"' || o_orderstatus || '\"]' WHEN 2 THEN '[\"z\"]' ELSE '[]' END"),
})
_whole = lambda name, *steps: (lambda x: x.child("facts").field(name, *steps))
_facts("ref_whole_metadata", {
    "metadata": (_whole("metadata"), """'{"how":"' || o_orderstatus || '","none":null,"who":' || o_custkey || '}'"""), "metrics": (_whole("metrics"), """'{"cost":' || o_custkey * 2 || '}'"""),
    "tags": (_whole("tags"), """'["kept","' || lower(o_orderstatus) || '"]'"""), "one": (_whole("metadata", "how"), "'\"' || o_orderstatus || '\"'"), "last": (_whole("tags", slice(1, None)), """'["' || lower(o_orderstatus) || '"]'"""),
})

# values of a kind that only the trace tells
_MIXED = Span("tool", "facts", {"output": lambda x: F.when(c("o_orderkey") % 4 == 0, values.as_variant(c("o_custkey"))).when(c("o_orderkey") % 4 == 1, values.as_variant(c("o_custkey").cast("double"))).when(c("o_orderkey") % 4 == 2, values.as_variant(c("o_orderstatus"))).otherwise(values.as_variant(None))})
_OTHER = lambda: F.when(c("o_orderkey") % 4 < 2, values.as_variant(c("o_custkey") + c("o_orderkey") % 3 - 1)).when(c("o_orderkey") % 4 == 2, values.as_variant("O")).otherwise(values.as_variant("any"))
_shaped("pred_variant_equality", "orders", "o_orderkey", Span("task", "root", children=[_MIXED, Span("llm", "reader", metadata={
    "same": lambda x: values.equal(x.child("facts").field("output"), _OTHER()), "unlike": lambda x: values.differ(_OTHER(), x.child("facts").field("output")), "absent": lambda x: values.equal(x.child("facts").field("output"), None),
})]), {"trace_index": (_TRACE_INDEX, "o_orderkey")} | {k: ((lambda k=k: c("metadata")[k].cast("boolean")), s) for k, s in {
    "same": "CASE WHEN o_orderkey % 4 < 2 THEN o_orderkey % 3 = 1 WHEN o_orderkey % 4 = 2 THEN o_orderstatus = 'O' ELSE false END", "unlike": "CASE WHEN o_orderkey % 4 < 2 THEN o_orderkey % 3 <> 1 WHEN o_orderkey % 4 = 2 THEN o_orderstatus <> 'O' ELSE true END", "absent": "o_orderkey % 4 = 3",
}.items()}, where="name = 'reader'")
_NUMBER = Span("tool", "facts", {"output": lambda x: F.when(c("o_orderkey") % 2 == 0, values.as_variant(c("o_custkey") - 700)).otherwise(values.as_variant((c("o_custkey") - 700).cast("double")))})
_fact = lambda x: x.child("facts").field("output")
_INT, _REAL = "(o_custkey - 700)", "CAST(o_custkey - 700 AS DOUBLE)"


def _either(whole: str, real: str) -> str:
    return f"CASE o_orderkey % 2 WHEN 0 THEN CAST({whole} AS VARCHAR) ELSE CAST({real} AS VARCHAR) END"


_shaped("expr_variant_arithmetic", "orders", "o_orderkey", Span("task", "root", children=[_NUMBER, Span("llm", "reader", metadata={
    "sum": lambda x: values.text(values.add(values.multiply(_fact(x), 3), 1)), "half": lambda x: values.text(values.divide(_fact(x), 2)), "rest": lambda x: values.text(values.remainder(_fact(x), 7)), "less": lambda x: values.text(values.subtract(values.negate(_fact(x)), 0.5)),
    "below": lambda x: values.text(values.less(_fact(x), 10)), "kind": lambda x: values.kind(values.add(_fact(x), 1)),
})]), {"trace_index": (_TRACE_INDEX, "o_orderkey")} | {k: ((lambda k=k: c("metadata")[k].cast("string")), s) for k, s in {
    "sum": _either(f"{_INT} * 3 + 1", f"{_REAL} * 3 + 1"), "half": _either(f"CAST(trunc({_INT} / 2) AS BIGINT)", f"{_REAL} / 2"), "rest": _either(f"{_INT} % 7", f"{_REAL} % 7"), "less": f"CAST(-{_REAL} - 0.5::DOUBLE AS VARCHAR)",
    "below": f"CAST({_INT} < 10 AS VARCHAR)", "kind": "CASE o_orderkey % 2 WHEN 0 THEN 'int' ELSE 'float' END",
}.items()}, where="name = 'reader'")
_shaped("fld_plain_null", "orders", "o_orderkey", Span("task", "order", {"error": lambda x: F.lit(None), "output": lambda x: None}, metadata={"none": lambda x: F.lit(None)}),
        {"trace_index": (_TRACE_INDEX, "o_orderkey"), "error": (_STATE("error"), "'null'"), "output": (_STATE("output"), "'null'"), "input": (_STATE("input"), "'unset'"), "metadata": (lambda: F.to_json("metadata"), """'{"none":null}'""")})

_WAY = f"""CAST(floor({_u('o_orderkey', "'/way'", "'pick'", "'0'")} * 2) AS BIGINT)"""
_ASIDE = f"""({_u('o_orderkey', "'/aside'", "'chance'", "'0'")} < 0.4)"""
_FORKED = [Choice("way", [Span("tool", "short", _OUT), Span("tool", "long", _OUT)]), Maybe("aside", [Span("task", "note", _OUT)], 0.4)]
_FORK = f"WITH x AS (SELECT o_orderkey AS t, {_WAY} AS way, {_ASIDE} AS aside FROM orders)"


def _fork(name: str, read: Callable, sql: str) -> None:
    _ref(name, Span("task", "root", children=[*_FORKED, Span("llm", "reader", {"input": read})]), sql, "name = 'reader'", _FORK, index=False)


_fork("ref_chosen", lambda x: strings.template(x.child("way").chosen, F.when(x.child("way").chosen == 0, F.lit("short")).otherwise("long")), "way || CASE way WHEN 0 THEN 'short' ELSE 'long' END")
_fork("ref_included", lambda x: x.child("aside").included, "CAST(aside AS VARCHAR)")
# null across a branch that was not taken
_fork("ref_outer_null", lambda x: x.child("aside").child("note").field("output"), f"""CASE WHEN aside THEN CAST({_drawn("'/aside/note'")} AS VARCHAR) END""")
_fork("ref_unpicked", lambda x: F.coalesce(x.child("way").child("short").field("output"), F.lit(-1)), f"""CAST(CASE WHEN way = 0 THEN {_drawn("'/way/short'")} ELSE -1 END AS VARCHAR)""")


@_add("ref_drill", "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) + 1 AS next FROM events")
def _(spark, d):
    return _table(spark, d, "events").select("event_id", (objects.drill(F.parse_json("props"), "k", kind="bigint") + 1).alias("next"))


# ---------------------------------------------------------------- aggregates, order, context


@_add("agg_last_descendant", f"""WITH {_TURNS}, e AS (
  SELECT o_orderkey AS trace_index, 'root' AS name, [] :: INTEGER[] AS p FROM orders
  UNION ALL SELECT trace_index, 'turn', [0, CAST(index_turn AS INTEGER)] FROM turns
  UNION ALL SELECT trace_index, 'reply', [0, CAST(index_turn AS INTEGER), 0] FROM turns
  UNION ALL SELECT o_orderkey, 'close', [1] FROM orders
), o AS (SELECT *, CAST(row_number() OVER (PARTITION BY trace_index ORDER BY p) - 1 AS INTEGER) AS ordinal FROM e)
SELECT a.trace_index, a.name, a.ordinal, max(b.ordinal) AS last FROM o a JOIN o b ON a.trace_index = b.trace_index AND b.p[1:len(a.p)] = a.p GROUP BY ALL""")
def _(spark, d):
    return shape_events(_roots(spark, d), _TREE, SEED).select("trace_index", "name", "ordinal", "last")


@_add("agg_perf_report", "SELECT event_type AS path, round(avg(value), 6) AS mean, min(value) AS least, max(value) AS most, min(event_id) AS first_seen FROM events GROUP BY event_type")
def _(spark, d):
    return inputs.perf_report(_table(spark, d, "events"), "event_type", "value", "event_id").withColumn("mean", F.round("mean", 6))


@_add("agg_last_error", "WITH l AS (SELECT user_id AS run, arg_max(props, event_id) FILTER (WHERE event_type = 'error') AS last FROM (SELECT user_id, event_id, event_type, 'at ' || props || repeat(' again ' || props, CAST(event_id % 5 AS INTEGER)) AS props FROM events) GROUP BY 1) SELECT run, CASE WHEN last IS NULL THEN 'ok' ELSE 'failed: ' || substr(last, 1, 80) || CASE WHEN length(last) > 80 THEN '…' ELSE '' END END AS verdict FROM l")
def _(spark, d):
    text = F.concat(F.lit("at "), c("props"), F.repeat(F.concat(F.lit(" again "), c("props")), (c("event_id") % 5).cast("int")), F.lit("\nsecond line"))
    fields = F.struct(F.lit("message").alias("message"), text.alias("error"))
    return inputs.verdicts(_table(spark, d, "events").select(c("user_id").alias("run"), F.upper("event_type").alias("level"), c("event_id").alias("line"), fields.alias("fields")))


@_add("sort_runs_desc", "SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS newest FROM events")
def _(spark, d):
    return inputs.ranked(_table(spark, d, "events"), "ts", "event_id", ["user_id"]).select("event_id", "newest")


@_add("topk_last_run", "SELECT event_id, user_id FROM events ORDER BY ts DESC, event_id DESC LIMIT 1")
def _(spark, d):
    return inputs.last_run(_table(spark, d, "events"), "ts", "event_id").select("event_id", "user_id")


@_add("topk_retention", "SELECT event_id, user_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n <= 19")
def _(spark, d):
    return inputs.retained(_table(spark, d, "events"), "ts", "event_id", 20, ["user_id"]).select("event_id", "user_id")


@_add("ctx_trace_index", "SELECT o_orderkey AS trace_index, 'trace ' || o_orderkey AS input FROM orders")
def _(spark, d):
    return _told(spark, d, input=lambda x: strings.template("trace ", _key())).select("trace_index", _text("input").alias("input"))


@_add("ctx_repeat_index", f"WITH {_TURNS} SELECT trace_index, index_turn AS i FROM turns")
def _(spark, d):
    return _told(spark, d, _turn(Span("llm", "reply", {}, {"i": lambda x: x.index()}))).where("name = 'reply'").select("trace_index", _metric("i").alias("i"))


@_add("ctx_repeat_count", f"WITH {_TURNS} SELECT trace_index, index_turn, count_turn - index_turn AS left_over FROM turns")
def _(spark, d):
    reply = Span("llm", "reply", {}, {"i": lambda x: x.index(), "left": lambda x: x.count() - x.index()})
    return _told(spark, d, _turn(reply)).where("name = 'reply'").select("trace_index", _metric("i").alias("index_turn"), _metric("left").alias("left_over"))


# ---------------------------------------------------------------- functions


def _sampler(name: str, column: Callable[[], Column], sql: str | None) -> None:
    @_add(name, None if sql is None else f"SELECT o_orderkey AS trace_index, {sql} AS x FROM orders")
    def _(spark, d):
        return _roots(spark, d).select("trace_index", column().alias("x"))


def _su(call: int = 0) -> Column:
    return _dr("", "input", call)


_SU = [_u("o_orderkey", "''", "'input'", f"'{i}'") for i in range(3)]
_Z = f"(sqrt(-2 * ln(1 - {_SU[0]})) * cos(2 * pi() * {_SU[1]}))"
_sampler("fn_choice", lambda: samplers.choice([F.lit("x"), F.lit("y"), F.lit("z")], _su()), f"['x', 'y', 'z'][CAST(floor({_SU[0]} * 3) AS BIGINT) + 1]")
_sampler("fn_range_int", lambda: samplers.range_int(-3, 12, _su()), f"CAST(-3 + floor({_SU[0]} * 16) AS BIGINT)")
_WIDE = f"CAST({_SU[0]} * 4503599627370496 AS HUGEINT)", f"CAST({_SU[1]} * 4503599627370496 AS HUGEINT)"
_wide_sql = lambda low, span: f"CAST(({_WIDE[0]} * {span}::HUGEINT + ({_WIDE[1]} * {span}::HUGEINT) // 4503599627370496::HUGEINT) // 4503599627370496::HUGEINT + ({low})::HUGEINT AS BIGINT)"


@_add("fn_range_wide", f"SELECT o_orderkey AS trace_index, {_wide_sql('-9223372036854775808', '18446744073709551616')} AS whole, {_wide_sql('-5', (1 << 53) + 1)} AS part FROM orders")
def _(spark, d):
    wide = lambda low, high: samplers.range_int(low, high, _su(), _su(1))
    return _roots(spark, d).select("trace_index", wide(-(1 << 63), (1 << 63) - 1).alias("whole"), wide(-5, (1 << 53) - 5).alias("part"))


_sampler("fn_range_float", lambda: samplers.range_float(0.5, 2.0, _su()), f"0.5::DOUBLE + {_SU[0]} * 1.5::DOUBLE")
_sampler("fn_weighted", lambda: samplers.weighted([(F.lit("often"), 6), (F.lit("never"), 0), (F.lit("some"), 3), (F.lit("rare"), 1)], _su()), f"CASE WHEN {_SU[0]} * 10 < 6 THEN 'often' WHEN {_SU[0]} * 10 < 9 THEN 'some' ELSE 'rare' END")
_sampler("fn_normal", lambda: F.round(samplers.normal(10, 2, _su(), _su(1)), 6), f"round(10 + 2 * {_Z}, 6)")
_sampler("fn_lognormal", lambda: F.round(samplers.lognormal(3, 0.5, _su(), _su(1)), 6), f"round(3 * exp(0.5 * {_Z}), 6)")
_sampler("fn_exponential", lambda: F.round(samplers.exponential(4, _su()), 6), f"round(-4 * ln(1 - {_SU[0]}), 6)")
_sampler("fn_pareto", lambda: F.round(samplers.pareto(1.5, 3, _su()), 6), f"round(1.5::DOUBLE * pow(1 - {_SU[0]}, -1.0::DOUBLE / 3), 6)")
_sampler("fn_chance", lambda: samplers.chance(0.3, _su()), f"{_SU[0]} < 0.3")
_TERMS = "exp(-2.5::DOUBLE)" + "".join(f", exp(-2.5::DOUBLE) * {' * '.join(f'2.5::DOUBLE / {j}' for j in range(1, k + 1))}" for k in range(1, 12))
_UNIFORMS = ", ".join(_u("o_orderkey", "''", "'input'", f"'{i}'") for i in range(6))
_sampler("fn_beta", lambda: samplers.beta(2, 5, _su), f"list_sort([{_UNIFORMS}])[2]")


@_add("fn_poisson", f"""WITH p AS (SELECT [{_TERMS}] AS t), k AS (SELECT list_transform(range(1, 13), lambda i: list_sum(t[1:i])) AS cum FROM p)
SELECT o_orderkey AS trace_index, CAST(len(list_filter(cum, lambda x: x <= {_SU[0]})) AS BIGINT) AS x FROM orders, k""")
def _(spark, d):
    return _roots(spark, d).select("trace_index", samplers.poisson(2.5, _su()).alias("x"))


def _trimmed() -> Column:
    return strings.trim(F.concat(F.lit(" \t\n"), c("text"), F.lit("  ")))


_simple("fn_upper", "part", {"x": (lambda: strings.upper("p_name"), "upper(p_name)")}, ["p_partkey"])
_simple("fn_lower", "customer", {"x": (lambda: strings.lower("c_mktsegment"), "lower(c_mktsegment)")}, ["c_custkey"])
_SPACES = r"[\t-\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"
_WHOLE = f"regexp_replace(' \t\n' || text || '  ', '^{_SPACES}|{_SPACES}$', '', 'g')"
_simple("fn_trim", "documents", {"chars": (lambda: strings.length(_trimmed()), f"CAST(length({_WHOLE}) AS BIGINT)"), "digest": (lambda: F.md5(_trimmed()), f"md5({_WHOLE})")}, ["doc_id"])
_simple("fn_replace", "part", {"x": (lambda: strings.replace(c("p_type"), " ", "_"), "replace(p_type, ' ', '_')")}, ["p_partkey"])
_simple("fn_split", "part", {"n": (lambda: strings.size(strings.split(c("p_type"), " ")), "CAST(len(string_split(p_type, ' ')) AS BIGINT)"), "last": (lambda: F.element_at(strings.split(c("p_type"), " "), -1), "string_split(p_type, ' ')[-1]")}, ["p_partkey"])
_simple("fn_join", "part", {"x": (lambda: strings.join(F.array(c("p_brand"), c("p_type")), " | "), "p_brand || ' | ' || p_type")}, ["p_partkey"])
_simple("fn_contains_str", "part", {"x": (lambda: strings.contains(c("p_name"), F.lit("a")), "contains(p_name, 'a')")}, ["p_partkey"])
_simple("fn_contains_arr", "customer", {"x": (lambda: strings.contains_element(F.array(F.lit(1), F.lit(5), F.lit(9)), c("c_nationkey")), "c_nationkey IN (1, 5, 9)")}, ["c_custkey"])
_simple("fn_starts_with", "part", {"x": (lambda: strings.starts_with(c("p_type"), F.lit("S")), "starts_with(p_type, 'S')")}, ["p_partkey"])
_simple("fn_ends_with", "part", {"x": (lambda: strings.ends_with(c("p_type"), F.lit("L")), "ends_with(p_type, 'L')")}, ["p_partkey"])
_simple("fn_len", "documents", {"chars": (lambda: strings.length(c("text")), "CAST(length(text) AS BIGINT)"), "parts": (lambda: strings.size(strings.split(c("text"), " ")), "CAST(len(string_split(text, ' ')) AS BIGINT)")}, ["doc_id"])
_simple("fn_format", "customer", {"x": (lambda: strings.format("{} has {} in {}", c("c_name"), strings.float_text(F.floor("c_acctbal").cast("double")), c("c_nationkey")), "c_name || ' has ' || CAST(floor(c_acctbal) AS BIGINT) || '.0 in ' || c_nationkey")}, ["c_custkey"])
_simple("fn_clamp", "lineitem", {"x": (lambda: numbers.clamp(c("l_quantity"), F.lit(10.0), F.lit(40.0)), "greatest(10.0::DOUBLE, least(40.0::DOUBLE, l_quantity))"), "k": (lambda: numbers.clamp_int(c("l_partkey"), 50, 1500), "greatest(50, least(1500, l_partkey))")}, ["l_orderkey", "l_linenumber"])
_simple("fn_round", "customer", {"x": (lambda: numbers.round_half_away(c("c_acctbal")), "CAST(round(c_acctbal) AS BIGINT)")}, ["c_custkey"])
_simple("fn_floor", "customer", {"x": (lambda: numbers.floor(c("c_acctbal")), "CAST(floor(c_acctbal) AS BIGINT)")}, ["c_custkey"])
_simple("fn_ceil", "customer", {"x": (lambda: numbers.ceil(c("c_acctbal")), "CAST(ceil(c_acctbal) AS BIGINT)")}, ["c_custkey"])
_simple("fn_abs", "customer", {"x": (lambda: numbers.absolute(c("c_acctbal")), "abs(c_acctbal)"), "k": (lambda: numbers.absolute(c("c_custkey") - 700), "abs(c_custkey - 700)")}, ["c_custkey"])
_simple("fn_min", "lineitem", {"x": (lambda: numbers.least(c("l_quantity"), c("l_linenumber").cast("double"), F.lit(5.0)), "least(l_quantity, CAST(l_linenumber AS DOUBLE), 5.0::DOUBLE)")}, ["l_orderkey", "l_linenumber"])
_simple("fn_max", "lineitem", {"x": (lambda: numbers.most(c("l_partkey"), c("l_suppkey")), "greatest(l_partkey, l_suppkey)")}, ["l_orderkey", "l_linenumber"])


@_add("fn_tokens", None)
def _(spark, d):
    import public_tokenizers

    docs = _table(spark, d, "documents")
    return docs.select("doc_id", strings.tokens(c("text"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN).alias("tokens"))


_H = f"md5(concat_ws('|', '{SEED}', o_orderkey, 'id'))"
_sampler("fn_uuid", lambda: ids.uuid(SEED, _key(), "id"), f"substr({_H}, 1, 8) || '-' || substr({_H}, 9, 4) || '-4' || substr({_H}, 14, 3) || '-' || substr('89ab', CAST(('0x' || substr({_H}, 17, 1)) AS INTEGER) % 4 + 1, 1) || substr({_H}, 18, 3) || '-' || substr({_H}, 21, 12)")
_sampler("fn_hex", lambda: ids.hex_digits(40, SEED, _key(), "id"), f"substr(md5(concat_ws('|', '{SEED}', o_orderkey, 'id', 0)) || md5(concat_ws('|', '{SEED}', o_orderkey, 'id', 1)), 1, 40)")
_sampler("fn_alphanum", lambda: ids.alphanumeric(6, SEED, _key(), "id"), " || ".join(f"substr('{ids.ALPHABET}', CAST(floor({_u('o_orderkey', chr(39) + 'id' + chr(39), str(i))} * 62) AS BIGINT) + 1, 1)" for i in range(6)))

# ---------------------------------------------------------------- timeline

_PLACED = "placed AS (SELECT o_orderkey AS trace_index, CAST(o_orderkey AS DOUBLE) / ((SELECT count(*) FROM orders) - 1) AS r FROM orders)"
_SINE = "acos(greatest(-1.0::DOUBLE, least(1.0::DOUBLE, 1 - 2 * r))) / pi()"


def _placed(spark, d) -> DataFrame:
    roots = _roots(spark, d)
    whole = F.broadcast(roots.agg((F.count("*") - 1).alias("most")))  # one row
    return roots.crossJoin(whole).select("trace_index", (_key().cast("double") / c("most")).alias("r"))


@_add("time_spread_linear", f"WITH {_PLACED} SELECT trace_index, r AS place FROM placed")
def _(spark, d):
    return _placed(spark, d).select("trace_index", timeline.linear(c("r")).alias("place"))


@_add("time_spread_sine", f"WITH {_PLACED} SELECT trace_index, round({_SINE}, 9) AS place FROM placed")
def _(spark, d):
    return _placed(spark, d).select("trace_index", F.round(timeline.sine(c("r")), 9).alias("place"))


_COUNTS = f"""{_TURNS}, counts AS (SELECT o_orderkey AS trace_index, 2 + 2 * coalesce(n, 0) AS events FROM orders LEFT JOIN (SELECT trace_index, count(*) AS n FROM turns GROUP BY trace_index) t ON t.trace_index = o_orderkey),
w AS (SELECT max(events) AS longest, count(*) AS n FROM counts),
anchors AS (SELECT trace_index, {NOW - OVER} + CAST(floor(({OVER} - longest * 100000) * (CAST(trace_index AS DOUBLE) / (n - 1))) AS BIGINT) AS anchor FROM counts, w)"""


def _slotted(spark, d) -> DataFrame:
    return generate(_roots(spark, d), _TREE, SEED, NOW, OVER)


@_add("time_anchor", f"WITH {_COUNTS} SELECT trace_index, anchor FROM anchors")
def _(spark, d):
    return _slotted(spark, d).where("ordinal = 0").select("trace_index", "anchor")


_SLOTS = f"""{_COUNTS}, e AS (
  SELECT o_orderkey AS trace_index, 'root' AS name, [] :: INTEGER[] AS p FROM orders
  UNION ALL SELECT trace_index, 'turn', [0, CAST(index_turn AS INTEGER)] FROM turns
  UNION ALL SELECT trace_index, 'reply', [0, CAST(index_turn AS INTEGER), 0] FROM turns
  UNION ALL SELECT o_orderkey, 'close', [1] FROM orders
), o AS (SELECT *, row_number() OVER (PARTITION BY trace_index ORDER BY p) - 1 AS ordinal FROM e),
l AS (SELECT *, CASE name WHEN 'root' THEN max(ordinal) OVER (PARTITION BY trace_index) WHEN 'turn' THEN ordinal + 1 ELSE ordinal END AS last FROM o),
s AS (SELECT l.trace_index, name, CAST(ordinal AS INTEGER) AS ordinal, anchor + ordinal * 100000 AS start_micros, anchor + (last + 1) * 100000 AS end_micros FROM l JOIN anchors a ON a.trace_index = l.trace_index)"""


@_add("time_slots", f"WITH {_SLOTS} SELECT trace_index, name, ordinal, start_micros, end_micros FROM s")
def _(spark, d):
    return _slotted(spark, d).select("trace_index", "name", "ordinal", "start_micros", "end_micros")


@_add("time_created", f"WITH {_SLOTS} SELECT trace_index, ordinal, strftime(make_timestamp(start_micros), '%Y-%m-%dT%H:%M:%S.%fZ') AS created FROM s")
def _(spark, d):
    return _slotted(spark, d).select("trace_index", "ordinal", "created")


@_add("time_metrics", f"WITH {_SLOTS} SELECT trace_index, ordinal, start_micros / 1e6::DOUBLE AS start, end_micros / 1e6::DOUBLE AS \"end\" FROM s")
def _(spark, d):
    return _slotted(spark, d).select("trace_index", "ordinal", *[c("metrics")[m].cast("double").alias(m) for m in ("start", "end")])


# ---------------------------------------------------------------- whole traces

SHAPE = Span(
    "task", "session",
    {"input": lambda x: strings.template("question ", samplers.range_int(0, 99, x.draw("input"))), "output": lambda x: x.child("answer").field("output")},
    children=[
        Repeat("turn", lambda x: samplers.range_int(1, 3, x.draw("count")), [
            Span("task", "think", {"input": lambda x: x.trace.field("input")}, children=[
                Span("llm", "reply", {"input": lambda x: strings.template(x.trace.field("input"), " / ", x.index("turn") + 1)}, {"tokens": lambda x: samplers.range_int(10, 60, x.draw("tokens")), "total": lambda x: x.field("tokens") + 5}),
            ]),
        ]),
        Choice("way", [Span("tool", "search", {"output": lambda x: F.lit("found")}), Span("function", "compute", {"output": lambda x: F.lit("done")})]),
        Maybe("aside", [Span("task", "review", {"output": lambda x: samplers.choice([F.lit("good"), F.lit("poor")], x.draw("output"))})], 0.25),
        Span("llm", "answer", {"output": lambda x: strings.template("answer ", samplers.range_int(0, 9, x.draw("output")))}),
    ],
)


def trace_events(spark: SparkSession, d: str) -> DataFrame:
    """All events of one generated trace per order."""
    return generate(_roots(spark, d), SHAPE, SEED, NOW, OVER)


_I = "trace_index"
_TRACE = f"""WITH r AS (
  SELECT o_orderkey AS trace_index, 'question ' || CAST(floor({_u('o_orderkey', "''", "'input'", "'0'")} * 100) AS BIGINT) AS q,
    'answer ' || CAST(floor({_u('o_orderkey', "'/answer'", "'output'", "'0'")} * 10) AS BIGINT) AS a,
    1 + CAST(floor({_u('o_orderkey', "'/turn'", "'count'", "'0'")} * 3) AS BIGINT) AS n,
    CAST(floor({_u('o_orderkey', "'/way'", "'pick'", "'0'")} * 2) AS BIGINT) AS way,
    {_u('o_orderkey', "'/aside'", "'chance'", "'0'")} < 0.25 AS aside FROM orders
), t AS (SELECT *, unnest(range(n)) AS i FROM r), e AS (
  SELECT trace_index, [] :: INTEGER[] AS p, 'session' AS name, 'task' AS type, q AS input, a AS output, CAST(NULL AS DOUBLE) AS total, -1 AS parent_length FROM r
  UNION ALL SELECT trace_index, [0, CAST(i AS INTEGER), 0], 'think', 'task', q, NULL, NULL, 0 FROM t
  UNION ALL SELECT trace_index, [0, CAST(i AS INTEGER), 0, 0], 'reply', 'llm', q || ' / ' || (i + 1), NULL, 15 + floor({_u(_I, "'/turn#' || i || '/think/reply'", "'tokens'", "'0'")} * 51), 3 FROM t
  UNION ALL SELECT trace_index, [1, CAST(way AS INTEGER)], CASE way WHEN 0 THEN 'search' ELSE 'compute' END, CASE way WHEN 0 THEN 'tool' ELSE 'function' END, NULL, CASE way WHEN 0 THEN 'found' ELSE 'done' END, NULL, 0 FROM r
  UNION ALL SELECT trace_index, [2, 0], 'review', 'task', NULL, CASE floor({_u(_I, "'/aside/review'", "'output'", "'0'")} * 2) WHEN 0 THEN 'good' ELSE 'poor' END, NULL, 0 FROM r WHERE aside
  UNION ALL SELECT trace_index, [3], 'answer', 'llm', NULL, a, NULL, 0 FROM r
), o AS (SELECT *, row_number() OVER (PARTITION BY trace_index ORDER BY p) - 1 AS ordinal FROM e),
w AS (SELECT max(m) AS longest, count(*) AS traces FROM (SELECT max(ordinal) + 1 AS m FROM o GROUP BY trace_index)),
x AS (SELECT *, CASE name WHEN 'session' THEN max(ordinal) OVER (PARTITION BY trace_index) WHEN 'think' THEN ordinal + 1 ELSE ordinal END AS last,
  {NOW - OVER} + CAST(floor(({OVER} - longest * 100000) * (CAST(trace_index AS DOUBLE) / (traces - 1))) AS BIGINT) AS anchor FROM o, w)"""


@_add("trace_events", _TRACE + """ SELECT trace_index, CAST(ordinal AS INTEGER) AS ordinal, name, type, input, output, total, anchor + ordinal * 100000 AS start_micros, anchor + (last + 1) * 100000 AS end_micros FROM x""")
def _(spark, d):
    return trace_events(spark, d).select("trace_index", "ordinal", "name", "type", "input", "output", c("metrics")["total"].cast("double").alias("total"), "start_micros", "end_micros").withColumns({f: c(f).cast("string") for f in ("input", "output")})


def _span_id(place: str) -> str:
    return _uuid_sql("'run'", "trace_index", place)


# ids are functions of addresses: the SQL makes those of span, parent and root from the places of the tree
@_add("link_parents", _TRACE + f""", k AS (SELECT trace_index, name, array_to_string(p, '.') AS own, array_to_string(p[1:greatest(parent_length, 0)], '.') AS above, parent_length FROM x)
SELECT trace_index, name, {_span_id("own")} AS span_id, CASE WHEN parent_length >= 0 THEN {_span_id("above")} END AS parent, {_span_id("''")} AS root FROM k""")
def _(spark, d):
    return trace_events(spark, d).select("trace_index", "name", "span_id", F.get("span_parents", F.lit(0)).alias("parent"), c("root_span_id").alias("root"))


@_add("agg_max_trace_len", _TRACE + " SELECT max(longest) AS longest, max(traces) AS traces FROM w")
def _(spark, d):
    return timeline.totals(shape_events(_roots(spark, d), SHAPE, SEED))


@_add("agg_counts", _TRACE + " SELECT trace_index, count(*) AS events, count(DISTINCT name) AS names, sum(CASE WHEN parent_length = 0 THEN 1 ELSE 0 END)::BIGINT AS children FROM o GROUP BY trace_index")
def _(spark, d):
    below_root = F.count_if(c("parent") == "")
    return shape_events(_roots(spark, d), SHAPE, SEED).groupBy("trace_index").agg(F.count("*").alias("events"), F.countDistinct("name").alias("names"), below_root.alias("children"))


@_add("sink_run_summary", _TRACE + f" SELECT CAST({SEED} AS BIGINT) AS seed, count(DISTINCT trace_index) AS traces, count(*) AS events, CAST(12 AS BIGINT) AS rows, 'mine' AS project, CAST(34 AS BIGINT) AS ms, 'a.jsonl' AS log FROM o")
def _(spark, d):
    return sinks.summary(shape_events(_roots(spark, d), SHAPE, SEED), SEED, "mine", 12, 34, "a.jsonl")


@_add("src_template_turns", f"""SELECT o_orderkey AS trace_index, CASE o_orderkey % 3 WHEN 0 THEN 'a' WHEN 1 THEN 'b' ELSE 'c' END AS name,
  CASE o_orderkey % 3 WHEN 0 THEN CAST({_u('o_orderkey', "''", "'input'", "'0'")} * 10 AS BIGINT) END IS NOT NULL AS has_input FROM orders""")
def _(spark, d):
    shapes = [Span("task", "a", {"input": lambda x: samplers.range_int(0, 9, x.draw("input"))}), Span("task", "b"), Span("task", "c")]
    return shape_events(_roots(spark, d), shapes, SEED).select("trace_index", "name", c("input").isNotNull().alias("has_input"))


def queries() -> dict[str, Query]:
    return {name: query for name, (query, _) in _FOUND.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in _FOUND.items() if sql}
