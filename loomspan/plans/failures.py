"""Where generation failed: the first error in the order of traces, with its block and field.

A job fails in whichever task comes to an error first, and the error says what
went wrong, not where. As every value depends on its address alone, it can be
asked for again: halving the range of traces finds the first that fails (all
halves together are one more pass), and in that trace the values are evaluated
one by one. The value to blame fails although all it reads is fine; of several,
the first in the order of events and fields. The answer doesn't depend on how
the traces are partitioned.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from contextlib import contextmanager

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomspan.functions.errors import KINDS
from loomspan.plans import shape as shapes_
from loomspan.plans.recurrences import CircularReference, Value
from loomspan.plans.shape import Choice, Context, Maybe, Repeat, Span

#: The kinds that errors of Spark's own arithmetic, casts and indexes stand for.
SPARK_KINDS = {
    "DIVIDE_BY_ZERO": "DivisionByZero", "REMAINDER_BY_ZERO": "DivisionByZero", "ARITHMETIC_OVERFLOW": "NonFiniteResult", "BINARY_ARITHMETIC_OVERFLOW": "NonFiniteResult", "CAST_OVERFLOW": "NonFiniteResult",
    "NUMERIC_VALUE_OUT_OF_RANGE": "NonFiniteResult", "INVALID_ARRAY_INDEX": "IndexOutOfBounds", "INVALID_VARIANT_CAST": "RefShapeMismatch", "CAST_INVALID_INPUT": "RefShapeMismatch",
}


class GenerationError(ValueError):
    """The first error of a run: its ``kind``, the ``trace_index``, the path of its ``block`` with iterations, and the ``field``."""

    def __init__(self, kind: str, message: str, trace_index: int, block: str, field: str):
        super().__init__(f"{kind} in trace {trace_index}, block {block or '/'}, {field}: {message}")
        self.kind, self.message, self.trace_index, self.block, self.field = kind, message, trace_index, block, field


def told(error: Exception) -> tuple[str, str] | None:
    """Kind and message of an error of evaluation; None for an error of another sort."""
    text = str(error)
    if found := re.search(rf"({'|'.join(KINDS)}): ([^\n]*)", text):
        return found[1], re.sub(r" SQLSTATE: \w+$", "", found[2])
    for condition, kind in SPARK_KINDS.items():
        if found := re.search(rf"\[{condition}[\w.]*\] ([^\n]*)", text):
            return kind, re.sub(r" SQLSTATE: \w+$", "", found[1])
    return None


def _error(rows: DataFrame, run: bool = False) -> Exception | None:
    """What evaluating all columns of the rows fails with."""
    try:
        rows.write.format("noop").mode("overwrite").save() if run else rows.collect()
    except (PySparkException, Py4JJavaError) as e:
        if told(e) is None:
            raise
        return e
    return None


def first_failure(roots: DataFrame, shapes: Span | Sequence[Span], seed: int) -> GenerationError | None:
    """The first error that generating the events of ``roots`` ends in; None if they are all fine."""
    several = [shapes] if isinstance(shapes, Span) else list(shapes)
    compiled = shapes_._compiled(roots, several, seed)

    def fails(low: int, high: int) -> bool:
        part = roots.where((F.col("trace_index") >= low) & (F.col("trace_index") < high))
        return _error(shapes_._exploded(shapes_._with_slots(part, compiled.layers), compiled, []), run=True) is not None

    bounds = roots.agg(F.min("trace_index").alias("low"), F.max("trace_index").alias("high")).first()
    if bounds.low is None or not fails(low := bounds.low, high := bounds.high + 1):
        return None
    while high - low > 1:
        middle = (low + high) // 2
        low, high = (low, middle) if fails(low, middle) else (middle, high)
    rows = roots.where(F.col("trace_index") == low)
    one = roots.sparkSession.createDataFrame(rows.limit(1).collect(), rows.schema)
    return _in_trace(one, several[low % len(several)], seed, low)


def _own_values(shared, node) -> Iterator[tuple[int, Value]]:
    """(0 for the structure, else 1, value) of a block's own values in the order in which they are due."""
    context, block = Context(shared, node, _marks(node)), node.block
    found: list[Value] = []

    def noted(value: Value, indices) -> None:
        found.append(value)
        return F.lit(None)

    with shared.reading(noted):
        if isinstance(block, Repeat):
            context.times()
        elif isinstance(block, Choice):
            context.chosen
        elif isinstance(block, Maybe):
            context.included
    yield from ((0, v) for v in found[:1])
    slots = {f"var:{k}": f for k, f in block.vars.items()}
    if isinstance(block, Span):
        slots |= {k: block.fields[k] for k in shapes_.FIELDS if k in block.fields}
        slots |= {f"metadata.{k}": f for k, f in (block.metadata or {}).items()} | {f"metrics.{k}": f for k, f in block.metrics.items()}
        slots |= {f"tag:{i}": t for i, t in enumerate(block.tags) if not isinstance(t, str)}
    iterating = isinstance(block, Repeat)
    yield from ((1, Value((node.address, iterating, k), f, node, iterating)) for k, f in slots.items())


def _marks(node) -> tuple:
    return tuple(F.col(f"_i{k}") for k in range(len(node.outer)))


def _in_trace(one: DataFrame, shape: Span, seed: int, trace_index: int) -> GenerationError:
    """The value to blame in the one trace of ``one``."""
    shared = shapes_._Shared(seed, "_slot_", one)
    nodes: list = [shapes_._Node(shape)]
    for node in nodes:
        nodes += node.children
    values = [(structure, v) for node in nodes for structure, v in _own_values(shared, node)]
    names = {v.key: shared.column(v) for _, v in values}
    whole = shapes_._with_slots(one, shared.layers)
    errors = {v.key: e for _, v in values if (e := _error(whole.select(names[v.key])))}

    def reads(value: Value) -> set[tuple]:
        found: set[tuple] = set()
        here = tuple(F.col(f"_i{k}") for k in range(len(value.loops)))
        with shared.reading(lambda v, indices: found.add(v.key) or F.lit(None)):
            for k, loop in enumerate(value.loops):
                shared.times(loop, here[:k])
            shared.made(value, here)
        return found - {value.key}

    failed = [(structure, v) for structure, v in values if v.key in errors]
    around = {v.key: reads(v) & errors.keys() for _, v in failed}
    # values that read each other fail together: none of them is fine
    alone = [(structure, v) for structure, v in failed if all(v.key in _reach(around, k) for k in around[v.key])]
    blamed = []
    for structure, value in alone:
        for at in _iterations(whole, shared, value):
            own = whole.select(shared.made(value, tuple(F.lit(i).cast("bigint") for i in at)).alias("x")) if not around[value.key] else None
            error = _error(own) if own is not None else errors[value.key]
            if error:
                blamed.append((structure, _place(value.node, at), len(blamed), value, at, error))
                break
    if not blamed:  # it shows in the array of all iterations only
        blamed = [(structure, _place(v.node, ()), i, v, (), errors[v.key]) for i, (structure, v) in enumerate(alone or failed)]
    _, _, _, value, at, error = min(blamed, key=lambda x: x[:3])
    kind, message = told(error)
    return GenerationError(kind, message, trace_index, _path(value, at), value.key[-1])


def _reach(around: dict[tuple, set[tuple]], start: tuple) -> set[tuple]:
    seen, todo = set(), [start]
    while todo:
        for k in around.get(todo.pop(), ()):
            if k not in seen:
                seen.add(k), todo.append(k)
    return seen


def _iterations(whole: DataFrame, shared, value: Value) -> Iterator[tuple[int, ...]]:
    """The iterations that a value is evaluated in, in order."""
    found: list[tuple[int, ...]] = [()]
    for level, loop in enumerate(value.loops):
        counts = [shared.times(loop, tuple(F.lit(i).cast("bigint") for i in at)) for at in found]
        if not counts:
            return
        many = whole.select(*[x.alias(f"n{i}") for i, x in enumerate(counts)])
        if _error(many):  # the count itself is to blame
            yield from (at + (0,) * (len(value.loops) - level) for at in found[:1])
            return
        found = [(*at, i) for at, n in zip(found, many.first()) for i in range(n or 0)]
    yield from found


def _place(node, at: tuple[int, ...]) -> list[int]:
    """Sort key of pre-order: sibling positions and iterations from the root."""
    out: list[int] = []
    for n in node.chain():
        out.append(n.position)
        level = len(n.outer)
        if isinstance(n.block, Repeat) and level < len(at):
            out.append(at[level])
    return out


def _path(value: Value, at: tuple[int, ...]) -> str:
    out = ""
    for n in value.node.chain():
        out += n.segment
        level = len(n.outer)
        if isinstance(n.block, Repeat) and level < len(at):
            out += f"#{at[level]}"
    return out


@contextmanager
def located(roots: DataFrame, shapes: Span | Sequence[Span], seed: int):
    """Actions on events of these roots and shapes fail with the first error and its place."""
    try:
        yield
    except CircularReference:
        raise
    except (PySparkException, Py4JJavaError) as e:
        if told(e) is None or (found := first_failure(roots, shapes, seed)) is None:
            raise
        raise found from e
