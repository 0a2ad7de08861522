"""Values that read themselves through iterations, slices in slices, whole objects: against Python."""

import json

import pytest
from pyspark.sql import functions as F

from loomspan.functions import samplers
from loomspan.plans.recurrences import CircularReference
from loomspan.plans.shape import Choice, Maybe, Repeat, Span, shape_events
from loomspan.sources import inputs

DRAWN = lambda x: samplers.range_int(0, 99, x.draw("output"))


def told(spark, *children, n=12, name=None, **more):
    rows = shape_events(inputs.trace_range(spark, n), Span("task", "root", children=list(children), **more), 11)
    made = [F.to_json(f).alias(f) for f in ("input", "output", "metadata")]
    rows = rows.select("trace_index", "ordinal", "name", "place", *made).orderBy("trace_index", "ordinal").collect()
    read = lambda x: None if x is None else json.loads(x)
    return [(r.trace_index, r.place, read(r.input), read(r.output), read(r.metadata)) for r in rows if name in (None, r.name)]


def turn(*children, count=lambda x: samplers.range_int(0, 4, x.draw("count")), **more):
    return Repeat("turn", count, list(children), **more)


def before(x, field="output"):
    return x.child("turn").iteration(x.index("turn") - 1).child("reply").field(field)


def by_trace(rows):
    out = {}
    for t, *rest in rows:
        out.setdefault(t, []).append(rest)
    return out


def test_a_running_total(spark):
    reply = Span("llm", "reply", {"output": DRAWN, "input": lambda x: F.when(x.index() > 0, before(x, "input")).otherwise(0) + x.field("output")})
    got = by_trace(told(spark, turn(reply), name="reply"))
    assert got
    for rows in got.values():
        assert [r[1] for r in rows] == [sum(r[2] for r in rows[: i + 1]) for i in range(len(rows))]


def test_a_chat_that_reads_what_was_said(spark):
    said = lambda x, f: x.child("turn").iterations(0, x.index()).child("reply").field(f)
    reply = Span("llm", "reply", {
        "input": lambda x: F.concat(F.flatten(F.transform(F.arrays_zip(said(x, "input"), said(x, "output")), lambda p: F.array(F.element_at(p["0"], -1), p["1"]))), F.array(F.concat(F.lit("ask "), x.index().cast("string")))),
        "output": lambda x: F.concat(F.lit("to "), F.size(x.field("input")).cast("string"), F.lit(": "), F.element_at(x.field("input"), -1)),
    }, types={"input": "array<string>"})
    after = Span("llm", "after", {"input": lambda x: x.child("turn").iterations().child("reply").field("output")})
    rows = told(spark, turn(reply), after)
    for t, rows in by_trace(r for r in rows if r[2] is not None).items():
        history = []
        for _, asked, answer, _ in rows[:-1]:
            history.append(f"ask {len(history) // 2}")
            assert asked == history
            history.append(f"to {len(history)}: {history[-1]}")
            assert answer == history[-1]
        assert rows[-1][1] == history[1::2]


def test_a_circle_through_variables_and_branches(spark):
    # what a maybe leaves out is null, and the next iteration reads that
    note = Maybe("aside", [Span("tool", "note", {"output": lambda x: x.var("level") * 2})], 0.5)
    last = lambda x: x.child("turn").iteration(x.index("turn") - 1).child("aside").child("note").field("output")
    level = lambda x: F.when(x.index("turn") > 0, F.coalesce(last(x), F.lit(-1))).otherwise(1).cast("bigint")
    rows = told(spark, turn(Span("llm", "reply", {"output": lambda x: x.var("level")}), note, vars={"level": level}), n=30)
    seen = 0
    for events in by_trace(r for r in rows if r[1]).values():
        turns = {}
        for place, _, output, _ in events:
            turns.setdefault(int(place.split(".")[1]), []).append(output)
        want = 1
        for i in range(len(turns)):
            assert turns[i][0] == want and turns[i][1:] in ([], [2 * want])
            want = turns[i][1] if turns[i][1:] else -1
            seen += 1
    assert seen > 20


def test_circles_around_two_repeats(spark):
    def count_on(x):
        step, use = x.index("step"), lambda at: at.child("use").field("output")
        here = use(x.child("step").iteration(step - 1))
        above = F.element_at(x.child("turn").iteration(x.index("turn") - 1).child("step").iterations().child("use").field("output"), -1)
        return F.when(step > 0, here).otherwise(F.when(x.index("turn") > 0, above).otherwise(0)) + 1

    step = Repeat("step", lambda x: x.index("turn") + 1, [Span("tool", "use", {"output": count_on})])
    got = by_trace(told(spark, turn(step, count=lambda x: F.lit(4)), n=3, name="use"))
    assert [[r[2] for r in rows] for rows in got.values()] == [list(range(1, 11))] * 3


def test_an_inner_circle_starts_anew_in_each_turn(spark):
    step = Repeat("step", lambda x: F.lit(3), [Span("tool", "use", {"output": lambda x: F.when(x.index() > 0, x.child("step").iteration(x.index() - 1).child("use").field("output")).otherwise(x.index("turn") * 10) + 1})])
    got = by_trace(told(spark, turn(step, count=lambda x: F.lit(2)), n=2, name="use"))
    assert [[r[2] for r in rows] for rows in got.values()] == [[1, 2, 3, 11, 12, 13]] * 2


@pytest.mark.parametrize("read", [lambda x: x.field("output"), lambda x: x.this.field("output"), lambda x: x.child("turn").child("reply").field("output") if False else x.field("input")])
def test_circles_in_one_place_are_refused(spark, read):
    reply = Span("llm", "reply", {"output": read, "input": lambda x: x.field("output")})
    with pytest.raises(CircularReference, match="reply"):
        told(spark, turn(reply))


@pytest.mark.parametrize("read", [lambda x: x.child("turn").iteration(x.index()), lambda x: x.child("turn").iteration(F.lit(2)), lambda x: x.child("turn").iterations()])
def test_iterations_that_are_not_there_yet_are_an_error(spark, read):
    reply = Span("llm", "reply", {"output": lambda x: F.concat(F.lit("a"), F.to_json(F.array(read(x).child("reply").field("output"))))}, types={"output": "string"})
    with pytest.raises(Exception, match="CircularReference"):
        told(spark, turn(reply, count=lambda x: F.lit(3)))


def test_a_circle_from_outside_the_repeat_is_refused(spark):
    reply = Span("llm", "reply", {"output": lambda x: x.trace.field("input")})
    with pytest.raises(CircularReference):
        told(spark, turn(reply), fields={"input": lambda x: F.size(x.child("turn").iterations().child("reply").field("output"))})


def test_a_type_that_cannot_be_told_is_asked_for(spark):
    reply = lambda **more: Span("llm", "reply", {"output": lambda x: F.when(x.index() > 0, before(x)["n"]).otherwise(F.lit(3))}, **more)
    with pytest.raises(ValueError, match="declare its type"):
        told(spark, turn(reply()))


def test_slices_in_slices(spark):
    use = Span("tool", "use", {"output": DRAWN})
    pick = Choice("way", [Span("tool", "short", {"output": lambda x: F.lit("s")}), Span("tool", "long")])
    step = Repeat("step", lambda x: x.index("turn"), [use, pick])
    read = lambda x: x.child("turn").iterations()
    reader = Span("llm", "reader", metadata={
        "all": lambda x: read(x).child("step").iterations().child("use").field("output"), "first": lambda x: x.child("turn").iterations(1).child("step").iteration(0).child("use").field("output"),
        "at": lambda x: read(x).child("step").iterations().index("step"), "of": lambda x: read(x).child("step").iterations().count("turn"), "way": lambda x: read(x).child("step").iterations(0, 2).child("way").chosen,
        "short": lambda x: read(x).child("step").iterations().child("way").child("short").field("output"),
    })
    for events in by_trace(told(spark, turn(step), reader)).values():
        uses, ways = {}, {}
        for place, _, output, _ in events:
            at = [int(k) for k in place.split(".")] if place else []
            if len(at) == 5 and at[4] == 0:
                uses[at[1], at[3]] = output
            elif len(at) == 6:
                ways[at[1], at[3]] = at[5]
        n = max((i for i, _ in uses), default=0) + 1 if uses else None
        got = events[-1][3]
        turns = len(got["all"])
        assert n is None or turns == n
        assert got["all"] == [[uses[i, j] for j in range(i)] for i in range(turns)] and got["first"] == [uses[i, 0] for i in range(1, turns)]
        assert got["at"] == [list(range(i)) for i in range(turns)] and got["of"] == [[turns] * i for i in range(turns)]
        assert got["way"] == [[ways[i, j] for j in range(min(2, i))] for i in range(turns)]
        assert got["short"] == [[None if ways[i, j] else "s" for j in range(i)] for i in range(turns)]


def test_whole_objects_tags_and_paths(spark):
    facts = Span("tool", "facts", {"output": lambda x: F.struct(F.array(F.lit(1), F.lit(2)).alias("k"))}, {"b": lambda x: F.lit(0.5), "a": lambda x: x.field("b") * 2}, ["t", lambda x: x.index("turn")], metadata={"z": lambda x: F.lit(None), "a": lambda x: x.index("turn")})
    bare = Span("tool", "bare", {"output": lambda x: F.lit(1)}, metadata={})
    reader = Span("llm", "reader", metadata={
        "metadata": lambda x: x.child("facts").field("metadata"), "metrics": lambda x: x.child("facts").field("metrics"), "tags": lambda x: x.child("facts").field("tags"), "none": lambda x: x.child("bare").field("metadata"),
        "all": lambda x: x.child("turn").iterations().child("facts").field("metadata", "a"), "k": lambda x: x.child("turn").iterations(0, 1).child("facts").field("output", "k", 1), "z": lambda x: x.child("facts").field("metadata.z"),
    })
    for t, place, _, _, got in told(spark, turn(facts, bare, reader, count=lambda x: F.lit(2)), n=2, name="reader"):
        i = int(place.split(".")[1])
        assert got == {"metadata": {"a": i, "z": None}, "metrics": {"a": 1.0, "b": 0.5}, "tags": ["t", str(i)], "none": {}, "all": [0, 1], "k": [2], "z": None}
    for missing in ("metrics", "tags", "metadata.q"):
        with pytest.raises(KeyError):
            told(spark, turn(bare, Span("llm", "reader", {"input": lambda x, m=missing: x.child("bare").field(m)})))
    with pytest.raises(Exception, match="MissingObjectKey"):
        told(spark, turn(facts, Span("llm", "reader", {"input": lambda x: x.child("facts").field("output", "q")}), count=lambda x: F.lit(1)))
    two = [Span("tool", "a", {"output": lambda x: F.lit("x")}), Span("tool", "a")]
    at = lambda i: told(spark, *two, Span("llm", "reader", {"input": lambda x: x.child("a", position=F.lit(i)).field("output")}), n=1, name="reader")
    assert at(0)[0][2] == "x"
    for i, kind in ((1, "AbsentRefField"), (2, "IndexOutOfBounds"), (1.0, "NonIntegerIndex")):
        with pytest.raises(Exception, match=kind):
            at(i)


def test_plain_nulls(spark):
    shape = [Choice("way", [Span("tool", "a", {"output": lambda x: F.lit(None), "input": lambda x: None})]), Span("llm", "reader", {"input": lambda x: x.child("way").child("a").field("output")})]
    rows = shape_events(inputs.trace_range(spark, 2), Span("task", "root", children=shape), 1).where("name <> 'root'")
    got = rows.select("name", *[F.when(F.is_variant_null(f), "null").when(F.col(f).isNull(), "unset").alias(f) for f in ("input", "output", "error")]).distinct().collect()
    assert {tuple(r) for r in got} == {("a", "null", "null", "unset"), ("reader", "null", "unset", "unset")}
