"""Shapes: declarative trace templates that compile to one events DataFrame.

A shape is a tree of Python objects; a field is a function of a context that
gives its Column. Every value that is read elsewhere becomes one column of the
roots, computed once a trace: a plain value where its block stands once, an
array over the iterations where it stands in a repeat. A reference is then a
column, an element or a slice of one: no join, no shuffle. The layout of a
trace, which block in which iterations, is one array in pre-order, exploded with
its ordinals; only then are fields computed, those that are asked for.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomspan.functions import objects
from loomspan.functions.draws import Pieces, draw
from loomspan.functions.errors import fail
from loomspan.functions.ids import uuid
from loomspan.functions.strings import template
from loomspan.functions.values import as_variant, once, plain_null, whole
from loomspan.operators import timeline
from loomspan.plans.recurrences import Circle, Recurrence, Value

FIELDS = ["input", "output", "expected", "error"]
KINDS = ["task", "llm", "tool", "function"]
#: Metrics that the timeline writes.
RESERVED = ["start", "end"]
Slot = Callable[["Context"], Column]


@dataclass
class Span:
    """A span block; ``kind`` is task, llm, tool or function.

    ``fields`` may set input, output, expected and error; an unset one is SQL
    NULL in the events, a null value (a Column of some type) a VARIANT null. ``metadata`` and
    ``metrics`` have one value a key, ``tags`` are texts or functions, and
    ``vars`` are values drawn once an instance, for this block and those below.
    ``types`` declares types of values that read themselves in earlier
    iterations, where that can't be told from what else they are made of.
    """

    kind: str
    name: str
    fields: dict[str, Slot] = field(default_factory=dict)
    metrics: dict[str, Slot] = field(default_factory=dict)
    tags: list[str | Slot] = field(default_factory=list)
    children: list = field(default_factory=list)
    metadata: dict[str, Slot] | None = None
    vars: dict[str, Slot] = field(default_factory=dict)
    types: dict[str, str] = field(default_factory=dict)


@dataclass
class Repeat:
    """Its children ``count`` times, none for 0; ``vars`` are drawn anew each iteration."""

    name: str
    count: Slot
    children: list
    vars: dict[str, Slot] = field(default_factory=dict)


@dataclass
class Choice:
    """One of its children, all alike."""

    name: str
    children: list
    vars: dict[str, Slot] = field(default_factory=dict)


@dataclass
class Maybe:
    """All its children or none."""

    name: str
    children: list
    chance: float | Slot = 0.5
    vars: dict[str, Slot] = field(default_factory=dict)


def check_shape(shape: Span) -> None:
    """Refuse what no run could make sense of, before anything runs."""
    if not isinstance(shape, Span) or shape.kind != "task":
        raise ValueError("a trace is a span of kind task")
    seen: set[str] = set()

    def walk(block) -> None:
        for name in block.vars:
            if name in seen:
                raise ValueError(f"the variable {name} is declared twice")
            seen.add(name)
        if isinstance(block, Span):
            if block.kind not in KINDS:
                raise ValueError(f"{block.name}: no span kind {block.kind}")
            if unknown := set(block.fields) - set(FIELDS):
                raise ValueError(f"{block.name}: no field {min(unknown)}")
            if taken := set(block.metrics) & set(RESERVED):
                raise ValueError(f"{block.name}: the metric {min(taken)} is reserved")
        elif not block.children:
            raise ValueError(f"{block.name} holds no block")
        for child in block.children:
            if not isinstance(child, (Span, Repeat, Choice, Maybe)):
                raise ValueError(f"{block.name}: not a block: {child!r}")
            walk(child)

    walk(shape)


class _Node:
    """A block in its place: what is known of it without any trace."""

    def __init__(self, block, above: _Node | None = None, position: int = 0, segment: str = ""):
        self.block, self.above, self.position, self.segment = block, above, position, segment
        self.address: tuple[int, ...] = (*above.address, position) if above else ()
        self.outer: list[_Node] = above.inner if above else []  # enclosing repeats
        self.inner = [*self.outer, self] if isinstance(block, Repeat) else self.outer
        names: Counter = Counter()
        self.children = []
        for i, child in enumerate(block.children):
            again = names[child.name]
            names[child.name] += 1
            self.children.append(_Node(child, self, i, f"/{child.name}" + (f"[{again}]" if again else "")))

    def chain(self) -> list[_Node]:
        return [*(self.above.chain() if self.above else []), self]


def _built(build: Slot, context: Context) -> Column:
    """A value; a plain null, which has no type, as VARIANT null."""
    made = build(context)
    return as_variant(None) if plain_null(made) else made if isinstance(made, Column) else F.lit(made)


def _each(count: Column) -> Column:
    """0 to count - 1; no element for 0."""
    return F.when(count > 0, F.sequence(F.lit(0).cast("bigint"), count - 1)).otherwise(F.expr("cast(array() as array<bigint>)"))


def _text(parts: list[Column | str]) -> Column:
    """Concatenation, with neighbouring literals joined."""
    out: list[Column | str] = []
    for p in parts:
        if isinstance(p, str) and out and isinstance(out[-1], str):
            out[-1] += p
        else:
            out.append(p)
    columns = [F.lit(p) if isinstance(p, str) else p.cast("string") for p in out] or [F.lit("")]
    return columns[0] if len(columns) == 1 else F.concat(*columns)


class _Shared:
    """Values of one shape that become columns of the roots, each after those it reads."""

    def __init__(self, seed: int, prefix: str, roots: DataFrame):
        self.seed, self.prefix, self.roots = seed, prefix, roots
        self.names: dict[tuple, str] = {}
        self.layers: list[tuple[str, Column]] = []
        self.inlined: list[tuple] = []
        self.busy: set[tuple] = set()
        self.readers: list[Callable[[Value, tuple[Column, ...]], Column | None]] = []

    @contextmanager
    def reading(self, reader: Callable[[Value, tuple[Column, ...]], Column | None]):
        """Values are asked of ``reader`` first; what it doesn't know goes on."""
        self.readers.append(reader)
        try:
            yield
        finally:
            self.readers.pop()

    def read(self, value: Value, indices: tuple[Column, ...]) -> Column:
        for reader in reversed(self.readers):
            if (found := reader(value, indices)) is not None:
                return found
        out = F.col(self.column(value))
        for i in indices:
            out = F.get(out, i.cast("int"))
        return out

    def made(self, value: Value, indices: tuple[Column, ...]) -> Column:
        return Context(self, value.node, indices, value.iterating).guarded(value.build)

    def times(self, loop: _Node, bound: tuple[Column, ...]) -> Column:
        return Context(self, loop, bound).times()

    def each(self, loop: _Node, bound: tuple[Column, ...]) -> Column:
        return _each(self.times(loop, bound))

    def nested(self, loops: list[_Node], bound: tuple[Column, ...], made: Callable[[tuple[Column, ...]], Column]) -> Column:
        """What is made in each iteration of the loops beyond ``bound``, in arrays."""
        if len(bound) == len(loops):
            return made(bound)
        return F.transform(self.each(loops[len(bound)], bound), lambda i: self.nested(loops, (*bound, i), made))

    def frame(self) -> DataFrame:
        """The roots with the columns so far."""
        return _with_slots(self.roots, self.layers)

    def column(self, value: Value) -> str:
        key, made = value.key, None
        if key in self.names:
            return self.names[key]
        if key in self.busy:
            raise Circle(key)
        self.busy.add(key)
        try:
            made = self.nested(value.loops, (), lambda bound: self.made(value, bound))
        except Circle as circle:
            if circle.key != key:
                raise
        finally:
            self.busy.discard(key)
        if key in self.names:  # a circle that it belongs to was solved meanwhile
            return self.names[key]
        if made is None:  # it reads itself, in earlier iterations
            found = Recurrence(self, value)
            name = f"{self.prefix}{len(self.names)}"
            self.layers += found.layers(name)
            self.names |= {k: f"{name}_{f}" for k, f in found.field.items()}
        else:
            self.names[key] = f"{self.prefix}{len(self.names)}"
            self.layers.append((self.names[key], made))
        return self.names[key]


class Context:
    """Where a value is evaluated: a block of one trace, in given iterations.

    What a field's function gets is its own block's context; references start
    from it. ``strict`` contexts were reached by a reference, and look for
    blocks only below themselves.
    """

    def __init__(self, shared: _Shared, node: _Node, indices: tuple[Column, ...] = (), iterating: bool = False, strict: bool = False):
        self.shared, self.node, self.indices, self.iterating, self.strict = shared, node, tuple(indices), iterating, strict

    @property
    def block(self):
        return self.node.block

    @property
    def path(self) -> Column:
        """The block's address, which all its draws take in."""
        return _text(self._pieces(lambda n: n.segment, "#"))

    @property
    def place(self) -> Column:
        """Sibling positions and iterations from the root."""
        return _text(self._pieces(lambda n: f".{n.position}" if n.above and n.above.above else str(n.position) if n.above else "", "."))

    def _pieces(self, piece: Callable[[_Node], str], between: str) -> list[Column | str]:
        out: list[Column | str] = []
        for n in self.node.chain():
            out.append(piece(n))
            level = len(n.outer)
            if isinstance(n.block, Repeat) and (n is not self.node or self.iterating):
                out += [between, self.indices[level]]
        return out

    # ------------------------------------------------------------ values

    def draw(self, slot: str, call: int = 0) -> Column:
        return draw(self.shared.seed, F.col("trace_index"), Pieces(self._pieces(lambda n: n.segment, "#")), slot, call)

    def value(self, slot: str, build: Slot) -> Column:
        """A value of this block, computed once for all that read it."""
        return self.shared.read(Value((self.node.address, self.iterating, slot), build, self.node, self.iterating), self.indices)

    def own(self, slot: str, build: Slot) -> Column:
        """A value of this block for its own event: that of the column, if others have read it so far."""
        key = (self.node.address, self.iterating, slot)
        if key in self.shared.names:
            return self.value(slot, build)
        self.shared.inlined.append(key)
        return _built(build, self)

    def guarded(self, build: Slot) -> Column:
        """The value where every choice and maybe above lets the block be, else null."""
        whether: Column | None = None
        for n, below in zip(self.node.chain(), self.node.chain()[1:]):
            at = Context(self.shared, n, self.indices[: len(n.inner)])
            if isinstance(n.block, Choice):
                here = at.chosen == below.position
            elif isinstance(n.block, Maybe):
                here = at.included
            else:
                continue
            whether = here if whether is None else whether & here
        made = _built(build, self)
        return made if whether is None else F.when(whether, made)

    def field(self, name: str, *steps: str | int | slice | Column) -> Column:
        """A field, a metric or metadata key (``name`` or ``metrics.name``, ``metadata.name``), or all ``metadata``, ``metrics`` or ``tags`` of this span.

        ``steps`` are keys, indexes and slices to go on with inside the value,
        each checked; the result is a VARIANT then, as whole objects are.
        """
        found = self._field(name)
        return objects.drill(found, *steps) if steps else found

    def _field(self, name: str) -> Column:
        self._must(Span, "fields")
        block = self.block
        keyed = {"metrics": block.metrics, "metadata": block.metadata}
        where, _, key = name.partition(".")
        if not key and name in block.fields:
            return self.value(name, block.fields[name])
        if name == "tags" and block.tags:
            return F.array(*[F.lit(t) if isinstance(t, str) else template(self.value(f"tag:{i}", t)) for i, t in enumerate(block.tags)])
        if name == "metadata" and block.metadata is not None or name == "metrics" and block.metrics:
            held = [as_variant(self.value(f"{name}.{k}", f)).alias(k) for k, f in sorted(keyed[name].items())]
            return F.to_variant_object(F.struct(*held)) if held else F.parse_json(F.lit("{}"))
        for kind, values in keyed.items():
            found = key if where == kind else name
            if (key == "" or where == kind) and found in (values or {}):
                return self.value(f"{kind}.{found}", values[found])
        raise KeyError(f"{block.name} has no field {name}")

    def var(self, name: str) -> Column:
        """A variable of the nearest block above that declares it, this one included."""
        for n in reversed(self.node.chain()):
            if name in n.block.vars:
                return Context(self.shared, n, self.indices[: len(n.inner)], isinstance(n.block, Repeat)).value(f"var:{name}", n.block.vars[name])
        raise KeyError(f"no variable {name} is in reach")

    def times(self) -> Column:
        """How often this repeat runs; a negative count is an error."""
        def checked(x: Context) -> Column:
            count = whole(x.block.count(x), "NonIntegerRepeatCount")
            return F.when(count < 0, fail("NegativeRepeatCount", "a count is negative", "bigint")).otherwise(count)

        return self.value("count", checked)

    @property
    def chosen(self) -> Column:
        """Which child this choice takes, from 0."""
        self._must(Choice, "chosen")
        return self.value("pick", lambda x: F.floor(x.draw("pick") * len(x.block.children)))

    @property
    def included(self) -> Column:
        """Whether this maybe takes place."""
        self._must(Maybe, "included")

        def taken(x: Context) -> Column:
            chance = x.block.chance
            p = chance(x) if callable(chance) else F.lit(float(chance))
            return x.draw("chance") < F.when((p < 0) | (p > 1), fail("ChanceOutOfRange", "a chance is not in 0..1", "double")).otherwise(p)

        return self.value("chance", taken)

    def _must(self, kind: type, what: str) -> None:
        if not isinstance(self.block, kind):
            raise KeyError(f"{self.block.name} is no {kind.__name__.lower()} and has no {what}")

    # ------------------------------------------------------------ references

    @property
    def trace(self) -> Context:
        return Context(self.shared, self.node.chain()[0])

    @property
    def this(self) -> Context:
        """The innermost span around, past choices, maybes and repeats."""
        n = next(n for n in reversed(self.node.chain()) if isinstance(n.block, Span))
        return Context(self.shared, n, self.indices[: len(n.inner)])

    def child(self, name: str, kind: str | None = None, position: int | Column | None = None) -> Context | Several:
        """The block of that name (and kind) below the nearest block above that has one.

        Of several, ``position`` (from 0) takes one; a Column as position
        leaves that to each trace, and only fields can follow.
        """
        for n in reversed(self.node.chain()):
            found = [c for c in n.children if c.block.name == name and (kind is None or kind == (c.block.kind if isinstance(c.block, Span) else type(c.block).__name__.lower()))]
            if found:
                if len(self.indices) < len(n.inner):
                    raise ValueError(f"{n.block.name} is repeated: name an iteration or a slice of it")
                each = [Context(self.shared, c, self.indices[: len(c.outer)], strict=True) for c in found]
                if isinstance(position, Column):
                    return Several(each, position)
                if position is None and len(found) > 1:
                    raise ValueError(f"there are {len(found)} blocks {name}: name a position")
                if not 0 <= (position or 0) < len(found):
                    raise IndexError(f"there is no block {name} in position {position}")
                return each[position or 0]
            if self.strict:
                break
        raise KeyError(f"no block {name} is in reach")

    def iteration(self, i: int | Column) -> Context:
        """One iteration of this repeat, from 0; beyond its count is an error."""
        self._collection()
        index = whole(i, "NonIntegerIndex")
        checked = F.when((index >= 0) & (index < self.times()), index).otherwise(fail("IndexOutOfBounds", "an iteration is out of bounds", "bigint"))
        return Context(self.shared, self.node, (*self.indices, checked), iterating=True, strict=True)

    def iterations(self, start: int | Column | None = None, end: int | Column | None = None) -> Slice:
        """Iterations from ``start`` to before ``end`` of this repeat; bounds beyond its count are cut to it, negative ones are errors."""
        self._collection()

        def bound(x: int | Column | None, default: Column) -> Column:
            if x is None:
                return default
            at = whole(x, "NonIntegerSliceBound")
            return F.when(at < 0, fail("NegativeSliceBound", "a slice bound is negative", "bigint")).otherwise(F.least(at, self.times()))

        low, high = bound(start, F.lit(0).cast("bigint")), bound(end, self.times())
        return Slice(F.transform(_each(high - low), lambda i: i + low), lambda i: Context(self.shared, self.node, (*self.indices, i), iterating=True, strict=True))

    def _collection(self) -> None:
        self._must(Repeat, "iterations")
        if len(self.indices) != len(self.node.outer):
            raise ValueError(f"{self.block.name} is an iteration already")

    def index(self, repeat: str | None = None) -> Column:
        """The current iteration, from 0, of the named or else the innermost repeat around."""
        return self.indices[self._level(repeat)]

    def count(self, repeat: str | None = None) -> Column:
        level = self._level(repeat)
        return Context(self.shared, self._loops()[level], self.indices[:level]).times()

    def _loops(self) -> list[_Node]:
        return self.node.inner if self.iterating else self.node.outer

    def _level(self, repeat: str | None) -> int:
        for level in reversed(range(len(self._loops()))):
            if repeat is None or self._loops()[level].block.name == repeat:
                return level
        raise KeyError(f"no repeat {repeat or ''} is around")

    # ------------------------------------------------------------ events

    def below(self) -> Iterator[Context]:
        for c in self.node.children:
            yield Context(self.shared, c, self.indices)

    def size(self) -> int | Column:
        """Events of this block and all below."""
        if isinstance(self.block, Repeat):
            once = sum((x.size() for x in Context(self.shared, self.node, (*self.indices, F.lit(0).cast("bigint")), True).below()), 0)
            if isinstance(once, int):
                return self.times() * once
            each = F.transform(_each(self.times()), lambda i: sum((x.size() for x in Context(self.shared, self.node, (*self.indices, i), True).below()), 0))
            return F.aggregate(each, F.lit(0).cast("bigint"), lambda a, b: a + b)
        sizes = [x.size() for x in self.below()]
        if isinstance(self.block, Choice):
            if len(set(map(str, sizes))) == 1 and isinstance(sizes[0], int):
                return sizes[0]
            return F.element_at(F.array(*[x if isinstance(x, Column) else F.lit(x).cast("bigint") for x in sizes]), (self.chosen + 1).cast("int"))
        if isinstance(self.block, Maybe):
            return F.when(self.included, sum(sizes, 0)).otherwise(0).cast("bigint")
        return sum(sizes, 1)

    def layout(self, numbers: dict[tuple, int], depth: int) -> list[Column | list[Column]]:
        """This block's events and all below in pre-order, each by its block's number and its iterations: lists of one event each, and arrays."""
        none = F.expr(f"cast(array() as array<struct<_b:int{''.join(f',_i{k}:bigint' for k in range(depth))}>>)")

        def joined(context: Context) -> Column:
            return _joined([part for x in context.below() for part in x.layout(numbers, depth)], none)

        if isinstance(self.block, Repeat):
            return [F.flatten(F.transform(_each(self.times()), lambda i: joined(Context(self.shared, self.node, (*self.indices, i), True))))]
        if isinstance(self.block, Choice):
            options, chosen = [_joined(x.layout(numbers, depth), none) for x in self.below()], self.chosen
            picked = F.when(chosen == 0, options[0])
            for i, x in enumerate(options[1:], 1):
                picked = picked.when(chosen == i, x)
            return [F.coalesce(picked, none)]
        if isinstance(self.block, Maybe):
            return [F.when(self.included, joined(self)).otherwise(none)]
        indices = [*self.indices, *[F.lit(0)] * (depth - len(self.indices))]
        own = F.struct(F.lit(numbers[self.node.address]).alias("_b"), *[i.cast("bigint").alias(f"_i{k}") for k, i in enumerate(indices)])
        return [[own], *[part for x in self.below() for part in x.layout(numbers, depth)]]

    def event(self) -> dict[str, Column | list[Column]]:
        """What this span's event says, in its iterations; unset fields are not in it, metrics are keys and values."""
        block, size = self.block, self.size()

        def keyed(kind: str, values: dict[str, Slot]) -> list[Column]:
            return [x for k, f in values.items() for x in (F.lit(k), as_variant(self.own(f"{kind}.{k}", f)))]

        above = next((n for n in reversed(self.node.chain()[:-1]) if isinstance(n.block, Span)), None)
        out = {"place": self.place, "size": (F.lit(size) if isinstance(size, int) else size).cast("bigint")}
        if above is not None:
            out["parent"] = Context(self.shared, above, self.indices[: len(above.inner)]).place
        out |= {f: as_variant(self.own(f, block.fields[f])) for f in FIELDS if f in block.fields}
        if block.metadata is not None:
            out["metadata"] = F.create_map(*keyed("metadata", block.metadata)).cast("map<string,variant>") if block.metadata else _no_keys()
        if block.metrics:
            out["metrics"] = keyed("metrics", block.metrics)
        if block.tags:
            out["tags"] = F.array(*[F.lit(t) if isinstance(t, str) else template(self.own(f"tag:{i}", t)) for i, t in enumerate(block.tags)])
        return out


def _joined(parts: list[Column | list[Column]], none: Column) -> Column:
    """One array of the parts; events that follow each other are one part of it."""
    arrays: list[Column | list[Column]] = []
    for part in parts:
        if isinstance(part, list) and arrays and isinstance(arrays[-1], list):
            arrays[-1] = arrays[-1] + part
        else:
            arrays.append(part)
    columns = [F.array(*x) if isinstance(x, list) else x for x in arrays] or [none]
    return columns[0] if len(columns) == 1 else F.concat(*columns)


def _no_keys() -> Column:
    return F.expr("cast(map() as map<string,variant>)")


class Several:
    """Blocks of one name, of which a position known in each trace takes one."""

    def __init__(self, each: list[Context], position: Column):
        self.each, self.position = each, whole(position, "NonIntegerIndex")

    def field(self, name: str, *steps: str | int | slice | Column) -> Column:
        """The field of the block taken; one that doesn't set it is an error where it is taken."""

        def of(x: Context) -> Column:
            try:
                return x.field(name, *steps)
            except KeyError:
                return fail("AbsentRefField", f"{x.block.name} has no field {name}")

        picked = F.when(self.position == 0, of(self.each[0]))
        for i, x in enumerate(self.each[1:], 1):
            picked = picked.when(self.position == i, of(x))
        return F.when((self.position >= 0) & (self.position < len(self.each)), picked).otherwise(fail("IndexOutOfBounds", "a position is out of bounds"))


class Slice:
    """Iterations of a repeat; what follows is read in each, into an array.

    A slice inside a slice gives an array of arrays, and so on.
    """

    def __init__(self, indices: Column, at: Callable[[Column], Context | Several | Slice]):
        self.indices, self.at = indices, at

    def _each(self, read: Callable) -> Column:
        return F.transform(self.indices, lambda i: read(self.at(i)))

    def child(self, name: str, kind: str | None = None, position: int | Column | None = None) -> Slice:
        return Slice(self.indices, lambda i: self.at(i).child(name, kind, position))

    def iteration(self, i: int | Column) -> Slice:
        return Slice(self.indices, lambda j: self.at(j).iteration(i))

    def iterations(self, start: int | Column | None = None, end: int | Column | None = None) -> Slice:
        return Slice(self.indices, lambda j: self.at(j).iterations(start, end))

    def field(self, name: str, *steps: str | int | slice | Column) -> Column:
        return self._each(lambda x: x.field(name, *steps))

    def index(self, repeat: str | None = None) -> Column:
        return self._each(lambda x: x.index(repeat))

    def count(self, repeat: str | None = None) -> Column:
        return self._each(lambda x: x.count(repeat))

    @property
    def chosen(self) -> Column:
        return self._each(lambda x: x.chosen)

    @property
    def included(self) -> Column:
        return self._each(lambda x: x.included)


_UNSET = {f: "variant" for f in FIELDS} | {"place": "string", "parent": "string", "size": "bigint", "metadata": "map<string,variant>", "tags": "array<string>"}


@dataclass
class _Compiled:
    """Columns to add to the roots in turn, the layout of a trace and its size, and what each block's events say."""

    layers: list[tuple[str, Column]]
    layout: Column
    size: Column
    spans: list[Span]
    events: list[dict[str, Column | list[Column]]]


def _compiled(roots: DataFrame, shapes: Span | Sequence[Span], seed: int) -> _Compiled:
    shapes = [shapes] if isinstance(shapes, Span) else list(shapes)
    nodes: list[_Node] = []

    def below(node: _Node) -> Iterator[_Node]:
        yield node
        for child in node.children:
            yield from below(child)

    for shape in shapes:
        check_shape(shape)
        nodes.append(_Node(shape))
    depth = max(len(n.inner) for node in nodes for n in below(node))
    columns = tuple(F.col(f"_i{k}") for k in range(depth))
    out, layouts, sizes = _Compiled([], F.lit(0), F.lit(0), [], []), [], []
    for t, node in enumerate(nodes):
        spans = [n for n in below(node) if isinstance(n.block, Span)]
        numbers = {n.address: len(out.spans) + i for i, n in enumerate(spans)}

        shared = _Shared(seed, f"_slot_{t}_", roots)
        top = Context(shared, node)
        layout, size = _joined(top.layout(numbers, depth), F.lit(None)), top.size()

        def event(n: _Node) -> tuple[dict, list[tuple]]:
            shared.inlined = []
            return Context(shared, n, columns[: len(n.outer)]).event(), shared.inlined

        found = [event(n) for n in spans]
        # what a later block turned out to read is a column by now
        events = [event(n)[0] if any(k in shared.names for k in inlined) else made for n, (made, inlined) in zip(spans, found)]
        layouts.append(layout), sizes.append((F.lit(size) if isinstance(size, int) else size).cast("bigint"))
        out.layers += shared.layers
        out.spans += [n.block for n in spans]
        out.events += events
    turn = F.pmod("trace_index", F.lit(len(shapes)))
    out.layout, out.size = layouts[0], sizes[0]
    if len(shapes) > 1:  # traces take the shapes in turn
        out.layout, out.size = F.when(turn == 0, layouts[0]), F.when(turn == 0, sizes[0])
        for t in range(1, len(shapes)):
            out.layout, out.size = out.layout.when(turn == t, layouts[t]), out.size.when(turn == t, sizes[t])
    return out


def _with_slots(roots: DataFrame, layers: list[tuple[str, Column]]) -> DataFrame:
    for name, made in layers:
        roots = roots.withColumn(name, made)
    return roots


#: Blocks whose values stand in one expression; more are looked up in a tree of such groups.
GROUP_BLOCKS = 16


def _by_block(found: list[tuple[int, Column]], rest: Column) -> Column:
    """The value of the event's block, by rising block numbers, else ``rest``.

    A tree finds the group of a block in a few comparisons. Groups are lambdas,
    which stay out of the generated code: with the values of very many blocks
    its methods would be too long for the JVM to compile.
    """

    def chain(part: list[tuple[int, Column]]) -> Column:
        picked = F.when(F.col("_b") == part[0][0], part[0][1])
        for b, value in part[1:]:
            picked = picked.when(F.col("_b") == b, value)
        return picked.otherwise(rest)

    def tree(part: list[tuple[int, Column]]) -> Column:
        if len(part) <= GROUP_BLOCKS:
            return once(F.col("_b"), lambda _: chain(part))
        middle = len(part) // 2
        return F.when(F.col("_b") < part[middle][0], tree(part[:middle])).otherwise(tree(part[middle:]))

    return rest if not found else chain(found) if len(found) <= GROUP_BLOCKS else tree(found)


def _exploded(traces: DataFrame, shape: _Compiled, keep: list[str], stamps: list[Column] = ()) -> DataFrame:
    """The events of all traces, with the ``keep`` columns of their roots; ``stamps`` are keys and values that every event's metrics get."""
    rows = traces.select("*", F.posexplode(shape.layout).alias("ordinal", "_e")).select("*", "_e.*")

    def of_block(name: str) -> Column:
        found = [(b, event[name]) for b, event in enumerate(shape.events) if name in event]
        rest = F.lit(None).cast(_UNSET[name]) if name != "metrics" else F.create_map(*stamps).cast("map<string,variant>") if stamps else _no_keys()
        if name == "metrics":
            found = [(b, F.create_map(*x, *stamps).cast("map<string,variant>")) for b, x in found]
        return _by_block(found, rest)

    names, kinds = (F.get(F.array(*[F.lit(getattr(x, f)) for x in shape.spans]), F.col("_b")) for f in ("name", "kind"))
    rows = rows.withColumn("_size", of_block("size"))
    columns = {f: of_block(f) for f in ("place", "parent", *FIELDS, "metadata", "metrics", "tags")}
    last = (F.col("ordinal") + F.col("_size") - 1).cast("int").alias("last")
    return rows.select("trace_index", *keep, "ordinal", names.alias("name"), kinds.alias("type"), *[x.alias(f) for f, x in columns.items()], last)


def shape_events(roots: DataFrame, shapes: Span | Sequence[Span], seed: int) -> DataFrame:
    """Events of all traces with their pre-order ordinals and last descendants: one narrow pass, fit for streams."""
    shape = _compiled(roots, shapes, seed)
    return _exploded(_with_slots(roots, shape.layers), shape, [])


def generate(roots: DataFrame, shapes: Span | Sequence[Span], seed: int, now_micros: int, over_micros: int, spread=timeline.linear, salt: str = "run") -> DataFrame:
    """Events with order, times, ids and links.

    ``roots`` has one row a trace: trace_index, numbered from 0 without a gap
    (which is checked), and any columns that fields use. Of several shapes
    traces take one each in turn. Nothing is shuffled: a first pass over the
    counts and picks alone finds the longest trace, a second writes the events.
    """
    shape = _compiled(roots, shapes, seed)
    traces = _with_slots(roots, shape.layers)
    whole = timeline.checked_totals(traces.select("trace_index", shape.size.alias("events")))
    placed = timeline.anchored(traces, whole, F.col("trace_index"), now_micros, over_micros, spread)
    rooted = placed.withColumn("root_span_id", uuid(salt, F.col("trace_index"), F.lit("")))
    start, end = (F.col("anchor") + x.cast("bigint") * timeline.SLOT_MICROS for x in (F.col("ordinal"), F.col("ordinal") + F.col("_size")))
    stamps = [F.lit("start"), (start / 1e6).cast("variant"), F.lit("end"), (end / 1e6).cast("variant")]
    timed = timeline.slots(_exploded(rooted, shape, ["anchor", "root_span_id"], stamps)).withColumn("created", timeline.created(F.col("start_micros")))
    return timeline.linked(timed, salt)
