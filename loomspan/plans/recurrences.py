"""Values that read themselves through earlier iterations of a repeat.

A running total reads the total of the iteration before; a chat's input reads
the outputs so far, which read their own inputs. Such values refer to each other
in a circle, but never to one that isn't there yet: they are found as a strongly
connected group of values and evaluated together, by one aggregate over the
iterations that carries a struct with an array for each value. Inside an
iteration they stand in the order in which they read each other; a group that
also goes round an inner repeat is an aggregate in the aggregate. A circle
inside one iteration, or a read of an iteration that is still to come, is a
CircularReference.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column
from pyspark.sql import functions as F

from loomspan.functions.errors import fail
from loomspan.functions.values import once

Indices = tuple[Column, ...]


class CircularReference(ValueError):
    """A value needs itself to be there first."""


class Circle(Exception):
    """Raised inside while a value is built that turns out to read itself."""

    def __init__(self, key: tuple):
        self.key = key


@dataclass(frozen=True)
class Value:
    """One value of a block: how it is built, and where."""

    key: tuple
    build: Callable
    node: object
    iterating: bool

    @property
    def loops(self) -> list:
        """The repeats around it, from the outermost."""
        return self.node.inner if self.iterating else self.node.outer

    @property
    def name(self) -> str:
        return f"{self.node.block.name}: {self.key[-1]}"


def _unready(value: Value) -> Column:
    return fail("CircularReference", f"{value.name} reads an iteration that isn't there yet")


def _at(value: Column, indices: Indices) -> Column:
    for i in indices:
        value = F.get(value, i.cast("int"))
    return value


class Recurrence:
    """A group of values of one shape that read each other, and how they are evaluated together."""

    def __init__(self, shared, start: Value):
        self.shared = shared
        self.values: dict[tuple, Value] = {}
        #: reads of a value: the key, and the outermost repeat whose iteration differs from the reader's, by its level
        self.reads: dict[tuple, list[tuple[tuple, int | None]]] = {}
        todo = [start]
        while todo:
            value = todo.pop()
            if value.key in self.values or value.key in shared.names:
                continue
            self.values[value.key] = value
            found = self._reads(value)
            self.reads[value.key] = [(v.key, level) for v, level in found]
            todo += [v for v, _ in found]
        self.members = next(g for g in self._groups(list(self.values), lambda level: True) if start.key in g)
        self.field = {k: f"v{i}" for i, k in enumerate(self.members)}
        self.kinds = self._kinds()

    def _reads(self, value: Value) -> list[tuple[Value, int | None]]:
        here = tuple(F.col(f"_i{k}") for k in range(len(value.loops)))
        found: list[tuple[Value, int | None]] = []

        def noted(read: Value, indices: Indices) -> Column:
            level = None
            for k, (a, b) in enumerate(zip(value.loops, read.loops)):
                if a is not b:
                    break
                if indices[k] is not here[k]:
                    level = k
                    break
            found.append((read, level))
            return F.lit(None)

        with self.shared.reading(noted):
            for k, loop in enumerate(value.loops):
                self.shared.times(loop, here[:k])
            self.shared.made(value, here)
        return found

    def _groups(self, keys: list[tuple], counts: Callable[[int | None], bool]) -> list[list[tuple]]:
        """Strongly connected groups of ``keys`` over the reads that count, each after those it reads."""
        inside = set(keys)
        ahead = {k: {r for r, level in self.reads[k] if r in inside and counts(level)} for k in keys}
        reach: dict[tuple, set[tuple]] = {}
        for k in keys:
            seen, todo = set(), [k]
            while todo:
                for r in ahead[todo.pop()]:
                    if r not in seen:
                        seen.add(r), todo.append(r)
            reach[k] = seen
        groups, placed = [], set()
        for k in sorted(keys, key=lambda k: len(reach[k])):  # whoever is read reaches less
            if k not in placed:
                group = [r for r in keys if r == k or (r in reach[k] and k in reach[r])]
                groups.append(group), placed.update(group)
        return groups

    def _kinds(self) -> dict[tuple, str]:
        """Type of each member: as declared, or what the others' types come to, from unknown ones up."""
        declared = {k: getattr(self.values[k].node.block, "types", {}).get(k[-1]) for k in self.members}
        kinds = dict(declared)

        def typed(read: Value, indices: Indices) -> Column | None:
            if read.key not in self.field:
                return None
            return F.lit(None).cast(kinds[read.key]) if kinds[read.key] else F.lit(None)

        for _ in range(len(self.members) + 3):
            with self.shared.reading(typed):
                made = [self.shared.made(self.values[k], tuple(F.lit(0).cast("bigint") for _ in self.values[k].loops)) for k in self.members]
            try:
                schema = self.shared.frame().select(*[x.alias(self.field[k]) for k, x in zip(self.members, made)]).schema
            except AnalysisException as e:
                unknown = [self.values[k].name for k in self.members if not kinds[k]]
                if not unknown:
                    raise
                raise ValueError(f"{', '.join(unknown)}: declare its type, which can't be told from what it reads of itself") from e
            found = {k: declared[k] or f.dataType.simpleString() for k, f in zip(self.members, schema)}
            found = {k: None if x == "void" or "<void>" in x or ":void" in x else x for k, x in found.items()}
            if found == kinds:
                break
            kinds = found
        return {k: x or "string" for k, x in kinds.items()}

    def _kind(self, key: tuple, level: int) -> str:
        """Type of a member inside an iteration of the repeat at ``level``: arrays over the repeats further in."""
        deeper = len(self.values[key].loops) - level - 1
        return "array<" * deeper + self.kinds[key] + ">" * deeper

    def turns(self, members: list[tuple], bound: Indices) -> tuple[Column, int]:
        """Struct of the members' arrays over the repeat that their circle goes round, and that repeat's level.

        The struct stands in arrays over the repeats between ``bound`` and that level.
        """
        levels = [level for k in members for r, level in self.reads[k] if r in members and level is not None and level >= len(bound)]
        if not levels:
            raise CircularReference(f"{' and '.join(self.values[k].name for k in members)} refers to itself")
        level, first = min(levels), self.values[members[0]]
        for k in members:
            if len(self.values[k].loops) <= level or self.values[k].loops[level] is not first.loops[level]:
                raise CircularReference(f"{self.values[k].name} and {first.name} refer to each other from outside the repeat")
        loops = first.loops[: level + 1]
        start = F.struct(*[F.array().cast(f"array<{self._kind(k, level)}>").alias(self.field[k]) for k in members])

        def down(at: Indices) -> Column:
            each = self.shared.each(loops[len(at)], at)
            if len(at) < level:
                return F.transform(each, lambda i: down((*at, i)))
            return F.aggregate(each, start, lambda past, i: self._turn(members, level, past, (*at, i)))

        return down(bound), level

    def _turn(self, members: list[tuple], level: int, past: Column, bound: Indices) -> Column:
        """``past`` with one more iteration, that of ``bound``."""
        i = bound[level]

        def step(groups: list[list[tuple]], done: dict[tuple, Callable[[Indices], Column]], whole: dict[tuple, Column]) -> Column:
            if not groups:
                return F.struct(*[F.concat(past[self.field[k]], F.array(whole[k].cast(self._kind(k, level)))).alias(self.field[k]) for k in members])
            group, rest = groups[0], groups[1:]

            def read(value: Value, indices: Indices) -> Column | None:
                if value.key not in members or any(a is not b for a, b in zip(indices[:level], bound[:level])):
                    return None
                at, inner = indices[level], indices[level + 1 :]
                if at is i:
                    if value.key not in done:
                        raise CircularReference(f"{value.name} refers to itself")
                    return done[value.key](inner)
                now = done[value.key](inner) if value.key in done else _unready(value)
                earlier = _at(F.get(past[self.field[value.key]], at.cast("int")), inner)
                return F.when(at < i, earlier).otherwise(F.when(at == i, now).otherwise(_unready(value)))

            with self.shared.reading(read):
                if len(group) == 1 and all(r != group[0] or (level_ is not None and level_ <= level) for r, level_ in self.reads[group[0]]):
                    key = group[0]
                    made = self.shared.nested(self.values[key].loops, bound, lambda at: self.shared.made(self.values[key], at))
                    return once(made, lambda v: step(rest, done | {key: lambda inner: _at(v, inner)}, whole | {key: v}))
                made, inner_level = self.turns(group, bound)
            between = inner_level - level - 1

            def after(v: Column) -> Column:
                def reader(key: tuple) -> Callable[[Indices], Column]:
                    return lambda inner: _at(_at(v, inner[:between])[self.field[key]], inner[between:])

                return step(rest, done | {k: reader(k) for k in group}, whole | {k: _field(v, self.field[k], between) for k in group})

            return once(made, after)

        return step(self._groups(members, lambda at: at is None or at > level), {}, {})

    def layers(self, name: str) -> list[tuple[str, Column]]:
        """Columns to add to the roots in turn: the group's struct, then each member in arrays over its repeats."""
        made, level = self.turns(self.members, ())
        return [(name, made), *((f"{name}_{self.field[k]}", _field(F.col(name), self.field[k], level)) for k in self.members)]


def _field(value: Column, name: str, depth: int) -> Column:
    """A field of structs that stand ``depth`` arrays deep."""
    return F.transform(value, lambda x: _field(x, name, depth - 1)) if depth else value[name]
