"""Syntax trees."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class Name:
    """An attribute, by its name and perhaps its table's."""

    name: str
    table: str | None = None


@dataclass(frozen=True)
class Value:
    value: int | float | str


@dataclass(frozen=True)
class Current:
    """CURRENT(): the instant that is looked at."""


@dataclass(frozen=True)
class Arith:
    op: str
    left: object
    right: object


@dataclass(frozen=True)
class Aggregate:
    function: str
    of: object  # an expression, or None for COUNT(*)


@dataclass(frozen=True)
class Star:
    table: str | None = None


@dataclass(frozen=True)
class Item:
    what: object
    alias: str | None = None


@dataclass(frozen=True)
class Window:
    """range: instants, None for unbounded; slide: instants."""

    range: int | None
    slide: int = 1


@dataclass(frozen=True)
class Source:
    name: str
    window: Window | None = None
    alias: str | None = None


@dataclass(frozen=True)
class Comparison:
    left: object
    op: str
    right: object
    negated: bool = False


@dataclass(frozen=True)
class Predicate:
    """low <(=) attribute <(=) high; None for no bound."""

    name: str
    low: object = None
    low_open: bool = False
    high: object = None
    high_open: bool = False
    #: None, FIRST, PREVIOUS, SOME or ALL: the past that it speaks of (FIRST has no attribute).
    past: str | None = None


@dataclass(frozen=True)
class Rule:
    condition: tuple[Predicate, ...]
    best: Predicate
    worst: Predicate
    indifferent: tuple[str, ...] = ()


@dataclass(frozen=True)
class Select:
    items: tuple[Item, ...]
    sources: tuple[Source, ...]
    where: tuple[Comparison, ...] = ()
    any_of: bool = False
    groups: tuple[Name, ...] = ()
    rules: tuple[Rule, ...] = ()
    distinct: bool = False
    top: int | None = None


@dataclass(frozen=True)
class Bag:
    """first op1 second op2 third ..., from the left, all operations alike."""

    first: Select
    rest: tuple[tuple[str, Select], ...] = ()


@dataclass(frozen=True)
class ToStream:
    kind: str
    source: Source


@dataclass(frozen=True)
class Sequences:
    identifier: tuple[str, ...]
    window: Window
    source: Source | ToStream
    consecutive: bool = False
    ends: bool = False
    shortest: int | None = None
    longest: int | None = None
    top: int | None = None
    rules: tuple[Rule, ...] = ()


@dataclass(frozen=True)
class Register:
    """An entry of an environment file."""

    kind: str  # TABLE, STREAM or QUERY
    name: str
    input: str
    attributes: tuple[tuple[str, str], ...] = ()
    output: str | None = None
    changes: bool = field(default=False)
