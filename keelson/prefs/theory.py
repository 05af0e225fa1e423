"""From rules to comparisons.

For each attribute the bounds that rules mention cut its line into segments: points, and the open
stretches between and beyond them. A predicate is a set of segments. A comparison says: a tuple in
`best` beats one in `worst` if they are equal on all attributes outside `free`. Each rule is one;
two compose if some tuple can stand in between. Composing to a fixpoint, dropping comparisons that
a wider one covers, gives exactly the transitive closure over the whole domain, also through tuples
that the data don't hold."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..lang.ast import Predicate, Rule
from ..lang.tokens import LanguageError

#: Comparisons that a theory may come to; more is a theory that no plan should hold.
MOST = 4000
Sets = dict[str, frozenset[int]]


@dataclass(frozen=True)
class Comparison:
    best: tuple[tuple[str, frozenset[int]], ...]
    worst: tuple[tuple[str, frozenset[int]], ...]
    free: frozenset[str]


class Theory:
    """rules over the attributes `names` (upper case). `past` predicates of temporal rules are left
    to the caller: a theory is made of the rules that hold after some past."""

    def __init__(self, rules: list[Rule], names: list[str]) -> None:
        self.rules, self.names = list(rules), list(names)
        for r in rules:
            self._check(r)
        self._check_order()
        self.bounds = {}
        for r in rules:
            for p in (*(c for c in r.condition if not c.past), r.best, r.worst):
                self.bounds.setdefault(p.name, set()).update(x for x in (p.low, p.high) if x is not None)
        for name, values in self.bounds.items():
            if len({isinstance(v, str) for v in values}) > 1:
                raise LanguageError(f"{name} is compared with text and with numbers")
        self.bounds = {k: sorted(v) for k, v in self.bounds.items()}
        self.comparisons = self._closed()
        for c in self.comparisons:
            low, high = dict(c.best), dict(c.worst)
            if all(self._set(low, a) & self._set(high, a) for a in self.bounds):
                raise LanguageError("the preferences contradict each other: a tuple would beat itself")

    # -- rules -------------------------------------------------------------------------------
    def _check(self, r: Rule) -> None:
        here = {c.name for c in r.condition if not c.past}
        used = {*here, r.best.name, r.worst.name, *r.indifferent, *(c.name for c in r.condition if c.name)}
        if unknown := used - set(self.names):
            raise LanguageError(f"unknown attributes in a preference: {', '.join(sorted(unknown))}")
        if r.best.name != r.worst.name:
            raise LanguageError(f"a rule prefers values of one attribute, not {r.best.name} and {r.worst.name}")
        if r.best.name in here or r.best.name in r.indifferent:
            raise LanguageError(f"{r.best.name} is preferred, so it can't be a condition or indifferent")
        if both := here & set(r.indifferent):
            raise LanguageError(f"a condition can't be indifferent: {', '.join(sorted(both))}")

    def _check_order(self) -> None:
        """What conditions lead to, and what preferences override, must not run in a circle."""
        after: dict[str, set[str]] = {}
        for r in self.rules:
            for c in r.condition:
                if not c.past:
                    after.setdefault(c.name, set()).add(r.best.name)
            after.setdefault(r.best.name, set()).update(r.indifferent)
        done: set[str] = set()

        def visit(a: str, path: tuple[str, ...]) -> None:
            if a in path:
                raise LanguageError(f"the preferences run in a circle: {' -> '.join((*path, a))}")
            if a not in done:
                for b in after.get(a, ()):
                    visit(b, (*path, a))
                done.add(a)

        for a in list(after):
            visit(a, ())

    # -- segments ----------------------------------------------------------------------------
    def _all(self, name: str) -> frozenset[int]:
        return frozenset(range(2 * len(self.bounds[name]) + 1))

    def _set(self, sets: Sets, name: str) -> frozenset[int]:
        return sets.get(name) or self._all(name)

    def segments(self, p: Predicate) -> frozenset[int]:
        """Segment 2i lies below bound i, segment 2i + 1 is bound i itself."""
        b = self.bounds[p.name]
        low = 0 if p.low is None else 2 * b.index(p.low) + 1 + p.low_open
        high = 2 * len(b) if p.high is None else 2 * b.index(p.high) + 1 - p.high_open
        if low > high:
            raise LanguageError(f"an empty interval of {p.name}")
        return frozenset(range(low, high + 1))

    def column(self, name: str, sets: frozenset[int], value: Column) -> Column:
        """Whether a value lies in the segments."""
        b, tests, at = self.bounds[name], [], sorted(sets)
        while at:
            i = j = at[0]
            while j + 1 in sets:
                j += 1
            at = [x for x in at if x > j]
            parts = []
            if i == j and i % 2:
                parts.append(value == F.lit(b[i // 2]))
            else:
                if i:
                    parts.append(value >= F.lit(b[i // 2]) if i % 2 else value > F.lit(b[i // 2 - 1]))
                if j < 2 * len(b):
                    parts.append(value <= F.lit(b[j // 2]) if j % 2 else value < F.lit(b[j // 2]))
            tests.append(reduce(Column.__and__, parts, F.lit(True)))
        return reduce(Column.__or__, tests)

    def test(self, sets: tuple[tuple[str, frozenset[int]], ...], of) -> Column:
        """Whether a tuple lies in all the sets; of: attribute name -> its column."""
        return F.coalesce(reduce(Column.__and__, (self.column(a, s, of(a)) for a, s in sets), F.lit(True)), F.lit(False))

    # -- closure -----------------------------------------------------------------------------
    def _make(self, best: Sets, worst: Sets, free: frozenset[str]) -> Comparison:
        """Attributes that must be equal get one set on both sides; whole lines are left out."""
        for a in {*best, *worst} - free:
            best[a] = worst[a] = self._set(best, a) & self._set(worst, a)
        kept = lambda s: tuple(sorted((a, v) for a, v in s.items() if v != self._all(a)))
        return Comparison(kept(best), kept(worst), free)

    def direct(self) -> list[Comparison]:
        out = []
        for r in self.rules:
            given: Sets = {}
            for c in r.condition:
                if not c.past:
                    given[c.name] = self.segments(c)  # the last word on an attribute holds
            a = r.best.name
            out.append(self._make({**given, a: self.segments(r.best)}, {**given, a: self.segments(r.worst)}, frozenset({a, *r.indifferent})))
        return out

    def _composed(self, x: Comparison, y: Comparison) -> Comparison | None:
        xb, xw, yb, yw = dict(x.best), dict(x.worst), dict(y.best), dict(y.worst)
        best, worst = {}, {}
        for a in {*xb, *xw, *yb, *yw}:
            b, m, w = self._set(xb, a), self._set(xw, a) & self._set(yb, a), self._set(yw, a)
            if a not in x.free:  # the one in between has the better one's value
                b = m = b & m
            if a not in y.free:
                w = m = w & m
                if a not in x.free:
                    b = m
            if not (b and m and w):
                return None
            best[a], worst[a] = b, w
        return self._make(best, worst, x.free | y.free)

    def _covers(self, wide: Comparison, c: Comparison) -> bool:
        if not c.free <= wide.free:
            return False
        cb, cw = dict(c.best), dict(c.worst)
        return all(self._set(cb, a) <= s for a, s in wide.best) and all(self._set(cw, a) <= s for a, s in wide.worst)

    def _closed(self) -> list[Comparison]:
        known: list[Comparison] = []
        fresh = self.direct()
        rules = list(fresh)
        while fresh:
            c = fresh.pop(0)
            if any(self._covers(k, c) for k in known):
                continue
            known = [k for k in known if not self._covers(c, k)]
            known.append(c)
            if len(known) > MOST:
                raise LanguageError(f"the preferences come to more than {MOST} comparisons")
            fresh += [n for r in rules if (n := self._composed(c, r)) is not None]
        return known
