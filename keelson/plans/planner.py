"""From syntax trees to DataFrames.

A relation is a DataFrame with one column per attribute, named `TABLE.ATTRIBUTE` while a query is
worked out. Sources are joined, filtered and, where that can be, grouped as intervals (`_vfrom`,
`_vto`); only then are they spread over their instants (`_TS`). Sources of a grouped join are condensed
before they meet. Nothing here runs a job but the loops of TOP(k) and of sequence preferences."""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from functools import reduce
from operator import mul

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import compare, floor_div
from ..lang import ast
from ..lang.tokens import LanguageError
from ..operators import bags, preference, windows
from ..operators import sequences as seq
from ..prefs.theory import Theory

_KIND = {"bigint": "INTEGER", "int": "INTEGER", "smallint": "INTEGER", "tinyint": "INTEGER", "double": "FLOAT", "float": "FLOAT", "string": "STRING"}


@dataclass
class Leaf:
    """Something that FROM can name.

    kind STREAM: rows has `_TS`, `_ORD`. kind TABLE: intervals (`_vfrom`, `_vto`), or if view is
    true, the relation at each instant. always: all rows hold at every instant."""

    name: str
    kind: str
    attributes: list[str]
    rows: DataFrame
    view: bool = False
    always: bool = False


@dataclass(frozen=True)
class Begun:
    """An aggregate worked out within a source: its column, that of the source's counts, the type,
    and the column that is true where the value could fail, so that it is still to be worked out."""

    column: str
    count: str
    kind: str
    unsure: str | None


@dataclass
class Relation:
    """span: of intervals, whether all hold always, start somewhere and stay (`from`), are single
    instants (`point`), or all are a window's (`window`), or none of these (`some`).

    Of condensed sources, rows has only the attributes that are still asked for; a row stands for as
    many tuples as the product of counts."""

    rows: DataFrame
    attributes: list[tuple[str, str]] = field(default_factory=list)  # (table, name)
    span: str = "some"
    counts: tuple[str, ...] = ()
    begun: dict[ast.Aggregate, Begun] = field(default_factory=dict)

    def find(self, n: ast.Name) -> str:
        got = [a for a in self.attributes if a[1] == n.name and n.table in (None, a[0])]
        if len(got) != 1:
            what = "unknown" if not got else "ambiguous"
            raise LanguageError(f"{what} attribute {n.table + '.' if n.table else ''}{n.name}")
        return f"{got[0][0]}.{got[0][1]}"


def names_in(e) -> list[ast.Name]:
    """The names in an expression, an aggregate or a comparison, `_TS` left out."""
    if isinstance(e, ast.Name):
        return [] if e.name == "_TS" else [e]
    if isinstance(e, ast.Aggregate):
        return names_in(e.of)
    return names_in(e.left) + names_in(e.right) if hasattr(e, "left") else []


def at_instant(e) -> bool:
    """Whether an expression, an aggregate or a comparison asks for the instant."""
    if isinstance(e, ast.Aggregate):
        return at_instant(e.of)
    return isinstance(e, ast.Current) or isinstance(e, ast.Name) and e.name == "_TS" or hasattr(e, "left") and (at_instant(e.left) or at_instant(e.right))


def exact(c: Column, kind: str) -> Column:
    """Numbers to add up: integers as decimals, as a part of a sum may be larger than the whole."""
    return c.cast("decimal(20,0)") if kind == "INTEGER" else c


class Planner:
    def __init__(self, leaves: dict[str, Leaf], last: int) -> None:
        self.leaves, self.last = leaves, last

    def plan(self, tree) -> tuple[DataFrame, str]:
        """The result by instant, and whether it is a TABLE or a STREAM."""
        if isinstance(tree, ast.ToStream):
            return self.to_stream(tree), "STREAM"
        if isinstance(tree, ast.Sequences):
            return self.sequence_query(tree), "TABLE"
        out = self.select(tree.first)
        for op, right in tree.rest:
            out = bags.OPERATIONS[op](out, self.select(right))
        return out, "TABLE"

    # -- leaves ------------------------------------------------------------------------------
    def leaf(self, name: str) -> Leaf:
        if name not in self.leaves:
            raise LanguageError(f"unknown table or stream {name}")
        return self.leaves[name]

    def intervals(self, s: ast.Source) -> DataFrame | None:
        """A source's intervals, or None if it is a view that has instants only."""
        leaf = self.leaf(s.name)
        if leaf.kind == "STREAM":
            if s.window is None:
                raise LanguageError(f"the stream {s.name} needs a window")
            return windows.windowed(leaf.rows.select("_TS", *(f"`{a}`" for a in leaf.attributes)), s.window.range, s.window.slide)
        if s.window is not None:
            raise LanguageError(f"{s.name} is a table; only streams have windows")
        return None if leaf.view else leaf.rows

    def source(self, s: ast.Source) -> Relation:
        """A source's intervals, its attributes named after it."""
        leaf, alias, held = self.leaf(s.name), s.alias or s.name, self.intervals(s)
        if held is None:
            span, held = "point", leaf.rows.withColumns({"_vfrom": F.col("_TS"), "_vto": F.col("_TS")})
        else:
            span = "always" if leaf.always else "some" if leaf.kind == "TABLE" else "from" if s.window.range is None else "window"
        return Relation(held.select("_vfrom", "_vto", *(F.col(f"`{a}`").alias(f"{alias}.{a}") for a in leaf.attributes)), [(alias, a) for a in leaf.attributes], span)

    # -- streams -----------------------------------------------------------------------------
    def to_stream(self, t: ast.ToStream) -> DataFrame:
        held, leaf = self.intervals(t.source), self.leaf(t.source.name)
        if held is None:
            if t.kind == "RSTREAM":
                return leaf.rows
            net = windows.changes(leaf.rows, leaf.attributes, last=self.last)
            return net.filter(F.col("_FL") == ("+" if t.kind == "ISTREAM" else "-")).drop("_FL")
        return {"ISTREAM": windows.istream, "DSTREAM": windows.dstream, "RSTREAM": windows.rstream}[t.kind](held, self.last)

    # -- bags --------------------------------------------------------------------------------
    def select(self, q: ast.Select) -> DataFrame:
        parts = [self.source(s) for s in q.sources]
        if len({a for p in parts for a, _ in p.attributes}) != len(parts):
            raise LanguageError("two sources of one name; give one an alias")
        if len(parts) > 1 and q.groups and not q.rules and any(isinstance(i.what, ast.Aggregate) for i in q.items):
            parts, q = self.condensed(parts, q)
        held = parts[0]
        for p in parts[1:]:
            held = self.joined(held, p, self.has_key(q, held, p))
        tests = self.tests(q)
        late = [t for t in tests if any(at_instant(c) for c in t)]
        for t in tests:
            if t not in late:
                held = replace(held, rows=held.rows.filter(self.any(t, held)))
        groups = bool(q.groups) or any(isinstance(i.what, ast.Aggregate) for i in q.items)
        if groups and not late and not q.rules and held.span != "point" and not any(at_instant(i.what) for i in q.items):
            out = self.grouped(held, q)
            return out.distinct() if q.distinct else out
        rows = windows.at_instants(held.rows, self.last) if held.span != "point" else held.rows.withColumnRenamed("_vfrom", "_TS").drop("_vto")
        whole = replace(held, rows=rows)
        for t in late:
            whole = replace(whole, rows=whole.rows.filter(self.any(t, whole)))
        if q.rules:  # without them TOP(k) says nothing
            whole = self.preferred(whole, q)
        out = self.grouped(whole, q) if groups else self.projected(whole, q)
        return out.distinct() if q.distinct else out

    def condensed(self, parts: list[Relation], q: ast.Select) -> tuple[list[Relation], ast.Select]:
        """The sources of a grouped join, with one row (and their number) for tuples that are equal in
        time and in all that later steps ask for, and what is left of the query: conditions on one
        source are met, aggregates of one source's attributes are begun. So the work grows with the
        sources, not with the pairs of a frequent key."""
        parts, where = list(parts), []
        whole = Relation(reduce(DataFrame.join, (p.rows.drop("_vfrom", "_vto") for p in parts)), [a for p in parts for a in p.attributes])
        at = {f"{t}.{n}": i for i, p in enumerate(parts) for t, n in p.attributes}
        columns = lambda e: {whole.find(n) for n in names_in(e)}
        for t in self.tests(q):
            on = {at[c] for e in t for c in columns(e)}
            if len(on) == 1 and not any(at_instant(e) for e in t):
                p = parts[i := on.pop()]
                parts[i] = replace(p, rows=p.rows.filter(self.any(t, p)))
            else:
                where += t
        needed = {whole.find(g) for g in q.groups}.union(*(columns(c) for c in where))
        mine: list[list[ast.Aggregate]] = [[] for _ in parts]
        for _, e in self.items(whole, q):
            if not isinstance(e, ast.Aggregate):
                continue
            self.aggregate(e, whole)  # refuses what is no aggregate
            if e.function == "COUNT":
                continue
            if len(on := {at[c] for c in columns(e)}) == 1 and not at_instant(e):
                mine[on.pop()].append(e)
            else:
                needed |= columns(e)
        return [self.condense(p, needed, mine[i], i) for i, p in enumerate(parts)], replace(q, where=tuple(where))

    def condense(self, p: Relation, needed: set[str], sums: list[ast.Aggregate], i: int) -> Relation:
        """One source, by its interval and the needed attributes. Values that could fail (too large,
        divided by zero) may belong to tuples that meet nothing: their attributes are kept instead."""
        rows, kept, begun, made = p.rows, {c: F.lit(True) for c in needed}, {}, []
        for k, e in enumerate(dict.fromkeys(sums)):
            (of, kind), unsure = self.expression(e.of, p, sure=True), None
            if isinstance(e.of, ast.Arith):
                names, unsure = [p.find(n) for n in names_in(e)], f"_u{i}_{k}"
                rows = rows.withColumn(unsure, reduce(lambda a, n: a & F.col(f"`{n}`").isNotNull(), names, of.isNull()))
                kept |= {n: kept.get(n, F.lit(False)) | F.col(unsure) for n in names}
            begun[e] = Begun(f"_p{i}_{k}", f"_n{i}", kind, unsure)
            made.append({"MIN": F.min, "MAX": F.max, "SUM": F.sum}[e.function](exact(of, kind) if e.function == "SUM" else of).alias(begun[e].column))
        by = [F.when(kept[c], F.col(f"`{c}`")).alias(c) for c in (f"{t}.{n}" for t, n in p.attributes) if c in kept]
        rows = rows.groupBy("_vfrom", "_vto", *by, *(b.unsure for b in begun.values() if b.unsure)).agg(F.count(F.lit(1)).alias(f"_n{i}"), *made)
        return replace(p, rows=rows, counts=(f"_n{i}",), begun=begun)

    @staticmethod
    def tests(q: ast.Select) -> list:
        """The parts of WHERE that all must hold; of each, one condition must."""
        return [] if not q.where else [q.where] if q.any_of else [[c] for c in q.where]

    def any(self, tests: list, r: Relation) -> Column:
        out = self.condition(tests[0], r)
        for t in tests[1:]:
            out = out | self.condition(t, r)
        return out

    def has_key(self, q: ast.Select, left: Relation, right: Relation) -> bool:
        """Whether WHERE holds an equality between the two, which then is the key of their join."""

        def side(e) -> str:
            names = names_in(e)
            of = lambda r: all(any(a[1] == n.name and n.table in (None, a[0]) for a in r.attributes) for n in names)
            return "" if not names or at_instant(e) else "left" if of(left) else "right" if of(right) else ""

        return not q.any_of and any(c.op == "=" and not c.negated and {side(c.left), side(c.right)} == {"left", "right"} for c in q.where)

    def joined(self, left: Relation, right: Relation, keyed: bool) -> Relation:
        """Pairs whose intervals overlap, with the overlap. Conditions of WHERE follow as a filter,
        which becomes the join's. Blocks of instants are a key where there is no other, and a second
        one between windows, so that a value met through all times is no one task's; a pair is made
        in the block where its overlap starts. Tables that hold always need none."""
        a, b = left.rows, right.rows.withColumnsRenamed({"_vfrom": "_rfrom", "_vto": "_rto"})
        spans = {left.span, right.span}
        if "always" in spans:
            both = a.join(b)
        elif spans == {"point"}:
            both = a.join(b, F.col("_vfrom") == F.col("_rfrom"))
        else:
            last = F.lit(self.last).cast("long")
            on = (F.col("_vfrom") <= F.coalesce("_rto", last)) & (F.col("_rfrom") <= F.coalesce("_vto", last))
            if not keyed or spans == {"window"}:
                a, b = windows.by_block(a, "_vfrom", "_vto", "_lblock", self.last), windows.by_block(b, "_rfrom", "_rto", "_rblock", self.last)
                on = on & (F.col("_lblock") == F.col("_rblock")) & (F.col("_lblock") == windows.block(F.greatest("_vfrom", "_rfrom", F.lit(0))))
            both = a.join(b, on)
        attributes = left.attributes + right.attributes
        span = spans.pop() if len(spans) == 1 else "point" if "point" in spans else "from" if spans == {"always", "from"} else "some"
        low, high = F.greatest("_vfrom", "_rfrom").alias("_vfrom"), F.least("_vto", "_rto").alias("_vto")
        rest = [f"`{c}`" for c in left.rows.columns + right.rows.columns if c not in ("_vfrom", "_vto")]
        return Relation(both.select(low, high, *rest), attributes, span, left.counts + right.counts, left.begun | right.begun)

    def preferred(self, whole: Relation, q: ast.Select) -> Relation:
        names = [a for _, a in whole.attributes]
        for r in q.rules:
            for n in {r.best.name, r.worst.name, *r.indifferent, *(c.name for c in r.condition)}:
                whole.find(ast.Name(n))
        short = {f"{t}.{a}": a if names.count(a) == 1 else f"{t}.{a}" for t, a in whole.attributes}
        theory = Theory(list(q.rules), [*short.values()])
        rows = whole.rows.select("_TS", *(F.col(f"`{k}`").alias(v) for k, v in short.items()))
        rows = preference.best(rows, theory, [*short.values()]) if q.top is None else preference.top(rows, theory, [*short.values()], q.top)
        return Relation(rows.select("_TS", *(F.col(f"`{v}`").alias(k) for k, v in short.items())), whole.attributes)

    def condition(self, c: ast.Comparison, r: Relation) -> Column:
        (a, ta), (b, tb) = self.expression(c.left, r), self.expression(c.right, r)
        if (ta == "STRING") != (tb == "STRING"):
            raise LanguageError(f"{ta} is compared with {tb}")
        out = compare(c.op, a, b)
        return ~out if c.negated else out

    def expression(self, e, r: Relation, sure: bool = False) -> tuple[Column, str]:
        """The column and its type. sure: null where working it out could fail."""
        if isinstance(e, ast.Value):
            kind = "STRING" if isinstance(e.value, str) else "INTEGER" if isinstance(e.value, int) else "FLOAT"
            return (F.lit(e.value).cast("bigint") if kind == "INTEGER" else F.lit(e.value)), kind
        if isinstance(e, ast.Current) or isinstance(e, ast.Name) and e.name == "_TS":
            return F.col("_TS"), "INTEGER"
        if isinstance(e, ast.Name):
            name = r.find(e)
            kind = _KIND.get(dict(r.rows.dtypes)[name])
            if kind is None:
                raise LanguageError(f"{name} has a type that the language lacks: {dict(r.rows.dtypes)[name]}")
            return F.col(f"`{name}`"), kind
        (a, ta), (b, tb) = self.expression(e.left, r, sure), self.expression(e.right, r, sure)
        if ta != tb:
            raise LanguageError(f"{ta} {e.op} {tb}: both sides must be of one type")
        if ta == "STRING":
            if e.op != "+":
                raise LanguageError(f"no {e.op} for strings")
            return F.concat(a, b), ta
        if sure and e.op == "/":
            small = a.between(-(2**62), 2**62) & b.between(-(2**62), 2**62)
            return (F.when(small & (b != 0), floor_div(a, b)) if ta == "INTEGER" else F.try_divide(a, b)), ta
        if sure:
            return {"+": F.try_add, "-": F.try_subtract, "*": F.try_multiply}[e.op](a, b), ta
        if e.op == "/":
            return (floor_div(a, b) if ta == "INTEGER" else a / b), ta
        return {"+": a + b, "-": a - b, "*": a * b}[e.op], ta

    def items(self, r: Relation, q: ast.Select) -> list[tuple[str, object]]:
        """(name, expression) of each item: stars expanded, names made and told apart."""
        raw: list[tuple[str, object]] = []
        for i in q.items:
            if isinstance(i.what, ast.Star):
                got = [a for a in r.attributes if i.what.table in (None, a[0])]
                if not got:
                    raise LanguageError(f"unknown table {i.what.table}")
                raw += [(a, ast.Name(a, t)) for t, a in got]
                continue
            inner = i.what.of if isinstance(i.what, ast.Aggregate) else i.what
            raw.append((i.alias or (inner.name if isinstance(inner, ast.Name) and inner.name != "_TS" else "ATT"), i.what))
        out: list[tuple[str, object]] = []
        for name, what in raw:
            k = 2
            while name in {n for n, _ in out}:
                name, k = f"{name}_{k}", k + 1
            out.append((name, what))
        return out

    def projected(self, r: Relation, q: ast.Select) -> DataFrame:
        return r.rows.select("_TS", *(self.expression(e, r)[0].alias(n) for n, e in self.items(r, q)))

    def grouped(self, r: Relation, q: ast.Select) -> DataFrame:
        items = self.items(r, q)
        sums = [(n, e) for n, e in items if isinstance(e, ast.Aggregate)]
        if not q.groups or not sums:
            raise LanguageError("GROUP BY and an aggregate need each other")
        keys = {r.find(g): i for i, g in enumerate(q.groups)}
        out = ["_TS"]
        for n, e in items:
            if isinstance(e, ast.Aggregate):
                out.append(F.col(f"`{n}`"))
            elif isinstance(e, ast.Name) and r.find(e) in keys:
                out.append(F.col(f"_k{keys[r.find(e)]}").alias(n))
            else:
                raise LanguageError(f"{n} is neither grouped nor an aggregate")
        names = [f"_k{i}" for i in keys.values()]
        by = [F.col(f"`{k}`").alias(f"_k{i}") for k, i in keys.items()]
        made = [self.aggregate(e, r).alias(n) for n, e in sums]
        again = {n: {"MIN": F.min, "MAX": F.max}.get(e.function, F.sum)(F.col(f"`{n}`")) for n, e in sums}
        if "_TS" in r.rows.columns:
            return r.rows.groupBy("_TS", *by).agg(*made).select(*out)
        if r.span == "always":
            got = r.rows.groupBy(*by).agg(*made).withColumns({"_vfrom": F.lit(0).cast("long"), "_vto": F.lit(None).cast("long")})
            return windows.at_instants(got, self.last).select(*out)
        if r.span == "from":  # a group's values change only where tuples come
            start = F.greatest("_vfrom", F.lit(0)).alias("_vfrom")
            got = r.rows.filter(F.col("_vfrom") <= self.last).groupBy(start, *by).agg(*made)
            order = Window.partitionBy(*names).orderBy("_vfrom")
            so_far = order.rowsBetween(Window.unboundedPreceding, 0)
            got = got.select(*names, *(c.over(so_far).alias(n) for n, c in again.items()), "_vfrom", (F.lead("_vfrom").over(order) - 1).alias("_vto"))
            return windows.at_instants(got, self.last).select(*out)
        got = windows.at_instants(r.rows.groupBy("_vfrom", "_vto", *by).agg(*made), self.last)
        return got.groupBy("_TS", *names).agg(*(c.alias(n) for n, c in again.items())).select(*out)

    def aggregate(self, a: ast.Aggregate, r: Relation) -> Column:
        if r.counts:
            return self.finished(a, r)
        if a.function == "COUNT":
            if a.of is not None:
                self.expression(a.of, r)
            return F.count(F.lit(1))
        of, kind = self.expression(a.of, r)
        if a.function == "SUM" and kind == "STRING":
            raise LanguageError("no SUM of strings")
        return {"MIN": F.min, "MAX": F.max, "SUM": F.sum}[a.function](of)

    def finished(self, a: ast.Aggregate, r: Relation) -> Column:
        """An aggregate over condensed sources."""
        times = lambda names: reduce(mul, (F.col(n) for n in names))
        if a.function == "COUNT":
            return F.sum(times(r.counts))
        b = r.begun.get(a)
        of, kind = self.expression(a.of, r) if b is None or b.unsure else (None, b.kind)
        if a.function != "SUM":
            value = of if b is None else F.when(F.col(b.unsure), of).otherwise(F.col(b.column)) if b.unsure else F.col(b.column)
            return {"MIN": F.min, "MAX": F.max}[a.function](value)
        value = None if of is None else exact(of, kind) * times(r.counts)
        if b is not None:
            part = F.col(b.column) * times([n for n in r.counts if n != b.count])
            value = F.when(F.col(b.unsure), value).otherwise(part) if b.unsure else part
        return F.sum(value).cast("bigint" if kind == "INTEGER" else "double")

    # -- sequences ---------------------------------------------------------------------------
    def sequence_table(self, q: ast.Sequences) -> tuple[DataFrame, list[str], list[str]]:
        """Sequences before the preferences, the identifier and all attributes."""
        if isinstance(q.source, ast.ToStream):
            rows = self.to_stream(q.source)
            names = [c for c in rows.columns if c != "_TS"]
            rows = rows.withColumn("_ORD", F.monotonically_increasing_id())
        else:
            leaf = self.leaf(q.source.name)
            if leaf.kind != "STREAM":
                raise LanguageError(f"{q.source.name} is no stream")
            rows, names = leaf.rows, leaf.attributes
            if "_ORD" not in rows.columns:
                rows = rows.withColumn("_ORD", F.monotonically_increasing_id())
        if missing := set(q.identifier) - set(names):
            raise LanguageError(f"unknown identifier {', '.join(sorted(missing))}")
        if set(names) <= set(q.identifier):
            raise LanguageError("a sequence needs an attribute beside its identifier")
        out = seq.sequences(rows, list(q.identifier), names, q.window.range, q.window.slide, self.last)
        if q.consecutive:
            out = seq.consecutive(out)
        if q.ends:
            out = seq.suffixes(out)
        return seq.of_length(out, q.shortest, q.longest), list(q.identifier), names

    def sequence_query(self, q: ast.Sequences) -> DataFrame:
        out, ids, names = self.sequence_table(q)
        if q.rules:
            out = seq.best_sequences(out, q.rules, ids, names) if q.top is None else seq.top_sequences(out, q.rules, ids, names, q.top)
        return seq.flat(out, ids, names)
