"""BEST through comparisons against a search that applies one rule after another."""

import itertools
import random

import pytest

from keelson.lang.parser import parse_theory
from keelson.lang.tokens import LanguageError
from keelson.operators import preference
from keelson.prefs.theory import Theory
from keelson.session import Session

NAMES = ["A", "B", "C"]


def inside(p, v):
    return (p.low is None or (v > p.low if p.low_open else v >= p.low)) and (p.high is None or (v < p.high if p.high_open else v <= p.high))


def direct(rule, x, y):
    at = NAMES.index(rule.best.name)
    if not (inside(rule.best, x[at]) and inside(rule.worst, y[at])):
        return False
    given = {c.name: c for c in rule.condition}
    if not all(inside(c, r[NAMES.index(n)]) for n, c in given.items() for r in (x, y)):
        return False
    return all(x[i] == y[i] for i, n in enumerate(NAMES) if n != rule.best.name and n not in rule.indifferent)


def beaten(rules, rows, domain):
    """All tuples over the domain that some row reaches by rules that worsen it."""
    lost, todo = set(), list(rows)
    while todo:
        x = todo.pop()
        for y in domain:
            if y not in lost and any(direct(r, x, y) for r in rules):
                lost.add(y)
                todo.append(y)
    return lost


def random_rule(rnd):
    pred = lambda n: rnd.choice([f"{n} = {rnd.randint(0, 3)}", f"{n} < {rnd.randint(1, 3)}", f"{n} >= {rnd.randint(1, 3)}", f"{rnd.randint(0, 1)} <= {n} < {rnd.randint(2, 4)}"])
    names = NAMES[:]
    rnd.shuffle(names)
    a, b, c = names
    condition = f"IF {pred(b)} THEN " if rnd.random() < 0.5 else ""
    free = [n for n in ((c,) if condition else (b, c)) if rnd.random() < 0.4]
    return f"{condition}{pred(a)} > {pred(a)}" + (f" [{', '.join(free)}]" if free else "")


def test_best_equals_search(spark):
    rnd, done = random.Random(7), 0
    # Half steps stand for the stretches between bounds, so that tuples in between exist.
    domain = list(itertools.product([x / 2 for x in range(-1, 9)], repeat=3))
    while done < 12:
        text = " AND ".join(random_rule(rnd) for _ in range(rnd.randint(1, 3)))
        rules = parse_theory(text)
        try:
            theory = Theory(list(rules), NAMES)
        except LanguageError:
            continue
        rows = [tuple(float(rnd.randint(0, 3)) for _ in NAMES) for _ in range(25)]
        df = spark.createDataFrame([(0, *r) for r in rows], "_TS long, A double, B double, C double")
        got = sorted(tuple(r)[1:] for r in preference.best(df, theory, NAMES).collect())
        lost = beaten(rules, rows, domain)
        assert got == sorted(r for r in rows if r not in lost), text
        done += 1


def test_bag_and_top(spark):
    theory = Theory(list(parse_theory("A = 1 > A = 2 AND A = 2 > A = 3")), ["A"])
    df = spark.createDataFrame([(t, a) for t in (0, 1) for a in (3, 2, 2, 1, 1, 7)], "_TS long, A long")
    assert sorted(r.A for r in preference.best(df, theory, ["A"]).filter("_TS = 1").collect()) == [1, 1, 7]
    for k, want in ((0, []), (2, [1, 1]), (4, [1, 1, 2, 7]), (9, [1, 1, 2, 2, 3, 7])):
        assert sorted(r.A for r in preference.top(df, theory, ["A"], k).filter("_TS = 0").collect()) == want


@pytest.mark.parametrize("rows", [[], [(0, None)], [(0, None), (0, 1)]])
def test_empty_and_null(spark, rows):
    theory = Theory(list(parse_theory("A = 1 > A = 2")), ["A"])
    assert preference.best(spark.createDataFrame(rows, "_TS long, A long"), theory, ["A"]).count() == len(rows)


# Worked examples with known answers.
PLAYERS = [("Messi", "attack", 25, "Spanish"), ("Ribeiro", "midfield", 21, "Spanish"), ("Oscar", "midfield", 15, "Spanish"), ("Soares", "attack", 14, "Spanish"), ("Silva", "defense", 9, "Brazilian")]
PLAYER_RULES = """(function = 'midfield') > (function = 'attack')[name, goals, league]
    AND (function = 'attack') > (function = 'defense')[name, goals, league]
    AND IF (function = 'midfield') THEN (goals <= 20) > (goals > 20)[name]
    AND IF (function = 'attack') THEN (goals > 20) > (goals <= 20)[name]"""
TRIPS = [("Angra", 2000.0, 4, "cruise"), ("Buzios", 2000.0, 5, "beach"), ("Salvador", 2600.0, 6, "cruise"), ("Belo Horizonte", 2700.0, 5, "urban"), ("Rio de Janeiro", 2600.0, 7, "beach")]
TRIP_RULES = """itinerary = 'cruise' BETTER itinerary = 'beach' [destination, duration]
    AND itinerary = 'beach' BETTER itinerary = 'urban' [price, destination]
    AND IF itinerary = 'cruise' THEN price < 2500.0 BETTER price >= 2500.0 [destination, duration]"""


@pytest.mark.parametrize(
    "table, names, kinds, rules, best",
    [(PLAYERS, "name function goals league", "string string long string", PLAYER_RULES, ["Oscar"]), (TRIPS, "destination price duration itinerary", "string double long string", TRIP_RULES, ["Angra"])],
)
def test_worked_examples(spark, table, names, kinds, rules, best):
    names = names.split()
    s = Session(spark, 1)
    s.register_relation("t", spark.createDataFrame(table, ", ".join(f"{n} {k}" for n, k in zip(names, kinds.split(), strict=True))), names)
    got = sorted(tuple(r)[:2] for r in s.query(f"SELECT * FROM t ACCORDING TO PREFERENCES {rules};").collect())
    assert got == [(ts, b) for ts in (0, 1) for b in best]
