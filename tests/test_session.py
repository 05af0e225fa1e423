"""Sessions over files, late rows, invalid deletions, views, sinks, and continuous runs."""

import random
from collections import Counter

import pytest

from keelson.lang.tokens import LanguageError
from keelson.operators import windows
from keelson.session import Session
from keelson.streaming.runner import Continuous


@pytest.fixture
def session(spark, tmp_path):
    (tmp_path / "t.csv").write_text("_ts, _fl, a, b\n0,+,1,x\n0,+,1,x\n1,-,1,x\n1,-,9,z\n2,+,2,y\n1,+,5,late\n3,-,1,x\n3,-,1,x\n")
    (tmp_path / "s.csv").write_text("b, _TS, a\nu,1,1\nu,1,2\nu,2,3\nv,2,7\nu,4,4\nv,3,0\n")
    s = Session(spark, 5)
    s.register_csv("TABLE", "t", [("a", "INTEGER"), ("b", "STRING")], str(tmp_path / "t.csv"))
    s.register_csv("STREAM", "s", [("a", "INTEGER"), ("b", "STRING")], str(tmp_path / "s.csv"))
    return s


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_table_log(session):
    assert rows(session.query("SELECT * FROM t;")) == [(0, 1, "x"), (0, 1, "x"), (1, 1, "x"), (2, 1, "x"), (2, 2, "y"), (3, 2, "y"), (4, 2, "y"), (5, 2, "y")]
    assert rows(session.query("SELECT DSTREAM FROM t;")) == [(1, 1, "x"), (3, 1, "x")]


def test_last_tuple_of_an_instant_counts(session):
    got = rows(session.query("SELECT SUBSEQUENCE CONSECUTIVE TUPLES FROM SEQUENCE IDENTIFIED BY b [RANGE 3 SECOND] FROM s;"))
    assert got == [(1, 1, "u", 2), (2, 1, "u", 2), (2, 1, "v", 7), (2, 2, "u", 3), (3, 1, "u", 2), (3, 1, "v", 7), (3, 2, "u", 3), (4, 1, "u", 3), (4, 1, "u", 4), (4, 1, "v", 7), (5, 1, "u", 4)]


def test_views_and_changes(session):
    session.register_query("q", "SELECT a FROM t WHERE a > 0;")
    assert rows(session.changes("q")) == [(0, "+", 1), (0, "+", 1), (1, "-", 1), (2, "+", 2), (3, "-", 1)]
    assert rows(session.query("SELECT q.a, COUNT(*) AS n FROM q GROUP BY a;"))[0] == (0, 1, 2)
    with pytest.raises(LanguageError):
        session.register_query("Q", "SELECT * FROM t;")


@pytest.mark.parametrize("text", ["SELECT * FROM s;", "SELECT * FROM t[NOW];", "SELECT x FROM t;", "SELECT a + b FROM t;", "SELECT * FROM t WHERE a = 'x';", "SELECT a FROM t UNION SELECT b FROM t;", "SELECT a, MIN(b) FROM t;", "SELECT b FROM t GROUP BY b;", "SELECT a FROM t, t;", "SELECT SEQUENCE IDENTIFIED BY a [NOW] FROM t;", "SELECT SUM(b) FROM t GROUP BY a;"])
def test_refused(session, text):
    with pytest.raises(LanguageError):
        session.query(text)


def test_environment_and_sink(session, tmp_path):
    (tmp_path / "q.txt").write_text("SELECT a FROM t;")
    (tmp_path / "env").write_text("REGISTER TABLE t (a INTEGER, b STRING) INPUT 't.csv';\nREGISTER QUERY q INPUT 'q.txt' OUTPUT CHANGES 'out';")
    s = Session(session.spark, 3)
    s.load(str(tmp_path / "env"))
    s.run()
    assert session.spark.read.csv(str(tmp_path / "out"), header=True).columns == ["_TS", "_FL", "A"]


def test_deletions_against_a_counter(spark):
    import random

    rnd = random.Random(1)
    for _ in range(3):
        log = [(t, rnd.choice("+-"), rnd.randint(0, 2), i) for i, t in enumerate(sorted(rnd.randint(0, 6) for _ in range(40)))]
        df = spark.createDataFrame(log, "_TS long, _FL string, K long, _ORD long")
        got = Counter(tuple(r) for r in windows.at_instants(windows.changelog(df, ["K"]), 7).select("_TS", "K").collect())
        want, held = Counter(), Counter()
        for t in range(8):
            for ts, flag, k, _ in log:
                if ts == t:
                    held[k] = held[k] + 1 if flag == "+" else max(0, held[k] - 1)
            want.update({(t, k): n for k, n in held.items() if n})
        assert got == want


@pytest.mark.parametrize(
    "text",
    ["SELECT * FROM s[RANGE 3 SECOND, SLIDE 2 SECOND];", "SELECT b, COUNT(*) AS n FROM s[UNBOUNDED] GROUP BY b;", "SELECT * FROM s[RANGE 2 SECOND] PREFERENCES b = 'u' > b = 'v' [a];", "SELECT SUBSEQUENCE CONSECUTIVE TUPLES FROM SEQUENCE IDENTIFIED BY b [RANGE 3 SECOND] FROM s;"],
)
def test_continuous_equals_batch(spark, tmp_path, text):
    data = [(t, (t * 7 + i) % 5, "uv"[(t + i) % 2], t * 10 + i) for t in (0, 1, 2, 4, 5, 8) for i in range(2)]
    df = spark.createDataFrame(data, "_TS long, A long, B string, _ORD long")
    for k, part in enumerate(([0, 1], [2, 4], [5, 8])):
        df.filter(df["_TS"].isin(part)).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        del k
    got = []
    again = lambda: Continuous(spark, text, "s", "STREAM", ["a", "b"], {}, str(tmp_path / "state"), lambda out, first, last: got.extend(map(tuple, out.collect())))
    run = again()
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = run.start(stream, str(tmp_path / "cp"))
    q.processAllAvailable()
    q.stop()
    run = again()  # as after a restart
    assert (run.closed, run.top) == (7, 8)
    run.finish()
    s = Session(spark, 8)
    s.register_stream("s", df, ["A", "B"], order="_ORD")
    assert sorted(got) == rows(s.query(text))


def test_integers_of_any_width_are_longs(spark):
    from keelson.session import Session

    s = Session(spark, 0)
    s.register_relation("a", spark.createDataFrame([(2_000_000_000, 1.5)], "x int, f float"), ["x", "f"])
    s.register_relation("b", spark.createDataFrame([(5, 2.5)], "y long, g double"), ["y", "g"])
    assert [r.X for r in s.query("SELECT x * x * 2 AS x FROM a;").collect()] == [8 * 10**18]
    assert sorted(r.X for r in s.query("SELECT x FROM a UNION SELECT y FROM b;").collect()) == [5, 2_000_000_000]
    assert s.query("SELECT f FROM a UNION SELECT g FROM b;").count() == 2


def test_contradicting_temporal_rules_are_refused_before_any_data(spark):
    import pytest

    from keelson.lang.tokens import LanguageError
    from keelson.session import Session

    s = Session(spark, 5)
    s.register_stream("t", spark.createDataFrame([(0, 1, "long")], "_TS long, id long, size string"), ["id", "size"])
    text = "SELECT SEQUENCE IDENTIFIED BY id [RANGE 3 SECOND] FROM t TEMPORAL PREFERENCES IF {} THEN size = 'long' > size = 'short' AND IF {} THEN size = 'short' > size = 'long';"
    past = "PREVIOUS (size = 'x')"
    for a, b in ((past, past), (past, past + " AND SOME PREVIOUS (size = 'y')")):
        with pytest.raises(LanguageError):
            s.query(text.format(a, b))
    assert s.query(text.format("FIRST", past)).count() == 6 - 3


JOINS = [
    ("p, q", lambda p, q: True),
    ("p, q WHERE p.k = q.k", lambda p, q: p[0] == q[0]),
    ("p, q WHERE p.k = q.k AND p.v + q.v > 3", lambda p, q: p[0] == q[0] and p[1] + q[1] > 3),
    ("p, q WHERE p.v < q.v OR q.k = 0", lambda p, q: p[1] < q[1] or q[0] == 0),
]
SIDES = {"t": "t", "s[RANGE 3 SECOND]": "s3", "s[RANGE 5 SECOND, SLIDE 4 SECOND]": "s54", "s[UNBOUNDED]": "su", "r": "r", "vw": "vw"}


@pytest.fixture(scope="module")
def timeline(spark):
    """A session over 0..150 (more than two blocks) and, by source, the bag of each instant."""
    rnd, last = random.Random(3), 150
    stream = [(rnd.randint(0, last), rnd.randint(0, 2), rnd.randint(0, 4)) for _ in range(25)]
    fixed = [(k, k + 1) for k in range(3)] + [(0, 1)]
    log, alive = [], []
    for ts in sorted(rnd.sample(range(last), 24)):
        if alive and rnd.random() < 0.4:
            log.append((ts, "-", *alive.pop(rnd.randrange(len(alive)))))
        else:
            alive.append((rnd.randint(0, 2), rnd.randint(0, 4)))
            log.append((ts, "+", *alive[-1]))
    held = {name: [[] for _ in range(last + 1)] for name in SIDES.values()}
    for i in range(last + 1):
        held["r"][i] = list(fixed)
        now = Counter(x[2:] for x in log if x[0] <= i and x[1] == "+") - Counter(x[2:] for x in log if x[0] <= i and x[1] == "-")
        held["t"][i] = list(now.elements())
        held["vw"][i] = [x for x in held["t"][i] if x[1] > 1]
        held["s3"][i] = [x[1:] for x in stream if x[0] <= i < x[0] + 3]
        held["s54"][i] = [x[1:] for x in stream if x[0] <= i < x[0] - x[0] % 4 + 5]
        held["su"][i] = [x[1:] for x in stream if x[0] <= i]
    s = Session(spark, last)
    s.register_stream("s", spark.createDataFrame(stream, "ts int, k int, v int"), ["k", "v"], "ts")
    s.register_table("t", spark.createDataFrame([(*x, n) for n, x in enumerate(log)], "ts int, fl string, k int, v int, n int"), ["k", "v"], "ts", "fl", "n")
    s.register_relation("r", spark.createDataFrame(fixed, "k int, v int"), ["k", "v"])
    s.register_query("vw", "SELECT * FROM t WHERE v > 1;")
    return s, held


@pytest.mark.parametrize("left, right", [("t", "s[RANGE 3 SECOND]"), ("s[RANGE 3 SECOND]", "s[RANGE 5 SECOND, SLIDE 4 SECOND]"), ("s[UNBOUNDED]", "r"), ("t", "s[UNBOUNDED]"), ("vw", "s[RANGE 3 SECOND]"), ("vw", "vw"), ("r", "r"), ("t", "t")])
def test_joins_by_instant(timeline, left, right):
    s, held = timeline
    for text, test in JOINS:
        got = Counter(tuple(x) for x in s.query(f"SELECT p.k, p.v, q.k AS qk, q.v AS qv FROM {text.replace('p, q', f'{left} AS p, {right} AS q', 1)};").collect())
        want = Counter((i, *a, *b) for i in range(s.last + 1) for a in held[SIDES[left]][i] for b in held[SIDES[right]][i] if test(a, b))
        assert got == want, text


@pytest.mark.parametrize("source", SIDES)
def test_groups_by_instant(timeline, source):
    s, held = timeline
    for where, test in (("", lambda i, x: True), (" WHERE p.v > 1", lambda i, x: x[1] > 1), (" WHERE p._TS > 40", lambda i, x: i > 40)):
        got = sorted(tuple(x) for x in s.query(f"SELECT p.k, COUNT(*) AS n, SUM(p.v) AS s, MIN(p.v) AS a, MAX(p.v) AS b FROM {source} AS p{where} GROUP BY p.k;").collect())
        want = []
        for i in range(s.last + 1):
            for k in range(3):
                v = [x[1] for x in held[SIDES[source]][i] if x[0] == k and test(i, x)]
                want += [(i, k, len(v), sum(v), min(v), max(v))] if v else []
        assert got == sorted(want), where


def test_nested_groups_of_a_join(timeline):
    s, held = timeline
    got = sorted(tuple(x) for x in s.query("SELECT p.k, COUNT(*) AS n FROM s[UNBOUNDED] AS p, r AS q, t AS u WHERE p.k = q.k AND u.k = q.k GROUP BY p.k;").collect())
    want = Counter((i, a[0]) for i in range(s.last + 1) for a in held["su"][i] for b in held["r"][i] for c in held["t"][i] if a[0] == b[0] == c[0])
    assert got == sorted((*k, n) for k, n in want.items())


AGGREGATES = "COUNT(*) AS n, SUM(p.v) AS s, MIN(q.v * 2 + 1) AS a, MAX(p.v - q.v) AS b, SUM(p.v * q.v) AS c, SUM(q.v - 1) AS d, COUNT(q.k) AS e"


@pytest.mark.parametrize("left, right", [("t", "s[RANGE 3 SECOND]"), ("s[RANGE 3 SECOND]", "s[RANGE 5 SECOND, SLIDE 4 SECOND]"), ("s[UNBOUNDED]", "r"), ("t", "s[UNBOUNDED]"), ("vw", "s[RANGE 3 SECOND]"), ("vw", "vw"), ("r", "r")])
def test_groups_of_joins_by_instant(timeline, left, right):
    s, held = timeline
    cases = [(text, lambda i, p, q, test=test: test(p, q)) for text, test in JOINS]
    cases += [("p, q WHERE p.k = q.k AND q.v > 1 AND p._TS > 40", lambda i, p, q: p[0] == q[0] and q[1] > 1 and i > 40), ("p, q WHERE p.v = 1 OR p.k = 0", lambda i, p, q: p[1] == 1 or p[0] == 0)]
    for text, test in cases:
        got = sorted(tuple(x) for x in s.query(f"SELECT p.k, {AGGREGATES} FROM {text.replace('p, q', f'{left} AS p, {right} AS q', 1)} GROUP BY p.k;").collect())
        met = {}
        for i in range(s.last + 1):
            for p in held[SIDES[left]][i]:
                for q in held[SIDES[right]][i]:
                    if test(i, p, q):
                        met.setdefault((i, p[0]), []).append((p[1], q[1]))
        want = [(*k, len(m), sum(p for p, _ in m), min(q * 2 + 1 for _, q in m), max(p - q for p, q in m), sum(p * q for p, q in m), sum(q - 1 for _, q in m), len(m)) for k, m in met.items()]
        assert got == sorted(want), text


def joined_rows(df):
    """The most rows that a join of the plan that was run put out."""

    def joins(p):
        name = p.nodeName()
        inner = [p.executedPlan()] if name == "AdaptiveSparkPlan" else [p.plan()] if name.endswith("QueryStage") else [p.children().apply(i) for i in range(p.children().size())]
        found = [p.metrics().get("numOutputRows").get().value()] if "Join" in name or name == "CartesianProduct" else []
        return found + [n for i in inner for n in joins(i)]

    return max(joins(df._jdf.queryExecution().executedPlan()))


def test_groups_of_a_join_make_no_pairs(spark):
    s = Session(spark, 0)
    s.register_relation("a", spark.range(1500).selectExpr("id % 2 AS k", "id AS v"), ["k", "v"])
    s.register_relation("b", spark.range(1000).selectExpr("id % 2 AS k", "id AS w"), ["k", "w"])
    s.register_relation("c", spark.createDataFrame([(0, "x"), (1, "y"), (2, "z")], "k int, n string"), ["k", "n"])
    df = s.query("SELECT c.n, MIN(a.v + 1) AS m, SUM(b.w) AS s, COUNT(b.w) AS z FROM a, c, b WHERE a.k = c.k AND b.k = c.k AND a.v > 9 GROUP BY c.n;")
    assert rows(df) == [(0, "x", 11, 745 * 249500, 745 * 500), (0, "y", 12, 745 * 250000, 745 * 500)]
    assert joined_rows(df) <= 4


def test_groups_of_a_join_on_odd_values(spark):
    s, big = Session(spark, 0), 2**63 - 1
    s.register_relation("a", spark.createDataFrame([(1, 5, 2, 0.5), (1, None, 0, None), (2, big, 1, 1.5), (2, big, 2, 2.5), (3, 7, 0, 3.5), (None, 1, 1, 1.0)], "k int, v long, d long, f double"), ["k", "v", "d", "f"])
    s.register_relation("b", spark.createDataFrame([(1, "u"), (1, "u"), (1, None), (4, "w")], "k int, n string"), ["k", "n"])
    s.register_relation("none", spark.createDataFrame([], "x int"), ["x"])
    # of a only k = 1 meets anything: too large values and divisions by zero of the rest are not worked out
    text = "SELECT b.n, MIN(a.v + 1) AS a, SUM(a.v) AS b, MAX(a.v / a.d) AS c, SUM(a.f / a.f) AS d, SUM(a.v * 3) AS e, COUNT(a.v) AS f, MIN(b.n + '!') AS g FROM a, b WHERE a.k = b.k{} GROUP BY b.n;"
    got = {r[1]: tuple(r[2:]) for r in s.query(text.format(" AND a.d > 0")).collect()}
    assert got == {"u": (6, 10, 2, 2.0, 30, 2, "u!"), None: (6, 5, 2, 1.0, 15, 1, None)}
    with pytest.raises(Exception, match="BY_ZERO"):  # here 1 / 0 meets a tuple
        s.query("SELECT b.n, MAX(1 / a.d) AS c FROM a, b WHERE a.k = b.k GROUP BY b.n;").collect()
    with pytest.raises(Exception, match="OVERFLOW"):
        s.query("SELECT a.k, MAX(a.v + 1) AS c FROM a, b WHERE a.k = 2 GROUP BY a.k;").collect()
    assert rows(s.query("SELECT a.k, COUNT(*) AS n FROM a, none AS o WHERE a.k > 0 GROUP BY a.k;")) == []
    assert rows(s.query("SELECT a.k, COUNT(*) AS n, SUM(3) AS t FROM a, b WHERE a.k > 0 GROUP BY a.k;")) == [(0, 1, 8, 24), (0, 2, 8, 24), (0, 3, 4, 12)]
    for bad in ("SELECT a.k, SUM(b.n) AS x", "SELECT a.k, COUNT(b.n - b.n) AS x", "SELECT b.n, MIN(a.k) AS x", "SELECT a.k, MIN(k) AS x", "SELECT a.k, MIN(a.v + 1) AS x, MIN(a.v + 1.0) AS y"):
        with pytest.raises(LanguageError):
            s.query(f"{bad} FROM a, b WHERE a.k = b.k GROUP BY a.k;")
