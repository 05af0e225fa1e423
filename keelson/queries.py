"""Registered queries of the relational, preference and sequence operators, with oracle SQL.

Instants are hours (0 to 719) or days (0 to 29) since 2024-01-01 for `events`, turns for
`conversations`; plain tables are relations that hold at instant 0."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import windows
from .session import Session

HOURS, DAYS, TURNS = 719, 29, 63
_BASE = 1704067200  # 2024-01-01 UTC

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def _events(spark: SparkSession, sf_dir: str, seconds: int) -> DataFrame:
    at = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1_000_000)
    return _read(spark, sf_dir, "events").select(F.floor((at - _BASE) / seconds).cast("long").alias("_TS"), "user_id", "event_type", F.round(F.col("value") * 100).cast("long").alias("cents"), "event_id")


def _relations(spark: SparkSession, sf_dir: str) -> Session:
    s = Session(spark, 0)
    for name in ("region", "nation", "customer", "supplier", "part", "orders"):
        df = _read(spark, sf_dir, name)
        s.register_relation(name, df, [c for c, t in df.dtypes if t in ("int", "bigint", "double", "string")])
    return s


def _stream(spark: SparkSession, sf_dir: str, seconds: int = 3600, last: int = HOURS) -> Session:
    s = Session(spark, last)
    s.register_stream("ev", _events(spark, sf_dir, seconds), ["user_id", "event_type", "cents"], order="event_id")
    errors = _events(spark, sf_dir, seconds).filter("event_type = 'error'")
    s.register_stream("err", errors, ["user_id", "cents"], order="event_id")
    return s


def _talks(spark: SparkSession, sf_dir: str) -> Session:
    s = Session(spark, TURNS)
    # every third turn waits for an instant, so that runs of turns end
    rows = _read(spark, sf_dir, "conversations").select((F.col("turn") + F.floor(F.col("turn") / 3)).alias("_TS"), "conv_id", "role", F.when(F.length("text") > 400, "long").when(F.length("text") > 150, "middle").otherwise("short").alias("size"))
    s.register_stream("talk", rows, ["conv_id", "role", "size"], order="_TS")
    return s


def _log(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = _events(spark, sf_dir, 86400)
    return day.select("_TS", F.when(F.col("event_type").isin("error", "view"), "-").otherwise("+").alias("_FL"), (F.col("user_id") % 40).alias("k"), "event_id")


def _tables(spark: SparkSession, sf_dir: str) -> Session:
    s = Session(spark, DAYS)
    s.register_table("stock", _log(spark, sf_dir), ["k"], order="event_id")
    return s


def _add(name: str, session: Callable[[SparkSession, str], Session], text: str, sql: str) -> None:
    QUERIES[name] = lambda spark, sf_dir: session(spark, sf_dir).query(text)
    ORACLE_SQL[name] = sql


_EV = "ev AS (SELECT CAST(floor((epoch_us(ts) // 1000000 - 1704067200) / 3600) AS BIGINT) AS t, user_id, event_type, CAST(round(value * 100) AS BIGINT) AS cents, event_id FROM events)"
_EVD = _EV.replace("/ 3600", "/ 86400")
_TL = "tl AS (SELECT unnest(range(0, 720)) AS t)"
_TLD = "tl AS (SELECT unnest(range(0, 30)) AS t)"
_OUT = 'tl.t AS "_TS", user_id AS "USER_ID", event_type AS "EVENT_TYPE", cents AS "CENTS"'
_ZERO = 'CAST(0 AS BIGINT) AS "_TS"'


def _win(n: int, k: int = 1) -> str:
    return f"WITH {_EV}, {_TL} SELECT {_OUT} FROM tl JOIN ev ON tl.t BETWEEN ev.t AND (ev.t // {k}) * {k} + {n} - 1"


# -- projection, selection, joins ------------------------------------------------------------
_add("select_star", _relations, "SELECT * FROM nation;", f'SELECT {_ZERO}, CAST(n_nationkey AS BIGINT) AS "N_NATIONKEY", n_name AS "N_NAME", CAST(n_regionkey AS BIGINT) AS "N_REGIONKEY" FROM nation')
_add(
    *("select_rename_dedup", _relations, "SELECT r.r_regionkey AS aa, r.r_name, r.*, * FROM region AS r;"),
    f'SELECT {_ZERO}, CAST(r_regionkey AS BIGINT) AS "AA", r_name AS "R_NAME", CAST(r_regionkey AS BIGINT) AS "R_REGIONKEY", r_name AS "R_NAME_2", CAST(r_regionkey AS BIGINT) AS "R_REGIONKEY_2", r_name AS "R_NAME_2_3" FROM region',
)
_add(
    *("arith_floor_div", _relations, "SELECT p_partkey, (p_size - 25) / 7 AS q, (p_size - 25) / (0 - 7) AS r, p_size * 2 + 1 - p_size / 3 AS s, p_name + '/' + p_brand AS n FROM part;"),
    f"""SELECT {_ZERO}, p_partkey AS "P_PARTKEY", CAST(floor((p_size - 25) / 7.0) AS BIGINT) AS "Q", CAST(floor((p_size - 25) / -7.0) AS BIGINT) AS "R",
    CAST(p_size * 2 + 1 - p_size // 3 AS BIGINT) AS "S", p_name || '/' || p_brand AS "N" FROM part""",
)
_add(
    *("literal_current", lambda a, b: _stream(a, b), "SELECT 7 AS seven, 'x' AS x, CURRENT() AS now, _TS, user_id FROM err[NOW];"),
    f"""WITH {_EV} SELECT t AS "_TS", CAST(7 AS BIGINT) AS "SEVEN", 'x' AS "X", t AS "NOW", t AS "ATT", user_id AS "USER_ID" FROM ev WHERE event_type = 'error'""",
)
_add(
    *("filter_and", _relations, "SELECT p_partkey, p_size FROM part WHERE p_size >= 10 AND p_size < 20 AND NOT p_brand = 'Brand#1' AND p_type <> 'PROMO';"),
    f"""SELECT {_ZERO}, p_partkey AS "P_PARTKEY", CAST(p_size AS BIGINT) AS "P_SIZE" FROM part WHERE p_size >= 10 AND p_size < 20 AND p_brand <> 'Brand#1' AND p_type <> 'PROMO'""",
)
_add(
    *("filter_or_not", _relations, "SELECT p_partkey, p_size FROM part WHERE p_size = 1 OR NOT p_size < 45 OR p_size * 2 = p_size + 7;"),
    f"""SELECT {_ZERO}, p_partkey AS "P_PARTKEY", CAST(p_size AS BIGINT) AS "P_SIZE" FROM part WHERE p_size = 1 OR p_size >= 45 OR p_size = 7""",
)
_add(
    *("join_equi_3way", _relations, "SELECT c.c_custkey, n.n_name, r.r_name FROM customer AS c, nation AS n, region AS r WHERE c.c_nationkey = n.n_nationkey AND n.n_regionkey = r.r_regionkey;"),
    f'SELECT {_ZERO}, c_custkey AS "C_CUSTKEY", n_name AS "N_NAME", r_name AS "R_NAME" FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey',
)
_add("join_cross", _relations, "SELECT n_name, r_name FROM nation, region;", f'SELECT {_ZERO}, n_name AS "N_NAME", r_name AS "R_NAME" FROM nation, region')
_add(
    *("join_theta", _relations, "SELECT a.n_nationkey AS x, r.r_regionkey AS y FROM nation AS a, region AS r WHERE a.n_regionkey < r.r_regionkey AND a.n_name > r.r_name;"),
    f'SELECT {_ZERO}, CAST(n_nationkey AS BIGINT) AS "X", CAST(r_regionkey AS BIGINT) AS "Y" FROM nation, region WHERE n_regionkey < r_regionkey AND n_name > r_name',
)
_add(
    *("self_join", _relations, "SELECT a.n_name, b.n_name AS other FROM nation AS a, nation AS b WHERE a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey;"),
    f'SELECT {_ZERO}, a.n_name AS "N_NAME", b.n_name AS "OTHER" FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey',
)
_add(
    *("window_join", lambda a, b: _stream(a, b), "SELECT e.user_id, e.cents, f.cents AS failed FROM ev[NOW] AS e, err[RANGE 3 HOUR] AS f WHERE e.user_id = f.user_id;".replace("3 HOUR", "3 SECOND")),
    f"""WITH {_EV} SELECT e.t AS "_TS", e.user_id AS "USER_ID", e.cents AS "CENTS", f.cents AS "FAILED" FROM ev e JOIN ev f ON e.user_id = f.user_id AND e.t BETWEEN f.t AND f.t + 2 WHERE f.event_type = 'error'""",
)

# -- windows, streams, changes ---------------------------------------------------------------
_hour = lambda a, b: _stream(a, b)
_day = lambda a, b: _stream(a, b, 86400, DAYS)
_add("window_now", _hour, "SELECT * FROM ev[NOW];", _win(1))
_add("window_range", _hour, "SELECT * FROM ev[RANGE 4 SECOND];", _win(4))
_add("window_minutes", _hour, "SELECT * FROM err[RANGE 1 MINUTE];", f"""WITH {_EV}, {_TL} SELECT tl.t AS "_TS", user_id AS "USER_ID", cents AS "CENTS" FROM tl JOIN ev ON tl.t BETWEEN ev.t AND ev.t + 59 WHERE event_type = 'error'""")
_add("window_slide_tumbling", _hour, "SELECT * FROM ev[RANGE 3 SECOND, SLIDE 3 SECOND];", _win(3, 3))
_add("window_slide_gap", _hour, "SELECT * FROM ev[RANGE 2 SECOND, SLIDE 5 SECOND];", _win(2, 5))
_add("window_slide_overlap", _hour, "SELECT * FROM ev[RANGE 6 SECOND, SLIDE 2 SECOND];", _win(6, 2))
_add("window_unbounded", _day, "SELECT event_type, COUNT(*) AS n FROM ev[UNBOUNDED] GROUP BY event_type;", f'WITH {_EVD}, {_TLD} SELECT tl.t AS "_TS", event_type AS "EVENT_TYPE", count(*) AS "N" FROM tl JOIN ev ON tl.t >= ev.t GROUP BY ALL')
_add("istream", _hour, "SELECT ISTREAM FROM ev[RANGE 3 SECOND];", f'WITH {_EV} SELECT t AS "_TS", user_id AS "USER_ID", event_type AS "EVENT_TYPE", cents AS "CENTS" FROM ev')
_add("dstream", _hour, "SELECT DSTREAM FROM ev[RANGE 6 SECOND, SLIDE 2 SECOND];", f'WITH {_EV} SELECT (t // 2) * 2 + 6 AS "_TS", user_id AS "USER_ID", event_type AS "EVENT_TYPE", cents AS "CENTS" FROM ev WHERE (t // 2) * 2 + 6 <= 719')
_add("rstream", _hour, "SELECT RSTREAM FROM ev[RANGE 2 SECOND];", _win(2))

_STOCK = f"""WITH {_EVD}, log AS (SELECT t, user_id % 40 AS k, event_id, CASE WHEN event_type IN ('error', 'view') THEN -1 ELSE 1 END AS d FROM ev),
s AS (SELECT *, sum(d) OVER (PARTITION BY k ORDER BY t, event_id) AS s FROM log),
m AS (SELECT *, least(0, min(s) OVER (PARTITION BY k ORDER BY t, event_id)) AS m FROM s),
ends AS (SELECT k, t, max_by(s - m, event_id) AS n FROM m GROUP BY k, t), {_TLD},
held AS (SELECT tl.t, k, max_by(n, ends.t) AS n FROM tl JOIN ends ON ends.t <= tl.t GROUP BY tl.t, k)"""
_add("table_changelog", _tables, "SELECT k, COUNT(*) AS n FROM stock GROUP BY k;", f'{_STOCK} SELECT t AS "_TS", k AS "K", CAST(n AS BIGINT) AS "N" FROM held WHERE n > 0')


def _changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _tables(spark, sf_dir)
    s.register_query("q", "SELECT * FROM stock;")
    return s.changes("q").groupBy("_TS", "_FL", "K").agg(F.count(F.lit(1)).alias("N"))


QUERIES["changes"] = _changes
ORACLE_SQL["changes"] = f"""{_STOCK}, steps AS (SELECT t, k, n - coalesce(lag(n) OVER (PARTITION BY k ORDER BY t), 0) AS d FROM held)
SELECT t AS "_TS", CASE WHEN d > 0 THEN '+' ELSE '-' END AS "_FL", k AS "K", CAST(abs(d) AS BIGINT) AS "N" FROM steps WHERE d <> 0"""


def _late(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _events(spark, sf_dir, 3600).withColumn("_TS", F.col("_TS") - F.when(F.col("event_id") % 5 == 0, F.col("event_id") % 4).otherwise(0)).withColumn("_ORD", F.col("event_id"))
    return windows.in_order(rows).select("_TS", F.col("event_id").alias("EVENT_ID"))


QUERIES["late_rows"] = _late
ORACLE_SQL["late_rows"] = f"""WITH {_EV}, r AS (SELECT t - CASE WHEN event_id % 5 = 0 THEN event_id % 4 ELSE 0 END AS t, event_id FROM ev),
m AS (SELECT *, max(t) OVER (ORDER BY event_id) AS top FROM r) SELECT t AS "_TS", event_id AS "EVENT_ID" FROM m WHERE t >= top"""


def _chained(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _stream(spark, sf_dir)
    s.register_query("fails", "SELECT ISTREAM FROM err[RANGE 2 SECOND];")
    s.register_query("recent", "SELECT user_id, cents FROM fails[RANGE 2 SECOND] WHERE cents > 1000;")
    return s.query("SELECT r.user_id, COUNT(*) AS n FROM recent AS r GROUP BY user_id;")


QUERIES["query_as_view"] = _chained
ORACLE_SQL["query_as_view"] = f"""WITH {_EV}, {_TL} SELECT tl.t AS "_TS", user_id AS "USER_ID", count(*) AS "N" FROM tl JOIN ev ON tl.t BETWEEN ev.t AND ev.t + 1 WHERE event_type = 'error' AND cents > 1000 GROUP BY ALL"""

# -- bags, groups, distinct -------------------------------------------------------------------
_A, _B = "SELECT user_id FROM ev[RANGE 2 SECOND]", "SELECT user_id FROM err[RANGE 5 SECOND]"
_SA = "(SELECT tl.t, user_id FROM tl JOIN ev ON tl.t BETWEEN ev.t AND ev.t + 1)"
_SB = "(SELECT tl.t, user_id FROM tl JOIN ev ON tl.t BETWEEN ev.t AND ev.t + 4 WHERE event_type = 'error')"
for _n, _op in (("union_all", "UNION"), ("intersect_all", "INTERSECT"), ("except_all", "EXCEPT")):
    _add(_n, _hour, f"{_A} {_op} {_B};", f'WITH {_EV}, {_TL} SELECT t AS "_TS", user_id AS "USER_ID" FROM ({_SA} {_op} ALL {_SB})')
_add("bag_chain", _hour, f"{_A} UNION {_B} EXCEPT {_A} INTERSECT {_B};", f'WITH {_EV}, {_TL} SELECT t AS "_TS", user_id AS "USER_ID" FROM ((({_SA} UNION ALL {_SB}) EXCEPT ALL {_SA}) INTERSECT ALL {_SB})')
for _n, _f in (("group_min", "MIN"), ("group_max", "MAX"), ("group_sum", "SUM"), ("group_count", "COUNT")):
    _sum = f"CAST({_f}(cents) AS BIGINT)"
    _add(_n, _hour, f"SELECT event_type, {_f}(cents) FROM ev[RANGE 4 SECOND] GROUP BY event_type;", f'WITH {_EV}, {_TL} SELECT tl.t AS "_TS", event_type AS "EVENT_TYPE", {_sum} AS "CENTS" FROM tl JOIN ev ON tl.t BETWEEN ev.t AND ev.t + 3 GROUP BY tl.t, event_type')
_add(
    *("group_expr", _relations, "SELECT n.n_name, MIN(c.c_custkey + 1), MAX(s.s_suppkey * 2) AS m, COUNT(s.s_name) AS k FROM customer AS c, nation AS n, supplier AS s WHERE c.c_nationkey = n.n_nationkey AND s.s_nationkey = n.n_nationkey GROUP BY n.n_name;"),
    f'SELECT {_ZERO}, n_name AS "N_NAME", min(c_custkey + 1) AS "ATT", max(s_suppkey * 2) AS "M", count(*) AS "K" FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN supplier ON s_nationkey = n_nationkey GROUP BY n_name',
)
_add("distinct", _hour, "SELECT DISTINCT user_id, event_type FROM ev[RANGE 3 SECOND];", f'WITH {_EV}, {_TL} SELECT DISTINCT tl.t AS "_TS", user_id AS "USER_ID", event_type AS "EVENT_TYPE" FROM tl JOIN ev ON tl.t BETWEEN ev.t AND ev.t + 2')

_add("union_int_widths", _relations, "SELECT p_size AS n FROM part UNION SELECT p_partkey AS n FROM part;", f'SELECT {_ZERO}, CAST(p_size AS BIGINT) AS "N" FROM part UNION ALL SELECT {_ZERO}, CAST(p_partkey AS BIGINT) FROM part')
_add(
    *("arith_large", _relations, "SELECT p_partkey, p_size * p_size * p_size * p_size * p_size * p_size AS n FROM part;"),
    f'SELECT {_ZERO}, p_partkey AS "P_PARTKEY", CAST(p_size AS BIGINT) * p_size * p_size * p_size * p_size * p_size AS "N" FROM part',
)

# -- tuple preferences -----------------------------------------------------------------------
_PART = "SELECT p_partkey, p_brand, p_type, p_size FROM part"
_PSQL = f'SELECT {_ZERO}, p_partkey AS "P_PARTKEY", p_brand AS "P_BRAND", p_type AS "P_TYPE", CAST(p_size AS BIGINT) AS "P_SIZE" FROM part r'


def _beats(*pairs: tuple[str, str, str]) -> str:
    """NOT EXISTS for comparisons written out: (the better one x, the worse one r, equalities)."""
    return " AND ".join(f"NOT ({w} AND EXISTS (SELECT 1 FROM part x WHERE {b}{' AND ' + e if e else ''}))" for b, w, e in pairs)


_SAME = lambda *names: " AND ".join(f"x.{n} = r.{n}" for n in names)
_ANY = "p_partkey, p_name, p_retailprice"
_add(
    *("best_unconditional", _relations, f"SELECT p_partkey, p_brand, p_type, p_size FROM part ACCORDING TO PREFERENCES p_type = 'PROMO' BETTER p_type = 'SMALL' [{_ANY}];"),
    f"{_PSQL} WHERE {_beats(("x.p_type = 'PROMO'", "r.p_type = 'SMALL'", _SAME('p_brand', 'p_size')))}",
)
_add(
    *("best_conditional", _relations, f"{_PART} PREFERENCES p_type = 'PROMO' > p_type = 'LARGE' [{_ANY}, p_size] AND IF p_type = 'PROMO' THEN p_size < 10 > p_size >= 10 [{_ANY}];"),
    f"""{_PSQL} WHERE {_beats(
        ("x.p_type = 'PROMO'", "r.p_type = 'LARGE'", _SAME('p_brand')),
        ("x.p_type = 'PROMO' AND x.p_size < 10", "r.p_type = 'PROMO' AND r.p_size >= 10", _SAME('p_brand')),
    )}""",
)
_add(
    *("best_interval", _relations, f"{_PART} PREFERENCES 10 <= p_size < 20 BETTER p_size >= 30 [{_ANY}, p_brand] AND IF p_type = 'SMALL' THEN p_size < 5 BETTER 5 <= p_size < 10 [{_ANY}, p_brand];"),
    f"""{_PSQL} WHERE {_beats(
        ("x.p_size >= 10 AND x.p_size < 20", "r.p_size >= 30", _SAME('p_type')),
        ("x.p_type = 'SMALL' AND x.p_size < 5", "r.p_type = 'SMALL' AND r.p_size BETWEEN 5 AND 9", _SAME('p_type')),
    )}""",
)
_add(
    *("best_transitive", _relations, f"{_PART} PREFERENCES p_type = 'PROMO' BETTER p_type = 'LARGE' [{_ANY}] AND p_type = 'LARGE' BETTER p_type = 'SMALL' [{_ANY}, p_size];"),
    f"""{_PSQL} WHERE {_beats(
        ("x.p_type = 'PROMO'", "r.p_type = 'LARGE'", _SAME('p_brand', 'p_size')),
        ("x.p_type = 'LARGE'", "r.p_type = 'SMALL'", _SAME('p_brand')),
        ("x.p_type = 'PROMO'", "r.p_type = 'SMALL'", _SAME('p_brand')),
    )}""",
)
_add(
    *("best_stream", _hour, "SELECT * FROM ev[RANGE 2 SECOND] PREFERENCES event_type = 'purchase' BETTER event_type = 'view' [cents] AND event_type = 'view' BETTER event_type = 'error' [cents];"),
    f"""WITH {_EV}, {_TL}, r AS (SELECT tl.t, user_id, event_type, cents FROM tl JOIN ev ON tl.t BETWEEN ev.t AND ev.t + 1)
SELECT t AS "_TS", user_id AS "USER_ID", event_type AS "EVENT_TYPE", cents AS "CENTS" FROM r WHERE NOT EXISTS (SELECT 1 FROM r x WHERE x.t = r.t AND x.user_id = r.user_id
AND (x.event_type = 'purchase' AND r.event_type IN ('view', 'error') OR x.event_type = 'view' AND r.event_type = 'error'))""",
)
_add(
    *("topk_pref", _relations, f"SELECT TOP(900) p_partkey, p_brand, p_type, p_size FROM part PREFERENCES p_type = 'PROMO' BETTER p_type = 'LARGE' [{_ANY}, p_size, p_brand] AND p_type = 'LARGE' BETTER p_type = 'SMALL' [{_ANY}, p_size, p_brand];"),
    f"""WITH r AS (SELECT *, CASE p_type WHEN 'LARGE' THEN 1 WHEN 'SMALL' THEN 2 ELSE 0 END AS level FROM part),
k AS (SELECT *, row_number() OVER (ORDER BY level, p_partkey) AS place FROM r) SELECT {_ZERO}, p_partkey AS "P_PARTKEY", p_brand AS "P_BRAND", p_type AS "P_TYPE", CAST(p_size AS BIGINT) AS "P_SIZE" FROM k WHERE place <= 900""",
)

# -- sequences ---------------------------------------------------------------------------------
_SEQ = f"""WITH {_EV}, one AS (SELECT * FROM ev QUALIFY row_number() OVER (PARTITION BY user_id, t ORDER BY event_id DESC) = 1), {_TL},
s AS (SELECT tl.t AS inst, one.t, user_id, event_type, cents, row_number() OVER (PARTITION BY tl.t, user_id ORDER BY one.t) AS pos FROM tl JOIN one ON tl.t BETWEEN one.t AND {{}})"""
_POS = 'inst AS "_TS", CAST(pos AS INTEGER) AS "_POS"'
_add("seq", _hour, "SELECT SEQUENCE IDENTIFIED BY user_id [RANGE 6 SECOND] FROM ev;", f'{_SEQ.format("one.t + 5")} SELECT {_POS}, user_id AS "USER_ID", event_type AS "EVENT_TYPE", cents AS "CENTS" FROM s')
_add("seq_slide", _hour, "SELECT SEQUENCE IDENTIFIED BY user_id [RANGE 6 SECOND, SLIDE 4 SECOND] FROM ev;", f'{_SEQ.format("(one.t // 4) * 4 + 5")} SELECT {_POS}, user_id AS "USER_ID", event_type AS "EVENT_TYPE", cents AS "CENTS" FROM s')
_TALK = """WITH talk AS (SELECT conv_id, turn + turn // 3 AS t, role, CASE WHEN length(text) > 400 THEN 'long' WHEN length(text) > 150 THEN 'middle' ELSE 'short' END AS size FROM conversations),
tl AS (SELECT unnest(range(0, 64)) AS t), w AS (SELECT tl.t AS inst, talk.* FROM tl JOIN talk ON tl.t BETWEEN talk.t AND talk.t + 4)"""
_RUNS = f"{_TALK}, c AS (SELECT *, t - row_number() OVER (PARTITION BY inst, conv_id ORDER BY t) AS run FROM w), s AS (SELECT *, row_number() OVER (PARTITION BY inst, conv_id, run ORDER BY t) AS pos FROM c)"
_WHOLE = f"{_TALK}, s AS (SELECT *, 0 AS run, row_number() OVER (PARTITION BY inst, conv_id ORDER BY t) AS pos FROM w)"
_TAIL = 'conv_id AS "CONV_ID", role AS "ROLE", size AS "SIZE"'
_WIN5 = "SEQUENCE IDENTIFIED BY conv_id [RANGE 5 SECOND] FROM talk"
_add("conseq", _talks, f"SELECT SUBSEQUENCE CONSECUTIVE TUPLES FROM {_WIN5};", f"{_RUNS} SELECT {_POS}, {_TAIL} FROM s")
_ENDS = ", e AS (SELECT a.inst, a.conv_id, a.run, a.pos AS start, b.pos - a.pos + 1 AS pos, b.role, b.size FROM s a JOIN s b ON a.inst = b.inst AND a.conv_id = b.conv_id AND a.run = b.run AND b.pos >= a.pos)"
_add("endseq", _talks, f"SELECT SUBSEQUENCE END POSITION FROM SUBSEQUENCE CONSECUTIVE TIMESTAMP FROM {_WIN5};", f"{_RUNS}{_ENDS} SELECT {_POS}, {_TAIL} FROM e")
_LONG = ", n AS (SELECT *, count(*) OVER (PARTITION BY inst, conv_id, run) AS n FROM s)"
_add("minseq", _talks, f"SELECT SUBSEQUENCE CONSECUTIVE TUPLES FROM {_WIN5} WHERE MINIMUM LENGTH IS 3;", f"{_RUNS}{_LONG} SELECT {_POS}, {_TAIL} FROM n WHERE n >= 3")
_add("maxseq", _talks, f"SELECT SUBSEQUENCE CONSECUTIVE TUPLES FROM {_WIN5} WHERE MAXIMUM LENGTH IS 3 AND MINIMUM LENGTH IS 2;", f"{_RUNS}{_LONG} SELECT {_POS}, {_TAIL} FROM n WHERE n BETWEEN 2 AND 3")


def _best_seq(test: str, better: str) -> str:
    """Sequences that no other beats at the first position where they differ: `test` on the items
    before (p), `better` between two items (x beats y)."""
    return f"""{_WHOLE}, q AS (SELECT inst, conv_id, list({{'role': role, 'size': size}} ORDER BY pos) AS l FROM s GROUP BY inst, conv_id),
p AS (SELECT inst, conv_id, i, l[1:i - 1] AS p, l[i] AS y FROM q, unnest(range(1, len(l) + 1)) AS u(i)),
k AS (SELECT DISTINCT inst, p, y AS x FROM p),
lost AS (SELECT DISTINCT p.inst, conv_id FROM p JOIN k ON p.inst = k.inst AND p.p = k.p WHERE {test} AND {better})
SELECT inst AS "_TS", CAST(pos AS INTEGER) AS "_POS", conv_id AS "CONV_ID", role AS "ROLE", size AS "SIZE" FROM s WHERE NOT EXISTS (SELECT 1 FROM lost WHERE lost.inst = s.inst AND lost.conv_id = s.conv_id)"""


_XY = "x.size = '{}' AND y.size = '{}' AND x.role = y.role"
for _n, _if, _test in (
    ("first", "FIRST", "len(p.p) = 0"),
    ("previous", "PREVIOUS (size = 'long')", "len(p.p) > 0 AND p.p[-1].size = 'long'"),
    ("some", "SOME PREVIOUS (size = 'short') AND SOME PREVIOUS (role = 'user')", "len(list_filter(p.p, lambda z: z.size = 'short' AND z.role = 'user')) > 0"),
    ("all", "ALL PREVIOUS (role = 'user')", "len(p.p) > 0 AND len(list_filter(p.p, lambda z: z.role <> 'user')) = 0"),
):
    _add(f"bestseq_{_n}", _talks, f"SELECT {_WIN5} TEMPORAL PREFERENCES IF {_if} THEN size = 'middle' BETTER size = 'short';", _best_seq(_test, _XY.format("middle", "short")))
_add(
    *("bestseq_chain", _talks, f"SELECT {_WIN5} ACCORDING TO TEMPORAL PREFERENCES size = 'long' BETTER size = 'middle' AND size = 'middle' BETTER size = 'short' [role];"),
    _best_seq("true", "(x.size = 'long' AND y.size = 'middle' AND x.role = y.role OR x.size IN ('long', 'middle') AND y.size = 'short')"),
)
_add(
    *("topkseq", _talks, f"SELECT TOP(20) {_WIN5} TEMPORAL PREFERENCES IF FIRST THEN role = 'system' BETTER role = 'user' [size];"),
    f"""{_WHOLE}, q AS (SELECT inst, conv_id, min_by(role, pos) AS head FROM s GROUP BY inst, conv_id),
b AS (SELECT *, CASE WHEN head = 'user' AND max((head = 'system')::INT) OVER (PARTITION BY inst) = 1 THEN 1 ELSE 0 END AS level FROM q),
k AS (SELECT inst, conv_id FROM b QUALIFY row_number() OVER (PARTITION BY inst ORDER BY level, conv_id) <= 20)
SELECT {_POS}, {_TAIL} FROM s SEMI JOIN k USING (inst, conv_id)""",
)


def _stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _talks(spark, sf_dir).statistics(f"SELECT {_WIN5} TEMPORAL PREFERENCES IF FIRST THEN size = 'middle' BETTER size = 'short';")


QUERIES["seq_stats"] = _stats
_inner = _best_seq("len(p.p) = 0", _XY.format("middle", "short"))
_head, _, _rest = _inner.partition("SELECT inst AS")
ORACLE_SQL["seq_stats"] = f"""{_head.rstrip()}, f AS (SELECT inst AS {_rest}),
i AS (SELECT inst, conv_id, count(*) AS n FROM s GROUP BY ALL), o AS (SELECT "_TS" AS inst, "CONV_ID" AS conv_id, count(*) AS n FROM f GROUP BY ALL),
ia AS (SELECT inst, count(*) AS c, min(n) AS a, max(n) AS b, sum(n) // count(*) AS m FROM i GROUP BY inst), oa AS (SELECT inst, count(*) AS c, min(n) AS a, max(n) AS b, sum(n) // count(*) AS m FROM o GROUP BY inst)
SELECT tl.t AS "_TS", coalesce(ia.c, 0) AS "in", coalesce(ia.a, -1) AS in_min, coalesce(ia.b, -1) AS in_max, CAST(coalesce(ia.m, -1) AS BIGINT) AS in_avg,
coalesce(oa.c, 0) AS "out", coalesce(oa.a, -1) AS out_min, coalesce(oa.b, -1) AS out_max, CAST(coalesce(oa.m, -1) AS BIGINT) AS out_avg FROM tl LEFT JOIN ia ON tl.t = ia.inst LEFT JOIN oa ON tl.t = oa.inst"""
