"""The queries on the smallest tables, and the stages one by one."""

import collections

import pytest
from pyspark.sql import functions as F

from conftest import SF
from keelson.llm.oracle import ORACLE_SQL
from keelson.llm.queries import QUERIES
from oracle import differs


@pytest.mark.parametrize("name", ORACLE_SQL)
def test_query_equals_oracle(spark, name):
    assert differs(QUERIES[name](spark, SF), ORACLE_SQL[name], SF) == ([], [])


def test_stages(spark, tmp_path):
    import corpus_pipeline as p

    docs = first = spark.read.parquet(f"{SF}/documents.parquet")
    seen = {}
    for k, (name, stage) in enumerate(p.STAGES):
        stage(spark, docs, SF).write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        seen[name] = docs
        if k < len(p.STAGES) - 1:
            assert docs.columns == first.columns
    quality, lined, near, mixed, encoded = seen.values()
    good = spark.read.parquet(f"{SF}/labels.parquet")
    kept = good.filter("quality = 1").join(quality, "doc_id", "left_anti").count()
    assert kept <= 0.05 * good.filter("quality = 1").count()
    assert good.filter("quality = 0").join(quality, "doc_id").count() <= 0.2 * good.filter("quality = 0").count()
    assert lined.count() == quality.count()
    assert near.count() == near.select("text").distinct().count() <= lined.count()
    times = mixed.groupBy("doc_id").count()
    assert times.agg(F.max("count")).first()[0] == 2 and mixed.join(near, "doc_id", "left_anti").count() == 0
    assert encoded.count() == mixed.count() and encoded.filter("n_tokens < 1").count() == 0
    decoded = encoded.select("doc_id", "decoded_sha256").distinct().join(near.select("doc_id", F.sha2("text", 256).alias("own")), "doc_id")
    assert decoded.filter("decoded_sha256 <> own").count() == 0


def test_stages_with_null_and_repeated_ids(spark):
    import corpus_pipeline as p

    text = lambda k: " ".join(f"w{k}x{i}" for i in range(40))
    near = text(2).rsplit(" ", 1)[0]
    rows = [(1, text(1), "a"), (1, text(1), "a"), (None, text(2), "a"), (None, near, "b"), (None, text(3), "b"), (5, text(4), "b"), (7, text(5), "b"), (7, text(4), "b"), (None, text(6), None), (None, text(6), None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    kept = sorted(map(str, p.near_dedup(spark, docs, SF).collect()))
    assert len(kept) == 6 and sum(text(2)[:200] in r for r in kept) == 1
    for want in ((1, text(1), "a"), (None, text(3), "b"), (5, text(4), "b"), (7, text(5), "b"), (None, text(6), None)):
        assert kept.count(f"Row(doc_id={want[0]}, text='{want[1]}', source={want[2]!r})") == 1
    same = spark.createDataFrame([(None, text(k), "a") for k in range(8)] + [(3, text(9), "b")] * 4, "doc_id long, text string, source string")
    mixed = p.mix_sources(spark, same, SF).collect()
    assert len(mixed) == 18 and sum(r.doc_id is None for r in mixed) in range(11, 14)
    assert all(n <= 2 for n in collections.Counter(r.text for r in mixed if r.doc_id is None).values())


NAMES = ("drop", "of", "row", "hash", "key", "times", "copy", "id", "class", "class_id", "size", "__row", "__hash", "__key", "__drop")


def test_each_stage_on_odd_rows(spark):
    """Null and repeated ids, repeated rows, null and empty texts, clashing names; and no rows."""
    import corpus_pipeline as p

    text = lambda k: " ".join(f"w{k}x{i}" for i in range(40))
    rows = [(k, text(k), "ab"[k % 2], 7) for k in range(12)]
    rows += [(None, text(20 + k), None, 7) for k in range(6)]
    rows += [(3, text(3), "b", 7), (3, text(40), "a", 7), (None, None, "a", 7), (50, "", "b", 7), (51, None, None, 7)]
    rows = [(*r, *["clash"] * len(NAMES)) for r in rows]
    schema = "doc_id long, text string, source string, n_chars int, " + ", ".join(f"`{n}` string" for n in NAMES)
    docs = spark.createDataFrame(rows, schema).repartition(3)
    count = lambda df: collections.Counter((r.doc_id, r.text, r.source) for r in df.select("doc_id", "text", "source").collect())
    given = collections.Counter(r[:3] for r in rows)
    for name, stage in p.STAGES[:4]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns, name
        assert stage(spark, docs.limit(0), SF).count() == 0, name
        got = count(out)
        if name == "line dedup":
            assert got == given
            assert all(r.n_chars == (None if r.text is None else len(r.text)) for r in out.collect())
        elif name == "minhash near-dedup":
            # null and empty texts are one class, of the smallest id that isn't null
            assert got == collections.Counter([r[:3] for r in rows[:18]] + [(3, text(40), "a"), (50, "", "b")])
        elif name == "source mix":
            assert set(got) <= set(given) and all(r[1] for r in got)
            assert all(n <= 2 * given[r] for r, n in got.items())
            assert abs(sum(got.values()) - 30) <= 3  # 20 rows of 40 words, taken 1.5 times
        else:
            assert not got - given
    assert p.encode(spark, docs, SF).count() == len(rows)
    assert p.encode(spark, docs.limit(0), SF).count() == 0


def test_frequent_lines_go_from_rows_of_any_id(spark):
    import corpus_pipeline as p

    rows = [(None if k % 3 else 4, f"own line {k}\nShared", None, 1, "x") for k in range(10)]
    out = p.line_dedup(spark, spark.createDataFrame(rows, "doc_id long, text string, source string, n_chars int, __drop string"), SF).collect()
    assert sorted(r.text for r in out) == [f"own line {k}" for k in range(10)]
    out = p.line_dedup(spark, spark.createDataFrame(rows[:9], "doc_id long, text string, source string, n_chars int, __drop string"), SF).collect()
    assert all("Shared" in r.text for r in out)


def test_stages_leave_little_memory_behind(spark, monkeypatch):
    import os
    import subprocess
    import sys

    import corpus_pipeline as p
    from keelson.llm.common import release

    # The heap of executors is collected too: in local mode by one task per core besides the driver's call.
    beans = spark._jvm.java.lang.management.ManagementFactory.getGarbageCollectorMXBeans()
    whole = lambda: sum(b.getCollectionCount() for b in beans if "Old" in b.getName() or "MarkSweep" in b.getName())
    before = whole()
    release(spark)
    assert whole() - before >= 2
    # Small tables of the driver start no Python workers of another kind.
    monkeypatch.setattr(type(spark.sparkContext), "parallelize", lambda *_, **__: pytest.fail("rows go through Python workers"))
    assert p.mix_sources(spark, spark.read.parquet(f"{SF}/documents.parquet"), SF).count() > 0
    # An encoder keeps what it needs to encode: MB that are its process's own (108 with all it was made from).
    code = """if True:
        import re
        from keelson.llm import bpe
        from keelson.llm.queries import tokenizer
        own = lambda: int(re.search(r"Pss_Anon:\\s+(\\d+)", open("/proc/self/smaps_rollup").read())[1]) / 1024
        before = own()
        bpe.load(tokenizer("byte_bpe_50k.json"))
        print(own() - before)"""
    env = {**os.environ, "PYTHONPATH": str(p.__file__).rsplit("/", 1)[0]}
    got = subprocess.run([sys.executable, "-c", code], env=env, capture_output=True, text=True, check=True).stdout
    assert float(got) < 80
