"""MinHash near-dedup by improved consistent weighted sampling.

A text is a weighted set of its five-word shingles: weight is the shingle's count times the mean
inverse document frequency of its words. Frequencies are counted over all documents, in 2^20 cells
of the word's hash (feature hashing, so the table's size is fixed whatever the corpus). Word
frequencies, not the shingles' own, make the weights: a passage that thousands of near copies share
would otherwise weigh next to nothing beside any copy's own edits, and the copies would drift apart.

Samples are drawn so that two texts agree on one with the probability of their weighted Jaccard
similarity. They are banded; texts that share a band are candidates. Exact copies were merged
before. Two rounds of pivots come first, as they join most of what is alike with few comparisons:
one pivot of each bucket, then four others (all members of small buckets) where texts of one bucket
are still apart. Then whatever is apart in a larger bucket is compared in blocks: the texts outside
the class of the bucket's first text meet one another and that class, so of a large group of copies
only the few that are still apart meet the many. Each link is verified by the weighted Jaccard
similarity of the whole texts."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Words, checkpointed, lean, mix64, own_names, packed, release, steps, text_buffer, trim, unpacked, window_hashes
from .components import components

SHINGLE = 5
LIKE = 0.8
BANDS, ROWS = 14, 3
#: Pairs whose samples agree less often than this are not verified: at a similarity of 0.8 that
#: happens to one pair in a million.
GUESS = 0.5
#: Pivots of a bucket in the rounds after the first.
PIVOTS = 4
#: In buckets of so many texts at most, the second round compares all.
SMALL = 8
#: Bytes of a block's texts, each counted as so many more: some 2,000 texts.
BLOCK, BESIDES = 1 << 21, 1 << 10
#: Texts of a block whose similarities with another block's are worked out at once.
_SIDE = 512
_PAIRS = 1 << 18
#: Pairs whose ends (twice as many, 16 bytes each) may be broadcast.
FEW = 50_000
CELL_BITS = 20
_BLOCKS = 64
_STEP = 1 << 19
_MOST_TEXTS = 4096  # of a step: a text's number takes 12 bits of a key
_GOLD = np.uint64(0x9E3779B97F4A7C15)


def _cells(batches):
    """Documents by cell of their words, for one partition; block -1 counts the documents."""
    total, n = np.zeros(1 << CELL_BITS, np.int64), 0
    for batch in batches:
        for a, b in steps(batch.column(0), _STEP):
            part = batch.slice(a, b - a)
            w = Words(*text_buffer(part.column(0)))
            keys = np.unique((w.owner().astype(np.uint64) << np.uint64(CELL_BITS)) | (w.hashes() & np.uint64((1 << CELL_BITS) - 1)))
            total += np.bincount((keys & np.uint64((1 << CELL_BITS) - 1)).astype(np.int64), minlength=1 << CELL_BITS)
            n += part.num_rows
    size = (1 << CELL_BITS) // _BLOCKS
    blocks, data = [-1], [np.array([n], np.int64).tobytes()]
    for k in range(_BLOCKS):
        here = total[k * size : (k + 1) * size]
        if len(some := np.flatnonzero(here)):
            blocks.append(k)
            data.append(packed(here[some], some.astype(np.uint16)))
    yield pa.RecordBatch.from_arrays([pa.array(blocks, pa.int32()), pa.array(data, pa.binary())], names=["block", "data"])


def _summed(table: pa.Table) -> pa.Table:
    block = table.column("block")[0].as_py()
    total = np.zeros(1 if block < 0 else (1 << CELL_BITS) // _BLOCKS, np.int64)
    for data in table.column("data"):
        if block < 0:
            total += np.frombuffer(data.as_py(), np.int64)
        else:
            n, at = unpacked(data.as_py(), np.int64, np.uint16)
            total[at] += n
    return pa.table({"block": pa.array([block], pa.int32()), "data": pa.array([total.tobytes()], pa.binary())})


def word_weights(texts: DataFrame) -> np.ndarray:
    """The inverse document frequency of each cell, damped: the square root of
    1 + ln((1 + documents) / (1 + those with it)).

    4 MB whatever the corpus: partitions send sparse counts, 65 groups add them up."""
    rows = {r[0]: r[1] for r in texts.mapInArrow(lean(_cells), "block int, data binary").groupBy("block").applyInArrow(_summed, "block int, data binary").collect()}
    total = np.zeros(1 << CELL_BITS, np.int64)
    size = (1 << CELL_BITS) // _BLOCKS
    for k, data in rows.items():
        if k >= 0:
            total[k * size : (k + 1) * size] = np.frombuffer(data, np.int64)
    n = int(np.frombuffer(rows[-1], np.int64)[0]) if -1 in rows else 0
    return np.sqrt(1 + np.log((1 + n) / (1 + total))).astype(np.float32)


def _gamma_quantiles(n: int) -> np.ndarray:
    """Quantiles of Gamma(2, 1), by bisection of 1 - (1 + x) exp(-x)."""
    p = (np.arange(n) + 0.5) / n
    low, high = np.zeros(n), np.full(n, 50.0)
    for _ in range(60):
        x = (low + high) / 2
        less = 1 - (1 + x) * np.exp(-x) < p
        low, high = np.where(less, x, low), np.where(less, high, x)
    return (low + high) / 2


_R = _gamma_quantiles(1 << 16).astype(np.float32)
_LOG_C = np.log(_R)
_SEEDS = np.random.Generator(np.random.PCG64(11)).integers(1, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingles(column: pa.Array, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of consecutive texts (4,096 at most): keys (text number in the high 12 bits, a shingle's hash
    below), ascending; weights; and where each text's keys begin and the last ends. A text of one to
    four words has all of them for a shingle."""
    w = Words(*text_buffer(column))
    h, owner, n = w.hashes(), w.owner(), np.diff(w.first)
    value = idf[(h & np.uint64((1 << CELL_BITS) - 1)).astype(np.int64)].astype(np.float64)
    sums = np.concatenate([[0], np.cumsum(value)])
    whole = np.flatnonzero(owner[SHINGLE - 1 :] == owner[: -(SHINGLE - 1)]) if len(h) >= SHINGLE else np.zeros(0, np.int64)
    found, text = window_hashes(h, SHINGLE)[whole], owner[whole]
    weight = (sums[whole + SHINGLE] - sums[whole]) / SHINGLE
    short = np.flatnonzero((n > 0) & (n < SHINGLE))
    if len(short):
        odd = [mix64(np.bitwise_xor.accumulate(mix64(h[w.first[k] : w.first[k + 1]] + np.arange(1, n[k] + 1, dtype=np.uint64) * _GOLD))[-1:] + np.uint64(n[k])) for k in short]
        found, text = np.concatenate([found, *odd]), np.concatenate([text, short])
        weight = np.concatenate([weight, [(sums[w.first[k + 1]] - sums[w.first[k]]) / n[k] for k in short]])
    keys = (text.astype(np.uint64) << np.uint64(52)) | (found >> np.uint64(12))
    order = np.argsort(keys, kind="stable")
    keys, weight = keys[order], weight[order]
    new = np.ones(len(keys), bool)
    new[1:] = keys[1:] != keys[:-1]
    at = np.flatnonzero(new)
    # Equal shingles have equal words, so the count times the weight is the sum.
    weight = np.add.reduceat(weight, at) if len(at) else weight
    keys = keys[at]
    return keys, weight, np.searchsorted(keys, np.arange(len(column) + 1, dtype=np.uint64) << np.uint64(52))


def samples(keys: np.ndarray, weight: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Consistent weighted samples of each text that has shingles, one row each."""
    n = np.diff(first)
    some = first[:-1][n > 0]
    n = n[n > 0]
    out = np.zeros((len(some), BANDS * ROWS), np.uint64)
    if not len(some):
        return out
    h = mix64(keys & np.uint64((1 << 52) - 1))
    log_w = np.log(weight).astype(np.float32)
    for k, seed in enumerate(_SEEDS):
        u = h * seed
        u ^= u >> np.uint64(29)
        u *= _GOLD
        r = _R[(u >> np.uint64(48)).astype(np.int64)]
        beta = ((u >> np.uint64(8)) & np.uint64(0xFFFFFF)).astype(np.float32) * np.float32(2**-24)
        t = np.floor(log_w / r + beta)
        a = _LOG_C[((u >> np.uint64(32)) & np.uint64(0xFFFF)).astype(np.int64)] - r * (t - beta) - r
        best = np.flatnonzero(a == np.repeat(np.minimum.reduceat(a, some), n))
        best = best[np.searchsorted(best, some)]
        out[:, k] = mix64(h[best] + t[best].astype(np.int64).astype(np.uint64) * _GOLD)
    return out


def _limited(column: pa.Array):
    for a, b in steps(column, _STEP):
        for i in range(a, b, _MOST_TEXTS):
            yield i, min(b, i + _MOST_TEXTS)


def _signed(idf):
    def run(batches):
        for batch in batches:
            for a, b in _limited(batch.column(3)):
                part = batch.slice(a, b - a)
                keys, weight, first = shingles(part.column(3), idf.value)
                got, has = samples(keys, weight, first), np.diff(first) > 0
                bands = np.zeros((len(got), BANDS), np.uint64)
                for k in range(BANDS):
                    x = np.full(len(got), k, np.uint64)
                    for j in range(ROWS):
                        x = mix64(x + got[:, k * ROWS + j])
                    bands[:, k] = x
                short = (got & np.uint64(0xFFFF)).astype(np.uint16)
                at = iter(range(len(got)))
                rows = [(bands[i].view(np.int64), short[i].tobytes()) if yes and (i := next(at)) >= 0 else (np.zeros(0, np.int64), b"") for yes in has.tolist()]
                size = pc.binary_length(part.column(3)).cast(pa.int64())
                yield pa.RecordBatch.from_arrays([*part.columns[:3], size, pa.array([r[0] for r in rows], pa.list_(pa.int64())), pa.array([r[1] for r in rows], pa.binary())], names=["id", "h1", "h2", "size", "bands", "sig"])

    return run


def _similar(idf, like: float):
    def run(batches):
        for batch in batches:
            for a, b in _limited(batch.column(2)):
                part = batch.slice(a, b - a)
                (ka, wa, fa), (kb, wb, fb) = (shingles(part.column(i), idf.value) for i in (2, 3))
                common, i, j = np.intersect1d(ka, kb, assume_unique=True, return_indices=True)
                row = (common >> np.uint64(52)).astype(np.int64)
                least = np.bincount(row, np.minimum(wa[i], wb[j]), part.num_rows)
                total = [np.bincount((k >> np.uint64(52)).astype(np.int64), w, part.num_rows) for k, w in ((ka, wa), (kb, wb))]
                most = total[0] + total[1] - least
                yes = pa.array((least >= like * most - 1e-9) & (most > 0))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1)], names=["a", "b"]).filter(yes)

    return run


def _sums_of_least(a: tuple, b: tuple, shape: tuple[int, int]) -> np.ndarray:
    """The weight that texts of a and b have in common, for all pairs; a and b: keys and weights."""
    (ta, ha), (tb, hb) = (((k >> np.uint64(52)).astype(np.int64), k & np.uint64((1 << 52) - 1)) for k in (a[0], b[0]))
    oa, ob = np.argsort(ha, kind="stable"), np.argsort(hb, kind="stable")
    ta, ha, wa, tb, hb, wb = ta[oa], ha[oa], a[1][oa], tb[ob], hb[ob], b[1][ob]
    common = np.intersect1d(ha, hb)
    a0, a1, b0, b1 = (np.searchsorted(h, common, side) for h in (ha, hb) for side in ("left", "right"))
    na, nb = a1 - a0, b1 - b0
    out = np.zeros(shape)
    for k in np.flatnonzero(na * nb > 256):
        i, j = slice(a0[k], a1[k]), slice(b0[k], b1[k])
        out[np.ix_(ta[i], tb[j])] += np.minimum.outer(wa[i], wb[j])
    few = np.flatnonzero(na * nb <= 256)
    n = (na * nb)[few]
    if not len(few):
        return out
    cuts = np.searchsorted(np.cumsum(n), np.arange(0, int(n.sum()), _PAIRS))  # some _PAIRS pairs at a time
    for i, j in zip(cuts, [*cuts[1:], len(few)], strict=True):
        part, m = few[i:j], n[i:j]
        at = np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m)
        wide = np.repeat(nb[part], m)
        k, q = np.repeat(a0[part], m) + at // wide, np.repeat(b0[part], m) + at % wide
        out += np.bincount(ta[k] * shape[1] + tb[q], np.minimum(wa[k], wb[q]), shape[0] * shape[1]).reshape(shape)
    return out


def _crossed(idf, like: float):
    """Links between the classes of two blocks (or of one, if there is no second): all pairs of
    texts are compared; of two classes that are alike one link is told, which joins them."""

    def known(t: pa.Table, names: np.ndarray) -> list[tuple]:
        """By some hundred texts: where they begin, keys, weights, their sums, and classes."""
        out = []
        for k in range(0, t.num_rows, _SIDE):
            part = t.slice(k, _SIDE)
            keys, weight, _ = shingles(part.column("text").combine_chunks(), idf.value)
            total = np.bincount((keys >> np.uint64(52)).astype(np.int64), weight, part.num_rows)
            out.append((k, keys, weight, total, np.searchsorted(names, np.array(part.column("class").to_pylist()))))
        return out

    def run(table: pa.Table) -> pa.Table:
        second = table.column("second").to_numpy().astype(bool)
        left, right = table.filter(pa.array(~second)).combine_chunks(), table.filter(pa.array(second)).combine_chunks()
        right = right if second.any() else left
        names = np.unique(np.array(table.column("class").to_pylist()))
        ends = {}
        for k, ka, wa, sa, ca in (ours := known(left, names)):
            for m, kb, wb, sb, cb in ours if right is left else known(right, names):
                if right is left and m < k or len(np.union1d(ca, cb)) == 1:
                    continue
                least = _sums_of_least((ka, wa), (kb, wb), (len(sa), len(sb)))
                most = sa[:, None] + sb[None] - least
                for i, j in np.argwhere((least >= like * most - 1e-9) & (most > 0) & (ca[:, None] != cb[None])).tolist():
                    ends.setdefault((min(ca[i], cb[j]), max(ca[i], cb[j])), (k + i, m + j))
        one, two = left.column("node"), right.column("node")
        links = [sorted((one[i].as_py(), two[j].as_py())) for i, j in ends.values()]
        trim()
        return pa.table({"a": pa.array([e[0] for e in links], pa.string()), "b": pa.array([e[1] for e in links], pa.string())})

    return run


def _rest(placed: DataFrame, texts: DataFrame, idf, like: float) -> DataFrame | None:
    """Links (a, b) between texts of different classes that share a bucket of more than SMALL, all
    pairs compared; placed: node, lead, size, band, key, class. None if no such bucket is left.

    A bucket's home is the class of its smallest lead. Members of home and the others are dealt to
    blocks by their hashes. Blocks of others meet one another and the blocks of home; home's own
    need not. Each two blocks are a group of their own, however large the bucket."""
    home = F.min(F.struct("lead", "class"))["class"].alias("home")
    several = placed.groupBy("band", "key").agg(F.count(F.lit(1)).alias("n"), F.min("class").alias("low"), F.max("class").alias("high"), home).filter(f"low <> high AND n > {SMALL}").select("band", "key", "home")
    rows = checkpointed(placed.join(several, ["band", "key"]).select("band", "key", "class", "node", "size", (F.col("class") != F.col("home")).alias("other")))
    bytes_of = lambda which: F.coalesce(F.sum(F.when(which, F.col("size") + BESIDES)), F.lit(0))
    blocks = lambda which: F.ceil(bytes_of(which) / BLOCK).cast("int")
    cut = checkpointed(rows.groupBy("band", "key").agg(blocks(~F.col("other")).alias("homes"), blocks(F.col("other")).alias("others")))
    if cut.isEmpty():
        return None
    # Blocks of others are numbered first, then those of home.
    i = cut.select("*", F.explode(F.expr("sequence(0, others - 1)")).alias("i"))
    both = i.select("band", "key", "i", F.explode(F.expr("sequence(i, others + homes - 1)")).alias("j"))
    sides = both.select("band", "key", "i", "j", F.explode(F.expr("array_distinct(array(i, j))")).alias("block"))
    hashed = F.xxhash64("node", "band")
    block = F.when(F.col("other"), F.pmod(hashed, F.col("others"))).otherwise(F.col("others") + F.pmod(hashed, F.greatest("homes", F.lit(1))))
    dealt = rows.join(cut, ["band", "key"]).select("band", "key", block.cast("int").alias("block"), "class", "node").join(sides, ["band", "key", "block"])
    dealt = dealt.select("band", "key", "i", "j", (F.col("block") > F.col("i")).cast("int").alias("second"), "class", "node").join(texts, "node")
    return dealt.groupBy("band", "key", "i", "j").applyInArrow(_crossed(idf, like), "a string, b string").distinct()


def _agreeing(pairs: DataFrame) -> DataFrame:
    """Pairs (a, b, sa, sb) whose samples agree often enough to be verified."""

    def run(batches):
        for batch in batches:
            both = [np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint16).reshape(batch.num_rows, -1) for i in (2, 3)]
            yes = (both[0] == both[1]).mean(axis=1) >= GUESS if batch.num_rows else np.zeros(0, bool)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(yes))

    return pairs.mapInArrow(run, "a string, b string")


def near_classes(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", like: float = LIKE) -> DataFrame:
    """id, class_id (the smallest id of the class), n_links (the links of its text that were found on
    the way, which join its class; other links within a class aren't counted): one row per row of df.

    Ids are integers. Equal texts share a class, also null with empty ones and texts without words
    if they are equal. Rows that share an id share a class only if their texts are alike: their
    class is told by row. Whole texts are compared, however long. Of samples that tie the first in
    the order of shingle hashes is taken, of pivots that tie the smallest hash of text. An empty
    table gives an empty result; other columns, whatever their names, are ignored."""
    raw = own_names(df, id=id_col, text=text_col).select(F.col("id").cast("long").alias("id"), F.coalesce("text", F.lit("")).alias("text"))
    spark = df.sparkSession
    idf = spark.sparkContext.broadcast(word_weights(raw.select("text")))
    hashed = raw.select("id", F.xxhash64("text").alias("h1"), F.xxhash64(F.lit(1), "text").alias("h2"), "text")
    node = F.concat_ws(".", F.hex("h1"), F.hex("h2")).alias("node")  # 128 bits stand for a text
    # One row per document with its samples; texts stay where they are.
    signed = checkpointed(hashed.mapInArrow(lean(_signed(idf)), "id long, h1 long, h2 long, size long, bands array<long>, sig binary"))
    kinds = checkpointed(signed.groupBy("h1", "h2").agg(F.min("id").alias("lead"), F.first("size").alias("size"), F.first("bands").alias("bands"), F.first("sig").alias("sig")).withColumn("node", node))
    in_band = kinds.select("node", "lead", "size", F.posexplode("bands").alias("band", "key"))
    several = in_band.groupBy("band", "key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("band", "key")
    shared = checkpointed(in_band.join(several, ["band", "key"]))
    sigs = kinds.select("node", "sig")
    # The only shuffle of all texts: one copy of each that shares a band, for all rounds.
    asked_for = kinds.join(shared.select("node").distinct(), "node").select("h1", "h2", F.col("lead").alias("id"), "node").alias("t")
    own = hashed.alias("d")  # a text whose ids are all null is found by null
    texts = checkpointed(own.join(asked_for, (F.col("d.h1") == F.col("t.h1")) & (F.col("d.h2") == F.col("t.h2")) & F.col("d.id").eqNullSafe(F.col("t.id"))).select("node", "text"))
    links, classes, seen = None, None, None
    for turn in range(3):
        placed = shared.withColumn("class", F.col("node")) if classes is None else shared.join(classes, "node", "left").withColumn("class", F.coalesce("class", "node"))
        found = _rest(placed, texts, idf, like) if turn == 2 else None
        if turn < 2:
            # The first pivot is the smallest id, mostly what others were copied from; then any.
            placed = placed.withColumn("o", F.xxhash64(F.col("node"), F.lit(turn), F.col("band")) if turn else F.col("lead"))
            several = placed.groupBy("band", "key").agg(F.count(F.lit(1)).alias("n"), F.min("class").alias("low"), F.max("class").alias("high")).filter("low <> high").select("band", "key", "n")
            apart = placed.join(several, ["band", "key"])
            slot = F.pmod(F.xxhash64(F.col("node"), F.col("band"), F.lit(~turn)), F.lit(PIVOTS if turn else 1))
            if turn:
                slot = F.when(F.col("n") <= SMALL, F.xxhash64("node")).otherwise(slot)
            pivot = apart.groupBy("band", "key", slot.alias("slot")).agg(F.min(F.struct("o", "node", "class")).alias("p")).select("band", "key", F.col("p.node").alias("a"), F.col("p.class").alias("pc"))
            pairs = apart.join(pivot, ["band", "key"]).filter("class <> pc").select(F.least("a", "node").alias("a"), F.greatest("a", "node").alias("b")).distinct()
            if seen is not None:
                pairs = pairs.join(seen, ["a", "b"], "left_anti")
            asked = checkpointed(_agreeing(pairs.join(sigs.toDF("a", "sa"), "a").join(sigs.toDF("b", "sb"), "b").select("a", "b", "sa", "sb")))
            if not (n := asked.count()):
                continue
            seen = asked
            here = texts
            if n <= FEW:  # then the texts that aren't asked for needn't move
                here = texts.join(F.broadcast(asked.select(F.explode(F.array("a", "b")).alias("node")).distinct()), "node", "left_semi")
            met = asked.join(here.toDF("b", "tb"), "b").join(here.toDF("a", "ta"), "a").select("a", "b", "ta", "tb")
            found = met.mapInArrow(lean(_similar(idf, like)), "a string, b string").distinct()
        found = None if found is None else checkpointed(found)
        if found is None or found.isEmpty():
            continue
        links = found if links is None else links.unionByName(found)
        if classes is None:
            classes = components(found)
            classes = checkpointed(classes.toDF("node", "class"))
        else:
            of = lambda x: classes.toDF(x, f"c{x}")  # noqa: B023, E731
            met_classes = found.join(of("a"), "a", "left").join(of("b"), "b", "left").select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b"))
            merged = components(met_classes).toDF("old", "new")
            every = classes.unionByName(found.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(classes, "node", "left_anti").withColumn("class", F.col("node")))
            classes = checkpointed(every.join(merged, every["class"] == merged["old"], "left").select("node", F.coalesce("new", "class").alias("class")))
        release(spark)
    members = signed.select("id", node)
    one = kinds.select("node", "lead")
    if links is None:
        return members.join(one, "node").select("id", F.col("lead").alias("class_id"), F.lit(0).cast("long").alias("n_links"))
    degree = links.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count(F.lit(1)).alias("n_links"))
    told = one.join(classes, "node", "left").withColumn("class", F.coalesce("class", "node"))
    heads = told.groupBy("class").agg(F.min("lead").alias("class_id"))
    by_kind = told.join(heads, "class").join(degree, "node", "left").select("node", "class_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))
    return members.join(by_kind, "node").select("id", "class_id", "n_links")


def digest(classes: DataFrame) -> DataFrame:
    return classes.withColumnRenamed("id", "doc_id")
