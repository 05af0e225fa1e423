"""Each operator on odd tables: nulls, empty and long texts, ties, repeated rows, clashing columns,
and no rows at all; and against brute force."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from keelson.llm import bpe, gam, lines, media, minhash, mixing, pieces, rules, shards, substrings
from keelson.llm.components import components
from keelson.llm.queries import tokenizer

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, source string, lang string, id string, h1 string, sum string, n string, drop string, s string, key string, size string, node string, class string, block string, marks string, words string, score string"


def texts():
    rnd = random.Random(3)
    word = lambda: rnd.choice("alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu".split()) + str(rnd.randint(0, 60))
    base = [" ".join(word() for _ in range(rnd.randint(1, 90))) for _ in range(24)]
    passage = " ".join(word() for _ in range(30))
    out = [None, "", " \t\n", "Ünï code ½ \U0001f600", base[0], base[0], base[1] + "\n" + passage, passage + "\n" + base[2], base[3] + " " + passage + "\x0b" + base[4]]
    out += base
    near = base[5].split() * 3
    for k in range(4):
        near[k * 7] = "changed"
        out.append(" ".join(near))
    out += ["common line\n" + b + "\n Common LINE \n" for b in base[6:20]]
    out.append(" ".join(word() for _ in range(30_000)))
    out.append("x" * 100_000)
    out.append("and " * 60 + "$$$ ***" * 10)
    return out


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i if i != 9 else None, t, [None, "a", "b", "b"][i % 4], "xx", *["clash"] * 14) for i, t in enumerate(texts())]
    rows += [rows[5], rows[12], rows[12]]
    return spark.createDataFrame(rows, SCHEMA).repartition(3).persist()


@pytest.fixture(scope="module")
def none(odd):
    return odd.limit(0)


def given(odd):
    return [(r.doc_id, r.text, r.source) for r in odd.select("doc_id", "text", "source").collect()]


def sha(b):
    return hashlib.sha256(b if isinstance(b, bytes) else b.encode()).hexdigest()


def test_lines(odd, none):
    rows = given(odd)
    keyed = [[x.strip(" \t\n\x0b\x0c\r").translate({c: c + 32 for c in range(65, 91)}) for x in (t or "").split("\n")] for _, t, _ in rows]
    often = {k for k, n in collections.Counter(k for ks in keyed for k in set(ks) if k).items() if n >= 10}
    assert "common line" in often
    want = collections.Counter()
    for (i, t, _), ks in zip(rows, keyed, strict=True):
        kept = [x for x, k in zip((t or "").split("\n"), ks, strict=True) if k not in often]
        want[i, len(ks), len(ks) - len(kept), sha("\n".join(kept))] += 1
    assert collections.Counter(map(tuple, lines.digest(lines.dedup_lines(odd)).collect())) == want
    assert lines.dedup_lines(none).count() == 0
    kept = lines.dedup_rows(odd)
    assert kept.columns == odd.columns and kept.count() == len(rows) and kept.filter("text IS NULL").count() == 1


def test_substrings(odd, none):
    rows = given(odd)
    least, first, want = -(1 << 63), {}, collections.Counter()
    for i, t, _ in rows:
        w = WORD.findall(t or "")
        for k in range(len(w) - 12):
            key = tuple(w[k : k + 13])
            first[key] = min(first.get(key, 1 << 62), least if i is None else i)
    for i, t, _ in rows:
        w = WORD.findall(t or "")
        gone = {p for k in range(len(w) - 12) if first[tuple(w[k : k + 13])] < (least if i is None else i) for p in range(k, k + 13)}
        want[i, len(w), len(gone), sha(" ".join(x for p, x in enumerate(w) if p not in gone))] += 1
    got = collections.Counter(map(tuple, substrings.digest(substrings.dedup_substrings(odd)).collect()))
    assert got == want and any(k[2] for k in got)
    assert substrings.dedup_substrings(none).count() == 0


def test_cover_meets_every_shift():
    p, cover = substrings.PERIOD, set(substrings.COVER)
    assert all(any((i + d) % p in cover and (j + d) % p in cover for d in range(p)) for i in range(p) for j in range(p))
    assert substrings.ANCHOR + p - 1 == substrings.WINDOW


def test_shards(odd, none):
    rows = given(odd)
    got = shards.digest(shards.shard(odd, 5)).collect()
    want = collections.Counter((i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t, _ in rows)
    assert collections.Counter((r.doc_id, r["size"], r.text_crc32) for r in got) == want
    by = collections.defaultdict(list)
    for r in got:
        by[r.shard].append(r)
    total, most = sum(r["size"] for r in got), max(r["size"] for r in got)
    for part in by.values():
        assert sorted(r.slot for r in part) == list(range(len(part)))
        assert abs(sum(r["size"] for r in part) - total / 5) <= most
    assert shards.shard(none).count() == 0


def test_encoding(odd, none):
    from tokenizers import Tokenizer

    path = tokenizer("byte_bpe_50k.json")
    t = Tokenizer.from_file(path)
    want = collections.Counter()
    for i, text, _ in given(odd):
        ids = t.encode(text or "", add_special_tokens=False).ids
        want[i, len(ids), sha(np.array(ids, "<u4").tobytes()), sha(t.decode(ids, skip_special_tokens=False))] += 1
    out = bpe.encode_table(odd, path)
    assert collections.Counter(map(tuple, bpe.digest(out).collect())) == want
    assert out.filter("size(ids) <> n_tokens").count() == 0 and bpe.encode_table(none, path).count() == 0


def odd_strings():
    rnd = random.Random(5)
    letters = list(" \n\t\r\x0b\x1c\x85　  aab bthe'sre ll12½é中ñ\U0001f600▁#!_") + ["<|endoftext|>", "  ", "'ll"]
    out = ["".join(rnd.choice(letters) for _ in range(rnd.randint(0, 30))) for _ in range(1500)]
    return [*out, "a" * 300, " " * 40, "\n" * 9, *(chr(i) + "a " + chr(i) for i in range(1, 0x3000))]


def test_automaton_equals_library():
    from tokenizers import Tokenizer

    path, some = tokenizer("byte_bpe_50k.json"), odd_strings()
    t = Tokenizer.from_file(path)
    for text, want in zip(some, t.encode_batch(some, add_special_tokens=False), strict=True):
        got = bpe.encode(text, path)
        assert np.frombuffer(got, "<u4").tolist() == want.ids, repr(text)
        assert bpe.decode(got, path) == text
    assert bpe.decode(np.array([220, 162], "<u4").tobytes(), path) == t.decode([220, 162], skip_special_tokens=False)


def test_counts_equal_library(odd, none):
    from sentencepiece import SentencePieceProcessor

    path, some = tokenizer("piece_bpe_32k.model"), odd_strings()
    sp = SentencePieceProcessor(model_file=path)
    assert [pieces.count(x, path) for x in some] == [len(x) for x in sp.encode(some)]
    want = collections.Counter((i, len((t or "").encode()), n := len(sp.encode(t or "")), n > 4096) for i, t, _ in given(odd))
    assert collections.Counter(map(tuple, pieces.digest(pieces.count_table(odd, path)).collect())) == want
    assert pieces.count_table(none, path).count() == 0
    known = pieces.load(path).pieces
    assert all(len(known.merge(p)) == 1 for p in known.whole)


def test_classifier(spark, odd, none):
    labels = spark.createDataFrame([(i, int(i % 2), "clash") for i in range(40)] + [(None, 1, "x"), (3, None, "x")], "doc_id long, quality int, id string")
    model = gam.learn(odd, labels)
    got = gam.digest(gam.score(odd, model)).collect()
    assert len(got) == odd.count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got)
    assert gam.score(none, model).count() == 0 and gam.keep(odd, model).columns == odd.columns
    empty = gam.learn(none, labels.limit(0))
    assert {r.score for r in gam.score(odd, empty).collect()} == {0.5}


def test_classifier_learns():
    rnd = np.random.Generator(np.random.PCG64(1))
    x = rnd.random((1500, 4))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    m = gam.fit(x[:1000], y[:1000])
    assert ((m.score(x[1000:]) >= 0.5) == y[1000:]).mean() > 0.95
    assert {frozenset(p[:2]) for p in m.pairs} >= {frozenset((0, 1))}


def base(t):
    w = WORD.findall(t)
    seen, count, dup, lines_ = set(), collections.Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7)), 0, set()
    for i in range(len(w) - 7):
        if count[tuple(w[i : i + 8])] > 1:
            seen.update(range(i, i + 8))
    for x in t.split("\n"):
        if WORD.search(x):
            dup += x in lines_
            lines_.add(x)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), dup, len(seen)


def test_rules(odd, none):
    got = rules.digest(rules.quality_rules(odd)).collect()
    want = collections.Counter((i, *base(t or "")) for i, t, _ in given(odd))
    assert collections.Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got) == want
    for r in got:
        assert r.base_failed == (r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words)
        assert not (r.kept and r.base_failed)
    assert rules.quality_rules(none).count() == 0


def test_verdicts_equal_brute_force(spark):
    """Posterior and verdict of every row, by EM over rows in matrices."""
    rnd = random.Random(4)
    word = lambda: "".join(rnd.choice("abcdefghijklmnop") for _ in range(rnd.randint(2, 8)))
    rows = []
    for k in range(400):
        w = [word() for _ in range(rnd.randint(25, 120))]
        if k % 8 == 1:
            w = [x if i % 2 else "#$%*" for i, x in enumerate(w)]
        if k % 8 == 2:
            w = ["BUY!", "NOW!!"] * 30 + [x.upper() for x in w[:20]]
        rows.append((k, "\n".join(" ".join(w[i : i + 9]) for i in range(0, len(w), 9))))
    got = rules.quality_rules(spark.createDataFrame([*rows, (None, None), (7, "")], "doc_id long, text string")).collect()
    names = [f"vote_{k}" for k in rules.votes()]
    votes = np.array([[r[k] for k in names] for r in got])
    good = np.array(rules.START)[np.minimum((votes == -1).sum(1), 2)]
    for _ in range(rules.ROUNDS):
        share = (good.sum() + 1) / (len(votes) + 2)
        odds = np.full(len(votes), np.log(share / (1 - share)))
        for j in range(votes.shape[1]):
            for v in (-1, 0, 1):
                at = votes[:, j] == v
                yes, no = (good[at].sum() + 1) / (good.sum() + 3), ((1 - good)[at].sum() + 1) / ((1 - good).sum() + 3)
                odds[at] += np.log(yes / no)
        good = 1 / (1 + np.exp(-odds))
    for r, p in zip(got, good, strict=True):
        assert r.posterior == pytest.approx(p, abs=1e-6)
        assert r.kept == (not r.base_failed and r.posterior >= 0.5)
        if r.n_words and -1 not in (r[k] for k in names):
            assert r.kept
    assert not any(r.kept for r in got if r.n_words and r.id % 8 in (1, 2))


def test_estimate_of_a_worked_example():
    """Two rules that agree on 90 good and 10 bad texts: EM calls the texts what both say."""
    share, table = rules.estimate({(1, 1): 90, (-1, -1): 10})
    assert share == pytest.approx(91 / 102, abs=1e-3)
    for g, b in table:
        assert g[-1] == pytest.approx(1 / 93, abs=1e-3) and b[-1] == pytest.approx(11 / 13, abs=1e-2)
    assert rules.posterior(share, table, (-1, -1)) < 0.01 and rules.posterior(share, table, (1, 1)) > 0.99
    assert rules.estimate({}) == (0.5, [])


def test_estimate_finds_the_faulty():
    counts = {(1, 1, 1): 800, (-1, 1, 1): 60, (1, -1, 1): 50, (-1, -1, 1): 20, (0, 1, 1): 40}
    share, table = rules.estimate(counts)
    assert 0.7 < share < 0.98 and all(g[-1] < b[-1] for g, b in table[:2])


def test_mix(odd, none):
    rows = given(odd)
    got = mixing.mix(odd).collect()
    assert sorted(map(str, got)) == sorted(map(str, mixing.mix(odd.repartition(2)).collect()))
    size = collections.Counter((i, len(WORD.findall(t or ""))) for i, t, _ in rows)
    assert collections.Counter((r.id, r["size"]) for r in got) == size and all(r.taken <= 2 * r["size"] for r in got)
    by, taken = {}, collections.Counter()
    for r in got:
        by[r.source_size] = r.target
        taken[r.source_size] += r.taken
    assert all(abs(taken[k] - v) <= 1 for k, v in by.items())
    assert abs(sum(by.values()) - 1.5 * sum(by)) < 1 and mixing.mix(none).count() == 0


def test_targets():
    assert mixing.targets([100, 100, 100], [5, 2, 1], 450) == pytest.approx([200.0, 500 / 3, 250 / 3])
    assert mixing.targets([0, 10], [5, 2], 15) == [0.0, 15.0] and mixing.targets([], [], 0) == []


def test_schedule_spreads_sources(spark):
    plan = mixing.Plan(["a", "b", None], [64_000, 64_000, 6_400])
    slots = sorted(mixing.schedule(spark.range(1), plan).collect())
    assert len({r.slot for r in slots}) == len(slots) == sum(plan.visits)
    assert [sum(r.words for r in slots if r.s == k) for k in range(3)] == plan.words
    half = slots[: len(slots) // 2]
    for k, n in enumerate(plan.visits):
        assert abs(sum(r.s == k for r in half) - n / 2) <= 12


def test_mix_with_last_sources_without_words(spark):
    rows = [(i, "some words of a text", "ab"[i % 2]) for i in range(60)] + [(60, " ", "y"), (61, "", "z"), (62, None, None)]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    assert sorted(r.id for r in got) == list(range(63)) and sum(r.taken for r in got) == 450
    assert all(r.taken == r.target == 0 for r in got if r.id >= 60)


def jaccard(a, b):
    s = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set() for w in (WORD.findall(x) for x in (a, b))]
    return len(s[0] & s[1]) / max(1, len(s[0] | s[1]))


def test_near_classes(odd, none):
    got = {}
    for r in minhash.near_classes(odd).collect():
        got.setdefault(r.id, r.class_id)
    rows = [(i, t or "") for i, t, _ in given(odd) if i is not None]
    for i, a in rows:
        for j, b in rows:
            like = jaccard(a, b) if a != b else 1.0
            if like >= 0.85:
                assert got[i] == got[j]
            if like < 0.5 and i != j:
                assert got[i] != got[j]
    assert minhash.near_classes(none).count() == 0


def test_near_texts_without_ids(spark):
    a = " ".join(f"w{i}" for i in range(60))
    got = minhash.near_classes(spark.createDataFrame([(None, a), (None, a + " more"), (4, "other")], "doc_id long, text string")).collect()
    assert sorted((r.class_id is None, r.n_links) for r in got) == [(False, 0), (True, 1), (True, 1)]


def test_near_pairs_in_a_large_template_group(spark):
    """Texts of one template, most pairs below 0.8, so that no pivot stands for the others."""
    import pyarrow as pa

    rng = random.Random(7)
    template = [f"t{i}" for i in range(300)]

    def edit(words, n):
        words = list(words)
        for i in rng.sample(range(len(words)), n):
            words[i] = f"e{rng.randrange(10**9)}"
        return words

    texts = [edit(template, 5) for _ in range(600)]
    texts += [edit(t, 4) for t in texts[:40]]
    texts = [" ".join(t) for t in texts]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["id"]: r["class_id"] for r in minhash.near_classes(df).collect()}
    keys, weight, _ = minhash.shingles(pa.array(texts), minhash.word_weights(df.select("text")))
    sets = [{} for _ in texts]
    for k, w in zip(keys.tolist(), weight.tolist(), strict=True):
        sets[k >> 52][k & ((1 << 52) - 1)] = w
    near, total = [], [sum(s.values()) for s in sets]
    for i in range(len(texts)):
        for j in range(i):
            least = sum(min(w, sets[j].get(k, 0)) for k, w in sets[i].items())
            if least >= minhash.LIKE * (total[i] + total[j] - least):
                near.append((i, j))
    assert 40 <= len(near) < 0.05 * len(texts) ** 2 / 2
    assert [(i, j) for i, j in near if got[i] != got[j]] == []


def test_samples_agree_as_often_as_sets():
    import pyarrow as pa

    rnd = random.Random(2)
    words = [f"w{i}" for i in range(400)]
    a = [rnd.choice(words) for _ in range(1200)]
    b = a[:1000] + [rnd.choice(words) for _ in range(200)]
    keys, weight, first = minhash.shingles(pa.array([" ".join(a), " ".join(b)]), np.ones(1 << minhash.CELL_BITS, np.float32))
    got = minhash.samples(keys, weight, first)
    assert abs((got[0] == got[1]).mean() - jaccard(" ".join(a), " ".join(b))) < 0.25


def test_components(spark):
    links = [(i, i + 1) for i in range(0, 30) if i % 10 != 9] + [(100, k) for k in range(101, 140)] + [(5, 5), (None, 3), (2, 1)]
    got = dict(map(tuple, components(spark.createDataFrame(links, "a long, b long")).collect()))
    assert all(got[i] == i // 10 * 10 for i in range(31) if i < 30) and all(got[k] == 100 for k in range(100, 140))
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_images(spark):
    state = lambda k: media.shapes(" ".join(f"w{k}x{i}" for i in range(300)).encode())
    plain = [media.draw(state(k)) for k in range(6)]
    rows = [(10 * k, media.encode_pgm(x), "clash") for k, x in enumerate(plain)]
    for k in range(4):
        rows.append((10 * k + 1, media.encode_pgm(np.rint(media.edited(plain[k], k))), "clash"))
    rows += [(45, rows[4][1], "x"), (90, None, "x"), (91, b"", "x"), (92, b"P5 9 9 255\n123", "x"), (93, b"junk", "x"), (94, media.encode_pgm(np.zeros((64, 64))), "x"), (None, None, "x")]
    df = spark.createDataFrame(rows, "m long, pic binary, node string")
    got = {r.id: r.class_id for r in media.copy_classes(df, "m", "pic").collect() if r.id is not None}
    assert [got[10 * k + 1] for k in range(4)] == [0, 10, 20, 30] and got[45] == got[40] == 40
    assert [got[k] for k in (50, 92, 93, 94)] == [50, 92, 93, 94] and got[90] == got[91]
    assert media.copy_classes(df.limit(0), "m", "pic").count() == 0


def test_image_tables_against_brute_force():
    """Of the edited copies that a comparison of whole descriptors links, by edit, nine in ten meet
    often enough in the tables, among some hundred images; other images aren't linked."""
    rng = np.random.Generator(np.random.PCG64(1))
    edits = {
        "crop": lambda x: media.edited(x, 0),
        "deep crop": lambda x: x[17:-17, 17:-17],
        "contrast": lambda x: media.edited(x, 1),
        "turn": lambda x: media.edited(x, 2),
        "size": lambda x: media.edited(x, 3),
        "noise": lambda x: np.clip(x + rng.normal(0, 8, x.shape), 0, 255),
    }
    plain = [media.draw(media.shapes(" ".join(f"w{k}x{i}" for i in range(300)).encode())) for k in range(120)]
    seen = [media.describe(x) for x in plain]
    copies = []
    for name, edit in edits.items():
        for k in range(25):
            copies.append((name, k, len(seen)))
            seen.append(media.describe(np.rint(edit(plain[k])).astype(np.uint8).astype(np.float32)))
    code = [media.codes(d[1]).ravel() for d in seen]
    pairs, votes = media.meetings(np.repeat(np.arange(len(seen)), [len(c) for c in code]), np.concatenate(code))
    met = {(int(p) >> 32, int(p) & 0xFFFFFFFF): int(v) for p, v in zip(pairs, votes, strict=True)}
    for name in edits:
        linked = [(k, j) for n, k, j in copies if n == name and media.alike(seen[k], seen[j])]
        assert len(linked) >= 22, name
        assert sum(met.get(x, 0) >= media.VOTES for x in linked) >= 0.9 * len(linked), name
    assert not any(media.alike(seen[a], seen[b]) for a in range(40) for b in range(a))


def logos(marks, each, side):
    """Images that show one of a few marks, at another place each, and little else."""
    rng = np.random.Generator(np.random.PCG64(2))
    out = []
    for k, at in enumerate(rng.permutation(36 * 36)[: marks * each].tolist()):
        image = np.full((132, 132), 128.0, np.float32)
        r, c = 24 + at // 36, 24 + at % 36
        image[r : r + side, c : c + side] = media.draw(media.shapes(" ".join(f"m{k % marks}x{i}" for i in range(300)).encode()))[30 : 30 + side, 30 : 30 + side]
        out.append(media.decode_image(media.encode_pgm(image)))
    return out


def test_copies_that_meet_in_crowded_buckets_only(spark):
    """No link of images whose buckets are crowded is lost, against brute force over all pairs, and
    none is found that a comparison of whole descriptors doesn't confirm."""
    images = logos(2, 100, 16)
    seen = [media.describe(x) for x in images]
    buckets = [set((media.codes(d[1]) >> np.uint64(media.MORE_BITS)).ravel().tolist()) for d in seen]
    # Which image of a pair comes first depends on their numbers, and may decide between equally near corners.
    ways = {(a, b): media.alike(seen[a], seen[b]) + media.alike(seen[b], seen[a]) for b in range(len(images)) for a in range(b)}
    alike = [pair for pair, n in ways.items() if n]
    links = [(a, b) for a, b in alike if ways[a, b] == 2 and len(buckets[a] & buckets[b]) >= media.VOTES]
    assert len(links) > 10 * len(images)
    least, most = (collections.Counter(k for link in some for k in link) for some in (links, alike))
    df = spark.createDataFrame([(k, media.encode_pgm(x)) for k, x in enumerate(images)], "id long, image binary")
    got = {r.id: r for r in media.copy_classes(df, "id", "image").collect()}
    assert len(got) == len(images) and all(least[k] <= got[k].n_links <= most[k] for k in got)
    assert all(got[a].class_id == got[b].class_id for a, b in links)


def test_blocks_against_brute_force(monkeypatch):
    """Meetings of two blocks and comparison of many images, against one pair at a time."""
    images = logos(3, 8, 44) + [media.draw(media.shapes(f"a{k} b{k}".encode())) for k in range(4)] + [np.zeros((132, 132), np.float32)]
    images += [media.edited(x, k % 4) for k, x in enumerate(images[:12])]
    seen = [d for d in map(media.describe, images) if len(d[1])]
    # Descriptors that are equal, complements of one another, or many.
    seen += [(d[0], np.repeat(d[1][:1], len(d[1]), 0)) for d in seen[:2]] + [(seen[0][0], ~seen[0][1])]
    seen.append(tuple(np.concatenate([d[k] for d in seen[:20]]) for k in (0, 1)))
    block = lambda some: media.Block(np.arange(len(some)).tobytes(), np.array([len(d[1]) for d in some]).tobytes(), *(b"".join(d[k].tobytes() for d in some) for k in (0, 1)))
    x, y = block(seen[::2]), block(seen[1::2])
    buckets = [set((media.codes(d[1]) >> np.uint64(media.MORE_BITS)).ravel().tolist()) for d in seen]
    want = [[media.alike(a, b) for b in seen[1::2]] for a in seen[::2]]
    assert any(map(any, want)) and not all(map(all, want))
    for cells in (media.CELLS, 500):
        monkeypatch.setattr(media, "CELLS", cells)
        assert media.shared(x, y).tolist() == [[len(a & b) for b in buckets[1::2]] for a in buckets[::2]]
        assert [media.alike_all(x, k, y, np.arange(len(y.images))).tolist() for k in range(len(x.images))] == want


def test_crowded_buckets_stay_linear():
    n = 400
    code = np.full(n, 5 << media.MORE_BITS, np.uint64)
    pairs, votes = media.meetings(np.arange(n), code)
    assert len(pairs) <= 2 * media.NEXT * n and votes.max() <= 2
    kinds = n // (media.FULL - 1)
    pairs, _ = media.meetings(np.arange(n), code + np.arange(n, dtype=np.uint64) % np.uint64(kinds))
    same = {(a, b) for a in range(n) for b in range(a + 1, n) if a % kinds == b % kinds}
    assert same <= {(int(p) >> 32, int(p) & 0xFFFFFFFF) for p in pairs}
