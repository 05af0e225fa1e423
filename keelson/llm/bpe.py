"""Byte-level BPE by a compiled tokenization automaton.

Every merge rule (a, b) is one merge gadget on a deterministic automaton whose arcs carry tokens.
At the start one state has an arc to itself for each byte. All a-arcs lead to one state q; where q
has a b-arc, the gadget copies q to q' without that arc, turns all a-arcs to q', and gives each
state that has an a-arc an ab-arc to where q's b-arc led. In the end each string is spelled by
exactly one path, its encoding.

The gadgets are compiled to a table. Tokens are numbered along the tree of their left parts, later
born children first, so that what a lost b-arc takes with it (b and all tokens that would have been
born from b's arc later) is one range of numbers. A state is the sorted bounds of the ranges that it
has no arcs for; the copy of a gadget adds one range. Where an arc leads depends on its token alone.

A pre-token is encoded in one pass over its bytes: each prefix has exactly one path too, so every
byte position is reached by exactly one arc, and the arcs that enter it are read back from the end.
Decoding joins the labels of arcs."""

from __future__ import annotations

import hashlib
import json
from array import array
from bisect import bisect_left, bisect_right
from functools import lru_cache
from struct import pack

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean, own_names, trim

#: Bytes of encoded parts that a worker remembers at most.
MEMORY = 32 << 20
#: Parts that are encoded together at most.
TOGETHER = 1 << 13
#: Bytes of a pre-token that is encoded together with others; a longer one is encoded by itself.
LONGEST = 64
#: Fixed: the byte-level pre-token pattern that goes with the public vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_PRE = regex.compile(PATTERN)
#: Three white space characters with a blank in the middle: only there can a blank's own cut matter.
_WIDE = regex.compile(r"\s \s")


def byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in the vocabulary file: printable Latin-1
    stands for itself, the others follow from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def without(bounds: tuple[int, ...], low: int, high: int) -> tuple[int, ...]:
    """Sorted bounds of disjoint ranges, with the range low..high (high not in it) added."""
    i, j = bisect_left(bounds, low), bisect_right(bounds, high)
    return (*bounds[:i], *([] if i & 1 else [low]), *([] if j & 1 else [high]), *bounds[j:])


class Trie:
    """Nodes of several children have a row by byte; of one child, that byte and child."""

    def __init__(self, edges: dict[int, int], nodes: int) -> None:
        """edges: child by node << 8 | byte."""
        keys, child = np.array(list(edges), np.int64), np.array(list(edges.values()), np.int32)
        node, byte = keys >> 8, keys & 255
        several = np.bincount(node, minlength=nodes) > 1
        self.row = np.where(several, np.cumsum(several), 0)  # row 0 is empty
        self.rows = np.full((int(several.sum()) + 1, 256), -1, np.int32)
        wide = several[node]
        self.rows[self.row[node[wide]], byte[wide]] = child[wide]
        self.byte, self.child = np.full(nodes, -1, np.int16), np.full(nodes, -1, np.int32)
        self.byte[node[~wide]], self.child[node[~wide]] = byte[~wide], child[~wide]

    def next(self, nodes: np.ndarray, byte: np.ndarray) -> np.ndarray:
        """The children by a byte each, -1 for none."""
        return np.where(self.byte[nodes] == byte, self.child[nodes], self.rows[self.row[nodes], byte])


class Automaton:
    """labels: bytes by token. numbers: a token's place in the tree of left parts. afters: the state
    that its arcs lead to. bounds: by state those of the numbers without an arc. What these were
    made from goes once they are made."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = byte_letters()
        spell = lambda s: bytes(map(letters.__getitem__, s))
        self.labels: dict[int, bytes] = {i: spell(s) for s, i in spec["model"]["vocab"].items()}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.labels.update({i: s.encode() for s, i in self.special.items()})
        ids = {s: i for i, s in self.labels.items() if i not in self.special.values()}
        pairs = [p if isinstance(p, list) else p.split(" ") for p in spec["model"]["merges"]]
        rules = [(ids[spell(x)], ids[spell(y)], ids[spell(x) + spell(y)]) for x, y in pairs]
        roots = [ids[bytes([b])] for b in range(256)]
        self._compile(rules, roots)
        self._index({s: t for s, t in ids.items() if t in self.after})

    def _compile(self, rules: list[tuple[int, int, int]], roots: list[int]) -> None:
        """One gadget per rule (a, b, ab), in order."""
        children: dict[int, list[tuple[int, int]]] = {}
        for born, (a, _, ab) in enumerate(rules, 1):
            children.setdefault(a, []).append((born, ab))
        weight = dict.fromkeys(roots, 1)
        for a, _, ab in rules:
            weight[ab] = 1
        for a, _, ab in reversed(rules):  # a token is born after its left part
            weight[a] += weight[ab]
        self.number: dict[int, int] = {}
        at, todo = 0, []
        for r in roots:
            self.number[r] = at
            at += weight[r]
            todo.append(r)
        ends: dict[int, tuple[list[int], list[int]]] = {}
        while todo:
            t = todo.pop()
            at, births, until = self.number[t] + 1, [], []
            for born, c in reversed(children.get(t, ())):
                self.number[c] = at
                at += weight[c]
                births.append(-born)
                until.append(at)
                todo.append(c)
            ends[t] = births, until

        def reach(t: int, rule: int) -> int:
            """Where the range ends of t and what is born from its arc with the rule or later."""
            births, until = ends[t]
            k = bisect_right(births, -rule)
            return until[k - 1] if k else self.number[t] + 1

        states: list[tuple[int, ...]] = [()]
        self.after: dict[int, int] = dict.fromkeys(roots, 0)
        for born, (a, b, ab) in enumerate(rules, 1):
            q = self.after.get(a)
            if q is None or b not in self.after or bisect_right(states[q], self.number[b]) & 1:
                continue  # the two never meet: the gadget changes nothing
            self.after[ab] = self.after[b]
            self.after[a] = len(states)
            states.append(without(states[q], self.number[b], reach(b, born)))
        used = sorted({0, *self.after.values()})
        new = {q: k for k, q in enumerate(used)}
        self.states = [array("I", states[q]) for q in used]
        self.after = {t: new[q] for t, q in self.after.items()}

    def _index(self, live: dict[bytes, int]) -> None:
        """The trie of the tokens, and all tables as arrays."""
        step: dict[int, int] = {}
        ends: list[int] = [-1]
        for s, t in live.items():
            node = 0
            for c in s:
                nxt = step.setdefault(node << 8 | c, len(ends))
                if nxt == len(ends):
                    ends.append(-1)
                node = nxt
            ends[node] = t
        self.at = np.array(ends, np.int32)
        self.trie = Trie(step, len(ends))
        n = max(self.labels) + 1
        self.numbers, self.afters, self.lengths = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64)
        for t, s in self.labels.items():
            self.numbers[t], self.afters[t], self.lengths[t] = self.number.get(t, 0), self.after.get(t, 0), len(s)
        self.row_ends = np.concatenate([[0], np.cumsum([len(x) for x in self.states])])
        self.bounds = np.repeat(np.arange(len(self.states), dtype=np.int64) << 20, np.diff(self.row_ends)) + np.concatenate([np.asarray(x, np.int64) for x in self.states])
        del self.number, self.after, self.states

    def word(self, text: bytes) -> list[int]:
        """The tokens of one pre-token."""
        ids, _ = self.words(np.frombuffer(text, np.uint8), np.array([0]), np.array([len(text)]))
        return ids.tolist()

    def arcs(self, states: np.ndarray, tokens: np.ndarray) -> np.ndarray:
        """Whether each state has an arc for each token: a number within bounds has passed an odd
        count of them."""
        passed = np.searchsorted(self.bounds, (states << 20) + self.numbers[tokens], "right") - self.row_ends[states]
        return passed & 1 == 0

    def words(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The tokens of pre-tokens, byte spans of data that follow each other without gaps: all
        ids, and the byte positions at which their labels end.

        Where tokens begin and end is looked up for all bytes at once; then byte by byte of all
        words the arcs that exist are taken."""
        size = ends - starts
        place = np.arange(len(data)) - np.repeat(starts - starts[0], size)
        left = np.repeat(size, size) - place
        at, node = np.arange(len(data)), np.zeros(len(data), np.int64)
        froms, tos, tokens, depth = [], [], [], 0
        while len(at):
            node = self.trie.next(node, data[at + depth])
            ok = node >= 0
            at, node = at[ok], node[ok]
            depth += 1
            t = self.at[node]
            hit = t >= 0
            froms.append(at[hit])
            tos.append(at[hit] + depth)
            tokens.append(t[hit])
            more = left[at] > depth
            at, node = at[more], node[more]
        froms, tos, tokens = np.concatenate(froms), np.concatenate(tos), np.concatenate(tokens)
        order = np.argsort(place[froms], kind="stable")
        froms, tos, tokens = froms[order], tos[order], tokens[order]
        cuts = np.searchsorted(place[froms], np.arange(int(size.max()) + 1))
        # came[k]: the token whose label ends before byte k of the data (a word's first byte: none).
        came = np.zeros(len(data) + 1, np.int64)
        for level, (i, j) in enumerate(zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)):
            a, b, t = froms[i:j], tos[i:j], tokens[i:j]
            if level:
                ok = self.arcs(self.afters[came[a]], t)
                b, t = b[ok], t[ok]
            came[b] = t  # at a word's first byte the state is 0, which has all arcs
        taken = np.zeros(len(data) + 1, bool)
        at, first = ends - starts[0], starts - starts[0]
        while len(at):
            taken[at] = True
            at = at - self.lengths[came[at]]
            more = at > first
            at, first = at[more], first[more]
        return came[taken], np.flatnonzero(taken)

    def pieces(self, text: str) -> list[str]:
        """Parts of a text that pre-split apart from each other: a blank after a solid character
        begins a pre-token, whatever follows."""
        if _WIDE.search(text):
            return _PRE.findall(text)
        first, *rest = text.split(" ")
        return [*([first] if first else []), *map(" ".__add__, rest)]


#: Classes of characters in the pre-token pattern: letters, numbers, others, white space.
_LETTER, _NUMBER, _OTHER, _SPACE = range(4)


@lru_cache(maxsize=1)
def _classes() -> np.ndarray:
    """The class of every code point."""
    out = np.full(0x110000, _OTHER, np.uint8)
    for kind, pattern in ((_LETTER, r"\p{L}+"), (_NUMBER, r"\p{N}+"), (_SPACE, r"\s+")):
        for low in range(0, 0x110000, 0x10000):
            if low == 0:
                chars = "".join(map(chr, [*range(0xD800), *([0x20] if kind != _SPACE else [0x41]) * 0x800, *range(0xE000, 0x10000)]))
            else:
                chars = "".join(map(chr, range(low, low + 0x10000)))
            for m in regex.finditer(pattern, chars):
                out[low + m.start() : low + m.end()] = kind
    return out


def _plain(points: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of parts (code points that follow each other): which are cut by classes alone, and where
    pre-tokens of those begin. A blank in front belongs to what follows; apostrophes and other white
    space have rules of their own."""
    kind = _classes()[points]
    odd = (kind == _SPACE) | (points == 0x27)
    lead = starts[(points[starts] == 0x20) & (ends - starts > 1)]
    odd[lead] = False
    sums = np.concatenate([[0], np.cumsum(odd)])
    plain = sums[ends] == sums[starts]
    kind[lead] = kind[lead + 1]
    begins = np.ones(len(points), bool)
    begins[1:] = kind[1:] != kind[:-1]
    begins[starts] = True
    return plain, begins


class Encoder:
    """Remembers the ids of parts, as little-endian 32-bit integers, within about MEMORY bytes: the
    latest half at the least and what is asked for again. Parts that aren't known are encoded
    together."""

    def __init__(self, path: str) -> None:
        self.automaton = Automaton(path)
        trim()
        self.special = regex.compile("(" + "|".join(map(regex.escape, self.automaton.special)) + ")")
        self.new: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.size = 0

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text."""
        a = self.automaton
        split = []
        for text in texts:
            if any(s in text for s in a.special):
                split.append([p for x in self.special.split(text) if x for p in ([x] if x in a.special else a.pieces(x))])
            else:
                split.append(a.pieces(text))
        known = self._known({p for parts in split for p in parts})
        return [b"".join(map(known.__getitem__, parts)) for parts in split]

    def _known(self, parts: set[str]) -> dict[str, bytes]:
        """Ids by part, of these parts at least."""
        missing = parts.difference(self.new)
        made = {p: self.old[p] for p in missing.intersection(self.old)}
        special = missing.intersection(self.automaton.special)
        made.update((p, pack("<I", self.automaton.special[p])) for p in special)
        fresh = list(missing.difference(made))
        for i in range(0, len(fresh), TOGETHER):
            self._made(fresh[i : i + TOGETHER], made)
        kept = {p: ids for p, ids in made.items() if len(p) <= 256}
        known = self.new if len(kept) == len(made) else {**self.new, **made}
        self.new.update(kept)
        self.size += 200 * len(kept) + sum(map(len, kept)) + sum(map(len, kept.values()))
        if self.size > MEMORY // 2:
            self.old, self.new, self.size = self.new, {}, 0
        return known

    def _made(self, parts: list[str], out: dict[str, bytes]) -> None:
        """Encodes different parts together. Long pre-tokens go one by one: rounds are by byte."""
        sizes = np.array([len(p) for p in parts])
        joined = "".join(parts)
        points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        ends = np.cumsum(sizes)
        starts = ends - sizes
        plain, begins = _plain(points, starts, ends)
        data = np.frombuffer(joined.encode("utf-8", "surrogatepass"), np.uint8)
        width = 1 + (points >= 0x80).astype(np.int64) + (points >= 0x800) + (points >= 0x10000)
        byte = np.concatenate([[0], np.cumsum(width)])
        for k in np.flatnonzero(~plain).tolist():
            at = int(starts[k])
            begins[at : ends[k]] = False
            for w in _PRE.findall(parts[k]):
                begins[at] = True
                at += len(w)
        first = byte[np.flatnonzero(begins)]
        last = np.append(first[1:], len(data))
        of = np.searchsorted(byte[ends], first, "right")  # the part of each pre-token
        long = last - first > LONGEST
        slow = np.zeros(len(parts), bool)
        slow[of[long]] = True
        if slow.any():
            raw = data.tobytes()
            for k in np.flatnonzero(slow).tolist():
                ids = [t for i in np.flatnonzero(of == k).tolist() for t in self.automaton.word(raw[first[i] : last[i]])]
                out[parts[k]] = pack(f"<{len(ids)}I", *ids)
            fast = ~slow[of]
            if not fast.any():
                return
            keep = np.repeat(~slow, byte[ends] - byte[starts])
            data, size = data[keep], (last - first)[fast]
            last = np.cumsum(size)
            first = last - size
            parts = [p for p, s in zip(parts, slow.tolist(), strict=True) if not s]
            stop = np.cumsum((byte[ends] - byte[starts])[~slow])
        else:
            stop = byte[ends]
        ids, at = self.automaton.words(data, first, last)
        cuts = (4 * np.searchsorted(at, stop, "right")).tolist()
        raw = ids.astype("<u4").tobytes()
        out.update(zip(parts, (raw[i:j] for i, j in zip([0, *cuts[:-1]], cuts, strict=True)), strict=True))


@lru_cache(maxsize=2)
def load(path: str) -> Encoder:
    return Encoder(path)


def encode(text: str, path: str) -> bytes:
    """The ids of a text as little-endian 32-bit integers."""
    return load(path).encode([text])[0]


def decode(ids: bytes, path: str) -> str:
    """The text that the arc labels spell; bytes that are no UTF-8 become U+FFFD."""
    labels = load(path).automaton.labels
    return b"".join(map(labels.__getitem__, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", "replace")


def encode_table(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = True) -> DataFrame:
    """id, n_tokens, ids (array<int>, if keep_ids), ids_sha256, decoded_sha256: one row per row of df.

    A null text is an empty one (no tokens). The longest texts cost time in proportion to their
    length, and are encoded as a whole. Repeated rows and rows of equal or null ids stay apart, each
    with its own result; there are no ties. An empty table gives an empty result; other columns,
    whatever their names, are ignored."""
    texts = own_names(df, id=id_col, text=text_col)
    kind = texts.schema["id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                part = batch.slice(k, 256)
                counts, ids, sums, back = [], [], [], []
                for x in load(path).encode([text or "" for text in part.column(1).to_pylist()]):
                    counts.append(len(x) // 4)
                    ids.append(x)
                    sums.append(hashlib.sha256(x).hexdigest())
                    back.append(hashlib.sha256(decode(x, path).encode()).hexdigest())
                columns = [part.column(0), pa.array(counts, pa.int64()), pa.array(sums), pa.array(back)]
                if keep_ids:
                    values = np.frombuffer(b"".join(ids), "<u4").astype(np.int32)
                    offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
                    columns.append(pa.ListArray.from_arrays(pa.array(offsets), pa.array(values)))
                yield pa.RecordBatch.from_arrays(columns, names=["id", "n_tokens", "ids_sha256", "decoded_sha256", "ids"][: len(columns)])

    return texts.mapInArrow(lean(run), f"id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * keep_ids)


def digest(encoded: DataFrame) -> DataFrame:
    return encoded.select(F.col("id").alias("doc_id"), "n_tokens", "ids_sha256", "decoded_sha256")
