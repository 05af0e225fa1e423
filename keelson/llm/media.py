"""Media columns: cropped and edited copies of images by local descriptors.

Corners are found on several scales, each the strongest of its neighbourhood, so their number
follows the area; around each, 256 pairs of points, turned by the patch's own orientation, are
compared, which gives a binary descriptor. Descriptors meet in Hamming tables: eight windows of 48
bits, whose buckets hold descriptors that agree there. Corners of many images are packed by bin of
the bucket, so that a task sorts the buckets of its bin and tells how often two images meet. In a
bucket of few images all meet. In a crowded one (corners of plain shapes look alike everywhere) the
bins tell only some pairs, so images of crowded buckets are packed into blocks besides, and each two
blocks count their meetings in all buckets, however crowded. Images that met often enough are
compared by their whole descriptors, and are linked if enough of the matching corners agree on one
turn, scale and shift; links make classes. Exact copies were merged before."""

from __future__ import annotations

from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Words, checkpointed, importable, lean, mix64, own_names, parts, release, trim
from .components import components

#: The scales, and how far around a corner no stronger one may lie.
SCALES, AROUND = (1.0, 0.84, 0.7071, 0.5946), 4
#: Bits of a descriptor; tables, each from another word on; bits of their keys, and further ones.
BITS, TABLES, KEY_BITS, MORE_BITS = 256, 8, 48, 13
#: In buckets of so many images at most all meet in the bins; in others, whose images meet in blocks
#: besides, each meets so many neighbours there.
FULL, NEXT = 6, 2
#: Corners and images of a block at most (an image of more corners is a block), and meetings or pairs
#: of corners that a step works on.
BLOCK, ROOM, CELLS = 1 << 16, 1 << 10, 1 << 20
#: Images that meet in so many buckets are compared.
VOTES = 6
#: Entries of corners that a task packs at a time.
CHUNK = 1 << 20
PATCH = 12
#: A link needs this many corners that agree, and bits that may differ in a match.
AGREE, APART = 8, 64
#: How far (in pixels of the first image) corners may lie from where the transform puts them.
NEAR = 5.0

#: Pixels that are described at a time.
PIXELS = 1 << 17
NOTHING = np.zeros((0, 4), np.float32), np.zeros((0, BITS // 8), np.uint8)

_rng = np.random.Generator(np.random.PCG64(5))
_PAIRS = np.clip(_rng.normal(0, PATCH / 2.5, (2, BITS, 2)), -PATCH, PATCH).astype(np.float32)
_GRID = np.stack(np.meshgrid(np.arange(-8, 9), np.arange(-8, 9), indexing="ij"), -1).reshape(-1, 2)
_GRID = _GRID[(_GRID**2).sum(1) <= 64]


def encode_pgm(image: np.ndarray) -> bytes:
    return b"P5 %d %d 255\n" % (image.shape[1], image.shape[0]) + image.astype(np.uint8).tobytes()


def decode_image(data: bytes | None) -> np.ndarray | None:
    """Grey values of a binary PGM or PPM; None for anything else, also if it is cut short."""
    if not data or data[:2] not in (b"P5", b"P6"):
        return None
    fields, at = [], 2
    while len(fields) < 3:
        while at < len(data) and data[at : at + 1].isspace():
            at += 1
        if data[at : at + 1] == b"#":
            at = data.find(b"\n", at) + 1 or len(data)
            continue
        end = at
        while end < len(data) and data[end : end + 1].isdigit():
            end += 1
        if end == at:
            return None
        fields.append(int(data[at:end]))
        at = end
    w, h, most = fields
    depth = 1 if data[:2] == b"P5" else 3
    body = data[at + 1 : at + 1 + w * h * depth]
    if most != 255 or not w * h or len(body) < w * h * depth:
        return None
    x = np.frombuffer(body, np.uint8).astype(np.float32)
    return x.reshape(h, w) if depth == 1 else x.reshape(h, w, 3) @ np.array([0.299, 0.587, 0.114], np.float32)


def _blur(x: np.ndarray) -> np.ndarray:
    """Images smoothed by 1 4 6 4 1 over 16 along both axes: four sums of neighbours each."""
    p = np.concatenate([x[:, :1], x[:, :1], x, x[:, -1:], x[:, -1:]], 1)
    for _ in range(4):
        p = p[:, :-1] + p[:, 1:]
    p = np.concatenate([p[..., :1], p[..., :1], p, p[..., -1:], p[..., -1:]], 2)
    for _ in range(4):
        p = p[..., :-1] + p[..., 1:]
    p *= 1 / 256
    return p


def _resized(x: np.ndarray, scale: float) -> np.ndarray:
    """An image, or images of one shape, on fewer pixels."""
    if scale == 1:
        return x
    for axis in (-2, -1):
        n = x.shape[axis]
        at = np.clip((np.arange(max(1, int(n * scale))) + 0.5) / scale - 0.5, 0, n - 1)
        low = at.astype(int)
        part = (at - low).astype(np.float32)
        part = part[:, None] if axis == -2 else part
        x = x.take(low, axis) * (1 - part) + x.take(np.minimum(low + 1, n - 1), axis) * part
    return x


def _peaks(x: np.ndarray) -> np.ndarray:
    """The greatest value within AROUND pixels along both axes."""
    for axis in (1, 2):
        wide = [(AROUND, AROUND) if k == axis else (0, 0) for k in range(3)]
        x, width = np.pad(x, wide, constant_values=-np.inf), 1
        cut = lambda a, i, j: a[:, i:j] if axis == 1 else a[..., i:j]  # noqa: B023, E731
        while width < 2 * AROUND + 1:  # widened by doubling
            step = min(width, 2 * AROUND + 1 - width)
            n = x.shape[axis]
            x, width = np.maximum(cut(x, 0, n - step), cut(x, step, n)), width + step
    return x


def describe_all(images: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Of each of several images of one shape, the corners (row, column, scale, angle), in pixels of
    the image, and their descriptors (32 bytes)."""
    margin, whose, spots, bits = PATCH + 6, [], [], []
    for scale in SCALES:
        x = _resized(images, scale)
        if min(x.shape[1:]) < 2 * margin + 3:
            continue
        x = _blur(x)
        gr, gc = np.zeros_like(x), np.zeros_like(x)
        gr[:, 1:-1], gc[..., 1:-1] = x[:, 2:] - x[:, :-2], x[..., 2:] - x[..., :-2]
        a, b, c = _blur(gr * gr), _blur(gc * gc), _blur(gr * gc)
        s = a * b - c * c - 0.05 * (a + b) ** 2
        inner = (slice(None), slice(margin, -margin), slice(margin, -margin))
        n, r, q = np.nonzero((s[inner] > 50.0) & (s[inner] == _peaks(s)[inner]))
        if not len(n):
            continue
        r, q, x = r + margin, q + margin, _blur(x)
        patch = x[n[:, None], r[:, None] + _GRID[:, 0], q[:, None] + _GRID[:, 1]]
        patch = patch - patch.mean(1, keepdims=True)
        angle = np.arctan2(*((patch * _GRID[:, k].astype(np.float32)).sum(1) for k in (0, 1)))  # the same in any batch
        cos, sin = np.cos(angle)[:, None], np.sin(angle)[:, None]
        values = []
        for p in _PAIRS:
            dr, dc = p[:, 0] * cos + p[:, 1] * sin, p[:, 1] * cos - p[:, 0] * sin
            rr = np.clip(r[:, None] + np.rint(dr).astype(np.int32), 0, x.shape[1] - 1)
            cc = np.clip(q[:, None] + np.rint(dc).astype(np.int32), 0, x.shape[2] - 1)
            values.append(x[n[:, None], rr, cc])
        whose.append(n)
        bits.append(np.packbits(values[0] < values[1], axis=1))
        spots.append(np.stack([(r + 0.5) / scale - 0.5, (q + 0.5) / scale - 0.5, np.full(len(r), 1 / scale), angle], 1).astype(np.float32))
    if not whose:
        return [NOTHING] * len(images)
    whose, spots, bits = np.concatenate(whose), np.concatenate(spots), np.concatenate(bits)
    order = np.argsort(whose, kind="stable")
    cuts = np.searchsorted(whose[order], np.arange(1, len(images)))
    return list(zip(np.split(spots[order], cuts), np.split(bits[order], cuts), strict=True))


def describe(image: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return describe_all(image[None].astype(np.float32))[0]


def _described(batches):
    """(node, spots, bits): the corners of one image and their descriptors, packed. Images of one
    shape are described some at a time, equal ones of a batch once."""
    for batch in batches:
        for k in range(0, batch.num_rows, 64):
            part = batch.slice(k, 64)
            nodes, shapes_, got = part.column(0).to_pylist(), {}, {}
            for node, data in zip(nodes, part.column(1), strict=True):
                if node not in got:
                    image, got[node] = decode_image(data.as_py()), NOTHING
                    if image is not None:
                        shapes_.setdefault(image.shape, []).append((node, image))
            for (h, w), same in shapes_.items():
                step = max(1, PIXELS // (h * w))
                for i in range(0, len(same), step):
                    some = same[i : i + step]
                    got.update(zip([n for n, _ in some], describe_all(np.stack([x for _, x in some])), strict=True))
            spots, bits = ([np.ascontiguousarray(got[n][k]).tobytes() for n in nodes] for k in (0, 1))
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(spots, pa.binary()), pa.array(bits, pa.binary())], names=["node", "spots", "bits"])


def codes(bits: np.ndarray) -> np.ndarray:
    """By descriptor and table: the table's number, its key and the further bits, high to low."""
    words = bits.view(">u4").astype(np.uint64)
    take = lambda k: np.roll(words, -k, axis=1)
    following = (take(1) << np.uint64(32)) | take(2)
    key = (words << np.uint64(16)) | (following >> np.uint64(48))
    more = (following >> np.uint64(48 - MORE_BITS)) & np.uint64((1 << MORE_BITS) - 1)
    tab = np.arange(TABLES, dtype=np.uint64) << np.uint64(KEY_BITS + MORE_BITS)
    return tab | (key << np.uint64(MORE_BITS)) | more


def _binned(bins: int):
    """Rows (bin, images, at, codes): the corners of many images by bin of their buckets; at: the
    place of a corner's image in images, their numbers."""

    def rows(numbers: list[int], parts: list[np.ndarray]) -> pa.RecordBatch:
        known = np.array(numbers, np.int64)
        at = np.repeat(np.arange(len(parts), dtype=np.uint16), [x.size for x in parts])
        code = np.concatenate([x.ravel() for x in parts])
        to = (mix64(code >> np.uint64(MORE_BITS)) >> np.uint64(32)) % np.uint64(bins)
        order = np.lexsort((code, to))
        at, code, to = at[order], code[order], to[order]
        cuts = np.append(np.flatnonzero(np.diff(to, prepend=np.uint64(bins))), len(to))
        kinds = [pa.int32(), *[pa.binary()] * 3]
        out = []
        for i, j in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            here, place = np.unique(at[i:j], return_inverse=True)
            out.append((int(to[i]), known[here].tobytes(), place.astype(np.uint16).tobytes(), code[i:j].tobytes()))
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate(kinds)], names=["bin", "images", "at", "codes"])

    def run(batches):
        numbers, parts, n = [], [], 0
        for batch in batches:
            for number, bits in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if not bits:
                    continue
                numbers.append(number)
                parts.append(codes(np.frombuffer(bits, np.uint8).reshape(-1, BITS // 8)))
                n += parts[-1].size
                if n >= CHUNK or len(parts) == 1 << 16:
                    yield rows(numbers, parts)
                    numbers, parts, n = [], [], 0
        if parts:
            yield rows(numbers, parts)

    return run


def meetings(image: np.ndarray, code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of images that meet in buckets, low << 32 | high, and in how many buckets; in crowded
    ones only neighbours meet. image: their numbers, one entry per corner and table."""
    return _meetings(image, code)[:2]


def _meetings(image: np.ndarray, code: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Those, and the images that stand in crowded buckets."""
    pairs = []

    def meet(bucket: np.ndarray, image: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Adds the pairs of uncrowded buckets and of neighbours; gives what is crowded."""
        order = np.lexsort((image, bucket))
        bucket, image = bucket[order], image[order]
        new = np.ones(len(bucket), bool)
        new[1:] = (bucket[1:] != bucket[:-1]) | (image[1:] != image[:-1])
        bucket, image = bucket[new], image[new]
        order = np.lexsort((mix64(bucket * np.uint64(0x9E3779B97F4A7C15) + image.astype(np.uint64)), bucket))
        bucket, image = bucket[order], image[order]
        starts = np.flatnonzero(np.diff(bucket, prepend=bucket[:1] + np.uint64(1)))
        size = np.diff(np.append(starts, len(bucket)))
        crowded = np.repeat(size > FULL, size)
        for d in range(1, FULL):
            same = bucket[d:] == bucket[:-d]
            if d > NEXT:
                same &= ~crowded[d:]
            a, b = image[:-d][same].astype(np.uint64), image[d:][same].astype(np.uint64)
            pairs.append((np.minimum(a, b) << np.uint64(32)) | np.maximum(a, b))
        return bucket[crowded], image[crowded]

    if not len(code):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    often, crowd = map(np.unique, meet(code >> np.uint64(MORE_BITS), image))
    if len(often):
        again = np.isin(code >> np.uint64(MORE_BITS), often)
        meet(code[again], image[again])
    return *np.unique(np.concatenate(pairs), return_counts=True), crowd


def _met(table: pa.Table) -> pa.Table:
    """(a, b, votes) of the buckets of one bin; (a, a, 0) for an image of a crowded one."""
    known = [np.frombuffer(x.as_py(), np.int64) for x in table.column("images")]
    names = np.unique(np.concatenate(known))
    image = np.concatenate([np.searchsorted(names, k)[np.frombuffer(x.as_py(), np.uint16)] for k, x in zip(known, table.column("at"), strict=True)])
    code = np.concatenate([np.frombuffer(x.as_py(), np.uint64) for x in table.column("codes")])
    pairs, votes, crowd = _meetings(image, code)
    side = lambda k: pa.array(names[np.append(k.astype(np.int64), crowd)])
    votes = np.append(votes, np.zeros(len(crowd))).astype(np.int32)
    out = pa.table({"a": side(pairs >> np.uint64(32)), "b": side(pairs & np.uint64(0xFFFFFFFF)), "votes": pa.array(votes)})
    trim()
    return out


def matches(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of two images' descriptors, those that are nearest to each other and close."""
    if not len(x) or not len(y):
        return np.zeros(0, int), np.zeros(0, int)
    sign = lambda b: np.unpackbits(b, axis=1).astype(np.float32) * 2 - 1
    apart = (BITS - sign(x) @ sign(y).T) / 2
    best, back = apart.argmin(1), apart.argmin(0)
    i = np.flatnonzero((back[best] == np.arange(len(x))) & (apart.min(1) <= APART))
    return i, best[i]


def consensus(a: np.ndarray, b: np.ndarray) -> int:
    """Of matching corners a and b (row, column, scale, angle), how many agree on one similarity
    transform. Each match proposes one; corners of a are counted once."""
    turn, grow = b[:, 3] - a[:, 3], b[:, 2] / a[:, 2]
    cos, sin = (np.cos(turn) * grow)[:, None], (np.sin(turn) * grow)[:, None]
    # By proposal and point, turned (row, column): the angle is measured from the column axis towards rows.
    r, c = a[:, 0] * cos + a[:, 1] * sin, a[:, 1] * cos - a[:, 0] * sin
    own = np.arange(len(a))
    miss = np.hypot(r - (r[own, own] - b[:, 0])[:, None] - b[:, 0], c - (c[own, own] - b[:, 1])[:, None] - b[:, 1])
    off = np.abs((turn - turn[:, None] + np.pi) % (2 * np.pi) - np.pi)
    agree = (miss <= NEAR * np.maximum(1, grow)[:, None]) & (off < 0.5)
    _, at = np.unique(a[:, :2], axis=0, return_inverse=True)
    return int((agree.astype(np.float32) @ np.eye(at.max() + 1, dtype=np.float32)[at.ravel()] > 0).sum(1).max(initial=0))


def alike(x: tuple[np.ndarray, np.ndarray], y: tuple[np.ndarray, np.ndarray]) -> bool:
    """Whether two described images show the same thing."""
    i, j = matches(x[1], y[1])
    return len(i) >= AGREE and consensus(x[0][i], y[0][j]) >= AGREE


def _agreeing(batches):
    read = lambda spots, bits: (np.frombuffer(spots, np.float32).reshape(-1, 4), np.frombuffer(bits, np.uint8).reshape(-1, BITS // 8))
    for batch in batches:
        yes = [alike(read(xs, xb), read(ys, yb)) for xs, xb, ys, yb in zip(*(batch.column(c).to_pylist() for c in (2, 3, 4, 5)), strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(yes, pa.bool_()))


def _ranges(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """start, start + 1 and so on, size of them, one range after another."""
    return np.arange(int(size.sum())) + np.repeat(start - (np.cumsum(size) - size), size)


def _steps(size: np.ndarray, most: int) -> list[tuple[int, int]]:
    """Slices whose sizes add up to little more than most, or of one element."""
    cuts = np.flatnonzero(np.diff(np.cumsum(size) // most, prepend=-1, append=-1)) if len(size) else np.zeros(1, int)
    return list(zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True))


class Block:
    """Described images, one after another: their numbers; first: where the corners of each begin."""

    def __init__(self, images: bytes, sizes: bytes, spots: bytes, bits: bytes) -> None:
        self.images, self.sizes = np.frombuffer(images, np.int64), np.frombuffer(sizes, np.int64)
        self.first = np.cumsum(self.sizes) - self.sizes
        self.spots, self.bits = np.frombuffer(spots, np.float32).reshape(-1, 4), np.frombuffer(bits, np.uint8).reshape(-1, BITS // 8)
        self.words = self.bits.view(np.uint64)
        self.columns = np.ascontiguousarray(self.words.T)
        # Once per bucket and image; images are numbered within the block.
        own = np.repeat(np.arange(len(self.images), dtype=np.uint64), self.sizes)[:, None]
        entries = np.unique((codes(self.bits) >> np.uint64(MORE_BITS)) * np.uint64(ROOM) + own)
        self.at = (entries % np.uint64(ROOM)).astype(np.int64)
        self.buckets, self.begin, self.often = np.unique(entries // np.uint64(ROOM), return_index=True, return_counts=True)

    def corners(self, k: int) -> slice:
        return slice(int(self.first[k]), int(self.first[k] + self.sizes[k]))


def shared(x: Block, y: Block) -> np.ndarray:
    """By image of x and image of y, in how many buckets both stand."""
    _, p, q = np.intersect1d(x.buckets, y.buckets, assume_unique=True, return_indices=True)
    votes = np.zeros(len(x.images) * len(y.images), np.int64)
    for i, j in _steps(x.often[p] * y.often[q], CELLS):
        u, v = p[i:j], q[i:j]
        times = np.repeat(y.often[v], x.often[u])
        a = np.repeat(x.at[_ranges(x.begin[u], x.often[u])], times)
        b = y.at[_ranges(np.repeat(y.begin[v], x.often[u]), times)]
        votes += np.bincount(a * len(y.images) + b, minlength=len(votes))
    return votes.reshape(len(x.images), len(y.images))


@cache
def _rooms() -> tuple[np.ndarray, np.ndarray]:
    """Room that is used again, as new pages for each step cost more than the step."""
    return np.empty(2 * CELLS, np.uint64), np.empty(2 * CELLS, np.uint8)


def _apart(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """In how many bits descriptors differ (255 for all): x by words, y by columns of words."""
    out = np.empty((len(x), y.shape[1]), np.uint8)
    step = max(1, CELLS // y.shape[1])
    for i in range(0, len(x), step):
        got = out[i : i + step]
        differ, more = (r[: got.size].reshape(got.shape) if got.size <= len(r) else np.empty(got.shape, r.dtype) for r in _rooms())
        for w in range(len(y)):
            np.bitwise_xor(x[i : i + step, w, None], y[w], out=differ)
            np.bitwise_count(differ, out=more if w else got)
            if w:
                np.add(got, more, out=got)
        if (round_ := got < more).any():  # 256 came round to 0
            got[round_] = 255
    return out


def alike_all(x: Block, k: int, y: Block, some: np.ndarray) -> np.ndarray:
    """Which of some images of y are alike to image k of x: what alike() says, for many at a time."""
    here = x.corners(k)
    place = np.unique(x.spots[here, :2], axis=0, return_inverse=True)[1].ravel()
    yes = np.zeros(len(some), bool)
    for i, j in _steps(y.sizes[some], max(1, CELLS // len(place))):
        yes[i:j] = _alike_some(x.spots[here], x.words[here], place, y, some[i:j])
    return yes


def _alike_some(spots: np.ndarray, words: np.ndarray, place: np.ndarray, y: Block, some: np.ndarray) -> np.ndarray:
    size, n = y.sizes[some], len(spots)
    begin = np.cumsum(size) - size
    columns, whose = _ranges(y.first[some], size), np.repeat(np.arange(len(some)), size)
    apart = _apart(words, y.columns.take(columns, 1))
    # Nearest to each other: by column the first of the nearest, which has to be nearest in its row.
    kind, low = (np.uint16, 8) if n <= 256 else (np.uint32, 24)
    top = ((apart.astype(kind) << kind(low)) | np.arange(n, dtype=kind)[:, None]).min(0)
    i, top = (top & kind((1 << low) - 1)).astype(np.int64), top >> kind(low)
    c = np.flatnonzero((top <= APART) & (np.minimum.reduceat(apart, begin, axis=1)[i, whose] == top))
    i, b = i[c], whose[c]
    # Images of which too few matches, or too few turned alike, could agree are left out first.
    one, two = spots[i], y.spots[columns[c]]
    turned = 16 * b + (two[:, 3] - one[:, 3]).astype(float) % (2 * np.pi)
    turned = np.sort(np.append(turned, turned + 2 * np.pi))
    left = np.zeros(len(some), bool)
    start = turned[: max(0, len(turned) - AGREE + 1)]
    left[(start[turned[AGREE - 1 :] - start < 1.01] // 16).astype(int)] = True
    i, c, b = i[left[b]], c[left[b]], b[left[b]]
    # Of a row's equally near corners the first.
    before = c - begin[b]
    tie = apart.ravel()[_ranges(i * len(columns) + begin[b], before)] == np.repeat(top[c], before)
    first = np.bincount(np.repeat(np.arange(len(c)), before)[tie], minlength=len(c)) == 0
    i, c, b = i[first], c[first], b[first]
    # As in consensus(): match p proposes, match q of the same image agrees.
    one, two = spots[i], y.spots[columns[c]]
    count = np.bincount(b, minlength=len(some))
    p = np.repeat(np.arange(len(b)), count[b])
    q = _ranges((np.cumsum(count) - count)[b], count[b])
    turn, grow = two[:, 3] - one[:, 3], two[:, 2] / one[:, 2]
    near = np.abs((turn[q] - turn[p] + np.pi) % (2 * np.pi) - np.pi) < 0.5
    near &= np.bincount(p[near], minlength=len(b))[p] >= AGREE
    p, q = p[near], q[near]
    cos, sin = np.cos(turn) * grow, np.sin(turn) * grow
    r, c = one[q, 0] * cos[p] + one[q, 1] * sin[p], one[q, 1] * cos[p] - one[q, 0] * sin[p]
    own = one[:, 0] * cos + one[:, 1] * sin - two[:, 0], one[:, 1] * cos - one[:, 0] * sin - two[:, 1]
    agree = np.hypot(r - own[0][p] - two[q, 0], c - own[1][p] - two[q, 1]) <= NEAR * np.maximum(1, grow)[p]
    votes = np.unique(p[agree] * n + place[i[q[agree]]]) // n  # a corner's place counts once
    return np.bincount(b[np.bincount(votes, minlength=len(b)) >= AGREE], minlength=len(some)) > 0


def _blocked(batches):
    """Rows (first, images, sizes, spots, bits) of many images; first: the number of the first."""
    names = ["first", "images", "sizes", "spots", "bits"]

    def row(some):
        numbers, sizes = (np.array(x, np.int64) for x in ([s[0] for s in some], [len(s[2]) * 8 // BITS for s in some]))
        values = [int(numbers[0]), numbers.tobytes(), sizes.tobytes(), b"".join(s[1] for s in some), b"".join(s[2] for s in some)]
        return pa.RecordBatch.from_arrays([pa.array([v], pa.binary() if k else pa.int64()) for k, v in enumerate(values)], names=names)

    some, n = [], 0
    for batch in batches:
        for image in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
            size = len(image[2]) * 8 // BITS
            if some and (n + size > BLOCK or len(some) == ROOM):
                yield row(some)
                some, n = [], 0
            some.append(image)
            n += size
    if some:
        yield row(some)


def _compared(batches):
    """(a, b): the links between the images of two blocks, or within one."""
    for batch in batches:
        for k in range(batch.num_rows):
            first, *x, other = (batch.column(c)[k].as_py() for c in range(6))
            x = Block(*x)
            y = x if first == other else Block(*(batch.column(c)[k].as_py() for c in range(6, 10)))
            votes = shared(x, y)
            links = [np.zeros((2, 0), np.int64)]
            for i in range(len(x.images)):
                some = np.flatnonzero(votes[i] >= VOTES)
                some = some[some > i] if y is x else some
                if len(some):
                    found = y.images[some[alike_all(x, i, y, some)]]
                    links.append(np.stack([np.full(len(found), x.images[i]), found]))
            links = np.concatenate(links, 1)
            yield pa.RecordBatch.from_arrays([pa.array(links.min(0)), pa.array(links.max(0))], names=["a", "b"])
        trim()


def crowd_links(images: DataFrame) -> DataFrame:
    """a, b: all links between images (image, spots, bits) that meet in VOTES buckets, however many
    images these hold. Every two blocks are met, which grows with the square of the images."""
    n = images.agg(F.sum(F.length("bits"))).first()[0] or 0
    blocks = images.repartition(max(1, -(-n // (BLOCK * 3 // 4 * BITS // 8))))  # with room, so that a part is a block
    blocks = checkpointed(blocks.mapInArrow(lean(_blocked), "first long, images binary, sizes binary, spots binary, bits binary"))
    x, y = (blocks.toDF(*(f"{side}_{c}" for c in blocks.columns)) for side in "xy")
    both = x.hint("shuffle_replicate_nl").join(y, F.col("x_first") <= F.col("y_first"))  # blocks are read again, not shuffled
    return both.mapInArrow(lean(_compared), "a long, b long")


def _often_met(images: DataFrame, bins: int) -> DataFrame:
    """a, b: pairs that met often enough in the bins; (a, a): an image of a crowded bucket."""
    binned = images.select("image", "bits").mapInArrow(lean(_binned(bins)), "bin int, images binary, at binary, codes binary")
    met = binned.groupBy("bin").applyInArrow(_met, "a long, b long, votes int")
    votes = met.groupBy("a", "b").agg(F.sum("votes").alias("votes"))
    return checkpointed(votes.filter((F.col("votes") >= VOTES) | (F.col("a") == F.col("b"))).select("a", "b"))


def copy_classes(df: DataFrame, id_col: str, image_col: str) -> DataFrame:
    """id, class_id (the smallest id of the class), n_links (images alike to its own that meet it in
    VOTES buckets, crowded or not; parts of crowded buckets may add to these, so a few more are
    found): one row per row of df.

    Ids are integers; rows of null or equal ids stay apart. Equal bytes share a class; null images
    count as empty ones; these, unreadable ones and those without corners are alone beside their
    equals. The corners of an image grow with its area, however large it is. Of equally strong
    neighbouring corners all stay; of descriptors equally near the first counts; images of one hash
    of order meet in the order of their bytes' hashes. An empty table gives an empty result; other
    columns, whatever their names, are ignored."""
    rows = own_names(df, id=id_col, image=image_col).select(F.col("id").cast("long").alias("id"), F.coalesce("image", F.lit(b"")).alias("image"))
    hashed = rows.select("id", F.unhex(F.md5("image")).alias("node"), "image")  # 128 bits stand for an image
    members = checkpointed(hashed.select("id", "node"))
    # Described before they are dealt by bytes: the descriptors are smaller than the images.
    described = hashed.select("node", "image").mapInArrow(lean(_described), "node binary, spots binary, bits binary")
    kinds = described.groupBy("node").agg(F.first("spots").alias("spots"), F.first("bits").alias("bits"))
    # Numbered once and for all, as the checkpoint holds the numbers.
    images = checkpointed(kinds.withColumn("image", F.monotonically_increasing_id()))
    met = _often_met(images, 2 * parts(df))
    release(df.sparkSession)
    corners = images.select("image", "spots", "bits")
    told = met.filter("a <> b").join(corners.toDF("a", "xs", "xb"), "a").join(corners.toDF("b", "ys", "yb"), "b").select("a", "b", "xs", "xb", "ys", "yb")
    crowd = corners.join(met.filter("a = b").select(F.col("a").alias("image")), "image", "left_semi")
    links = checkpointed(told.mapInArrow(lean(_agreeing), "a long, b long").unionByName(crowd_links(crowd)).distinct())
    lead = members.groupBy("node").agg(F.min("id").alias("lead")).join(images.select("node", "image"), "node")
    classes = components(links).toDF("image", "top")
    degree = links.select(F.explode(F.array("a", "b")).alias("image")).groupBy("image").agg(F.count(F.lit(1)).alias("n_links"))
    told = lead.join(classes, "image", "left").withColumn("top", F.coalesce("top", "image"))
    heads = told.groupBy("top").agg(F.min("lead").alias("class_id"))
    by_node = told.join(heads, "top").join(degree, "image", "left").select("node", "class_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))
    return members.join(by_node, "node").select("id", "class_id", "n_links")


# -- a media column for the test tables, which have none ---------------------------------------
SIDE, SHAPES = 112, 48


def shapes(text: bytes | None) -> np.ndarray:
    """What a text adds to the shapes of an image: every different word falls to one shape."""
    data = np.frombuffer(text or b"", np.uint8)
    h = np.unique(Words(data, np.array([0, len(data)])).hashes())
    state = np.zeros(SHAPES, np.uint64)
    np.bitwise_xor.at(state, (h % np.uint64(SHAPES)).astype(int), h)
    return state


def draw(state: np.ndarray) -> np.ndarray:
    """An image: each shape's state gives its place, size and grey. Texts that share most words
    share most shapes."""
    image = np.full((SIDE, SIDE), 128.0, np.float32)
    for v in mix64(state + np.arange(1, SHAPES + 1, dtype=np.uint64)).tolist():
        r, c, a, b, grey = v & 127, v >> 7 & 127, 6 + (v >> 14 & 15), 6 + (v >> 18 & 15), v >> 22 & 255
        image[r % SIDE : r % SIDE + a, c % SIDE : c % SIDE + b] = grey
    return image


def edited(image: np.ndarray, kind: int) -> np.ndarray:
    """A copy: cropped (0), brighter with less contrast (1), turned by a quarter (2), or smaller (3)."""
    n = SIDE // 10
    if kind == 0:
        return image[n:, : -n // 2]
    if kind == 1:
        return np.clip(image * 0.8 + 30, 0, 255)
    return np.rot90(image) if kind == 2 else np.clip(_resized(image, 0.85), 0, 255)


def conversation_media(conversations: DataFrame) -> DataFrame:
    """media_id (twice the conversation's id; one more for an edited copy, which every fifth
    conversation has), image: all turns of a conversation draw one image. Turns are combined by
    exclusive or, on the map side first, so a conversation of very many turns is no task's burden."""
    importable(conversations.sparkSession)

    def turns(batches):
        for batch in batches:
            states = [shapes(t).view(np.int64) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(states, pa.list_(pa.int64()))], names=["id", "s"])

    def images(batches):
        for batch in batches:
            for k in range(0, batch.num_rows, 64):
                part = batch.slice(k, 64)
                ids, out = [], []
                for i, s in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    image = draw(np.array(s, np.int64).view(np.uint64))
                    ids.append(2 * i)
                    out.append(encode_pgm(image))
                    if i % 5 == 0:
                        ids.append(2 * i + 1)
                        out.append(encode_pgm(np.rint(edited(image, i // 5 % 4))))
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(out, pa.binary())], names=["media_id", "image"])

    drawn = conversations.filter("conv_id IS NOT NULL").select(F.col("conv_id").cast("long"), F.col("text").cast("binary")).mapInArrow(turns, "id long, s array<long>")
    whole = drawn.groupBy("id").agg(*(F.bit_xor(F.get("s", F.lit(k))).alias(f"s{k}") for k in range(SHAPES))).select("id", F.array(*(f"s{k}" for k in range(SHAPES))).alias("s"))
    return whole.mapInArrow(images, "media_id long, image binary")


def digest(classes: DataFrame) -> DataFrame:
    return classes.select(F.col("id").alias("media_id"), F.expr("id div 2").alias("conv_id"), "class_id", "n_links")
