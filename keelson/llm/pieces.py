"""Token counts of a sentence-piece vocabulary, most of them without merging.

No piece of the vocabulary has a blank after another character (checked when it is loaded), so
merges never cross from a solid character to a blank and a text is cut there. Which vocabulary
strings encode alone as one token is proved once, by merging each of them; a part that is such a
string counts one. Only the rest is merged, once for each different part that a worker sees."""

from __future__ import annotations

import heapq
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import own_names

#: Counted parts that a worker remembers at most; then it starts anew.
MEMORY = 500_000
LIMIT = 4096
#: Fixed: the letter that stands for a blank in the vocabulary.
BLANK = "▁"
_PARTS = regex.compile(r"▁*[^▁]+|▁+")


class Pieces:
    def __init__(self, path: str) -> None:
        from sentencepiece import SentencePieceProcessor

        sp = SentencePieceProcessor(model_file=path)
        odd = lambda i: sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)
        #: piece -> its rank; the best score merges first, equal scores from the left.
        self.rank = {sp.id_to_piece(i): -sp.get_score(i) for i in range(sp.get_piece_size()) if not odd(i)}
        if any(BLANK in p.lstrip(BLANK) for p in self.rank):
            raise ValueError("a piece has a blank after another character: texts can't be cut at blanks")
        self.whole = {p for p in self.rank if len(self.merge(p)) == 1}

    def merge(self, part: str) -> list[str]:
        """The symbols that are left when no two neighbours form a piece any more."""
        rank, symbols = self.rank, list(part)
        n = len(symbols)
        if n <= 24:
            while True:
                best, where = None, -1
                for i in range(len(symbols) - 1):
                    r = rank.get(symbols[i] + symbols[i + 1])
                    if r is not None and (best is None or r < best):
                        best, where = r, i
                if where < 0:
                    return symbols
                symbols[where : where + 2] = [symbols[where] + symbols[where + 1]]
        after, before = [*range(1, n), -1], list(range(-1, n - 1))
        heap = [(r, i, s) for i in range(n - 1) if (r := rank.get(s := symbols[i] + symbols[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, s = heapq.heappop(heap)
            j = after[i]
            if not symbols[i] or j < 0 or symbols[i] + symbols[j] != s:
                continue
            symbols[i], symbols[j] = s, ""
            after[i] = after[j]
            if after[j] >= 0:
                before[after[j]] = i
            for a, b in ((before[i], i), (i, after[i])):
                if a >= 0 and b >= 0 and (r := rank.get(t := symbols[a] + symbols[b])) is not None:
                    heapq.heappush(heap, (r, a, t))
        return [s for s in symbols if s]

    def count(self, part: str) -> int:
        """Tokens of one part; a character that is no piece is spelled by its bytes."""
        if part in self.whole:
            return 1
        return sum(1 if s in self.rank else len(s.encode("utf-8", "surrogatepass")) for s in self.merge(part))


class _Memory(dict):
    def __init__(self, pieces: Pieces) -> None:
        super().__init__()
        self.pieces = pieces

    def __missing__(self, part: str) -> int:
        if len(self) >= MEMORY:
            self.clear()
        # A line break is no piece, so nothing merges across it.
        n = sum(self.pieces.count(x) for x in part.split("\n")) + part.count("\n") if "\n" in part else self.pieces.count(part)
        if len(part) <= 256:
            self[part] = n
        return n


@lru_cache(maxsize=2)
def load(path: str) -> _Memory:
    p = Pieces(path)
    if "\n" in "".join(p.rank):
        raise ValueError("a piece holds a line break")
    return _Memory(p)


def count(text: str, path: str) -> int:
    memory = load(path)
    if not text:
        return 0
    text = BLANK + text.replace(" ", BLANK)
    if BLANK * 2 in text:
        return sum(map(memory.__getitem__, _PARTS.findall(text)))
    return sum(map(memory.__getitem__, map(BLANK.__add__, text.split(BLANK)[1:])))


def count_table(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = LIMIT) -> DataFrame:
    """id, n_bytes, n_tokens, over_limit: one row per row of df.

    A null text is an empty one: no bytes, no tokens. Rows of equal ids stay apart; other columns
    are ignored. Long parts without a blank are merged with a heap."""
    texts = own_names(df, id=id_col, text=text_col)
    kind = texts.schema["id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            for k in range(0, batch.num_rows, 512):
                part = batch.slice(k, 512)
                texts = [t or "" for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(t.encode()) for t in texts], pa.int64()), pa.array([count(t, path) for t in texts], pa.int64())], names=["id", "n_bytes", "n_tokens"])

    return texts.mapInArrow(run, f"id {kind}, n_bytes long, n_tokens long").withColumn("over_limit", F.col("n_tokens") > limit)


def digest(counted: DataFrame) -> DataFrame:
    return counted.withColumnRenamed("id", "doc_id")
