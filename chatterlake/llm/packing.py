"""Best-fit packing of documents into fixed token sequences, after Martello-Toth reduction.

All that packing needs of a corpus is how many pieces there are of each length, at most
`CAPACITY` numbers. The plan is made on those: first the dominance reduction fixes sets of
two or three lengths that no other set containing the same piece can beat, many at a
time; the remainder is packed best-fit, longest first. A plan is a list of runs: pieces
rank_from, rank_from + 1, ... of one length go to sequences from sequence_from on, `many`
to each, from `offset` on. Each piece then needs only its rank among those of its length;
ranks come from counts of salted groups, so a length that a third of all pieces share is
spread over many tasks.

Defined cases. A null text is empty; an empty one is the end token alone. A document
longer than a sequence is cut into whole sequences, its first piece taking the remainder.
Rows that repeat a doc_id are packed one by one. A text of any length is tokenized whole:
beyond `LONG` characters by the tokenizers library, since the faster encoder's expressions
fail on runs of about a million blanks; ids are the same. A null doc_id is packed like others
and stays null. Pieces alike in length, hash and number are ranked by (doc_id, piece,
checksum); rows alike in all of that are interchangeable. Other columns of the input are
ignored, whatever their names. An empty table gives no rows.
"""

from __future__ import annotations

import base64
import json
import zlib
from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import public_tokenizers
import tiktoken
import tokenizers
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .storage import Scratch

CAPACITY, END = 2048, 0
#: Pieces ranked in one group.
GROUP = 512
#: Texts tokenized at a time.
AT_ONCE = 64
#: Characters of a text from which the tokenizers library encodes it.
LONG = 200_000
#: The same vocabulary as byte_bpe_50k.json, as ranks; ids are alike but for the added tokens, which only the JSON lists.
VOCABULARY, LISTED = "byte_bpe_50k.tiktoken", "byte_bpe_50k.json"
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"

_encodings: dict[tuple, tiktoken.Encoding] = {}
_tokenizers: dict[int, tokenizers.Tokenizer] = {}


def added_tokens() -> dict[str, int]:
    """The tokens that the tokenizer finds in texts before it splits them, and their ids."""
    with open(public_tokenizers.path(LISTED), encoding="utf-8") as f:
        return {t["content"]: t["id"] for t in json.load(f)["added_tokens"]}


def encoding(ranks: bytes, added: dict[str, int]) -> tiktoken.Encoding:
    key = (zlib.crc32(ranks), *sorted(added.items()))
    if key not in _encodings:
        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}
        _encodings[key] = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens=added)
    return _encodings[key]


def long_ids(listed: str, text: str) -> list[int]:
    """Ids by the tokenizers library, from the JSON of the same vocabulary."""
    key = zlib.crc32(listed.encode())
    if key not in _tokenizers:
        _tokenizers[key] = tokenizers.Tokenizer.from_str(listed)
    return _tokenizers[key].encode(text, add_special_tokens=False).ids


def cuts(n: int, capacity: int) -> list[int]:
    """Where pieces of n tokens begin, and the end; the first piece takes what whole sequences leave."""
    first = n % capacity or capacity
    return [0, *range(first, n + 1, capacity)]


def tokenized(docs: DataFrame, vocabulary: str, capacity: int, added: dict[str, int]) -> DataFrame:
    """A row for each piece of each document: its ids' place, number and checksum."""
    with open(vocabulary, "rb") as f:
        ranks = f.read()
    with open(public_tokenizers.path(LISTED), encoding="utf-8") as f:
        listed = f.read()

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = encoding(ranks, added)
        for batch in batches:
            ids, texts = batch.column("doc_id"), batch.column("text")
            for a in range(0, len(texts), AT_ONCE):
                out: list = [[], [], [], [], []]
                for k in range(a, min(a + AT_ONCE, len(texts))):
                    text = texts[k].as_py() or ""
                    own = np.array([*(long_ids(listed, text) if added and len(text) > LONG else tokens.encode(text, allowed_special="all")), END], "<u4")
                    at = cuts(len(own), capacity)
                    for p, (x, y) in enumerate(zip(at, at[1:])):
                        for column, value in zip(out, (k, p, x, y - x, zlib.crc32(own[x:y].tobytes())), strict=True):
                            column.append(value)
                kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int64())
                yield pa.record_batch([ids.take(pa.array(out[0], pa.int64())), *[pa.array(c, t) for c, t in zip(out[1:], kinds, strict=True)]], names=[x.split()[0] for x in PIECES.split(", ")])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(rows, PIECES)


class Stock:
    """How many pieces are left of each length."""

    def __init__(self, counts: dict[int, int]):
        self.counts = {n: c for n, c in counts.items() if c}
        self.lengths = sorted(self.counts)

    def take(self, length: int, n: int) -> None:
        self.counts[length] -= n
        if not self.counts[length]:
            del self.counts[length]
            self.lengths.remove(length)

    def largest(self, limit: int) -> int:
        """The largest length of at most limit, or 0."""
        at = bisect_right(self.lengths, limit)
        return self.lengths[at - 1] if at else 0

    def smallest(self, n: int) -> list[int]:
        """The n smallest lengths, counting each piece."""
        out: list[int] = []
        for x in self.lengths:
            out += [x] * min(self.counts[x], n - len(out))
            if len(out) == n:
                break
        return out


def dominating(stock: Stock, piece: int, capacity: int) -> list[int] | None:
    """Companions of a piece (already taken from stock) such that no other set with the piece is better; None if unclear.

    A set dominates if each piece of any other feasible set fits in the place of one of its own.
    """
    room = capacity - piece
    best = stock.largest(room)
    if not best:
        return []
    if best == room:
        return [best]
    low = stock.smallest(3)
    if len(low) < 2 or low[0] + low[1] > room:
        return [best]  # one companion at most: the largest that fits
    if len(low) == 3 and sum(low) <= room:
        return None
    # Two companions at most: {best, second} dominates if no feasible pair has a larger lesser piece.
    stock.take(best, 1)
    second = stock.largest(min(room - best, best))
    stock.counts[best] = stock.counts.get(best, 0) + 1
    if stock.counts[best] == 1:
        insort(stock.lengths, best)
    lesser = 0
    for at in range(bisect_right(stock.lengths, room // 2) - 1, -1, -1):
        y = stock.lengths[at]
        mate = y if stock.counts[y] > 1 else stock.lengths[at + 1] if at + 1 < len(stock.lengths) else capacity
        if y + mate <= room:
            lesser = y
            break
    return [best, second] if second and second >= lesser else None


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> tuple[np.ndarray, int]:
    """Runs (length, rank_from, many, sequence_from, offset), sorted by length and rank, and the number of sequences."""
    groups: list[tuple[int, tuple]] = []  # how many alike sequences, and (length, many) of each
    stock = Stock(counts)
    changed = True
    while changed:
        changed = False
        for length in sorted(stock.counts, reverse=True):
            while length in stock.counts:
                stock.take(length, 1)
                mates = dominating(stock, length, capacity)
                stock.counts[length] = stock.counts.get(length, 0) + 1
                if stock.counts[length] == 1:
                    insort(stock.lengths, length)
                if mates is None:
                    break
                held: dict[int, int] = {}
                for x in (length, *mates):
                    held[x] = held.get(x, 0) + 1
                # The set stays dominant while its pieces last: what else there is only gets less.
                n = min(stock.counts[x] // k for x, k in held.items())
                for x, k in held.items():
                    stock.take(x, n * k)
                groups.append((n, tuple(held.items())))
                changed = True
    # What is left, best-fit: each time the fullest sequences that still have room.
    spaces: list[int] = []
    open_: dict[int, list] = {}

    def put(room: int, n: int, content: tuple) -> None:
        if room:
            if room not in open_:
                insort(spaces, room)
            open_.setdefault(room, []).append((n, content))
        else:
            groups.append((n, content))

    for length in sorted(stock.counts, reverse=True):
        left = stock.counts[length]
        while left:
            at = bisect_left(spaces, length)
            if at == len(spaces):
                many = capacity // length
                n, many = (left // many, many) if left >= many else (1, left)
                put(capacity - many * length, n, ((length, many),))
            else:
                room = spaces[at]
                have, content = open_[room].pop()
                if not open_[room]:
                    del open_[room]
                    spaces.pop(at)
                many = room // length
                n, many = (min(have, left // many), many) if left >= many else (1, left)
                if have > n:
                    put(room, have - n, content)
                put(room - many * length, n, (*content, (length, many)))
            left -= n * many
    groups += [g for several in open_.values() for g in several]
    runs, used, sequence = [], dict.fromkeys(counts, 0), 0
    for n, content in groups:
        offset = 0
        for length, many in content:
            runs.append((length, used[length], many, sequence, offset))
            used[length] += n * many
            offset += length * many
        sequence += n
    return np.array(sorted(runs), np.int64).reshape(-1, 5), sequence


def pack(docs: DataFrame, vocabulary: str | None = None, capacity: int = CAPACITY, added: dict[str, int] | None = None) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    added: tokens that stand for themselves wherever a text has them, by default those that the vocabulary lists.
    """
    scratch = Scratch(docs.sparkSession)
    pieces = scratch.write(tokenized(docs, vocabulary or public_tokenizers.path(VOCABULARY), capacity, added_tokens() if added is None else added))
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}  # capacity rows at most
    runs, _ = plan(counts, capacity)
    salts = -(-max(counts.values(), default=1) // GROUP)
    salted = pieces.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece", "start", "ids_crc32"), F.lit(salts)).cast("int"))
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    bases = salted.groupBy("length", "salt").agg(F.count("*").alias("n")).select("length", "salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    own = Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32")
    ranked = salted.withColumn("row", F.row_number().over(own)).join(bases, ["length", "salt"])
    ranked = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("base") + F.col("row") - 1).alias("rank"))

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = (runs[:, 0] << 48) + runs[:, 1]
        for batch in batches:
            length, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            run = runs[np.searchsorted(keys, (length << 48) + rank, side="right") - 1] if len(runs) else np.zeros((0, 5), np.int64)
            nth = rank - run[:, 1]
            columns = [batch.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")]
            yield pa.record_batch([*columns, pa.array(run[:, 3] + nth // run[:, 2]), pa.array(run[:, 4] + nth % run[:, 2] * length)], names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return ranked.mapInArrow(placed, f"{PIECES}, sequence_id long, offset long")
