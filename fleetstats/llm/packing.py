"""Best-fit packing through the configuration linear program.

Texts become token ids with an end mark; only longer ones than a sequence are cut, the first piece takes the remainder. The
histogram of piece lengths (at most a sequence's length of numbers) goes to the driver. There multiplicative weights solve
the configuration linear program: weights are the prices of lengths, a knapsack dynamic program finds the configuration worth
most at these prices for each length, and prices of what these cover fall, until all lengths are covered. The solution is rounded down, and what is
left packed by the same pricing, one whole configuration after another. Pieces find their place by rank within their
length, so no task sees them all.

Null texts are empty and give the end mark alone. Repeated rows are packed as often as they occur.
"""

from __future__ import annotations

import base64
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import maybe_broadcast, stored

LENGTH = 1024
END_ID = 2
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
SPECIAL = "<|endoftext|>"


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


@cache
def _encoder(path: str):
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={SPECIAL: len(ranks)})


def token_ids(text: str, path: str) -> np.ndarray:
    """Little-endian unsigned 32-bit ids of ``text``, where the special token's string stands for its id, and the end mark."""
    e = _encoder(path)
    ids = e.encode_to_numpy(text, allowed_special="all") if text else np.empty(0, np.uint32)
    return np.append(ids, END_ID).astype("<u4")


def cut(docs: DataFrame, vocabulary: str | None = None, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every piece. ``vocabulary``: a rank file, by default the installed one."""

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path = vocabulary or default_vocabulary()
        for b in batches:
            out: list[tuple] = []
            for doc, text in zip(b[0].to_pylist(), b[1].to_pylist(), strict=True):
                ids = token_ids(text or "", path)
                at, k = 0, 0
                while at < len(ids):
                    end = at + ((len(ids) - 1) % length + 1 if k == 0 else length)
                    out.append((doc, k, at, end - at, zlib.crc32(ids[at:end].tobytes())))
                    at, k = end, k + 1
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out) if out else [[]] * 5, kinds, strict=True)], names=[x.split()[0] for x in PIECES.split(", ")])

    return docs.select(id_col, text_col).mapInArrow(pieces, PIECES)


class Pricing:
    """Knapsack dynamic program over ``capacity`` for items of the given sizes, each as often as it fits."""

    def __init__(self, sizes: np.ndarray, capacity: int):
        self.sizes, self.capacity = sizes, capacity
        self.upto = np.searchsorted(sizes, np.arange(capacity + 1), side="right")

    def configurations(self, prices: np.ndarray, items: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each of ``items`` the configuration worth most among those with it, as a row of indices (-1: none), and its worth."""
        sizes, capacity = self.sizes, self.capacity
        worth, pick, room = np.zeros(capacity + 1), np.full(capacity + 1, -1, np.int16), np.zeros(capacity + 1, np.int64)
        for w in range(int(sizes[0]), capacity + 1):
            n = self.upto[w]
            gain = prices[:n] + worth[w - sizes[:n]]
            k = int(gain.argmax())
            if gain[k] > worth[w - 1]:
                worth[w], pick[w], room[w] = gain[k], k, w - sizes[k]
            else:
                worth[w], pick[w], room[w] = worth[w - 1], pick[w - 1], room[w - 1]
        columns, w = [items.astype(np.int16)], capacity - sizes[items]
        while (pick[w] >= 0).any():
            columns.append(pick[w])
            w = np.where(pick[w] >= 0, room[w], 0)
        return np.sort(np.stack(columns, axis=1), axis=1), prices[items] + worth[capacity - sizes[items]]


#: Parts of its number by which a round covers a length at most, to begin with; how far under the best a configuration's worth may be; how steeply
#: prices fall; rounds after which the first doubles; part of all tokens whose cover is left to rounding.
STEP, SLACK, STEEP, GROWTH, REST = 0.05, 0.05, 5.0, 40, 0.003
#: In the rounding prices rise a little faster than lengths, as long pieces are harder to place.
PRICE_POWER = 1.1


def fractional(sizes: np.ndarray, need: np.ndarray, capacity: int) -> dict[bytes, float]:
    """How often each configuration (its indices, as bytes) is used; together they cover all but REST of the tokens.

    Prices fall exponentially with how far a length is covered, and a covered length has no price. A round takes, for each length, the configuration worth
    most with it, if worth nearly the most of all; each as often as no length of it gains over STEP of its number, all that the round
    takes together. The length with the greatest load gains a whole step, so there are no more rounds than lengths times steps, on any histogram.
    """
    covered, used, tokens = np.zeros(len(sizes)), {}, float(need @ sizes)
    for turn in range(len(sizes) * (int(1 / STEP) + 1)):
        open_ = np.flatnonzero(covered < 1)
        gap, n = 1 - covered[open_], need[open_]
        if not len(open_) or gap * n @ sizes[open_] < REST * tokens:
            return used
        prices = sizes[open_] / capacity * np.exp(STEEP * (gap - gap.max()))
        rows, values = Pricing(sizes[open_], capacity).configurations(prices, np.arange(len(open_)))
        best = np.flatnonzero(values >= (1 - SLACK) * values.max())
        rows = rows[best]
        counts = np.zeros((len(rows), len(open_) + 1), np.float32)
        np.add.at(counts, (np.arange(len(rows))[:, None], rows), 1)  # the last column takes what is none
        counts = counts[:, :-1]
        amount = (gap * n)[best] / counts[np.arange(len(best)), best]
        load = amount @ counts / n
        room = np.minimum(gap, STEP * (1 + turn / GROWTH)) / np.maximum(load, 1e-300)
        amount = amount * np.where(counts > 0, np.minimum(1, room), 1).min(axis=1)
        covered[open_] += amount @ counts / n
        covered[covered > 1 - 1e-9] = 1
        for row, x in zip(rows, amount.tolist(), strict=True):
            key = open_[row[row >= 0]].astype(np.int16).tobytes()
            used[key] = used.get(key, 0.0) + x
    raise AssertionError("a round covered nothing")


def solve(histogram: dict[int, int], capacity: int = LENGTH) -> list[tuple[dict[int, int], int]]:
    """Configurations {length: how many} with how often each is used; together they hold the histogram exactly.

    The fractional solution is rounded down, and what is left priced and rounded piece by piece. Where that takes more sequences than any packing
    must, all is priced piece by piece as well, and best fit is tried; the fewest sequences count, of equal ones the first of these three.
    """
    histogram = {k: v for k, v in histogram.items() if v > 0}
    if not histogram:
        return []
    sizes = np.array(sorted(histogram), dtype=np.int64)
    need = np.array([histogram[int(s)] for s in sizes], dtype=np.int64)
    least = max(-(-int(need @ sizes) // capacity), int(need[2 * sizes > capacity].sum()))
    ways = (lambda: rounded(sizes, need, capacity, fractional(sizes, need.astype(np.float64), capacity)), lambda: priced(sizes, need, capacity), lambda: best_fit(sizes, need, capacity))
    found = None
    for way in ways:
        made = way()
        if found is None or total(made) < total(found):
            found = made
        if total(found) == least:
            break
    return found


def total(configurations: list[tuple[dict[int, int], int]]) -> int:
    return sum(times for _, times in configurations)


def rounded(sizes: np.ndarray, need: np.ndarray, capacity: int, used: dict[bytes, float]) -> list[tuple[dict[int, int], int]]:
    """The solution's (nearly) full configurations rounded down, the most used first, then ``priced`` for what is left."""
    left, found = need.copy(), []
    for key, x in sorted(used.items(), key=lambda item: (-item[1], item[0])):
        index, count = np.unique(np.frombuffer(key, np.int16), return_counts=True)
        times = int(min(int(x), (left[index] // count).min()))
        if times > 0 and sizes[index] @ count >= capacity - capacity // 256:
            left[index] -= times * count
            found.append((dict(zip(sizes[index].tolist(), count.tolist(), strict=True)), times))
    return found + priced(sizes, left, capacity)


def priced(sizes: np.ndarray, left: np.ndarray, capacity: int) -> list[tuple[dict[int, int], int]]:
    """What is ``left``: each time the configuration worth most of those with the longest piece left, of pieces that are there, as often as they last."""
    left, found, prices = left.copy(), [], (sizes / capacity) ** PRICE_POWER
    for k in range(len(sizes) - 1, -1, -1):
        while left[k]:
            room, steps = capacity - int(sizes[k]), []
            worth = np.zeros(room + 1)
            # A length that is there n times is tried as 1, 2, 4... of it and what remains of n.
            for i in np.flatnonzero((left[: k + 1] > 0) & (sizes[: k + 1] <= room)).tolist():
                n, size, part = min(int(left[i]) - (i == k), room // int(sizes[i])), int(sizes[i]), 1
                while n > 0:
                    part = min(part, n)
                    gain = worth[: room + 1 - part * size] + part * prices[i]
                    better = gain > worth[part * size :]
                    np.maximum(gain, worth[part * size :], out=worth[part * size :])
                    steps.append((i, part, part * size, better))
                    n, part = n - part, part * 2
            count = {k: 1}
            for i, part, size, better in reversed(steps):
                if room >= size and better[room - size]:
                    count[i] = count.get(i, 0) + part
                    room -= size
            times = min(int(left[i]) // n for i, n in count.items())
            for i, n in count.items():
                left[i] -= times * n
            found.append(({int(sizes[i]): n for i, n in count.items()}, times))
    return found


def best_fit(sizes: np.ndarray, left: np.ndarray, capacity: int) -> list[tuple[dict[int, int], int]]:
    """What is ``left`` by best fit, the longest first; sequences of equal content go together."""
    rooms: dict[int, dict[tuple[int, ...], int]] = {}

    def put(room: int, content: tuple[int, ...], n: int) -> None:
        own = rooms.setdefault(room, {})
        own[content] = own.get(content, 0) + n

    for k in reversed(np.flatnonzero(left).tolist()):
        size, n = int(sizes[k]), int(left[k])
        while n:
            room = min((r for r in rooms if r >= size), default=None)
            if room is None:
                fit = capacity // size
                if n >= fit:
                    put(capacity - fit * size, (k,) * fit, n // fit)
                if n % fit:
                    put(capacity - n % fit * size, (k,) * (n % fit), 1)
                break
            content, there = rooms[room].popitem()
            if not rooms[room]:
                del rooms[room]
            more = min(room // size, n)
            times = min(there, n // more)
            if there > times:
                put(room, content, there - times)
            put(room - more * size, (*content, *(k,) * more), times)
            n -= times * more
    out = []
    for own in rooms.values():
        for content, times in own.items():
            index, count = np.unique(content, return_counts=True)
            out.append((dict(zip(sizes[index].tolist(), count.tolist(), strict=True)), times))
    return out


def slots(configurations: list[tuple[dict[int, int], int]]) -> list[tuple[int, int, int, int, int, int]]:
    """(length, first rank, last rank, first sequence, how many in a sequence, offset): where ranks of a length go."""
    out, at, sequence = [], {}, 0
    for a, times in configurations:
        offset = 0
        for length, n in sorted(a.items(), reverse=True):
            first = at.get(length, 0)
            out.append((length, first, first + n * times - 1, sequence, n, offset))
            at[length] = first + n * times
            offset += n * length
        sequence += times
    return out


def pack(pieces: DataFrame, length: int = LENGTH) -> DataFrame:
    """``pieces`` (from ``cut``) with ``sequence_id`` and ``offset``. Pieces as long as a sequence have one of their own."""
    pieces = stored(pieces)
    spark = pieces.sparkSession
    full = pieces.where(F.col("length") == length).withColumn("sequence_id", -1 - F.monotonically_increasing_id()).withColumn("offset", F.lit(0).cast("long"))
    short = pieces.where(F.col("length") < length)
    histogram = {r["length"]: r["count"] for r in short.groupBy("length").count().collect()}
    # Ranks within a length, by groups of about the root of all rows.
    group = max(64, int(sum(histogram.values()) ** 0.5))
    classes = spark.createDataFrame([(k, -(-n // group)) for k, n in histogram.items()], "length long, _groups long")
    table = np.array(slots(solve(histogram, length)), dtype=np.int64).reshape(-1, 6)
    table = table[np.lexsort((table[:, 1], table[:, 0]))]
    # A row for each length of each configuration; there are no more of these than rounds of the solver give, whatever the input.
    places = spark.sparkContext.broadcast(table)
    ranked = short.join(F.broadcast(classes), "length").withColumn("_salt", F.pmod(F.xxhash64("doc_id", "piece", "start", "ids_crc32"), "_groups"))
    ranked = ranked.withColumn("_rank", F.row_number().over(Window.partitionBy("length", "_salt").orderBy("doc_id", "piece", "start", "ids_crc32")))
    sizes = short.join(F.broadcast(classes), "length").groupBy("length", F.pmod(F.xxhash64("doc_id", "piece", "start", "ids_crc32"), "_groups").alias("_salt")).count()
    before = F.sum("count").over(Window.partitionBy("length").orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1))
    starts = stored(sizes.select("length", "_salt", F.coalesce(before, F.lit(0)).alias("_before")))
    ranked = ranked.join(maybe_broadcast(starts), ["length", "_salt"]).withColumn("_rank", F.col("_rank") - 1 + F.col("_before"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size, first, _, sequence, n, offset = places.value.T
        keys = (size << 48) | first
        for b in batches:
            own, rank = b["length"].to_numpy(), b["_rank"].to_numpy()
            at = np.searchsorted(keys, (own << 48) | rank, side="right") - 1
            within = rank - first[at]
            found = (pa.array(sequence[at] + within // n[at]), pa.array(offset[at] + within % n[at] * own))
            yield pa.RecordBatch.from_arrays([*b.select(columns[:5]).columns, *found], names=columns)

    columns = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    placed = ranked.select(*columns[:5], F.col("_rank").cast("long")).mapInArrow(place, f"{PIECES}, sequence_id long, offset long")
    return full.select(columns).unionByName(placed)


def op7_best_fit_packing(spark, sf_dir):
    from .common import table

    return pack(cut(table(spark, sf_dir, "documents")))
