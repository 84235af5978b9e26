"""Suffix-array dedup: remove bytes covered by a 100-byte string that starts earlier.

Every 100-byte string has an anchor: the 32-byte string in it with the least hash (the leftmost of equals). Equal strings have equal
anchors at equal places, so strings with different anchors are never compared. Successive starts with one anchor are a
run; its context is all bytes its strings cover. Equal contexts are merged before the shuffle: all but the first are wholly
covered. First contexts that share an anchor with others go on: their 100-byte suffixes are sorted, by multikey quicksort to a
shallow depth, then by blind tries for groups with a longer common prefix. Equal suffixes are adjacent then, and all but the
earliest start a covered string.

Documents without an id or a text, or under 100 bytes, keep everything and cover nothing. Rows that repeat an id and text are one
document and get equal results; ids are otherwise taken to be unique. Only id and text are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, maybe_broadcast, stored

LENGTH = 100
ANCHOR = 32
SPAN = LENGTH - ANCHOR + 1
SHALLOW = 24
#: Bytes worked on at once; a longer document goes by overlapping parts.
CHUNK, PART = 1 << 20, 1 << 23
PLACES = np.uint64((1 << 24) - 1)
#: Runs that a task merges at once.
FLUSH = 2_000_000
#: An anchor with more distinct contexts than this in one task is dealt by string, not as a whole.
MANY = 256
#: Suffixes sorted at once.
BATCH = 300_000

_M = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB)]
_S = [np.uint64(x) for x in (31, 29, 32)]
_BYTES = np.random.Generator(np.random.Philox(key=7)).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _S[0])) * _M[1]
    return (x ^ (x >> _S[1])) * _M[2]


def _hashes(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of all 32-byte and all 64-byte strings, by doubling."""
    h, size, at32 = _BYTES[data], 1, None
    while size < 64:
        h = (h[:-size] ^ (h[:-size] >> _S[1])) * _M[0] + h[size:]
        size *= 2
        if size == ANCHOR:
            at32 = h
    return at32, h


def _least(v: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every window of ``width``."""
    n = len(v) - width + 1
    pad = -len(v) % width
    blocks = np.concatenate([v, np.full(pad, np.iinfo(np.uint64).max, np.uint64)]).reshape(-1, width)
    upto = np.minimum.accumulate(blocks, axis=1).ravel()
    since = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(since[:n], upto[width - 1 : width - 1 + n])


def runs(data: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of texts that stand in ``data``: the text's number, first and last start, anchor's hash and context's hash of each run."""
    none = np.empty(0, np.int64)
    if len(data) < LENGTH:
        return none, none, none, none, none
    change = np.zeros(len(data) + 1, np.int64)
    long = ends - begins >= LENGTH
    np.add.at(change, begins[long], 1)
    np.add.at(change, ends[long] - LENGTH + 1, -1)
    starts = np.flatnonzero(np.cumsum(change)[: len(data) - LENGTH + 1] > 0)
    if not len(starts):
        return none, none, none, none, none
    h32, h64 = _hashes(data)
    ranked = _mix(h32)
    v = (ranked & ~PLACES) | np.arange(len(ranked), dtype=np.uint64)
    anchor = (_least(v, SPAN)[starts] & PLACES).astype(np.int64)
    new = np.flatnonzero(np.r_[True, (anchor[1:] != anchor[:-1]) | (starts[1:] != starts[:-1] + 1)])
    lo, hi, at = starts[new], starts[np.r_[new[1:] - 1, len(starts) - 1]], anchor[new]
    size = hi - lo + LENGTH
    c = _mix(h64[lo] ^ _mix(h64[lo + (size - 64) // 2] ^ _mix(h64[lo + size - 64] ^ (size * 256 + at - lo).astype(np.uint64))))
    return np.searchsorted(begins, lo, side="right") - 1, lo, hi, ranked[at].view(np.int64), c.view(np.int64)


RUNS = "h long, c long, doc_id long, span long, kind byte"
#: Kinds of rows: of a run, of a run that an earlier one covers, of a run whose anchor has many contexts, and a notice of that.
RUN, COVERED, MANY_RUN, NOTICE = 0, 1, 2, 3


def _merge(doc: np.ndarray, lo: np.ndarray, hi: np.ndarray, h: np.ndarray, c: np.ndarray) -> Iterator[pa.RecordBatch]:
    span = (lo << 8) | (hi - lo)
    order = np.lexsort((span, doc, c, h))
    h, c, doc, span = h[order], c[order], doc[order], span[order]
    first = np.r_[True, (h[1:] != h[:-1]) | (c[1:] != c[:-1])]
    leader = np.flatnonzero(first)[np.cumsum(first) - 1]
    again = ~first & (doc == doc[leader]) & (span == span[leader])
    kind = np.where(first, RUN, COVERED).astype(np.int8)
    fh = h[first]
    starts = np.flatnonzero(np.r_[True, fh[1:] != fh[:-1]])
    sizes = np.diff(np.r_[starts, len(fh)])
    many = fh[starts[sizes > MANY]]
    if len(many):
        kind[first & np.isin(h, many)] = MANY_RUN
    keep = ~again
    zero = np.zeros(len(many), np.int64)
    columns = [np.concatenate(x) for x in ((h[keep], many), (c[keep], zero), (doc[keep], zero), (span[keep], zero), (kind[keep], np.full(len(many), NOTICE, np.int8)))]
    for at in range(0, len(columns[0]), 100_000):
        yield pa.RecordBatch.from_arrays([pa.array(x[at : at + 100_000]) for x in columns], names=[x.split()[0] for x in RUNS.split(", ")])


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    found: list[tuple[np.ndarray, ...]] = []
    held = 0

    def work(ids: list[int], texts: list[bytes], base: int = 0) -> None:
        nonlocal held
        sizes = np.array([len(t) for t in texts], np.int64)
        ends = np.cumsum(sizes)
        which, lo, hi, h, c = runs(np.frombuffer(b"".join(texts), np.uint8), ends - sizes, ends)
        if len(which):
            shift = (ends - sizes)[which] - base
            found.append((np.array(ids, np.int64)[which], lo - shift, hi - shift, h, c))
            held += len(which)

    ids: list[int] = []
    texts: list[bytes] = []
    size = 0
    for b in batches:
        for doc, text in zip(b[0].to_pylist(), b[1].to_pylist(), strict=True):
            if doc is None or not text:
                continue
            data = text.encode("utf-8", "surrogatepass")
            if len(data) > PART:
                for at in range(0, len(data) - LENGTH + 1, PART - LENGTH):
                    work([doc], [data[at : at + PART - 1]], at)
                continue
            if size + len(data) > CHUNK and ids:
                work(ids, texts)
                ids, texts, size = [], [], 0
            ids.append(doc)
            texts.append(data)
            size += len(data)
            if held > FLUSH:
                yield from _merge(*map(np.concatenate, zip(*found, strict=True)))
                found, held = [], 0
    if ids:
        work(ids, texts)
    if found:
        yield from _merge(*map(np.concatenate, zip(*found, strict=True)))


MARKS = "h long, doc_id long, span long, open boolean, many boolean"


def _resolve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of a partition that holds all runs of its anchors: covered runs, and runs that must be compared further (open)."""
    held = [b for b in batches if b.num_rows]
    if not held:
        return
    t = pa.Table.from_batches(held)
    kind = t["kind"].to_numpy()
    h, c, doc, span = (t[x].to_numpy() for x in ("h", "c", "doc_id", "span"))
    noticed = np.unique(h[kind == NOTICE])
    done = kind == COVERED
    rest = np.flatnonzero((kind == RUN) | (kind == MANY_RUN))
    rest = rest[np.lexsort((span[rest], doc[rest], c[rest], h[rest]))]
    rh, rc, rd, rs = h[rest], c[rest], doc[rest], span[rest]
    first = np.r_[True, (rh[1:] != rh[:-1]) | (rc[1:] != rc[:-1])][: len(rest)]
    leader = np.flatnonzero(first)[np.cumsum(first) - 1]
    covered = ~first & ((rd != rd[leader]) | (rs != rs[leader]))
    starts = np.flatnonzero(np.r_[True, rh[1:] != rh[:-1]][: len(rest)])
    sizes = np.diff(np.r_[starts, len(rest)])
    contexts = np.add.reduceat(first.astype(np.int64), starts) if len(starts) else sizes
    several, hot = np.repeat(contexts > 1, sizes), np.repeat(contexts > MANY, sizes)
    many = (kind[rest] == MANY_RUN) | np.isin(rh, noticed)
    opened = first & (several | many)
    for rows, is_open in ((np.flatnonzero(done), False), (rest[covered], False), (rest[opened], True)):
        flag = (many | hot)[opened] if is_open else np.zeros(len(rows), bool)
        yield pa.RecordBatch.from_arrays([pa.array(h[rows]), pa.array(doc[rows]), pa.array(span[rows]), pa.array(np.full(len(rows), is_open)), pa.array(flag)], names=[x.split()[0] for x in MARKS.split(", ")])


CONTEXTS = "deal long, doc_id long, lo long, hi long, bytes binary, covered boolean"


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bytes of open runs; of anchors with many contexts string by string, dealt by how these begin, equal ones merged."""
    names = [x.split()[0] for x in CONTEXTS.split(", ")]
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.bool_())
    first: dict[bytes, list] = {}
    out: list[tuple] = []

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    def single(h: int, doc: int, s: int, said: bytes) -> tuple:
        deal = int.from_bytes(hashlib.blake2b(said[:SHALLOW], digest_size=8, salt=h.to_bytes(8, "little", signed=True)).digest(), "little", signed=True)
        return deal, doc, s, s, said, False

    for b in batches:
        for doc, text, opened in zip(*(b[x].to_pylist() for x in ("doc_id", "text", "opened")), strict=True):
            data = text.encode("utf-8", "surrogatepass")
            for o in opened:
                h, lo = o["h"], o["span"] >> 8
                hi = lo + (o["span"] & 255)
                if hi + LENGTH > len(data):  # another row's text under the same id
                    continue
                if not o["many"]:
                    out.append((h, doc, lo, hi, data[lo : hi + LENGTH], False))
                    continue
                for s in range(lo, hi + 1):
                    said = data[s : s + LENGTH]
                    known = first.get(said)
                    if known is None:
                        first[said] = [h, doc, s]
                    elif (doc, s) > (known[1], known[2]):
                        out.append((doc * 31 + s & 0x7FFFFFFF, doc, s, s, None, True))
                    elif (doc, s) < (known[1], known[2]):
                        out.append((doc * 31 + s & 0x7FFFFFFF, known[1], known[2], known[2], None, True))
                        first[said] = [h, doc, s]
            if len(out) > 20_000:
                yield batch(out)
                out = []
            if len(first) > 200_000:
                yield batch([single(h, d, s, said) for said, (h, d, s) in first.items()])
                first = {}
    out += [single(h, d, s, said) for said, (h, d, s) in first.items()]
    if out:
        yield batch(out)


def multikey_quicksort(words: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order by group, then by the columns of ``words``; and, in that order, the number of each row's set of equal rows.

    Ternary partition around a pivot, for all segments at once: what is less or greater is partitioned again by the same
    column, what is equal goes on to the next.
    """
    order = np.argsort(group, kind="stable")
    segment = np.cumsum(np.r_[False, group[order][1:] != group[order][:-1]]) if len(order) else order
    for column in range(words.shape[1]):
        settled = np.zeros(len(order), bool)
        while True:
            sizes = np.bincount(segment, minlength=1)
            active = np.flatnonzero(~settled & (sizes[segment] > 1))
            if not len(active):
                break
            seg, value = segment[active], words[order[active], column]
            begin = np.r_[True, seg[1:] != seg[:-1]]
            heads = np.flatnonzero(begin)
            counts = np.diff(np.r_[heads, len(seg)])
            pivot = np.repeat(value[heads + counts // 2], counts)
            side = (value > pivot).astype(np.int64) - (value < pivot) + 1
            by = np.argsort(np.repeat(np.arange(len(heads)), counts) * 3 + side, kind="stable")
            order[active], side = order[active][by], side[by]
            settled[active] = side == 1
            cut = np.r_[False, side[1:] != side[:-1]] & ~begin
            bump = np.zeros(len(order), np.int64)
            bump[active[cut]] = 1
            old = np.r_[False, segment[1:] != segment[:-1]]
            segment = np.cumsum(old | (bump > 0))
    return order, segment


class BlindTrie:
    """Sorts strings of one length by inserting them; inner nodes know only where strings differ and the bytes there."""

    __slots__ = ("root",)

    def __init__(self, text: bytes, item: int):
        self.root: list = [len(text), text, [item]]

    def insert(self, text: bytes, item: int) -> None:
        node = self.root
        while node[0] < len(text):  # blind descent; a missing branch may be any
            node = node[1].get(text[node[0]]) or next(iter(node[1].values()))
        if node[1] == text:
            node[2].append(item)
            return
        differ = int.from_bytes(node[1], "big") ^ int.from_bytes(text, "big")
        common = len(text) - (differ.bit_length() + 7) // 8
        at, above, other = self.root, None, node[1]
        while at[0] < common:
            above, at = at, at[1][text[at[0]]]
        leaf = [len(text), text, [item]]
        if at[0] == common:
            at[1][text[common]] = leaf
            return
        split = [common, {other[common]: at, text[common]: leaf}]
        if above is None:
            self.root = split
        else:
            above[1][text[above[0]]] = split

    def leaves(self) -> Iterator[list[int]]:
        """Items by string, in the strings' order."""
        stack = [self.root]
        while stack:
            node = stack.pop()
            if isinstance(node[1], dict):
                stack += [node[1][k] for k in sorted(node[1], reverse=True)]
            else:
                yield node[2]


def sort_suffixes(data: bytes, starts: np.ndarray, group: np.ndarray) -> Iterator[np.ndarray]:
    """Sets of two or more suffixes (their places in ``starts``) with one group and 100 equal bytes, in suffix order."""
    raw = np.frombuffer(data, np.uint8)
    words = raw[starts[:, None] + np.arange(SHALLOW)].view(">u8").astype(np.uint64)
    order, segment = multikey_quicksort(words, group)
    heads = np.flatnonzero(np.r_[True, segment[1:] != segment[:-1]])
    for a, b in zip(heads, np.r_[heads[1:], len(order)], strict=True):
        if b - a < 2:
            continue
        items = order[a:b].tolist()
        trie = BlindTrie(data[starts[items[0]] : starts[items[0]] + LENGTH], items[0])
        for i in items[1:]:
            s = starts[i]
            trie.insert(data[s : s + LENGTH], i)
        for leaf in trie.leaves():
            if len(leaf) > 1:
                yield np.array(leaf)


SPANS = "doc_id long, span long"


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Covered starts of a partition that holds all contexts of its deals, as spans of starts."""
    held = [b for b in batches if b.num_rows]
    if not held:
        return
    t = pa.Table.from_batches(held).sort_by("deal")

    def spans(doc: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(doc), pa.array((lo << 8) | (hi - lo))], names=["doc_id", "span"])

    covered = t.filter(t["covered"])
    if covered.num_rows:
        yield spans(*(covered[x].to_numpy() for x in ("doc_id", "lo", "hi")))
    t = t.filter(pa.compute.invert(t["covered"]))
    deal, doc, lo, hi = (t[x].to_numpy() for x in ("deal", "doc_id", "lo", "hi"))
    if not len(deal):
        return
    ends = np.flatnonzero(np.r_[deal[1:] != deal[:-1], True]) + 1
    total = np.cumsum(hi - lo + 1)
    at = 0
    while at < len(deal):
        # As many whole deals as make about BATCH suffixes.
        before = total[at - 1] if at else 0
        k = np.searchsorted(total[ends - 1], before + BATCH, side="right")
        stop = int(ends[min(max(k - 1, np.searchsorted(ends, at, side="right")), len(ends) - 1)])
        n = hi[at:stop] - lo[at:stop] + 1
        texts = t["bytes"].slice(at, stop - at).to_pylist()
        sizes = np.array([len(x) for x in texts])
        base = np.cumsum(sizes) - sizes
        row = np.repeat(np.arange(stop - at), n)
        step = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
        starts = base[row] + step
        d, s = doc[at:stop][row], lo[at:stop][row] + step
        again = np.zeros(len(row), bool)
        for same in sort_suffixes(b"".join(texts), starts, deal[at:stop][row]):
            i = same[np.lexsort((s[same], d[same]))]
            again[i] = (d[i] != d[i[0]]) | (s[i] != s[i[0]])
        hit = np.flatnonzero(again)
        if len(hit):
            new = np.r_[True, (hit[1:] != hit[:-1] + 1) | (row[hit[1:]] != row[hit[:-1]])]
            heads = np.flatnonzero(new)
            tails = np.r_[heads[1:] - 1, len(hit) - 1]
            yield spans(d[hit[heads]], s[hit[heads]], s[hit[tails]])
        at = stop


def covered_spans(docs: DataFrame) -> DataFrame:
    """doc_id, span: starts of covered strings; the first in the upper bits, how many follow in the lower 8."""
    bound_batches(docs.sparkSession)
    docs = docs.select("doc_id", "text")
    found = docs.mapInArrow(_runs, RUNS)
    deal = F.when(F.col("kind").isin(RUN, NOTICE), F.col("h")).when(F.col("kind") == MANY_RUN, F.xxhash64("h", "c")).otherwise(F.xxhash64("doc_id", "span"))
    marks = stored(found.withColumn("_deal", deal).repartition("_deal").drop("_deal").mapInArrow(_resolve, MARKS))
    opened = marks.where("open").groupBy("doc_id").agg(F.collect_list(F.struct("h", "span", "many")).alias("opened"))
    opened = stored(opened)
    texts = docs.where("text IS NOT NULL").join(maybe_broadcast(opened, marks.where("open").count(), 2_000_000), "doc_id")
    contexts = texts.select("doc_id", "text", "opened").mapInArrow(_contexts, CONTEXTS)
    compared = contexts.repartition("deal").mapInArrow(_compare, SPANS)
    return marks.where("NOT open").select("doc_id", "span").unionByName(compared)


RESULT = "n_bytes long, n_removed long, n_spans long, kept binary, removed array<struct<begin:long,end:long>>"


def _remove(batches: Iterator[pa.RecordBatch], as_text: bool) -> Iterator[pa.RecordBatch]:
    """The columns before the text and spans, then RESULT."""
    names = [x.split()[0] for x in RESULT.split(", ")]
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string() if as_text else pa.binary(), pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())])))
    for b in batches:
        carried = b.schema.names[:-2]
        rows, held, at_row = [], 0, 0

        def flush(n: int, b=b, carried=carried) -> pa.RecordBatch:
            part = b.slice(n - len(rows), len(rows))
            return pa.RecordBatch.from_arrays([*part.columns[:-2], *(pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True))], names=[*carried, *names])

        for text, spans in zip(b[-2].to_pylist(), b[-1].to_pylist(), strict=True):
            at_row += 1
            data = (text or "").encode("utf-8", "surrogatepass")
            removed: list[list[int]] = []
            for span in sorted(spans or ()):
                begin = span >> 8
                end = min(begin + (span & 255) + LENGTH, len(data))
                if begin >= end:
                    continue
                if removed and begin <= removed[-1][1]:
                    removed[-1][1] = max(end, removed[-1][1])
                else:
                    removed.append([begin, end])
            at, kept = 0, []
            for begin, end in removed:
                kept.append(data[at:begin])
                at = end
            left = b"".join([*kept, data[at:]]) if removed else data
            rows.append((len(data), len(data) - len(left), len(removed), left.decode(errors="ignore") if as_text else left, [{"begin": x, "end": y} for x, y in removed]))
            held += len(data)
            if held > 8_000_000:
                yield flush(at_row)
                rows, held = [], 0
        if rows:
            yield flush(at_row)


def remove_repeats(docs: DataFrame, carry: tuple[str, ...] = (), as_text: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept (bytes), removed (byte ranges) of every row; before these the columns in ``carry``.

    ``as_text``: kept is a string, without the bytes that a cut inside a character leaves.
    """
    spans = covered_spans(docs).groupBy("doc_id").agg(F.collect_set("span").alias("_spans"))
    rows = docs.select("doc_id", *carry, F.col("text").alias("_text")).join(spans, "doc_id", "left").select("doc_id", *carry, "_text", "_spans")
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-2])
    result = RESULT.replace("kept binary", "kept string") if as_text else RESULT
    return rows.mapInArrow(lambda batches: _remove(batches, as_text), f"{fields}, {result}")


def op1_suffix_array_dedup(spark, sf_dir):
    from .common import table

    found = remove_repeats(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
