"""Substring dedup by paragraph MinHash banding.

A passage may stand anywhere in a text, so paragraphs are laid by content, at two sizes. Long ones, of LONG words or more, lie beside
each other, from a pair of words whose hash is the least of all within APART words to the first such pair (or the text's end)
that is LONG words on; what is left under LONG words at a text's end is part of its last one, and texts of fewer words are one
paragraph. Short ones have SPAN words and begin wherever a pair of words has the least hash of some NEAR consecutive pairs. Any run of SPAN + NEAR - 1 =
38 words that two texts share has such a beginning in its first NEAR words, so it holds a whole short paragraph in common, and those in
it cover all but its first and last few words.

Equal paragraphs are one node. Long nodes' 5-word shingles give a MinHash signature in bands; with 7 bands of 3, pairs of J = 0.8 meet
with probability 0.993, of 0.4 with 0.37. Colliding ones are verified by exact Jaccard (0.8 or more) and clustered by components; of each
cluster the first paragraph (smallest doc_id, then place) stays and the others go. In short ones a single changed word takes J under
0.8 unless it is among the outer two at either end, so their only band is the whole paragraph.

Null texts are empty; texts without an id keep everything. Rows that repeat an id and text are one document and get equal results; equal
short paragraphs of a text that overlap count once. Only id and text are read.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bound_batches, maybe_broadcast, stored
from .components import link_lists
from .jaccard_join import LISTS, shared_lists, split_lists
from .shingles import WORDS, fold, hashed_words, least_of_windows, mix, powers

SPAN, NEAR = 26, 13
LONG, APART = 60, 24
BANDS, ROWS = 7, 3
PERCENT = 80
#: A band's list with more nodes than this in one task is dealt by node.
MANY = 256
#: Bytes of texts laid out at once, and rows that a task merges at once.
CHUNK, FLUSH = 1 << 20, 1_000_000
#: Maps of 64 bits each of the shingles; every bit in which two differ is a shingle that only one of them has.
MAPS = tuple(f"u{i}" for i in range(8))
BOUND = f"{100 + PERCENT} * least(na, nb) >= {PERCENT} * (na + nb) AND {100 + PERCENT} * ({' + '.join(f'bit_count({x}a ^ {x}b)' for x in MAPS)}) <= {100 - PERCENT} * (na + nb)"

_A = np.random.Generator(np.random.Philox(key=11)).integers(1, 1 << 62, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_R, _M = np.uint64(31), np.uint64(0xBF58476D1CE4E5B9)
_OTHER = np.uint64(0xD6E8FEB86659FD93)
_PLACES = np.uint64((1 << 24) - 1)
_TOP = np.uint64(np.iinfo(np.uint64).max)


def _run_hashes(h: np.ndarray, span: int) -> np.ndarray:
    """Of every run of ``span`` words: from those of its first and of its last words, a power of two, by doubling."""
    size = 1
    while 2 * size <= span:
        h = (h[:-size] ^ (h[:-size] >> _R)) * _M + h[size:]
        size *= 2
    last = span - size
    return mix(mix(h[: len(h) - last]) + h[last:])


def short_beginnings(h: np.ndarray, crossing: np.ndarray) -> np.ndarray:
    """Where the pair of words is the least of some NEAR consecutive ones of its text, the first of equals.

    ``crossing``: whether a pair's words stand in different texts.
    """
    found = []
    for at in range(0, max(0, len(h) - NEAR), 1 << 22):
        own = slice(at, at + (1 << 22) + NEAR)
        v = (fold([h[own][:-1], h[own][1:]]) & ~_PLACES) | np.arange(len(h[own]) - 1, dtype=np.uint64)
        v = np.where(crossing[own][: len(v)], _TOP, v)
        least = least_of_windows(v, NEAR)
        crossed = np.cumsum(np.r_[0, crossing[own][: len(v)]])
        whole = crossed[NEAR:] == crossed[:-NEAR]
        found.append((least[whole] & _PLACES).astype(np.int64) + at)
    # These never go back from one window to the next.
    chosen = np.concatenate(found) if found else np.empty(0, np.int64)
    return chosen[np.r_[True, chosen[1:] != chosen[:-1]][: len(chosen)]]


def long_paragraphs(h: np.ndarray, crossing: np.ndarray, firsts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First word and end word of each long paragraph of texts whose words stand at ``firsts`` to ``ends``."""
    pair = np.where(crossing, _TOP, fold([h[:-1], h[1:]])) if len(h) > 1 else np.empty(0, np.uint64)
    rim = np.full(APART, _TOP)
    cuts = np.flatnonzero(pair == least_of_windows(np.r_[rim, pair, rim], 2 * APART + 1)) if len(pair) else np.empty(0, np.int64)
    cuts = cuts[~crossing[cuts]].tolist()
    begin, end = [], []
    for x, n in zip(firsts.tolist(), ends.tolist(), strict=True):
        first = x
        # Beside each other, since overlapping ones of a text would link and join what has nothing in common.
        while n - x >= (LONG if n - first >= 2 * LONG else n - first + 1):
            k = bisect_left(cuts, x + LONG)
            y = min(cuts[k], n) if k < len(cuts) else n
            begin.append(x)
            end.append(y)
            x = y
        if x == first:
            begin.append(x)
            end.append(n)
        elif x < n:
            # The last of them reaches the end, so that no word is in none.
            end[-1] = n
    return np.array(begin, np.int64), np.array(end, np.int64)


def band_keys(flat: np.ndarray, at: np.ndarray) -> np.ndarray:
    """A key for each band and set; sets begin at ``at`` in ``flat``."""
    keys = np.empty((len(at), BANDS), np.uint64)
    for band in range(BANDS):
        key = np.full(len(at), band + 1, np.uint64)
        for r in range(ROWS):
            x = flat * _A[band * ROWS + r]
            x ^= x >> _R
            x *= _M
            x ^= x >> _R
            key = (key ^ (key >> _R)) * _M + np.minimum.reduceat(x, at)
        keys[:, band] = (key ^ (key >> _R)) * _M
    return keys


def sets_of(h: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(shingles, their sets' numbers, where sets begin), repeats included, of the words from ``begin`` to ``end``; of fewer than WORDS all as one."""
    if not len(begin):
        return np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64)
    count = np.maximum(end - begin - WORDS + 1, 1)
    at = np.cumsum(count) - count
    which = np.repeat(np.arange(len(begin)), count)
    padded = np.r_[h, np.zeros(WORDS, np.uint64)]
    all_of = fold([padded[i : len(h) + i] for i in range(WORDS)])
    flat = all_of[begin[which] + np.arange(len(which)) - at[which]]
    for i in np.flatnonzero(end - begin < WORDS):
        own = h[begin[i] : end[i]]
        flat[at[i]] = fold([np.full(1, len(own), np.uint64), *own[:, None]])[0]
    return flat, which, at


def distinct(flat: np.ndarray, which: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(shingles, sets' numbers, sizes) without repeats; sorted within a set."""
    order = np.lexsort((flat, which))
    flat, which = flat[order], which[order]
    keep = np.r_[True, (flat[1:] != flat[:-1]) | (which[1:] != which[:-1])][: len(flat)]
    return flat[keep], which[keep], np.bincount(which[keep], minlength=k)


#: Kinds of rows: a short paragraph, a long one, one that stands earlier in the same task.
SHORT, WHOLE, AGAIN = 0, 1, 2
UNIT = pa.struct([("n", pa.int32()), *((x, pa.int64()) for x in MAPS), ("bands", pa.list_(pa.int64()))])
ROWS_OF = pa.schema([("kind", pa.int8()), ("node", pa.int64()), ("check", pa.int32()), ("doc_id", pa.int64()), ("begin", pa.int64()), ("size", pa.int64()), ("first_doc", pa.int64()), ("unit", UNIT)])
ROWS_SQL = f"kind byte, node long, check int, doc_id long, begin long, size long, first_doc long, unit struct<n:int,{','.join(f'{x}:long' for x in MAPS)},bands:array<long>>"


def lay_out(texts: list[bytes], ids: np.ndarray, span: int | None) -> list[tuple]:
    """(kind, node, check, doc_id, begin, size) of the short and of the long paragraphs of some texts; with the long ones (n, maps, bands)."""
    sizes = np.array([len(t) for t in texts], np.int64) + 1
    base = np.cumsum(sizes) - sizes
    begins, ends, h = hashed_words(b" ".join(texts))
    if not len(h):
        return []
    of = np.searchsorted(base, begins, side="right") - 1
    crossing = of[1:] != of[:-1]
    other = mix(h * _OTHER)
    out = []
    at = short_beginnings(h, crossing) if span else np.empty(0, np.int64)
    if len(at):
        at = at[at + span <= len(h)]
        at = at[of[at] == of[at + span - 1]]
    if len(at):
        out.append((SHORT, _run_hashes(h, span)[at].view(np.int64), (_run_hashes(other, span)[at] >> np.uint64(32)).astype(np.uint32).view(np.int32), ids[of[at]], begins[at] - base[of[at]], ends[at + span - 1] - begins[at], None))
    edges = np.flatnonzero(np.r_[True, crossing])
    x, y = long_paragraphs(h, crossing, edges, np.r_[edges[1:], len(h)])
    step = np.arange(int((y - x).sum())) - np.repeat(np.cumsum(y - x) - (y - x), y - x)
    place, weight, heads = np.repeat(x, y - x) + step, powers(step), np.cumsum(y - x) - (y - x)
    node = mix(np.add.reduceat(mix(h)[place] * weight, heads) + (y - x).astype(np.uint64))
    check = mix(np.add.reduceat(other[place] * weight, heads))
    flat, which, starts = sets_of(h, x, y)
    # Sizes without repeats, by 44 bits of each shingle: they only bound what is then counted exactly.
    if len(x) < 1 << 20:
        key = np.sort((which.astype(np.uint64) << np.uint64(44)) | (flat >> np.uint64(20)))
        n = np.bincount((key[np.r_[True, key[1:] != key[:-1]]] >> np.uint64(44)).astype(np.int64), minlength=len(x))
    else:
        n = distinct(flat, which, len(x))[2]
    bits, part = np.uint64(1) << (flat & np.uint64(63)), (flat >> np.uint64(6)) & np.uint64(len(MAPS) - 1)
    maps = [np.bitwise_or.reduceat(np.where(part == np.uint64(i), bits, np.uint64(0)), starts).view(np.int64) for i in range(len(MAPS))]
    unit = (n.astype(np.int32), *maps, band_keys(flat, starts).view(np.int64))
    out.append((WHOLE, node.view(np.int64), (check >> np.uint64(32)).astype(np.uint32).view(np.int32), ids[of[x]], begins[x] - base[of[x]], ends[y - 1] - begins[x], unit))
    return out


def _batch(kind: int, node, check, doc, begin, size, first_doc=None, unit=None) -> pa.RecordBatch:
    k = len(doc)
    whole = pa.nulls(k, UNIT)
    if unit is not None:
        bands = pa.ListArray.from_arrays(pa.array(np.arange(0, (k + 1) * BANDS, BANDS, dtype=np.int32)), pa.array(unit[-1].ravel()))
        whole = pa.StructArray.from_arrays([*map(pa.array, unit[:-1]), bands], fields=list(UNIT))
    first = pa.nulls(k, pa.int64()) if first_doc is None else pa.array(first_doc)
    return pa.RecordBatch.from_arrays([pa.array(np.full(k, kind, np.int8)), pa.array(node), pa.array(check), pa.array(doc), pa.array(begin), pa.array(size), first, whole], schema=ROWS_OF)


def _without_overlaps(node: np.ndarray, doc: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Which rows, in order of node, document and place, overlap no earlier kept one of their node and document."""
    keep = np.ones(len(node), bool)
    same = np.r_[False, (node[1:] == node[:-1]) & (doc[1:] == doc[:-1])]
    end = 0
    for i in np.flatnonzero(same).tolist():
        if not same[i - 1]:
            end = begin[i - 1] + size[i - 1]
        # Rows that repeat an id have equal places; those stay and are told apart later.
        if begin[i] < end and begin[i] != begin[i - 1]:
            keep[i] = False
        else:
            end = begin[i] + size[i]
    return keep


def _merged(kind: int, found: list[tuple]) -> Iterator[pa.RecordBatch]:
    """Paragraphs of one kind; those that equal an earlier one here are told apart, so that what meets of a node is bounded by the tasks."""
    node, check, doc, begin, size = (np.concatenate([f[i] for f in found]) for i in range(5))
    unit = tuple(np.concatenate([f[5][i] for f in found]) for i in range(len(UNIT))) if kind == WHOLE else None
    order = np.lexsort((begin, doc, check, node))
    node, check, doc, begin, size = (x[order] for x in (node, check, doc, begin, size))
    if unit is None:
        keep = _without_overlaps(node, doc, begin, size)
        node, check, doc, begin, size = (x[keep] for x in (node, check, doc, begin, size))
    first = np.r_[True, (node[1:] != node[:-1]) | (check[1:] != check[:-1])]
    leader = np.flatnonzero(first)[np.cumsum(first) - 1]
    again = ~first & ((doc != doc[leader]) | (begin != begin[leader]))
    for at in range(0, len(node), 100_000):
        own = slice(at, at + 100_000)
        f, a = np.flatnonzero(first[own]) + at, np.flatnonzero(again[own]) + at
        yield _batch(kind, node[f], check[f], doc[f], begin[f], size[f], None, None if unit is None else tuple(x[order[f]] for x in unit))
        if len(a):
            yield _batch(AGAIN, mix((doc[a] * 31 + begin[a]).view(np.uint64)).view(np.int64), check[a], doc[a], begin[a], size[a], doc[leader[a]])


def _lay(batches: Iterator[pa.RecordBatch], span: int | None = SPAN) -> Iterator[pa.RecordBatch]:
    """The paragraphs of all texts of a task."""
    found: dict[int, list[tuple]] = {SHORT: [], WHOLE: []}
    ids: list[int] = []
    texts: list[bytes] = []
    size = held = 0

    def work() -> None:
        nonlocal ids, texts, size, held
        for kind, *columns in lay_out(texts, np.array(ids, np.int64), span):
            found[kind].append(columns)
            held += len(columns[0])
        ids, texts, size = [], [], 0

    for b in batches:
        for doc, text in zip(b[0], b[1], strict=True):
            if not doc.is_valid or not text.is_valid:
                continue
            data = text.as_buffer().to_pybytes()
            if ids and size + len(data) > CHUNK:
                work()
            ids.append(doc.as_py())
            texts.append(data)
            size += len(data)
            if held > FLUSH:
                for kind, rows in found.items():
                    if rows:
                        yield from _merged(kind, rows)
                found, held = {SHORT: [], WHOLE: []}, 0
    if ids:
        work()
    for kind, rows in found.items():
        if rows:
            yield from _merged(kind, rows)


BANDED = "s long, node long, n int, pos int, frequent boolean, notice boolean"


def _bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each band of each node; lists with many rows here are marked, with a notice."""
    for b in batches:
        if not b.num_rows:
            continue
        s = pa.compute.list_flatten(b["bands"]).to_numpy()
        node, n = np.repeat(b["node"].to_numpy(), BANDS), np.repeat(b["n"].to_numpy(), BANDS)
        value, count = np.unique(s, return_counts=True)
        many = value[count > MANY]
        k = len(many)
        cols = (np.r_[s, many], np.r_[node, np.zeros(k, np.int64)], np.r_[n, np.zeros(k, np.int32)], np.zeros(len(s) + k, np.int32), np.r_[np.isin(s, many), np.zeros(k, bool)], np.r_[np.zeros(len(s), bool), np.ones(k, bool)])
        yield pa.RecordBatch.from_arrays(list(map(pa.array, cols)), names=[x.split()[0] for x in BANDED.split(", ")])


def _noticed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``shared_lists``, where the lists of which some task gave notice count as frequent."""
    held = [b for b in batches if b.num_rows]
    if not held:
        return
    t = pa.Table.from_batches(held)
    s, notice = t["s"].to_numpy(), t["notice"].to_numpy()
    frequent = t["frequent"].to_numpy() | np.isin(s, s[notice])
    t = t.set_column(t.schema.get_field_index("frequent"), "frequent", pa.array(frequent)).drop_columns(["notice"]).filter(pa.array(~notice))
    yield from shared_lists(iter(t.to_batches()))


SLICES = "node long, said binary"


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bytes of the wanted paragraphs of each text."""
    for b in batches:
        rows = []
        for text, wanted in zip(b["text"], b["wanted"].to_pylist(), strict=True):
            data = text.as_buffer()
            rows += [(w["node"], data.slice(w["begin"], w["size"]).to_pybytes()) for w in wanted if w["begin"] + w["size"] <= data.size]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.binary()), strict=True)], names=["node", "said"])


def overlap_of(x: list[bytes], y: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sizes of the sets of each pair of texts, and of what they share."""
    k = len(x)
    sizes = np.array([len(t) for t in (*x, *y)], np.int64) + 1
    base = np.cumsum(sizes) - sizes
    begins, _, h = hashed_words(b" ".join((*x, *y)))
    first = np.searchsorted(begins, base)
    flat, which, _ = sets_of(h, first, np.r_[first[1:], len(h)])
    flat, which, n = distinct(flat, which, 2 * k)
    pair = which % k
    order = np.lexsort((flat, pair))
    flat, pair = flat[order], pair[order]
    both = (flat[1:] == flat[:-1]) & (pair[1:] == pair[:-1])
    return n[:k], n[k:], np.bincount(pair[1:][both], minlength=k)


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pairs with J of PERCENT or more."""
    for batch in batches:
        for at in range(0, batch.num_rows, 2000):
            b = batch.slice(at, 2000)
            na, nb, o = overlap_of(b["x"].to_pylist(), b["y"].to_pylist())
            yield b.select(["a", "b"]).filter(pa.array((100 + PERCENT) * o >= PERCENT * (na + nb)))


def clusters(docs: DataFrame, span: int | None = SPAN) -> DataFrame:
    """doc_id, begin, size, first_doc of every paragraph that isn't the first of its cluster. ``span``: words of short ones, None for none."""
    bound_batches(docs.sparkSession)
    docs = docs.select("doc_id", "text")
    place = Window.partitionBy("node").orderBy("doc_id", "begin").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = docs.mapInArrow(partial(_lay, span=span), ROWS_SQL)
    rows = rows.select("*", F.row_number().over(Window.partitionBy("node").orderBy("doc_id", "begin")).alias("_nth"), *(F.first(c).over(place).alias(f"_{c}") for c in ("check", "doc_id", "begin")))
    # Equal names that are of other words by chance stay, as they fail the check.
    later = "_nth > 1 AND check = _check AND (doc_id != _doc_id OR begin != _begin)"
    rows = rows.withColumn("cut", F.expr(f"kind = {AGAIN} OR ({later})"))
    rows = rows.where(f"cut OR (kind = {WHOLE} AND _nth = 1)").withColumn("first_doc", F.when(F.col("cut"), F.coalesce("first_doc", "_doc_id")))
    found = stored(rows.select("cut", "node", "doc_id", "begin", "size", "first_doc", F.expr("CASE WHEN NOT cut THEN unit END").alias("unit")))
    cuts = found.where("cut").select("doc_id", "begin", "size", "first_doc")
    nodes = found.where("NOT cut").select("node", "doc_id", "begin", "size", "unit.*")

    banded = nodes.select("node", "n", "bands").mapInArrow(_bands, BANDED)
    deal = F.when(F.col("frequent"), F.xxhash64("s", "node")).otherwise(F.col("s"))
    dealt = banded.withColumn("_deal", deal).repartition("_deal").drop("_deal")
    lists, pairs = split_lists(stored(dealt.mapInArrow(_noticed, LISTS)))
    maps = nodes.select("node", *MAPS)
    # The likeliest hub of a list is the node that meets most others in all its lists, such as the text that many differ a little from.
    central = lists.groupBy("node").agg((-F.sum("m")).alias("pos"))
    lists = stored(lists.drop("pos").join(central, "node").join(maps, "node"))
    a, b = (maps.select(F.col("node").alias(x), *(F.col(c).alias(f"{c}{x}") for c in MAPS)) for x in "ab")
    pairs = stored(pairs.distinct().join(a, "a").join(b, "b").where(BOUND).select("a", "b", "na", "nb"))

    met = lists.select("node").union(pairs.select("a")).union(pairs.select("b")).distinct()
    wanted = stored(nodes.join(met, "node").groupBy("doc_id").agg(F.collect_list(F.struct("node", "begin", "size")).alias("wanted")))
    texts = docs.where("text IS NOT NULL").join(maybe_broadcast(wanted, met.count()), "doc_id")
    slices = stored(texts.select("text", "wanted").mapInArrow(_slices, SLICES).dropDuplicates(["node"]))

    def verify(pairs: DataFrame) -> DataFrame:
        x, y = (slices.select(F.col("node").alias(k), F.col("said").alias(name)) for k, name in (("a", "x"), ("b", "y")))
        return pairs.select("a", "b").join(x, "a").join(y, "b").mapInArrow(_verified, "a long, b long")

    labels, _ = link_lists(lists, verify, BOUND, pairs, MAPS)
    if labels is None:
        return cuts
    joined = nodes.select("node", "doc_id", "begin", "size").join(labels, "node")
    firsts = joined.groupBy("component").agg(F.min(F.struct("doc_id", "begin")).alias("leader"))
    near = joined.join(firsts, "component").where("doc_id != leader.doc_id OR begin != leader.begin")
    return cuts.unionByName(near.select("doc_id", "begin", "size", F.col("leader.doc_id").alias("first_doc")))


RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary, sources array<long>"


def _remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.int64()))
    for batch in batches:
        for start in range(0, batch.num_rows, 1000):
            b = batch.slice(start, 1000)
            rows = []
            for doc, text, cuts in zip(*(b[x].to_pylist() for x in ("doc_id", "text", "cuts")), strict=True):
                data = (text or "").encode("utf-8", "surrogatepass")
                spans: list[list[int]] = []
                for c in sorted(cuts or (), key=lambda c: (c["begin"], c["size"])):
                    end = min(c["begin"] + c["size"], len(data))
                    if spans and c["begin"] <= spans[-1][1]:
                        spans[-1][1] = max(spans[-1][1], end)
                    elif c["begin"] < end:
                        spans.append([c["begin"], end])
                at, kept = 0, []
                for x, y in spans:
                    kept.append(data[at:x])
                    at = y
                left = b"".join([*kept, data[at:]])
                rows.append((doc, len(data), len(data) - len(left), len(spans), left, sorted({c["first_doc"] for c in cuts or ()})))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=[x.split()[0] for x in RESULT.split(", ")])


def remove_paragraphs(docs: DataFrame, span: int | None = SPAN) -> DataFrame:
    """doc_id, n_bytes, n_removed (bytes), n_spans, kept (bytes), sources (documents where equal or similar paragraphs stand earlier), a row per row."""
    cuts = stored(clusters(docs, span).groupBy("doc_id").agg(F.collect_set(F.struct("begin", "size", "first_doc")).alias("cuts")))
    total = cuts.agg(F.sum(F.size("cuts"))).first()[0] or 0
    return docs.select("doc_id", "text").join(maybe_broadcast(cuts, total), "doc_id", "left").select("doc_id", "text", "cuts").mapInArrow(_remove, RESULT)


def op3_substring_dedup(spark, sf_dir):
    from .common import table

    found = remove_paragraphs(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"), "sources")
