"""Removal of long repeated byte strings by suffix arrays of content-defined shards.

Every string of `length` bytes belongs to its minimizer, the ANCHOR-byte gram in it with the least hash (leftmost on ties), at the same
place in every copy of the string. A segment is a run of string starts with one minimizer. Equal strings therefore lie in segments
with equal minimizers, and a shard is a set of whole minimizers: all copies of a string meet in one shard, wherever they come from.

1. Segments are counted by (minimizer, content). Equal contents repeat wholly. A minimizer with one segment is done.
2. Of a minimizer with several contents, those that agree with another one in half a string before or after the minimizer go once into the suffix array of its shard: induced sorting, then
   permuted common prefixes; a string start whose common prefix with a neighbour of the suffix array reaches `length` is repeated.
3. A minimizer whose contents exceed a shard (a passage with other surroundings in very many places) is dealt out further: its segments are cut into
   parts of PART string starts at equal distances from the minimizer, and those whose strings share the same bytes form a shard again. Only
   where even such contents exceed a shard, the digests of single strings decide. So no shard grows with the number of places that a passage has.

Contents, parts and texts are told apart by digests of 128 bits, minimizers by 64 (two of them in one group only share its shard).
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, drop, released, table, tidy
from .kernels import U64, mix, prefix_hash, text_parts

ANCHOR, PART = 64, 16
#: Bytes of a shard's suffix array; whole minimizers are added until it is reached.
SHARD = 1 << 20
#: Symbols up to which a bucket of suffixes is scanned in vector steps; above, where buckets hold few suffixes, the scan takes them one by one.
SYMBOLS = 2048
#: String starts of a text that are scanned at once.
WINDOW = 1 << 20


def _equal_substrings(text: np.ndarray, x: np.ndarray, y: np.ndarray, size: np.ndarray, by: int = 16) -> np.ndarray:
    """Whether text[x : x + size] equals text[y : y + size], symbol by symbol."""
    equal = np.ones(len(x), bool)
    padded = np.concatenate((text, np.zeros(by, text.dtype)))
    steps = np.arange(by)
    for s in range(0, len(x), 1 << 16):
        live, at = np.arange(s, min(len(x), s + (1 << 16))), 0
        while len(live):
            same = padded[x[live, None] + at + steps] == padded[y[live, None] + at + steps]
            equal[live] &= (same | (at + steps >= size[live, None])).all(1)
            at += by
            live = live[equal[live] & (size[live] > at)]
    return equal


def _induce_singly(text: np.ndarray, smaller: np.ndarray, start: np.ndarray, end: np.ndarray, sorted_lms: np.ndarray) -> np.ndarray:
    """The scans of induced sorting, suffix by suffix."""
    array = [-1] * len(text)
    tail, symbols = end.tolist(), text[sorted_lms[::-1]].tolist()
    for j, c in zip(sorted_lms[::-1].tolist(), symbols, strict=True):
        tail[c] -= 1
        array[tail[c]] = j
    # Of each suffix, the symbol before it, and whether that begins a larger or a smaller suffix; the last entry stands for none (-1).
    before = np.concatenate((text[:1], text[:-1], [0])).tolist()
    smaller_before = np.concatenate(([False], smaller[:-1], [False])).tolist()
    larger_before = np.concatenate(([False], ~smaller[:-1], [False])).tolist()
    head = start.tolist()
    for j in array:  # also sees what is put farther on
        if larger_before[j]:
            c = before[j]
            at = head[c]
            array[at] = j - 1
            head[c] = at + 1
    tail = end.tolist()
    for j in reversed(array):
        if smaller_before[j]:
            c = before[j]
            at = tail[c] = tail[c] - 1
            array[at] = j - 1
    return np.array(array, np.int64)


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Suffix array of small non-negative integers that end in a unique least symbol, by induced sorting, recursively on the string of names.

    In a small alphabet the scan over a bucket of suffixes is one vector step for each generation: what a bucket induces into itself is the next generation."""
    n = len(text)
    if n < 3:
        return np.argsort(text, kind="stable")
    symbols = int(text.max()) + 1
    step = np.sign(np.diff(text.astype(np.int64))).astype(np.int8)
    nearest = np.where(step != 0, np.arange(n - 1), n)
    nearest = np.minimum.accumulate(nearest[::-1])[::-1]
    smaller = np.ones(n, bool)
    smaller[:-1] = step[np.minimum(nearest, n - 2)] > 0
    lms = np.flatnonzero(smaller[1:] & ~smaller[:-1]) + 1
    size = np.bincount(text, minlength=symbols)
    end = np.cumsum(size)
    start = end - size
    larger_size = np.bincount(text[~smaller], minlength=symbols)

    def put(array: np.ndarray, pointer: np.ndarray, batch: np.ndarray, want: bool, way: int) -> None:
        batch = batch[batch > 0] - 1
        batch = batch[smaller[batch] == want]
        if not len(batch):
            return
        c = text[batch]
        order = np.argsort(c, kind="stable")
        batch, c = batch[order], c[order]
        count = np.bincount(c, minlength=symbols)
        place = np.arange(len(c)) - (np.cumsum(count) - count)[c]
        array[pointer[c] + way * place] = batch
        pointer += way * count

    def induce(sorted_lms: np.ndarray) -> np.ndarray:
        if symbols > SYMBOLS:
            return _induce_singly(text, smaller, start, end, sorted_lms)
        array = np.full(n, -1, np.int64)
        head = start.copy()
        of = np.searchsorted(text[sorted_lms], np.arange(symbols + 1))
        for c in range(symbols):
            at = start[c]
            while at < head[c]:
                batch, at = array[at : head[c]], head[c]
                put(array, head, batch, False, 1)
            if of[c] < of[c + 1]:
                put(array, head, sorted_lms[of[c] : of[c + 1]], False, 1)
        tail = end - 1
        for c in range(symbols - 1, -1, -1):
            at = end[c] - 1
            while at > tail[c]:
                batch, at = array[tail[c] + 1 : at + 1][::-1], tail[c]
                put(array, tail, batch, True, -1)
            put(array, tail, array[start[c] : start[c] + larger_size[c]][::-1], True, -1)
        array[0] = n - 1
        return array

    array = induce(lms[np.argsort(text[lms], kind="stable")])
    is_lms = np.zeros(n, bool)
    is_lms[lms] = True
    ordered = array[is_lms[array]]
    stop = np.full(n, n, np.int64)
    stop[lms[:-1]] = lms[1:] + 1
    reach = stop[ordered] - ordered
    fresh = reach[1:] != reach[:-1]
    same = np.flatnonzero(~fresh)
    fresh[same] = ~_equal_substrings(text, ordered[same], ordered[same + 1], reach[same])
    names = np.empty(n, np.int64)
    names[ordered] = np.concatenate(([0], np.cumsum(fresh)))
    reduced = names[lms]
    if reduced.max() + 1 < len(lms):
        return induce(lms[suffix_array(reduced)])
    return induce(ordered)


def common_prefixes(text: np.ndarray, array: np.ndarray, most: int) -> np.ndarray:
    """At each text position, the prefix shared with the suffix before it in the array (permuted order), counted up to `most` at least where it reaches it.

    Only positions whose preceding symbols differ are compared; the others follow from the position before."""
    n = len(text)
    before = np.full(n, -1, np.int64)
    before[array[1:]] = array[:-1]
    at = np.arange(n)
    own = (before < 0) | (at == 0) | (before == 0)
    rest = np.flatnonzero(~own)
    own[rest] = text[rest - 1] != text[before[rest] - 1]
    active = np.flatnonzero(own & (before >= 0))
    length = np.zeros(n, np.int64)
    padded = np.concatenate((text, np.full(1, -1, text.dtype)))
    while len(active):
        x, y = active + length[active], before[active] + length[active]
        inside = (x < n) & (y < n)
        active, x, y = active[inside], x[inside], y[inside]
        active = active[padded[x] == padded[y]]
        length[active] += 1
        if len(active) and length[active[0]] % 8 == 0:
            active = _stride(padded, before, length, active, n)
    reach = np.where(own, at + length, 0)
    return np.maximum(np.maximum.accumulate(reach) - at, 0)


def _stride(text: np.ndarray, before: np.ndarray, length: np.ndarray, active: np.ndarray, n: int, by: int = 32) -> np.ndarray:
    """Extend the common prefixes of `active` by whole strides while they last."""
    go, size = active, np.full(len(active), by)
    while len(go := go[(go + length[go] + by <= n) & (before[go] + length[go] + by <= n)]):
        go = go[_equal_substrings(text, go + length[go], before[go] + length[go], size[: len(go)], by)]
        length[go] += by
    return active


def _anchors(grams: np.ndarray, width: int) -> np.ndarray:
    """Of each window of `width` grams, the place of the least hash, the leftmost on ties."""
    m = len(grams)
    blocks = -(-m // width)
    value = np.full(blocks * width, ~U64(0))
    value[:m] = grams
    value = value.reshape(blocks, width)
    place = np.arange(blocks * width).reshape(blocks, width)
    ahead = np.minimum.accumulate(value, axis=1)
    fresh = np.ones(value.shape, bool)
    fresh[:, 1:] = value[:, 1:] < ahead[:, :-1]
    ahead_at = np.maximum.accumulate(np.where(fresh, place, 0), axis=1).ravel()
    behind = np.minimum.accumulate(value[:, ::-1], axis=1)[:, ::-1]
    fresh[:, -1] = True
    fresh[:, :-1] = value[:, :-1] <= behind[:, 1:]
    behind_at = np.minimum.accumulate(np.where(fresh, place, place[-1, -1])[:, ::-1], axis=1)[:, ::-1].ravel()
    ahead, behind = ahead.ravel(), behind.ravel()
    starts = np.arange(m - width + 1)
    stops = starts + width - 1
    return np.where(behind[starts] <= ahead[stops], behind_at[starts], ahead_at[stops])


def digest(raw: bytes | memoryview) -> bytes:
    return hashlib.blake2b(raw, digest_size=16).digest()


def segments(data: np.ndarray, offsets: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, list[bytes], np.ndarray]:
    """(row, start in the row, number of string starts, minimizer, content digest, place of the minimizer in the content) of the segments of all rows."""
    n, width = len(data), length - ANCHOR + 1
    none = np.zeros(0, np.int64)
    if n < length or not (np.diff(offsets) >= length).any():
        return none, none, none, none.astype(U64), [], none
    sums, down = prefix_hash(data)
    grams = mix((sums[ANCHOR:] - sums[:-ANCHOR]) * down[: n - ANCHOR + 1])
    anchor = _anchors(grams, width)
    starts = np.arange(len(anchor))
    row = np.searchsorted(offsets, starts, "right") - 1
    fits = starts + length <= offsets[row + 1]
    cut = np.ones(len(starts), bool)
    cut[1:] = (anchor[1:] != anchor[:-1]) | (row[1:] != row[:-1])
    first = np.flatnonzero(cut & fits)
    edge = np.flatnonzero(np.concatenate((cut[1:] | (fits[:-1] & ~fits[1:]), [True])) & fits)
    raw = memoryview(np.ascontiguousarray(data))
    content = [digest(raw[s:t]) for s, t in zip(first.tolist(), (edge + length).tolist(), strict=True)]
    return row[first], first - offsets[row[first]], edge - first + 1, grams[anchor[first]], content, anchor[first] - first


def _scan(length: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Segments of each text. A very long text is scanned by windows of string starts, at whose ends segments end, too."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at, data, offsets in text_parts(b.column(1)):
                for w in range(0, len(data), WINDOW) if len(offsets) == 2 else (0,):
                    part, bounds = (data, offsets) if len(offsets) > 2 else (data[w : w + WINDOW + length - 1], None)
                    row, start, count, anchor, content, place = segments(part, np.array([0, len(part)]) if bounds is None else bounds, length)
                    yield pa.RecordBatch.from_arrays([pa.array(anchor.view(np.int64)), pa.array(content, pa.binary()), b.column(0).take(pa.array(at + row)), pa.array((start + w).astype(np.int64)), pa.array(count.astype(np.int32)), pa.array(place.astype(np.int32))], ["anchor", "content", "text_key", "start", "n", "place"])

    return run


def _cut(length: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(text, wanted segments) to each segment's bytes, and the digests of its minimizer with what stands before and after it.

    A string of `length` bytes holds the minimizer and, on one side of it, half of the rest: contents that agree in neither share no string."""
    half = (length - ANCHOR + 1) // 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(len(b)):
                raw = memoryview(b.column(0)[i].as_buffer())
                anchor, content, start, stop, hot, place = b.column(1)[i].values.flatten()
                cuts, left, right = [], [], []
                for s, e, p in zip(start.to_pylist(), stop.to_pylist(), place.to_pylist(), strict=True):
                    cuts.append(bytes(raw[s:e]))
                    left.append(digest(raw[s + p - half : s + p + ANCHOR]) if p >= half else None)
                    right.append(digest(raw[s + p : s + p + ANCHOR + half]) if s + p + ANCHOR + half <= e else None)
                yield pa.RecordBatch.from_arrays([anchor, content, hot, pa.array(left, pa.binary()), pa.array(right, pa.binary()), pa.array(cuts, pa.binary())], ["anchor", "content", "hot", "left", "right", "bytes"])

    return run


def repeated_starts(parts: list[bytes], length: int) -> np.ndarray:
    """For the joined parts (a separator after each), whether the string of `length` bytes at a position starts at another position too; it lies within one part."""
    sizes = np.array([len(x) + 1 for x in parts])
    joined = np.frombuffer(b"\0".join(parts) + b"\0\0", np.uint8).astype(np.int32) + 2
    ends = np.cumsum(sizes) - 1
    joined[ends] = 1
    joined[-1] = 0
    array = suffix_array(joined)
    shared = common_prefixes(joined, array, length)
    rank = np.empty(len(array), np.int64)
    rank[array] = np.arange(len(array))
    left = np.repeat(ends, sizes) - np.arange(len(joined) - 1)
    after = np.zeros(len(joined), np.int64)
    after[array[:-1]] = shared[array[1:]]
    return (np.maximum(shared, after)[:-1] >= length) & (left >= length)


def _runs(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edge = np.flatnonzero(np.diff(np.concatenate(([0], flags.view(np.int8), [0]))))
    return edge[::2], edge[1::2]


def _shards(length: int, group: pa.DataType) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows (group, content, bytes) sorted by group to the runs of repeated string starts of each content. A shard ends between two groups."""

    def solve(held: list[tuple[object, bytes, bytes]]) -> pa.RecordBatch:
        flags, at, out = repeated_starts([x[2] for x in held], length), 0, []
        for name, content, raw in held:
            a, b = _runs(flags[at : at + len(raw)])
            out += [(name, content, int(s), int(e) - 1) for s, e in zip(a, b, strict=True)]
            at += len(raw) + 1
        types = (group, pa.binary(), pa.int64(), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], t) for i, t in enumerate(types)], ["name", "content", "first", "last"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for b in batches:
            for name, content, raw in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                if size >= SHARD and name != held[-1][0]:
                    yield solve(held)
                    held, size = [], 0
                held.append((name, content, raw))
                size += len(raw)
        if held:
            yield solve(held)

    return run


def _parts(length: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Segments of hot minimizers cut into parts of PART string starts, at the same distances from the minimizer in every copy.

    (anchor, content, first, last, digest of the bytes that all strings of the part share, digest of all bytes of the part, how many these are)"""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for anchor, content, raw in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                sums, down = prefix_hash(np.frombuffer(raw, np.uint8))
                n = len(raw) - length + 1
                at = np.arange(n - 1, length - ANCHOR + 1)
                gram = mix((sums[at + ANCHOR] - sums[at]) * down[at])
                far = int(at[np.flatnonzero(gram == np.array(anchor).view(U64))[0]]) - np.arange(n)
                first = np.flatnonzero(np.concatenate(([True], np.diff(far // PART) != 0)))
                last = np.append(first[1:], n) - 1
                # What all strings at these distances share, whether or not the segment holds all of them.
                left, right = far[first] // PART * PART, (far[first] // PART * PART + PART - 1)
                start, stop = first + far[first] - left, first + far[first] - right + length
                name = anchor.to_bytes(8, "little", signed=True)
                sub = [digest(name + x.to_bytes(8, "little", signed=True) + raw[s:e]) for x, s, e in zip(left.tolist(), start.tolist(), stop.tolist(), strict=True)]
                part = [digest(x + raw[s : e + length]) for x, s, e in zip(sub, first.tolist(), last.tolist(), strict=True)]
                k = len(first)
                columns = [pa.array([anchor] * k), pa.array([content] * k, pa.binary()), pa.array(first), pa.array(last), pa.array(sub, pa.binary()), pa.array(part, pa.binary()), pa.array(last - first + length)]
                yield pa.RecordBatch.from_arrays(columns, ["anchor", "content", "first", "last", "sub", "part", "size"])

    return run


def _cut_parts(length: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(bytes, wanted parts) to (sub, part, whether too many for a shard, bytes of the part)"""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(len(b)):
                raw = b.column(0)[i].as_buffer().to_pybytes()
                sub, part, first, last, many = b.column(1)[i].values.flatten()
                cuts = [raw[s : e + length] for s, e in zip(first.to_pylist(), last.to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([sub, part, many, pa.array(cuts, pa.binary())], ["sub", "part", "many", "bytes"])

    return run


def _strings(length: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(sub, part, position in the part, digest) of each string of (sub, part, bytes)"""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            row, at, strings = [], [], []
            for i, raw in enumerate(b.column(2).to_pylist()):
                n = len(raw) - length + 1
                row += [i] * n
                at += range(n)
                strings += [digest(raw[s : s + length]) for s in range(n)]
            where = pa.array(row, pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0).take(where), b.column(1).take(where), pa.array(at, pa.int64()), pa.array(strings, pa.binary())], ["sub", "part", "first", "string"])

    return run


def _hot_runs(cut: DataFrame, length: int, shard: int) -> DataFrame:
    """Runs of repeated string starts of the contents of hot minimizers, found like those of segments but with parts in the place of segments."""
    parts = table(cut.mapInArrow(released(_parts(length)), "anchor long, content binary, first long, last long, sub binary, part binary, size long"))
    kinds = parts.groupBy("sub", "part").agg(F.count("*").alias("copies"), F.min(F.struct("anchor", "content", "first", "last", "size")).alias("one"))
    subs = kinds.groupBy("sub").agg(F.count("*").alias("contents"), F.sum("copies").alias("rows"), F.sum("one.size").alias("bytes")).where("rows > 1")
    several = table(kinds.join(subs, "sub").select("sub", "part", "copies", "contents", (F.col("bytes") > shard).alias("many"), "one.*"))
    wanted = several.where("contents > 1").groupBy("anchor", "content").agg(F.collect_list(F.struct("sub", "part", "first", "last", "many")).alias("want"))
    pieces = table(cut.join(wanted, ["anchor", "content"]).select("bytes", "want").mapInArrow(released(_cut_parts(length)), "sub binary, part binary, many boolean, bytes binary"))
    few = pieces.where("not many").select("sub", "part", "bytes").repartition("sub").sortWithinPartitions("sub")
    sorted_ = few.mapInArrow(released(_shards(length, pa.binary())), "sub binary, part binary, `from` long, `to` long")
    strings = table(pieces.where("many").select("sub", "part", "bytes").mapInArrow(released(_strings(length)), "sub binary, part binary, first long, string binary"))
    twice = strings.groupBy("string").agg(F.count("*").alias("n")).where("n > 1").select("string")
    single = strings.join(twice, "string").select("sub", "part", F.col("first").alias("from"), F.col("first").alias("to"))
    whole = several.where("copies > 1").select("sub", "part", F.lit(0).cast("long").alias("from"), (F.col("last") - F.col("first")).alias("to"))
    found = whole.unionByName(sorted_.unionByName(single).join(whole.select("sub", "part"), ["sub", "part"], "left_anti"))
    runs = table(parts.join(found, ["sub", "part"]).select("anchor", "content", (F.col("first") + F.col("from")).alias("first"), (F.col("first") + F.col("to")).alias("last")))
    drop(parts, several, pieces, strings)
    return runs


def _remove(length: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, ranges = b.column(1), b.column(2)
            out: list[tuple[int, int, int, str, bytes]] = []
            for i in range(len(b)):
                raw = texts[i].as_buffer().to_pybytes() if texts[i].is_valid else b""
                spans = []
                if ranges[i].is_valid and len(ranges[i].values):
                    first, last = (np.asarray(x) for x in ranges[i].values.flatten())
                    order = np.argsort(first, kind="stable")
                    first, reach = first[order], np.maximum.accumulate(last[order] + length)
                    head = np.concatenate(([True], first[1:] > reach[:-1]))
                    spans = list(zip(first[head].tolist(), np.append(reach[:-1][head[1:]], reach[-1]).tolist(), strict=True))
                at, kept = 0, []
                for s, e in spans:
                    kept.append(raw[at:s])
                    at = e
                kept = b"".join([*kept, raw[at:]])
                out.append((len(raw), len(raw) - len(kept), len(spans), hashlib.sha256(kept).hexdigest(), kept))
            n, gone, spans, sha, kept = zip(*out, strict=True) if out else ((), (), (), (), ())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(spans, pa.int64()), pa.array(sha, pa.string()), pa.array(kept, pa.binary())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    return run


def remove_repeats(docs: DataFrame, length: int = 400, key: str = "doc_id", text: str = "text", shard: int = SHARD) -> DataFrame:
    """Remove each byte covered by a string of `length` bytes that also starts anywhere else in the table, the same row included.

    Returns, for each row, doc_id, n_bytes, n_removed, n_spans (maximal removed runs), kept_sha256 and kept (the remaining bytes; a cut may
    fall inside a character). Overlapping copies count, every copy is removed, and strings are judged on the input. No match crosses
    rows. A null text is empty; a shorter text than `length` stays whole; repeated rows are copies of each other; a null doc_id keeps its
    row. Other columns, also of the names of results, are not read. An empty table gives no rows. `length` is more than ANCHOR. shard: bytes of the
    contents of one minimizer up to which one suffix array takes them all."""
    if length <= ANCHOR:
        raise ValueError(f"length must be more than {ANCHOR}")
    bound_batches(docs.sparkSession)
    docs = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    named = F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.col("text"))
    docs = docs.withColumn("text_key", F.unhex(F.md5(named.cast("binary"))))
    found = table(docs.where(F.octet_length("text") >= length).select("text_key", "text").mapInArrow(released(_scan(length)), "anchor long, content binary, text_key binary, start long, n int, place int"))
    contents = found.groupBy("anchor", "content").agg(F.count("*").alias("copies"), F.min(F.struct("text_key", "start", "n", "place")).alias("one"))
    anchors = contents.groupBy("anchor").agg(F.count("*").alias("contents"), F.sum("copies").alias("rows"), F.sum(F.col("one.n") + (length - 1)).alias("bytes")).where("rows > 1")
    several = table(contents.join(anchors, "anchor").select("anchor", "content", "copies", "contents", "bytes", "one.*"))
    wanted = several.where("contents > 1").groupBy("text_key").agg(F.collect_list(F.struct("anchor", "content", F.col("start"), (F.col("start") + F.col("n") + (length - 1)).alias("stop"), (F.col("bytes") > shard).alias("hot"), "place")).alias("want"))
    source = docs.join(wanted, "text_key").dropDuplicates(["text_key"]).select("text", "want")
    cut = table(source.mapInArrow(released(_cut(length)), "anchor long, content binary, hot boolean, left binary, right binary, bytes binary"))
    both = lambda side: cut.where(F.col(side).isNotNull()).groupBy("anchor", side).agg(F.count("*").alias("m")).where("m > 1").select("anchor", side)
    near = cut.join(both("left"), ["anchor", "left"]).select("anchor", "content").unionByName(cut.join(both("right"), ["anchor", "right"]).select("anchor", "content")).distinct()
    whole, cut = cut, table(cut.select("anchor", "content", "hot", "bytes").join(near, ["anchor", "content"], "left_semi"))
    drop(whole)
    tidy(docs.sparkSession)
    schema = "anchor long, content binary, first long, last long"
    shards = cut.where("not hot").select("anchor", "content", "bytes").repartition("anchor").sortWithinPartitions("anchor").mapInArrow(released(_shards(length, pa.int64())), schema)
    parts = several.where("copies > 1").select("anchor", "content", F.lit(0).cast("long").alias("first"), (F.col("n") - 1).cast("long").alias("last"))
    partly = shards.unionByName(_hot_runs(cut.where("hot").drop("hot"), length, shard))
    runs = table(parts.unionByName(partly.join(several.where("copies > 1").select("content", "anchor"), ["anchor", "content"], "left_anti")))
    places = found.join(runs, ["anchor", "content"]).select("text_key", (F.col("start") + F.col("first")).alias("first"), (F.col("start") + F.col("last")).alias("last")).distinct()
    ranges = table(places.groupBy("text_key").agg(F.collect_list(F.struct("first", "last")).alias("ranges")))
    drop(found, several, cut, runs)
    return docs.join(ranges, "text_key", "left").select("doc_id", "text", "ranges").mapInArrow(released(_remove(length)), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
