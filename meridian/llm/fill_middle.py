"""Fill-in-middle by a parallel automaton scan.

One automaton reads a text's bytes: it counts the units (lines with their ends) that begin, and notices marks. A stretch of bytes is known by what it
does from every start state: the state that it ends in and the units that begin. These functions compose associatively, so stretches are
scanned side by side, composed in order, and only then given their entry states; a cut is looked for in the one stretch that holds it.

1. Inside a task all texts of a batch are cut into blocks that are scanned in lockstep from all states. Runs of bytes on which the automaton rests
   are scanned as one byte.
2. A text above `chunk` bytes is dealt out in chunks. Tasks reduce chunks to their functions; these, a few numbers a chunk, are composed by text;
   chunks that hold a cut are scanned again from their entry state, and the cuts go back to the text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, drop, released, table

#: Marks of prefix, suffix and middle.
MARKS = ("<P>", "<S>", "<M>")
#: Bytes of a chunk of a text that several tasks share, and symbols of a block inside a task.
CHUNK, BLOCK = 1 << 16, 256


class Automaton:
    """Counts units that begin and finds marks. `step` and `begins` are by symbol and state; symbol 0 is every byte that no mark holds, the last one changes nothing."""

    def __init__(self, marks: tuple[str, ...]) -> None:
        given = [m.encode() for m in marks]
        prefixes = sorted({m[:i] for m in given for i in range(len(m))})
        self.found = len(prefixes)
        self.marks = self.found + 1  # states of the marks; a state is inside * marks + mark
        special = sorted({10, *(b for m in given for b in m)})
        self.symbol = np.zeros(256, np.uint8)
        self.symbol[special] = np.arange(1, len(special) + 1)
        other = next(b for b in range(256) if b not in special)

        def seen(mark: int, byte: int) -> int:
            if mark == self.found:
                return mark
            text = prefixes[mark] + bytes([byte])
            if any(text.endswith(m) for m in given):
                return self.found
            return prefixes.index(next(text[i:] for i in range(len(text) + 1) if text[i:] in prefixes))

        self.states = 2 * self.marks
        self.pad = len(special) + 1
        self.step = np.tile(np.arange(self.states, dtype=np.uint8), (self.pad + 1, 1))
        self.begins = np.zeros_like(self.step)
        for k, byte in enumerate([other, *special]):
            for s in range(self.states):
                self.step[k, s] = (byte != 10) * self.marks + seen(s % self.marks, byte)
                self.begins[k, s] = s < self.marks
        rest = self.step[0]
        assert (rest[rest] == rest).all() and not self.begins[0][rest].any(), "a second byte of a run must change nothing"

    def symbols(self, data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(places of the bytes that count, their symbols, bounds of the texts among them): runs of symbol 0 count once."""
        sym = self.symbol[data]
        odd = sym != 0
        keep = odd.copy()
        keep[1:] |= odd[:-1]
        keep[bounds[:-1][bounds[:-1] < len(data)]] = True
        where = np.flatnonzero(keep)
        return where, sym[where], np.searchsorted(where, bounds)


@lru_cache(4)
def automaton(marks: tuple[str, ...]) -> Automaton:
    return Automaton(marks)


class Scan:
    """The blocks of some texts, each with its function; resolved by the texts' entry states."""

    def __init__(self, auto: Automaton, data: np.ndarray, bounds: np.ndarray, block: int = BLOCK) -> None:
        self.auto, self.data, self.bounds, self.block = auto, data, bounds, block
        self.where, self.sym, at = auto.symbols(data, bounds)
        self.n_blocks = -(-np.diff(at) // block)
        self.first = np.cumsum(self.n_blocks) - self.n_blocks
        within = np.arange(self.n_blocks.sum()) - np.repeat(self.first, self.n_blocks)
        self.start = np.repeat(at[:-1], self.n_blocks) + within * block
        self.stop = np.minimum(self.start + block, np.repeat(at[1:], self.n_blocks))
        state = np.tile(np.arange(auto.states, dtype=np.uint8), (len(self.start), 1))
        begun = np.zeros(state.shape, np.int64)
        for column in self._columns(np.arange(len(self.start))):
            begun += auto.begins[column[:, None], state]
            state = auto.step[column[:, None], state]
        self.to, self.begun = state, begun

    def _columns(self, blocks: np.ndarray) -> Iterator[np.ndarray]:
        """The j-th symbol of each block, for every j."""
        start, stop = self.start[blocks], self.stop[blocks]
        for j in range(int((stop - start).max(initial=0))):
            at = start + j
            yield np.where(at < stop, self.sym[np.minimum(at, len(self.sym) - 1)], self.auto.pad)

    def composed(self, entry: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """entry: states by text and column. (last state, units, by text and column; entry state and units before, by block for the first column)"""
        state, units = entry.copy(), np.zeros(entry.shape, np.int64)
        before, count = np.zeros(len(self.start), np.uint8), np.zeros(len(self.start), np.int64)
        for depth in range(int(self.n_blocks.max(initial=0))):
            texts = np.flatnonzero(self.n_blocks > depth)
            blocks = self.first[texts] + depth
            now = state[texts]
            before[blocks], count[blocks] = now[:, 0], units[texts, 0]
            units[texts] += np.take_along_axis(self.begun[blocks], now.astype(np.intp), 1)
            state[texts] = np.take_along_axis(self.to[blocks], now.astype(np.intp), 1)
        return state, units, before, count

    def places(self, texts: np.ndarray, ranks: np.ndarray, before: np.ndarray, count: np.ndarray) -> np.ndarray:
        """The byte, counted from the batch's start, at which the unit of each rank begins; the rank is below the text's units."""
        blocks = np.array([self.first[t] + np.searchsorted(count[self.first[t] : self.first[t] + self.n_blocks[t]], r, "right") - 1 for t, r in zip(texts, ranks, strict=True)], np.int64)
        state, seen, found = before[blocks].copy(), count[blocks].copy(), np.zeros(len(blocks), np.int64)
        for j, column in enumerate(self._columns(blocks)):
            begins = self.auto.begins[column, state].astype(bool)
            hit = begins & (seen == ranks)
            found[hit] = self.where[self.start[blocks[hit]] + j]
            seen += begins
            state = self.auto.step[column, state]
        return found


def points(data: np.ndarray) -> int:
    """Code points of UTF-8 bytes."""
    return int(np.count_nonzero((data & 0xC0) != 0x80))


def layout(doc_id: int | None, n: int, marked: bool, seed: int, rate: int, spm: int) -> tuple[str, int, int]:
    """(form, units of the prefix, units of prefix and middle) that the document's id asks for."""
    h = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[i : i + 8], 16) for i in (0, 8, 16, 24))
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    return ("plain" if not n or marked or h3 % 100 >= rate else "spm" if h4 % 100 < spm else "psm"), a, b


def arranged(form: str, prefix: bytes, middle: bytes, suffix: bytes, marks: tuple[str, ...] = MARKS) -> bytes:
    p, s, m = (x.encode() for x in marks)
    if form == "plain":
        return prefix + middle + suffix
    return p + prefix + s + suffix + m + middle if form == "psm" else s + suffix + p + prefix + m + middle


def restored(form: str, output: bytes, marks: tuple[str, ...] = MARKS) -> bytes:
    """The text that an output was made of: no part of a text that isn't plain holds a mark."""
    if form == "plain":
        return output
    p, s, m = (x.encode() for x in marks)
    first, second = (p, s) if form == "psm" else (s, p)
    one, rest = output[len(first) :].split(second, 1)
    two, middle = rest.split(m, 1)
    return one + middle + two if form == "psm" else two + middle + one


_OUT = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output_sha256 string, restored_sha256 string"


def _rows(rows: list[tuple], with_text: bool) -> pa.RecordBatch:
    """rows: (doc_id, n, form, text, bytes of the prefix, of prefix and middle)"""
    out = []
    for doc_id, n, form, text, a, b in rows:
        parts = text[:a], text[a:b], text[b:]
        made = arranged(form, *parts)
        chars = (None, None) if form == "plain" else tuple(points(np.frombuffer(x, np.uint8)) for x in parts[:2])
        sha = [hashlib.sha256(x).hexdigest() for x in (made, restored(form, made))]
        out.append((doc_id, n, form, *chars, *sha, *([made.decode()] if with_text else [])))
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()]
    names = [x.split(" ")[0] for x in _OUT.split(", ")] + ["output"]
    columns = list(zip(*out, strict=True)) or [()] * (7 + with_text)
    return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=False)], names[: len(columns)])


def _joined(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(b"".join(texts), np.uint8), np.concatenate(([0], np.cumsum([len(t) for t in texts]))).astype(np.int64)


def _bytes(column: pa.Array) -> list[bytes]:
    return [x.as_buffer().to_pybytes() if x.is_valid else b"" for x in column]


def _small(given: tuple[int, int, int], with_text: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Texts that one task scans whole: (doc_id, text)"""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        auto = automaton(MARKS)
        for b in batches:
            ids, texts = b.column(0).to_pylist(), _bytes(b.column(1))
            data, bounds = _joined(texts)
            scan = Scan(auto, data, bounds)
            state, units, before, count = scan.composed(np.zeros((len(texts), 1), np.uint8))
            n, marked = units[:, 0].tolist(), (state[:, 0] % auto.marks == auto.found).tolist()
            plans = [layout(i, k, m, *given) for i, k, m in zip(ids, n, marked, strict=True)]
            text, rank = np.repeat(np.arange(len(texts)), 2), np.array([r for _, x, y in plans for r in (x, y)], np.int64).reshape(-1)
            cut = np.diff(bounds)[text]
            inner = np.flatnonzero(rank < units[text, 0])
            cut[inner] = scan.places(text[inner], rank[inner], before, count) - bounds[text[inner]]
            cuts = cut.tolist()
            yield _rows([(i, k, form, t, cuts[2 * j], cuts[2 * j + 1]) for j, (i, k, (form, _, _), t) in enumerate(zip(ids, n, plans, texts, strict=True))], with_text)

    return run


def _cut(chunk: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(text_key, number, chunk)"""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for key, value in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                data = value.as_buffer()
                for k, at in enumerate(range(0, data.size, chunk)):
                    yield pa.RecordBatch.from_arrays([pa.array([key]), pa.array([k], pa.int64()), pa.array([data.slice(at, min(chunk, data.size - at)).to_pybytes()], pa.binary())], ["text_key", "number", "part"])

    return run


def _functions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(text_key, number, end state and units by start state, bytes) of each chunk"""
    auto = automaton(MARKS)
    for b in batches:
        data, bounds = _joined(_bytes(b.column(2)))
        every = np.tile(np.arange(auto.states, dtype=np.uint8), (len(b), 1))
        to, units, _, _ = Scan(auto, data, bounds).composed(every)
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(to.astype(np.int32).tolist(), pa.list_(pa.int32())), pa.array(units.tolist(), pa.list_(pa.int64())), pa.array(np.diff(bounds))], ["text_key", "number", "to", "units", "size"])


def _wanted(given: tuple[int, int, int]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The functions of a text's chunks composed, for each document of that text: (text_key, doc_id, n, form, which cut, number of its chunk, the chunk's entry state, rank in it, bytes before it). A cut at the text's end has no chunk."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        auto = automaton(MARKS)
        for b in batches:
            out = []
            for key, doc_id, chunks in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                state, n, size, entry = 0, 0, 0, []
                for c in sorted(chunks, key=lambda c: c["number"]):
                    entry.append((state, n, size))
                    state, n, size = c["to"][state], n + c["units"][state], size + c["size"]
                begun = np.array([e[1] for e in entry])
                form, *ranks = layout(doc_id, n, state % auto.marks == auto.found, *given)
                for which, r in enumerate(ranks):
                    k = int(np.searchsorted(begun, r, "right")) - 1
                    out.append((key, doc_id, n, form, which, -1, 0, 0, size) if r == n else (key, doc_id, n, form, which, k, entry[k][0], r - entry[k][1], entry[k][2]))
            yield pa.RecordBatch.from_pylist([dict(zip(_WANTED.names, r, strict=True)) for r in out], _WANTED)

    return run


_WANTED = pa.schema([("text_key", pa.string()), ("doc_id", pa.int64()), ("n", pa.int64()), ("form", pa.string()), ("which", pa.int32()), ("number", pa.int64()), ("state", pa.int32()), ("rank", pa.int64()), ("before", pa.int64())])


def _places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(text_key, doc_id, n, form, which, byte of the cut) of (text_key, doc_id, n, form, which, state, rank, before, part)"""
    auto = automaton(MARKS)
    for b in batches:
        data, bounds = _joined(_bytes(b.column(8)))
        scan = Scan(auto, data, bounds)
        state, rank, at = (np.asarray(b.column(i)) for i in (5, 6, 7))
        _, _, before, count = scan.composed(state.astype(np.uint8)[:, None])
        cut = at + scan.places(np.arange(len(b)), rank, before, count) - bounds[:-1]
        yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(5)), pa.array(cut, pa.int64())], ["text_key", "doc_id", "n", "form", "which", "at"])


def _large(with_text: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(doc_id, n, form, text, bytes of the prefix, of prefix and middle)"""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(len(b)):
                doc_id, n, form, a, z = (b.column(j)[i].as_py() for j in (0, 1, 2, 4, 5))
                yield _rows([(doc_id, n, form, b.column(3)[i].as_buffer().to_pybytes(), a, z)], with_text)

    return run


def fill_in_middle(docs: DataFrame, key: str = "doc_id", text: str = "text", seed: int = 7, rate: int = 100, spm: int = 50, with_text: bool = True, chunk: int = CHUNK) -> DataFrame:
    """Each whole text as prefix, suffix and middle, cut at lines.

    A text of n lines (runs up to and with a line feed, the last one perhaps without) is cut before two lines that the SHA-256 of `seed:doc_id` picks;
    `rate` of 100 documents are transformed, `spm` of 100 of them in the form suffix, prefix, middle, the others as prefix, suffix, middle.
    Returns, for each row, doc_id, n, form (psm, spm or plain), prefix_chars and middle_chars (code points; null if plain), the hashes of the output
    and of the text rebuilt from output and form, and with `with_text` the output. Null and empty texts, and texts that hold a mark, stay plain;
    a null doc_id counts as an empty one. Equal rows give equal results, rows of one id with several texts one result a text. Other columns,
    also of the names of results, are not read. An empty table gives no rows. Texts above `chunk` bytes are shared by several tasks, to the same result."""
    bound_batches(docs.sparkSession)
    given = (seed, rate, spm)
    out = _OUT + ", output string" * with_text
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    small = rows.where(F.octet_length("text") <= chunk).mapInArrow(released(_small(given, with_text)), out)
    large = rows.where(F.octet_length("text") > chunk).withColumn("text_key", F.concat(F.md5(F.col("text").cast("binary")), F.octet_length("text").cast("string")))
    texts = large.groupBy("text_key").agg(F.first("text").alias("text"))
    chunks = table(texts.mapInArrow(released(_cut(chunk)), "text_key string, number long, part binary").repartition("text_key", "number"))
    functions = chunks.mapInArrow(released(_functions), "text_key string, number long, to array<int>, units array<long>, size long")
    by_text = functions.groupBy("text_key").agg(F.collect_list(F.struct("number", "to", "units", "size")).alias("chunks"))
    asked = large.select("text_key", "doc_id").distinct().join(by_text, "text_key")
    kinds = "text_key string, doc_id long, n long, form string, which int, number long, state int, rank long, before long"
    wanted = table(asked.mapInArrow(released(_wanted(given)), kinds))
    inside = wanted.where("number >= 0").join(chunks, ["text_key", "number"]).select("text_key", "doc_id", "n", "form", "which", "state", "rank", "before", "part")
    found = inside.mapInArrow(released(_places), "text_key string, doc_id long, n long, form string, which int, at long")
    every = found.unionByName(wanted.where("number < 0").select("text_key", "doc_id", "n", "form", "which", F.col("before").alias("at")))
    cuts = table(every.groupBy("text_key", "doc_id", "n", "form").agg(F.min("at").alias("a"), F.max("at").alias("z")))
    drop(chunks, wanted)
    met = large.alias("l").join(cuts.alias("c"), (F.col("l.text_key") == F.col("c.text_key")) & F.col("l.doc_id").eqNullSafe(F.col("c.doc_id"))).select("l.doc_id", "c.n", "c.form", "l.text", "c.a", "c.z")
    return small.unionByName(met.mapInArrow(released(_large(with_text)), out))
