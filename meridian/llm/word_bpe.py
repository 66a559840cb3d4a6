"""BPE encoding and decoding over a table of distinct words.

1. Partitions count the words of their texts (after the tokenizer's normaliser and splitter); Spark sums them into one row a word.
2. Each distinct word is encoded once. The HOT most frequent words, a fixed number, are broadcast with their ids.
3. A text becomes the sequence of its words' numbers in that table; a word that isn't there leaves a hole, and goes as
   (row, position, word) to a join with the table of all words; the ids come back by position and fill the holes. The text is split once for
   both: the packed numbers and the holes' words cross one exchange, which is used twice.
4. Ids become pieces through the id-to-piece table, whose size the vocabulary fixes.

No row of texts is shuffled, only the packed numbers and the rare words. Rows are told apart by a number of their own, so equal rows neither share
a task nor multiply each other's holes. Inside a batch, Arrow splits the texts at white space and numbers the distinct pieces; Python sees each of these once.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections import Counter
from collections.abc import Callable, Iterator
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Regex, Tokenizer, normalizers, pre_tokenizers

from .common import bound_batches, kept, table, trimmed

#: Words that are broadcast: at most so many, each with its ids.
HOT = 1 << 18
#: A longer word is never broadcast.
HOT_CHARS = 64
#: Compresses the packed word numbers and the holes' words.
_ZSTD = pa.Codec("zstd", compression_level=1)
#: Bytes of texts, and words, that a worker handles at once; a single longer text is handled alone.
PART_BYTES, PART_WORDS = 2 << 20, 1 << 18


class Rules:
    """What a vocabulary file says of words: the splitter, the special strings with their ids, and the suffix that ends a word."""

    def __init__(self, path: str) -> None:
        spec = json.loads(Path(path).read_text())
        normal = [x["type"] for x in (spec["normalizer"] or {}).get("normalizers", [])]
        before = (spec["pre_tokenizer"] or {}).get("pretokenizers", [])
        added, model = spec["added_tokens"], spec["model"]
        if (
            normal != ["NFC", "Replace", "Lowercase"]
            or spec["normalizer"]["normalizers"][1] != {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}
            or [x["type"] for x in before] != ["Split", "ByteLevel"]
            or (before[0]["behavior"], before[0]["invert"]) != ("Removed", True)
            or before[1]["add_prefix_space"]
            or before[1]["use_regex"]
            or model["type"] != "BPE"
            or not model["end_of_word_suffix"]
            or spec["decoder"] is not None
            or any(x["normalized"] or x["lstrip"] or x["rstrip"] or x["single_word"] or not x["content"].startswith("<|") for x in added)
        ):
            raise ValueError(f"{path} isn't a word-level BPE file: NFC, white space to one space, lower case; a splitter that keeps its matches; byte-level pieces with a word end; no decoder")
        #: The library's own, for its tables of letters aren't those of Python or of other packages.
        self.normalizer = Tokenizer.from_file(path).normalizer
        self.splitter = pre_tokenizers.Split(Regex(before[0]["pattern"]["Regex"]), "removed", invert=True)
        self.ascii_word = regex.compile(before[0]["pattern"]["Regex"], regex.ASCII)
        self.special = {x["content"]: x["id"] for x in added}
        self.specials = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if added else regex.compile(r"(?!)()")
        self.suffix = model["end_of_word_suffix"]

    def _given(self, text: str) -> list[str]:
        return [w for w, _ in self.splitter.pre_tokenize_str(self.normalizer.normalize_str(text))]

    def words_of(self, pieces: list[str]) -> list[list[str]]:
        """The words of each piece between white space. ASCII pieces are split here; all others at once by the library, parted by spaces, which no word holds."""
        out: list[list[str]] = [[]] * len(pieces)
        beyond = []
        for i, p in enumerate(pieces):
            if p.isascii():
                p = p.lower()
                out[i] = [p] if p.isalpha() else self.ascii_word.findall(p)
            else:
                beyond.append(i)
        for s in range(0, len(beyond), 5000):
            some = beyond[s : s + 5000]
            text = self.normalizer.normalize_str(" ".join([pieces[i] for i in some]))
            ends = np.cumsum([len(x) + 1 for x in text.split(" ")])
            if len(ends) != len(some):  # a piece holds what the library takes for white space
                for i in some:
                    out[i] = self._given(pieces[i])
                continue
            found = self.splitter.pre_tokenize_str(text)
            cuts = np.searchsorted(np.array([at for _, (at, _) in found], np.int64), ends).tolist()
            words = [w for w, _ in found]
            for i, a, b in zip(some, [0, *cuts], cuts):  # noqa: B905
                out[i] = words[a:b]
        return out

    def split(self, text: str) -> list[str]:
        """The words that the tokenizer's normaliser and splitter make of a text; special strings stand for themselves."""
        if plain(text):
            return [w for words in self.words_of(text.split()) for w in words]
        return [w for part in self.specials.split(text) for w in ([part] if part in self.special else self._given(part))]


@lru_cache(2)
def rules(path: str) -> Rules:
    return Rules(path)


#: White space of Python's split() that the splitter takes for ordinary characters.
_ODD = "\x1c\x1d\x1e\x1f"


def plain(text: str) -> bool:
    """Whether white space alone parts the text into pieces whose words can be found one by one."""
    return "<|" not in text and not any(c in text for c in _ODD)


@lru_cache(2)
def word_encoder(path: str) -> Tokenizer:
    """The tokenizer for words that split() has made, with a space between them."""
    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True
    t.normalizer = normalizers.Sequence([])
    t.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
    return t


@lru_cache(2)
def pieces(path: str) -> list[str]:
    t = Tokenizer.from_file(path)
    return [t.id_to_token(i) or "" for i in range(t.get_vocab_size())]


@lru_cache(2)
def _ends(path: str) -> np.ndarray:
    """Whether an id ends a word."""
    return np.array([p.endswith(rules(path).suffix) for p in pieces(path)])


@lru_cache(2)
def id_type(path: str) -> np.dtype:
    """Ids are joined as packed bytes, two or four each as the vocabulary's size needs."""
    return np.dtype("<u2" if len(pieces(path)) <= 1 << 16 else "<u4")


def encode_words(path: str, words: list[str]) -> list[bytes]:
    """The packed ids of each word. The words are encoded in one string; where the word ends don't tell them apart, one by one."""
    t, special, kind = word_encoder(path), rules(path).special, id_type(path)
    given = [w for w in words if w not in special]
    ids = np.array(t.encode_batch_fast([" ".join(given)], add_special_tokens=False)[0].ids, kind)
    cut = np.flatnonzero(_ends(path)[ids]) + 1
    if len(cut) == len(given) and (not len(cut) or cut[-1] == len(ids)):
        raw, at = ids.tobytes(), [0, *(cut * kind.itemsize).tolist()]
        found = iter([raw[a:b] for a, b in zip(at, at[1:])])  # noqa: B905
    else:
        found = iter([np.array(e.ids, kind).tobytes() for e in t.encode_batch_fast(given, add_special_tokens=False)])
    return [np.array([special[w]], kind).tobytes() if w in special else next(found) for w in words]


def parts(column: pa.Array, most: int = PART_BYTES) -> Iterator[tuple[int, list[str]]]:
    """(first row, texts) of runs of rows that hold about `most` bytes; null counts as empty."""
    size = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(column), 0)).astype(np.int64))
    at = 0
    while at < len(column):
        to = max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + most, "right")))
        yield at, [x or "" for x in column.slice(at, to - at).to_pylist()]
        at = to


def pieces_of(texts: list[str]) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """(number of each piece between white space, bounds of the texts, the distinct pieces); a piece may be empty."""
    lists = pc.utf8_split_whitespace(pa.array(texts, pa.large_string()))
    found = lists.flatten().dictionary_encode()
    bounds = np.asarray(lists.offsets).astype(np.int64)
    return np.asarray(found.indices), bounds - bounds[0], found.dictionary.to_pylist()


def _counts(path: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = rules(path)
        seen: Counter[str] = Counter()
        odd: Counter[str] = Counter()

        def flush() -> pa.RecordBatch:
            for n, words in zip(list(seen.values()), r.words_of(list(seen)), strict=True):
                for w in words:
                    odd[w] += n
            out = pa.RecordBatch.from_arrays([pa.array(list(odd), pa.string()), pa.array(list(odd.values()), pa.int64())], ["word", "n"])
            seen.clear()
            odd.clear()
            return out

        for b in batches:
            for value in b.column(0):
                text = value.as_py() or ""
                if plain(text):
                    seen.update(text.split())
                else:
                    odd.update(r.split(text))
                if len(seen) + len(odd) > 400_000:
                    yield flush()
        yield flush()

    return run


def _encode(path: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for s in range(0, len(b), 2000):
                part = b.slice(s, 2000)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(encode_words(path, part.column(0).to_pylist()), pa.binary())], ["word", "n", "ids"])

    return run


def _squeeze(raw: bytes) -> bytes:
    return len(raw).to_bytes(8, "little") + _ZSTD.compress(raw, asbytes=True)


def _unsqueeze(packed: pa.Buffer) -> pa.Buffer:
    return _ZSTD.decompress(packed[8:], int.from_bytes(packed[:8].to_pybytes(), "little"))


def _pack(code: np.ndarray) -> bytes:
    """Word numbers below 2**24 as the planes of their three bytes, compressed."""
    return _squeeze(code.astype("<u4").view(np.uint8).reshape(-1, 4)[:, :3].T.tobytes())


def _unpack(packed: pa.Buffer) -> np.ndarray:
    planes = np.frombuffer(_unsqueeze(packed), np.uint8).astype(np.int32).reshape(3, -1)
    return planes[0] | planes[1] << 8 | planes[2] << 16


def spread(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """start[0], start[0] + 1, ... (size[0] of them), start[1], ..."""
    end = np.cumsum(size)
    return np.repeat(start - (end - size), size) + np.arange(end[-1] if len(end) else 0)


def codes(texts: list[str], known: dict[str, int], r: Rules) -> list[tuple[np.ndarray, list[str]]]:
    """Of each text its words' numbers and the words of its holes; the number len(known) stands for a word that isn't known."""
    hole = len(known)
    out: list[tuple[np.ndarray, list[str]]] = [(np.zeros(0, np.int64), [])] * len(texts)
    easy = [i for i, t in enumerate(texts) if plain(t)]
    at, bounds, names = pieces_of([texts[i] for i in easy])
    split = r.words_of(names)
    size = np.array([len(w) for w in split], np.int64)
    words = [w for x in split for w in x]
    number = [known.get(w, hole) for w in words]
    where = spread((np.cumsum(size) - size)[at], size[at])
    number = np.array(number, np.int64)
    code = number[where] if len(where) else np.zeros(0, np.int64)
    holes = np.flatnonzero(code == hole)
    rare = [words[p] for p in where[holes].tolist()]
    ends = np.concatenate(([0], np.cumsum(size[at])))[bounds]
    cuts = np.searchsorted(holes, ends).tolist()
    ends = ends.tolist()
    for k, i in enumerate(easy):
        out[i] = code[ends[k] : ends[k + 1]], rare[cuts[k] : cuts[k + 1]]
    for i, t in enumerate(texts):
        if not plain(t):
            w = r.split(t)
            x = np.array([known.get(y, hole) for y in w], np.int64)
            out[i] = x, [w[p] for p in np.flatnonzero(x == hole).tolist()]
    return out


def _packed(path: str, hot) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:  # noqa: ANN001
    """(row_key, doc_id, packed word numbers, words of the holes in their order; a word has no line break). hot: a broadcast of (name, words joined by line breaks)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, joined = hot.value
        known = kept((name, "known"), lambda: {w: i for i, w in enumerate(joined.split("\n") if joined else [])})
        for b in batches:
            for at, texts in parts(b.column(1)):
                found = codes(texts, known, rules(path))
                packed = [pa.array(x, pa.binary()) for x in ([_pack(c) for c, _ in found], [_squeeze("\n".join(w).encode()) for _, w in found])]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(at, len(texts)), b.column(2).slice(at, len(texts)), *packed], ["row_key", "doc_id", "codes", "rare"])

    return run


def _holes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(row_key, position among the row's holes, word)"""
    for b in batches:
        row, at, words = [], [], []
        for i, x in enumerate(b.column(3)):
            text = _unsqueeze(x.as_buffer()).to_pybytes().decode()
            if text:
                w = text.split("\n")
                row += [i] * len(w)
                at += range(len(w))
                words += w
        yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(row, pa.int64())), pa.array(at, pa.int32()), pa.array(words, pa.string())], ["row_key", "position", "word"])


class Shown:
    """Ids of a list of words: as numbers, as decimal text, and as pieces, each joined by a space."""

    def __init__(self, path: str, ids: np.ndarray, size: np.ndarray) -> None:
        self.ids, self.size = ids, size
        self.start = np.cumsum(size) - size
        bounds = pa.array(np.concatenate(([0], np.cumsum(size))).astype(np.int64))
        joined = lambda names: pc.binary_join(pa.LargeListArray.from_arrays(bounds, names.take(pa.array(ids))), pa.scalar(" ", pa.large_string()))
        self.text = joined(pa.array([str(i) for i in range(len(pieces(path)))], pa.large_string()))
        self.pieces = joined(pa.array(pieces(path), pa.large_string()))


def _sha(joined: pa.Array) -> pa.Array:
    return pa.array([hashlib.sha256(x.as_buffer()).hexdigest() for x in joined], pa.string())


def _assemble(path: str, hot, with_ids: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:  # noqa: ANN001
    """hot: a broadcast of (name, ids of all known words, ids of each)"""
    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids"][: 4 + with_ids]

    def solve(ids: pa.Array, word: list[np.ndarray], filled: list[list[bytes]], known: Shown) -> pa.RecordBatch:
        code, rare = np.concatenate(word).astype(np.int64), [x for row in filled for x in row]
        hole = len(known.size)
        code[code == hole] = hole + np.arange(len(rare))
        kind = id_type(path)
        own = Shown(path, np.frombuffer(b"".join(rare), kind), np.array([len(x) // kind.itemsize for x in rare], np.int64))
        size = np.concatenate((known.size, own.size))[code]
        bounds = np.concatenate(([0], np.cumsum([len(w) for w in word])))
        n = np.diff(np.concatenate(([0], np.cumsum(size)))[bounds])
        full = size > 0  # a word without ids shows nothing
        if not full.all():
            bounds, code, size = np.concatenate(([0], np.cumsum(full)))[bounds], code[full], size[full]
        at, index = pa.array(bounds.astype(np.int64)), pa.array(code)
        joined = lambda x, y: pc.binary_join(pa.LargeListArray.from_arrays(at, pa.concat_arrays([x, y]).take(index)), pa.scalar(" ", pa.large_string()))
        columns = [ids, pa.array(n), _sha(joined(known.text, own.text)), _sha(joined(known.pieces, own.pieces))]
        if with_ids:
            start = np.concatenate((known.start, len(known.ids) + own.start))[code]
            flat = np.concatenate((known.ids, own.ids))[spread(start, size)].astype(np.int32)
            columns.append(pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(n))).astype(np.int32)), pa.array(flat)))
        return pa.RecordBatch.from_arrays(columns, names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, ids, size = hot.value
        known = kept((name, "shown"), lambda: Shown(path, ids, size))
        for b in batches:
            at, word, filled, held = 0, [], [], 0
            for i in range(len(b)):
                word.append(_unpack(b.column(1)[i].as_buffer()))
                rare: list[bytes] = []
                if b.column(2)[i].is_valid:
                    position, found = (x.to_pylist() for x in b.column(2)[i].values.flatten())
                    rare = [x for _, x in sorted(zip(position, found, strict=True))]
                filled.append(rare)
                held += len(word[-1])
                if held > PART_WORDS or i == len(b) - 1:
                    yield solve(b.column(0).slice(at, len(word)), word, filled, known)
                    at, word, filled, held = i + 1, [], [], 0

    return run


def encode_texts(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", hot_words: int = HOT, with_ids: bool = True) -> DataFrame:
    """Encode every whole text as the library's encode(text, add_special_tokens=False) does, and decode the ids.

    path: a word-level BPE file of the tokenizers library (lower case, words end in a suffix, no decoder); another kind of file raises ValueError.
    Returns, for each row, doc_id, n_tokens, ids_sha256 (decimal ids joined by one space), decoded_sha256 (decode(ids,
    skip_special_tokens=False)) and, unless with_ids is false, ids. A null text is empty: no ids, hashes of the empty string. Special
    strings in a text become their ids. Repeated rows give repeated results; a null doc_id keeps its row. Other columns, also of the names
    of results, are not read. An empty table gives no rows."""
    spark = docs.sparkSession
    rules(path)
    bound_batches(spark)
    texts = docs.select(F.col(text).cast("string").alias("text"), F.col(key).cast("long").alias("doc_id"))
    counted = texts.select("text").mapInArrow(trimmed(_counts(path)), "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    words = table(counted.mapInArrow(trimmed(_encode(path)), "word string, n long, ids binary"), "zstd")
    top = words.where(F.length("word") <= HOT_CHARS).orderBy(F.desc("n"), "word").limit(hot_words).select("word", "ids").toArrow()
    packed_ids, kind, name = top.column("ids").to_pylist(), id_type(path), uuid.uuid4().hex
    known = spark.sparkContext.broadcast((name, "\n".join(top.column("word").to_pylist())))
    known_ids = spark.sparkContext.broadcast((name, np.frombuffer(b"".join(packed_ids), kind), np.array([len(x) // kind.itemsize for x in packed_ids], np.int64)))
    # Both uses below read all columns of `packed`, so that its exchange is made once and used twice. A row's number follows from its place in the input.
    numbered = texts.select(F.monotonically_increasing_id().alias("row_key"), "text", "doc_id")
    packed = numbered.mapInArrow(trimmed(_packed(path, known)), "row_key long, doc_id long, codes binary, rare binary").repartition("row_key")
    holes = packed.mapInArrow(trimmed(_holes), "row_key long, position int, word string")
    filled = holes.join(words.select("word", "ids"), "word").groupBy("row_key").agg(F.collect_list(F.struct("position", "ids")).alias("filled"))
    both = packed.join(filled, "row_key", "left").select("doc_id", "codes", "filled", "rare", "row_key")
    return both.mapInArrow(trimmed(_assemble(path, known_ids, with_ids)), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids)
