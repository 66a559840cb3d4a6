"""Token counts of whole texts; huge texts are encoded in overlapping chunks that are spliced.

A chunk's first and last words may be cut, but a token start just after white space is stable: the tokenizer's words and special
strings hold no white space, so nothing before such a place changes the tokens after it. Two neighbouring chunks are spliced at the first
place in their overlap that is stable and starts a token in both, and where both agree on all tokens from there to the last stable place. If
there is none (an overlap without white space), the text's chunks and overlaps are widened, up to the whole text.
"""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .common import bound_batches, kept, released, table
from .word_bpe import parts, plain, rules

CHUNK, OVERLAP, WIDEN = 32_768, 512, 8


@lru_cache(2)
def tokenizer(path: str) -> Tokenizer:
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    return t


#: Pieces between white space whose numbers of tokens a worker remembers: so many new ones, and as many from before.
MEMO = 250_000


def sizes(t: Tokenizer, path: str, pieces: list[str]) -> list[int]:
    """The number of tokens of each piece. They are encoded in one string, parted by a special string, which nothing reaches across."""
    special = rules(path).special
    if not special:
        return [len(e) for e in t.encode_batch_fast(pieces, add_special_tokens=False)]
    mark, number = next(iter(special.items()))
    ids = np.array(t.encode_batch_fast([mark.join([*pieces, ""])], add_special_tokens=False)[0].ids)
    return (np.diff(np.flatnonzero(ids == number), prepend=-1) - 1).tolist()


def count_pieces(t: Tokenizer, path: str, texts: list[str], memo: list[dict[str, int]]) -> list[int]:
    """The number of tokens of each text. White space is stable, so a text has the tokens of its pieces; each new piece is encoded once. A text with what may be a special string, or with white space that the tokenizer doesn't know as such, is encoded whole."""
    easy = [plain(x) for x in texts]
    found = [x.split() if p else [] for x, p in zip(texts, easy, strict=True)]
    young, old = memo
    new = set().union(*found).difference(young)
    young.update({x: old[x] for x in new if x in old})
    new = list(new.difference(young))
    for s in range(0, len(new), 2000):
        young.update(zip(new[s : s + 2000], sizes(t, path, new[s : s + 2000]), strict=True))
    out = [sum(map(young.__getitem__, x)) if p else len(t.encode(text, add_special_tokens=False)) for text, x, p in zip(texts, found, easy, strict=True)]
    if len(young) > MEMO:
        memo[:] = {}, young
    return out


def _whole(path: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t, memo = tokenizer(path), kept(("token counts", path), lambda: [{}, {}])
        for b in batches:
            for at, texts in parts(b.column(2), 1 << 20):
                yield pa.RecordBatch.from_arrays([b.column(0).slice(at, len(texts)), b.column(1).slice(at, len(texts)), pa.array(count_pieces(t, path, texts, memo), pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    return run


def _chunks(chunk: int, overlap: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(text_key, number, start, whether it is the last, chunk)"""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(len(b)):
                key, text = b.column(0)[i].as_py(), b.column(1)[i].as_py()
                for k, s in enumerate(range(0, max(1, len(text) - overlap), chunk)):
                    part = text[s : s + chunk + overlap]
                    yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (key, k, s, s + len(part) >= len(text), part)], ["text_key", "k", "start", "last", "chunk"])

    return run


def edges(text: str, ids: list[int], offsets: list[tuple[int, int]], overlap: int, first: bool, last: bool) -> tuple[list[int], list[int], list[int], list[int]]:
    """Stable places of a chunk's left and right overlap, from the chunk's and from the overlap's start, as (places, tokens before them); then the ids in both overlaps by place are compared by splice()."""
    places, before = [], []
    seen = -1
    for i, (s, _) in enumerate(offsets):
        if s != seen and s > 0 and text[s - 1] in " \t\n\r":
            places.append(s)
            before.append(i)
        seen = s
    cut = len(text) - overlap
    left = [(p, i) for p, i in zip(places, before, strict=True) if p < overlap] if not first else []
    right = [(p - cut, i) for p, i in zip(places, before, strict=True) if p >= cut] if not last else []
    return [p for p, _ in left], [i for _, i in left], [p for p, _ in right], [i for _, i in right]


def _encode_chunks(path: str, overlap: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Of each chunk the number of tokens, and of its overlaps the stable places, the tokens before them (right: less all tokens) and the ids between the first and the last of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = tokenizer(path)
        for b in batches:
            for i in range(len(b)):
                key, k, last, text = (b.column(c)[i].as_py() for c in (0, 1, 3, 4))
                e = t.encode(text, add_special_tokens=False)
                ids = e.ids
                lp, lb, rp, rb = edges(text, ids, e.offsets, overlap, k == 0, last)
                left = {"places": lp, "before": lb, "ids": ids[lb[0] : lb[-1]] if lb else []}
                right = {"places": rp, "before": [x - len(ids) for x in rb], "ids": ids[rb[0] : rb[-1]] if rb else []}
                yield pa.RecordBatch.from_arrays([pa.array([key]), pa.array([k], pa.int64()), pa.array([len(ids)], pa.int64()), pa.array([left], _EDGE), pa.array([right], _EDGE)], ["text_key", "k", "n", "left", "right"])

    return run


_EDGE = pa.struct([("places", pa.list_(pa.int32())), ("before", pa.list_(pa.int32())), ("ids", pa.list_(pa.int32()))])


def splice(right: dict, left: dict) -> tuple[int, int] | None:
    """Of the first proven common boundary of an overlap: minus the tokens of the earlier chunk after it, and the tokens of the later chunk before it; None if there is none."""
    common = sorted(set(right["places"]) & set(left["places"]))
    if not common:
        return None
    first, end = common[0], common[-1]
    at = lambda side, p: side["before"][side["places"].index(p)]
    ids = lambda side: side["ids"][at(side, first) - side["before"][0] : at(side, end) - side["before"][0]]
    if ids(right) != ids(left) or [p for p in right["places"] if first <= p <= end] != [p for p in left["places"] if first <= p <= end]:
        return None
    return at(right, first), at(left, first)


def _join_chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Neighbouring chunks' edges to the change of the text's count, null where they can't be aligned."""
    for b in batches:
        out = []
        for n, left, right in zip(*(b.column(c).to_pylist() for c in (1, 2, 3)), strict=True):
            if right is None:
                out.append(n)
            else:
                cut = splice(right, left)
                out.append(None if cut is None else n + cut[0] - cut[1])
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.int64())], ["text_key", "n"])


def count_tokens(docs: DataFrame, path: str, limit: int = 2048, key: str = "doc_id", text: str = "text", chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """Count the tokens of every whole text as the tokenizers library's encode(text, add_special_tokens=False) gives them.

    path: a word-level file of that library, whose words hold no white space; another kind of file raises ValueError. Returns, for each row, doc_id, n_bytes (UTF-8), n_tokens and
    over_limit (n_tokens > limit). A null text is empty: 0 bytes, 0 tokens. Repeated rows give repeated results; a null doc_id keeps its row.
    Texts of more than two chunks are cut into chunks, which are encoded as rows of their own; their count is the same. Other columns are
    not read. An empty table gives no rows."""
    rules(path)
    bound_batches(docs.sparkSession)
    docs = docs.select(F.col(key).cast("long").alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    docs = docs.withColumn("n_bytes", F.octet_length("text").cast("long"))
    huge = F.length("text") > 2 * chunk
    whole = docs.where(~huge).select("doc_id", "n_bytes", "text").mapInArrow(_whole(path), "doc_id long, n_bytes long, n_tokens long")
    long_docs = docs.where(huge).withColumn("text_key", F.md5(F.col("text").cast("binary")))
    long_texts = long_docs.select("text_key", "text")
    solved, todo, step, width = None, long_texts, chunk, overlap
    edge = "struct<places:array<int>,before:array<int>,ids:array<int>>"
    most = long_docs.agg(F.max(F.length("text"))).first()[0]
    while most is not None:
        parts = todo.mapInArrow(_chunks(step, width), "text_key string, k long, start long, last boolean, chunk string").dropDuplicates(["text_key", "k"])
        found = table(parts.mapInArrow(_encode_chunks(path, width), f"text_key string, k long, n long, left {edge}, right {edge}"))
        before = found.select("text_key", (F.col("k") + 1).alias("k"), F.col("right").alias("prior"))
        pairs = found.join(before, ["text_key", "k"], "left").select("text_key", "n", "left", F.col("prior").alias("right"))
        counts = pairs.mapInArrow(_join_chunks, "text_key string, n long").groupBy("text_key").agg(F.sum("n").alias("n_tokens"), F.bool_and(F.col("n").isNotNull()).alias("whole"))
        counts = table(counts)
        good = counts.where("whole").select("text_key", "n_tokens")
        solved = good if solved is None else solved.unionByName(good)
        if step + width >= most or not counts.where("not whole").limit(1).count():
            break
        todo = long_texts.join(counts.where("not whole").select("text_key"), "text_key", "left_semi")
        step, width = step * WIDEN, width * WIDEN * WIDEN
    if solved is not None:
        whole = whole.unionByName(long_docs.select("text_key", "doc_id", "n_bytes").join(solved, "text_key").select("doc_id", "n_bytes", "n_tokens"))
    return whole.withColumn("over_limit", F.col("n_tokens") > limit)
