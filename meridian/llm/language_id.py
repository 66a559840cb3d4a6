"""Language identification by nearest centroids of TF-IDF vectors of hashed byte n-grams.

Document frequencies are counted over all training rows. Centroids are fitted on a sample of about SAMPLE distinct texts a language (all, if it has no
more), the bound of what the driver holds: the share drawn by the hash of the text comes from the number of distinct texts, so copies change nothing. Each language has up to CENTROIDS of them (spherical k-means). A text takes the language of the centroid with the
highest cosine and is rejected if even this one is farther than REJECT allows, or than texts of that language with as many distinct n-grams
are: each half of a language's sample, whole and cut to first characters, is held against centroids of the other halves, and MARGIN times the
LOW quantile of these cosines is the least for its band of n-grams (octaves). Languages of fewer than LEAST sampled texts have REJECT only.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, forget, released, table
from .kernels import U64, mix, text_parts

#: Buckets of hashed n-grams; training texts a language; centroids a language.
BUCKETS, SAMPLE, CENTROIDS = 4096, 400, 4
#: The least cosine that isn't rejected, for texts of any length.
REJECT = 0.08
#: Rejection by length: characters that sampled texts are cut to, quantile of their cosines and share of it, texts a language, cosines a band.
CUTS, LOW, MARGIN, LEAST, BAND_LEAST = tuple(1 << i for i in range(3, 14)), 0.01, 0.5, 16, 10
UND = "und"
#: ASCII letters and all bytes of other characters stay; the rest parts words.
_LETTER = np.array([c if c >= 128 or 97 <= c <= 122 else 32 for c in range(256)], np.uint8)


def _grams(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Counts of hashed n-grams (1 to 3 bytes) of each row, rows x BUCKETS."""
    rows = len(offsets) - 1
    x = _LETTER[data]
    keep = np.ones(len(x), bool)
    keep[1:] = (x[1:] != 32) | (x[:-1] != 32)
    row = np.repeat(np.arange(rows), np.diff(offsets))[keep]
    x = x[keep].astype(U64)
    out = np.zeros(rows * BUCKETS, np.int64)
    for n in (1, 2, 3):
        m = max(0, len(x) - n + 1)
        code = np.full(m, n, U64)
        for i in range(n):
            code = code * U64(256) + x[i : i + m]
        inside = row[:m] == row[n - 1 : n - 1 + m]
        bucket = (mix(code) & U64(BUCKETS - 1)).astype(np.int64) + row[:m] * BUCKETS
        out += np.bincount(bucket[inside], minlength=rows * BUCKETS)
    return out.reshape(rows, BUCKETS)


def _parts(column: pa.Array) -> Iterator[tuple[int, np.ndarray]]:
    for at, data, offsets in text_parts(pc.utf8_lower(column), most=1 << 19, rows=256):
        yield at, _grams(data, offsets)


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(BUCKETS + 1, np.int64)
    for b in batches:
        for _, counts in _parts(b.column(0)):
            total[:BUCKETS] += (counts > 0).sum(0)
            total[BUCKETS] += len(counts)
    used = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], ["bucket", "n"])


def _vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for at, counts in _parts(b.column(1)):
            yield pa.RecordBatch.from_arrays([b.column(0).slice(at, len(counts)), pa.array([r.tobytes() for r in counts.astype(np.uint32)], pa.binary()), b.column(2).slice(at, len(counts))], ["lang", "counts", "half"])


def weighted(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    x = np.log1p(counts.astype(np.float32)) * idf
    return x / np.maximum(np.sqrt((x * x).sum(1, keepdims=True)), 1e-12)


def cluster(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Spherical k-means from the row nearest the mean and the rows farthest from those chosen."""
    picked = [int(np.argmax(x @ x.mean(0)))]
    while len(picked) < min(k, len(x)):
        best = (x @ x[picked].T).max(1)
        if best.min() > 1 - 1e-6:
            break
        picked.append(int(np.argmin(best)))
    centres = x[picked]
    for _ in range(rounds):
        near = np.argmax(x @ centres.T, 1)
        centres = np.stack([x[near == i].mean(0) if (near == i).any() else c for i, c in enumerate(centres)])
        centres /= np.maximum(np.sqrt((centres * centres).sum(1, keepdims=True)), 1e-12)
    return centres


def band(counts: np.ndarray) -> np.ndarray:
    """The octave of the number of distinct n-grams of each row."""
    return np.log2(np.maximum((counts > 0).sum(1), 1)).astype(np.int64)


def _cosines(model) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:  # noqa: ANN001
    """(lang, band, cosine with the nearest centroid of the other halves) of every text, whole and cut."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        idf, others = model.value
        for b in batches:
            for cut in (*CUTS, None):
                part = b if cut is None else b.filter(pc.greater(pc.utf8_length(b.column(1)), cut))
                text = part.column(1) if cut is None else pc.utf8_slice_codeunits(part.column(1), 0, cut)
                lettered = pc.match_substring_regex(text, r"\pL")
                part, text = part.filter(lettered), text.filter(lettered)
                half = part.column(2).to_numpy(zero_copy_only=False)
                for at, counts in _parts(text):
                    x, own = weighted(counts, idf), half[at : at + len(counts)]
                    near = np.where(own == 0, (x @ others[0].T).max(1), (x @ others[1].T).max(1))
                    yield pa.RecordBatch.from_arrays([part.column(0).slice(at, len(x)), pa.array(band(counts)), pa.array(near.astype(np.float64))], ["lang", "band", "score"])

    return run


def limits(scores, langs: list[str]) -> np.ndarray:  # noqa: ANN001
    """The least cosine by language and band, 0 where there is none; it never falls with the number of n-grams."""
    out = np.zeros((len(langs), BUCKETS.bit_length()))
    for (lang, at), part in scores.groupby(["lang", "band"]):
        if len(part) >= BAND_LEAST:
            out[langs.index(lang), at] = MARGIN * part["score"].quantile(LOW)
    return np.maximum.accumulate(out, 1)


RESULTS = ("held_out", "lang_pred", "score", "rejected")


def _predict(model) -> Callable[[Iterator[pa.Array]], Iterator[pa.Array]]:  # noqa: ANN001
    """A struct of lang_pred, score and far, whether the score is below the least for the language and length, of each text."""

    def run(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        forget()
        idf, names, centres, least = model.value
        names = np.array(names, object)
        for column in texts:
            langs, scores, far = [], [np.zeros(0)], [np.zeros(0, bool)]
            for _, counts in _parts(column):
                near = weighted(counts, idf) @ centres.T
                best = near.argmax(1)
                score = np.clip(near[np.arange(len(best)), best].astype(np.float64), 0, 1)
                langs += names[best].tolist()
                scores.append(score)
                far.append(score < least[best, band(counts)])
            yield pa.StructArray.from_arrays([pa.array(langs, pa.string()), pa.array(np.concatenate(scores)), pa.array(np.concatenate(far))], ["lang_pred", "score", "far"])

    return run


def held_out(key: str = "doc_id") -> Column:
    """Rows that are never learned from: crc32 of the id as text is 1 modulo 3, or the id is null."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 3 == 1, F.lit(True))


def fit(docs: DataFrame):  # noqa: ANN201
    """(idf, language of each centroid, centroids, least cosine of each centroid by band) of the labelled rows that aren't held out; None without such rows."""
    train = docs.where(~held_out() & F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}")).select("lang", "text")
    pick = F.shiftrightunsigned(F.xxhash64("text", F.lit(7)), 11)  # 53 bits
    counts = train.select("lang", pick.alias("pick")).distinct().groupBy("lang").count().orderBy("lang").toPandas()
    if counts.empty:
        return None
    share = F.lit(0.0)
    for lang, n in zip(counts["lang"], counts["count"], strict=True):
        share = F.when(F.col("lang") == lang, min(1.0, SAMPLE / n) * 2.0**53).otherwise(share)
    half = F.pmod(F.xxhash64("text", F.lit(8)), F.lit(2)).cast("int").alias("half")
    sample = table(train.where(pick < share).dropDuplicates(["lang", "text"]).select("lang", "text", half))
    rows = sample.mapInArrow(released(_vectors), "lang string, counts binary, half int").toPandas()
    frequency = train.select("text").mapInArrow(released(_frequencies), "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toPandas()
    seen = np.zeros(BUCKETS + 1)
    seen[frequency["bucket"]] = frequency["n"]
    idf = np.log((1 + seen[BUCKETS]) / (1 + seen[:BUCKETS])).astype(np.float32) + np.float32(0.1)
    names, centres, others = [], [], ([], [])
    for lang, part in rows.groupby("lang", sort=True):
        part = part.sort_values("counts")
        x = weighted(np.stack([np.frombuffer(r, np.uint32) for r in part["counts"]]), idf)
        found = cluster(x, CENTROIDS)
        names += [lang] * len(found)
        centres.append(found)
        for half, other in enumerate(others):
            rest = (part["half"] != half).to_numpy()
            if len(x) >= LEAST and rest.any():
                other.append(cluster(x[rest], CENTROIDS))
    if not names:
        return None
    least = np.zeros((len(names), BUCKETS.bit_length()))
    if all(others):
        shared = docs.sparkSession.sparkContext.broadcast((idf, [np.concatenate(x).astype(np.float32) for x in others]))
        scores = sample.mapInArrow(released(_cosines(shared)), "lang string, band long, score double").toPandas()
        size = rows.groupby("lang").size()
        langs = sorted(set(names))
        least = limits(scores[scores["lang"].isin(size[size >= LEAST].index)], langs)[[langs.index(x) for x in names]]
    return idf, names, np.concatenate(centres).astype(np.float32), least


def identify(docs: DataFrame, train: DataFrame | None = None, keep: list[str] | None = None, reject: float = REJECT) -> DataFrame:
    """Predict the language of every whole text; lang, source and doc_id are not inputs.

    Learns from `train` (docs if None; columns doc_id, text, lang). Returns the columns `keep` (doc_id if None; one named as a result is left out),
    held_out, lang_pred, score (cosine with the nearest centroid, 0 to 1) and rejected. lang_pred is `und`, score 0, and the row rejected if the
    text is null or has no letter, or if nothing could be learned; else it is a learned value, and rejected tells that the cosine is below `reject`
    or below the least learned for the language and the number of distinct n-grams. Ties go to the first language. Repeated rows give
    repeated results. Rows with a null id or lang are predicted but not learned from. An empty table gives no rows. The text goes to Python
    once and doesn't come back."""
    keep = [c for c in (["doc_id"] if keep is None else keep) if c not in RESULTS]
    spark = docs.sparkSession
    bound_batches(spark)
    model = fit((docs if train is None else train).select("doc_id", "text", "lang"))
    if model is None:
        return docs.select(*keep, held_out().alias("held_out"), F.lit(UND).alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(True).alias("rejected"))
    predict = F.arrow_udf(_predict(spark.sparkContext.broadcast(model)), "struct<lang_pred:string,score:double,far:boolean>").asNondeterministic()  # evaluated once a row
    has_letter = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))
    found = docs.select(*keep, held_out().alias("held_out"), has_letter.alias("meridian_letter"), predict(F.coalesce("text", F.lit(""))).alias("meridian_found"))
    known = F.col("meridian_letter")
    score = F.when(known, F.col("meridian_found.score")).otherwise(0.0)
    return found.select(*keep, "held_out", F.when(known, F.col("meridian_found.lang_pred")).otherwise(UND).alias("lang_pred"), score.alias("score"), (~known | (score < reject) | F.col("meridian_found.far")).alias("rejected"))
