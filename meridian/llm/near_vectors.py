"""Near duplicates among embeddings of one label by int8 tile products with rigorous error bounds.

Equal vectors of a label are one class with a count. Classes of a label are laid in tiles of at most TILE vectors, close ones together. A pair of
tiles is skipped if their boxes of rotated components are too far apart for the threshold. A pair of tiles is multiplied in int8 (exact
in float32 up to 2**24); each vector's own quantisation error, measured in double, bounds the error of the product, and only pairs that the
bound leaves open are computed in double. What a pair of tiles gives are link counts and a spanning forest of its links, never all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import components, table
from .vectors import matrix

TILE = 1024
#: Random directions whose cell orders the vectors of a label, and whose values bound the distance of tiles.
DIRECTIONS = 12


#: Components whose int8 products add up exactly in float32.
EXACT_DIM = 2**24 // 127**2


def directions(dim: int) -> np.ndarray:
    """Orthonormal directions, the same everywhere."""
    return np.linalg.qr(np.random.default_rng(20).standard_normal((dim, min(dim, DIRECTIONS))))[0]


def _units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Valid vectors with the key of their exact components and the first directions' values of the unit vector."""
    for b in batches:
        sizes = np.asarray(b.column(2).value_lengths().fill_null(0))
        for d in np.unique(sizes[sizes > 0]).tolist():
            keep = np.flatnonzero(sizes == d)
            part = b.take(pa.array(keep))
            rows, x = matrix(part.column(2), d)
            # Scaled by powers of two, which changes no cosine, so that squares neither overflow nor vanish.
            x = np.ldexp(x, -np.frexp(np.abs(x).max(1, keepdims=True))[1])
            x = np.where(x == 0, 0.0, x)
            norm = np.sqrt((x * x).sum(1))
            good = (norm > 0) & np.isfinite(norm)
            rows, x, norm = rows[good], x[good], norm[good]
            cell = np.zeros(len(x), np.int64)
            value = (x / norm[:, None]) @ directions(d)
            for i in range(min(value.shape[1], 8)):
                cell = cell * 2 + (value[:, i] > 0)
            raw = [r.tobytes() for r in x]
            yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(rows)), part.column(1).take(pa.array(rows)), pa.array(raw, pa.binary()), pa.array(cell)], ["vec_id", "label", "raw", "cell"])


def _pack(rows: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    raw = rows.column("raw").to_pylist()
    return np.asarray(rows.column("cls")), np.asarray(rows.column("copies")), np.frombuffer(b"".join(raw), np.float64).reshape(len(raw), -1)


def _tile(rows: pa.Table) -> pa.Table:
    """One row of a tile: packed classes, counts, vectors, and the box of its rotated unit vectors."""
    rows = rows.sort_by("cls")
    cls, copies, x = _pack(rows)
    value = (x / np.sqrt((x * x).sum(1))[:, None]) @ directions(x.shape[1])
    value = np.pad(value, ((0, 0), (0, DIRECTIONS - value.shape[1])))
    one = {k: rows.column(k)[:1] for k in ("label", "dim", "tile")}
    return pa.table({**one, "ids": pa.array([cls.tobytes()], pa.binary()), "counts": pa.array([copies.tobytes()], pa.binary()), "raw": pa.array([x.tobytes()], pa.binary()), "low": pa.array([value.min(0).tolist()]), "high": pa.array([value.max(0).tolist()])})


def quantised(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(int8 values, step, length of what they stand for, length of the error) of unit vectors."""
    step = np.abs(x).max(1) / 127
    q = np.rint(x / step[:, None]).astype(np.int8)
    near = q * step[:, None]
    return q, step, np.sqrt((near * near).sum(1)), np.sqrt(((x - near) ** 2).sum(1))


def pairs_above(x: np.ndarray, y: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray, int]:
    """Index pairs whose cosine in double precision is at least `least`, and how many pairs were computed in full precision."""
    nx, ny = np.sqrt((x * x).sum(1)), np.sqrt((y * y).sum(1))
    (qx, sx, lx, ex), (qy, sy, ly, ey) = quantised(x / nx[:, None]), quantised(y / ny[:, None])
    near = np.zeros((len(x), len(y)))
    for at in range(0, x.shape[1], EXACT_DIM):
        part = slice(at, at + EXACT_DIM)
        near += qx[:, part].astype(np.float32) @ qy[:, part].T.astype(np.float32)
    near *= sx[:, None] * sy[None, :]
    error = ex[:, None] * ly[None, :] + lx[:, None] * ey[None, :] + ex[:, None] * ey[None, :] + 1e-9
    i, j = np.nonzero(near + error >= least)
    good = np.zeros(len(i), bool)
    for s in range(0, len(i), 100_000):
        a, b = i[s : s + 100_000], j[s : s + 100_000]
        good[s : s + 100_000] = np.einsum("nd,nd->n", x[a], y[b]) / (nx[a] * ny[b]) >= least
    return i[good], j[good], len(i)


def _forest(a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        while (up := parent.setdefault(x, x)) != x:
            parent[x] = parent[up]
            x = up
        return x

    out = []
    for x, y in zip(a.tolist(), b.tolist(), strict=True):
        p, q = find(x), find(y)
        if p != q:
            parent[max(p, q)] = min(p, q)
            out.append((x, y))
    return out


def _products(least: float):  # noqa: ANN202
    names = ["cls", "other", "links"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(len(b)):
                one = lambda c: b.column(c)[i].as_buffer()  # noqa: B023, E731
                ids, others = np.frombuffer(one("ids"), np.int64), np.frombuffer(one("ids2"), np.int64)
                count, count2 = np.frombuffer(one("counts"), np.int64), np.frombuffer(one("counts2"), np.int64)
                x, y = np.frombuffer(one("raw"), np.float64).reshape(len(ids), -1), np.frombuffer(one("raw2"), np.float64).reshape(len(others), -1)
                p, q, _ = pairs_above(x, y, least)
                same = b.column("same")[i].as_py()
                keep = p != q if same else np.ones(len(p), bool)
                p, q = p[keep], q[keep]
                sides = [(ids, np.bincount(p, count2[q], len(ids)))] + ([] if same else [(others, np.bincount(q, count[p], len(others)))])
                edges = _forest(ids[p], others[q])
                rows = [(c, None, int(n)) for who, n in sides for c, n in zip(who.tolist(), n.tolist(), strict=True) if n] + [(a, o, 0) for a, o in edges]
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.int64()) for k in range(3)], names)

    return run


def near_vectors(vectors: DataFrame, least: float = 0.93, key: str = "vec_id", value: str = "embedding", label: str = "label") -> DataFrame:
    """Link vectors of equal, non-null label whose cosine in double precision is at least `least` (0 < least <= 1).

    Returns one row per row: vec_id, n_links (other rows linked directly), component_id (smallest vec_id reachable, itself included)
    and kept (vec_id = component_id). Vectors that are null, empty, zero, or hold null or non-finite components, and rows with a null
    label, link with nothing; so do vectors of different length. Rows with equal vectors link with each other; repeated rows count
    as rows. Vectors of any dimension and finite size are compared. A null vec_id keeps its row, names no component, and is never kept. Other columns are not read. An empty table gives
    no rows."""
    vectors = vectors.select(F.col(key).cast("long").alias("vec_id"), F.col(label).alias("label"), F.col(value).cast("array<double>").alias("v"))
    units = table(vectors.where("label is not null and v is not null").select("vec_id", F.col("label").cast("string").alias("label"), "v").mapInArrow(_units, "vec_id long, label string, raw binary, cell long"))
    keys = ["key", "key2"]  # 128 bits of label and vector
    units = units.withColumn("key", F.xxhash64("label", "raw")).withColumn("key2", F.xxhash64(F.lit("second"), "label", "raw"))
    classes = units.groupBy(*keys).agg(F.min("vec_id").alias("least"), F.count("*").alias("copies"), F.first("label").alias("label"), F.first("raw").alias("raw"), F.first("cell").alias("cell"))
    classes = table(classes.withColumn("dim", F.octet_length("raw") / 8).withColumn("cls", F.monotonically_increasing_id()))

    # Tiles: neighbouring cells of a label share one until it is full; a fuller cell is split by hash.
    cells = classes.groupBy("label", "dim", "cell").agg(F.count("*").alias("n"))
    order = Window.partitionBy("label", "dim").orderBy("cell")
    cells = cells.withColumn("before", F.sum("n").over(order) - F.col("n")).withColumn("parts", F.ceil(F.col("n") / TILE)).withColumn("first", F.floor(F.col("before") / TILE))
    tile = F.when(F.col("parts") > 1, F.concat_ws("-", "cell", F.pmod(F.xxhash64("cls", F.lit(3)), F.col("parts")))).otherwise(F.concat_ws("+", F.lit("g"), "first"))
    placed = classes.join(cells.select("label", "dim", "cell", "parts", "first"), ["label", "dim", "cell"]).select("label", F.col("dim").cast("long").alias("dim"), tile.alias("tile"), "cls", "copies", "raw")
    schema = "label string, dim long, tile string, ids binary, counts binary, raw binary, low array<double>, high array<double>"
    tiles = table(placed.groupBy("label", "dim", "tile").applyInArrow(_tile, schema))
    small = tiles.select("label", "dim", "tile", "low", "high")
    gap = F.aggregate(F.zip_with(F.zip_with("a.low", "b.high", lambda x, y: x - y), F.zip_with("b.low", "a.high", lambda x, y: x - y), lambda x, y: F.greatest(x, y, F.lit(0.0))), F.lit(0.0), lambda s, x: s + x * x)
    chosen = table(small.alias("a").join(small.alias("b"), (F.col("a.label") == F.col("b.label")) & (F.col("a.dim") == F.col("b.dim")) & (F.col("a.tile") <= F.col("b.tile"))).where(gap <= 2 - 2 * least + 1e-9).select("a.label", "a.dim", "a.tile", F.col("b.tile").alias("tile2")))
    second = tiles.select("label", "dim", F.col("tile").alias("tile2"), F.col("ids").alias("ids2"), F.col("counts").alias("counts2"), F.col("raw").alias("raw2"))
    work = chosen.join(tiles.drop("low", "high"), ["label", "dim", "tile"]).join(second, ["label", "dim", "tile2"])
    work = work.select((F.col("tile") == F.col("tile2")).alias("same"), "ids", "counts", "raw", "ids2", "counts2", "raw2")
    found = table(work.mapInArrow(_products(least), "cls long, other long, links long"))
    links = found.where("other is null").groupBy("cls").agg(F.sum("links").alias("links"))
    roots = components(found.where("other is not null").select("cls", "other"))
    named = classes.select("cls", *keys, "least", "copies").join(links, "cls", "left").join(roots, F.col("cls") == F.col("node"), "left").withColumn("root", F.coalesce("root", "cls"))
    named = named.join(named.groupBy("root").agg(F.min("least").alias("component")), "root").select(*keys, (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links"), "component")
    linked = units.select("vec_id", *keys).join(named, keys).select("vec_id", "links", F.col("component").alias("component_id"))
    alone = vectors.select("vec_id").exceptAll(units.select("vec_id")).select("vec_id", F.lit(0).cast("long").alias("links"), F.col("vec_id").alias("component_id"))
    both = linked.unionByName(alone)
    return both.select("vec_id", F.col("links").cast("long").alias("n_links"), "component_id", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)).alias("kept"))
