"""Operator 11, embedding whitening by a bit-sliced scatter matrix.

Entries become integers. A task shifts each dimension of a batch to start at zero and packs its bit
planes across the rows into words; AND of two planes and its popcount, weighted by both places, give the
sum of products of two dimensions exactly. These sums meet as integers in Spark, are centred as
integers (``n * products - sums * sums``) and only then divided, so the covariance of which ``eigh``
takes the components is correctly rounded whatever the number of rows.

Vectors of different lengths have no common covariance: each length is whitened by itself. A task and
the driver hold one square matrix and eight directions for each length, nothing that grows with the rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sealwright.llm import common

SCALE, SHIFT, COMPONENTS = 1024, 100_000, 8
#: Entries of at least this size have no integer that all sums can hold exactly; they count as not finite.
LARGEST = float(1 << 30)
#: Rows whose bit planes are packed at a time.
ROWS = 4096
#: Matrix entries that a task holds before it hands them on; one length always fits.
HELD = 1 << 22

_SUMS = "dim int, i int, j int, value decimal(38,0)"
_FIT = "dim int, n long, sums array<string>, directions array<array<double>>, explained array<double>, live int"
_WHITE = "dim int, n long, deviation decimal(38,0), whitened array<double>"


@dataclass
class Fit:
    n: int
    sums: np.ndarray  #: of each dimension, Python integers
    directions: np.ndarray  #: component by dimension, over the root of its eigenvalue; zero where there is no spread


def quantised(vectors: DataFrame, embedding: str = "embedding") -> DataFrame:
    """``vectors`` whose ``embedding`` is there and holds only finite entries, as doubles."""
    fits = F.forall("_e", lambda x: x.isNotNull() & (F.abs(x) < LARGEST))
    return vectors.withColumn("_e", F.col(embedding).cast("array<double>")).where(F.col("_e").isNotNull() & fits)


def _integers(column: pa.ListArray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row numbers, integers by row) for each length of vector in a batch."""
    flat = np.floor(SCALE * column.flatten().to_numpy(zero_copy_only=False)).astype(np.int64) + SHIFT
    lengths = np.diff(column.offsets.to_numpy())
    starts = np.cumsum(lengths) - lengths
    for dim in np.unique(lengths):
        rows = np.flatnonzero(lengths == dim)
        yield rows, flat[starts[rows][:, None] + np.arange(dim)]


def scatter(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(sums, sums of products) of the columns of ``x``, exact, as Python integers."""
    n, dims = x.shape
    least = x.min(axis=0)
    y = x - least
    bits = [int(m).bit_length() for m in y.max(axis=0)]
    words = -(-n // 64)
    planes = np.zeros((sum(bits), words * 8), np.uint8)
    starts, at = [], 0
    for k in range(dims):
        starts.append(at)
        planes[at : at + bits[k], : -(-n // 8)] = np.packbits((y[None, :, k] >> np.arange(bits[k])[:, None]) & 1, axis=1)
        at += bits[k]
    planes = planes.view(np.uint64)
    places = np.concatenate([np.arange(b) for b in bits] or [np.zeros(0, int)])
    owner = np.repeat(np.arange(dims), bits)
    # popcounts times both places stay in 63 bits, or are added up as Python integers
    small = 2 * max(bits, default=0) + n.bit_length() + 1 < 63
    kind = np.int64 if small else object
    weights = np.asarray([1 << int(p) for p in places], kind)
    product = np.zeros((dims, dims), kind)
    for p in range(len(planes)):
        first = starts[owner[p]]
        both = np.bitwise_count(planes[first:] & planes[p]).sum(axis=1, dtype=np.int64).astype(kind)
        np.add.at(product[owner[p]], owner[first:], both * weights[first:] * weights[p])
    product = np.triu(product)
    total = np.zeros(dims, kind)
    np.add.at(total, owner, np.bitwise_count(planes).sum(axis=1, dtype=np.int64).astype(kind) * weights)
    product, total, least = product.astype(object), total.astype(object), least.astype(object)
    product = product + np.triu(product, 1).T
    # undo the shift: (y + a)(z + b) = yz + a z + b y + a b, summed
    return total + n * least, product + np.outer(least, total) + np.outer(total, least) + n * np.outer(least, least)


def _emit(dim: int, n: int, sums: np.ndarray, products: np.ndarray) -> pa.RecordBatch:
    """Counts stand at (-1, -1), sums at (i, -1), sums of products at (i, j) with i <= j."""
    i, j = np.triu_indices(dim)
    values = [n, *sums, *products[i, j]]
    columns = [
        pa.array([dim] * len(values), pa.int32()),
        pa.array(np.concatenate([[-1], np.arange(dim), i]).astype(np.int32)),
        pa.array(np.concatenate([np.full(1 + dim, -1), j]).astype(np.int32)),
        pa.array([Decimal(int(v)) for v in values], pa.decimal128(38, 0)),
    ]
    return pa.RecordBatch.from_arrays(columns, ["dim", "i", "j", "value"])


def _scatter_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[int, list] = {}
    for batch in batches:
        for _, x in _integers(batch.column("_e")):
            dim = x.shape[1]
            for at in range(0, len(x), ROWS):
                part = x[at : at + ROWS]
                sums, products = scatter(part)
                have = held.setdefault(dim, [0, 0, 0])
                held[dim] = [have[0] + len(part), have[1] + sums, have[2] + products]
            if sum(d * d for d in held) > HELD:
                yield from (_emit(d, *h) for d, h in held.items())
                held = {}
    yield from (_emit(d, *h) for d, h in held.items())


def _fit(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    dim = int(key[0])
    i, j, value = rows["i"].to_numpy(), rows["j"].to_numpy(), np.array([int(v) for v in rows["value"]], object)
    n = value[(i < 0)][0]
    sums = np.zeros(dim, object)
    single = (i >= 0) & (j < 0)
    sums[i[single]] = value[single]
    pair = j >= 0
    cov = np.zeros((dim, dim))
    # Python's division of integers is rounded once
    centred = [(n * v - sums[a] * sums[b]) / (n * n) for a, b, v in zip(i[pair], j[pair], value[pair])]
    cov[i[pair], j[pair]] = cov[j[pair], i[pair]] = centred
    e, v = np.linalg.eigh(cov)
    e, v = e[::-1][:COMPONENTS], v[:, ::-1].T[:COMPONENTS]
    trace = float(np.trace(cov))
    live = e > trace * dim * np.finfo(float).eps
    directions = np.where(live[:, None], v / np.sqrt(np.where(live, e, 1.0))[:, None], 0.0)
    explained = np.where(live, e / (trace or 1.0), 0.0)
    out = {"dim": dim, "n": int(n), "sums": [str(s) for s in sums], "directions": directions.tolist(), "explained": explained.tolist(), "live": int(live.sum())}
    return pd.DataFrame([out])


def fit(vectors: DataFrame) -> DataFrame:
    """(dim, n, sums, directions, explained, live) for each length of vector; ``live`` components have spread."""
    parts = vectors.where(F.size("_e") > 0).select("_e").mapInArrow(_scatter_batches, _SUMS)
    sums = parts.groupBy("dim", "i", "j").agg(F.sum("value").cast("decimal(38,0)").alias("value"))
    # one matrix of a length to a group: its size is that of the length, squared, at any number of rows
    return common.stage(sums.groupBy("dim").applyInPandas(_fit, _FIT), "whitening-fit")


def _project(fits: dict[int, Fit], names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, x in _integers(batch.column("_e")):
                model = fits[x.shape[1]]
                n, most = model.n, max(int(np.abs(x).max()), max(abs(s) for s in model.sums) // model.n + 1)
                narrow = x.shape[1] * (2 * n * most) ** 2 < 1 << 63
                moved = n * x - model.sums.astype(np.int64) if narrow else n * x.astype(object) - model.sums
                squares = (moved * moved).sum(axis=1)
                deviation = [Decimal(int(s)) if int(s) < 10**38 else None for s in squares]
                white = (moved / n).astype(float) @ model.directions.T
                kept = batch.take(pa.array(rows))
                yield pa.RecordBatch.from_arrays(
                    [
                        *[kept.column(c) for c in names],
                        pa.array([x.shape[1]] * len(rows), pa.int32()),
                        pa.array([n] * len(rows), pa.int64()),
                        pa.array(deviation, pa.decimal128(38, 0)),
                        pa.array(list(white), pa.list_(pa.float64())),
                    ],
                    [*names, "dim", "n", "deviation", "whitened"],
                )

    return run


def identity_error(white: DataFrame, fits: DataFrame) -> DataFrame:
    """(dim, identity_error): the largest absolute entry of the whitened rows' covariance less the identity.

    The mean is taken first and the rows are centred before they are multiplied. Components without spread do
    not count; a length without any has the error 0.
    """
    means = white.groupBy("dim").agg(F.array(*[F.avg(F.get("whitened", F.lit(a))) for a in range(COMPONENTS)]).alias("_mean"))
    rows = white.select("dim", "whitened").join(F.broadcast(means), "dim")

    def off(a: int):
        return F.get("whitened", F.lit(a)) - F.get("_mean", F.lit(a))

    pairs = [(a, b) for a in range(COMPONENTS) for b in range(a + 1)]
    sums = rows.groupBy("dim").agg(*[F.avg(off(a) * off(b)).alias(f"_{a}_{b}") for a, b in pairs])
    apart = [F.when(F.col("live") > a, F.abs(F.col(f"_{a}_{b}") - (1.0 if a == b else 0.0))) for a, b in pairs]
    return sums.join(F.broadcast(fits.select("dim", "live")), "dim").select("dim", F.coalesce(F.greatest(*apart), F.lit(0.0)).alias("identity_error"))


def whiten(vectors: DataFrame, key: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """(key, dim, n, deviation, whitened, explained, identity_error) for every row whose vector can be used.

    ``whitened`` and ``explained`` hold up to eight components, by falling eigenvalue. Vectors that are null, hold
    null or non-finite entries, or entries of 2**30 and more are left out; an empty vector has no component and
    gives no row. Each length of vector is a fit list of its own (``n`` counts it). Equal rows and null keys stay
    as they are. Components without spread (one row, equal rows) are whitened to 0 and explain 0. An empty table
    gives no rows. ``deviation`` is exact, null beyond 38 digits.
    """
    usable = quantised(vectors.select(F.col(key), F.col(embedding).alias("_v")), "_v").where(F.size("_e") > 0).select(key, "_e")
    told = fit(usable)
    models = {r.dim: Fit(r.n, np.array([int(s) for s in r.sums], object), np.array(r.directions)) for r in told.collect()}
    kind = usable.schema[key].dataType.simpleString()
    rows = usable.mapInArrow(_project(models, [key]), f"`{key}` {kind}, {_WHITE}")
    white = common.stage(rows, "whitened")
    told = told.select("dim", "explained", "live")
    wrong = identity_error(white, told)
    return white.join(F.broadcast(told.join(wrong, "dim").drop("live")), "dim")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each vector and component; ``deviation`` is null where it does not fit a long."""
    rows = whiten(common.read(spark, sf_dir, "embeddings", "vec_id", "embedding"))
    each = rows.select("vec_id", "n", "deviation", "explained", "identity_error", F.posexplode("whitened").alias("_at", "whitened"))
    long = F.when(F.col("deviation") <= (1 << 63) - 1, F.col("deviation")).cast("long")
    return each.select(
        "vec_id", (F.col("_at") + 1).cast("int").alias("component"), "n", long.alias("deviation"), "whitened", F.get("explained", F.col("_at")).alias("explained"), "identity_error"
    )
