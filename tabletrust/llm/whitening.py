"""Whitening of embeddings by Golub-Kahan-Lanczos bidiagonalisation.

With X the centred rows, each step multiplies both ways: p = X v - beta u_before, then X'p. Rows stay where they are; a pass
over them gives, as sums over all rows, X'p (one number a dimension), |p|^2 and the products of p with all earlier left
vectors. Left vectors have an entry a row and aren't stored: each is X w for a known w of one entry a dimension, and every
pass makes their entries again for the rows it reads. With these sums the new left vector is orthogonalised against all
earlier ones, and the new right vector against all earlier right ones, so one pass is one step.

The singular values of the small bidiagonal matrix are the deviations, its right singular vectors turn the right vectors
into components. Steps end when the wanted components are settled and no other can be missing: either all dimensions are
spanned, or what the right vectors leave of the total variance is less than the smallest wanted one. A subspace that closes
early (equal deviations) is left by a new start, orthogonal to all vectors so far.

Entries are whole numbers, so sums, n * x - S and its squares are exact: in 64 bits where the largest entry allows it, else
as Python's whole numbers.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabletrust.llm.common import saved

#: An entry c becomes floor(SCALE * c) + SHIFT.
SCALE, SHIFT = 1024, 100_000
#: Entries beyond it are held at it, as SCALE times more still fits in 64 bits.
EDGE = float(1 << 52)
#: What is as large or larger isn't a decimal of 38 digits.
DIGITS = 10**38
#: Error of a component, against the largest deviation, at which it is settled.
SETTLED = 1e-13
#: Rows that are multiplied at once.
ROWS = 4096


def whole_numbers(df: DataFrame, vector: str = "embedding") -> DataFrame:
    """df with x (array<long>) in place of the vector; rows whose vector is null, or holds null or entries that aren't
    finite, go, and those of another length than most (of equally frequent lengths the largest counts): they lack a dimension."""
    c = F.col(f"`{vector}`")
    finite = F.forall(c, lambda e: F.coalesce(e.isNotNull() & ~F.isnan(e.cast("double")) & (F.abs(e.cast("double")) < float("inf")), F.lit(False)))
    entry = lambda e: F.floor(F.lit(float(SCALE)) * F.greatest(F.lit(-EDGE), F.least(F.lit(EDGE), e.cast("double")))) + SHIFT
    rows = df.where(c.isNotNull() & F.coalesce(finite, F.lit(False)) & (F.size(c) > 0))
    others = [F.col(f"`{k}`") for k in df.columns if k not in (vector, "x")]
    return rows.select(*others, F.transform(c, entry).alias("x"))


def blocks(batches: Iterator[pa.RecordBatch], at: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Parts of the batches with the matrix of column `at`."""
    for batch in batches:
        for part in (batch.slice(k, ROWS) for k in range(0, batch.num_rows, ROWS)):
            yield part, part.column(at).flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, -1)


class Centre(NamedTuple):
    """Rows n, exact sums a dimension, and whether n * x - S and the sum of its squares fit in 64 bits."""

    n: int
    sums: list[int]
    short: bool
    squares_short: bool

    def spread(self, x: np.ndarray) -> np.ndarray:
        """n * x - S, exact."""
        if self.short:
            return self.n * x - np.array(self.sums, np.int64)
        return self.n * x.astype(object) - np.array(self.sums, object)

    def centred(self, x: np.ndarray) -> np.ndarray:
        return self.spread(x).astype(np.float64) / self.n


class Whitening(NamedTuple):
    """Components (a row each), their deviations squared, by falling size, the trace and what the rows are centred by."""

    centre: Centre
    components: np.ndarray
    variances: np.ndarray
    trace: float


def summed(x: DataFrame, work: Callable[[np.ndarray], np.ndarray], size: int) -> np.ndarray:
    """The sum over all rows of what `work` makes of a block of them, an array of `size` numbers. Each task sums its own
    blocks; the tasks' sums are added by place, so that the driver gets `size` rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for _, block in blocks(batches, 0):
            total += work(block)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(size)), pa.array(total)], names=["i", "v"])

    out = np.zeros(size)
    for r in x.select("x").mapInArrow(run, "i long, v double").groupBy("i").agg(F.sum("v").alias("v")).collect():
        out[r.i] = r.v
    return out


def centre(x: DataFrame) -> Centre | None:
    """None without rows."""
    stats = x.agg(F.count("*").alias("n"), F.coalesce(F.max(F.array_max("x")), F.lit(0)).alias("high"), F.coalesce(F.min(F.array_min("x")), F.lit(0)).alias("low")).first()
    if not stats.n:
        return None
    sums = x.select(F.posexplode("x").alias("i", "e")).groupBy("i").agg(F.sum(F.col("e").cast("decimal(38,0)")).alias("s")).orderBy("i").collect()
    most = stats.n * (int(stats.high) - int(stats.low))
    largest = stats.n * max(abs(int(stats.high)), abs(int(stats.low)))
    return Centre(stats.n, [int(r.s) for r in sums], largest < 1 << 62, largest < 1 << 62 and most**2 * len(sums) < 1 << 63)


def learn(x: DataFrame, components: int = 8, seed: int = 17) -> Whitening | None:
    """The largest components of the rows' covariance (divisor n); None without rows. Variances that are nothing beside
    the largest one (equal rows, dependent dimensions) have no component. x: a stored table, as each step reads it once."""
    c = centre(x)
    if c is None:
        return None
    d, random = len(c.sums), np.random.default_rng(seed)
    total = summed(x, lambda b: np.array([np.square(c.centred(b)).sum()]), 1)[0]
    right, left, back = np.empty((d, 0)), np.empty((d, 0)), np.empty((d, 0))  # V, W with U = X W, X'U
    alphas, betas = [], []

    def apart(v: np.ndarray) -> np.ndarray:
        for _ in range(2):
            v = v - right @ (right.T @ v)
        return v

    def start() -> np.ndarray:
        v = apart(random.standard_normal(d))
        return v / np.linalg.norm(v)

    v, beta, sigma, turn = start(), 0.0, np.empty(0), np.empty((0, 0))
    closed = np.sqrt(total) * 1e-12
    while total > 0 and len(alphas) < d:
        q = v - beta * left[:, -1] if beta else v
        w = left

        def work(b: np.ndarray, q: np.ndarray = q, w: np.ndarray = w) -> np.ndarray:
            rows = c.centred(b)
            p = rows @ q
            return np.concatenate([rows.T @ p, (rows @ w).T @ p, [p @ p]])

        found = summed(x, work, d + w.shape[1] + 1)
        g, overlap, square = found[:d], found[d:-1], found[-1]
        q, g, square = q - w @ overlap, g - back @ overlap, square - overlap @ overlap
        right = np.column_stack([right, v])
        alpha = float(np.sqrt(max(square, 0.0)))
        if alpha <= closed:  # v is in the null space
            alpha, q, g = 0.0, np.zeros(d), np.zeros(d)
        else:
            q, g = q / alpha, g / alpha
        left, back = np.column_stack([left, q]), np.column_stack([back, g])
        alphas.append(alpha)
        rest = apart(g - alpha * v)
        beta = float(np.linalg.norm(rest))
        k = len(alphas)
        matrix = np.diag(alphas) + np.diag(betas, 1) if betas else np.diag(alphas)
        u, sigma, turn = np.linalg.svd(matrix)
        wanted = min(components, k)
        error = beta * np.abs(u[-1, :wanted]) if beta > closed else np.zeros(wanted)
        left_over = total - np.square(matrix).sum()
        smallest = sigma[components - 1] ** 2 if k >= components else 0.0
        if k >= components and (error <= SETTLED * sigma[0]).all() and left_over < smallest * (1 - 1e-9):
            break
        if k == d:
            break
        if beta <= closed:
            v, beta = start(), 0.0
        else:
            v = rest / beta
        betas.append(beta)
    keep = [i for i in range(min(components, len(sigma))) if sigma[i] > max(closed, 1e-7 * sigma[0])]
    axes = (right @ turn[keep].T).T if keep else np.empty((0, d))
    for a in axes:
        a /= np.linalg.norm(a)
        a *= np.sign(a[np.argmax(np.abs(a))])
    return Whitening(c, axes, np.square(sigma[keep]) / c.n if keep else np.empty(0), total / c.n)


def fitted(df: DataFrame, vector: str = "embedding", components: int = 8) -> tuple[DataFrame, Whitening | None]:
    """The remaining rows as a stored table with x, and what was learned from them."""
    x = saved(whole_numbers(df, vector), "vectors")
    lengths = x.groupBy(F.size("x").alias("d")).agg(F.count("*").alias("c")).orderBy(F.desc("c"), F.desc("d")).limit(2).collect()
    if len(lengths) > 1:
        x = saved(x.where(F.size("x") == lengths[0].d), "vectors")
    return x, learn(x, components)


def projected(x: DataFrame, model: Whitening | None, key: str) -> DataFrame:
    """key, whitened (array<double>, one for each component) and deviation (decimal, exact; null beyond 38
    digits) of each row of x."""
    kind = dict(x.dtypes)[key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        axes, scale = model.components, np.sqrt(model.variances)
        for part, block in blocks(batches, 1):
            white = (model.centre.centred(block) @ axes.T) / scale
            cuts = np.arange(part.num_rows + 1, dtype=np.int32) * len(scale)
            spread = model.centre.spread(block)
            squares = np.square(spread if model.centre.squares_short else spread.astype(object)).sum(axis=1)
            exact = pa.array([int(s) if s < DIGITS else None for s in squares], pa.decimal128(38, 0))
            yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(pa.array(cuts), pa.array(white.ravel())), exact], names=[key, "whitened", "deviation"])

    shape = f"`{key}` {kind}, whitened array<double>, deviation decimal(38,0)"
    if model is None or not len(model.components):
        return x.sparkSession.createDataFrame([], shape)
    return x.select(key, "x").mapInArrow(run, shape)


def identity_error(white: DataFrame, k: int, n: int) -> float:
    """The largest absolute entry of the covariance of the whitened rows (divisor n) minus the identity."""
    row = white.select("whitened")
    sums = [F.sum(F.get("whitened", i)).alias(f"s{i}") for i in range(k)]
    mean = list(row.agg(*sums).first()) if k else []
    w = [F.get("whitened", i) - F.lit(mean[i] / n) for i in range(k)]
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    found = row.agg(*(F.sum(w[i] * w[j]).alias(f"c{i}_{j}") for i, j in pairs)).first() if k else []
    return max((abs(v / n - (i == j)) for (i, j), v in zip(pairs, found, strict=True)), default=0.0)


def whitened(df: DataFrame, key: str = "vec_id", vector: str = "embedding", components: int = 8) -> DataFrame:
    """A row for each remaining row and component: key, component (from 1), n, deviation (decimal), whitened, explained and
    identity_error.

    Rows with a null vector, null or infinite entries, NaN, no entries or another length than most go; equal rows and rows
    with equal or null keys are rows of their own. Entries beyond EDGE are held at it.
    Fewer components come back where fewer have any variance; none for an empty table, one row or equal rows. Columns other
    than key and vector aren't read, whatever they are called.
    """
    x, model = fitted(df.select(F.col(f"`{key}`").alias("_id"), F.col(f"`{vector}`").alias("_vector")), "_vector", components)
    white = projected(x, model, "_id")
    k = len(model.components) if model else 0
    if k:
        white = saved(white, "whitened")
    error = identity_error(white, k, model.centre.n) if k else 0.0
    share = F.array(*(F.lit(float(v / model.trace)) for v in model.variances)) if k else F.array().cast("array<double>")
    rows = white.select("_id", "deviation", F.posexplode("whitened").alias("i", "w"))
    return rows.select(
        F.col("_id").alias(key), (F.col("i") + 1).cast("int").alias("component"), F.lit(model.centre.n if k else 0).cast("long").alias("n"), "deviation",
        F.col("w").alias("whitened"), F.get(share, F.col("i")).alias("explained"), F.lit(float(error)).alias("identity_error"),
    )
