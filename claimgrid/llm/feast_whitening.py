"""Whitening of embeddings by FEAST contour integration.

Spark sums the vectors and then, centred, their products; what the driver gets is one covariance, the
square of the dimension in doubles, whatever the number of vectors. Its leading eigenvalues are cut
into intervals by inertia: the signs of a symmetric factorisation of the shifted covariance count the
eigenvalues above a shift. Each interval is solved alone. A random block is pushed through a rational
filter, the quadrature of shifted complex solves on a circle around the interval, which leaves the
eigenvectors inside; Rayleigh-Ritz extracts them, and the rounds end when the residuals are at the
precision of doubles and as many are found as inertia counts. A last Rayleigh-Ritz over all intervals
makes the components orthogonal across their borders.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MOST_COMPONENTS = 32
SCALE, SHIFT = 64, 1_000_000
#: Entries beyond this count as this, so that integers do not overflow.
LARGEST = 2.0**52
#: Eigenvalues that one interval should hold, at most.
IN_INTERVAL = 8
#: Points on the upper half circle, and filter rounds.
POINTS, ROUNDS = 8, 20
#: Components below this share of the largest eigenvalue cannot be told from none.
LEAST_SHARE = 1e-11
#: Result rows of one Arrow batch, about.
ROWS_AT_ONCE = 1 << 16


# ---- inertia -------------------------------------------------------------------------------


def count_above(matrix: np.ndarray, shift: float) -> int:
    """Eigenvalues of a symmetric matrix above ``shift``: positive pivots of its factorisation with
    symmetric pivoting, in blocks of one or two (complete pivoting keeps it stable)."""
    a = matrix - shift * np.eye(len(matrix))
    above, bound = 0, (1 + 17**0.5) / 8
    while len(a):
        diagonal = np.abs(np.diag(a))
        at = int(diagonal.argmax())
        off = np.abs(np.tril(a, -1))
        r, s = np.unravel_index(int(off.argmax()), off.shape)
        if diagonal[at] >= bound * off[r, s]:
            pivot = a[at, at]
            if pivot == 0:
                return above  # nothing is left
            above += pivot > 0
            rest = np.delete(np.arange(len(a)), at)
            a = a[np.ix_(rest, rest)] - np.outer(a[rest, at], a[at, rest]) / pivot
        else:
            above += 1  # a block of two with a negative determinant: one on each side
            pair, rest = [r, s], np.delete(np.arange(len(a)), [r, s])
            side = a[np.ix_(rest, pair)]
            a = a[np.ix_(rest, rest)] - side @ np.linalg.solve(a[np.ix_(pair, pair)], side.T)
        a = (a + a.T) / 2
    return int(above)


def intervals(matrix: np.ndarray, wanted: int) -> list[tuple[float, float, int]]:
    """(low, high, eigenvalues inside) that together hold the ``wanted`` largest eigenvalues, from the top."""
    n, radius = len(matrix), np.abs(matrix).sum(1)
    top = float(radius.max()) * (1 + 1e-9) + 1e-300  # Gershgorin
    finest = top * 1e-9
    counts: dict[float, int] = {top: 0}

    def above(x: float) -> int:
        if x not in counts:
            counts[x] = count_above(matrix, x)
        return counts[x]

    low = -top
    counts[low] = n
    lower, upper = low, top
    while upper - lower > finest and above(lower) > wanted + IN_INTERVAL // 2:
        middle = (lower + upper) / 2
        lower, upper = (middle, upper) if above(middle) >= wanted else (lower, middle)
    out: list[tuple[float, float, int]] = []

    def cut(a: float, b: float) -> None:
        inside = above(a) - above(b)
        if not inside:
            return
        if inside > IN_INTERVAL and b - a > finest:
            cut((a + b) / 2, b)
            cut(a, (a + b) / 2)
        else:
            out.append((a, b, inside))

    cut(lower, top)
    return out


# ---- contour integration -----------------------------------------------------------------------


def filtered(matrix: np.ndarray, block: np.ndarray, low: float, high: float) -> np.ndarray:
    """The block projected on the eigenvectors inside the circle over [low, high], by quadrature."""
    nodes, weights = np.polynomial.legendre.leggauss(POINTS)
    middle, radius = (low + high) / 2, (high - low) / 2
    out = np.zeros_like(block)
    for t, w in zip(nodes, weights, strict=True):
        turn = np.exp(1j * np.pi / 2 * (1 - t))  # upper half; the lower half is its conjugate
        shifted = (middle + radius * turn) * np.eye(len(matrix)) - matrix
        out += (w / 2) * np.real(radius * turn * np.linalg.solve(shifted, block.astype(complex)))
    return out


def ritz(matrix: np.ndarray, block: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rayleigh-Ritz pairs in the span of a block, by falling value."""
    basis, _ = np.linalg.qr(block)
    small = basis.T @ matrix @ basis
    values, vectors = np.linalg.eigh((small + small.T) / 2)
    return values[::-1], basis @ vectors[:, ::-1]


def solve_interval(matrix: np.ndarray, low: float, high: float, inside: int) -> np.ndarray:
    """The eigenvectors of the interval; an error if fewer are found than inertia counts."""
    n, size = len(matrix), float(np.abs(matrix).sum(1).max())
    pad = (high - low) * 0.05  # an eigenvalue on the border stays well inside the circle
    width = min(n, 2 * inside + 4)
    while True:
        block = np.random.Generator(np.random.PCG64(13)).standard_normal((n, width))
        before = np.inf
        for _ in range(ROUNDS):
            block = filtered(matrix, block, low - pad, high + pad)
            values, block = ritz(matrix, block)
            within = (values >= low) & (values <= high)
            found = block[:, within]
            worst = float(np.abs(matrix @ found - found * values[within]).max(initial=0)) / size
            if within.sum() == inside and (worst < 1e-15 or worst < 1e-12 and worst >= before / 4):
                return found
            before = worst
        if width == n:
            raise ArithmeticError(f"{inside} eigenvalues lie in [{low}, {high}], {int(within.sum())} were found")
        width = min(n, 2 * width)


def leading_components(covariance: np.ndarray, most: int = MOST_COMPONENTS) -> tuple[np.ndarray, np.ndarray]:
    """The ``most`` largest eigenvalues above the noise, falling, and their unit eigenvectors as columns."""
    size = float(np.abs(covariance).max(initial=0))
    none = np.zeros(0), np.zeros((len(covariance), 0))
    if not size:
        return none
    matrix = covariance / size
    wanted = min(most, count_above(matrix, LEAST_SHARE * float(np.abs(matrix).sum(1).max())))
    if not wanted:
        return none
    blocks = [solve_interval(matrix, *interval) for interval in intervals(matrix, wanted)]
    values, vectors = ritz(matrix, np.concatenate(blocks, 1))
    return values[:wanted] * size, vectors[:, :wanted]


# ---- sums on Spark ---------------------------------------------------------------------------


def usable(embeddings: DataFrame) -> DataFrame:
    """(vec_id, x): vectors without null or non-finite entries as integers. Where lengths differ, those
    of the most frequent length count, the longest of equally frequent ones."""
    vector = F.col("embedding").cast("array<double>")
    fine = F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    entry = lambda c: F.floor(SCALE * F.greatest(F.lit(-LARGEST / SCALE), F.least(F.lit(LARGEST / SCALE), c))) + F.lit(SHIFT)
    x = F.transform(vector, entry).cast("array<long>")
    rows = embeddings.where(F.col("embedding").isNotNull() & (F.size("embedding") > 0) & fine).select("vec_id", x.alias("x"))
    lengths = rows.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).limit(1).collect()
    return rows.where(F.size("x") == (lengths[0]["d"] if lengths else 0))


def matrix_of(column: pa.Array, d: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, d)


def entry_sums(rows: DataFrame, per_batch, shape: tuple[int, int], centre: np.ndarray) -> np.ndarray:
    """Sum over all rows of ``per_batch`` (a matrix of ``shape``): one partial sum a task, added by Spark."""
    d, width = len(centre), shape[1]

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, seen = np.zeros(shape), False
        for batch in batches:
            if batch.num_rows:
                total += per_batch(matrix_of(batch.column("x"), d) - centre)
                seen = True
        if seen:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size, dtype=np.int32)), pa.array(total.ravel())], names=["place", "part"])

    out = np.zeros(shape)
    sums = rows.select("x").mapInArrow(partial, "place int, part double").groupBy("place").agg(F.sum("part").alias("total"))
    for place, total in sums.collect():  # as many as the matrix has entries
        out[place // width, place % width] = total
    return out


def exact_sums(rows: DataFrame) -> tuple[int, list[int]]:
    """Number of vectors and the exact sum of each dimension."""
    each = rows.select(F.posexplode("x").alias("k", "v")).groupBy("k").agg(F.sum(F.col("v").cast("decimal(38,0)")).alias("s"), F.count("*").alias("n"))
    found = sorted(each.collect())  # one row for each dimension
    return (found[0]["n"], [int(r["s"]) for r in found]) if found else (0, [])


def deviations(x: np.ndarray, n: int, sums: list[int]) -> list[int | None]:
    """Exact sum over dimensions of (n*x - S)^2; null where it passes the range of a long."""
    far = float(n) * float(np.abs(x).max(initial=0)) + max(map(abs, sums), default=0)
    if far < 2.0**62:
        off = n * x - np.array(sums, np.int64)
        if float(np.abs(off).max(initial=0)) ** 2 * x.shape[1] < 2.0**62:
            return (off * off).sum(1).tolist()
    exact = [sum((n * v - s) ** 2 for v, s in zip(row, sums, strict=True)) for row in x.tolist()]
    return [v if v < 2**63 else None for v in exact]


def whitened(embeddings: DataFrame, most: int = MOST_COMPONENTS) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error) for every usable row and
    component.

    Null vectors, empty ones and such with null or non-finite entries are dropped, and those of
    another length than the most frequent one. Repeated rows count each and come back each; a null
    vec_id stays. Directions without variance are no components: copies of one vector give no rows,
    and neither does an empty table. Other columns are ignored.
    """
    kind = dict(embeddings.dtypes)["vec_id"]
    schema = f"vec_id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    rows = usable(embeddings)
    n, sums = exact_sums(rows)
    d = len(sums)
    if not n:
        return embeddings.sparkSession.createDataFrame([], schema)
    mean = np.array([s / n for s in sums])  # quotients of exact integers, rounded once
    covariance = entry_sums(rows, lambda c: c.T @ c, (d, d), mean) / n
    covariance = (covariance + covariance.T) / 2
    values, vectors = leading_components(covariance, most)
    k = len(values)
    if not k:
        return embeddings.sparkSession.createDataFrame([], schema)
    project = vectors / np.sqrt(values)

    def products(c: np.ndarray) -> np.ndarray:
        w = np.column_stack([np.ones(len(c)), c @ project])
        return w.T @ w

    around = entry_sums(rows, products, (k + 1, k + 1), mean) / n
    left = around[0, 1:]  # what rounding leaves of the mean
    error = float(np.abs(around[1:, 1:] - np.outer(left, left) - np.eye(k)).max())
    explained = values / np.trace(covariance)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for a in range(0, whole.num_rows, max(1, ROWS_AT_ONCE // k)):
                batch = whole.slice(a, max(1, ROWS_AT_ONCE // k))
                x = matrix_of(batch.column("x"), d)
                m = len(x)
                each = pa.array(np.repeat(np.arange(m), k))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("vec_id").take(each),
                        pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)),
                        pa.array(np.full(m * k, n, np.int64)),
                        pa.array(deviations(x, n, sums), pa.int64()).take(each),
                        pa.array(((x - mean) @ project).ravel()),
                        pa.array(np.tile(explained, m)),
                        pa.array(np.full(m * k, error)),
                    ],
                    names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
                )

    return rows.mapInArrow(score, schema)
