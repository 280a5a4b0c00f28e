"""Embedding whitening by Jacobi-Davidson.

The covariance of the vectors is never formed.  A product with a block of directions is one distributed
pass: every task centres its vectors, multiplies them by the directions and the results by the vectors
again, and Spark adds the small sums.  Jacobi-Davidson keeps a search space of orthonormal directions and
their products on the driver (a few times the wanted number of vectors of one dimension each), takes the
Ritz pairs of it, and solves the projected correction equation of every pair that has not converged by a
few MINRES steps, all pairs in step, so that one pass serves them all.  Pairs whose residual reaches double
precision are locked: they are projected out of the equations and not corrected any more.

Vectors are first written as blocks of whole numbers, many vectors a row, so that a pass is a scan of few
large rows.  Sums are exact.

Defined results: a row is dropped if its vector is null or empty, holds a null, NaN, infinite entry or one
beyond 2^42, or is not of the most frequent length (the longest of equally frequent ones); null and repeated
ids stay; components whose eigenvalue is not above ``LEAST`` of the greatest are no directions of the data
and have no rows, nor has an empty table; ``deviation`` is null where no long can hold it; other columns are
not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lifelog.llm.common import ship_package
from lifelog.staging import stage

COMPONENTS = 8
#: Whole numbers per unit of an entry, and their offset.
SCALE, OFFSET = 1024, 100_000
#: Bytes of a block of vectors.
BLOCK_BYTES = 1 << 20
#: MINRES steps for each correction.
STEPS = 2
#: Directions that the search space holds before it restarts, per wanted component, and after it.
WIDEST, RESTART = 12, 3
#: Residuals, as a share of the greatest eigenvalue, that count as double precision.
TOLERANCE = 256 * float(np.finfo(float).eps)
#: Components below this share of the greatest eigenvalue are left out.
LEAST = 1e-11
ROUNDS = 200
SEED = 13


@dataclass
class Packed:
    """Vectors as blocks: (ids, n, wide, data), with their number, sums and dimension."""

    blocks: DataFrame
    id_type: str
    n: int
    sums: list[int]

    @property
    def mean(self) -> np.ndarray:
        return np.array([float(Fraction(s, self.n)) for s in self.sums])


def pack(vectors: DataFrame, key: str, vector: str) -> Packed:
    """The valid vectors of a table as blocks of whole numbers; exact sums over all of them."""
    id_type = vectors.select(key).schema[key].dataType
    entries = F.col("v").cast("array<double>")
    bad = F.exists(entries, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) > 2.0**42))
    rows = vectors.select(F.col(key).alias("id"), F.col(vector).alias("v")).where(F.col("v").isNotNull() & (F.size("v") > 0) & ~bad)
    widths = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).limit(1).collect()
    d = widths[0]["d"] if widths else 0
    held = max(1, BLOCK_BYTES // (4 * max(d, 1)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("id")
            flat = batch.column("v").flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, d)
            whole = np.floor(flat * SCALE).astype(np.int64) + OFFSET
            for at in range(0, len(whole), held):
                x = whole[at:at + held]
                wide = bool((np.abs(x) > np.iinfo(np.int32).max).any())
                data = np.ascontiguousarray(x if wide else x.astype(np.int32)).tobytes()
                sums = [int(s) for s in x.sum(axis=0)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([ids.slice(at, len(x)).to_pylist()], pa.list_(ids.type)), pa.array([len(x)], pa.int64()), pa.array([wide]),
                     pa.array([data], pa.binary()), pa.array([sums], pa.list_(pa.int64()))], ["ids", "n", "wide", "data", "sums"])

    ship_package(vectors.sparkSession)
    blocks = stage(rows.where(F.size("v") == d).mapInArrow(
        run, f"ids array<{id_type.simpleString()}>, n long, wide boolean, data binary, sums array<long>"), "whitening-blocks")
    total = blocks.select("n", F.posexplode("sums").alias("i", "s")).groupBy("i").agg(
        F.sum("n").alias("n"), F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).orderBy("i").collect()
    return Packed(blocks.drop("sums"), id_type.simpleString(), total[0]["n"] if total else 0, [int(r["s"]) for r in total])


def _matrix(wide: bool, data: pa.Buffer | bytes, d: int) -> np.ndarray:
    return np.frombuffer(data, np.int64 if wide else np.int32).reshape(-1, d)


def _centred(batch: pa.RecordBatch, mean: np.ndarray) -> Iterator[np.ndarray]:
    wide = batch.column("wide").to_pylist()
    for row, data in enumerate(batch.column("data")):
        yield _matrix(wide[row], data.as_buffer(), len(mean)) - mean


def _summed(packed: Packed, parts: Callable[[np.ndarray], np.ndarray], shape: tuple[int, int]) -> np.ndarray:
    """The sum of ``parts`` of all centred blocks, a matrix of ``shape``."""
    mean = packed.mean

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for y in _centred(batch, mean):
                part = parts(y)
                total = part if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size), pa.int32()), pa.array(total.ravel())], ["at", "part"])

    rows = packed.blocks.select("wide", "data").mapInArrow(run, "at int, part double").groupBy("at").agg(F.sum("part").alias("part")).collect()
    out = np.zeros(shape)
    for r in rows:  # one for each entry of the matrix
        out.flat[r["at"]] = r["part"]
    return out


def covariance_product(packed: Packed) -> Callable[[np.ndarray], np.ndarray]:
    """``directions -> covariance @ directions``, one pass over the vectors each."""

    def product(directions: np.ndarray) -> np.ndarray:
        return _summed(packed, lambda y: y.T @ (y @ directions), directions.shape) / packed.n

    return product


def trace(packed: Packed) -> float:
    return float(_summed(packed, lambda y: np.array([[np.einsum("ij,ij->", y, y)]]), (1, 1))[0, 0]) / packed.n


def _orthonormal(new: np.ndarray, basis: np.ndarray) -> np.ndarray:
    """An orthonormal basis of what ``new`` adds to ``basis``."""
    kept: list[np.ndarray] = []
    for column in new.T:
        size = np.linalg.norm(column)
        if not size > 0:
            continue
        v = column / size
        for _ in range(3):
            v = v - basis @ (basis.T @ v)
            for k in kept:
                v = v - k * (k @ v)
            size = np.linalg.norm(v)
            if size < 1e-10:  # adds nothing but rounding
                break
            v = v / size
        else:
            kept.append(v)
    return np.array(kept).T if kept else np.zeros((len(new), 0))


def corrections(product: Callable, known: np.ndarray, values: np.ndarray, residuals: np.ndarray, steps: int) -> np.ndarray:
    """MINRES for (I - QQ')(V - value)(I - QQ') t = -residual, one equation a column, all in step.

    Lanczos vectors of the projected operators, one product a step for all equations; the coefficients
    are those of least residual.
    """

    def project(x: np.ndarray) -> np.ndarray:
        x = x - known @ (known.T @ x)
        return x - known @ (known.T @ x)

    start = project(-residuals)
    size = np.linalg.norm(start, axis=0)
    v = start / np.where(size > 0, size, 1)
    before, beta = np.zeros_like(v), np.zeros(len(values))
    vectors, alphas, betas = [], [], []
    for _ in range(steps):
        vectors.append(v)
        w = project(product(v) - v * values) - before * beta
        alpha = (v * w).sum(axis=0)
        w = w - v * alpha
        for u in vectors:  # few steps, so they are kept orthogonal in full
            w = w - u * (u * w).sum(axis=0)
        beta = np.linalg.norm(w, axis=0)
        alphas.append(alpha)
        betas.append(beta)
        before, v = v, w / np.where(beta > 0, beta, 1)
    out = np.zeros_like(residuals)
    for k in range(len(values)):
        t = np.zeros((steps + 1, steps))
        for j in range(steps):
            t[j, j], t[j + 1, j] = alphas[j][k], betas[j][k]
            if j:
                t[j - 1, j] = betas[j - 1][k]
        right = np.zeros(steps + 1)
        right[0] = size[k]
        y = np.linalg.lstsq(t, right, rcond=None)[0]
        out[:, k] = sum(vectors[j][:, k] * y[j] for j in range(steps))
    return project(out)


def jacobi_davidson(product: Callable[[np.ndarray], np.ndarray], d: int, wanted: int, steps: int = STEPS) -> tuple[np.ndarray, np.ndarray]:
    """The greatest eigenvalues of a symmetric operator, falling, and their unit vectors as columns."""
    wanted = min(wanted, d)
    rng = np.random.default_rng(SEED)
    basis = _orthonormal(rng.standard_normal((d, min(d, wanted + 2))), np.zeros((d, 0)))
    images = product(basis)
    best, idle = np.inf, 0
    for _ in range(ROUNDS):
        small = basis.T @ images
        values, turn = np.linalg.eigh((small + small.T) / 2)
        values, turn = values[::-1], turn[:, ::-1]
        ritz = basis @ turn[:, :wanted]
        residuals = images @ turn[:, :wanted] - ritz * values[:wanted]
        size = np.linalg.norm(residuals, axis=0)
        locked = size <= TOLERANCE * max(abs(values[0]), np.finfo(float).tiny)
        idle = 0 if size.max() < 0.5 * best else idle + 1
        best = min(best, size.max())
        # Rounding may keep a residual just above the bound; a full space holds the exact pairs.
        if locked.all() or basis.shape[1] == d or (idle >= 4 and best <= 100 * TOLERANCE * abs(values[0])):
            return values[:wanted], ritz
        if basis.shape[1] + (~locked).sum() > max(WIDEST * wanted, 64):
            keep = min(RESTART * wanted, basis.shape[1])
            basis, images = basis @ turn[:, :keep], images @ turn[:, :keep]
        change = corrections(product, ritz, values[:wanted][~locked], residuals[:, ~locked], steps)
        new = _orthonormal(change, basis)
        if not new.shape[1]:
            new = _orthonormal(rng.standard_normal((d, 1)), basis)
        basis, images = np.hstack([basis, new]), np.hstack([images, product(new)])
    raise RuntimeError(f"no convergence in {ROUNDS} rounds: residuals {size}")


def whitened(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """``key``, component, n, deviation, whitened, explained, identity_error, see ``op13_whitening``."""
    packed = pack(vectors, key, vector)
    n, d, sums = packed.n, len(packed.sums), packed.sums
    schema = f"`{key}` {packed.id_type}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    if not n:
        return packed.blocks.sparkSession.createDataFrame([], schema)
    product = covariance_product(packed)
    values, directions = jacobi_davidson(product, d, components)
    some = values > LEAST * max(values[0], 0)
    values, directions = values[some], directions[:, some]
    turn = directions / np.sqrt(values)
    k = turn.shape[1]
    if not k:
        return packed.blocks.sparkSession.createDataFrame([], schema)
    explained = values / trace(packed)
    # The covariance of what is returned, from its values: products above the diagonal, and sums beside them.
    seen = _summed(packed, lambda y: (lambda z: np.hstack([z.T @ z, z.sum(axis=0)[:, None]]))(y @ turn), (k, k + 1)) / n
    error = float(np.abs(seen[:, :k] - np.outer(seen[:, k], seen[:, k]) - np.eye(k)).max())
    mean = packed.mean
    wrapped = np.array([s % (1 << 64) for s in sums], np.uint64).view(np.int64)

    def deviations(x: np.ndarray) -> pa.Array:
        near = (((x - mean) * n) ** 2).sum(axis=1)
        exact = ((x * np.int64(n) - wrapped) ** 2).sum(axis=1)  # modulo 2^64, so right wherever a long holds it
        out = near >= 2.0**63
        for row in np.flatnonzero(np.abs(near / 2.0**63 - 1) < 1e-6):
            out[row] = sum((n * int(c) - s) ** 2 for c, s in zip(x[row], sums)) >= 1 << 63
        return pa.array(exact, pa.int64(), mask=out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            wide = batch.column("wide").to_pylist()
            for row in range(batch.num_rows):
                ids = batch.column("ids")[row].values
                x = _matrix(wide[row], batch.column("data")[row].as_buffer(), d).astype(np.int64)
                z = (x - mean) @ turn
                each = pa.array(np.repeat(np.arange(len(x)), k))
                yield pa.RecordBatch.from_arrays([
                    ids.take(each), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))), pa.array(np.full(len(x) * k, n)),
                    deviations(x).take(each), pa.array(z.ravel()), pa.array(np.tile(explained, len(x))), pa.array(np.full(len(x) * k, error)),
                ], [key, "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return packed.blocks.select("ids", "wide", "data").mapInArrow(run, schema)


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whitened components of every valid vector of ``embeddings``."""
    return whitened(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


QUERIES = {"op13_whitening": op13_whitening}
ORACLE: dict[str, str] = {}
