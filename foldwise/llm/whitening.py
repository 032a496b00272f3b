"""Embedding whitening by an incremental eigendecomposition.

Partitions keep the largest eigenpairs of their scatter matrix and update them with one centred
vector at a time: the eigenvalues of ``D + z z'`` are the roots of a secular equation, one behind
every pole, found after the entries that change nothing are deflated. Spectra of streams, partitions
and groups are combined by the same rank-one updates, one per eigenvector. The result, completed to
an orthonormal basis, is nearly that of the whole; a distributed pass gathers the covariance in this
basis (Rayleigh-Ritz), whose small eigenproblem refines it to double precision.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foldwise.workspace import materialize

SCALE, SHIFT = 64, 1_000_000
#: Entries, as whole numbers, beyond which the job stops: their squares would not fit 64 bits.
MOST_UNIT = 1 << 40
#: Eigenpairs an incremental spectrum keeps beyond the components asked for.
SPARE = 4
#: Spectra that one task updates side by side; it deals its vectors to them.
STREAMS = 32
#: Spectra, or sums of products, put together by one task.
FAN = 32
#: Steps of the secular equation's solver at most.
STEPS = 8
EPS = np.finfo(float).eps
_SPECTRUM = "part long, n long, mean array<double>, roots array<double>, basis binary"


def secular_roots(poles: np.ndarray, weights: np.ndarray, active: np.ndarray) -> tuple:
    """Roots of ``1 + sum(w / (d - x)) = 0``, one behind every active pole, of a stack of equations.

    Active poles stand first and increase. Returns ``(nearest pole, distance from it)``: the distance
    is sought by itself, so that it keeps its relative precision next to the pole.
    """
    weights = np.where(active, weights, 0.0)
    size, places = active.sum(1), np.arange(poles.shape[1])
    final = places[None, :] == size[:, None] - 1
    # Poles that are not active stand far off, with nothing to add.
    poles = np.where(active, poles, 4 * (np.abs(poles).max(1) + weights.sum(1) + 1)[:, None])
    following = np.concatenate([poles[:, 1:], poles[:, -1:]], axis=1)
    width = np.where(final, weights.sum(1)[:, None] * (1 + 8 * EPS), following - poles)
    width = np.where(active, width, 1.0)
    with np.errstate(divide="ignore", invalid="ignore", over="ignore"):
        away = poles[:, None, :] - (poles + width / 2)[:, :, None]
        left = (1 + np.einsum("sij,sj->si", 1 / away, weights) >= 0) | final
        origin = np.where(left, places[None, :], np.minimum(places + 1, places[-1])[None, :])
        gap = poles[:, None, :] - np.take_along_axis(poles, origin, 1)[:, :, None]
        # Terms of the poles up to the root's own and of those behind it.
        upto = np.tril(np.ones((len(places), len(places)))) * weights[:, None, :]
        behind = weights[:, None, :] - upto
        lower = np.where(left, 0.0, -width)
        upper = np.where(left, width, 0.0)
        low = np.where(left, 0.0, -width / 2)
        high = np.where(left, np.where(final, width, width / 2), 0.0)
        x, done = (low + high) / 2, ~active
        for _ in range(STEPS):
            inverse = 1 / (gap - x[:, :, None])
            value = 1 + np.einsum("sij,sj->si", inverse, weights)
            inverse *= inverse
            below = np.einsum("sij,sij->si", inverse, upto)
            above = np.einsum("sij,sij->si", inverse, behind)
            high, low = np.where(value >= 0, x, high), np.where(value >= 0, low, x)
            # One pole on either side of the root and a constant, with this value and slopes.
            one, two = lower - x, upper - x
            a = (one + two) * value - one * two * (below + above)
            b, c = one * two * value, value - one * below - two * above
            root = np.sqrt(np.maximum(a * a - 4 * b * c, 0.0))
            step = np.where(a <= 0, (a - root) / (2 * c), 2 * b / (a + root))
            # Behind the last pole there is none: c + s / (one - step) = 0.
            lone = one + below * one * one / (value - one * below)
            step = np.where(final, lone, step)
            new = x + step
            new = np.where((new > low) & (new < high), new, (low + high) / 2)
            # Convergence is quadratic: the step after one of this size is below rounding.
            small = np.abs(step) <= 1e-7 * np.abs(x)
            new = np.where(small, np.clip(x + step, low, high), new)
            x = np.where(done, x, new)
            done |= small
            if done.all():
                break
    return origin, x


def _separate(poles, z, columns, active, tiny) -> None:
    """Of equal active poles all but the last are turned out of ``z`` (deflated), in place."""
    for s in np.flatnonzero(_crowded(poles, active, tiny)):
        last = -1
        for i in np.flatnonzero(active[s]):
            if last >= 0 and poles[s, i] - poles[s, last] <= tiny[s]:
                size = np.hypot(z[s, i], z[s, last])
                c, d = z[s, i] / size, z[s, last] / size
                columns[s][:, [last, i]] = columns[s][:, [last, i]] @ np.array([[c, d], [-d, c]])
                z[s, last], z[s, i], active[s, last] = 0.0, size, False
            last = i


def _crowded(poles, active, tiny) -> np.ndarray:
    sorted_poles = np.sort(np.where(active, poles, np.inf), axis=1)
    with np.errstate(invalid="ignore"):
        return (np.diff(sorted_poles, axis=1) <= tiny[:, None]).any(1)


def rank_one_update(
    roots: np.ndarray, basis: np.ndarray, vectors: np.ndarray, scales: np.ndarray
) -> tuple[np.ndarray, np.ndarray]:
    """Largest eigenpairs of ``B diag(roots) B' + scale v v'`` of a stack of spectra.

    ``roots`` increase; eigenvectors are columns, and a column of zeros with root 0 is a free place.
    The vector's part outside the basis is one more direction; of the eigenpairs then found, the
    smallest is dropped. Scales are not negative.
    """
    v = vectors * np.sqrt(scales)[:, None]
    inside = (v[:, None, :] @ basis)[:, 0]
    outside = v - (basis @ inside[:, :, None])[:, :, 0]
    again = (outside[:, None, :] @ basis)[:, 0]
    inside, outside = inside + again, outside - (basis @ again[:, :, None])[:, :, 0]
    norm, size = np.sqrt((v * v).sum(1)), np.sqrt((outside * outside).sum(1))
    new = size > 32 * EPS * norm
    unit = np.where(new[:, None], outside / np.where(new, size, 1.0)[:, None], 0.0)
    poles = np.concatenate([np.zeros((len(v), 1)), roots], axis=1)
    z = np.concatenate([np.where(new, size, 0.0)[:, None], inside], axis=1)
    columns = np.concatenate([unit[:, :, None], basis], axis=2)

    tiny = 8 * EPS * (poles[:, -1] + norm * norm)
    active = np.abs(z) * norm[:, None] > tiny[:, None]
    _separate(poles, z, columns, active, tiny)
    order = np.argsort(np.where(active, poles, np.inf), axis=1, kind="stable")
    poles, z, active = (np.take_along_axis(x, order, 1) for x in (poles, z, active))
    columns = np.take_along_axis(columns, order[:, None, :], 2)

    origin, shift = secular_roots(poles, z * z, active)
    values = np.where(active, np.take_along_axis(poles, origin, 1) + shift, poles)
    # Distances of poles from roots, and the vector for which these roots are exact: its
    # eigenvectors are orthogonal however far the solver went.
    away = poles[:, None, :] - np.take_along_axis(poles, origin, 1)[:, :, None] - shift[:, :, None]
    pair = active[:, :, None] & active[:, None, :]
    same = np.eye(poles.shape[1], dtype=bool)[None]
    apart = np.where(pair & ~same, poles[:, None, :] - poles[:, :, None], 1.0)
    ratio = np.where(pair, np.where(same, -away, away / apart), 1.0)
    exact = np.sqrt(np.abs(ratio.prod(1))) * np.where(z < 0, -1.0, 1.0)
    turn = np.where(pair, exact[:, None, :] / np.where(pair, away, 1.0), 0.0)
    turn = turn / np.sqrt(np.where(active, (turn * turn).sum(2), 1.0))[:, :, None]
    turn = np.where(active[:, :, None], turn, same)
    columns = columns @ turn.transpose(0, 2, 1)
    order = np.argsort(values, axis=1, kind="stable")[:, 1:]
    return np.take_along_axis(values, order, 1), np.take_along_axis(columns, order[:, None, :], 2)


class Spectra:
    """A stack of spectra: number and mean of the vectors seen, and eigenpairs of their scatter."""

    def __init__(self, count: int, size: int, rank: int) -> None:
        self.n, self.mean = np.zeros(count, np.int64), np.zeros((count, size))
        self.roots, self.basis = np.zeros((count, rank)), np.zeros((count, size, rank))

    def __len__(self) -> int:
        return len(self.n)

    def take(self, which) -> Spectra:
        out = Spectra.__new__(Spectra)
        for name in ("n", "mean", "roots", "basis"):
            setattr(out, name, getattr(self, name)[which])
        return out

    def add(self, vectors: np.ndarray) -> None:
        """One more vector for each of the first spectra, centred by the mean so far."""
        k = slice(0, len(vectors))
        away, n = vectors - self.mean[k], self.n[k]
        self.roots[k], self.basis[k] = rank_one_update(self.roots[k], self.basis[k], away, n / (n + 1))
        self.n[k] += 1
        self.mean[k] += away / self.n[k][:, None]

    def merge(self, other: Spectra) -> None:
        """Another stack: an update per eigenvector of it, and one for the distance of the means."""
        for i in range(other.roots.shape[1]):
            self.roots, self.basis = rank_one_update(
                self.roots, self.basis, other.basis[:, :, i], np.maximum(other.roots[:, i], 0.0)
            )
        n = np.maximum(self.n + other.n, 1)
        away = other.mean - self.mean
        self.roots, self.basis = rank_one_update(self.roots, self.basis, away, self.n * other.n / n)
        self.mean = self.mean + away * (other.n / n)[:, None]
        self.n = self.n + other.n

    def combined(self) -> Spectra:
        """One spectrum of all, by halves."""
        stack = self.take(self.n > 0)
        while len(stack) > 1:
            half = len(stack) // 2
            merged, odd = stack.take(slice(0, half)), stack.take(slice(2 * half, None))
            merged.merge(stack.take(slice(half, 2 * half)))
            stack = _stacked([merged, odd])
        return stack

    def rows(self, part: int) -> pa.RecordBatch:
        columns = [
            pa.array([part] * len(self), pa.int64()),
            pa.array(self.n),
            pa.array(list(self.mean), pa.list_(pa.float64())),
            pa.array(list(self.roots), pa.list_(pa.float64())),
            pa.array([b.tobytes() for b in self.basis], pa.binary()),
        ]
        return pa.RecordBatch.from_arrays(columns, names="part n mean roots basis".split())


def _stacked(parts: list[Spectra]) -> Spectra:
    out = Spectra.__new__(Spectra)
    for name in ("n", "mean", "roots", "basis"):
        setattr(out, name, np.concatenate([getattr(p, name) for p in parts]))
    return out


def _spectra(rows: list[dict]) -> Spectra:
    out = Spectra.__new__(Spectra)
    out.n = np.array([r["n"] for r in rows], np.int64)
    out.mean, out.roots = (np.array([r[c] for r in rows], float) for c in ("mean", "roots"))
    size, rank = out.mean.shape[1], out.roots.shape[1]
    out.basis = np.stack([np.frombuffer(r["basis"]).reshape(size, rank) for r in rows])
    return out


def _whole_numbers(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(len(batch), -1)


def usable_rows(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """``(id, x)``, ``x = floor(64 c) + 1000000``, of the rows whose vector has finite entries only.

    NULL vectors, NULL or non-finite entries and empty vectors drop the row. An entry too large
    for exact sums stops the job.
    """
    vector = F.col(f"`{vector_col}`")
    finite = F.forall(vector, lambda c: F.coalesce(F.abs(c.cast("double")) < float("inf"), F.lit(False)))
    rows = df.where(vector.isNotNull() & (F.size(vector) > 0) & finite)
    x = F.transform(vector, lambda c: F.floor(c.cast("double") * SCALE) + SHIFT)
    rows = rows.select(F.col(f"`{id_col}`").alias("id"), x.cast("array<bigint>").alias("x"))
    large = F.exists("x", lambda c: F.abs(c) > MOST_UNIT)
    error = F.raise_error(F.lit("an embedding's entry is too large"))
    return rows.select("id", F.when(large, error).otherwise(F.col("x")).alias("x"))


def exact_sums(fit: DataFrame) -> tuple[int, list[int]]:
    """Number of vectors and per-dimension sums, in whole numbers without rounding."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths = np.diff(np.asarray(batch.column("x").offsets))
            if len(set(lengths.tolist())) > 1:
                raise ValueError("vectors differ in length")
            if len(batch):
                x = _whole_numbers(batch)
                places = np.arange(x.shape[1], dtype=np.int32)
                columns = [pa.array(places), pa.array(x.sum(0)), pa.array(np.full(len(places), len(x)))]
                yield pa.RecordBatch.from_arrays(columns, names=["at", "s", "n"])

    parts = fit.select("x").mapInArrow(sums, "at int, s long, n long")
    exact = F.sum(F.col("s").cast("decimal(20,0)")).alias("s")
    rows = sorted(parts.groupBy("at").agg(exact, F.sum("n").alias("n")).collect())  # one per dimension
    if len({r.n for r in rows}) > 1:
        raise ValueError("vectors differ in length")
    return (rows[0].n if rows else 0), [int(r.s) for r in rows]


def incremental_spectrum(fit: DataFrame, size: int, rank: int, fan: int = FAN) -> Spectra:
    """The combined spectrum of the partitions of ``fit`` (column ``x``)."""

    def partition(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Spectra(STREAMS, size, rank)
        for batch in batches:
            x = _whole_numbers(batch).astype(float) - SHIFT
            for at in range(0, len(x), STREAMS):
                own.add(x[at : at + STREAMS])
        if own.n.any():
            yield own.combined().rows(TaskContext.get().partitionId())

    def combine(table: pa.Table) -> pa.Table:
        rows = sorted(table.to_pylist(), key=lambda r: r["part"])
        return pa.Table.from_batches([_spectra(rows).combined().rows(rows[0]["part"] // fan)])

    spectra = materialize(fit.select("x").mapInArrow(partition, _SPECTRUM), "spectra")
    most = spectra.agg(F.max("part")).first()[0]
    while most >= fan:
        group = spectra.groupBy(F.floor(F.col("part") / fan))
        spectra = materialize(group.applyInArrow(combine, _SPECTRUM), "spectra")
        most //= fan
    rows = sorted((r.asDict() for r in spectra.collect()), key=lambda r: r["part"])  # at most ``fan``
    return _spectra(rows).combined()


def gathered(fit: DataFrame, center: np.ndarray, turn: np.ndarray, fan: int = FAN) -> np.ndarray:
    """Sum over ``fit`` of ``y y'`` for ``y = (x - center) turn``, in one pass.

    Products of whole partitions are added in groups; the driver adds ``fan`` of them.
    """
    width = turn.shape[1]

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, seen = np.zeros((width, width)), False
        for batch in batches:
            if len(batch):
                y = (_whole_numbers(batch) - center) @ turn
                total, seen = total + y.T @ y, True
        if seen:
            yield pa.RecordBatch.from_arrays([pa.array([total.ravel()])], names=["v"])

    def add(table: pa.Table) -> pa.Table:
        return pa.table({"v": [np.sum([np.asarray(v) for v in table.column("v").to_pylist()], axis=0)]})

    parts = fit.select("x").mapInArrow(products, "v array<double>")
    group = F.pmod(F.spark_partition_id(), F.lit(fan))
    summed = parts.groupBy(group).applyInArrow(add, "v array<double>").collect()
    return np.sum([np.array(r.v) for r in summed], axis=0).reshape(width, width)


class Whitening:
    """A fit: ``n``, exact sums, eigenpairs by falling eigenvalue, and how well they whiten."""

    def __init__(self, n, sums, values, vectors, trace, identity_error) -> None:
        self.n, self.sums, self.values, self.vectors = n, sums, values, vectors
        self.trace, self.identity_error = trace, identity_error


def fit_whitening(fit: DataFrame, components: int = 16) -> Whitening | None:
    """The whitening of distinct vectors ``x``, written by the caller; None without vectors.

    At most ``components`` with an eigenvalue above rounding are kept.
    """
    n, sums = exact_sums(fit)
    if not n:
        return None
    size = len(sums)
    center = np.array([s / n for s in sums])
    start = incremental_spectrum(fit, size, min(size, components + SPARE))
    # Completed by unit vectors, and made orthonormal to the last digit.
    order = np.argsort(-start.roots[0], kind="stable")
    full = np.concatenate([start.basis[0][:, order], np.eye(size)], axis=1)
    used = np.abs(full).max(0) > 0
    vectors = _orthonormal(full[:, used])
    values, turn = np.linalg.eigh(gathered(fit, center, vectors) / n)
    values, vectors = values[::-1], np.linalg.qr(vectors @ turn[:, ::-1])[0]
    trace = float(values.sum())
    kept = (values > size * EPS * trace) & (np.arange(size) < components)
    values, vectors = values[kept], vectors[:, kept]
    if not len(values):
        return Whitening(n, sums, values, vectors, trace, 0.0)
    second = gathered(fit, center, vectors / np.sqrt(values)) / n
    error = float(np.abs(second - np.eye(len(values))).max())
    return Whitening(n, sums, values, vectors, trace, error)


def _orthonormal(columns: np.ndarray) -> np.ndarray:
    """An orthonormal basis of the whole space whose first vectors are those of ``columns``."""
    size, made = len(columns), np.zeros((len(columns), 0))
    for column in columns.T:
        if made.shape[1] == size:
            break
        for _ in range(2):
            column = column - made @ (made.T @ column)
        norm = np.sqrt(column @ column)
        if norm > 1e-3:
            made = np.concatenate([made, (column / norm)[:, None]], axis=1)
    return made


_WHITENED = (
    "component int, n long, deviation long, whitened double, explained double, identity_error double"
)


def whiten(rows: DataFrame, model: Whitening) -> DataFrame:
    """``(id, component, n, deviation, whitened, explained, identity_error)``, a row per component."""
    sums, n, width = model.sums, model.n, len(model.values)
    center = np.array([s / n for s in sums])
    scaled, explained = model.vectors / np.sqrt(model.values), model.values / model.trace
    error = model.identity_error
    id_field = T.StructField("id", rows.schema["id"].dataType)
    schema = T.StructType([id_field, *T._parse_datatype_string(_WHITENED).fields])
    names = schema.names
    floors = np.array([s // n for s in sums], np.int64)
    rests = np.array([s % n for s in sums], np.int64)

    def deviations(x: np.ndarray) -> np.ndarray:
        """Sum of ``(n x - S)^2``, in larger whole numbers where 64 bits would not do on the way."""
        away = x - floors
        most = n * (int(np.abs(away).max()) + 1)
        if most * most * len(sums) < 2**63:
            return ((away * n - rests) ** 2).sum(1)
        return ((away.astype(object) * n - rests) ** 2).sum(1)

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            x, rows = _whole_numbers(batch), len(batch)
            columns = [
                batch.column("id").take(pa.array(np.repeat(np.arange(rows), width))),
                pa.array(np.tile(np.arange(1, width + 1, dtype=np.int32), rows)),
                pa.array(np.full(rows * width, n, np.int64)),
                pa.array(np.repeat(deviations(x).astype(np.int64), width)),
                pa.array(((x - center) @ scaled).ravel()),
                pa.array(np.tile(explained, rows)),
                pa.array(np.full(rows * width, error)),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return rows.mapInArrow(spread, schema)


def whitened_embeddings(df: DataFrame, id_col: str, vector_col: str, components: int = 16) -> DataFrame:
    """Every usable row's whitened components, fitted on the distinct vectors; see ``whiten``.

    Repeated rows and ids each give rows; a NULL id stays. Components without variance have no
    rows: none where all vectors are equal, and none for an empty table. Vectors of different
    lengths are an error, as is a deviation beyond 64 bits.
    """
    rows = materialize(usable_rows(df, id_col, vector_col), "units")
    fit = materialize(rows.select("x").distinct(), "distinct-units")
    model = fit_whitening(fit, components)
    if model is None or not len(model.values):
        id_type = rows.schema["id"].dataType.simpleString()
        return rows.sparkSession.createDataFrame([], f"id {id_type}, {_WHITENED}")
    return whiten(rows, model)
