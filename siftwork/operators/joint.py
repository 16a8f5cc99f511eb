"""One model of utility and spread, trained on all four terms of the loss at once.

mu is linear in [1, z_x, z_p, z_t] and the products of their leading entries, sigma is the softplus of a second linear
form of the same inputs. z_p and z_t are those of a few (configuration, task) cells, so within a cell both forms are
linear in z_x alone: a row costs z_x times its cells, and no row's inputs are laid out in full. Every evaluation of loss
and gradient is one Spark job over the stored rows; the driver holds the two coefficient vectors and the last steps of
the descent.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwork.operators.model import SIGMA_FLOOR, WEIGHTS
from siftwork.operators.sampling import rank_pairs
from siftwork.session import cut_lineage

SLOTS = 32  # partial sums that reach the driver
ROWS = 4096  # samples that are stored and worked on as one block


def inputs(x, p, t) -> list[Column]:
    """z_x, z_p and z_t of one row; a part left out is an empty array."""
    return [F.coalesce(F.col(c).cast("array<double>"), F.array().cast("array<double>")) for c in (x, p, t)]


def _form(x: np.ndarray, p: np.ndarray, t: np.ndarray, rank: int, *coefficients: np.ndarray) -> list[np.ndarray]:
    """Linear forms of [1, x, p, t, products of x and p, products of x and t] of many rows.

    Each row is summed in the same order wherever it stands, so equal rows get equal values.
    """
    lead = x[:, :rank, None]
    parts = [x, p, t, *[(lead * o[:, None, :rank]).reshape(len(x), lead.shape[1] * o[:, :rank].shape[1]) for o in (p, t)]]
    at = np.cumsum([1, *[q.shape[1] for q in parts]])
    return [w[0] + sum((q * w[i : i + q.shape[1]]).sum(axis=1) for q, i in zip(parts, at)) for w in coefficients]


def _lists(column) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Values of a column of arrays, each row's length, and which rows hold a NULL."""
    values, size = column.flatten(), np.diff(np.asarray(column.offsets))
    gone = np.zeros(len(column), bool)
    if values.null_count:
        gone[np.repeat(np.arange(len(column)), size)[np.asarray(values.is_null().to_numpy(zero_copy_only=False))]] = True
    return values.to_numpy(zero_copy_only=False).astype(np.float64), size, gone


def _scores(rank: int, w: np.ndarray, v: np.ndarray) -> Callable:
    """[mu, z] of rows of inputs; NULL where an input is NULL or their number is not the model's."""

    def run(x, p, t):
        import pyarrow as pa

        flat, sizes, gone = zip(*[_lists(c) for c in (x, p, t)])
        starts = [np.cumsum(n) - n for n in sizes]
        out, bad = np.zeros((len(x), 2)), np.logical_or.reduce(gone)
        shapes, kind = np.unique(np.stack(sizes, axis=1), axis=0, return_inverse=True)
        for k, shape in enumerate(shapes.tolist()):
            lead = [min(rank, n) for n in shape]
            some = np.flatnonzero(kind.ravel() == k)
            if 1 + sum(shape) + lead[0] * (lead[1] + lead[2]) != len(w):
                bad[some] = True
                continue
            parts = [f[at[some][:, None] + np.arange(n)] for f, at, n in zip(flat, starts, shape)]
            out[some] = np.stack(_form(*parts, rank, w, v), axis=1)
        offsets = pa.array(np.arange(0, 2 * len(x) + 1, 2, dtype=np.int32))
        return pa.ListArray.from_arrays(offsets, pa.array(out.ravel()), mask=pa.array(bad))

    return run


def _softplus(z):
    return np.maximum(z, 0) + np.log1p(np.exp(-np.abs(z)))


def _sigmoid(z):
    e = np.exp(-np.abs(z))
    return np.where(z >= 0, 1, e) / (1 + e)


def _huber(e):
    a = np.abs(e)
    return np.where(a <= 1, 0.5 * e * e, a - 0.5), np.clip(e, -1, 1)


def row_slopes(mu: np.ndarray, z: np.ndarray, u_lo: np.ndarray, u_hi: np.ndarray, share: dict) -> tuple[float, np.ndarray, np.ndarray]:
    """Loss of rows and its slopes in mu and z: Huber on the label and on the proxy, and the likelihood of the label.

    NaN stands for a missing value; ``share`` weighs each term's sum.
    """
    has, known = ~np.isnan(u_hi), ~np.isnan(u_lo)
    loss, g_mu, g_z = 0.0, np.zeros(len(mu)), np.zeros(len(mu))
    for name, target, some in (("reg", u_hi, has), ("proxy", u_lo, known)):
        value, slope = _huber(mu[some] - target[some])
        loss += share[name] * value.sum()
        g_mu[some] += share[name] * slope
    s = _softplus(z[has]) + SIGMA_FLOOR
    gap = mu[has] - u_hi[has]
    loss += share["unc"] * (0.5 * gap**2 / s**2 + np.log(s)).sum()
    g_mu[has] += share["unc"] * gap / s**2
    g_z[has] += share["unc"] * (1 / s - gap**2 / s**3) * _sigmoid(z[has])
    return float(loss), g_mu, g_z


def row_terms(f: np.ndarray, u_lo: np.ndarray, u_hi: np.ndarray, w: np.ndarray, v: np.ndarray, share: dict) -> tuple[float, np.ndarray, np.ndarray]:
    """``row_slopes`` of rows with inputs f, as gradients in w and v."""
    loss, g_mu, g_z = row_slopes(f @ w, f @ v, u_lo, u_hi, share)
    return loss, g_mu @ f, g_z @ f


def pair_slopes(z: np.ndarray, share: float) -> tuple[float, np.ndarray]:
    """Loss of pairs with signed differences z, -log sigmoid(z), and its slopes in z."""
    return float(share * _softplus(-z).sum()), -share * _sigmoid(-z)


def pair_terms(left: np.ndarray, right: np.ndarray, sign: np.ndarray, w: np.ndarray, share: float) -> tuple[float, np.ndarray]:
    """Loss and gradient of pairs: -log sigmoid(sign (mu_left - mu_right))."""
    d = sign[:, None] * (left - right)
    loss, slope = pair_slopes(d @ w, share)
    return loss, slope @ d


@dataclass(frozen=True)
class Conditions:
    """z_p and z_t of every (configuration, task) cell, a table as small as the registry."""

    keys: tuple
    p: np.ndarray
    t: np.ndarray

    @staticmethod
    def of(table: DataFrame) -> Conditions:
        rows = table.select("config", "task", "z_p", "z_t").orderBy("config", "task").collect()
        width = lambda c: np.array([r[c] or [] for r in rows], np.float64).reshape(len(rows), -1)
        return Conditions(tuple((r.config, r.task) for r in rows), width("z_p"), width("z_t"))


    def coefficients(self, w: np.ndarray, width: int, rank: int) -> tuple[np.ndarray, np.ndarray]:
        """Of each cell: the coefficients of x (``width`` rows, a column a cell) and the constant of the form w."""
        sizes = [1, width, self.p.shape[1], self.t.shape[1]]
        one, x, p, t, products = np.split(w, np.cumsum(sizes))
        a = np.repeat(x[:, None], len(self.keys), axis=1)
        lead = min(rank, width)
        for o in (self.p[:, :rank], self.t[:, :rank]):
            made, products = np.split(products, [lead * o.shape[1]])
            a[:lead] += made.reshape(lead, o.shape[1]) @ o.T
        return a, one + self.p @ p + self.t @ t

    def folded(self, n: np.ndarray, x: np.ndarray, rank: int) -> np.ndarray:
        """Weighted sums of all inputs, from each cell's sum of weights (n) and weighted sums of x (a row a cell)."""
        made = [(x[:, :rank].T @ o[:, :rank]).ravel() for o in (self.p, self.t)]
        return np.concatenate(([n.sum()], x.sum(axis=0), n @ self.p, n @ self.t, *made))

    def squared(self) -> Conditions:
        return Conditions(self.keys, self.p**2, self.t**2)


PACKED = "pair boolean, n int, width int, x binary, other binary, row binary, cell binary, u_lo binary, u_hi binary"


def _packed(rows: DataFrame) -> DataFrame:
    """Blocks of up to ROWS rows (x, other, cells) of one kind: their numbers as bytes, and the row of each cell."""

    def run(batches) -> Iterator:
        import pyarrow as pa

        for b in batches:
            paired = ~np.asarray(b.column("other").is_null().to_numpy(zero_copy_only=False))
            for pair in (False, True):
                chosen = np.flatnonzero(paired == pair)
                for at in range(0, len(chosen), ROWS):
                    part = b.take(pa.array(chosen[at : at + ROWS]))
                    n, cells = part.num_rows, part.column("cells")
                    flat = cells.flatten()
                    row = np.repeat(np.arange(n), np.diff(np.asarray(cells.offsets)))
                    cell, lo, hi = (flat.field(c).to_numpy(zero_copy_only=False) for c in ("cell", "u_lo", "u_hi"))
                    x = part.column("x").flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(n, -1)
                    other = part.column("other").flatten().to_numpy(zero_copy_only=False).astype(np.float64)
                    made = (x, other, row.astype(np.int32), cell.astype(np.int32), lo.astype(np.float64), hi.astype(np.float64))
                    columns = [pa.array([pair]), pa.array([n], pa.int32()), pa.array([x.shape[1]], pa.int32()), *[pa.array([m.tobytes()], pa.binary()) for m in made]]
                    yield pa.RecordBatch.from_arrays(columns, names=names)

    names = [c.split()[0] for c in PACKED.split(", ")]
    return rows.select("x", "other", "cells").mapInArrow(run, PACKED)


def _blocks(batches, wide: bool = True) -> Iterator[tuple]:
    """(pair, x, other, row, cell, u_lo, u_hi) of the stored blocks; x has no columns where it is not ``wide``."""
    for b in batches:
        for r in range(b.num_rows):
            pair, n, width = (b.column(c)[r].as_py() for c in ("pair", "n", "width"))
            x, other, lo, hi = (np.frombuffer(b.column(c)[r].as_buffer(), np.float64) for c in ("x", "other", "u_lo", "u_hi"))
            row, cell = (np.frombuffer(b.column(c)[r].as_buffer(), np.int32).astype(np.int64) for c in ("row", "cell"))
            x, other = x.reshape(n, width), other.reshape(n if pair else 0, width)
            if not wide:
                x, other = x[:, :0], other[:, :0]
            yield pair, x, other, row, cell, lo, hi


def _cell_sums(weight: np.ndarray, x: np.ndarray, row: np.ndarray, cell: np.ndarray, cells: int) -> np.ndarray:
    """Each cell's sum of weights, then its weighted sums of x."""
    g = np.bincount(row * cells + cell, weights=weight, minlength=len(x) * cells).reshape(len(x), cells)
    return np.concatenate((g.sum(axis=0), (g.T @ x).ravel()))


def _partial(work: Callable):
    """One row a task: the slot it is added up in, and its sums."""

    def run(batches) -> Iterator:
        import pyarrow as pa

        total = work(batches)
        if total is not None:
            at = TaskContext.get().partitionId()
            yield pa.RecordBatch.from_arrays([pa.array([at % SLOTS]), pa.array([at]), pa.array([total.tobytes()], pa.binary())], names=["slot", "task", "sums"])

    return run


def _slot(table):
    import pyarrow as pa

    rows = sorted(zip(table.column("task").to_pylist(), table.column("sums").to_pylist()))
    total = sum(np.frombuffer(s) for _, s in rows)
    return pa.table({"slot": table.column("slot")[:1], "sums": pa.array([total.tobytes()], pa.binary())})


def _summed(rows: DataFrame, work: Callable) -> np.ndarray:
    """Sums over all rows: by task, then by slot, then SLOTS vectors on the driver."""
    parts = rows.mapInArrow(_partial(work), "slot bigint, task bigint, sums binary").groupBy("slot").applyInArrow(_slot, "slot bigint, sums binary")
    return sum(np.frombuffer(r.sums) for r in sorted(parts.collect(), key=lambda r: r.slot))


def descend(value: Callable[[np.ndarray], tuple[float, np.ndarray]], start: np.ndarray, steps: int = 40, keep: int = 10, tol: float = 1e-6) -> tuple[np.ndarray, list[float]]:
    """Limited-memory quasi-Newton descent with backtracking; (last point, losses)."""
    x, (f, g) = start.copy(), value(start)
    moves: list[tuple[np.ndarray, np.ndarray]] = []
    losses = [f]
    for _ in range(steps):
        d, used = -g, []
        for s, y in reversed(moves):
            a = (s @ d) / (y @ s)
            d = d - a * y
            used.append(a)
        if moves:
            s, y = moves[-1]
            d = d * (s @ y) / (y @ y)
        else:
            d = d / max(1.0, np.linalg.norm(g))
        for (s, y), a in zip(moves, reversed(used)):
            d = d + s * (a - (y @ d) / (y @ s))
        slope, size = g @ d, 1.0
        if slope >= 0:
            d, slope, moves = -g, -(g @ g), []
        while True:
            f2, g2 = value(x + size * d)
            if f2 <= f + 1e-4 * size * slope or size < 1e-6:
                break
            size /= 2
        if f2 > f:
            break
        if size * (d @ (g2 - g)) > 1e-12:
            moves = [*moves, (size * d, g2 - g)][-keep:]
        done = f - f2 <= tol * max(1.0, abs(f))
        x, f, g = x + size * d, f2, g2
        losses.append(f)
        if done:
            break
    return x, losses


@dataclass(frozen=True)
class JointScorer:
    w: np.ndarray
    v: np.ndarray
    rank: int
    parts: tuple[bool, bool, bool] = (True, True, True)  # which of z_x, z_p, z_t are inputs
    losses: tuple[float, ...] = ()

    def score(self, df: DataFrame, x: str = "z_x", p: str = "z_p", t: str = "z_t") -> DataFrame:
        """Add mu and sigma; all targets in one projection."""
        used = df
        for c, keep in zip((x, p, t), self.parts):
            if not keep:
                used = used.withColumn(c, F.array().cast("array<double>"))
        made = F.arrow_udf(_scores(self.rank, np.asarray(self.w, np.float64), np.asarray(self.v, np.float64)), "array<double>")
        both = made(*inputs(x, p, t))
        z = F.get("_s", 1)
        sigma = F.greatest(z, F.lit(0.0)) + F.log1p(F.exp(-F.abs(z))) + F.lit(SIGMA_FLOOR)
        scored = used.withColumn("_s", both).withColumn("mu", F.get("_s", 0)).withColumn("sigma", sigma)
        return scored.select(*[c for c in df.columns if c not in ("mu", "sigma")], "mu", "sigma")

    def coefficients(self, spark: SparkSession) -> DataFrame:
        """(i, w, v, rank, parts): the model as a table."""
        flags = "".join("1" if k else "0" for k in self.parts)
        rows = [(i, float(a), float(b), self.rank, flags) for i, (a, b) in enumerate(zip(self.w, self.v))]
        return spark.createDataFrame(rows, "i int, w double, v double, rank int, parts string")

    def save(self, spark: SparkSession, path: str) -> None:
        self.coefficients(spark).coalesce(1).write.mode("overwrite").parquet(path)


def from_coefficients(table: DataFrame) -> JointScorer:
    rows = table.orderBy("i").collect()
    return JointScorer(np.array([r.w for r in rows]), np.array([r.v for r in rows]), rows[0].rank, tuple(c == "1" for c in rows[0].parts))


def load(spark: SparkSession, path: str) -> JointScorer:
    return from_coefficients(spark.read.parquet(path))


def training_rows(triples: DataFrame, cond: Conditions, pairs_per_bucket: int = 256) -> DataFrame:
    """One row a sample with its cells, and one row a label pair, stored in blocks.

    ``triples``: sample_id, config, task, z_x, u_lo, u_hi (NULL where unknown). z_x is kept once a sample. Pairs are
    drawn per (config, task) among labelled rows; their number is bounded by cells x ``pairs_per_bucket``.
    """
    spark = triples.sparkSession
    cells = spark.createDataFrame([(*k, i) for i, k in enumerate(cond.keys)], "config string, task string, cell int")
    t = triples.join(F.broadcast(cells), ["config", "task"])
    cell = F.struct("cell", F.col("u_lo").cast("double").alias("u_lo"), F.col("u_hi").cast("double").alias("u_hi"))
    z = F.col("z_x").cast("array<double>")
    rows = t.groupBy("sample_id").agg(F.any_value(z).alias("x"), F.collect_list(cell).alias("cells"))
    rows = cut_lineage(rows.select("sample_id", "x", F.lit(None).cast("array<double>").alias("other"), "cells"))
    drawn = rank_pairs(t.where("u_hi IS NOT NULL").select("sample_id", "config", "task", "u_hi"), "u_hi", ["config", "task"], pairs_per_bucket)
    drawn = drawn.where("left_u <> right_u").join(F.broadcast(cells), ["config", "task"])
    sign = F.struct("cell", F.signum(F.col("left_u") - F.col("right_u")).alias("u_lo"), F.lit(None).cast("double").alias("u_hi"))
    left = rows.select(F.col("sample_id").alias("left_id"), "x")
    right = rows.select(F.col("sample_id").alias("right_id"), F.col("x").alias("other"))
    pairs = drawn.select("left_id", "right_id", F.array(sign).alias("cells")).join(left, "left_id").join(right, "right_id")
    return cut_lineage(_packed(rows.select("x", "other", "cells").unionByName(pairs.select("x", "other", "cells"))))


def _moments(cells: int, wide: bool) -> Callable:
    """Rows, labels, proxies and pairs, then each cell's rows and its sums of x and of its squares."""

    def work(batches):
        total = None
        for pair, x, _, row, cell, lo, hi in _blocks(batches, wide):
            one = np.ones(len(row))
            counts = [0, 0, 0, len(row)] if pair else [len(row), (~np.isnan(hi)).sum(), (~np.isnan(lo)).sum(), 0]
            sums = [_cell_sums(one * (not pair), f, row, cell, cells) for f in (x, x * x)]
            made = np.concatenate((counts, sums[0], sums[1][cells:]))
            total = made if total is None else total + made
        return total

    return work


def _gradient(a: np.ndarray, a0: np.ndarray, c: np.ndarray, c0: np.ndarray, share: dict, wide: bool) -> Callable:
    """Loss, and each cell's sums of slopes and of x times them; a, a0 make mu of x in each cell, c, c0 make z."""
    cells, half = len(a0), len(a0) * (1 + len(a))

    def work(batches):
        total = np.zeros(1 + 2 * half)
        for pair, x, other, row, cell, lo, hi in _blocks(batches, wide):
            if pair:
                d = x - other  # of one cell, so all other inputs are the same
                loss, g = pair_slopes(lo * (d @ a)[row, cell], share["rank"])
                made = _cell_sums(g * lo, d, row, cell, cells)
                made[:cells] = 0.0
                total[0] += loss
                total[1 : 1 + half] += made
            else:
                loss, g, h = row_slopes((x @ a)[row, cell] + a0[cell], (x @ c)[row, cell] + c0[cell], lo, hi, share)
                total += np.concatenate(([loss], _cell_sums(g, x, row, cell, cells), _cell_sums(h, x, row, cell, cells)))
        return total

    return work


def fit(
    rows: DataFrame,
    cond: Conditions,
    weights: tuple = WEIGHTS,
    rank: int = 4,
    start: JointScorer | None = None,
    steps: int = 40,
    ridge: float = 1e-4,
    parts: tuple[bool, bool, bool] = (True, True, True),
) -> JointScorer:
    """Least of w_rank * pairs + w_reg * Huber(u_hi) + w_proxy * Huber(u_lo) + w_unc * likelihood(u_hi), each a mean.

    A term of weight 0, or without rows, does not count: (0, 0, 1, 0) is the first phase, (1, .3, 0, .2) leaves the
    proxy out. ``parts`` leaves inputs out. Inputs are scaled by their deviation during the descent; the ridge is on
    scaled coefficients other than the intercept's.
    """
    empty = np.zeros((len(cond.keys), 0))
    cond = Conditions(cond.keys, cond.p if parts[1] else empty, cond.t if parts[2] else empty)
    cells, wide = len(cond.keys), parts[0]
    m = _summed(rows, _moments(cells, wide))
    n, width = m[0], (len(m) - 4 - cells) // (2 * cells)
    sums, squares = m[4 + cells :].reshape(2, cells, width)
    mean, square = cond.folded(m[4 : 4 + cells], sums, rank) / n, cond.squared().folded(m[4 : 4 + cells], squares, rank) / n
    d = len(mean)
    scale = np.sqrt(np.maximum(square - mean**2, 0))
    scale = np.where(scale > 1e-9, scale, 1.0)
    share = {name: weight / max(1.0, count) for name, weight, count in zip(("rank", "reg", "proxy", "unc"), weights, (m[3], m[1], m[2], m[1]))}
    penalty = np.full(2 * d, ridge)
    penalty[[0, d]] = 0.0

    def value(theta: np.ndarray) -> tuple[float, np.ndarray]:
        w, v = theta[:d] / scale, theta[d:] / scale
        total = _summed(rows, _gradient(*cond.coefficients(w, width, rank), *cond.coefficients(v, width, rank), share, wide))
        g = np.concatenate([cond.folded(h[:cells], h[cells:].reshape(cells, width), rank) for h in np.split(total[1:], 2)])
        g = g / np.concatenate((scale, scale))
        return float(total[0] + 0.5 * (penalty * theta * theta).sum()), g + penalty * theta

    first = np.zeros(2 * d) if start is None else np.concatenate((start.w * scale, start.v * scale))
    theta, losses = descend(value, first, steps)
    return JointScorer(theta[:d] / scale, theta[d:] / scale, rank, parts, tuple(losses))


# ------------------------------------------------------------------ calibration


def normal_equations(scored: DataFrame, features: list[Column], label: str = "u_hi", mu: str = "mu") -> DataFrame:
    """(i, j, xx) sums of products of the inputs and (i, -1, xy) with the residual ``label - mu``; one aggregation."""
    f = F.array(*features)
    d = scored.where(F.col(label).isNotNull()).select(f.alias("f"), (F.col(label) - F.col(mu)).alias("y"))
    both = d.select("f", F.posexplode("f").alias("i", "a"), "y").select("i", "a", F.posexplode(F.concat("f", F.array("y"))).alias("j", "b"))
    sums = both.groupBy("i", "j").agg(F.sum(F.col("a") * F.col("b")).alias("s"))
    return sums.select("i", F.when(F.col("j") < len(features), F.col("j")).otherwise(-1).alias("j"), "s")


def solve_ridge(equations: DataFrame, ridge: float) -> np.ndarray:
    """Coefficients of the residual; the equations are as many as inputs squared."""
    rows = equations.collect()
    d = 1 + max(r.i for r in rows)
    a, b = np.zeros((d, d)), np.zeros(d)
    for r in rows:
        if r.j < 0:
            b[r.i] = r.s
        else:
            a[r.i, r.j] = r.s
    return np.linalg.solve(a + ridge * np.eye(d), b)


def calibrated(scored: DataFrame, features: list[Column], coefficients: np.ndarray, mu: str = "mu") -> DataFrame:
    shift = sum((c * float(a) for c, a in zip(features, coefficients)), F.lit(0.0))
    return scored.withColumn(mu, F.col(mu) + shift)
