"""Kernels in packed blocks, and the solvers that pass over them.

A block holds some observations' whole rows as arrays. A product G' G X for all columns of X at once is one pass: tasks
multiply their blocks, their sums meet. A kernel that one task holds is sent to the tasks instead, and every case of a
problem is solved in a task of its own by the same code. Models are vectors of the grid, whose size callers check.
"""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.sources.tables import stored

#: Numbers of a kernel that a task holds (some 50 MB), and cells times cases whose vectors the driver and tasks hold.
MOST_KERNEL, MOST_CELLS = 1 << 22, 1 << 22
BLOCK = 1 << 18
#: Rows of a kernel up to which a task holds their matrix (128 MB).
MOST_ROWS = 1 << 12


class Arrays:
    """Blocks in memory: (starts of rows, cells of their numbers, numbers, data)."""

    def __init__(self, n: int, blocks: list[tuple[bytes, bytes, bytes, bytes]]):
        self.n = n
        self.blocks = [(np.frombuffer(s, np.int64), np.frombuffer(c, np.int32), np.frombuffer(v), np.frombuffer(d)) for s, c, v, d in blocks]
        self.passes = 0

    def _rows(self, block: tuple, x: np.ndarray) -> np.ndarray:
        starts, cells, values, _ = block
        return np.add.reduceat(values * x[cells], starts)

    def _back(self, block: tuple, q: np.ndarray) -> np.ndarray:
        starts, cells, values, _ = block
        lengths = np.diff(np.append(starts, len(cells)))
        return np.bincount(cells, values * np.repeat(q, lengths), self.n)

    def times(self, x: np.ndarray) -> np.ndarray:
        """G' G x for each column of x (cells, columns)."""
        self.passes += 1
        out = np.zeros_like(x)
        for block in self.blocks:
            for k in range(x.shape[1]):
                out[:, k] += self._back(block, self._rows(block, x[:, k]))
        return out

    def start(self) -> np.ndarray:
        """(3, cells): G' d, the columns' sums of squares, and their sums."""
        out = np.zeros((3, self.n))
        for block in self.blocks:
            out[0] += self._back(block, block[3])
            out[1] += np.bincount(block[1], block[2] ** 2, self.n)
            out[2] += np.bincount(block[1], block[2], self.n)
        return out

    def misfits(self, x: np.ndarray) -> np.ndarray:
        """The squares of d - G x, summed, for each column."""
        return np.array([sum(float(((block[3] - self._rows(block, x[:, k])) ** 2).sum()) for block in self.blocks) for k in range(x.shape[1])])


    def preconditioner(self, diagonal: np.ndarray, scale: np.ndarray | None = None) -> Callable[[np.ndarray], np.ndarray] | None:
        """r -> (diagonal + S G'G S)^-1 r for vectors, S = diag(scale), by the matrix of the rows (Woodbury); None beyond MOST_ROWS rows or without a positive diagonal.

        What is left to conjugate gradients is the rest of the matrix, however strong the data are. A cell of infinite diagonal is held.
        """
        if sum(len(b[0]) for b in self.blocks) > MOST_ROWS or not (diagonal > 0).all():
            return None
        scale = np.ones(self.n) if scale is None else scale
        ids = np.unique(np.concatenate([b[1] for b in self.blocks])) if self.blocks else np.zeros(0, np.int64)
        rows = np.concatenate([np.full(stop - start, i) for i, (start, stop) in enumerate((a, z) for b in self._offsets() for a, z in b)]) if len(ids) else np.zeros(0, np.int64)
        n, cells, values = int(rows.max(initial=-1)) + 1, np.concatenate([b[1] for b in self.blocks] or [ids]), np.concatenate([b[2] for b in self.blocks] or [np.zeros(0)])
        values = values * scale[cells]
        small, at = np.eye(n), np.searchsorted(ids, cells)
        for low in range(0, len(ids), 4096):
            own = (at >= low) & (at < low + 4096)
            g = np.zeros((n, min(4096, len(ids) - low)))
            np.add.at(g, (rows[own], at[own] - low), values[own])
            small += (g / diagonal[ids[low : low + 4096]]) @ g.T
        inverse = np.linalg.inv(small)

        def apply(r: np.ndarray) -> np.ndarray:
            z = r / diagonal
            y = inverse @ np.bincount(rows, values * z[cells], n)
            return z - np.bincount(cells, values * y[rows], self.n) / diagonal

        return apply

    def _offsets(self) -> list[list[tuple[int, int]]]:
        return [list(zip(b[0], np.append(b[0][1:], len(b[1])), strict=True)) for b in self.blocks]


class Passes:
    """The same, each as one job over a table of blocks."""

    def __init__(self, n: int, frame: DataFrame):
        self.n, self.frame, self.passes = n, frame, 0

    def _sum(self, f: Callable[[Arrays, np.ndarray], np.ndarray], x: np.ndarray | None = None) -> np.ndarray:
        n, shared = self.n, self.frame.sparkSession.sparkContext.broadcast(x)

        def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = None
            for batch in batches:
                got = f(Arrays(n, list(zip(*[batch.column(i).to_pylist() for i in range(4)], strict=True))), shared.value)
                total = got if total is None else total + got
            if total is not None:
                yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["part"])

        rows = self.frame.select("starts", "cells", "numbers", "data").mapInArrow(part, "part binary").toLocalIterator()
        out = functools.reduce(lambda a, b: a + b, (np.frombuffer(r.part) for r in rows), 0.0)
        shared.unpersist()
        return out

    def times(self, x: np.ndarray) -> np.ndarray:
        self.passes += 1
        return np.broadcast_to(self._sum(Arrays.times, x), x.size).reshape(x.shape)

    def preconditioner(self, diagonal: np.ndarray, scale: np.ndarray | None = None) -> None:
        """None: the rows are no one's."""
        return None

    def start(self) -> np.ndarray:
        return np.broadcast_to(self._sum(lambda a, _: a.start()), 3 * self.n).reshape(3, self.n)

    def misfits(self, x: np.ndarray) -> np.ndarray:
        return np.broadcast_to(self._sum(Arrays.misfits, x), x.shape[1])


class Blocks:
    """kernel (obs_id, voxel_id, val) over sigma, and data (obs_id, d, sigma), packed for the cells with sorted ids."""

    def __init__(self, kernel: DataFrame, data: DataFrame, ids: np.ndarray):
        self.ids, self.spark = ids, kernel.sparkSession
        shared = self.spark.sparkContext.broadcast(ids)

        def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            def block(held: list[tuple]) -> pa.RecordBatch:
                obs, voxel, val, d = (np.concatenate(c) for c in zip(*held, strict=True))
                starts = np.flatnonzero(np.append(True, obs[1:] != obs[:-1]))
                cells = np.searchsorted(shared.value, voxel).astype(np.int32)
                return pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in (starts, cells, val, d[starts])] + [pa.array([len(val)])], ["starts", "cells", "numbers", "data", "n"])

            held, size = [], 0
            for batch in batches:
                part = tuple(batch.column(i).to_numpy(zero_copy_only=False) for i in range(4))
                if size >= BLOCK:  # the last observation may go on
                    old = tuple(np.concatenate(c) for c in zip(*held, strict=True))
                    cut = int(np.searchsorted(old[0], old[0][-1]))
                    if cut:
                        yield block([tuple(c[:cut] for c in old)])
                    held = [tuple(c[cut:] for c in old)]
                    size = len(held[0][0])
                held.append(part)
                size += len(part[0])
            if size:
                yield block(held)

        inside = self.spark.createDataFrame(pa.table({"voxel_id": pa.array(ids, pa.int64())})).hint("merge")
        rows = kernel.hint("merge").join(data.select("obs_id", "d", "sigma"), "obs_id").join(inside, "voxel_id", "left_semi")
        rows = rows.select(F.col("obs_id").cast("long"), F.col("voxel_id").cast("long"), (F.col("val") / F.col("sigma")).cast("double").alias("val"), (F.col("d") / F.col("sigma")).cast("double").alias("d"))
        dealt = rows.repartition("obs_id").sortWithinPartitions("obs_id", "voxel_id")
        self.frame = stored(dealt.mapInArrow(pack, "starts binary, cells binary, numbers binary, data binary, n long"), "kernel-blocks")
        self.numbers = self.frame.agg(F.sum("n")).first()[0] or 0

    def solve(self, solver: Callable, cases: list, context: dict, most_kernel: int = MOST_KERNEL) -> Iterator[tuple[list, dict[str, np.ndarray]]]:
        """(cases, arrays) by solver(operator, cases, context): cases in tasks of their own up to most_kernel numbers, else together in passes."""
        n = len(self.ids)
        if self.numbers > most_kernel:
            some, operator = max(1, MOST_CELLS // max(n, 1)), Passes(n, self.frame)
            for at in range(0, len(cases), some):
                yield cases[at : at + some], solver(operator, cases[at : at + some], context)
            return
        rows = [tuple(map(bytes, r)) for r in self.frame.select("starts", "cells", "numbers", "data").collect()]
        shared = self.spark.sparkContext.broadcast((rows, context))

        def solved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for i in batch.column(0).to_pylist():
                    blocks, held = shared.value
                    got = solver(Arrays(n, blocks), [cases[i]], held)
                    yield pa.RecordBatch.from_arrays([pa.array([i] * len(got)), pa.array(list(got)), pa.array([np.ascontiguousarray(v, float).tobytes() for v in got.values()], pa.binary())], ["case", "name", "value"])

        table = self.spark.range(len(cases)).repartition(len(cases), "id")
        found: dict[int, dict] = {}
        for r in table.mapInArrow(solved, "case long, name string, value binary").toLocalIterator():
            own = found.setdefault(r.case, {})
            own[r.name] = np.frombuffer(r.value)
        for i in sorted(found):
            yield [cases[i]], {k: v.reshape(len(v), 1) if k == "m" and len(v) == n else v for k, v in found[i].items()}


#: Cells that a solve takes in beyond those where it begins, at first, and groups of neighbouring ids that cells are chosen by.
LEAST, GROUPS = 1 << 16, 4096


class Overflow(Exception):
    """More crosses the border of a part than the tolerance allows."""


class Part:
    """The cells of a grid near those that data or bounds move; the others stay at 0 as long as what crosses the border is below the tolerance.

    Cells are chosen by groups of ids. The border's edges count in full for the cells inside, as if the cells beyond were
    held at 0; overflow() tells what they would feel, and grown() is a larger part. A part of all groups is the grid itself.
    """

    def __init__(self, cells: DataFrame, edges: DataFrame, seeds: DataFrame, joined: bool = True, least: int | None = None):
        """cells: voxel_id, w; edges: src, dst; seeds: voxel_id. Not joined: no cell feels another one, so the seeds' groups do."""
        low, high = cells.agg(F.min("voxel_id"), F.max("voxel_id")).first()
        self.low, self.width = low or 0, max(1, -(-((high or 0) - (low or 0) + 1) // GROUPS))
        self.cells, self.edges, self.extra = cells, edges, LEAST if least is None else least
        count = lambda df: {r[0]: r[1] for r in df.groupBy(self._group("voxel_id").alias("g")).agg(F.count("*")).collect()}  # noqa: E731  # GROUPS rows
        self.sizes, self.beside = count(cells), {}
        begun = count(seeds)
        self.begun = {g for g in begun if g in self.sizes}
        if joined and len(self.begun) < len(self.sizes):
            for a, b in edges.select(self._group("src").alias("a"), self._group("dst").alias("b")).where("a <> b").distinct().limit(GROUPS * 64).collect():
                self.beside.setdefault(a, set()).add(b)
                self.beside.setdefault(b, set()).add(a)
        self.joined = joined
        self._choose()

    def _group(self, column: str):
        return F.floor((F.col(column).cast("long") - self.low) / self.width).cast("int")

    def _choose(self) -> None:
        chosen, ring = set(self.begun), set(self.begun)
        wanted = sum(self.sizes[g] for g in chosen) + (self.extra if self.joined else 0)
        while ring and sum(self.sizes[g] for g in chosen) < wanted:
            ring = {b for g in ring for b in self.beside.get(g, ()) if b in self.sizes} - chosen
            chosen |= ring
        self.groups = chosen
        self.whole = len(chosen) == len(self.sizes)
        self.size = sum(self.sizes[g] for g in chosen)

    def grown(self) -> Part:
        self.extra *= 4
        before = self.size
        self._choose()
        if self.size == before:  # nothing borders on it
            self.groups, self.whole, self.size = set(self.sizes), True, sum(self.sizes.values())
        return self

    def _among(self, column: str):
        """Whether a cell is in the part; one expression, as a call for each of thousands of groups takes seconds."""
        groups = ", ".join(map(str, sorted(self.groups)))
        return F.expr(f"CAST(floor((CAST({column} AS BIGINT) - ({self.low})) / {self.width}) AS INT) IN ({groups})") if groups else F.lit(False)

    def inside(self, df: DataFrame, *columns: str) -> DataFrame:
        return df if self.whole else df.where(functools.reduce(lambda a, b: a & b, map(self._among, columns)))

    def outside(self, df: DataFrame) -> DataFrame:
        return df.where(F.lit(False) if self.whole else ~self._among("voxel_id"))

    def border(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(places in ids, ids beyond, w beyond) of the edges that leave the part."""
        if self.whole or not self.joined:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        own = self._among
        turned = F.when(own("src"), F.struct(F.col("src").alias("a"), F.col("dst").alias("voxel_id"))).otherwise(F.struct(F.col("dst").alias("a"), F.col("src").alias("voxel_id")))
        left = F.broadcast(self.edges.where(own("src") != own("dst")).select(F.inline(F.array(turned))))  # the border's edges
        got = left.join(self.cells.select("voxel_id", F.col("w").cast("double")), "voxel_id").select(F.col("a").cast("long"), F.col("voxel_id").cast("long"), "w").toArrow()
        a, b, w = (got.column(i).to_numpy() for i in range(3))
        known = np.isin(a, ids)
        return np.searchsorted(ids, a[known]), b[known], w[known]


def overflow(border: tuple[np.ndarray, np.ndarray, np.ndarray], m: np.ndarray, scaled: bool = False) -> np.ndarray:
    """The norm, for each column of m (cells, cases), of its sums over the border's edges by cell beyond (over its w if scaled)."""
    at, beyond, w = border
    if not len(at):
        return np.zeros(m.shape[1])
    ids, cell = np.unique(beyond, return_inverse=True)
    sums = np.stack([np.bincount(cell, m[at, k] / (w if scaled else 1.0), len(ids)) for k in range(m.shape[1])], 1)
    return np.linalg.norm(sums, axis=0)


def cell_ids(cells: DataFrame) -> np.ndarray:
    """The sorted ids of cells; callers have checked their number."""
    return np.sort(cells.select(F.col("voxel_id").cast("long")).distinct().toArrow().column(0).to_numpy())


def on_cells(ids: np.ndarray, table: DataFrame, columns: list[str], fill: list[float]) -> list[np.ndarray]:
    """Columns of table (voxel_id, ...) as vectors in the order of ids."""
    got = table.select(F.col("voxel_id").cast("long"), *[F.col(c).cast("double") for c in columns]).toArrow()
    at, out = np.searchsorted(ids, got.column(0).to_numpy()), []
    for c, x in zip(columns, fill, strict=True):
        v = np.full(len(ids), x)
        v[at] = got.column(c).fill_null(x).to_numpy()
        out.append(v)
    return out


def pairs_on(ids: np.ndarray, table: DataFrame, columns: list[str]) -> tuple[np.ndarray, ...]:
    """Two columns of ids as positions, and what other columns hold; pairs with a foreign id are left out."""
    got = table.select(*[F.col(c).cast("long" if i < 2 else "double") for i, c in enumerate(columns)]).toArrow()
    a, b = (got.column(c).to_numpy() for c in columns[:2])
    known = np.isin(a, ids) & np.isin(b, ids)
    return (*(np.searchsorted(ids, v[known]) for v in (a, b)), *(got.column(c).to_numpy()[known] for c in columns[2:]))


def as_table(spark, ids: np.ndarray, found: Iterator[tuple[list, np.ndarray]], rows: int = 1 << 20) -> DataFrame:
    """case_id, voxel_id, m of (cases, one column of cells each), written some rows at a time."""
    out, held, size = None, [], 0

    def written() -> DataFrame:
        got = pa.concat_tables(held)
        df = stored(spark.createDataFrame(got), "models")
        return df if out is None else out.unionByName(df)

    for cases, m in found:
        held += [pa.table({"case_id": pa.array(np.full(len(ids), c[0], np.int32)), "voxel_id": pa.array(ids), "m": pa.array(np.ascontiguousarray(m[:, k]))}) for k, c in enumerate(cases)]
        size += m.size
        if size >= rows:
            out = written()
            held, size = [], 0
    return written() if held or out is None else out


# --- what is added to G' G ---


def added(x: np.ndarray, weight: np.ndarray, smooth: np.ndarray, edges: tuple, penalty: tuple) -> np.ndarray:
    """weight * x, smooth times the edges' Laplacian of x, and the penalty's product, for each column."""
    out = weight * x
    a, b = edges
    mi, mj, mq = penalty
    for k in range(x.shape[1]):
        if smooth[k]:
            jump = x[a, k] - x[b, k]
            out[:, k] += smooth[k] * (np.bincount(a, jump, len(x)) - np.bincount(b, jump, len(x)))
        if len(mi):
            out[:, k] += np.bincount(mi, mq * x[mj, k], len(x))
    return out


def diagonal_of(squares: np.ndarray, weight: np.ndarray, smooth: np.ndarray, edges: tuple, penalty: tuple, empty: float = 1.0) -> np.ndarray:
    n = len(squares)
    degree = np.bincount(edges[0], minlength=n) + np.bincount(edges[1], minlength=n)
    mi, mj, mq = penalty
    out = squares[:, None] + weight + smooth[None, :] * degree[:, None] + np.bincount(mi[mi == mj], mq[mi == mj], n)[:, None]
    return np.where(out > 0, out, empty)


# --- solvers: `times` is the whole matrix of the normal equations ---


def conjugate_gradients(times: Callable, rhs: np.ndarray, diagonal: np.ndarray, iterations: int, tolerance: float, solve: Callable | None = None) -> np.ndarray:
    """x with times(x) = rhs for each column, scaled by the diagonal or by solve(r, column), to a relative residual of tolerance."""
    scaled = (lambda r: r / diagonal) if solve is None else (lambda r: np.stack([solve(r[:, k], k) for k in range(r.shape[1])], 1))
    x, r = np.zeros_like(rhs), rhs.copy()
    first = np.linalg.norm(r, axis=0)
    z = scaled(r)
    p, rz = z.copy(), (r * z).sum(0)
    for _ in range(iterations):
        if (np.linalg.norm(r, axis=0) <= tolerance * first).all():
            return x
        q = times(p)
        pq = (p * q).sum(0)
        alpha = np.divide(rz, pq, out=np.zeros_like(rz), where=pq > 0)
        x, r = x + alpha * p, r - alpha * q
        z = scaled(r)
        rz, old = (r * z).sum(0), rz
        p = z + np.divide(rz, old, out=np.zeros_like(rz), where=old > 0) * p
    raise ArithmeticError(f"no convergence in {iterations} iterations")


def within_bounds(times: Callable, rhs: np.ndarray, diagonal: np.ndarray, lower: np.ndarray, upper: np.ndarray, tolerance: float = 1e-9, passes: int = 5000, prepared: Callable | None = None) -> np.ndarray:
    """The x between lower and upper that is least for x' N x / 2 - rhs' x, N = times; vectors.

    Projected conjugate gradients with an active set: cells at a bound whose slope keeps them there, and cells whose
    bounds are equal, are held; the others move by conjugate gradients, and the step is cut back into the box until the
    objective falls. It ends when no cell that may move has a slope (scaled by the diagonal) above tolerance.
    prepared(free), if given, is r -> about N^-1 r on the cells that are free; the diagonal otherwise.
    """
    scale = diagonal**-0.5
    x = np.clip(np.zeros_like(rhs), lower, upper)
    slope, used = times(x) - rhs, 1
    least = tolerance * max(np.linalg.norm(rhs * scale), 1e-300)
    before, solve = None, lambda r: r / diagonal
    while used < passes:
        free = ((x > lower) | (slope < 0)) & ((x < upper) | (slope > 0)) & (lower < upper)
        if np.linalg.norm(np.where(free, slope, 0) * scale) <= least:
            return x
        if prepared is not None and (before is None or (before != free).any()):
            solve = prepared(free)
        d, r = np.zeros_like(x), np.where(free, -slope, 0)
        z = solve(r)
        p, rz = z.copy(), r @ z
        # the same cells free as before: this is the last face, solve it out
        goal = max(least**2 / 16, 0.0 if before is not None and (before == free).all() else 0.01 * rz)
        before = free
        while rz > goal and used < passes:
            q = np.where(free, times(p), 0)
            used += 1
            alpha = rz / (p @ q)
            d, r = d + alpha * p, r - alpha * q
            z = solve(r)
            rz, old = r @ z, rz
            p = z + rz / old * p
        step = 1.0
        while True:
            if step < 0.05:  # at a bound the step may point out of the box; the scaled slope never does
                d, step = np.where(free, -slope / diagonal, 0), 1.0
            moved = np.clip(x + step * d, lower, upper)
            fresh = times(moved) - rhs
            used += 1
            if (moved - x) @ (slope + fresh) <= 0 or used >= passes:  # twice the change of the objective
                break
            step /= 4
        x, slope = moved, fresh
    raise ArithmeticError(f"no convergence in {passes} products")


def shifted(times: Callable, rhs: np.ndarray, shifts: np.ndarray, iterations: int = 2000, tolerance: float = 1e-8, finish: Callable | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(x, condition): x[:, j] with (A + shifts[j]) x = rhs, all from the Krylov space of one right-hand side; A x = times(x).

    An iteration is one product with A, however many shifts. condition[j] is the root of the ratio of the extreme Ritz
    values of A + shifts[j]: that of the kernel stacked on the damping, as far as the data see it. Shifts that the space
    doesn't hold after `iterations` come from finish(shift), if given.
    """
    order = np.argsort(shifts)
    base, more = shifts[order[0]], shifts[order] - shifts[order[0]]
    k = len(more)
    x, p = np.zeros((len(rhs), k)), np.repeat(rhs[:, None], k, 1)
    r, main = rhs.copy(), rhs.copy()
    zeta, last = np.ones(k), np.ones(k)
    beta_before, alpha, rr = 1.0, 0.0, float(rhs @ rhs)
    first, alphas, betas, open_ = rr**0.5, [], [], np.ones(k, bool)
    for _ in range(iterations):
        if not open_.any() or not rr:
            break
        q = times(main[:, None])[:, 0] + base * main
        beta = -rr / float(main @ q)
        bottom = beta * alpha * (last - zeta) + last * beta_before * (1 - more * beta)
        ahead = np.where(open_, zeta * last * beta_before / np.where(open_, bottom, 1.0), 0.0)
        own = np.where(open_, beta * ahead / np.where(open_, zeta, 1.0), 0.0)
        x -= own * p
        r = r + beta * q
        rr, old = float(r @ r), rr
        alphas.append(-beta)
        alpha = rr / old
        betas.append(alpha)
        p = np.where(open_, ahead * r[:, None] + alpha * ahead * own / np.where(open_, zeta * beta, 1.0) * p, p)
        main = r + alpha * main
        last, zeta, beta_before = np.where(open_, zeta, last), np.where(open_, ahead, zeta), beta
        open_ &= np.abs(zeta) * rr**0.5 > tolerance * first
    if open_.any() and rr and finish is not None:
        for j in np.flatnonzero(open_):
            x[:, j] = finish(base + more[j])
    elif open_.any() and rr:
        raise ArithmeticError(f"no convergence in {iterations} iterations")
    inverse = 1 / np.array(alphas) if alphas else np.ones(1)
    ritz = np.linalg.eigvalsh(np.diag(inverse + np.append(0.0, np.array(betas[:-1]) * inverse[:-1]) if alphas else inverse) + sum((np.diag(np.sqrt(betas[:-1]) * inverse[:-1], s) for s in (1, -1)), np.zeros((len(inverse), len(inverse)))))
    out, condition = np.empty_like(x), np.empty(k)
    out[:, order] = x
    condition[order] = np.sqrt((ritz[-1] + more) / np.maximum(ritz[0] + more, 1e-300))
    return out, condition
