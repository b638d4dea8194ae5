"""QR of a tall matrix: R by a merge tree of small factors, thin Q by one of two routes.

* projected: Q1 = A R1^-1, then the same once more on Q1. The second pass restores orthogonality, so this is as
  good as a direct factorisation while R1 is far from singular. Rows never move; only n x n factors do.
* direct: every block keeps its own Q, the merge tree returns each block's slice of the merged Q, and the two are
  multiplied (Benson, Gleich and Demmel, 2013). Holds for any matrix, rank-deficient ones included, at the price
  of writing the block Qs once and joining them with their slices.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.arrow import lists_to_matrix, matrix_of, matrix_to_lists
from ..functions.dense import condition_one_norm, condition_two_norm, positive_qr
from ..functions.lineage import cut_lineage
from ..layout import Cells, Packed
from ..operators.folding import FAN_IN, RFactor, check_width, fold_rows

PROJECTED_LIMIT = 1e12
BLOCK_BYTES = 32 * 2**20


def r_rows(frame: DataFrame, parts: list[Cells], key: str | None = None) -> DataFrame:
    """R factor as ``(key, i, vec)``, each result in one partition."""
    width = sum(part.width for part in parts)
    check_width(width, "a QR factor")
    return fold_rows(frame, parts, RFactor(width), key)


def r_long(matrix) -> DataFrame:
    """Upper triangle of R as ``(i, j, value)``, diagonal >= 0."""
    rows = r_rows(matrix.base, [matrix.cells])
    return rows.select("i", F.posexplode("vec").alias("j", "value")).filter("j >= i")


def collect_square(rows: DataFrame, width: int) -> np.ndarray:
    """Bring a small ``(i, vec)`` result to the driver; its size depends on the number of columns only."""
    table = rows.select("i", "vec").toArrow()
    result = np.zeros((table.num_rows, width))
    if table.num_rows:
        result[table.column("i").to_numpy()] = lists_to_matrix(table.column("vec").combine_chunks(), width)
    return result


def local_r(matrix) -> np.ndarray:
    return collect_square(r_rows(matrix.base, [matrix.cells]), matrix.n_cols)


def condition_numbers(matrix) -> DataFrame:
    """One row ``(cond_1, cond_2)``: 1-norm and 2-norm condition numbers, both from R."""
    return conditions_of_r(r_rows(matrix.base, [matrix.cells]), matrix.n_cols).drop("key")


def conditions_of_r(rows: DataFrame, width: int) -> DataFrame:
    """``(key, cond_1, cond_2)`` from R factors in one partition."""

    def measure(batches):
        for k, r in squares_of(batches, width):
            values = {"key": [k], "cond_1": [condition_one_norm(r)], "cond_2": [condition_two_norm(r)]}
            yield pa.RecordBatch.from_pydict(
                values, schema=pa.schema([("key", pa.int32()), ("cond_1", pa.float64()), ("cond_2", pa.float64())])
            )

    return rows.coalesce(1).mapInArrow(measure, "key int, cond_1 double, cond_2 double")


def singular_values(matrix) -> DataFrame:
    """``(i, sigma)`` in decreasing order, from the SVD of R."""
    width = matrix.n_cols

    def measure(batches):
        for _, r in squares_of(batches, width):
            sigma = np.linalg.svd(r, compute_uv=False)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(len(sigma), dtype=np.int32)), pa.array(sigma)], ["i", "sigma"]
            )

    return r_rows(matrix.base, [matrix.cells]).coalesce(1).mapInArrow(measure, "i int, sigma double")


def two_norm(matrix) -> DataFrame:
    """One row ``(value)``: the largest singular value, 0 for a matrix without rows."""
    return singular_values(matrix).agg(F.coalesce(F.max("sigma"), F.lit(0.0)).alias("value"))


def squares_of(batches, width: int) -> list[tuple[int, np.ndarray]]:
    """Inside a task: the small matrices of a ``(key, i, vec)`` frame."""
    tables = [batch for batch in batches if batch.num_rows]
    if not tables:
        return []
    table = pa.Table.from_batches(tables)
    keys, index = table.column("key").to_numpy(), table.column("i").to_numpy()
    rows = lists_to_matrix(table.column("vec").combine_chunks(), width)
    return [(int(k), rows[keys == k][np.argsort(index[keys == k])]) for k in np.unique(keys)]


@dataclass
class ThinQR:
    """Q as a row matrix, R (n x n) on the driver, and the factors with Q = A F1^-1 F2^-1 on the projected route."""

    q: object
    r: np.ndarray
    factors: list[np.ndarray] | None = None


def thin_qr(matrix, route: str = "auto") -> ThinQR:
    """Thin Q as a row matrix with the same ``row_id``, and R on the driver (n x n)."""
    matrix.require_key()
    r_first = None
    if route == "auto":
        r_first = local_r(matrix)
        route = "projected" if condition_two_norm(r_first) < PROJECTED_LIMIT else "direct"
    if route == "projected":
        return _projected(matrix, local_r(matrix) if r_first is None else r_first)
    if route == "direct":
        return _direct(matrix)
    raise ValueError("route must be auto, projected or direct")


def _projected(matrix, r_first: np.ndarray) -> ThinQR:
    once = project(matrix, [r_first])
    r_second = local_r(once)
    factors = [r_first, r_second]
    return ThinQR(project(matrix, factors), np.triu(r_second @ r_first), factors)


def project(matrix, factors: list[np.ndarray], then: np.ndarray | None = None):
    """A R1^-1 R2^-1 ... row by row, times ``then``; the factors are n x n and travel with the task."""
    key, cells = matrix.require_key(), matrix.cells

    def apply(batches):
        for batch in batches:
            if batch.num_rows == 0:
                continue
            rows = divide_right(matrix_of(batch, [cells]), factors)
            rows = rows if then is None else rows @ then
            yield pa.RecordBatch.from_arrays([batch.column(key), matrix_to_lists(rows)], [key, "vec"])

    projected = matrix.base.select(key, *cells.columns()).mapInArrow(apply, f"{key} bigint, vec array<double>")
    return matrix.replace(projected, Packed("vec", cells.width if then is None else then.shape[1]))


def divide_right(rows: np.ndarray, factors: list[np.ndarray]) -> np.ndarray:
    for factor in factors:
        rows = np.linalg.solve(factor.T, rows.T).T
    return rows


# -- singular value decomposition --------------------------------------------------------------------------


@dataclass
class Svd:
    """A = U diag(sigma) V': U as a row matrix with the ``row_id`` of A, sigma in decreasing order, V as n x k."""

    u: object
    sigma: np.ndarray
    v: np.ndarray

    def v_long(self) -> DataFrame:
        """V as ``(i, j, value)``."""
        n, k = self.v.shape
        table = pa.table(
            {
                "i": pa.array(np.repeat(np.arange(n, dtype=np.int64), k)),
                "j": pa.array(np.tile(np.arange(k, dtype=np.int32), n)),
                "value": pa.array(self.v.ravel()),
            }
        )
        return self.u.base.sparkSession.createDataFrame(table)


def svd(matrix, rank: int | None = None, tolerance: float | None = None, route: str = "auto") -> Svd:
    """Singular value decomposition of a tall matrix: Q R first, then R = W diag(sigma) V' on the driver, and U = Q W.

    Kept are at most ``rank`` singular values, and only those above ``tolerance`` times the largest (default: n times the
    rounding unit), so a rank-deficient matrix gives as many as its numerical rank. U is one pass over the rows where Q
    is a projection; rank-deficient and nearly dependent columns take the direct route of ``thin_qr``. Signs: in each column of V the
    entry of largest absolute value is positive (the first one, if several are that large to nine digits).
    """
    if rank is not None and rank < 0:
        raise ValueError("rank must not be negative")
    factor = thin_qr(matrix, route)
    n = matrix.n_cols
    w, sigma, vt = np.linalg.svd(factor.r, full_matrices=False)
    limit = max(1, n) * np.finfo(float).eps if tolerance is None else tolerance
    kept = int(np.sum(sigma > limit * sigma[0])) if len(sigma) else 0
    kept = kept if rank is None else min(rank, kept)
    w, sigma, v = w[:, :kept], sigma[:kept], vt[:kept].T
    if kept:
        size = np.abs(v)
        leading = np.argmax(size >= (1 - 1e-9) * size.max(axis=0), axis=0)
        signs = np.where(v[leading, np.arange(kept)] < 0, -1.0, 1.0)
        w, v = w * signs, v * signs
    if factor.factors is not None:
        return Svd(project(matrix, factor.factors, w), sigma, v)
    if len(factor.r) == 0:
        return Svd(matrix.replace(matrix.base.select(matrix.require_key(), F.array().cast("array<double>").alias("vec")), Packed("vec", 0)), sigma, v)
    return Svd(factor.q.times_local(w), sigma, v)


# -- direct route ------------------------------------------------------------------------------------------

_BLOCKS = "node bigint, ids array<bigint>, q array<double>, r array<double>"
_LINKS = "node bigint, parent bigint, slice array<double>, r array<double>"


def _direct(matrix) -> ThinQR:
    width = matrix.n_cols
    check_width(width, "a QR factor")
    # Block boundaries depend on how rows arrive in a task, so they are fixed on storage before both uses.
    blocks = cut_lineage(_block_factors(matrix))
    nodes = blocks.count()
    if nodes == 0:
        return ThinQR(matrix.replace(matrix.base, matrix.cells), np.zeros((0, width)))
    links, level = [], blocks.select("node", "r")
    parents = max(1, -(-nodes // FAN_IN))
    group = F.pmod(F.xxhash64("node"), F.lit(parents))
    while True:
        link = cut_lineage(_merge_level(level, group, width))
        links.append(link)
        if parents == 1:
            break
        level = link.filter("r is not null").select(F.col("parent").alias("node"), "r")
        parents = -(-parents // FAN_IN)
        group = F.floor(F.col("node") / FAN_IN)
    top = links[-1].filter("r is not null").select("r").head()
    r = np.array(top.r).reshape(-1, width)
    q = _apply_slices(blocks, _slices(links, len(r)), len(r))
    return ThinQR(matrix.replace(q, Packed("vec", len(r)), key="row_id"), r)


def _block_factors(matrix) -> DataFrame:
    """Local QR of blocks of rows inside each task, sized in bytes so that a block always fits."""
    key, cells = matrix.require_key(), matrix.cells
    limit = max(4 * cells.width, BLOCK_BYTES // (8 * max(1, cells.width)))

    def factor(node, ids, rows):
        q, r = positive_qr(rows)
        return pa.RecordBatch.from_arrays(
            [
                pa.array([node], pa.int64()),
                pa.array([ids], pa.list_(pa.int64())),
                pa.array([q.ravel()], pa.list_(pa.float64())),
                pa.array([r.ravel()], pa.list_(pa.float64())),
            ],
            ["node", "ids", "q", "r"],
        )

    def blocks(batches):
        node = TaskContext.get().partitionId() << 32
        ids, rows, held = [], [], 0
        for batch in batches:
            for start in range(0, batch.num_rows, limit):
                piece = batch.slice(start, limit)
                if held and held + piece.num_rows > limit:
                    yield factor(node, np.concatenate(ids), np.vstack(rows))
                    node, ids, rows, held = node + 1, [], [], 0
                ids.append(piece.column(key).to_numpy())
                rows.append(matrix_of(piece, [cells]))
                held += piece.num_rows
        if held:
            yield factor(node, np.concatenate(ids), np.vstack(rows))

    return matrix.base.select(key, *cells.columns()).mapInArrow(blocks, _BLOCKS)


def _merge_level(level: DataFrame, group, width: int) -> DataFrame:
    """Stack the R factors of about FAN_IN children, factor, and give each child its slice of the merged Q."""

    def merge(key: tuple, table: pa.Table) -> pa.Table:
        table = table.sort_by("node").combine_chunks()
        factors = [r.values.to_numpy().reshape(-1, width) for r in table.column("r").combine_chunks()]
        q, r = positive_qr(np.vstack(factors))
        cuts = np.cumsum([len(f) for f in factors])[:-1]
        return pa.table(
            {
                "node": table.column("node"),
                "parent": pa.array([key[0].as_py()] * len(factors), pa.int64()),
                "slice": pa.array([part.ravel() for part in np.split(q, cuts)], pa.list_(pa.float64())),
                "r": pa.array([r.ravel()] + [None] * (len(factors) - 1), pa.list_(pa.float64())),
            }
        )

    grouped = level.select("node", "r", group.cast("bigint").alias("parent"))
    return grouped.groupBy("parent").applyInArrow(merge, _LINKS)


def _slices(links: list[DataFrame], rank: int) -> DataFrame:
    """``(node, slice)`` for the lowest level: products of slices along the path from the top, joined on node id."""
    current = links[-1].select("node", "slice")
    for link in reversed(links[:-1]):
        above = current.select(F.col("node").alias("parent"), F.col("slice").alias("above"))
        joined = link.select("node", "parent", "slice").join(above, "parent").select("node", "slice", "above")
        current = joined.mapInArrow(_multiplier("node", "slice", "above", rank), "node bigint, slice array<double>")
    return current


def _multiplier(key: str, left: str, right: str, rank: int):
    def apply(batches):
        for batch in batches:
            products = []
            for a, b in zip(batch.column(left), batch.column(right)):
                below = b.values.to_numpy().reshape(-1, rank)
                products.append((a.values.to_numpy().reshape(-1, len(below)) @ below).ravel())
            yield pa.RecordBatch.from_arrays(
                [batch.column(key), pa.array(products, pa.list_(pa.float64()))], [key, left]
            )

    return apply


def _apply_slices(blocks: DataFrame, slices: DataFrame, rank: int) -> DataFrame:
    joined = blocks.select("node", "ids", "q").join(slices, "node").select("ids", "q", "slice")

    def apply(batches):
        for batch in batches:
            for ids, q, part in zip(batch.column("ids"), batch.column("q"), batch.column("slice")):
                below = part.values.to_numpy().reshape(-1, rank)
                rows = q.values.to_numpy().reshape(-1, len(below)) @ below
                yield pa.RecordBatch.from_arrays([ids.values, matrix_to_lists(rows)], ["row_id", "vec"])

    return joined.mapInArrow(apply, "row_id bigint, vec array<double>")
