"""Row and block matrices from tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from ..functions.lineage import cut_lineage
from ..functions.prefix import running_start
from ..layout import Packed, Wide, explode_cells, quoted
from ..row_matrix import RowMatrix


def from_columns(
    df: DataFrame,
    columns: list[str],
    row_id: str | None = None,
    nulls: str = "error",
    n_rows: int | None = None,
) -> RowMatrix:
    """Matrix whose columns are DOUBLE columns of a table.

    ``row_id`` names a dense integer key 0..n-1; leave it out for tables without one (whole-matrix operators only).
    ``nulls`` is ``error`` or ``zero``. ``n_rows`` states a size already known and saves counting it.
    """
    types = {field.name: field.dataType for field in df.schema.fields}
    wrong = [name for name in columns if not isinstance(types.get(name), DoubleType)]
    if wrong:
        raise ValueError(f"matrix columns must be DOUBLE; check {wrong}")
    cells = [_no_null(quoted(name), nulls, name).alias(name) for name in columns]
    key = [quoted(row_id).cast("bigint").alias("row_id")] if row_id else []
    return RowMatrix(df.select(*key, *cells), Wide(tuple(columns)), "row_id" if row_id else None, n_rows)


def _no_null(value: Column, nulls: str, name: str) -> Column:
    if nulls == "zero":
        return F.coalesce(value, F.lit(0.0))
    if nulls == "error":
        message = F.lit(f"NULL in matrix column {name}")
        return F.coalesce(value, F.raise_error(message).cast("double"))
    raise ValueError("nulls must be 'error' or 'zero'")


def from_arrays(
    df: DataFrame, column: str, row_id: str | None = None, n_cols: int | None = None, n_rows: int | None = None
) -> RowMatrix:
    """Matrix whose rows are arrays. Without ``n_cols`` the width is read from one row (no full pass).

    A row of another length, or holding NULL, raises while the plan runs.
    """
    if not isinstance(df.schema[column].dataType, ArrayType):
        raise ValueError(f"{column} is not an array column")
    if n_cols is None:
        first = df.select(F.size(quoted(column)).alias("n")).head()
        n_cols = 0 if first is None else first.n
    vec = quoted(column).cast("array<double>")
    problem = F.raise_error(F.lit(f"every row of {column} must hold {n_cols} numbers")).cast("array<double>")
    key = [quoted(row_id).cast("bigint").alias("row_id")] if row_id else []
    base = df.select(*key, F.when((F.size(vec) == n_cols) & ~_has_null(vec), vec).otherwise(problem).alias("vec"))
    return RowMatrix(base, Packed("vec", n_cols), "row_id" if row_id else None, n_rows)


def _has_null(vec: Column) -> Column:
    """NULL among the elements. array_contains is compiled and answers NULL exactly when it finds no match but a
    NULL, so the slower look at each element is left to the rare rows that hold an infinity."""
    found = F.array_contains(vec, F.lit(float("inf")))
    return found.isNull() | (found & F.exists(vec, lambda x: x.isNull()))


def from_strips(strips: DataFrame, n_cols: int | None = None) -> RowMatrix:
    """Matrix from ready-made strips ``(strip_id, n_rows, n_cols, vals)`` with row-major values, stacked by id.

    Start rows are running sums over the strip directory (ids and heights, written down once), joined back on ``strip_id``.
    """
    if n_cols is None:
        first = strips.filter("n_rows > 0").select("n_cols").head()
        n_cols = 0 if first is None else first.n_cols
    directory = running_start(cut_lineage(strips.select("strip_id", "n_rows")), "strip_id", "n_rows", "start_row")
    fits = F.col("n_cols") == n_cols
    rows = F.transform(
        F.sequence(F.lit(0), F.col("n_rows") - 1),
        lambda r: F.slice(F.col("vals"), r * F.col("n_cols") + 1, F.col("n_cols")),
    )
    none = F.array().cast("array<array<double>>")
    checked = F.when(F.col("n_rows") == 0, none).when(fits, rows).otherwise(
        F.raise_error(F.lit(f"every strip must have {n_cols} columns")).cast("array<array<double>>")
    )
    placed = strips.join(directory.select("strip_id", "start_row"), "strip_id")
    stacked = explode_cells(placed, ["start_row"], checked, "offset", "vec")
    base = stacked.select((F.col("start_row") + F.col("offset")).alias("row_id"), "vec")
    return RowMatrix(base, Packed("vec", n_cols))
