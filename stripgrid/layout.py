"""Where the numbers of a matrix sit in a table.

``Wide``   - one DOUBLE column per matrix column. Expressions on it are plain column arithmetic, so they stay
             in generated code and a column slice prunes the Parquet scan.
``Packed`` - one ARRAY<DOUBLE> column of a known length, for matrices too wide for separate columns.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType


def quoted(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


@dataclass(frozen=True)
class Wide:
    names: tuple[str, ...]

    @property
    def width(self) -> int:
        return len(self.names)

    def items(self) -> list[Column]:
        return [quoted(name) for name in self.names]

    def array(self) -> Column:
        return F.array(*self.items()) if self.names else F.array().cast("array<double>")

    def columns(self) -> list[Column]:
        return self.items()

    def fields(self) -> list[str]:
        return list(self.names)


@dataclass(frozen=True)
class Packed:
    name: str
    width: int

    def items(self) -> list[Column]:
        return [quoted(self.name)[j] for j in range(self.width)]

    def array(self) -> Column:
        return quoted(self.name)

    def columns(self) -> list[Column]:
        return [quoted(self.name)]

    def fields(self) -> list[str]:
        return [self.name]


Cells = Wide | Packed

# Above this many columns a list of per-column expressions costs more than it saves (long generated methods
# are not compiled by the JVM), so operators switch to array expressions, explode + groupBy, or Arrow batches.
NARROW = 64

# Widest n for which an n x n result may be held by one task or by the driver (4096 -> 128 MiB of doubles).
LOCAL_WIDTH = 4096

# Spark type of a packed row.
VECTOR = ArrayType(DoubleType())


def explode_cells(frame: DataFrame, keep: list, array: Column, position: str, value: str) -> DataFrame:
    """``keep``, ``position`` and ``value``: one row per array element.

    The outer form is used because the plain one makes the optimizer add a filter that computes the whole array
    expression once more (to skip empty arrays); here empty arrays are dropped by their missing position.
    """
    cells = frame.select(*keep, F.posexplode_outer(array).alias(position, value))
    return cells.filter(F.col(position).isNotNull())
