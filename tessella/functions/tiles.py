"""Column expressions of the two-dimensional tiling."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def side_of(n: int, width: int) -> int:
    return -(-n // width)


def tile_row(width: int, src: str = "src") -> Column:
    return F.expr(f"{src} div {width}")


def tile_id(n: int, width: int, src: str = "src", dst: str = "dst") -> Column:
    return F.expr(f"({src} div {width}) * {side_of(n, width)} + ({dst} div {width})")


def stripe_order(n: int, width: int, rows: int, row: str = "tile_row", col: str = "tile_col") -> Column:
    """Place of a tile when stripes of ``rows`` tile rows are walked column by column, the last stripe being shorter."""
    side = side_of(n, width)
    height = f"least({rows}, {side} - {rows} * ({row} div {rows}))"
    return F.expr(f"({row} div {rows}) * {rows * side} + {col} * {height} + ({row} - {rows} * ({row} div {rows}))")
