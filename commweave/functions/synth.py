"""Synthetic edge updates from a small shift-register generator."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

_MASK = (1 << 64) - 1


class Generator:
    """xorshift64*: shifts 12, 25 and 27, then a multiplication, all modulo 2**64 (fixed values)."""

    def __init__(self, state: int):
        self.state = state & _MASK

    def below(self, n: int) -> int:
        x = self.state
        x ^= x >> 12
        x ^= x << 25 & _MASK
        x ^= x >> 27
        self.state = x
        return (x * 2685821657736338717 & _MASK) % n


#: Start of the generator's state, and what replaces a state of zero (fixed values).
GOLDEN, SPARE_FEW, SPARE_MANY = 0x9E3779B97F4A7C15, 0xDEADBEEF, 0x12345678


def synth_updates(spark: SparkSession, vertices: int, capacity: int, epoch: int = 0, share: int = 0) -> DataFrame:
    """(op, src, dst, weight): up to eight mixed updates for share 0, else share/10000 of the vertices as insertions of consecutive sources.

    No updates for fewer than two vertices or no capacity. The generator is sequential, so its few rows are made here.
    """
    rows: list[tuple[str, int, int, int]] = []
    if vertices >= 2 and capacity > 0 and share == 0:
        g = Generator((GOLDEN ^ epoch ^ vertices) or SPARE_FEW)
        for _ in range(min(8, capacity)):
            u, v = g.below(vertices), g.below(vertices)
            v = (v + 1) % vertices if u == v else v
            weight = 1 + g.below(8)
            rows.append(("INSERT" if g.below(2) else "DELETE", min(u, v), max(u, v), weight))
    elif vertices >= 2 and capacity > 0:
        g = Generator((GOLDEN ^ epoch ^ vertices << 7) or SPARE_MANY)
        start = g.below(vertices)
        for i in range(min(capacity, vertices, max(1, vertices * min(share, 10000) // 10000))):
            u = (start + i) % vertices
            v = (u + g.below(vertices - 1) + 1) % vertices
            rows.append(("INSERT", min(u, v), max(u, v), 1 + g.below(8)))
    return spark.createDataFrame(rows, "op string, src long, dst long, weight long")
