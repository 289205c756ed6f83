"""Edge updates as a stream: each micro-batch gives the vertices and communities it touches."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from commweave.operators import incremental


def stream_affected(updates: DataFrame, membership: DataFrame, owners: DataFrame, community_owners: DataFrame, sink: Callable[[str, DataFrame, int], None], checkpoint: str):
    """Start a query that hands every batch's affected vertices and communities to sink(kind, rows, batch).

    updates: a streaming DataFrame (op, src, dst). The static sides are joined anew in every batch; the caller's sink
    must overwrite what it wrote for the same batch before, then every batch counts once.
    """

    def batch(rows: DataFrame, number: int) -> None:
        resolved = incremental.resolve(rows, membership, owners, community_owners).persist()
        sink("vertices", incremental.affected_vertices(resolved), number)
        sink("communities", incremental.affected_communities(resolved), number)
        resolved.unpersist()

    return updates.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
