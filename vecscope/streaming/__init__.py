"""Streams.

Queries arrive one by one as easily as in batches: `score_stream` gives a stream of query vectors their exact
neighbours in a fixed base, micro-batch by micro-batch, with the operators of the batch path.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..operators import knn


def score_stream(queries: DataFrame, base: DataFrame, k: int, sink: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Hand gt(q_id, rank, id, dist) of each micro-batch of a (q_id, v) stream to `sink`."""

    def each(batch: DataFrame, number: int) -> None:
        sink(knn.exact_knn(base, batch, k), number)

    return queries.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
