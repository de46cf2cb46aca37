"""Quality metrics of a run: what was rejected, overflowed or found in a cache."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener


def observed(df: DataFrame, name: str, **metrics: Column) -> DataFrame:
    """Counts on the side while ``df`` flows through, in batch and in streams, without another pass."""
    return df.observe(name, *[value.alias(key) for key, value in metrics.items()])


class MetricsListener(StreamingQueryListener):
    """Collects the observed metrics of every micro-batch, and the rows dropped for being late."""

    def __init__(self) -> None:
        self.rows: list[dict] = []

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        progress = event.progress
        late = sum(s.numRowsDroppedByWatermark for s in progress.stateOperators)
        for name, row in progress.observedMetrics.items():
            self.rows.append({"batch": progress.batchId, "name": name, **row.asDict()})
        if progress.stateOperators:
            self.rows.append({"batch": progress.batchId, "name": "late rows", "dropped": late})

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass


def long_form(*parts: DataFrame) -> DataFrame:
    """One-row metric tables as (metric, value)."""
    out = None
    for part in parts:
        rows = part.select([F.col(c).cast("bigint").alias(c) for c in part.columns]).unpivot([], part.columns, "metric", "value")
        out = rows if out is None else out.union(rows)
    return out
