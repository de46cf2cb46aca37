"""What was known at a moment: each row with the last event at or before it, or the next at or after it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shoebox.operators.distributed import Sequence


def as_of(rows: DataFrame, events: DataFrame, keys: list[str], at: str, event_at: str, columns: list[str], forward: bool = False, name: str = "as-of", bound: int = 1_000_000) -> DataFrame:
    """``rows`` with ``columns`` of the last of ``events`` at or before ``at`` (``forward``: the first at or after it), nulls if there is none.

    Rows and events of a key stand in one sequence and the last event is carried along it, so no pair is formed; a key of any size is
    cut into slices and the carried event crosses their edges. Of events at one moment the one with the greatest ``columns`` counts
    (``forward``: the least).
    """
    seen = F.struct(F.col(event_at).alias("at"), F.struct(*columns).alias("known"))
    kind = f"struct<at:{events.schema[event_at].dataType.simpleString()},known:{events.select(F.struct(*columns).alias('s')).schema['s'].dataType.simpleString()}>"
    own = rows.select(*keys, F.col(at).alias("_at"), F.lit(1).alias("_kind"), F.struct(*rows.columns).alias("_row"), F.lit(None).cast(kind).alias("_event"))
    given = events.select(*keys, F.col(event_at).alias("_at"), F.lit(0).alias("_kind"), F.lit(None).cast(own.schema["_row"].dataType).alias("_row"), seen.alias("_event"))
    order = [F.desc("_at") if forward else F.asc("_at"), F.col("_kind")]
    line = Sequence(own.unionByName(given), keys, order, name, bound)
    line = line.running_min("_event", "_seen") if forward else line.running_max("_event", "_seen")
    return line.result().filter("_kind = 1").select("_row.*", *[F.col(f"_seen.known.{c}").alias(c) for c in columns])
