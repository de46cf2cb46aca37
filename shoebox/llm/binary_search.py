"""Exact top-k search over 64-bit codes by incremental multi-index hashing.

A code is cut into segments. A code at distance d from a query has a segment at distance d // segments or less from the query's. So once
all segments were searched up to radius r, and the first j also at r + 1, every code within segments * (r + 1) + j - 1 bits has
been verified. Each query's radii grow segment by segment until that proves its k-th best distance; easy queries end in
the first rounds, and a query never searches more segments of a round than its present k-th distance asks for.

A round joins the probes (segment values at exactly the round's radius) with the index on (segment, value). A pair is
verified only at the first segment and radius that meets it, so no pair is ever seen twice. Equal codes are one entry, with
the k + 1 smallest of their ids: no result needs more of them.
"""

from __future__ import annotations

import math
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shoebox.llm.common import materialize
from shoebox.operators.distributed import top_k

BITS = 64
BUCKET_BITS = 3  # a bucket of the index holds about 2 ** BUCKET_BITS codes or more
FAR = BITS + 1


def sign_codes(vectors: DataFrame) -> DataFrame:
    """(vec_id, code): bit i is set if component i is positive; of longer vectors, bit i is the parity over the components
    i, i + 64, ... Vectors that are null, empty, all zero, or hold a null or non-finite component have no code.
    """
    usable = "size(embedding) > 0 and forall(embedding, x -> x is not null and not isnan(x) and abs(x) < double('infinity')) and exists(embedding, x -> x <> 0)"
    code = "aggregate(transform(embedding, (x, i) -> if(x > 0, shiftleft(1L, i % 64), 0L)), 0L, (a, b) -> a ^ b)"
    return vectors.filter("vec_id is not null and embedding is not null").filter(usable).selectExpr("cast(vec_id as bigint) vec_id", f"{code} code")


def segment_masks(n: int) -> list[tuple[int, int]]:
    """(first bit, width) of each segment, for an index of about ``n`` codes."""
    width = max(4, min(16, int(math.log2(max(n, 2))) - BUCKET_BITS))
    parts = -(-BITS // width)
    edges = [BITS * i // parts for i in range(parts + 1)]
    return [(a, b - a) for a, b in zip(edges, edges[1:], strict=False)]


def _segment(code: str, at: int, width: int) -> Column:
    return F.expr(f"shiftrightunsigned({code}, {at}) & {(1 << width) - 1}L")


def _flips(width: int, radius: int) -> list[int]:
    return [sum(1 << b for b in bits) for bits in combinations(range(width), radius)]


def nearest_codes(codes: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """(query_id, rank, vec_id, distance): the ``k`` rows of ``codes`` (vec_id, code) nearest to each row of ``queries`` (alike),
    the query's own id excepted; ties go to the smaller id. With fewer rows than ``k``, all of them.

    An id that repeats counts once per different code. Empty tables give no rows; other columns are ignored.
    """
    codes, queries = (df.select("vec_id", "code").filter("vec_id is not null and code is not null").distinct() for df in (codes, queries))
    members = materialize(top_k(codes, ["code"], [F.col("vec_id")], k + 1).drop("rank"), "mih-members")
    index_codes = members.select("code").distinct()
    n, total = index_codes.count(), codes.count()
    segments = segment_masks(n)
    m = len(segments)
    index = materialize(
        index_codes.select("code", F.posexplode(F.array(*[_segment("code", a, w) for a, w in segments])).alias("segment", "value")), "mih-index"
    )
    wanted = materialize(queries.select(F.col("code").alias("asked")).distinct(), "mih-asked")
    best = None
    state = wanted.withColumn("kth", F.lit(FAR)).withColumn("found", F.lit(0))
    for radius in range(max(w for _, w in segments) + 1):
        # each query still open searches as many segments as its k-th distance needs for proof
        needed = F.least(F.lit(m), F.col("kth") - m * radius + 1)
        active = state.filter(needed > 0)
        probes = None
        for j, (at, width) in enumerate(segments):
            if radius > width:
                continue
            part = active.filter(needed > j).select(
                "asked", "kth", F.lit(j).alias("segment"), F.explode(F.lit(_flips(width, radius)).cast("array<bigint>")).alias("flip"), _segment("asked", at, width).alias("own")
            )
            part = part.select("asked", "kth", "segment", F.expr("own ^ flip").alias("value"))
            probes = part if probes is None else probes.unionByName(part)
        apart = [F.bit_count(F.expr(f"shiftrightunsigned(asked ^ code, {a}) & {(1 << w) - 1}L")) for a, w in segments]
        first = F.lit(True)
        for i, d in enumerate(apart):  # met before in segment i: at this radius if it comes first, else at a smaller one
            first &= (F.col("i_segment") == i) | F.when(F.col("i_segment") > i, d > radius).otherwise(d >= radius)
        # always a merge join: probes are many more rows than the plan's estimate of the unfolded arrays says
        entries = index.select(F.col("segment").alias("i_segment"), F.col("value").alias("i_value"), "code").hint("merge")
        distance = F.bit_count(F.expr("asked ^ code"))
        met = probes.join(entries, (F.col("segment") == F.col("i_segment")) & (F.col("value") == F.col("i_value")) & (distance <= F.col("kth")) & first)
        rows = met.select("asked", "code", distance.alias("distance")).join(members, "code").select("asked", "vec_id", "distance")
        best = materialize(top_k(rows if best is None else best.unionByName(rows), ["asked"], [F.col("distance"), F.col("vec_id")], k + 1).drop("rank"), "mih-best")
        seen = best.groupBy("asked").agg(F.count(F.lit(1)).alias("found"), F.max("distance").alias("worst"))
        state = wanted.join(seen, "asked", "left").select(
            "asked", F.when(F.col("found") > k, F.col("worst")).otherwise(FAR).alias("kth"), F.coalesce("found", F.lit(0)).alias("found")
        )
        state = materialize(state, "mih-state")
        if not state.filter((F.col("kth") >= m * (radius + 1)) & (F.col("found") < total)).limit(1).count():
            break
        state = state.filter((F.col("kth") >= m * (radius + 1)) & (F.col("found") < total))
    asked = queries.select(F.col("vec_id").alias("query_id"), F.col("code").alias("asked"))
    rows = asked.join(best, "asked").filter("vec_id <> query_id")
    return top_k(rows, ["query_id"], [F.col("distance"), F.col("vec_id")], k).select("query_id", "rank", "vec_id", F.col("distance").cast("int").alias("distance"))


CHECK_SQL = """
    with usable as (
        select vec_id, list_reduce(list_transform(embedding, lambda x, i: case when x > 0 then 1::ubigint << ((i - 1) % 64)::ubigint else 0::ubigint end), lambda a, b: xor(a, b)) code
        from embeddings
        where vec_id is not null and len(embedding) > 0 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
              and len(list_filter(embedding, lambda x: x <> 0)) > 0),
    pairs as (
        select q.vec_id query_id, c.vec_id, bit_count(xor(q.code, c.code)) distance
        from usable q join usable c on q.vec_id <> c.vec_id where q.vec_id % 20 = 0),
    ranked as (select *, row_number() over (partition by query_id order by distance, vec_id) as rank from pairs)
    select query_id, rank, vec_id, distance from ranked where rank <= 20"""
