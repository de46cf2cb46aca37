"""Sharding by a hierarchical weighted hash tree: regions hold racks, racks hold shards.

A row descends level by level. At each node every child draws ``-ln(u) / weight``, u being a hash in (0, 1) of the row's key and
the child's path, and the least draw wins; so a child takes its share of the node's weight, and its draw depends on nothing
but the key, its own path and its own weight. An inner node weighs what its shards weigh together. When weights
change, a node's choice changes only towards a child that gained or away from one that lost: rows move only into or out of
subtrees whose weights changed, and below any unchanged subtree nothing moves at all.

``uniform_tree`` fills shards in order, so a shard that opens a region takes rows only into itself. A shard that joins an older
region draws rows into that region, of which its neighbours there may take some.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shoebox.llm.common import materialize
from shoebox.llm.sql_parts import CRC_TABLE, crc32_of
from shoebox.operators.distributed import numbered

SHARDS = 40
RACKS_PER_REGION, SHARDS_PER_RACK = 4, 5
ROW_BYTES = 16  # what a row weighs besides its text
ROWS_PER_FILE = 1_000_000
_HEX_DIGITS = 13  # 52 bits, exact in a double

Leaves = dict[str, float]  # "region.rack.shard" to weight


def uniform_tree(shards: int) -> Leaves:
    """Shards 0 .. n - 1 of weight 1 in racks and regions filled in order."""
    per_region = RACKS_PER_REGION * SHARDS_PER_RACK
    return {f"{i // per_region}.{i // SHARDS_PER_RACK}.{i}": 1.0 for i in range(shards)}


def node_weights(leaves: Leaves) -> list[dict[str, dict[str, float]]]:
    """Per level, from the top: each node's children with their weights. Children without weight are left out."""
    levels: list[dict[str, dict[str, float]]] = [{}, {}, {}]
    for path, weight in sorted(leaves.items()):
        if weight < 0 or path.count(".") != 2:
            raise ValueError(f"shard {path!r} of weight {weight}")
        parts = path.split(".")
        for depth in range(3 if weight else 0):
            children = levels[depth].setdefault(".".join(parts[:depth]), {})
            child = ".".join(parts[: depth + 1])
            children[child] = children.get(child, 0.0) + weight
    if not levels[0]:
        raise ValueError("no shard has weight")
    return levels


def draw(key: Column, path: Column, weight: Column) -> Column:
    bits = F.conv(F.substring(F.md5(F.concat(key, F.lit("/"), path)), 1, _HEX_DIGITS), 16, 10).cast("double")
    return -F.log((bits + 0.5) / float(16**_HEX_DIGITS)) / weight


def place(key: Column, leaves: Leaves) -> Column:
    """The path of the shard that ``key`` (a string) falls to."""
    at = F.lit("")
    for nodes in node_weights(leaves):
        shelf = F.create_map(*[
            part
            for node, children in nodes.items()
            for part in (F.lit(node), F.array(*[F.struct(F.lit(c).alias("path"), F.lit(w).alias("weight")) for c, w in children.items()]))
        ])
        drawn = F.transform(F.element_at(shelf, at), lambda c: F.struct(draw(key, c["path"], c["weight"]).alias("draw"), c["path"].alias("path")))
        at = F.array_min(drawn)["path"]
    return at


def shard_number(path: Column) -> Column:
    return F.substring_index(path, ".", -1).cast("int")


def shard_documents(docs: DataFrame, leaves: Leaves | int = SHARDS, grown: Leaves | int | None = None) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) for every row of ``docs`` (doc_id, text).

    The law is ``key``: doc_id and the tree decide. ``grown`` is the tree that ``grown_shard`` is read from (default: for a
    number of shards, one more). ``size`` is the text's UTF-8 bytes plus 16; a null text has none and the checksum of an empty
    one. ``slot`` numbers a shard's rows from 0 without gaps, by doc_id, then checksum and size (nulls first); shards of any size are
    numbered in slices. A null doc_id is the key of the empty string. Repeated rows, and all texts of one doc_id, share a shard and
    have slots of their own; an empty table gives no rows; other columns are ignored.
    """
    if grown is None:
        if not isinstance(leaves, int):
            raise ValueError("name the grown tree")
        grown = leaves + 1
    trees = [uniform_tree(t) if isinstance(t, int) else t for t in (leaves, grown)]
    key, text = F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.coalesce("text", F.lit(""))
    rows = docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"),
        (F.octet_length(text).cast("bigint") + ROW_BYTES).alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        *[shard_number(place(key, tree)).alias(name) for name, tree in zip(("shard", "grown_shard"), trees, strict=True)],
    )
    rows = numbered(materialize(rows, "shards"), ["shard"], [F.col(c).asc_nulls_first() for c in ("doc_id", "text_crc32", "size")], "slot", "shard-slots")
    return rows.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("slot") - 1).alias("slot"), "grown_shard")


def write_shards(docs: DataFrame, path: str, leaves: Leaves | int = SHARDS, rows_per_file: int = ROWS_PER_FILE) -> None:
    """All of ``docs`` (doc_id, and any columns but ``region``, ``rack`` and ``shard``) as Parquet in ``path``/region=…/rack=…/shard=….

    Rows are dealt by shard and by a second hash within it, so that a shard is written by as many tasks as its rows need.
    """
    tree = uniform_tree(leaves) if isinstance(leaves, int) else leaves
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    placed = docs.withColumn("_path", place(key, tree))
    for i, name in enumerate(("region", "rack", "shard")):
        placed = placed.withColumn(name, F.split("_path", "[.]")[i].cast("int"))
    files = max(1, -(-docs.count() // (rows_per_file * len(tree))))
    placed = placed.withColumn("_file", F.pmod(F.xxhash64(*docs.columns), F.lit(files)))
    placed.repartition(files * len(tree), "shard", "_file").drop("_path", "_file").write.partitionBy("region", "rack", "shard").parquet(path)


def check_sql(shards: int = SHARDS) -> str:
    """The same for DuckDB: every node draws, the winners are followed down."""

    def placed(name: str, n: int) -> str:
        rows = ", ".join(f"('{node}', '{child}', {weight})" for level in node_weights(uniform_tree(n)) for node, children in level.items() for child, weight in children.items())
        u = f"((('0x' || substr(md5(key || '/' || child), 1, {_HEX_DIGITS}))::bigint)::double + 0.5) / {16**_HEX_DIGITS}"
        step = lambda source, node: f"select n, arg_min(child, -ln({u}) / weight) spot from {source} join {name}_tree on node = {node} group by n"
        return f"""
        {name}_tree(node, child, weight) as (values {rows}),
        {name}_region as ({step("keyed", "''")}),
        {name}_rack as ({step(f"keyed join {name}_region using (n)", "spot")}),
        {name} as ({step(f"keyed join {name}_rack using (n)", "spot")})"""

    return f"""
        with {CRC_TABLE},
        keyed as (select row_number() over () n, doc_id, coalesce(doc_id::varchar, '') as key, encode(coalesce(text, '')) body from documents),
        {placed("now", shards)}, {placed("later", shards + 1)},
        rows_ as (
            select doc_id, octet_length(body) + {ROW_BYTES} size, {crc32_of("body")} text_crc32,
                   split_part(now.spot, '.', 3)::int shard, split_part(later.spot, '.', 3)::int grown_shard
            from keyed join now using (n) join later using (n) cross join crc)
        select doc_id, size::bigint size, text_crc32, 'key' as law, shard,
               row_number() over (partition by shard order by doc_id nulls first, text_crc32, size) - 1 as slot, grown_shard
        from rows_"""
