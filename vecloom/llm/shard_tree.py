"""Sharding by a hierarchical weighted hash tree.

A document descends region, rack and shard. At each node every child draws -ln(u) / weight, with u from a hash of the document's
id and the child's name, and the least draw wins; a node's weight is the sum of its shards'. A change of weights inside one subtree
changes draws on the path to it only, so rows move into or out of that subtree and between no others. A tree grows by a new region of one
rack and one shard, and shards are never regrouped: only draws of the root change, and rows move into the new shard alone.

Law: key. Nulls: a null text has size 1 and the checksum of no bytes; null ids draw as the text "null". Equal ids go to
one shard; repeated rows get slots of their own, in an order that among equal rows is arbitrary. An empty table gives no rows.
Slots are numbered in blocks of about BLOCK_ROWS rows, and the blocks' counts are summed: no task holds a whole shard. Rows of one id
(or of none) fall into one block; there they are numbered by ranges of the checksum, and equal rows are counted first, so that a
frequent id is spread over tasks too.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK_ROWS = 8192
#: Bits of a digest that make a draw, and of a checksum that number the rows of a range.
BITS, PART_SHIFT = 52, 20


@dataclass(frozen=True)
class Node:
    """An inner node has children; a leaf has a shard number and a weight."""

    name: str
    children: tuple = ()
    shard: int = -1
    own: float = 0.0

    @property
    def weight(self) -> float:
        return sum(c.weight for c in self.children) if self.children else self.own


def tree(shards: int, base: int = 0, racks: int = 2, per_rack: int = 4, weights: dict[int, float] | None = None) -> Node:
    """The first base shards, a multiple of racks x per_rack, are in regions of so many from the start; each later one has a region of
    its own for ever. So with one base, a tree of n + 1 shards is the grown tree of n."""
    w = weights or {}
    size = racks * per_rack
    if base % size or not base <= shards or shards < 1:
        raise ValueError(f"{shards} shards on a base of {base}, which is to be a multiple of {size}")
    leaf = lambda s: Node(f"s{s}", (), s, w.get(s, 1.0))
    regions = []
    for g in range(base // size):
        own = [Node(f"g{g}k{k}", tuple(leaf(g * size + k * per_rack + i) for i in range(per_rack))) for k in range(racks)]
        regions.append(Node(f"g{g}", tuple(own)))
    return Node("root", (*regions, *(_alone(s, w.get(s, 1.0)) for s in range(base, shards))))


def _alone(s: int, weight: float) -> Node:
    return Node(f"x{s}", (Node(f"x{s}k", (Node(f"s{s}", (), s, weight),)),))


def grow(root: Node, weight: float = 1.0) -> Node:
    """One more shard, in a region of its own."""
    s = 1 + max(x.shard for g in root.children for k in g.children for x in k.children)
    return Node(root.name, (*root.children, _alone(s, weight)))


def _unit(key: Column, name: str) -> Column:
    head = F.conv(F.substring(F.md5(F.concat(F.lit(name + ":"), key)), 1, BITS // 4), 16, 10).cast("double")
    return (head + F.lit(0.5)) / F.lit(float(1 << BITS))


def _alone_in(node: Node) -> Node:
    """The node, or the shard under it if there is but one way down."""
    return _alone_in(node.children[0]) if len(node.children) == 1 else node


def _pick(key: Column, children: tuple) -> Column:
    """Name of the child that wins, or of the only shard under it."""
    if len(children) == 1:
        return F.lit(_alone_in(children[0]).name)
    return F.array_min(F.array(*[F.struct((-F.ln(_unit(key, c.name)) / F.lit(float(c.weight))).alias("d"), F.lit(_alone_in(c).name).alias("n")) for c in children]))["n"]


def place(df: DataFrame, root: Node, key: Column, out: str) -> DataFrame:
    """df with an int column out: the shard of each row. One column a level, so that a row draws on its own path only."""
    df = df.withColumn("_at", _pick(key, root.children))
    level = [n for c in root.children if (n := _alone_in(c)).children]
    while level:
        step = F.col("_at")
        for n in level:
            step = F.when(F.col("_at") == n.name, _pick(key, n.children)).otherwise(step)
        df = df.withColumn("_at", step)
        level = [m for n in level for c in n.children if (m := _alone_in(c)).children]
    return df.withColumn(out, F.substring("_at", 2, 20).cast("int")).drop("_at")


def sharded(docs: DataFrame, root: Node) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) of docs (doc_id, text)."""
    raw = F.coalesce("text", F.lit("")).cast("binary")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(raw) + 1).cast("long").alias("size"), F.crc32(raw).alias("text_crc32"))
    blocks = max(1, -(-docs.count() // BLOCK_ROWS))
    once = rows.groupBy("doc_id", "size", "text_crc32").agg(F.count(F.lit(1)).alias("m")).withColumn("key", F.coalesce(F.col("doc_id").cast("string"), F.lit("null")))
    once = place(place(once, root, F.col("key"), "shard"), grow(root), F.col("key"), "grown_shard")
    block = F.pmod(F.conv(F.substring(F.md5(F.concat(F.lit("block:"), F.col("key"))), 1, 12), 16, 10).cast("long"), F.lit(blocks))
    once = once.withColumn("block", block).withColumn("part", F.shiftright("text_crc32", PART_SHIFT))
    before = lambda *keys: Window.partitionBy(*keys).rowsBetween(Window.unboundedPreceding, -1)
    sums = once.groupBy("shard", "block", "key", "doc_id", "part").agg(F.sum("m").alias("n"))
    inner = F.coalesce(F.sum("n").over(before("shard", "block").orderBy("doc_id", "part")), F.lit(0))
    parts = sums.select("shard", "block", "key", "part", inner.alias("inner"))
    counts = sums.groupBy("shard", "block").agg(F.sum("n").alias("n"))
    start = counts.select("shard", "block", F.coalesce(F.sum("n").over(before("shard").orderBy("block")), F.lit(0)).alias("start"))
    own = F.coalesce(F.sum("m").over(before("shard", "block", "key", "part").orderBy("text_crc32", "size")), F.lit(0))
    placed = once.withColumn("own", own).join(parts, ["shard", "block", "key", "part"]).join(start, ["shard", "block"])
    every = placed.withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("m") - 1)))
    return every.select(
        "doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("start") + F.col("inner") + F.col("own") + F.col("copy")).alias("slot"), "grown_shard"
    )


def place_sql(root: Node) -> str:
    """DuckDB expression of a row's shard; key is the row's id as text."""

    def pick(children: tuple) -> str:
        draw = lambda c: f"{{'d': -ln((CAST(('0x' || substr(md5('{c.name}:' || key), 1, {BITS // 4})) AS BIGINT) + 0.5) / CAST({1 << BITS} AS DOUBLE)) / {float(c.weight)}, 'n': '{c.name}'}}"
        best = f"list_min([{', '.join(draw(c) for c in children)}]).n"
        cases = " ".join(f"WHEN '{c.name}' THEN {pick(c.children) if c.children else c.shard}" for c in children)
        return f"(CASE {best} {cases} END)"

    return pick(root.children)


#: CRC-32 of a hex string column h, by a table made from the reflected polynomial.
SQL_CRC = "xor(4294967295, list_reduce(list_transform(range(1, len(h) // 2 + 1), lambda i: CAST(('0x' || h[2 * i - 1:2 * i]) AS BIGINT)), lambda c, b: xor(c >> 8, tbl[1 + (xor(c, b) & 255)]), 4294967295))"
SQL_TABLE = "SELECT list_transform(range(256), lambda i: list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: xor(c >> 1, 3988292384 * (c & 1)))) AS tbl"


def sharded_sql(root: Node) -> str:
    return f"""WITH t AS ({SQL_TABLE}),
d AS (SELECT doc_id, octet_length(encode(coalesce(text, ''))) + 1 AS size, hex(encode(coalesce(text, ''))) AS h, coalesce(CAST(doc_id AS VARCHAR), 'null') AS key FROM documents),
p AS (SELECT doc_id, size, {SQL_CRC} AS text_crc32, CAST({place_sql(root)} AS INT) AS shard, CAST({place_sql(grow(root))} AS INT) AS grown_shard,
CAST(('0x' || substr(md5('block:' || key), 1, 12)) AS BIGINT) % (SELECT greatest(1, CAST(ceil(count(*) / {BLOCK_ROWS}) AS BIGINT)) FROM documents) AS block FROM d, t)
SELECT doc_id, size, text_crc32, 'key' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY block, doc_id, text_crc32, size) - 1 AS slot, grown_shard FROM p"""
