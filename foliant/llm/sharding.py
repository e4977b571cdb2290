"""Sharding by a hierarchical weighted hash tree: region, rack, shard. DataFrame functions only.

At each level the children of a node draw -ln(u) / weight, u from a hash of the document's id
and the child's name, and the smallest draw wins; an inner node weighs as much as its shards.
A draw depends on nothing else, so a changed weight moves rows only into or out of the
subtrees whose weights changed. A shard added by ``grown`` opens a region of its own, so that
rows move only into it (law ``key``: the id and the number of shards decide).

Places within a shard are counted in parts of about ``PART`` rows. Only ids, sizes and
checksums are shuffled for that; nothing is gathered for a shard.

Defined results: a null text has size 16 and the checksum of no bytes; a null id draws like
the text 'null'; repeated ids share a shard and get places of their own; an empty table
gives no rows; extra columns are kept by ``assign`` and ``write``.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PART = 20_000
#: Rows take this much besides their text.
OVERHEAD = 16


@dataclass(frozen=True)
class Node:
    """A shard (``shard`` is its number) or a node with children; names are unique in a tree."""

    name: str
    children: tuple[Node, ...] = ()
    shard: int = -1
    own_weight: float = 1.0

    @property
    def weight(self) -> float:
        return sum(c.weight for c in self.children) if self.children else self.own_weight

    @property
    def shards(self) -> int:
        return sum(c.shards for c in self.children) if self.children else 1


def even_tree(shards: int = 40, racks: int = 2, in_rack: int = 5) -> Node:
    """Shards 0 .. n - 1 of weight 1 in racks of ``in_rack``, ``racks`` of them in a region."""
    groups = [range(at, min(at + in_rack, shards)) for at in range(0, shards, in_rack)]
    all_racks = [
        Node(f"rack{k}", tuple(Node(f"shard{s}", shard=s) for s in group)) for k, group in enumerate(groups)
    ]
    regions = [tuple(all_racks[at : at + racks]) for at in range(0, len(all_racks), racks)]
    return Node("root", tuple(Node(f"region{k}", inside) for k, inside in enumerate(regions)))


def grown(tree: Node, weight: float = 1.0) -> Node:
    """``tree`` with one more shard, in a region and a rack of its own."""
    n = tree.shards
    rack = Node(f"rack-of-shard{n}", (Node(f"shard{n}", shard=n, own_weight=weight),))
    return Node(tree.name, (*tree.children, Node(f"region-of-shard{n}", (rack,))))


def _draw(key: Column, node: Node) -> Column:
    """An exponential draw of rate ``weight``: the smallest of several wins in proportion to the weights."""
    digits = F.substring(F.md5(F.concat(key, F.lit(f"/{node.name}"))), 1, 12)
    uniform = (F.conv(digits, 16, 10).cast("double") + 0.5) / F.lit(float(1 << 48))
    return -F.log(uniform) / F.lit(float(node.weight))


def shard_of(key: Column, tree: Node) -> Column:
    """The shard that the text ``key`` reaches; only the winner of a level is descended."""
    if not tree.children:
        return F.lit(tree.shard)
    live = [c for c in tree.children if c.weight > 0]
    if len(live) == 1:
        return shard_of(key, live[0])
    draws = F.array(*[F.struct(_draw(key, c).alias("draw"), F.lit(i).alias("child")) for i, c in enumerate(live)])
    if all(not c.children for c in live):
        return F.element_at(F.array(*[F.lit(c.shard) for c in live]), F.array_min(draws)["child"] + 1)

    def below(winner: Column) -> Column:
        out = shard_of(key, live[-1])
        for i, child in reversed(list(enumerate(live[:-1]))):
            out = F.when(winner == i, shard_of(key, child)).otherwise(out)
        return out

    # bound by a one-element transform, so that a level is drawn once
    return F.element_at(F.transform(F.array(F.array_min(draws)["child"]), below), 1)


def assign(docs: DataFrame, tree: Node, column: str = "shard") -> DataFrame:
    """``docs`` with the shard of each row; no shuffle."""
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))
    return docs.withColumn(column, shard_of(key, tree))


def placed(docs: DataFrame, tree: Node) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) for each row of ``docs``."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", (F.octet_length(text) + OVERHEAD).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))
    sharded = rows.select("*", shard_of(key, tree).alias("shard"), shard_of(key, grown(tree)).alias("grown_shard"))
    parts = max(1, math.ceil(docs.count() / (PART * tree.shards)))
    dealt = sharded.withColumn("part", F.pmod(F.xxhash64("doc_id", "size", "text_crc32"), F.lit(parts)).cast("int"))
    before = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = dealt.groupBy("shard", "part").count().select("shard", "part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("start"))
    within = Window.partitionBy("shard", "part").orderBy("doc_id", "size", "text_crc32")
    numbered = dealt.withColumn("number", F.row_number().over(within))
    return numbered.join(starts, ["shard", "part"]).select(
        "doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard",
        (F.col("start") + F.col("number") - 1).cast("long").alias("slot"), "grown_shard",
    )


def write(docs: DataFrame, tree: Node, path: str, column: str = "shard") -> None:
    """One folder for each shard under ``path``; the tasks that hold rows of a shard write it side by side."""
    assign(docs, tree, column).write.partitionBy(column).mode("overwrite").parquet(path)


def placed_sql(shards: int = 40, racks: int = 2, in_rack: int = 5) -> str:
    """The same in DuckDB SQL, for tables small enough for one part a shard."""
    tree = even_tree(shards, racks, in_rack)

    def draw(node: Node) -> str:
        return f"-ln((('0x' || substr(md5(k || '/{node.name}'), 1, 12))::BIGINT::DOUBLE + 0.5) / {float(1 << 48)!r}) / {float(node.weight)!r}"

    def descend(node: Node) -> str:
        if not node.children:
            return str(node.shard)
        if len(node.children) == 1:
            return descend(node.children[0])
        best = f"list_min([{', '.join(draw(c) for c in node.children)}])"
        return "CASE " + " ".join(f"WHEN {draw(c)} = {best} THEN {descend(c)}" for c in node.children) + " END"

    return f"""
    WITH RECURSIVE raw AS (
      SELECT doc_id, coalesce(text, '') AS t, coalesce(doc_id::VARCHAR, 'null') AS k FROM documents),
    crc_table AS (
      SELECT list(c ORDER BY b) AS tbl FROM (
        SELECT b, list_reduce(list_prepend(b, range(8)), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c
        FROM range(256) r(b))),
    hexed AS (SELECT doc_id, k, hex(encode(t)) AS h, octet_length(encode(t)) AS n FROM raw),
    bytes AS (
      SELECT doc_id, k, n, list_transform(range(n), lambda i: ('0x' || substr(h, 2 * i + 1, 2))::BIGINT) AS b FROM hexed),
    sized AS (
      SELECT doc_id, k, n + {OVERHEAD} AS size,
        xor(list_reduce(list_prepend(4294967295::BIGINT, b), lambda c, x: xor(c >> 8, tbl[(xor(c, x) & 255) + 1])), 4294967295) AS text_crc32
      FROM bytes, crc_table),
    sharded AS (SELECT *, {descend(tree)} AS shard, {descend(grown(tree))} AS grown_shard FROM sized)
    SELECT doc_id, size::BIGINT AS size, text_crc32::BIGINT AS text_crc32, 'key' AS law, shard::INTEGER AS shard,
      row_number() OVER (PARTITION BY shard ORDER BY doc_id, size, text_crc32) - 1 AS slot, grown_shard::INTEGER AS grown_shard
    FROM sharded"""
