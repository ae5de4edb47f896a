"""Sharding by a hierarchical weighted hash tree: region, rack, shard.

A key descends the tree; at each node the children draw -ln(u) / weight with u hashed from the key and
the child's name, and the least draw wins, so a child gets keys in proportion to its weight. A draw
depends on that child alone: changing one weight moves keys only into or out of that child's subtree.
Shards beyond the first tree hang under the root in regions of their own; so a further shard draws
against whole regions and takes keys only into itself.

Rows equal in id and text are counted before they are shuffled, numbered as one group, and dealt out
again, so neither a repeated id nor a group of repeated rows is one task's.

Defined cases: a null id is a key like any other ("null"); a null text has size 1 and the CRC of no
bytes; repeated rows go to the same shard and get slots of their own; an empty table gives an empty
result; other columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from skeinwork.llm.common import cut, read

#: Rows that one task numbers at once, about.
SLOT_ROWS = 20_000


@dataclass(frozen=True)
class Node:
    """A region, rack or (with a shard number) leaf. weight: of a leaf; an inner node's is its leaves' sum."""

    name: str
    children: tuple[Node, ...] = ()
    shard: int = -1
    own: float = 1.0

    @property
    def weight(self) -> float:
        return sum(c.weight for c in self.children) if self.children else self.own


def build_tree(shards: int, base: int = 16, racks_in_region: int = 2, shards_in_rack: int = 4) -> Node:
    """The tree for a number of shards: the first `base` in full regions, each further one in a region of its own."""

    def rack(numbers: range, name: str) -> Node:
        return Node(name, tuple(Node(f"s{i}", shard=i) for i in numbers))

    first = min(shards, base)
    racks = [rack(range(i, min(i + shards_in_rack, first)), f"k{i // shards_in_rack}") for i in range(0, first, shards_in_rack)]
    regions = [Node(f"r{i // racks_in_region}", tuple(racks[i : i + racks_in_region])) for i in range(0, len(racks), racks_in_region)]
    regions += [Node(f"r+{i}", (rack(range(i, i + 1), f"k+{i}"),)) for i in range(base, shards)]
    return Node("root", tuple(regions))


def _flat(tree: Node) -> tuple[list[Node], list[list[int]], int]:
    """The nodes by number (the root is 0), the numbers of each one's children, the depth."""
    nodes, below, depth, level = [tree], [[]], 0, [0]
    while level := [k for k in level if nodes[k].children]:
        nxt = []
        for k in level:
            for c in nodes[k].children:
                below[k].append(len(nodes))
                nxt.append(len(nodes))
                nodes.append(c)
                below.append([])
        level, depth = nxt, depth + 1
    return nodes, below, depth


def descend(key: Column, tree: Node) -> Column:
    """The shard that a key reaches. Each level draws among the children of one node: -ln(u) / weight, u from 48 bits of the MD5 of key and name."""
    nodes, below, depth = _flat(tree)

    def child(k: int) -> Column:
        return F.struct(F.lit(nodes[k].name).alias("name"), F.lit(float(nodes[k].weight)).alias("weight"), F.lit(k).alias("k"))

    table = F.array(*[F.array(*[child(c) for c in (below[k] or [k])]) for k in range(len(nodes))])

    def draw(c: Column) -> Column:
        bits = F.conv(F.substring(F.md5(F.concat(key, F.lit("/"), c["name"])), 1, 12), 16, 10).cast("double")
        return F.struct((-F.ln((bits + 0.5) / F.lit(float(1 << 48))) / c["weight"]).alias("d"), c["k"].alias("k"))

    at = F.lit(0)
    for _ in range(depth):
        at = F.array_min(F.transform(F.get(table, at), draw))["k"]
    return F.get(F.array(*[F.lit(n.shard) for n in nodes]), at)


def shard(docs: DataFrame, shards: int = 16, tree: Node | None = None, grown: Node | None = None, slot_rows: int = SLOT_ROWS) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot, grown_shard. Slots number a shard's rows part by part: parts are hash parts of id and text,
    numbered inside by a window and shifted by the counts of the parts before."""
    doc_id = docs["doc_id"].cast("long")
    key = F.coalesce(doc_id.cast("string"), F.lit("null"))
    text = F.coalesce(docs["text"], F.lit(""))
    crc = F.crc32(text.cast("binary"))
    rows = docs.select(
        doc_id.alias("doc_id"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        crc.alias("text_crc32"),
        descend(key, tree or build_tree(shards)).cast("int").alias("shard"),
        descend(key, grown or build_tree(shards + 1)).cast("int").alias("grown_shard"),
        F.conv(F.substring(F.md5(F.concat(key, F.lit("/"), crc.cast("string"))), 1, 8), 16, 10).cast("long").alias("draw"),
    )
    groups = cut(rows.groupBy(*rows.columns).agg(F.count("*").alias("m")), "shard-groups")
    total, most = groups.agg(F.coalesce(F.sum("m"), F.lit(0)), F.coalesce(F.max("m"), F.lit(0))).first()
    parts = max(1, -(-total // (shards * slot_rows)))
    groups = groups.withColumn("part", F.col("draw") % parts)
    counts = groups.groupBy("shard", "part").agg(F.sum("m").alias("n"))
    before = W.partitionBy("shard").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    starts = counts.select(F.col("shard").alias("shard_"), F.col("part").alias("part_"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    inside = F.sum("m").over(W.partitionBy("shard", "part").orderBy("doc_id", "size", "text_crc32").rowsBetween(W.unboundedPreceding, W.currentRow)) - F.col("m")
    numbered = groups.withColumn("at", inside).join(starts, (F.col("shard") == F.col("shard_")) & (F.col("part") == F.col("part_")))
    names = ["doc_id", "size", "text_crc32", "shard", "grown_shard"]
    runs = numbered.select(*names, (F.col("start") + F.col("at")).alias("first"), "m")
    # a group becomes runs of slot_rows rows, dealt out where there are large ones, and those become rows
    runs = runs.select(*names, "first", "m", F.explode(F.sequence(F.lit(0).cast("long"), F.col("m") - 1, F.lit(slot_rows).cast("long"))).alias("lo"))
    if most > slot_rows:
        runs = runs.repartition("doc_id", "text_crc32", "lo")
    slot = F.explode(F.sequence(F.col("lo"), F.least(F.col("lo") + slot_rows, F.col("m")) - 1))
    return runs.select(*names, "first", slot.alias("nth")).select("doc_id", "size", "text_crc32", "shard", (F.col("first") + F.col("nth")).cast("long").alias("slot"), "grown_shard")


def op6_sharding(spark, sf_dir: str) -> DataFrame:
    return shard(read(spark, sf_dir, "documents")).select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


def _descent(shards: int, name: str) -> tuple[str, str]:
    """(CTEs, the last one's name) that give for each document the shard among `shards`."""
    nodes, below, depth = _flat(build_tree(shards))
    rows = ", ".join(f"({k}, {c}, '{nodes[c].name}', {float(nodes[c].weight)}, {nodes[c].shard})" for k in range(len(nodes)) for c in below[k])
    parts = [f"{name}_t(up, k, name, weight, shard) AS (VALUES {rows})", f"{name}_0 AS (SELECT DISTINCT doc_id, 0 AS k, -1 AS shard FROM documents)"]
    bits = "('0x' || substr(md5(coalesce(CAST(p.doc_id AS VARCHAR), 'null') || '/' || t.name), 1, 12))::BIGINT"
    draw = f"-ln(({bits} + 0.5) / 281474976710656.0) / t.weight"
    for d in range(depth):
        choice = f"arg_min(t.k, {draw}) AS k, arg_min(t.shard, {draw}) AS shard"
        parts.append(f"{name}_{d + 1} AS (SELECT p.doc_id, {choice} FROM {name}_{d} p JOIN {name}_t t ON t.up = p.k GROUP BY p.doc_id)")
    return ", ".join(parts), f"{name}_{depth}"


def oracle_key_law(shards: int = 16, slot_rows: int = SLOT_ROWS) -> str:
    """op6_sharding as SQL: the descent level by level, the CRC byte by byte, slots by sorting whole shards."""
    a, last_a = _descent(shards, "a")
    b, last_b = _descent(shards + 1, "b")
    return f"""WITH {a}, {b},
      tab AS (SELECT list_transform(range(256), lambda n: list_reduce([n, 0, 0, 0, 0, 0, 0, 0, 0],
        lambda c, z: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END)) AS tab),
      bytes AS (SELECT doc_id, octet_length(encode(coalesce(text, ''))) + 1 AS size, list_prepend(4294967295, list_transform(
        string_split(regexp_replace(hex(encode(coalesce(text, ''))), '(..)', '\\1 ', 'g'), ' ')[:-2], lambda h: ('0x' || h)::BIGINT)) AS x FROM documents),
      crc AS (SELECT doc_id, size, xor(list_reduce(x, lambda c, y: xor(tab[(xor(c, y) & 255) + 1], c >> 8)), 4294967295) AS text_crc32 FROM bytes, tab),
      placed AS (SELECT c.*, a.shard, b.shard AS grown_shard,
        ('0x' || substr(md5(coalesce(CAST(c.doc_id AS VARCHAR), 'null') || '/' || c.text_crc32), 1, 8))::BIGINT
          % greatest(1, (SELECT CAST(ceil(count(*) / {float(shards * slot_rows)}) AS BIGINT) FROM documents)) AS part
        FROM crc c JOIN {last_a} a ON a.doc_id IS NOT DISTINCT FROM c.doc_id JOIN {last_b} b ON b.doc_id IS NOT DISTINCT FROM c.doc_id)
      SELECT doc_id, size, text_crc32, 'key' AS law, shard,
        row_number() OVER (PARTITION BY shard ORDER BY part, doc_id NULLS FIRST, size, text_crc32) - 1 AS slot, grown_shard FROM placed"""
