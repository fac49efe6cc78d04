"""Sharding by a hierarchical weighted hash tree.

A node weighs what the shards below it weigh together. A document descends from the root: among
the regions, then among the racks of the chosen region, then among the shards of the chosen
rack, each child draws an exponential number whose rate is the child's weight, from a hash of
the document and the child's name, and the least draw is followed. Each child thus gets
documents in proportion to its weight, and a document draws once per sibling on its way, not
once per shard. A changed weight changes the draws of the nodes above that shard alone:
documents move only into or out of the subtrees whose weights change, and where weights are
only shifted within a rack (or a region), only within it.

A shard that is added to a standing tree draws at the root for its own weight, against the draw
of the region that the document came to. The least of the regions' draws has the rate of the
whole tree, so the added shard gets its share and takes documents only into itself, and nothing
moves between the others (law ``key``). It stands in a region of its own from then on: a tree is
told by its shards and how many of them it was founded with (``layout``).

Edge cases. A null text has no bytes (size 16, CRC 0). Null ids draw as ``null`` and go to one
shard together; slots are still dealt out in parallel. Repeated rows go to one shard and get
slots of their own. Shards of weight 0 get nothing. An empty table gives an empty result.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronosift.llm.text import hash_bits, let
from chronosift.operators.ordinal import with_position
from chronosift.session import pinned

HEX_DIGITS = 13
OVERHEAD = 16


class Shard(NamedTuple):
    region: int
    rack: int
    shard: int
    weight: float = 1.0


def layout(shards: int, founded: int | None = None, per_rack: int = 4, racks_per_region: int = 5) -> list[Shard]:
    """Shards 0 to ``shards - 1`` of weight 1. The founding ones (all by default) fill racks and
    regions in turn; each one added later is a region of its own."""
    founded = shards if founded is None else min(founded, shards)
    per_region = per_rack * racks_per_region
    tree = [Shard(i // per_region, i // per_rack, i) for i in range(founded)]
    regions, racks = -(-founded // per_region), -(-founded // per_rack)
    return tree + [Shard(regions + i, racks + i, founded + i) for i in range(shards - founded)]


def draw(key: Column, name: Column, weight: Column) -> Column:
    """An exponential number of rate ``weight``, by the document and the node."""
    bits = hash_bits(F.concat(key, F.lit(":"), name), HEX_DIGITS)
    uniform = (bits + 0.5) / float(16 ** HEX_DIGITS)
    return -F.log(uniform) / weight


def _nodes(weights: dict[int, float], prefix: str) -> Column:
    return F.array(*[F.struct(F.lit(f"{prefix}{n}").alias("name"), F.lit(n).alias("node"), F.lit(float(w)).alias("weight"))
                     for n, w in weights.items()])


def _least(key: Column, nodes: Column) -> Column:
    """Struct ``draw, node`` of the child that is followed."""
    return F.array_min(F.transform(nodes, lambda n: F.struct(
        draw(key, n["name"], n["weight"]).alias("draw"), n["node"].alias("node"))))


def _below(shards: list[Shard], parent: str, child: str) -> dict[int, dict[int, float]]:
    """Weights of the children of every node of a level."""
    found: dict[int, dict[int, float]] = {}
    for s in sorted(shards):
        children = found.setdefault(getattr(s, parent), {})
        children[getattr(s, child)] = children.get(getattr(s, child), 0.0) + s.weight
    return found


def _children(below: dict[int, dict[int, float]], prefix: str) -> Column:
    return F.create_map(*[c for node, weights in below.items() for c in (F.lit(node), _nodes(weights, prefix))])


def descend(key: Column, tree: list[Shard]) -> Column:
    """Struct ``draw, region, rack, shard`` of the leaf that a document comes to; ``draw`` is the
    region's, the least of a rate of the whole tree's weight."""
    shards = [s for s in tree if s.weight > 0]
    regions: dict[int, float] = {}
    for s in sorted(shards):
        regions[s.region] = regions.get(s.region, 0.0) + s.weight
    racks, leaves = _children(_below(shards, "region", "rack"), "rack"), _children(_below(shards, "rack", "shard"), "shard")
    return let(_least(key, _nodes(regions, "region")), lambda region: let(
        _least(key, racks[region["node"]])["node"], lambda rack: F.struct(
            region["draw"].alias("draw"), region["node"].alias("region"), rack.alias("rack"),
            _least(key, leaves[rack])["node"].alias("shard"))))


def added(key: Column, tree: list[Shard], more: list[Shard]) -> Column:
    """Struct ``draw, node`` of the least draw of the shards that were added to ``tree``. One that
    stands alone in a new region draws by that region's name, as it does in the grown tree."""
    members = [s.region for s in tree + more]
    names = [f"region{s.region}" if members.count(s.region) == 1 else f"added{s.shard}" for s in more]
    return F.array_min(F.transform(F.array(*[
        F.struct(F.lit(name).alias("name"), F.lit(s.shard).alias("node"), F.lit(float(s.weight)).alias("weight"))
        for name, s in zip(names, more) if s.weight > 0]), lambda n: F.struct(
            draw(key, n["name"], n["weight"]).alias("draw"), n["node"].alias("node"))))


def place(docs: DataFrame, shards: int = 40, tree: list[Shard] | None = None,
          more: list[Shard] | None = None, doc_id: str = "doc_id", text: str = "text",
          founded: int | None = None) -> DataFrame:
    """Every document with its shard, its slot there, and its shard after ``more`` shards came
    (one by default). ``tree`` and ``more`` stand in for the default layout, of which ``founded``
    shards are the founding ones."""
    tree = layout(shards, founded) if tree is None else tree
    if more is None:
        more = [Shard(max(s.region for s in tree) + 1, max(s.rack for s in tree) + 1, max(s.shard for s in tree) + 1)]
    key = F.coalesce(F.col(doc_id).cast("string"), F.lit("null"))
    body = F.col(text).cast("string")
    rows = docs.select(
        F.col(doc_id).alias("doc_id"),
        (F.coalesce(F.octet_length(body), F.lit(0)) + OVERHEAD).cast("bigint").alias("size"),
        F.coalesce(F.crc32(F.encode(body, "UTF-8")), F.lit(0)).cast("bigint").alias("text_crc32"),
        let(key, lambda k: F.struct(descend(k, tree).alias("now"), added(k, tree, more).alias("new")))
        .alias("_leaf"))
    placed = pinned(rows.select(
        "doc_id", "size", "text_crc32", F.lit("key").alias("law"),
        F.col("_leaf.now.shard").alias("shard"),
        F.when(F.col("_leaf.new.draw") < F.col("_leaf.now.draw"), F.col("_leaf.new.node"))
        .otherwise(F.col("_leaf.now.shard")).alias("grown_shard"),
        F.col("_leaf.now.rack").alias("rack"), F.col("_leaf.now.region").alias("region"),
        F.monotonically_increasing_id().alias("_row")))
    order = [F.col("shard"), F.col("doc_id").asc_nulls_first(), F.col("size"), F.col("text_crc32"), F.col("_row")]
    numbered = with_position(placed, order, "_at")
    # One row for each shard.
    first = F.broadcast(numbered.groupBy("shard").agg(F.min("_at").alias("_first")))
    return numbered.join(first, "shard").select(
        "doc_id", "size", "text_crc32", "law", "shard",
        (F.col("_at") - F.col("_first")).alias("slot"), "grown_shard", "rack", "region")
