"""N-gram Jaccard join by a MinHash LSH forest.

Texts are sets of shingles of five words. Equal texts form a class, and only one text of a
class goes on. Each tree gives a text a path of minhashes; texts that share a prefix of it are
a node of the tree's trie. The prefix that has to match starts at the deepest level and is
shortened until the weakest pair that counts (similarity exactly at the threshold) meets with
the target probability; thresholds too low for 16 trees get more of them.

How deep a node goes beyond that follows from its texts. A crowded node (many tiles, for
instance texts that share a long passage and little else) is split by further levels: its
members get a second path in every tree, by minhashes not used so far, and only those that
share one of these too stay together. So that this loses nothing, half of the permitted misses
are kept for the second paths. Where the split would not lower the number of comparisons (near
copies stay together at any depth), the node is left whole. Nodes with the same members as
another one are left out. What remains is verified exactly, on the sets themselves.

A node is cut into tiles of bounded size, and a task compares two tiles by products of
incidence matrices. Tasks give back link counts and a spanning star per component, never
pairs, so a node of m texts costs m rows per tile and not m * m. A pair that meets in several
trees counts in the first one only. Links of different nodes are then joined to components.

Result per document: the class of equal texts (``text_id``, its smallest doc_id), the number
of other texts it is linked with (``links``), and the component (``class_id``, its smallest
doc_id).

Edge cases. Words are runs without white space (ASCII), in the case they have. A text of one
to four words is one shingle. Texts without words have no links; equal ones are a class. Null
texts stand alone, with their own id. Null ids come after all others. Repeated rows are equal
texts. Empty tables give empty results.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronosift.operators.ordinal import small_side
from chronosift.session import pinned

WORDS, THRESHOLD = 5, 0.8
TREES, LEVELS, RECALL = 16, 8, 0.999
TILE_TEXTS, TILE_SHINGLES = 512, 1 << 20
# Nodes of more tiles are split by further levels where that lowers the comparisons.
CROWDED_TILES = 4
# Trees of the second paths by which the number of comparisons after a split is estimated.
TRIAL_TREES = 2
# Classes that may be sent to all tasks when texts are fetched (16 bytes each, an id, a flag).
BROADCAST_CLASSES = 500_000

_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def forest_shape(threshold: float = THRESHOLD, recall: float = RECALL) -> tuple[int, int]:
    """Trees, and levels that have to agree: the most with which a pair at the threshold is
    missed by the first paths or by the second ones with a probability of at most
    ``1 - recall``. There are 16 trees, and more where even one level is too much for them."""
    if not 0 < threshold:
        raise ValueError(f"the threshold must be above 0, not {threshold}")
    threshold, missed = min(threshold, 1.0), (1 - recall) / 2
    for levels in range(LEVELS, 0, -1):
        if (1 - threshold ** levels) ** TREES <= missed:
            return TREES, levels
    return math.ceil(math.log(missed) / math.log(1 - threshold)), 1


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_set(text: str, size: int = WORDS) -> np.ndarray:
    """Sorted 64-bit hashes of the different shingles of a text."""
    from xxhash import xxh3_64_intdigest
    pieces = text.encode("utf-8", "surrogatepass").split()
    if not pieces:
        return np.zeros(0, dtype=np.uint64)
    hashes = np.fromiter(map(xxh3_64_intdigest, pieces), dtype=np.uint64, count=len(pieces))
    width = min(size, len(hashes))
    total = np.full(len(hashes) - width + 1, width, dtype=np.uint64)
    for i in range(width):
        total = total * _MULTIPLIER + hashes[i:len(hashes) - width + 1 + i]
    return np.unique(_mixed(total))


class Forest:
    """Minhash prefixes of ``levels`` levels in each of ``trees`` trees. Forests of different
    ``seed`` use different minhashes."""

    def __init__(self, trees: int, levels: int, seed: int = 20):
        self.trees, self.levels = trees, levels
        rng = np.random.default_rng(seed)
        width = trees * levels
        self.flip = rng.integers(0, 1 << 63, width, dtype=np.uint64)
        self.scale = rng.integers(0, 1 << 63, width, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

    def keys(self, shingles: np.ndarray) -> np.ndarray:
        """A key per tree that stands for the prefix of the path there."""
        least = np.full(self.trees * self.levels, np.iinfo(np.uint64).max, dtype=np.uint64)
        for at in range(0, len(shingles), 1024):
            part = (shingles[at:at + 1024, None] ^ self.flip) * self.scale
            np.minimum(least, part.min(axis=0), out=least)
        path = least.reshape(self.trees, self.levels)
        key = np.zeros(self.trees, dtype=np.uint64)
        for level in range(self.levels):
            key = _mixed(key * _MULTIPLIER + path[:, level])
        return key.view(np.int64)


def _lists(keys: list[np.ndarray], offsets: list[int]) -> pa.ListArray:
    values = np.concatenate(keys) if keys else np.zeros(0, dtype=np.int64)
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values))


def _sketched(trees: int, levels: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest = Forest(trees, levels)
        for batch in batches:
            counts, keys, offsets = [], [], [0]
            for text in batch.column(2):
                shingles = shingle_set(text.as_py() or "")
                counts.append(len(shingles))
                if len(shingles):
                    keys.append(forest.keys(shingles))
                offsets.append(offsets[-1] + (trees if len(shingles) else 0))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(counts, pa.int64()), _lists(keys, offsets)],
                names=["doc_id", "cls", "n", "keys"])
    return run


def _deeper(trees: int, levels: int):
    """Second paths of the sets in crowded nodes."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest = Forest(trees, levels, seed=21)
        for batch in batches:
            keys = [forest.keys(np.frombuffer(s.as_py(), dtype=np.uint64)) for s in batch.column(1)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), _lists(keys, [i * trees for i in range(len(keys) + 1)])], names=["cls", "deep"])
    return run


def _with_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sets = [shingle_set(t.as_py() or "").tobytes() for t in batch.column(1)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.binary())], names=["cls", "shingles"])


def linked_pairs(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray,
                 threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Positions in ``left`` and ``right`` (indexes into ``sets``) of pairs at the threshold."""
    sizes = np.array([len(s) for s in sets])
    if len(left) == 1 and len(right) == 1:
        common = np.array([[len(np.intersect1d(sets[left[0]], sets[right[0]], assume_unique=True))]], dtype=float)
    else:
        owner = np.repeat(np.arange(len(sets)), sizes)
        _, place, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        shared = times[place] > 1
        owner, place = owner[shared], np.unique(place[shared], return_inverse=True)[1]
        order = np.argsort(place, kind="stable")
        owner, place = owner[order], place[order]
        width = int(place[-1]) + 1 if len(place) else 0
        common = np.zeros((len(left), len(right)))
        for at in range(0, width, 8192):
            a, b = np.searchsorted(place, [at, at + 8192])
            block = np.zeros((len(sets), min(8192, width - at)), dtype=np.float32)
            block[owner[a:b], place[a:b] - at] = 1
            common += block[left] @ block[right].T
    union = sizes[left][:, None] + sizes[right][None, :] - common
    return np.nonzero(common >= threshold * union)


def _verify(rows: list[tuple], tree: int, branch: int, low: int, high: int, threshold: float):
    """Link counts and star edges of one pair of tiles; rows are ``cls, tile, keys, deep,
    shingles``. A pair counts in the first tree where it meets, and in a split node of it
    (``branch`` from 0) in the first tree of the second paths."""
    first = np.array([i for i, r in enumerate(rows) if r[1] == low])
    second = first if low == high else np.array([i for i, r in enumerate(rows) if r[1] == high])
    if not len(first) or not len(second):
        return []
    if low == high and len(rows) == 2:
        first, second = first[:1], second[1:]
    sets = [np.frombuffer(r[4], dtype=np.uint64) for r in rows]
    a, b = linked_pairs(sets, first, second, threshold)
    a, b = first[a], second[b]
    if low == high:
        a, b = a[a < b], b[a < b]
    seen = tree + max(branch, 0)
    if seen and len(a):
        keys = np.array([[*r[2][:tree], *(r[3][:branch] if branch > 0 else ())] for r in rows])
        fresh = np.concatenate([~(keys[a[i:i + 65536]] == keys[b[i:i + 65536]]).any(axis=1)
                                for i in range(0, len(a), 65536)])
        a, b = a[fresh], b[fresh]
    if not len(a):
        return []
    links = np.bincount(a, minlength=len(rows)) + np.bincount(b, minlength=len(rows))
    label = np.arange(len(rows))
    while True:
        least = label.copy()
        np.minimum.at(least, a, label[b])
        np.minimum.at(least, b, label[a])
        least = least[least]
        if np.array_equal(least, label):
            break
        label = least
    return [(rows[i][0], rows[label[i]][0], int(links[i])) for i in np.nonzero(links)[0]]


def _verified(threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def packed(found: list[tuple]) -> pa.RecordBatch:
            columns = list(zip(*found)) if found else [[], [], []]
            return pa.RecordBatch.from_arrays(
                [pa.array(columns[0], pa.binary()), pa.array(columns[1], pa.binary()),
                 pa.array(columns[2], pa.int64())], names=["cls", "root", "links"])

        group, rows, out = None, [], []
        for batch in batches:
            heads = list(zip(*[batch.column(i).to_pylist() for i in range(6)]))
            body = list(zip(*[batch.column(i).to_pylist() for i in range(6, 11)]))
            for head, row in zip(heads, body):
                if head != group:
                    if len(rows) > 1:
                        out += _verify(rows, group[0], group[2], group[4], group[5], threshold)
                    group, rows = head, []
                rows.append(row)
            if len(out) > 10_000:
                yield packed(out)
                out = []
        if len(rows) > 1:
            out += _verify(rows, group[0], group[2], group[4], group[5], threshold)
        yield packed(out)
    return run


def class_key(text: Column) -> Column:
    """16 bytes that stand for a text; null for null."""
    return F.unhex(F.md5(text.cast("string")))


def components(edges: DataFrame) -> DataFrame:
    """``cls, label`` of every end of ``edges`` (``cls, root``); equal labels, equal component.

    Every node takes the least label of its neighbours, then the label of its label, until
    nothing changes: rounds grow with the logarithm of a chain's length.
    """
    both = pinned(edges.select(F.col("cls").alias("a"), F.col("root").alias("b"))
                  .union(edges.select("root", "cls")).filter("a <> b").distinct())
    labels = pinned(both.groupBy("a").agg(F.min("b").alias("b")).select("a", F.least("a", "b").alias("label")))
    while True:
        near = both.join(labels.withColumnRenamed("a", "b"), "b").groupBy("a").agg(F.min("label").alias("near"))
        least = labels.join(near, "a").select("a", "label", F.least("label", "near").alias("least"))
        up = labels.select(F.col("a").alias("least"), F.col("label").alias("up"))
        moved = pinned(least.join(up, "least").select("a", F.col("label").alias("old"), F.least("least", "up").alias("label")))
        labels = moved.select("a", "label")
        if moved.filter("old <> label").limit(1).count() == 0:
            return labels.select(F.col("a").alias("cls"), "label")


NODE = ["tree", "key", "branch", "deep_key"]


def _shared_nodes(placed: DataFrame) -> DataFrame:
    """Size, tiles and a mark of the members of every node of more than one text."""
    mark = F.xxhash64("cls")
    nodes = placed.groupBy(*NODE).agg(
        F.count(F.lit(1)).alias("size"), F.sum("n").alias("weight"), F.bit_xor(mark).alias("x"),
        F.min(mark).alias("low"), F.max(mark).alias("high")).filter("size > 1")
    tiles = F.greatest(F.ceil(F.col("size") / TILE_TEXTS), F.ceil(F.col("weight") / TILE_SHINGLES))
    return nodes.withColumn("tiles", tiles.cast("int"))


def _one_of_each(nodes: DataFrame) -> DataFrame:
    """One node for each set of members: the one of the earliest tree and branch."""
    first = F.min_by(F.struct(*NODE), F.struct("tree", "branch"))
    return nodes.groupBy("size", "weight", "x", "low", "high").agg(
        first.alias("node"), F.first("tiles").alias("tiles")).select("node.*", "tiles", "size", "weight", "x", "low", "high")


def _split(members: DataFrame, crowded: DataFrame, sets: DataFrame, shape: tuple[int, int]):
    """Crowded nodes split by further levels, those where it lowers the comparisons:
    the split nodes (``tree, key``), the nodes that take their place, the members of these,
    and the second paths."""
    inside = pinned(members.join(crowded.select("tree", "key"), ["tree", "key"], "left_semi"))
    within = sets.join(inside.select("cls").distinct(), "cls", "left_semi")
    deep = pinned(within.select("cls", "shingles").mapInArrow(_deeper(*shape), "cls binary, deep array<long>"))
    placed = inside.drop("branch", "deep_key").join(deep, "cls")

    def branches(rows: DataFrame, keys) -> DataFrame:
        return rows.select("cls", "n", "tree", "key", F.posexplode(keys).alias("branch", "deep_key"))

    # The trees of the second paths are alike, so a few tell what all of them will cost.
    trial = _shared_nodes(branches(placed, F.slice("deep", 1, TRIAL_TREES)))
    after = trial.groupBy("tree", "key").agg(
        (F.sum(F.col("size").cast("double") * F.col("size")) * (shape[0] / TRIAL_TREES)).alias("after"))
    split = pinned(crowded.join(after, ["tree", "key"], "left").filter(
        F.coalesce("after", F.lit(0.0)) < F.col("size").cast("double") * F.col("size")).select("tree", "key"))
    fresh = branches(placed.join(split, ["tree", "key"], "left_semi"), F.col("deep"))
    return split, _shared_nodes(fresh), fresh, deep


def classes(docs: DataFrame, threshold: float = THRESHOLD, doc_id: str = "doc_id",
            text: str = "text") -> tuple[DataFrame, DataFrame]:
    """All documents as ``doc_id, cls``, and ``cls, text_id, class_id, links`` of every class."""
    shape = forest_shape(threshold)
    body = F.col(text).cast("string")
    rows = docs.select(F.col(doc_id).alias("doc_id"), class_key(body).alias("cls"), body.alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    sketches = pinned(rows.mapInArrow(_sketched(*shape), f"doc_id {kind}, cls binary, n long, keys array<long>"))
    texts = pinned(sketches.filter("cls is not null").groupBy("cls").agg(
        F.min("doc_id").alias("text_id"), F.first("n").alias("n"), F.first("keys").alias("keys")))
    placed = texts.select("cls", "n", F.posexplode("keys").alias("tree", "key")).select(
        "*", F.lit(-1).alias("branch"), F.lit(0).cast("bigint").alias("deep_key"))
    kept = pinned(_one_of_each(_shared_nodes(placed)))
    members = pinned(placed.join(kept.select("tree", "key"), ["tree", "key"], "left_semi"))
    wanted = pinned(members.select("cls").distinct().join(texts.select("cls", "text_id"), "cls"))
    fetch = rows.join(small_side(wanted, BROADCAST_CLASSES),
                      (rows["cls"] == wanted["cls"]) & rows["doc_id"].eqNullSafe(wanted["text_id"])).select(
        rows["cls"], rows["text"])
    sets = fetch.mapInArrow(_with_sets, "cls binary, shingles binary").groupBy("cls").agg(
        F.first("shingles").alias("shingles"))
    sets = pinned(sets.join(texts.select("cls", "keys"), "cls"))
    crowded = kept.filter(F.col("tiles") > CROWDED_TILES)
    if crowded.limit(1).count():
        split, parts, inside, deep = _split(members, crowded, sets, shape)
        whole = kept.join(split, ["tree", "key"], "left_anti")
        kept = pinned(_one_of_each(whole.select(*parts.columns).union(parts)))
        members = members.join(split, ["tree", "key"], "left_anti").select(*inside.columns).union(inside)
        sets = sets.join(deep, "cls", "left")
    else:
        sets = sets.withColumn("deep", F.lit(None).cast("array<bigint>"))
    within = members.select("cls", *NODE).join(kept.select(*NODE, "tiles"), NODE)
    tile = F.pmod(F.xxhash64("cls", F.lit(7)), F.col("tiles")).cast("int")
    dealt = within.withColumn("tile", tile).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    cells = dealt.select(*NODE, F.least("tile", "other").alias("low"), F.greatest("tile", "other").alias("high"), "cls", "tile")
    place = [*NODE, "low", "high"]
    full = cells.join(sets, "cls").select(*place, "cls", "tile", "keys", "deep", "shingles")
    full = full.repartition(*place).sortWithinPartitions(*place)
    found = pinned(full.mapInArrow(_verified(threshold), "cls binary, root binary, links long"))
    links = found.groupBy("cls").agg(F.sum("links").alias("links"))
    labels = components(found.select("cls", "root"))
    linked = labels.join(texts.select("cls", "text_id"), "cls")
    heads = linked.groupBy("label").agg(F.min("text_id").alias("class_id"))
    linked = linked.join(heads, "label").select("cls", "class_id").join(links, "cls")
    result = texts.select("cls", "text_id").join(linked, "cls", "left").select(
        "cls", "text_id", F.coalesce("class_id", "text_id").alias("class_id"),
        F.coalesce("links", F.lit(0)).cast("bigint").alias("links"))
    return sketches.select("doc_id", "cls"), pinned(result)


def join(docs: DataFrame, threshold: float = THRESHOLD, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, class_id, text_id, links`` of every document."""
    rows, known = classes(docs, threshold, doc_id, text)
    alone = F.col("cls").isNull()
    return rows.join(known, "cls", "left").select(
        "doc_id", F.when(alone, F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"),
        F.when(alone, F.col("doc_id")).otherwise(F.col("text_id")).alias("text_id"),
        F.coalesce("links", F.lit(0)).cast("bigint").alias("links"))


def first_of_each(docs: DataFrame, threshold: float = THRESHOLD, doc_id: str = "doc_id",
                  text: str = "text") -> DataFrame:
    """``docs`` with one document of each component: the one of the smallest id. Of repeated
    rows one stays; null texts all stay."""
    names = docs.columns
    _, known = classes(docs, threshold, doc_id, text)
    heads = known.filter(F.col("text_id").eqNullSafe(F.col("class_id"))).select(
        F.col("cls").alias("_cls"), F.col("text_id").alias("_head"))
    # Columns of the input travel in a struct, so that no name of theirs clashes.
    rows = docs.select(F.struct(*[F.col(f"`{n}`") for n in names]).alias("_row"), class_key(F.col(f"`{text}`")).alias("_cls"))
    first = rows.filter("_cls is not null").join(heads, "_cls").filter(
        F.col(f"_row.`{doc_id}`").eqNullSafe(F.col("_head"))).groupBy("_cls").agg(F.first("_row").alias("_row"))
    return first.select("_row").union(rows.filter("_cls is null").select("_row")).select("_row.*")
