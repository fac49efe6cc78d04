"""Benchmark decontamination by winnowing.

A window is ``span`` consecutive words of an item, or all words of a shorter item. Every run of
``GRAM`` words has a hash, and of the hashes in a window the least one is kept: the fingerprint.
Two texts that share a window share its fingerprint, at the same place of it, so that no
shared span of ``span`` words or more is missed. Few fingerprints are kept, as neighbouring
windows mostly have the same one. Items shorter than a window are fingerprinted for their own
length as well, with runs as long as they are when they have fewer than ``GRAM`` words.

Fingerprints of the items mark a bitmap of fixed size, which is all that tasks get of them. A
fingerprint of a document that hits a mark is extended to the windows it stands for, and these are
joined with the items' windows by fingerprint and words. A document names each of its different
windows once, with all places. Windows that the same items have are an item set, so that a
passage of many items and many documents gives one row for each document. Documents with the same
item sets are answered once.

Edge cases. A null text has no words and is in no result but its own row. Null item ids are listed
as an empty string. Repeated items of one id count once, items of equal texts each. Repeated
documents are judged each. Empty tables give empty or clean results. Other columns are not
looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronosift.session import pinned

SPAN, GRAM = 10, 5
# Bits of the fingerprint filter, as a power of two: 2 MB, whatever the number of items.
FILTER_BITS = 24
# A window that very many documents have is dealt to so many tasks.
SALTS = 32

_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
# Separators become blanks, A-Z are lower-cased, and bytes of other scripts stay.
_PLAIN = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


def words_of(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(_PLAIN).split() if text else []


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def hashes_of(words: list[bytes]) -> np.ndarray:
    from xxhash import xxh3_64_intdigest
    return np.fromiter(map(xxh3_64_intdigest, words), dtype=np.uint64, count=len(words))


def fingerprints(hashes: np.ndarray, span: int, gram: int = GRAM) -> np.ndarray:
    """The fingerprint of every window of ``span`` words: the least hash of a run in it."""
    if len(hashes) < span:
        return np.zeros(0, dtype=np.uint64)
    gram = min(gram, span)
    runs = np.full(len(hashes) - gram + 1, span, dtype=np.uint64)
    for i in range(gram):
        runs = runs * _MULTIPLIER + hashes[i:len(hashes) - gram + 1 + i]
    runs = _mixed(runs)
    least = runs[:len(hashes) - span + 1].copy()
    for i in range(1, span - gram + 1):
        np.minimum(least, runs[i:i + len(least)], out=least)
    return least


class Marks:
    """A bitmap of fingerprints by their first bits."""

    def __init__(self, blocks: list[tuple[int, int]]):
        bits = np.zeros(1 << (FILTER_BITS - 6), dtype=np.uint64)
        for block, mask in blocks:
            bits[block] = np.uint64(mask & 0xFFFFFFFFFFFFFFFF)
        self.bits = bits

    def hit(self, prints: np.ndarray) -> np.ndarray:
        place = prints >> np.uint64(64 - FILTER_BITS)
        return (self.bits[place >> np.uint64(6)] >> (place & np.uint64(63))) & np.uint64(1) != 0


def _windows(words: list[bytes], hashes: np.ndarray, span: int, marks: Marks | None) -> tuple[list, list, list]:
    """Different windows of ``span`` words whose fingerprint is marked: fingerprints, words, places."""
    prints = fingerprints(hashes, span)
    found: dict[bytes, tuple[int, list[int]]] = {}
    for at in (np.nonzero(marks.hit(prints))[0] if marks else np.arange(len(prints))).tolist():
        body = b" ".join(words[at:at + span])
        if body in found:
            found[body][1].append(at)
        else:
            found[body] = (int(prints[at].view(np.int64)), [at])
    return [p for p, _ in found.values()], [b.decode("utf-8", "replace") for b in found], [a for _, a in found.values()]


_SUSPECTS = "array<struct<span: int, print: bigint, words: string, places: array<int>>>"


def _searched(spans: list[int] | None, longest: int, blocks: list[tuple[int, int]] | None):
    """Texts to their windows: ``id, number, n_words, suspects``. Without ``spans`` a text has
    windows of ``longest`` words, or is one itself."""
    shape = pa.list_(pa.struct([("span", pa.int32()), ("print", pa.int64()), ("words", pa.string()),
                                ("places", pa.list_(pa.int32()))]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marks = Marks(blocks) if blocks is not None else None
        for batch in batches:
            for at in range(0, len(batch), 256):
                part, counts, suspects = batch.slice(at, 256), [], []
                for text in part.column(2):
                    words = words_of(text.as_py())
                    hashes, found = hashes_of(words), []
                    for span in ([min(longest, len(words))] if words else []) if spans is None else spans:
                        found += [{"span": span, "print": p, "words": w, "places": a}
                                  for p, w, a in zip(*_windows(words, hashes, span, marks))]
                    counts.append(len(words))
                    suspects.append(found)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(counts, pa.int64()), pa.array(suspects, shape)],
                    names=["id", "number", "n_words", "suspects"])
    return run


def _texts(table: DataFrame, id_: Column, text: str) -> DataFrame:
    return table.select(id_.alias("id"), F.monotonically_increasing_id().alias("number"), F.col(f"`{text}`").cast("string").alias("text"))


def item_windows(items: DataFrame, span: int = SPAN, item_id: str = "item_id", text: str = "text") -> DataFrame:
    """``item, span, print, words`` of all windows of all items."""
    rows = _texts(items, F.coalesce(F.col(f"`{item_id}`").cast("string"), F.lit("")), text)
    found = rows.mapInArrow(_searched(None, span, None), f"id string, number long, n_words long, suspects {_SUSPECTS}")
    return found.select(F.col("id").alias("item"), F.explode("suspects").alias("w")).select(
        "item", "w.span", "w.print", "w.words").distinct()


def _marked(windows: DataFrame) -> list[tuple[int, int]]:
    """The bitmap's blocks that are not empty: at most 2^(FILTER_BITS - 6)."""
    place = F.shiftrightunsigned("print", 64 - FILTER_BITS)
    blocks = windows.select(F.shiftright(place, 6).alias("block"), (place % 64).cast("int").alias("bit")).groupBy("block").agg(
        F.bit_or(F.expr("shiftleft(1L, bit)")).alias("mask"))
    return [(r["block"], r["mask"]) for r in blocks.collect()]


class Search:
    """Documents against items. ``documents`` is ``number, id, n_words``; ``hits`` is ``number, words,
    span, places, items`` (an item set) of all windows that a document shares with an item; ``members`` is
    ``items, item``."""

    def __init__(self, docs: DataFrame, items: DataFrame, span: int = SPAN, doc_id: str = "doc_id", text: str = "text",
                 item_id: str = "item_id", item_text: str = "text"):
        windows = pinned(item_windows(items, span, item_id, item_text))
        # At most ``span`` different lengths.
        spans = sorted(r["span"] for r in windows.select("span").distinct().collect())
        rows = _texts(docs, F.col(f"`{doc_id}`"), text)
        kind = rows.schema["id"].dataType.simpleString()
        searched = pinned(rows.mapInArrow(
            _searched(spans, span, _marked(windows)), f"id {kind}, number long, n_words long, suspects {_SUSPECTS}"))
        self.documents = searched.select("number", "id", "n_words")
        # Windows of the same items, told by what does not depend on their order.
        mark = F.xxhash64("item")
        of_items = windows.groupBy("span", "print", "words").agg(
            F.count(F.lit(1)).alias("n"), F.bit_xor(mark).alias("x"), F.sum(F.xxhash64("item", F.lit(7)).cast("decimal(38,0)")).alias("s"))
        sets = pinned(of_items.withColumn("items", F.md5(F.concat_ws(":", "n", "x", "s"))))
        some = sets.groupBy("items").agg(F.min(F.struct("span", "print", "words")).alias("w")).select("items", "w.*")
        self.members = windows.join(some, ["span", "print", "words"]).select("items", "item")
        suspects = searched.select("number", F.explode("suspects").alias("w")).select("number", "w.*").withColumn(
            "salt", F.pmod("number", F.lit(SALTS)))
        spread = sets.select("span", "print", "words", "items").withColumn(
            "salt", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(SALTS - 1).cast("bigint"))))
        self.hits = pinned(suspects.join(spread, ["print", "span", "words", "salt"]).select(
            "number", "span", "words", "places", "items"))


def covered(places: Column) -> Column:
    """Number of words in any of ``places``, sorted structs of ``at`` and ``span``."""
    start = F.struct(F.lit(0).cast("bigint").alias("upto"), F.lit(0).cast("bigint").alias("n"))
    return F.aggregate(places, start, lambda a, p: F.struct(
        F.greatest(a["upto"], (p["at"] + p["span"]).cast("bigint")).alias("upto"),
        (a["n"] + F.greatest(F.lit(0), p["at"] + p["span"] - F.greatest(a["upto"], p["at"].cast("bigint")))).alias("n")),
        lambda a: a["n"])


def report(docs: DataFrame, items: DataFrame, span: int = SPAN, doc_id: str = "doc_id", text: str = "text",
           item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """Every document with its words, words hit, and the items that hit it."""
    found = Search(docs, items, span, doc_id, text, item_id, item_text)
    places = F.transform("places", lambda p: F.struct(p.alias("at"), F.col("span").alias("span")))
    by_document = pinned(found.hits.groupBy("number").agg(
        F.sort_array(F.flatten(F.collect_list(places))).alias("places"),
        F.sort_array(F.collect_set("items")).alias("sets")).select(
            "number", covered(F.col("places")).alias("n_hit"), "sets", F.md5(F.array_join("sets", ",")).alias("kind")))
    kinds = by_document.groupBy("kind").agg(F.any_value("sets").alias("sets"))
    named = kinds.select("kind", F.explode("sets").alias("items")).join(found.members, "items").select("kind", "item").distinct()
    answers = named.groupBy("kind").agg(F.count(F.lit(1)).alias("n_items"), F.sort_array(F.collect_list("item")).alias("ids")).select(
        "kind", "n_items", F.sha2(F.concat_ws(",", "ids"), 256).alias("items_sha256"),
        F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(SALTS - 1).cast("bigint"))).alias("salt"))
    told = by_document.withColumn("salt", F.pmod("number", F.lit(SALTS))).join(answers, ["kind", "salt"])
    return found.documents.join(told, "number", "left").select(
        F.col("id").alias("doc_id"), "n_words", F.coalesce("n_hit", F.lit(0)).cast("bigint").alias("n_hit"),
        F.coalesce("n_items", F.lit(0)).cast("bigint").alias("n_items"),
        F.coalesce("items_sha256", F.sha2(F.lit(""), 256)).alias("items_sha256"),
        F.coalesce(F.col("n_hit") > 0, F.lit(False)).alias("contaminated"))
