"""Alignment of two tokenizers' tokens by diagonal run skipping.

Both tokenizers cut the same bytes, so that a token is told by where it ends. Places where tokens of
both end cut them into groups. Tokens come mostly one to one, with indexes of a fixed difference:
from the end of a group the lengths of tokens, which give their ends, are compared at this shift, 16
tokens, then 32, 64 and so on, until a stretch differs; its first difference tells the last equal token,
and what is before it is jumped. At an irregular group the side whose token ends first goes on until
both end at the same place, and the shift becomes what it is there. Tokens of the two sides are linked
where their bytes overlap: one to one in a jumped stretch, and step by step in an irregular group.

How often a pair of ids is linked is counted over all documents. Each document keeps its different
pairs with their numbers. The corpus counts are dealt into parts of at most about ``PART`` pairs,
and each part is sent to all tasks in turn, which add up what they know of it for each document:
the pairs themselves are never shuffled, and no pair is hot.

Edge cases. Null and empty texts have no tokens, and neither has a text whose tokens don't give
back its bytes (one with the character that stands for a space, say): zeros, and an empty string
for the groups. Special tokens' strings in a text are plain text. Null and repeated ids are judged
row by row. A text is tokenized whole. An empty table gives an empty result. Other columns are not
looked at.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronosift.session import pinned

# Pairs of ids, with their counts, that are sent to all tasks at a time: about 100 MB.
PART = 1_000_000
# Texts that a task holds with their tokens at a time, by characters.
BLOCK = 1 << 20

# Fixed value: how the byte-level vocabulary cuts a text into words.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
FIRST, SECOND = "byte_bpe_50k.json", "piece_bpe_32k.model"


def tokenizer_path(name: str) -> str:
    import public_tokenizers
    return public_tokenizers.path(name)


def byte_letters() -> dict[str, int]:
    """The letters by which byte-level vocabularies write bytes: printable ones stand for
    themselves, the others in order for the code points from 256 on."""
    shown = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    hidden = [b for b in range(256) if b not in shown]
    return {**{chr(b): b for b in shown}, **{chr(256 + i): b for i, b in enumerate(hidden)}}


class ByteLevel:
    """Byte-level BPE from its JSON file: an id is also the rank of its merge."""

    def __init__(self, path: str):
        import tiktoken
        with open(path, encoding="utf-8") as file:
            parts = json.load(file)
        letters = byte_letters()
        special = {t["id"] for t in parts["added_tokens"]}
        ranks = {bytes(letters[c] for c in piece): i for piece, i in parts["model"]["vocab"].items() if i not in special}
        self.coder = tiktoken.Encoding("plain", pat_str=WORDS, mergeable_ranks=ranks, special_tokens={})
        self.pieces = [b""] * (max(ranks.values()) + 1)
        for piece, i in ranks.items():
            self.pieces[i] = piece

    def __call__(self, text: str) -> list[int]:
        return self.coder.encode_ordinary(" " + text)

    def joined(self, ids: list[int]) -> bytes:
        return self.coder.decode_bytes(ids)


class Pieces:
    """A sentencepiece model; bytes of its pieces."""

    def __init__(self, path: str):
        import sentencepiece
        self.coder = sentencepiece.SentencePieceProcessor(model_file=path)
        self.pieces = []
        for i in range(self.coder.get_piece_size()):
            piece = self.coder.id_to_piece(i)
            self.pieces.append(bytes([int(piece[3:5], 16)]) if self.coder.is_byte(i)
                               else piece.replace("▁", " ").encode("utf-8"))

    def __call__(self, text: str) -> list[int]:
        return self.coder.encode(text, num_threads=1)

    def joined(self, ids: list[int]) -> bytes:
        return b"".join(map(self.pieces.__getitem__, ids))


def equal_run(first: list[int], second: list[int], i: int, j: int) -> int:
    """How many ends from ``i`` on are those from ``j`` on: probes of 1, 2, 4 ... tokens, then halves."""
    done, width = 0, 1
    while width:
        part = first[i + done:i + done + width]
        if len(part) == width and part == second[j + done:j + done + width]:
            done, width = done + width, width * 2
            continue
        width //= 2
        break
    while width:
        part = first[i + done:i + done + width]
        if len(part) == width and part == second[j + done:j + done + width]:
            done += width
        width //= 2
    return done


def equal_bytes(first: bytes, second: bytes, i: int, j: int) -> int:
    """``equal_run`` of bytes: probes of 16, 32, 64 ... of them, each as one number. The lowest bit that two
    numbers differ in tells the first byte that differs."""
    at, to, width = i, j, 16
    while True:
        part, other = first[at:at + width], second[to:to + width]
        if part != other:
            differ = int.from_bytes(part, "little") ^ int.from_bytes(other, "little")
            same = (differ & -differ).bit_length() - 1 >> 3 if differ else width
            return at - i + min(same, len(part), len(other))
        if len(part) < width:
            return at - i + len(part)
        at, to, width = at + width, to + width, width * 2


def align(first: list[int] | np.ndarray, second: list[int] | np.ndarray) -> tuple[list[tuple[int, int, int, int]], np.ndarray, np.ndarray]:
    """Stretches ``(i, i_end, j, j_end)`` of two arrays of ends, and linked indexes of both. A stretch
    of as many tokens on both sides whose ends are equal is as many groups of one token; any other is one.

    After the end of a group ends are equal as long as the lengths of the tokens are, and these mostly fit in bytes."""
    sizes = [np.diff(np.asarray(ends, np.int64), prepend=0) for ends in (first, second)]
    narrow = all(s.max(initial=0) < 256 for s in sizes)
    a, b = (s.astype(np.uint8).tobytes() if narrow else s.tolist() for s in sizes)
    same = equal_bytes if narrow else equal_run
    # What each link is followed by: the next token of the first side (1), of the second (2), or of both (3).
    stretches, steps = [], bytearray()
    i = j = 0
    while i < len(a) and j < len(b):
        gap = a[i] - b[j]
        if not gap:
            run = same(a, b, i, j)
            stretches.append((i, i + run, j, j + run))
            steps += b"\3" * run
            i, j = i + run, j + run
            continue
        start, other = i, j
        while gap:
            if gap < 0:
                steps.append(1)
                i += 1
                gap += a[i]
            else:
                steps.append(2)
                j += 1
                gap -= b[j]
        steps.append(3)
        i, j = i + 1, j + 1
        stretches.append((start, i, other, j))
    found = np.frombuffer(steps, np.uint8).astype(np.int64)
    left, right = ((side.cumsum() - side) for side in (found & 1, found >> 1))
    return stretches, left, right


class Aligner:
    """Texts to ids of both tokenizers, groups and links."""

    def __init__(self, first: str, second: str):
        self.coders = ByteLevel(first), Pieces(second)
        self.lengths = [np.array([len(p) for p in c.pieces], np.int64) for c in self.coders]
        # Each id followed by a comma, then each followed by what ends its side of a group: eight bytes, as one number.
        said = [[f"{i}{end}" for end in ends for i in range(len(c.pieces))] for c, ends in zip(self.coders, (",|", ",;"))]
        if max(len(name) for names in said for name in names) > 8:
            raise ValueError("a vocabulary has ids of more than seven digits")
        self.names = [np.array(names, "S8").view(np.int64) for names in said]

    def tokens(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        none = np.zeros(0, np.int64)
        if not text:
            return none, none
        whole = b" " + text.encode("utf-8")
        found = [c(text) for c in self.coders]
        if any(c.joined(ids) != whole for c, ids in zip(self.coders, found)):
            return none, none
        return np.array(found[0], np.int64), np.array(found[1], np.int64)

    def ends(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return self.lengths[0][a].cumsum(), self.lengths[1][b].cumsum()

    def groups(self, last_a: np.ndarray, last_b: np.ndarray, a: np.ndarray, b: np.ndarray) -> bytes:
        """``a1,a2|b1`` of each group, with ``;`` between. ``last_a`` and ``last_b`` are the last indexes of its two sides."""
        before_a, before_b = np.zeros(len(a), np.int64), np.zeros(len(b), np.int64)
        # A token comes after those of its side, and of the other side after those of earlier groups (first) or of its own too.
        before_a[last_a[:-1] + 1] = np.diff(last_b[:-1], prepend=-1)
        before_b[0] = last_a[0] + 1
        before_b[last_b[:-1] + 1] = np.diff(last_a)
        out = np.empty(len(a) + len(b), np.int64)
        for ids, before, last, names in ((a, before_a, last_a, self.names[0]), (b, before_b, last_b, self.names[1])):
            said = ids.copy()
            said[last] += len(names) // 2
            out[np.arange(len(ids)) + before.cumsum()] = names[said]
        return out.tobytes().translate(None, b"\0")[:-1]


def _aligned(first: str, second: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = Aligner(first, second)

        def packed(rows: list[tuple], ids: pa.Array) -> pa.RecordBatch:
            columns = list(zip(*rows)) if rows else [[] for _ in range(8)]
            lists = []
            for column, kind in ((columns[6], pa.int64()), (columns[7], pa.int32())):
                offsets = np.concatenate([[0], np.cumsum([len(c) for c in column])]).astype(np.int32)
                values = np.concatenate(column) if rows else np.zeros(0)
                lists.append(pa.ListArray.from_arrays(pa.array(offsets), pa.array(values.astype(kind.to_pandas_dtype()))))
            return pa.RecordBatch.from_arrays(
                [ids, *[pa.array(c, pa.int64()) for c in columns[:5]], pa.array(columns[5], pa.string()), *lists],
                names=["id", "number", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "times"])

        for batch in batches:
            rows, begin, held = [], 0, 0
            for at, (number, text) in enumerate(zip(batch.column(1), batch.column(2))):
                body = text.as_py()
                a, b = aligner.tokens(body)
                ends_a, ends_b = aligner.ends(a, b)
                _, left, right = align(ends_a, ends_b)
                shared = ends_a[left] == ends_b[right]
                last_a, last_b = left[shared], right[shared]
                pairs, times = np.unique(b[right] << 32 | a[left], return_counts=True)
                digest = hashlib.sha256(aligner.groups(last_a, last_b, a, b)).hexdigest() if len(a) else ""
                rows.append((number.as_py(), len(a), len(b), len(last_a), len(left), digest, pairs, times))
                held += len(body or "")
                if held > BLOCK:
                    yield packed(rows, batch.column(0).slice(begin, at + 1 - begin))
                    rows, begin, held = [], at + 1, 0
            if begin < len(batch):
                yield packed(rows, batch.column(0).slice(begin))
    return run


class Alignment:
    """``documents``: ``number, id``, counts and digest of the groups, ``pairs`` (second id times 2^32, plus
    first id) and ``times`` they are linked there. ``counts``: ``pair, n, best`` over the whole corpus."""

    def __init__(self, docs: DataFrame, doc_id: str = "doc_id", text: str = "text", first: str | None = None,
                 second: str | None = None):
        rows = docs.select(F.col(f"`{doc_id}`").alias("id"), F.monotonically_increasing_id().alias("number"),
                           F.col(f"`{text}`").cast("string").alias("text"))
        kind = rows.schema["id"].dataType.simpleString()
        self.documents = pinned(rows.mapInArrow(
            _aligned(first or tokenizer_path(FIRST), second or tokenizer_path(SECOND)),
            f"id {kind}, number long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, "
            "pairs array<long>, times array<int>"))
        counted = self._linked().groupBy("pair").agg(F.sum("times").alias("n"))
        totals = pinned(counted.withColumn("second", F.shiftright("pair", 32)))
        top = totals.groupBy("second").agg(F.max("n").alias("top"))
        self.counts = pinned(totals.join(top, "second").select("pair", "n", (F.col("n") == F.col("top")).alias("best")))

    def _linked(self) -> DataFrame:
        linked = F.explode(F.arrays_zip("pairs", "times"))
        return self.documents.select("number", linked.alias("p")).select("number", "p.pairs", "p.times").withColumnRenamed("pairs", "pair")

    def sums(self, part: int = PART) -> DataFrame:
        """``number, n_best, count_sum`` of documents with links: one pass over the documents for each part."""
        parts = -(-self.counts.count() // part) or 1
        linked, found = self._linked(), None
        for at in range(parts):
            mine = F.pmod(F.xxhash64("pair"), F.lit(parts)) == at
            sent = F.broadcast(self.counts.filter(mine))
            some = linked.filter(mine).join(sent, "pair").groupBy("number").agg(
                F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"),
                F.sum(F.col("times") * F.col("n")).alias("count_sum"))
            found = some if found is None else found.union(some)
        return found.groupBy("number").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))


def report(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", first: str | None = None,
           second: str | None = None) -> DataFrame:
    """Every document with its tokens, groups and links, and how its links stand in the corpus."""
    found = Alignment(docs, doc_id, text, first, second)
    zero = F.lit(0).cast("bigint")
    return found.documents.drop("pairs", "times").join(found.sums(), "number", "left").select(
        F.col("id").alias("doc_id"), "n_a", "n_b", "n_groups", "n_links", F.coalesce("n_best", zero).alias("n_best"),
        F.coalesce("count_sum", zero).alias("count_sum"), "groups_sha256")
