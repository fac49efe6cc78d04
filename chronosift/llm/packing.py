"""Packing token sequences by linear grouping and best fit.

Documents become token ids with id 0 after each; longer ones are cut into full sequences and
a rest. How many rests have which length is a table of fewer numbers than a sequence has
tokens, whatever the input, and the plan is made from it: lengths above ``LARGE`` of a sequence
are put in order, cut into groups of equal size and rounded up to the largest of their group;
which few-size configurations to use how often is a linear programme, solved by column
generation; configurations are filled with the actual lengths of their groups; what is left
and all small lengths then go where they fit best, the largest first. The plan says for a
run of equally long documents to which run of sequences it goes. Documents are numbered in
order of length by a range partitioning, and each finds its sequence by its number.

Edge cases. A null or empty text is the id 0 alone. Repeated rows are packed each. An empty
table gives an empty result. Very long texts are tokenized in blocks that end at white space.
"""

from __future__ import annotations

import os
import re
import sys
import types
import zlib
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronosift.operators.ordinal import with_position
from chronosift.session import pinned

CAPACITY = 2048
LARGE, GROUPS = 1 / 3, 32
# Parts of the configurations that are tried.
SHARES = (1, 1 / 2, 1 / 4, 1 / 8, 1 / 16, 0)
# Words whose ids a Python worker remembers.
MEMORY = 400_000
BLOCK = 1 << 20


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers
    return public_tokenizers.path(name)


class Memory(dict):
    """Results of a function of a word, up to a number of words. The first words stay, as most
    of the frequent ones are among them, until very many others were asked for."""

    def __init__(self, function: Callable[[str], bytes], most: int):
        super().__init__()
        self.function, self.most, self.others = function, most, 0

    def __missing__(self, key: str) -> bytes:
        found = self.function(key)
        if len(self) < self.most:
            self[key] = found
        else:
            self.others += 1
            if self.others > 16 * self.most:
                self.others = 0
                self.clear()
        return found


class WordTokenizer:
    """Ids of a text by a tokenizer that works word by word.

    The tokenizer's own model turns words into ids; ids of known words are looked up. Texts
    with control characters or marks of special tokens go to the tokenizer as a whole.
    """

    def __init__(self, path: str):
        import regex
        from tokenizers import Tokenizer
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.whole = Tokenizer.from_file(path)
        self.model = self.whole.model
        # The tokenizer's pieces of words, and its characters for bytes.
        self.pieces = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [b for b in range(256) if b not in plain]
        self.characters = {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}
        # Control characters, characters without a meaning of their own, rare scripts, and marks
        # of special tokens.
        self.unusual = re.compile("[\x00-\x08\x0e-\x1f\x7f-\x9f\ud800-\uf8ff\U00010000-\U0001efff"
                                  "\U000e0000-\U0010ffff]|<\\|")
        self.space = re.compile(r"\s")
        self.known = Memory(self.encode_word, MEMORY)
        self.parts = Memory(self.encode_piece, MEMORY // 4)

    def encode_piece(self, piece: str) -> bytes:
        if not piece.isascii():
            piece = piece.encode("utf-8").decode("latin-1").translate(self.characters)
        return array("I", [t.id for t in self.model.tokenize(piece)]).tobytes()

    def encode_word(self, word: str) -> bytes:
        if word.isalpha():
            return self.encode_piece(word)
        return b"".join([self.parts[piece] for piece in self.pieces.findall(word)])

    def _block(self, text: str) -> bytes:
        if self.unusual.search(text):
            return np.array(self.whole.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()
        if not text.isascii():
            import unicodedata
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
        return b"".join(map(self.known.__getitem__, text.lower().split()))

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit numbers."""
        if len(text) <= BLOCK:
            return self._block(text)
        out, at = [], 0
        while at < len(text):
            cut = self.space.search(text, min(at + BLOCK, len(text)))
            end = cut.start() if cut else len(text)
            out.append(self._block(text[at:end]))
            at = end
        return b"".join(out)


def tokenizer(path: str) -> WordTokenizer:
    """One per Python worker, kept from task to task."""
    kept = sys.modules.setdefault("_chronosift_tokenizers", types.ModuleType("_chronosift_tokenizers"))
    if path not in kept.__dict__:
        kept.__dict__[path] = WordTokenizer(path)
    return kept.__dict__[path]


def _cut(path: str, capacity: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = tokenizer(path)
        for batch in batches:
            rows, piece, start, length, crc = [], [], [], [], []
            for i, text in enumerate(batch.column(1)):
                ids = encoder.encode(text.as_py() or "") + b"\0\0\0\0"
                total = len(ids) // 4
                for nth, at in enumerate(range(0, total, capacity)):
                    part = ids[4 * at:4 * (at + capacity)]
                    rows.append(i)
                    piece.append(nth)
                    start.append(at)
                    length.append(len(part) // 4)
                    crc.append(zlib.crc32(part))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(rows, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()),
                 pa.array(length, pa.int64()), pa.array(crc, pa.int64())],
                names=["doc_id", "piece", "start", "length", "ids_crc32"])
    return run


def pieces(docs: DataFrame, capacity: int = CAPACITY, path: str | None = None, doc_id: str = "doc_id",
           text: str = "text") -> DataFrame:
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    kind = rows.schema[0].dataType.simpleString()
    return rows.mapInArrow(_cut(path or tokenizer_path(), capacity),
                           f"doc_id {kind}, piece int, start long, length long, ids_crc32 long")


# ---------------------------------------------------------------------------
# The plan, from the number of pieces of each length
# ---------------------------------------------------------------------------

def _groups(counts: np.ndarray, large: int, groups: int) -> list[tuple[int, int]]:
    """``rounded length, number`` of groups of equal cardinality, the largest first."""
    total = int(counts[large + 1:].sum())
    found: dict[int, int] = {}
    if not total:
        return []
    ends = np.unique(np.linspace(0, total, groups + 1).round().astype(int))
    lengths = np.arange(len(counts) - 1, large, -1)
    upto = np.cumsum(counts[lengths])
    for a, b in zip(ends[:-1], ends[1:]):
        size = int(lengths[np.searchsorted(upto, a, side="right")])
        found[size] = found.get(size, 0) + int(b - a)
    return list(found.items())


def _best_configuration(values: np.ndarray, sizes: np.ndarray, capacity: int) -> np.ndarray:
    """The configuration of the largest value that fits: an unbounded knapsack."""
    best, pick = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    least = int(sizes.min())
    for c in range(least, capacity + 1):
        fits = np.nonzero(sizes <= c)[0]
        gains = best[c - sizes[fits]] + values[fits]
        top = int(np.argmax(gains))
        if gains[top] > best[c - 1] + 1e-12:
            best[c], pick[c] = gains[top], fits[top]
        else:
            best[c] = best[c - 1]
    config, c = np.zeros(len(sizes), dtype=int), capacity
    while c >= least:
        if pick[c] < 0:
            c -= 1
        else:
            config[pick[c]] += 1
            c -= int(sizes[pick[c]])
    return config


def configurations(sizes: list[int], demand: list[int], capacity: int, rounds: int = 2000) -> list[tuple[np.ndarray, int]]:
    """Configurations (how many of each size) and how often each is used, rounded down, from
    the linear programme of fewest sequences, by column generation."""
    if not sizes:
        return []
    size, need = np.array(sizes), np.array(demand, dtype=float)
    basis = np.diag(capacity // size).astype(float)
    used = np.linalg.solve(basis, need)
    for _ in range(rounds):
        prices = np.linalg.solve(basis.T, np.ones(len(size)))
        config = _best_configuration(prices, size, capacity)
        if prices @ config <= 1 + 1e-9:
            break
        move = np.linalg.solve(basis, config.astype(float))
        steps = np.where(move > 1e-9, used / np.where(move > 1e-9, move, 1), np.inf)
        out = int(np.argmin(steps))
        basis[:, out] = config
        used = np.maximum(np.linalg.solve(basis, need), 0)
    return [(basis[:, i].astype(int), int(np.floor(used[i] + 1e-9))) for i in range(len(size)) if used[i] >= 1 - 1e-9]


class Run:
    """Equal sequences: how many, and the ``length, times`` they are filled with."""

    def __init__(self, number: int, filled: tuple[tuple[int, int], ...]):
        self.number, self.filled = number, filled


def _substituted(counts: np.ndarray, groups: list[tuple[int, int]], chosen: list[tuple[np.ndarray, int]]) -> list[Run]:
    """Runs of sequences in which actual lengths stand for the rounded ones. Takes them out of
    ``counts``."""
    queues, lengths = [], list(range(len(counts) - 1, 0, -1))
    left, at = counts.copy(), 0
    for _, number in groups:                    # the actual lengths of each group, in order
        queue = []
        while number:
            length = lengths[at]
            part = min(number, int(left[length]))
            if part:
                queue.append([length, part])
                left[length] -= part
                number -= part
            if not left[length]:
                at += 1
        queues.append(queue)
    runs = []
    for config, number in chosen:
        slots = []
        for g in np.nonzero(config)[0]:
            for _ in range(config[g]):
                taken, want, queue = [], number, queues[g]
                while want and queue:
                    part = min(want, queue[0][1])
                    taken.append((queue[0][0], part))
                    counts[queue[0][0]] -= part
                    want -= part
                    queue[0][1] -= part
                    if not queue[0][1]:
                        queue.pop(0)
                slots.append(taken)
        ends = sorted({int(e) for s in slots for e in np.cumsum([p for _, p in s])})
        begin = 0
        for end in ends:
            filled: dict[int, int] = {}
            for slot in slots:
                upto = 0
                for length, part in slot:
                    upto += part
                    if begin < upto:
                        filled[length] = filled.get(length, 0) + 1
                        break
            runs.append(Run(end - begin, tuple(filled.items())))
            begin = end
    return runs


def _best_fit(counts: np.ndarray, runs: list[Run], capacity: int) -> list[Run]:
    """All of ``counts`` put where they fit best, the largest first."""
    room: list[list[Run]] = [[] for _ in range(capacity + 1)]
    for run in runs:
        room[capacity - sum(a * b for a, b in run.filled)].append(run)
    for length in range(capacity, 0, -1):
        left, at = int(counts[length]), length
        while left:
            while at <= capacity and not room[at]:
                at += 1
            if at > capacity:
                each = capacity // length
                for number, times in ((left // each, each), (1, left % each)):
                    if number and times:
                        room[capacity - times * length].append(Run(number, ((length, times),)))
                break
            run, each = room[at].pop(), at // length
            full = min(run.number, left // each)
            some = min(left - full * each, each) if full < run.number else 0
            for number, times in ((full, each), (1 if some else 0, some)):
                if number:
                    room[at - times * length].append(Run(number, (*run.filled, (length, times))))
            left -= full * each + some
            rest = run.number - full - (1 if some else 0)
            if rest:
                room[at].append(Run(rest, run.filled))
    return [run for place in room for run in place]


def plan(counts: np.ndarray, capacity: int = CAPACITY, large: float = LARGE, groups: int = GROUPS) -> list[Run]:
    """Runs of sequences for ``counts[length]`` pieces of each length.

    Rounding leaves gaps that the small pieces have to fill. Where there are too few of them, a
    part of every configuration is left out and its pieces go with the small ones; the part that
    gives the fewest sequences is used, the largest such part.
    """
    counts = np.asarray(counts, dtype=np.int64)
    grouped = _groups(counts, int(capacity * large), groups)
    chosen = configurations([s for s, _ in grouped], [n for _, n in grouped], capacity)
    best: list[Run] | None = None
    for share in SHARES:
        left = counts.copy()
        used = [(config, int(number * share)) for config, number in chosen if int(number * share)]
        runs = _best_fit(left, _substituted(left, grouped, used), capacity)
        if best is None or sum(r.number for r in runs) < sum(r.number for r in best):
            best = runs
    return best


def segments(counts: np.ndarray, runs: list[Run]) -> tuple[np.ndarray, int]:
    """Rows ``first piece, length, times, first sequence, offset`` by first piece, where pieces
    are numbered in order of length; and the number of sequences."""
    first = np.concatenate([[0], np.cumsum(counts)])[:-1].astype(np.int64)
    rows, sequence = [], 0
    for run in runs:
        offset = 0
        for length, times in run.filled:
            rows.append((first[length], length, times, sequence, offset))
            first[length] += run.number * times
            offset += length * times
        sequence += run.number
    return np.array(sorted(rows), dtype=np.int64).reshape(-1, 5), sequence


def _assigned(table: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.column(batch.num_columns - 1).to_numpy()
            row = table[np.searchsorted(table[:, 0], at, side="right") - 1]
            bin_, nth = np.divmod(at - row[:, 0], row[:, 2])
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array(row[:, 3] + bin_), pa.array(row[:, 4] + nth * row[:, 1])],
                names=[*batch.schema.names[:-1], "sequence_id", "offset"])
    return run


def pack(docs: DataFrame, capacity: int = CAPACITY, path: str | None = None, doc_id: str = "doc_id",
         text: str = "text") -> DataFrame:
    """Every piece with its sequence and its place there."""
    cut = pinned(pieces(docs, capacity, path, doc_id, text).withColumn("_row", F.monotonically_increasing_id()))
    full, rest = cut.filter(F.col("length") == capacity), cut.filter(F.col("length") < capacity)
    counts = np.zeros(capacity + 1, dtype=np.int64)
    # Fewer rows than a sequence has tokens.
    for row in rest.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect():
        counts[row["length"]] = row["n"]
    table, number = segments(counts, plan(counts, capacity))
    placed = with_position(rest, [F.col("length"), F.col("_row")], "_at")
    names = ["doc_id", "piece", "start", "length", "ids_crc32"]
    schema = ", ".join(f"{n} {rest.schema[n].dataType.simpleString()}" for n in names)
    packed = placed.select(*names, "_at").mapInArrow(_assigned(table), f"{schema}, sequence_id long, offset long")
    whole = full.select(*names, (F.col("_row") + number).alias("sequence_id"), F.lit(0).cast("bigint").alias("offset"))
    return packed.unionByName(whole)
