"""Language identification by hyperdimensional profiles.

Every character has a random vector of +1 and -1. The vectors of three characters in a row,
permuted (rotated) by their place, are bound by multiplication into the vector of the n-gram;
a document is the sum (bundle) of its n-grams' vectors, a language prototype the sum over all
its training documents. The prediction is the language whose prototype has the largest cosine
with the document.

Training bundles all documents it is given. Bundling is a sum, so tasks send one
row per language and part, and Spark adds them up by language and dimension.

Edge cases. A null text, or one without a letter, is ``und`` with score 0; so is everything if
no language was learned. Ties go to the smaller language name. Very long texts are read in
blocks of ``BLOCK`` characters, with nothing left out. Null languages teach nothing. Repeated
rows are predicted each; empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronosift.session import pinned

DIMENSIONS = 1024
GRAM = 3
BLOCK = 1 << 20
# Languages beyond this many are refused: prototypes are held in every task.
MOST_LANGUAGES = 1000
UNKNOWN = "und"
BATCH_LANGUAGES = 64
# Rows that a task gives back at a time, a multiple of those that are judged together.
SENT = 1024


class Encoder:
    """Texts to counts of n-grams, and n-grams to vectors. Vectors depend on the characters
    alone, so all tasks have the same ones."""

    def __init__(self, dimensions: int = DIMENSIONS):
        self.dimensions = dimensions
        self.letters = np.zeros(0x110000, dtype=bool)
        self.known = np.zeros(0x110000, dtype=bool)
        self.vectors: dict[int, np.ndarray] = {}

    def _is_letter(self, codes: np.ndarray) -> np.ndarray:
        fresh = codes[~self.known[codes]]
        for code in np.unique(fresh):
            self.letters[code] = chr(code).isalpha()
            self.known[code] = True
        return self.letters[codes]

    def grams(self, text: str) -> tuple[np.ndarray, np.ndarray] | None:
        """Different n-grams with their counts; None without a letter. Everything that is not
        a letter is one space, also before the first and after the last letter."""
        parts, tail, found = [], np.full(GRAM - 1, 32, dtype=np.int64)[:1], False
        for at in range(0, len(text), BLOCK):
            codes = np.frombuffer(text[at:at + BLOCK].lower().encode("utf-32-le", "surrogatepass"), dtype="<u4")
            letter = self._is_letter(codes)
            found = found or bool(letter.any())
            codes = np.concatenate([tail, np.where(letter, codes, 32).astype(np.int64)])
            if at + BLOCK >= len(text):
                codes = np.append(codes, 32)
            space = codes == 32
            keep = np.ones(len(codes), dtype=bool)
            keep[1:] = ~(space[1:] & space[:-1])
            codes = codes[keep]
            if len(codes) >= GRAM:
                keys = (codes[:-2] << 42) | (codes[1:-1] << 21) | codes[2:]
                parts.append(np.unique(keys, return_counts=True))
            tail = codes[-(GRAM - 1):]
        if not found or not parts:
            return None
        if len(parts) == 1:
            return parts[0]
        return merged(parts)

    def letter_vector(self, code: int) -> np.ndarray:
        vector = self.vectors.get(code)
        if vector is None:
            vector = np.random.default_rng(code).integers(0, 2, self.dimensions, dtype=np.int8) * 2 - 1
            if len(self.vectors) < 20_000:
                self.vectors[code] = vector
        return vector

    def gram_vectors(self, keys: np.ndarray) -> np.ndarray:
        """Row per n-gram: the first character rotated twice, the second once, bound."""
        mask = (1 << 21) - 1
        columns = [keys >> 42, (keys >> 21) & mask, keys & mask]
        codes, where = np.unique(np.concatenate(columns), return_inverse=True)
        table = np.stack([self.letter_vector(int(c)) for c in codes])
        first, second, third = where.reshape(3, -1)
        return np.roll(table, 2, axis=1)[first] * np.roll(table, 1, axis=1)[second] * table[third]

    def bundle(self, keys: np.ndarray, counts: np.ndarray, rows: int = 4096) -> np.ndarray:
        total = np.zeros(self.dimensions)
        for at in range(0, len(keys), rows):
            total += counts[at:at + rows].astype(np.float32) @ self.gram_vectors(keys[at:at + rows]).astype(np.float32)
        return total


def merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    keys, where = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
    counts = np.bincount(where, weights=np.concatenate([c for _, c in parts]))
    return keys, counts.astype(np.int64)


def _bundled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows ``text, lang`` to rows ``lang, vector``; n-grams are added up before they are bound."""
    encoder, counts = Encoder(), {}

    def flush() -> pa.RecordBatch:
        langs = sorted(counts)
        vectors = [encoder.bundle(*merged(counts[lang])) for lang in langs]
        counts.clear()
        return pa.RecordBatch.from_arrays(
            [pa.array(langs, pa.string()), pa.array([v.tolist() for v in vectors], pa.list_(pa.float64()))],
            names=["lang", "vector"])

    held = 0
    for batch in batches:
        for text, lang in zip(batch.column(0), batch.column(1)):
            grams = encoder.grams(text.as_py())
            if grams is None:
                continue
            parts = counts.setdefault(lang.as_py(), [])
            parts.append(grams)
            held += len(grams[0])
            if len(parts) >= 256:
                before = sum(len(k) for k, _ in parts)
                parts[:] = [merged(parts)]
                held += len(parts[0][0]) - before
            if held > 4_000_000:
                yield flush()
                held = 0
    if counts:
        yield flush()


def prototypes(docs: DataFrame, text: str = "text", lang: str = "lang") -> dict[str, np.ndarray]:
    """Unit prototype of each language, learned from all rows of ``docs``."""
    rows = docs.select(F.col(text).cast("string").alias("text"), F.col(lang).cast("string").alias("lang")).filter(
        "text is not null and lang is not null")
    parts = rows.mapInArrow(_bundled, "lang string, vector array<double>")
    sums = pinned(parts.select("lang", F.posexplode("vector").alias("at", "value"))
                  .groupBy("lang", "at").agg(F.sum("value").alias("value")))
    langs = sums.filter("at = 0").limit(MOST_LANGUAGES + 1).count()
    if langs > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    found: dict[str, np.ndarray] = {}
    # At most MOST_LANGUAGES * DIMENSIONS numbers.
    for row in sums.collect():
        found.setdefault(row["lang"], np.zeros(DIMENSIONS))[row["at"]] = row["value"]
    found = {k: v / np.linalg.norm(v) for k, v in found.items() if np.any(v)}
    return dict(sorted(found.items()))


def _predictor(model: dict[str, np.ndarray], within: tuple[int, str] | None = None):
    langs = list(model)
    profiles = np.stack([model[k] for k in langs]).astype(np.float32) if langs else None

    def score(encoder: Encoder, grams: list) -> tuple[list[str], list[float]]:
        """Language and cosine of a few documents, whose vectors come from one product."""
        known = [i for i, g in enumerate(grams) if g is not None]
        names, scores = [UNKNOWN] * len(grams), [0.0] * len(grams)
        if profiles is None or not known:
            return names, scores
        lookup = np.unique(np.concatenate([grams[i][0] for i in known]))
        if len(lookup) <= 16_384:
            counts = np.zeros((len(known), len(lookup)), dtype=np.float32)
            for row, i in enumerate(known):
                counts[row, np.searchsorted(lookup, grams[i][0])] = grams[i][1]
            vectors = counts @ encoder.gram_vectors(lookup).astype(np.float32)
        else:
            vectors = np.stack([encoder.bundle(*grams[i]) for i in known])
        norms = np.maximum(np.linalg.norm(vectors, axis=1), 1e-12)
        cosines = vectors @ profiles.T / norms[:, None]
        for row, i in enumerate(known):
            best = int(np.argmax(cosines[row]))
            names[i], scores[i] = langs[best], min(1.0, max(0.0, float(cosines[row, best])))
        return names, scores

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder()
        for whole in batches:
            # Given back in small batches, of which the receiver holds one at a time.
            for at in range(0, whole.num_rows, SENT):
                batch = whole.slice(at, SENT)
                if within:
                    texts, kept = pc.struct_field(batch.column(within[0]), within[1]), batch.columns
                else:
                    texts, kept = batch.column(batch.num_columns - 1), batch.columns[:-1]
                names, scores = [], []
                for start in range(0, len(texts), 128):
                    found = score(encoder, [None if t is None else encoder.grams(t)
                                            for t in texts[start:start + 128].to_pylist()])
                    names += found[0]
                    scores += found[1]
                yield pa.RecordBatch.from_arrays(
                    [*kept, pa.array(names, pa.string()), pa.array(scores, pa.float64())],
                    names=[*batch.schema.names[:len(kept)], "lang_pred", "score"])
    return predict


def noise(model: dict[str, np.ndarray]) -> float:
    """The greatest cosine to be expected of a text that is like none of the languages: of as many
    numbers with the deviation of random vectors' cosines."""
    return float(np.sqrt(2 * np.log(max(len(model), 2)) / DIMENSIONS))


def predict(docs: DataFrame, model: dict[str, np.ndarray], keep: list[Column], text: str = "text") -> DataFrame:
    """The columns ``keep`` of every document with ``lang_pred`` and ``score``. The score is
    the cosine with the prototype of the language, 0 if negative."""
    rows = docs.select(*keep, F.col(text).cast("string").alias("_text"))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])
    return rows.mapInArrow(_predictor(model), f"{kinds}, lang_pred string, score double")


def predict_rows(docs: DataFrame, model: dict[str, np.ndarray], text: str = "text") -> DataFrame:
    """Whole rows as ``_row`` with ``lang_pred`` and ``score``, as ``predict`` gives them; a string text goes to
    the tasks once, in its row."""
    row = F.struct(*[F.col(f"`{n}`") for n in docs.columns]).alias("_row")
    if docs.schema[text].dataType.simpleString() != "string":
        return predict(docs, model, [row], text)
    rows = docs.select(row)
    return rows.mapInArrow(_predictor(model, (0, text)), f"`_row` {rows.schema[0].dataType.simpleString()}, lang_pred string, score double")


def held_out(doc_id: Column) -> Column:
    """One third of all ids, from which nothing is learned; null ids are not among them."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def identify(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """``doc_id, held_out, lang_pred, score`` of every document."""
    model = prototypes(docs.filter(~held_out(F.col(doc_id))), text, lang)
    key = F.col(doc_id)
    return predict(docs, model, [key.alias("doc_id"), held_out(key).alias("held_out")], text)
