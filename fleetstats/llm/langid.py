"""Language identification by hyperdimensional profiles.

Each letter has a random vector of +1 and -1, drawn from its code point. A trigram's vector binds its letters' vectors by
multiplication, the first permuted twice and the second once (rotation). A text's profile bundles (adds) its trigrams; a
language's prototype bundles the profiles of its training texts. The prediction is the prototype with the highest cosine.

Text is lower-cased; runs of anything but letters become one space, texts begin and end with one. Null texts and texts
without letters are ``und`` with score 0. Ties go to the first language by name. Only text and, for training, the label are read.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bound_batches

DIMENSIONS = 1024
#: Languages are at most this many, so prototypes have a bounded size.
MOST_LANGUAGES = 2000
#: Trigram vectors kept in a task; beyond it they are drawn anew.
MOST_TRIGRAMS = 60_000
#: Letters of a text, and trigrams, worked on at once.
PIECE, SLICE = 1_000_000, 2048


@cache
def _letters() -> np.ndarray:
    table = np.zeros(sys.maxunicode + 2, dtype=bool)
    for i in range(sys.maxunicode + 1):
        table[i] = chr(i).isalpha()
    return table


class Encoder:
    """Profiles of texts; draws and keeps the vectors of letters and trigrams."""

    def __init__(self, dimensions: int = DIMENSIONS):
        self.d = dimensions
        self.letters: dict[int, np.ndarray] = {}
        self.reset()

    def reset(self) -> None:
        self.codes = np.empty(0, dtype=np.int64)
        self.rows = np.empty(0, dtype=np.int64)
        self.matrix = np.empty((0, self.d), dtype=np.int8)

    def letter(self, code: int) -> np.ndarray:
        if code not in self.letters:
            self.letters[code] = np.random.Generator(np.random.Philox(key=code + 1)).integers(0, 2, self.d, dtype=np.int8) * 2 - 1
        return self.letters[code]

    def bind(self, codes: np.ndarray) -> np.ndarray:
        """Vectors of trigrams, given as three code points of 21 bits."""
        out = np.ones((len(codes), self.d), dtype=np.int8)
        for shift, turn in ((42, 2), (21, 1), (0, 0)):
            own, back = np.unique((codes >> shift) & 0x1FFFFF, return_inverse=True)
            out *= np.stack([np.roll(self.letter(int(c)), turn) for c in own])[back]
        return out

    def know(self, codes: np.ndarray) -> None:
        new = np.setdiff1d(codes, self.codes, assume_unique=True)
        if not len(new):
            return
        if len(self.codes) + len(new) > MOST_TRIGRAMS:
            self.reset()
            new = codes
        had = len(self.codes)
        if had + len(new) > len(self.matrix):
            grown = np.empty((min(MOST_TRIGRAMS, max(1024, 2 * len(self.matrix), had + len(new))), self.d), np.int8)
            grown[:had] = self.matrix[:had]
            self.matrix = grown
        for at in range(0, len(new), SLICE):
            own = new[at : at + SLICE]
            self.matrix[had + at : had + at + len(own)] = self.bind(own)
        where = np.concatenate([self.codes, new])
        order = np.argsort(where, kind="stable")
        rows = np.concatenate([self.rows, np.arange(had, had + len(new))])
        self.codes, self.rows = where[order], rows[order]

    def trigrams(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Codes and counts. Long texts go by pieces, which changes nothing: each goes on from the last one's last two letters."""
        codes, counts = [], []
        text = f" {text.lower()} "
        tail, before = np.empty(0, np.int64), True
        for at in range(0, len(text), PIECE):
            points = np.frombuffer(text[at : at + PIECE].encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.int64)
            letter = _letters()[points]
            keep = letter | np.r_[before, letter[:-1]]
            before = bool(letter[-1])
            points = np.r_[tail, np.where(letter, points, 32)[keep]]
            tail = points[-2:]
            if len(points) >= 3:
                c, n = np.unique((points[:-2] << 42) | (points[1:-1] << 21) | points[2:], return_counts=True)
                codes.append(c)
                counts.append(n)
        if len(codes) == 1:
            return codes[0], counts[0]
        if not codes:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        c, back = np.unique(np.concatenate(codes), return_inverse=True)
        return c, np.bincount(back, np.concatenate(counts)).astype(np.int64)

    def profile(self, text: str | None) -> np.ndarray | None:
        """Of DIMENSIONS sums; None without letters."""
        if not text:
            return None
        codes, counts = self.trigrams(text)
        if not len(codes):
            return None
        out = np.zeros(self.d, dtype=np.float64)
        for at in range(0, len(codes), SLICE):
            c = codes[at : at + SLICE]
            self.know(c)
            vectors = self.matrix[self.rows[np.searchsorted(self.codes, c)]]
            out += counts[at : at + len(c)].astype(np.float32) @ vectors.astype(np.float32)
        return out


def train(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang", dimensions: int = DIMENSIONS) -> dict[str, np.ndarray]:
    """Prototypes by language. Each task bundles all its texts, so what meets is one vector a task and language."""

    def bundle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, sums = Encoder(dimensions), {}
        for b in batches:
            for text, lang in zip(b[0].to_pylist(), b[1].to_pylist(), strict=True):
                if (p := encoder.profile(text)) is not None:
                    sums[lang] = sums.get(lang, 0) + p
        for lang, v in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([lang] * dimensions, pa.string()), pa.array(np.arange(dimensions, dtype=np.int32)), pa.array(v)], names=["lang", "i", "v"])

    rows = labelled.where(F.col(lang_col).isNotNull()).select(text_col, lang_col)
    parts = rows.mapInArrow(bundle, "lang string, i int, v double").groupBy("lang", "i").agg(F.sum("v").alias("v"))
    vectors = parts.groupBy("lang").agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "v"))), lambda x: x["v"]).alias("v"))
    found = vectors.limit(MOST_LANGUAGES + 1).collect()
    if len(found) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    return {r["lang"]: np.array(r["v"]) for r in sorted(found, key=lambda r: r["lang"])}


def predict(docs: DataFrame, prototypes: dict[str, np.ndarray], text_col: str = "text", dimensions: int = DIMENSIONS) -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score`` (cosine, 0 if negative), which replace columns of these names."""
    names = list(prototypes)
    units = np.stack([v / max(np.linalg.norm(v), 1e-12) for v in prototypes.values()]) if names else np.zeros((0, dimensions))
    kept = docs.drop("lang_pred", "score")
    place = kept.columns.index(text_col)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(dimensions)
        for b in batches:
            langs, scores = [], []
            for text in b[place].to_pylist():
                p = encoder.profile(text)
                if p is None or not names:
                    langs.append("und")
                    scores.append(0.0)
                    continue
                cosines = units @ p / max(np.linalg.norm(p), 1e-12)
                best = int(np.argmax(cosines))
                langs.append(names[best])
                scores.append(float(min(1.0, max(0.0, cosines[best]))))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=[*b.schema.names, "lang_pred", "score"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields)
    return kept.mapInArrow(judge, f"{fields}, lang_pred string, score double")


def held_out(doc_id: Column) -> Column:
    """The fold that no training reads."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def identify(docs: DataFrame, labelled: DataFrame | None = None) -> DataFrame:
    """Train on the labelled rows outside the held-out fold (of ``docs`` itself, as a rule), then predict all of ``docs``."""
    bound_batches(docs.sparkSession)
    source = docs if labelled is None else labelled
    return predict(docs, train(source.where(~held_out(F.col("doc_id")))))


def op6_language_id(spark, sf_dir):
    from .common import table

    docs = table(spark, sf_dir, "documents")
    found = identify(docs.select("doc_id", "text"), docs.select("doc_id", "text", "lang"))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
