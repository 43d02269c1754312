"""Language identification with hyperdimensional letter-trigram profiles.

Every letter has a pseudorandom vector of +1 and -1. A trigram binds its letters' vectors, permuted (rolled) by their
place, by multiplication; a text or language bundles its trigrams' vectors by addition; a text gets the language whose
prototype has the largest cosine with it.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from boxspark.llm.common import in_held_out_fold, slices

#: Slots of letters: 0 is anything else (a run counts once), 1-26 a-z, and the rest share 37 slots by code point.
SLOTS = 64
TRIGRAMS = SLOTS**3
UNKNOWN = "und"
#: Counts of (text, trigram) that are held at a time.
CELLS = 1 << 22


@lru_cache(maxsize=1)
def _slot_table() -> np.ndarray:
    table = np.zeros(0x110000, np.uint8)
    for cp in range(0x110000):
        c = chr(cp)
        if c.isalpha():
            low = ord(c.lower()[0])
            table[cp] = low - 96 if 97 <= low <= 122 else 27 + low % 37
    return table


@lru_cache(maxsize=4)
def _letters(dims: int, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    base = np.random.default_rng(seed).choice(np.array([-1, 1], np.float32), (SLOTS, dims))
    return np.roll(base, 2, axis=1), np.roll(base, 1, axis=1), base


def vectors(trigrams: np.ndarray, dims: int, seed: int) -> np.ndarray:
    first, second, third = _letters(dims, seed)
    return first[trigrams >> 12] * second[trigrams >> 6 & 63] * third[trigrams & 63]


def trigrams(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(row, trigram) of every letter of every text: the letter with what stands before and after it."""
    lengths = np.fromiter((len(t) + 2 if t else 2 for t in texts), np.int64, len(texts))
    joined = "".join(f" {t or ''} " for t in texts)
    slots = _slot_table()[np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)]
    rows = np.repeat(np.arange(len(texts), dtype=np.int32), lengths)
    keep = np.ones(len(slots), bool)
    keep[1:] = (slots[1:] != 0) | (slots[:-1] != 0)
    slots, rows = slots[keep].astype(np.int32), rows[keep]
    at = np.flatnonzero(slots)
    if not len(at):
        return rows[:0], slots[:0]
    return rows[at], slots[at - 1] << 12 | slots[at] << 6 | slots[np.minimum(at + 1, len(slots) - 1)]


def profiles(docs: DataFrame, learn: Column, text_col: str, lang_col: str) -> DataFrame:
    """(lang, trigram, n) over all rows where ``learn`` holds and the language isn't null."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] = {}

        def rows():
            for lang, n in held.items():
                some = np.flatnonzero(n)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(some), pa.string()), pa.array(some, pa.int32()), pa.array(n[some], pa.int64())], ["lang", "trigram", "n"])

        for part, texts in slices(batches, "text"):
            langs = part.column("lang").to_pylist()
            row, tri = trigrams(texts)
            names = sorted(set(langs))
            which = np.array([names.index(x) for x in langs], np.int64)[row] if len(row) else row
            for i, lang in enumerate(names):
                n = np.bincount(tri[which == i], minlength=TRIGRAMS)
                held[lang] = held[lang] + n if lang in held else n
            if len(held) > 64:  # bounded memory for any number of languages
                yield from rows()
                held.clear()
        yield from rows()

    rows = docs.where(learn & F.col(lang_col).isNotNull()).select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    return rows.mapInArrow(count, "lang string, trigram int, n bigint").groupBy("lang", "trigram").agg(F.sum("n").alias("n"))


def prototypes(counts: DataFrame, dims: int, seed: int) -> tuple[list[str], np.ndarray]:
    """(languages, unit vectors): each language bundles its trigrams; what all languages share is taken off."""

    def bundle(pdf: pd.DataFrame) -> pd.DataFrame:  # at most TRIGRAMS rows a language
        total = np.zeros(dims)
        for at in range(0, len(pdf), 4096):
            tri, n = pdf["trigram"].to_numpy()[at : at + 4096], pdf["n"].to_numpy()[at : at + 4096]
            total += n @ vectors(tri, dims, seed)
        return pd.DataFrame({"lang": [pdf["lang"].iloc[0]], "vector": [total / max(np.linalg.norm(total), 1e-12)]})

    found = sorted((r["lang"], r["vector"]) for r in counts.groupBy("lang").applyInPandas(bundle, "lang string, vector array<double>").collect())
    langs, matrix = [x for x, _ in found], np.array([v for _, v in found])
    if len(langs) > 1:
        matrix = matrix - matrix.mean(axis=0)
        matrix /= np.maximum(np.linalg.norm(matrix, axis=1, keepdims=True), 1e-12)
    return langs, matrix.astype(np.float32)


def _predicted(rows: DataFrame, text: str, keep: list[str], langs: list[str], matrix: np.ndarray, dims: int, seed: int) -> DataFrame:
    """The columns ``keep`` of ``rows`` with the language of ``text`` and its score, ``_pred`` and ``_score``: one pass,
    nothing is shuffled."""
    model = rows.sparkSession.sparkContext.broadcast((langs, matrix))  # languages x dims

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        langs, matrix = model.value
        for part, texts in slices(batches, text, 500_000):
            row, tri = trigrams(texts)
            best, score = [UNKNOWN] * len(texts), np.zeros(len(texts))
            if langs and len(row):
                seen = np.flatnonzero(np.bincount(tri, minlength=TRIGRAMS))
                place = np.zeros(TRIGRAMS, np.int64)
                place[seen] = np.arange(len(seen))
                bundles = np.zeros((len(texts), dims), np.float32)
                step = max(1, min(256, CELLS // len(seen)))
                for at in range(0, len(texts), step):
                    lo, hi = np.searchsorted(row, (at, min(at + step, len(texts))))
                    n = min(step, len(texts) - at)
                    cells = np.bincount((row[lo:hi] - at).astype(np.int64) * len(seen) + place[tri[lo:hi]], minlength=n * len(seen))
                    cells = cells.reshape(n, len(seen)).astype(np.float32)
                    for k in range(0, len(seen), 8192):
                        bundles[at : at + n] += cells[:, k : k + 8192] @ vectors(seen[k : k + 8192], dims, seed)
                cosine = (bundles / np.maximum(np.linalg.norm(bundles, axis=1, keepdims=True), 1e-12)) @ matrix.T
                lettered = np.zeros(len(texts), bool)
                lettered[row] = True
                top = cosine.argmax(axis=1)
                best = [langs[k] if ok else UNKNOWN for k, ok in zip(top.tolist(), lettered.tolist())]
                score = np.where(lettered, np.clip(cosine.max(axis=1), 0, 1), 0).astype(float)
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), pa.array(best, pa.string()), pa.array(score, pa.float64())], schema.names)

    schema = T.StructType([*(rows.schema[c] for c in keep), T.StructField("_pred", T.StringType()), T.StructField("_score", T.DoubleType())])
    return rows.mapInArrow(predict, schema)


def _learned(docs: DataFrame, id_col: str, text_col: str, lang_col: str, learn: Column | None, dims: int, seed: int) -> tuple[list[str], np.ndarray]:
    return prototypes(profiles(docs, ~in_held_out_fold(id_col) if learn is None else learn, text_col, lang_col), dims, seed)


def identify(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", learn: Column | None = None,
    dims: int = 512, seed: int = 11,
) -> DataFrame:
    """One row a row of ``docs``: id, held_out, lang_pred, score (the winning cosine, negative ones as 0).

    ``learn`` says which rows' languages may be learned (by default those outside the held-out fold). A text that is
    null or has no letter is "und" with score 0; so is everything when nothing could be learned. Equal cosines go to
    the language that sorts first. Whole texts count. Repeated rows each get a row; other columns are not read.
    """
    langs, matrix = _learned(docs, id_col, text_col, lang_col, learn, dims, seed)
    rows = docs.select(F.col(id_col).alias("_id"), in_held_out_fold(id_col).alias("held_out"), F.col(text_col).alias("_text"))
    found = _predicted(rows, "_text", ["_id", "held_out"], langs, matrix, dims, seed)
    return found.select(F.col("_id").alias(id_col), "held_out", F.col("_pred").alias("lang_pred"), F.col("_score").alias("score"))


def with_language(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", learn: Column | None = None, least_score: float = 0.05,
    dims: int = 512, seed: int = 11,
) -> DataFrame:
    """The rows of ``docs`` whose text has a language, with the predicted one in ``lang_col``.

    Rejected are null and empty texts, those without a letter, and those whose best cosine is under ``least_score``:
    letters that have nothing to do with a language come as near to it (1 / sqrt(dims) = 0.044). Each row is judged by
    its own text, so null and repeated ids, repeated rows and null languages are ordinary; ties go to the language that
    sorts first. Other columns keep their names and values. An empty table, or nothing to learn from, gives no row."""
    langs, matrix = _learned(docs, id_col, text_col, lang_col, learn, dims, seed)
    names = {c: f"c{i}" for i, c in enumerate(docs.columns)}
    found = _predicted(docs.select(*(F.col(c).alias(n) for c, n in names.items())), names[text_col], list(names.values()), langs, matrix, dims, seed)
    found = found.where((F.col("_pred") != UNKNOWN) & (F.col("_score") >= least_score))
    return found.select(*(F.col("_pred" if c == lang_col else n).alias(c) for c, n in names.items()))
