"""Language identification by rank-order profiles.

A text's letters are lower-cased and everything else becomes a space; its 1- to
3-grams, spaces included, are ranked by frequency.  A language's profile holds
the ranks of the ``PROFILE`` most frequent n-grams of its learning documents.
The out-of-place distance of a text to a profile is the sum over its ``TOP`` most
frequent n-grams of how far their ranks are apart, ``PROFILE`` for one that the
profile does not have; the nearest language wins.
"""

from __future__ import annotations

import sys
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import fresh, quoted

PROFILE = 400
TOP = 300
UNKNOWN = "und"
#: languages whose profiles are sent to the executors; more is an error
MAX_LANGUAGES = 2_000


def letter_table() -> np.ndarray:
    """By code point: the lower-cased letter, or a space for what is none."""
    points = np.full(sys.maxunicode + 1, 32, np.uint32)
    for c in range(sys.maxunicode + 1):
        ch = chr(c)
        if ch.isalpha():
            low = ch.lower()
            points[c] = ord(low) if len(low) == 1 else c
    return points


def grams(text: str, letters: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-gram codes (21 bits a code point) and their counts; both empty
    for a text without a letter.  Runs of spaces count as one space, and the text
    starts and ends with one; n-grams of spaces alone are left out."""
    points = letters[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)]
    points = np.r_[np.uint32(32), points, np.uint32(32)].astype(np.int64)
    points = points[(points != 32) | np.r_[True, points[:-1] != 32]]
    if len(points) < 3:
        none = np.zeros(0, np.int64)
        return none, none
    two = points[:-1] << 21 | points[1:]
    three = two[:-1] << 21 | points[2:]
    return np.unique(np.concatenate([points[points != 32], two, three]), return_counts=True)


def ranked(codes: np.ndarray, counts: np.ndarray, top: int) -> np.ndarray:
    """The ``top`` most frequent codes, the most frequent first, ties by code."""
    if len(codes) > top:
        least = np.partition(counts, len(counts) - top)[len(counts) - top]
        some = counts >= least
        codes, counts = codes[some], counts[some]
    return codes[np.lexsort((codes, -counts))][:top]


@dataclass
class Profiles:
    """Per language its n-gram codes in ascending order and their ranks."""

    names: list[str]
    codes: list[np.ndarray]
    ranks: list[np.ndarray]
    size: int = PROFILE
    top: int = TOP

    def distances(self, own: np.ndarray) -> np.ndarray:
        """Out-of-place distance of ranked codes to every language, over the largest possible."""
        out, place = np.empty(len(self.names)), np.arange(len(own))
        for k, (codes, ranks) in enumerate(zip(self.codes, self.ranks)):
            at = np.minimum(np.searchsorted(codes, own), len(codes) - 1)
            away = np.where(codes[at] == own, np.minimum(np.abs(ranks[at] - place), self.size), self.size)
            out[k] = away.sum() / (self.size * len(own))
        return out

    def column(self, text: Column) -> Column:
        """``lang_pred`` and ``score`` (1 less the distance, 0 to 1) of a text."""
        model, made = self, {}

        def run(texts: pd.Series) -> pd.DataFrame:
            letters = made.setdefault("letters", None)
            if letters is None:
                letters = made["letters"] = letter_table()
            names, scores = [], []
            for text in texts:
                codes, counts = grams(text, letters) if text else ((), ())
                if not len(codes) or not model.names:
                    names.append(UNKNOWN)
                    scores.append(0.0)
                    continue
                far = model.distances(ranked(codes, counts, model.top))
                best = int(far.argmin())
                names.append(model.names[best])
                scores.append(1.0 - float(far[best]))
            return pd.DataFrame({"lang_pred": names, "score": scores})

        return F.pandas_udf(run, "lang_pred string, score double")(text)


def learn(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", size: int = PROFILE, top: int = TOP) -> Profiles:
    """Profiles of all rows of ``docs`` with a text and a language: n-grams are
    counted per task, summed per language, and each language's most frequent
    ``size`` kept.  Without such a row there is no language to predict."""

    def run(batches):
        letters = letter_table()
        for batch in batches:
            by: dict[str, list] = {}
            for text, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                by.setdefault(lang, []).append(grams(text, letters))
            for lang, found in by.items():
                codes, place = np.unique(np.concatenate([c for c, _ in found]), return_inverse=True)
                n = np.bincount(place, np.concatenate([n for _, n in found])).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(codes), pa.string()), pa.array(codes), pa.array(n)], ["lang", "code", "n"])

    rows = docs.select(quoted(text_col).alias("text"), quoted(lang_col).alias("lang")).where("text IS NOT NULL AND lang IS NOT NULL")
    counted = rows.mapInArrow(run, "lang string, code long, n long").groupBy("lang", "code").agg(F.sum("n").alias("n"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "code"))
    # compared as it is, so that tasks keep their best only before the shuffle
    kept = counted.withColumn("place", place).where(F.col("place") <= size).select("lang", "code", (F.col("place") - 1).alias("place")).limit(MAX_LANGUAGES * size + 1).collect()
    by: dict[str, list[tuple[int, int]]] = {}
    for r in kept:
        by.setdefault(r["lang"], []).append((r["code"], r["place"]))
    if len(kept) > MAX_LANGUAGES * size:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    names = sorted(by)
    tables = [np.array(sorted(by[n]), np.int64) for n in names]
    return Profiles(names, [t[:, 0].copy() for t in tables], [t[:, 1].copy() for t in tables], size, top)


def held_out(doc_id: Column) -> Column:
    """crc32 of the id's digits leaves 2 when divided by 4; a null id is held out."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(True))


def predict(docs: DataFrame, profiles: Profiles, text_col: str = "text", out: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """``docs`` with the predicted language and its score.

    ``und`` and 0 for a null text or one without a letter; of languages at equal
    distance the first by name wins.  Other columns are kept as they are."""
    made = fresh(docs, "language")
    held = docs.withColumn(made, profiles.column(quoted(text_col)))
    return held.withColumns({out[0]: held[made]["lang_pred"], out[1]: held[made]["score"]}).drop(made)
