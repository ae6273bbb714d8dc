"""Language of a text by language-bitmask n-gram filters.

For every n-gram learned from labelled texts a bit mask says which languages have it. The masks lie in one bit-sliced
Bloom filter: a slot holds the bits of all languages, and the mask of an n-gram is the AND of its slots, so one probe
answers for all languages at once. A text's n-grams are probed, the bits of each language are counted, the counts are
corrected for the filter's false positives, and the largest decides.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetscope.llm.common import fold, stage

ORDER = 3
_SEEDS = tuple(np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93))
WORD_BITS = 62  # languages per mask word
#: The filter grows from 2**LEAST_BITS slots until the fullest language sets at most half of them, within MOST_BYTES.
LEAST_BITS, MOST_BYTES = 20, 128 << 20


def grams(text: str | None) -> np.ndarray:
    """Every 3-gram of the lower-cased whole text as one number; runs of anything but letters become one blank."""
    if not text:
        return np.zeros(0, np.int64)
    letters = "".join(ch if ch.isalpha() else " " for ch in text.lower()) if not text.isascii() else _ascii(text)
    words = letters.split()
    if not words:
        return np.zeros(0, np.int64)
    c = np.frombuffer(f" {' '.join(words)} ".encode("utf-32-le"), np.uint32).astype(np.int64)
    return (c[:-2] << 42) | (c[1:-1] << 21) | c[2:]


_KEEP = "".join(chr(i).lower() if chr(i).isalpha() else " " for i in range(128))


def _ascii(text: str) -> str:
    return text.translate(_KEEP)


def slots(g: np.ndarray, bits: int, hashes: int) -> list[np.ndarray]:
    x = g.astype(np.uint64)
    x ^= x >> np.uint64(31)
    out = []
    for s in _SEEDS[:hashes]:
        h = x * s
        h ^= h >> np.uint64(29)
        out.append((h * _SEEDS[0]) >> np.uint64(64 - bits))
    return out


@dataclass
class LanguageModel:
    languages: list[str]
    table: np.ndarray  # (slots, words) of masks
    false_rate: np.ndarray  # share of slots probes that pass by chance, per language
    bits: int
    hashes: int

    def predict(self, text: str | None) -> tuple[str, float]:
        g = grams(text)
        if not len(g) or not self.languages:
            return "und", 0.0
        where = slots(g, self.bits, self.hashes)
        counts = []
        for word in range(self.table.shape[1]):
            mask = self.table[where[0], word]
            for s in where[1:]:
                mask &= self.table[s, word]
            for bit in range(min(WORD_BITS, len(self.languages) - word * WORD_BITS)):
                counts.append(int(np.count_nonzero(mask & np.int64(1 << bit))))
        hits = np.maximum(0.0, (np.array(counts) - len(g) * self.false_rate) / np.maximum(1e-9, 1 - self.false_rate))
        best = int(hits.argmax())
        total = hits.sum()
        return self.languages[best], float(hits[best] / total) if total > 0 else 0.0


def filter_bits(most_grams: int, words: int, hashes: int) -> int:
    """Bits of the slot number for a language of ``most_grams`` n-grams and masks of so many words."""
    bits = LEAST_BITS
    while 1 - np.exp(-hashes * most_grams / (1 << bits)) > 0.5 and 8 * words * (1 << bits + 1) <= MOST_BYTES:
        bits += 1
    return bits


def learn(texts: DataFrame, bits: int | None = None, hashes: int = 3, share: float = 0.5, least: int = 3) -> LanguageModel:
    """Model from all rows of ``texts`` (text, lang). Rows without text, letters or language teach nothing.

    An n-gram belongs to a language if it is seen ``least`` times there and its rate is at least ``share`` of its
    highest rate in any language. Counts are taken over whole texts and summed per task before the shuffle. The filter
    has 2**bits slots, by default as many as ``filter_bits`` gives for the language of most n-grams (at the bound of 128 MB
    its slice fills beyond a half, and no n-gram is left out); only the slots and the languages reach the driver.
    """
    spark = texts.sparkSession

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[str, list] = {}

        def out(lang: str) -> pd.DataFrame:
            g = np.concatenate([p[0] for p in held[lang]])
            n = np.concatenate([p[1] for p in held[lang]])
            u, inverse = np.unique(g, return_inverse=True)
            held[lang] = [(u, np.bincount(inverse, n).astype(np.int64))]
            return pd.DataFrame({"lang": lang, "g": held[lang][0][0], "n": held[lang][0][1]})

        for pdf in batches:
            for lang, part in pdf.groupby("lang"):
                held.setdefault(lang, []).append(np.unique(np.concatenate([grams(t) for t in part["text"]]), return_counts=True))
                if len(held[lang]) >= 16 and len(out(lang)) > 2_000_000:
                    yield out(lang)
                    del held[lang]
        for lang in held:
            yield out(lang)

    known = texts.where("text is not null and lang is not null").select("text", "lang")
    counted = stage(known.mapInPandas(count, "lang string, g long, n long").groupBy("lang", "g").agg(F.sum("n").alias("n")), "lang-grams")
    totals = counted.groupBy("lang").agg(F.sum("n").alias("total"), F.count_if(F.col("n") >= least).alias("often"))
    sizes = {r["lang"]: r["often"] for r in totals.collect()}
    languages = sorted(sizes)
    words = max(1, -(-len(languages) // WORD_BITS))
    bits = bits or filter_bits(max(sizes.values(), default=0), words, hashes)
    table = np.zeros((1 << bits, words), np.int64)
    if not languages:
        return LanguageModel([], table, np.zeros(0), bits, hashes)
    number = spark.createDataFrame([(x, i // WORD_BITS, 1 << i % WORD_BITS) for i, x in enumerate(languages)], "lang string, word int, bit long")
    rated = counted.join(F.broadcast(totals.join(number, "lang")), "lang").selectExpr("g", "word", "bit", "n", "n / total as rate")
    best = rated.groupBy("g").agg(F.max("rate").alias("top"))
    masks = rated.join(best, "g").where(f"rate >= {share} * top and n >= {least}").groupBy("g", "word").agg(F.bit_or("bit").alias("mask"))

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for s in slots(pdf["g"].to_numpy(), bits, hashes):
                yield pd.DataFrame({"slot": s.astype(np.int64), "word": pdf["word"], "mask": pdf["mask"]})

    filled = masks.mapInPandas(place, "slot long, word int, mask long").groupBy("slot", "word").agg(F.bit_or("mask").alias("mask")).toPandas()
    table[filled["slot"], filled["word"]] = filled["mask"]
    fill = np.array([np.count_nonzero(table[:, i // WORD_BITS] & np.int64(1 << i % WORD_BITS)) / (1 << bits) for i in range(len(languages))])
    return LanguageModel(languages, table, fill**hashes, bits, hashes)


def identify_language(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every row of ``docs``; only the whole text is looked at.

    A null text, or one without a letter, is ``und`` with score 0, and so is every text under an empty model. Ties go to
    the first language by code point. Repeated rows get equal results; an empty table gives none.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def predict(text: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([shared.value.predict(t) for t in text], columns=["lang_pred", "score"])

    guess = F.pandas_udf(predict, "lang_pred string, score double")("text")
    return docs.select("doc_id", (fold(F.col("doc_id")) == 0).alias("held_out"), guess.alias("_p")).select("doc_id", "held_out", "_p.lang_pred", "_p.score")
