"""Language identification with language-bitmask n-gram filters.

A filter is a Bloom filter cut into slices by language: each slot is a bitmask
with one bit per language. An n-gram of a language sets that language's bit in a
few slots; the masks of an n-gram's slots, ANDed, tell all languages that may
contain it in one lookup. For a text the bits are counted per language over all
its n-grams. A share of these hits is false: with a fill of f and k slots a bit is
set by chance in f**k of the lookups, so hits become
(hits - n * f**k) / (1 - f**k). The largest corrected count decides.

Fitting reads labelled rows, at most about ``per_language`` of each language
(chosen by a hash of the id), and keeps the ``grams`` most frequent n-grams of
each length and language. What reaches the driver is these n-grams. Statistics of
the languages' sizes cover all labelled rows.

Edge cases: ``und`` with score 0 if the text is null or has no letter, or if
nothing was learned. A text whose n-grams are in no language gets the language
with most labelled rows and score 0. Ties go to that order as well.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from .common import SMALL_SLICE, lean, text_chunks

UNDETERMINED = "und"
LENGTHS = (2, 3, 4)
PER_LANGUAGE = 4_000
GRAMS = 2_000
SLOTS = 1 << 18
HASHES = 3
#: A text of which less than this share of n-grams is in any language is no prose.
MIN_SHARE = 0.05

_CODE = np.uint64(0x9E3779B97F4A7C15)
_LETTERS: list[np.ndarray] = []


def letter_table() -> np.ndarray:
    """Whether each code point is a letter."""
    if not _LETTERS:
        _LETTERS.append(np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000))
    return _LETTERS[0]


def ngram_codes(texts: list[str], lengths: tuple[int, ...] = LENGTHS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each length the codes of all n-grams and the text of each. Runs of other characters than letters are one blank."""
    lowered = [" " + t.lower() + " " for t in texts]
    codes = np.frombuffer("".join(lowered).encode("utf-32-le", "surrogatepass"), np.uint32)
    owner = np.repeat(np.arange(len(texts)), [len(t) for t in lowered])
    letter = letter_table()[codes]
    keep = letter | np.concatenate([[True], letter[:-1] | (owner[1:] != owner[:-1])])[:len(letter)]
    codes, owner = np.where(letter, codes, 32)[keep].astype(np.uint64), owner[keep]
    for n in lengths:
        size = max(0, len(codes) - n + 1)
        h = np.zeros(size, np.uint64)
        for j in range(n):
            h = (h + codes[j:j + size] + np.uint64(1)) * _CODE
            h ^= h >> np.uint64(29)
        inside = owner[:size] == owner[n - 1:n - 1 + size]
        yield (h + np.uint64(n))[inside], owner[:size][inside]


def slots_of(codes: np.ndarray) -> list[np.ndarray]:
    return [(codes * np.uint64(m) >> np.uint64(64 - SLOTS.bit_length() + 1)).astype(np.int64)
            for m in (0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53)[:HASHES]]


@dataclass
class LanguageFilter:
    """Languages, most frequent first; ``masks`` has a row of 64-bit words for each slot."""
    languages: list[str]
    masks: np.ndarray
    chance: np.ndarray

    @classmethod
    def of(cls, languages: list[str], grams: list[tuple[str, int]]) -> LanguageFilter:
        bit = {name: n for n, name in enumerate(languages)}
        masks = np.zeros((SLOTS, max(1, -(-len(languages) // 64))), np.uint64)
        which = np.array([bit[name] for name, _ in grams], np.int64)
        codes = np.array([c for _, c in grams], np.int64).view(np.uint64)
        for slot in slots_of(codes):
            np.bitwise_or.at(masks, (slot, which // 64), np.uint64(1) << (which % 64).astype(np.uint64))
        fill = np.array([(masks[:, n // 64] >> np.uint64(n % 64) & np.uint64(1)).mean() for n in range(len(languages))])
        return cls(languages, masks, fill ** HASHES)

    def judge(self, texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language, score and share of known n-grams of each text."""
        hits, total = np.zeros((len(self.languages), len(texts))), np.zeros(len(texts))
        for codes, owner in ngram_codes(texts):
            mask = np.full((len(codes), self.masks.shape[1]), ~np.uint64(0))
            for slot in slots_of(codes):
                mask &= self.masks[slot]
            total += np.bincount(owner, minlength=len(texts))
            for n in range(len(self.languages)):
                found = (mask[:, n // 64] >> np.uint64(n % 64)) & np.uint64(1)
                hits[n] += np.bincount(owner, weights=found, minlength=len(texts))
        chance = self.chance[:, None]
        known = np.maximum(0, (hits - total * chance) / np.maximum(1 - chance, 1e-9))
        readable = np.array([has_letter(t) for t in texts], bool)
        if not len(self.languages):
            return [UNDETERMINED] * len(texts), np.zeros(len(texts)), np.zeros(len(texts))
        best = known.argmax(0)
        top = known[best, np.arange(len(texts))]
        score = np.where(readable & (top > 0), top / np.maximum(known.sum(0), 1e-9), 0.0)
        share = np.where(readable, np.minimum(1.0, top / np.maximum(total, 1)), 0.0)
        return [self.languages[b] if ok else UNDETERMINED for b, ok in zip(best, readable)], score, share


def has_letter(text: str) -> bool:
    return any(m[0].isalpha() for m in re.finditer(r"[^\W\d_]", text))


def fit(rows: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
        per_language: int = PER_LANGUAGE, grams: int = GRAMS) -> LanguageFilter:
    """Learn from the labelled ones of ``rows``."""
    rows = rows.select(rows[id_col].alias("doc_id"), rows[lang_col].cast("string").alias("lang"),
                       rows[text_col].cast("string").alias("text")).filter("lang IS NOT NULL AND text IS NOT NULL")
    sizes = rows.groupBy("lang").count().collect()  # one number per language
    if not sizes:
        return LanguageFilter.of([], [])
    languages = [r["lang"] for r in sorted(sizes, key=lambda r: (-r["count"], r["lang"]))]
    share = F.create_map(*[x for r in sizes for x in (F.lit(r["lang"]), F.lit(min(1.0, per_language / r["count"])))])
    chosen = rows.filter(F.pmod(F.xxhash64(F.lit("fit-1"), "doc_id"), F.lit(1_000_000)) < F.element_at(share, F.col("lang")) * 1_000_000)

    @lean
    def count(batches):
        for part, texts in text_chunks(batches, SMALL_SLICE):
            labels = np.array(part.column(0).to_pylist(), object)
            for n, (codes, owner) in zip(LENGTHS, ngram_codes(texts)):
                for name in set(labels):
                    found, held = np.unique(codes[(labels == name)[owner]], return_counts=True)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([name] * len(found), pa.string()), pa.array([n] * len(found), pa.int32()),
                         pa.array(found.view(np.int64)), pa.array(held.astype(np.int64))], names=["lang", "n", "code", "held"])

    counted = chosen.select("lang", "text").mapInArrow(count, "lang string, n int, code long, held long").groupBy(
        "lang", "n", "code").agg(F.sum("held").alias("held"))
    top = counted.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "n").orderBy(F.desc("held"), "code")))
    return LanguageFilter.of(languages, [(r["lang"], r["code"]) for r in top.filter(F.col("rank") <= grams).select("lang", "code").collect()])


def is_held_out(id_col):
    """Whether a document is kept from fitting: the CRC-32 of its id as text is a multiple of 5."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))) % 5 == 0


def identify(docs: DataFrame, known: LanguageFilter, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, lang_pred, score, share."""
    id_type = docs.schema[id_col].dataType.simpleString()
    sent = docs.sparkSession.sparkContext.broadcast(known)  # of fixed size

    @lean
    def run(batches):
        for part, texts in text_chunks(batches, SMALL_SLICE):
            names, score, share = sent.value.judge(texts)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(names, pa.string()), pa.array(score), pa.array(share)],
                                             names=["doc_id", "lang_pred", "score", "share"])

    return docs.select(docs[id_col].alias("doc_id"), docs[text_col].cast("string").alias("text")).mapInArrow(
        run, f"doc_id {id_type}, lang_pred string, score double, share double")


def keep_identified(docs: DataFrame, known: LanguageFilter, text_col: str = "text", min_share: float = MIN_SHARE) -> DataFrame:
    """Documents with a language: letters, and n-grams that some language knows. Columns and order of rows stay."""
    sent = docs.sparkSession.sparkContext.broadcast(known)
    at = docs.columns.index(text_col)

    @lean
    def run(batches):
        for batch in batches:
            # Text goes last, for the chunks; columns come back in their place.
            for part, texts in text_chunks([
                    pa.RecordBatch.from_arrays([*batch.columns, batch.column(at)], names=[*batch.schema.names, "_text"])], SMALL_SLICE):
                names, _, share = sent.value.judge(texts)
                good = np.array([n != UNDETERMINED for n in names]) & (share >= min_share)
                yield pa.RecordBatch.from_arrays(part.columns[:-1], names=batch.schema.names).filter(pa.array(good))

    return docs.mapInArrow(run, docs.schema)
