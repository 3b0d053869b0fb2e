"""Spelling variants: words one edit apart, found by probing generated edits against Bloom filters of the vocabulary.

1. Words are counted in the map tasks and summed; those that are long and frequent enough
   are the vocabulary.
2. Each word sets bits in one block of 512 bits of a Bloom filter, in the part that belongs
   to its length. The filter is broadcast. What is sent at a time has at most
   ``max_blocks`` blocks (64 MB); a larger filter is sent and probed in several passes, so
   its density stays the same however large the vocabulary is.
3. Every word generates its deletions, and the replacements by later letters of the
   alphabet. Hashes are sums over the letters, so an edit changes a hash in one step and
   no string is built for a probe. Insertions need none: they are deletions of the other
   word. Each pair of near words so has exactly one probe.
4. Only probes that hit become strings. They are shuffled and joined with the vocabulary,
   which takes out the false ones.
5. The form of a word is its most frequent near word, if it is frequent enough. Forms are
   at least ``ratio`` times as frequent as their word, so following them ends; all words
   follow at once, and each step doubles the length of the way.

A word has at most (letters + 1) * alphabet near words, so no group is hot; words that are
frequent are combined in the map tasks. Edge cases: a null text has no words; a null id is
written as nothing in front of the colon of ``change``. Of near words equally frequent, the
smallest in code-point order is the form.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, functions as F

from ..session import cut
from .common import text_chunks

#: Fixed value: what counts as a word.
RUN = re.compile("[A-Za-zÀ-ÿ]+")
MIN_LENGTH, MIN_COUNT, RATIO = 5, 3, 2
#: Words a map task holds before it passes its counts on.
HELD_WORDS = 1 << 18
BITS_PER_WORD, HASHES = 24, 8
MAX_BLOCKS = 1 << 20
#: Blocks in one row of a filter.
SEGMENT = 1 << 10
#: Words of this length and longer share a part of the filter.
LONGEST = 64
#: Probes held at a time.
PROBES = 1 << 20

_BASE, _M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_BACK = np.uint64(pow(int(_BASE), -1, 1 << 64))
_TURNS = np.array([(int(_M2) + 2 * k * int(_M1)) % (1 << 64) for k in range(HASHES)], np.uint64)


def count_words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_length: int = MIN_LENGTH,
                min_count: int = MIN_COUNT, change: Callable[[str, str], str] | None = None) -> DataFrame:
    """The vocabulary: word, n. Only A-Z are lower-cased. ``change`` maps (doc_id as text, word) to the word to count."""

    def run(batches):
        held: Counter[str] = Counter()
        for part, texts in text_chunks(batches):
            for doc_id, text in zip(part.column(0).to_pylist(), texts):
                found = Counter(RUN.findall(text.encode().lower().decode()))
                for word, n in found.items():
                    if change:
                        word = change(doc_id or "", word)
                    if len(word) >= min_length:
                        held[word] += n
                if len(held) > HELD_WORDS:
                    yield row(held)
                    held = Counter()
        yield row(held)

    def row(held):
        return pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], names=["word", "n"])

    found = docs.select(docs[id_col].cast("string").alias("id"), docs[text_col].cast("string").alias("text")).mapInArrow(
        run, "word string, n long")
    return found.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= min_count)


def drop_letter(doc_id: str, word: str, every: int = 97) -> str:
    """The word, without one letter if a checksum of document and word says so."""
    h = zlib.crc32(f"{doc_id}:{word}".encode())
    return word[:h % len(word)] + word[h % len(word) + 1:] if h % every == 0 else word


def letter_codes(points: np.ndarray) -> np.ndarray:
    h = (points.astype(np.uint64) + np.uint64(1)) * _BASE
    h = (h ^ (h >> np.uint64(30))) * _M1
    return h ^ (h >> np.uint64(27))


class Letters:
    """Words laid end to end as code points. The hash of a word is the sum of code * base**place."""

    def __init__(self, words: list[str]):
        self.points = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
        self.length = np.array([len(w) for w in words], np.int64)
        self.owner = np.repeat(np.arange(len(words)), self.length)
        first = np.cumsum(self.length) - self.length
        self.place = np.arange(len(self.points)) - first[self.owner]
        powers = np.full(int(self.length.max(initial=0)) + 1, _BASE)
        powers[0] = 1
        self.power = np.cumprod(powers)[self.place]
        self.term = letter_codes(self.points) * self.power
        self.upto = np.concatenate([np.zeros(1, np.uint64), np.cumsum(self.term)])
        self.first = first
        self.hash = self.upto[first + self.length] - self.upto[first]

    def deletions(self) -> tuple[np.ndarray, np.ndarray]:
        """Letters to take out, and the hashes of what is left; of equal neighbours only the first."""
        at = np.flatnonzero((self.place == 0) | (self.points != np.concatenate([self.points[:1], self.points[:-1]])))
        owner = self.owner[at]
        before = self.upto[at] - self.upto[self.first[owner]]
        return at, before + (self.hash[owner] - before - self.term[at]) * _BACK


class Filter:
    """Blocks of 512 bits; the words of each length have their own range of them."""

    def __init__(self, counts: dict[int, int], bits_per_word: int = BITS_PER_WORD):
        self.blocks = np.zeros(LONGEST + 1, np.uint64)
        for length, n in counts.items():
            self.blocks[length] = max(1, -(-n * bits_per_word // 512))
        self.total = int(self.blocks.sum())
        self.start = np.cumsum(self.blocks) - self.blocks

    def block_of(self, h: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Block of each hash, or -1 where no word has that length."""
        part = np.minimum(length, LONGEST)
        mixed = (h + length.astype(np.uint64)) * _M1
        mixed ^= mixed >> np.uint64(32)
        at = self.start[part] + ((mixed >> np.uint64(32)) * self.blocks[part] >> np.uint64(32))
        return np.where(self.blocks[part] > 0, at.astype(np.int64), -1)

    @staticmethod
    def bits(h: np.ndarray, turn: int) -> np.ndarray:
        """The bit inside its block that a hash sets in one of HASHES turns."""
        return ((h ^ (h >> np.uint64(29))) * _TURNS[turn] >> np.uint64(55)).astype(np.int64)


def build(vocabulary: DataFrame, shape: Filter, low: int, high: int) -> np.ndarray:
    """Bytes of the blocks from low to high. Each row of the shuffle is a segment's list of bits; at most 64 MB come back."""

    def bits(batches):
        for batch in batches:
            letters = Letters(batch.column("word").to_pylist())
            block = shape.block_of(letters.hash, letters.length)
            meant = np.flatnonzero((block >= low) & (block < high))
            block = block[meant] - low
            at = np.concatenate([block * 512 + shape.bits(letters.hash[meant], k) for k in range(HASHES)])
            at = np.unique(at)
            segment = at // (SEGMENT * 512)
            edge = np.flatnonzero(np.concatenate([[True], segment[1:] != segment[:-1]])[:len(at)])
            yield pa.RecordBatch.from_arrays(
                [pa.array(segment[edge], pa.int32()),
                 pa.ListArray.from_arrays(pa.array([*edge, len(at)], pa.int32()), pa.array(at % (SEGMENT * 512), pa.int32()))],
                names=["segment", "bits"])

    def join(group: pa.Table) -> pa.Table:
        held = np.zeros(SEGMENT * 512, bool)
        for chunk in group.column("bits").chunks:
            held[chunk.flatten().to_numpy()] = True
        return pa.table({"segment": group.column("segment").slice(0, 1), "held": pa.array([np.packbits(held, bitorder="little").tobytes()])})

    out = np.zeros(((high - low + SEGMENT - 1) // SEGMENT, SEGMENT * 64), np.uint8)
    for r in vocabulary.select("word").mapInArrow(bits, "segment int, bits array<int>").groupBy("segment").applyInArrow(
            join, "segment int, held binary").collect():
        out[r["segment"]] = np.frombuffer(r["held"], np.uint8)
    return out.ravel()


def hits(vocabulary: DataFrame, alphabet: np.ndarray, shape: Filter, low: int, high: int, sent: Broadcast) -> DataFrame:
    """(word, n, candidate) for each generated edit that the blocks from low to high may hold."""

    def held(h, length):
        """Which of the hashes pass."""
        block = shape.block_of(h, length)
        at = np.flatnonzero((block >= low) & (block < high))
        for turn in range(HASHES):
            bit = (block[at] - low) * 512 + shape.bits(h[at], turn)
            at = at[sent.value[bit >> 3] >> (bit & 7).astype(np.uint8) & 1 > 0]
        return at

    def run(batches):
        codes = letter_codes(alphabet)
        for batch in batches:
            words, n = batch.column("word").to_pylist(), batch.column("n")
            letters = Letters(words)
            owner, candidate = [], []
            at, h = letters.deletions()
            for j in at[held(h, letters.length[letters.owner[at]] - 1)].tolist():
                w = letters.owner[j]
                place = int(letters.place[j])
                owner.append(w)
                candidate.append(words[w][:place] + words[w][place + 1:])
            step = max(1, PROBES // max(1, len(alphabet)))
            for begin in range(0, len(letters.points), step):
                j = np.arange(begin, min(begin + step, len(letters.points)))
                letter, c = np.nonzero(alphabet[None, :] > letters.points[j][:, None])
                j = j[letter]
                w = letters.owner[j]
                h = letters.hash[w] - letters.term[j] + codes[c] * letters.power[j]
                for k in held(h, letters.length[w]).tolist():
                    word, place = words[w[k]], int(letters.place[j[k]])
                    owner.append(w[k])
                    candidate.append(word[:place] + chr(alphabet[c[k]]) + word[place + 1:])
            yield pa.RecordBatch.from_arrays(
                [batch.column("word").take(pa.array(owner, pa.int64())), n.take(pa.array(owner, pa.int64())), pa.array(candidate, pa.string())],
                names=["word", "n", "candidate"])

    return vocabulary.select("word", "n").mapInArrow(run, "word string, n long, candidate string")


def near_words(vocabulary: DataFrame, max_blocks: int = MAX_BLOCKS) -> DataFrame:
    """Pairs of words one edit apart, both ways: word, n, near, near_n. ``vocabulary`` is read several times: pass a table."""
    part = F.least(F.length("word"), F.lit(LONGEST))
    counts = {r["part"]: r["n"] for r in vocabulary.groupBy(part.alias("part")).agg(F.count("*").alias("n")).collect()}  # by length
    points = vocabulary.select(F.explode(F.split("word", "")).alias("c")).distinct().filter("c <> ''").collect()  # the alphabet
    alphabet = np.array(sorted(ord(r["c"]) for r in points), np.uint32)
    shape, found = Filter(counts), None
    for low in range(0, max(shape.total, 1), max_blocks):
        high = min(low + max_blocks, shape.total)
        sent = vocabulary.sparkSession.sparkContext.broadcast(build(vocabulary, shape, low, high))
        hit = cut(hits(vocabulary, alphabet, shape, low, high, sent))
        sent.destroy()
        found = hit if found is None else found.unionByName(hit)
    true = found.join(vocabulary.select(F.col("word").alias("candidate"), F.col("n").alias("near_n")), "candidate")
    return true.select(F.explode(F.array(
        F.struct("word", "n", F.col("candidate").alias("near"), "near_n"),
        F.struct(F.col("candidate").alias("word"), F.col("near_n").alias("n"), F.col("word").alias("near"), F.col("n").alias("near_n"))
    )).alias("pair")).select("pair.*")


def follow(forms: DataFrame) -> DataFrame:
    """(word, root) for each row (word, form): the last word that forms lead to.

    Each round doubles what a word has gone; words that have arrived are met by others but move no more.
    """
    state = cut(forms.select("word", F.col("form").alias("root"), F.lit(False).alias("arrived")))
    while not state.filter("NOT arrived").isEmpty():
        ahead = state.select(F.col("word").alias("_at"), F.col("root").alias("_next"))
        moving = state.filter("NOT arrived")
        moved = moving.join(ahead, moving["root"] == ahead["_at"], "left").select(
            "word", F.coalesce("_next", "root").alias("root"), F.col("_next").isNull().alias("arrived"))
        state = cut(moved.unionByName(state.filter("arrived")))
    return state.select("word", "root")


def variants(vocabulary: DataFrame, ratio: int = RATIO, max_blocks: int = MAX_BLOCKS) -> DataFrame:
    """One row per word of (word, n): word, n, form, root, n_near, form_n."""
    vocabulary = cut(vocabulary.select("word", "n"))
    best = near_words(vocabulary, max_blocks).groupBy("word").agg(
        F.min_by(F.struct("near", "near_n"), F.struct(-F.col("near_n"), "near")).alias("best"), F.count("*").alias("n_near"))
    rows = cut(vocabulary.join(best, "word", "left").withColumn(
        "has", F.coalesce(F.col("best.near_n") >= ratio * F.col("n"), F.lit(False))).select(
        "word", "n", F.when(F.col("has"), F.col("best.near")).alias("form"), F.when(F.col("has"), F.col("best.near_n")).alias("form_n"),
        F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near")))
    roots = follow(rows.filter("form IS NOT NULL"))
    return rows.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
