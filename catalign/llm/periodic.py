"""Periodic runs: stretches of words that repeat with a fixed period, found by an online sparse diagonal DP.

Words i and i - q that are equal are a match on the diagonal of lag q; matches of
consecutive words add up, and the stretch that ends with the last of L matches has L + q
words of period q. The DP walks over the words and keeps only the diagonals that the
current word carries on: its earlier occurrences raise the match length at their lags,
and a diagonal that it does not carry on has ended, is emitted if it is long enough, and
is forgotten.

Which occurrences count. All earlier occurrences of a word are too many: their number
grows with the square of the text. A word is therefore looked up with the K - 1 words
before it, and only its latest earlier occurrence counts, for lags from K/2 to K/1.5;
levels of K cover all lags. Nothing is lost:

* a run of period q has length 3q or more, so 2q >= K matches on its diagonal, and a
  diagonal of that many matches holds a K-gram that occurs q words earlier;
* if that K-gram also occurred d < q words earlier, it would have period q and d, or q and
  q - d, one of which is at most q/2. As K >= q + q/2 it would then have a common
  divisor of both as its period, so the run would not have q as its smallest period.

For the same reason what is emitted has q as its smallest period. A word takes part in at
most one diagonal a level, so a text of n words takes n log n steps and memory of order n,
also if it is one word repeated. Only K-grams found twice at one level are looked at in
the next, so ordinary text costs one pass. K-grams are compared by 64-bit hashes.

Edge cases: a null text has no words, no runs and collapses to the empty text. Runs may
overlap. Rows are judged each by itself, whatever their ids.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import text_chunks
from .text_scan import Scan

MIN_LENGTH = 24
#: Periods that a run has at least.
REPEATS = 3

_OWNER, _SPREAD = np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x9E3779B97F4A7C15)


def levels(longest: int, min_length: int = MIN_LENGTH) -> Iterator[tuple[int, int, int]]:
    """(K, least lag, greatest lag) for texts of up to ``longest`` words."""
    size, low = 2 * min_length // 3, 1
    while REPEATS * low <= longest:
        high = 2 * size // 3
        yield size, low, high
        low = high + 1
        size = 2 * low


def earlier_occurrences(words: Scan, min_length: int = MIN_LENGTH) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each level K, words in order and the lag of the latest earlier occurrence, if it is one of the level."""
    first = (np.cumsum(words.n_words) - words.n_words)[words.owner]
    longest = words.n_words[words.owner]
    at = np.flatnonzero(longest >= min_length)
    for size, low, high in levels(int(words.n_words.max(initial=0)), min_length):
        at = at[(at - first[at] >= size - 1) & (longest[at] >= REPEATS * low)]
        if not len(at):
            return
        h = (words.over_words.of(at - size + 1, at + 1) ^ (words.owner[at].astype(np.uint64) * _OWNER)) * _SPREAD
        # Most K-grams occur once; a count by some bits of the hash spares them the sort.
        bits = max(10, int(len(at)).bit_length() + 2)
        slot = (h >> np.uint64(64 - bits)).astype(np.int64)
        again = np.bincount(slot, minlength=1 << bits)[slot] > 1
        at, h = at[again], h[again]
        order = np.argsort(h, kind="stable")
        same = h[order[1:]] == h[order[:-1]]
        lag, repeated = np.zeros(len(at), np.int64), np.zeros(len(at), bool)
        lag[order[1:][same]] = (at[order[1:]] - at[order[:-1]])[same]
        repeated[order[1:][same]] = repeated[order[:-1][same]] = True
        meant = (lag >= low) & (lag <= high)
        yield size, at[meant], lag[meant]
        at = at[repeated]


def diagonal_runs(words: Scan, min_length: int = MIN_LENGTH) -> np.ndarray:
    """Rows (first word, length, period) of all runs, words counted over all texts, in order of the first word."""
    found = [(np.full(len(at), size), at, lag) for size, at, lag in earlier_occurrences(words, min_length)]
    if not found:
        return np.zeros((0, 3), np.int64)
    size, at, lag = (np.concatenate(column) for column in zip(*found))
    order = np.argsort(at, kind="stable")
    runs: list[tuple[int, int, int]] = []
    active: dict[int, tuple[int, int]] = {}  # lag: matches so far, word of the last one

    def end(before: int) -> None:
        """Emit and forget the diagonals whose last match is earlier than the given word."""
        for q in [q for q, (_, last) in active.items() if last < before]:
            matches, last = active.pop(q)
            if matches >= max(min_length - q, (REPEATS - 1) * q):
                runs.append((last + 1 - matches - q, matches + q, q))

    for i, q, k in zip(at[order].tolist(), lag[order].tolist(), size[order].tolist()):
        end(i - 1)
        active[q] = (active[q][0] + 1 if q in active else k, i)
    end(len(words.begin))
    return np.array(sorted(runs, key=lambda r: (r[0], r[2])), np.int64).reshape(-1, 3)


def kept_words(words: Scan, runs: np.ndarray) -> np.ndarray:
    """Flags of the words that no run contains behind its first period."""
    change = np.zeros(len(words.begin) + 1, np.int64)
    np.add.at(change, runs[:, 0] + runs[:, 2], 1)
    np.add.at(change, runs[:, 0] + runs[:, 1], -1)
    return np.cumsum(change)[:-1] == 0


def find_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_length: int = MIN_LENGTH) -> DataFrame:
    """One row per document: doc_id, runs (array of start, length, period in words, by start and period), collapsed (the
    words that stay if each run keeps its first period only, joined by one space). Nothing is shuffled."""
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        for part, texts in text_chunks(batches):
            words = Scan(texts)
            runs = diagonal_runs(words, min_length)
            first = np.cumsum(words.n_words) - words.n_words
            owner = words.owner[runs[:, 0]]
            upto = np.searchsorted(owner, np.arange(len(texts) + 1))
            fields = [pa.array(c) for c in (runs[:, 0] - first[owner], runs[:, 1], runs[:, 2])]
            listed = pa.ListArray.from_arrays(
                pa.array(upto, pa.int32()), pa.StructArray.from_arrays(fields, names=["start", "length", "period"]))
            stays, collapsed = kept_words(words, runs), []
            for n, text in enumerate(texts):
                held = text.encode().split()  # at ASCII white space
                if upto[n] < upto[n + 1]:
                    held = [w for w, s in zip(held, stays[first[n]:first[n] + len(held)].tolist()) if s]
                collapsed.append(b" ".join(held).decode())
            yield pa.RecordBatch.from_arrays([part.column(0), listed, pa.array(collapsed, pa.string())],
                                             names=["doc_id", "runs", "collapsed"])

    return docs.select(docs[id_col].alias("doc_id"), docs[text_col].cast("string").alias("text")).mapInArrow(
        run, f"doc_id {id_type}, runs array<struct<start: long, length: long, period: long>>, collapsed string")
