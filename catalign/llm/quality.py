"""Repetition rules: characters inside duplicated n-grams and lines, by rolling hashes in numpy.

The texts of a task are laid end to end as UTF-8. Each byte maps to a random
64-bit number; running sums of these numbers times powers of an odd base give the
hash of any word or line as a difference of two sums. The hashes of the words are
rolled once more over windows of several lengths. Windows of a text that are equal
stand together after a sort; all words of a window found twice or more count as
repeated, its first place included. Coverage is the share of word characters
inside them.

Verdict: a text is kept if the base rules hold, and the coverage of no n-gram
length and of duplicated lines is above its limit. Limits are wide: they are meant
for texts that mostly repeat themselves.

Edge cases: a null text has no words and fails. Text that is white space alone has
no words and no lines that count.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import text_chunks
from .text_scan import TEXT_CODE, Scan

#: Characters that count as symbols, and the base rules.
SYMBOLS = b"#*$%&|<>"
WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
#: N-gram lengths of the method, and the largest share of word characters inside repeated ones.
NGRAMS = {4: 0.6, 6: 0.5, 12: 0.4}
MAX_LINE_SHARE = 0.5


def repeated(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which keys occur twice or more, and which equal an earlier one."""
    order = np.argsort(keys, kind="stable")
    ranked = keys[order]
    same = ranked[1:] == ranked[:-1]
    later = np.concatenate([[False], same])
    any_ = later | np.concatenate([same, [False]])
    out, again = np.empty(len(keys), bool), np.empty(len(keys), bool)
    out[order], again[order] = any_, later
    return out, again


def measure(texts: list[str], lengths: list[int]) -> dict[str, np.ndarray]:
    """Figures of each text; ``cover_n`` for each length has characters inside repeated windows of n words."""
    scan = Scan(texts)
    count, data, offsets, chars, rolling = len(texts), scan.data, scan.offsets, scan.chars, scan.rolling
    begin, end, owner, n_words = scan.begin, scan.end, scan.owner, scan.n_words
    symbols = np.concatenate([[0], np.cumsum(np.isin(data, np.frombuffer(SYMBOLS, np.uint8)))])
    over_words = scan.over_words
    word_chars = chars[end] - chars[begin]
    text_code = np.arange(count, dtype=np.uint64) * TEXT_CODE
    out = {"n_words": n_words, "word_chars": np.diff(chars[offsets]), "n_symbols": np.diff(symbols[offsets])}

    def in_repeats(n: int) -> np.ndarray:
        at = np.arange(max(0, len(begin) - n + 1))
        at = at[owner[at] == owner[at + n - 1]]
        twice, _ = repeated(over_words.of(at, at + n) + text_code[owner[at]])
        delta = np.zeros(len(begin) + 1, np.int64)
        np.add.at(delta, at[twice], 1)
        np.add.at(delta, at[twice] + n, -1)
        return np.cumsum(delta[:-1]) > 0

    def per_text(values: np.ndarray, owners: np.ndarray) -> np.ndarray:
        return np.bincount(owners, weights=values, minlength=count).astype(np.int64)

    out["n_repeat_words"] = per_text(in_repeats(WINDOW), owner)
    for n in lengths:
        out[f"cover_{n}"] = per_text(np.where(in_repeats(n), word_chars, 0), owner)

    # Lines: between line feeds and the ends of texts; only those with a word count.
    feeds = np.flatnonzero(data == 10)
    line_begin = np.sort(np.concatenate([offsets[:-1], feeds + 1]))
    line_end = np.sort(np.concatenate([feeds, offsets[1:]]))
    line_text = np.searchsorted(offsets[1:], line_begin, side="right")
    # A line that begins where its text ends is empty, as are all lines of empty texts.
    full = (line_end > line_begin) & (chars[np.maximum(line_end, line_begin)] > chars[line_begin])
    line_begin, line_end, line_text = line_begin[full], line_end[full], line_text[full]
    twice, again = repeated(rolling.of(line_begin, line_end) + text_code[line_text])
    out["n_dup_lines"] = per_text(again, line_text)
    out["cover_lines"] = per_text(np.where(twice, chars[line_end] - chars[line_begin], 0), line_text)
    return out


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", ngrams: dict[int, float] = NGRAMS,
                  max_line_share: float = MAX_LINE_SHARE) -> DataFrame:
    """One row per document: doc_id, the base figures, covered characters by kind, base_failed, kept."""
    id_type = docs.schema[id_col].dataType.simpleString()
    figures = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "cover_lines", *[f"cover_{n}" for n in ngrams]]

    def run(batches):
        for part, texts in text_chunks(batches):
            m = measure(texts, list(ngrams))
            failed = (m["n_words"] < MIN_WORDS) | (100 * m["n_repeat_words"] > MAX_REPEAT_PERCENT * m["n_words"])
            good = ~failed & (m["cover_lines"] <= max_line_share * m["word_chars"])
            for n, most in ngrams.items():
                good &= m[f"cover_{n}"] <= most * m["word_chars"]
            yield pa.RecordBatch.from_arrays(
                [part.column(0), *[pa.array(m[f].astype(np.int64)) for f in figures], pa.array(failed), pa.array(good)],
                names=["doc_id", *figures, "base_failed", "kept"])

    return docs.select(docs[id_col].alias("doc_id"), docs[text_col].cast("string").alias("text")).mapInArrow(
        run, f"doc_id {id_type}, {', '.join(f + ' long' for f in figures)}, base_failed boolean, kept boolean")
