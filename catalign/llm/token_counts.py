"""Token counts by a tokenizer compiled into a finite-state transducer (see ``bpe_transducer``).

The texts of a task are laid end to end and cut into chunks of one length; all
chunks advance together, their state maps are composed by a parallel prefix scan, and
the counts on the transitions are summed by a running total. Texts of any length take
the same path.

Edge cases: a null text is empty and has 0 bytes and tokens.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .bpe_transducer import load
from .common import text_chunks

LIMIT = 2048


def count_tokens(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = LIMIT) -> DataFrame:
    """One row per document: doc_id, n_bytes (UTF-8), n_tokens, over_limit. ``path`` is the vocabulary file on every node."""
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        machine = load(path)
        for part, texts in text_chunks(batches):
            counts = machine.counts(texts)
            n_bytes = np.array([len(t.encode()) for t in texts], np.int64)
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array(n_bytes), pa.array(counts), pa.array(counts > limit)],
                names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return docs.select(docs[id_col].alias("doc_id"), docs[text_col].cast("string").alias("text")).mapInArrow(
        run, f"doc_id {id_type}, n_bytes long, n_tokens long, over_limit boolean")
