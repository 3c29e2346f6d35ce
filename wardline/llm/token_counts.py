"""Token counts by trie-shared dynamic programming.

A document's pre-tokens are its words, each behind a space mark. Every task puts the distinct
new pre-tokens of a batch (by 64-bit hash) into a trie, computes the unigram model's forward scores once per
shared prefix (``unigram.trie_counts``), whatever a pre-token's length, and keeps the counts of the
terminals; a document's count is the sum over its words. No exchange is needed.

Cases: null and empty texts, and such without words, have 0 tokens and score 0; repeated
rows count each; other columns are not read."""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import slices
from .unigram import SPACE, trie_counts, vocabulary
from .words import text_bytes, words


#: Pre-tokens whose counts a task keeps.
_ROOM = 500_000


def token_counts(docs: DataFrame, model: str = "piece_bpe_32k.model") -> DataFrame:
    """(doc_id, n_words, n_tokens, score) of every row: score is the log probability."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(model)
        known: dict[int, tuple[int, float]] = {}  # tokens and score of the pre-tokens met, by hash
        for b in slices(batches):
            raw, off = text_bytes(b.column(1))
            h, first, end, row = words(raw, off, lower=False)
            names, one, at = np.unique(h, return_index=True, return_inverse=True)
            if len(known) > _ROOM:
                known.clear()
            text, new = raw.tobytes(), [(k, i) for k, i in zip(names.tolist(), one.tolist()) if k not in known]
            units = [SPACE + text[first[i]:end[i]].decode() for _, i in new]
            known.update(zip((k for k, _ in new), zip(*(x.tolist() for x in trie_counts(v, units)))))
            tokens, score = np.array([known[k] for k in names.tolist()]).reshape(-1, 2).T
            n = b.num_rows
            yield pa.RecordBatch.from_arrays([b.column(0), *map(pa.array, (
                np.bincount(row, minlength=n), np.bincount(row, tokens[at], n).astype(np.int64), np.bincount(row, score[at], n)))],
                ["doc_id", "n_words", "n_tokens", "score"])

    ids = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {ids}, n_words long, n_tokens long, score double")
