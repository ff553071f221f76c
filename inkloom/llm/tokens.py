"""Problem 8: token ids of every document, and their number for other operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkloom.llm import bpe
from inkloom.session import table


def _ids(path: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches):
        encoder = bpe.encoder(path)
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for a, b in bpe.chunks(texts):
                flat, count = encoder.encode(texts[a:b])
                offsets = np.concatenate([[0], np.cumsum(count)]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat, pa.int32()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), lists], ["doc_id", "ids"])

    return run


def _counts(path: str):
    def run(batches):
        encoder = bpe.encoder(path)
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for a, b in bpe.chunks(texts):
                _, count = encoder.encode(texts[a:b])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(count, pa.int64())], ["doc_id", "n_tokens"])

    return run


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer_path: str = bpe.DEFAULT_TOKENIZER) -> DataFrame:
    """``doc_id, ids``: the token ids of each row, no special tokens added.

    A null and an empty text give an empty list, a blank text its own tokens,
    a row with a null id keeps it, and repeated rows stay repeated.  Strings of
    special tokens inside a text are ordinary text.  No shuffle.
    """
    kept = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return kept.mapInArrow(_ids(tokenizer_path), "doc_id bigint, ids array<int>")


def count_tokens(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer_path: str = bpe.DEFAULT_TOKENIZER) -> DataFrame:
    """``doc_id, n_tokens``; a null or empty text has 0."""
    kept = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return kept.mapInArrow(_counts(tokenizer_path), "doc_id bigint, n_tokens bigint")


def p8_ids(spark, sf_dir: str) -> DataFrame:
    return encode(table(spark, sf_dir, "documents"))
