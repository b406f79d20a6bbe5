"""Token counts of whole texts by the whole-token shortcut (see bpe.WordCounter)."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from . import bpe


def token_counts(docs: DataFrame, tokenizer: str, limit: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of ``docs``: its id, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > ``limit``).

    ``tokenizer`` is the path of a word-end BPE vocabulary, present on every executor. One pass, no shuffle: the
    proof which of the vocabulary's strings are whole tokens is made once, on the driver, and broadcast (its size is the vocabulary's). Null and empty texts have
    0 bytes and 0 tokens; repeated rows are counted each; an empty table gives no rows; columns other than the
    two named are not read. Texts are taken whole, however long.
    """

    proved = docs.sparkSession.sparkContext.broadcast(bpe.word_counter(tokenizer).single)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = bpe.word_counter(tokenizer, proved.value)
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            tokens = [counter.count(t) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([len(t.encode()) for t in texts], pa.int64()),
                    pa.array(tokens, pa.int64()),
                    pa.array([n > limit for n in tokens], pa.bool_()),
                ],
                ["_id", "n_bytes", "n_tokens", "over_limit"],
            )

    kind = docs.schema[id_col].dataType.simpleString()
    out = docs.select(docs[id_col].alias("_id"), docs[text_col].alias("_text")).mapInArrow(
        run, f"_id {kind}, n_bytes long, n_tokens long, over_limit boolean"
    )
    return out.withColumnRenamed("_id", id_col)
