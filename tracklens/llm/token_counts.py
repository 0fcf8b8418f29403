"""Token counts of whole documents."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracklens.llm.common import on_workers
from tracklens.llm.tokens import encoder, tokenizer_path

LIMIT = 512
#: Texts that are held as Python strings at once.
BATCH = 256


def token_counts(
    docs: DataFrame, key: str = "doc_id", text: str = "text", tokenizer: str | None = None, limit: int = LIMIT
) -> DataFrame:
    """``key, n_bytes, n_tokens, over_limit`` of every row, in one narrow pass.

    Texts of more than ``tokens.HUGE_BYTES`` bytes are encoded as overlapping chunks that
    are spliced at stable boundaries (:meth:`TextEncoder.count_by_overlap`); shorter ones at once.
    Either way the count is the library's for the whole text: no special tokens are added, strings
    of special tokens inside a text are handled as the library does by default, nothing is cut.

    Null texts count as empty: 0 bytes, 0 tokens. Null keys and repeated rows are kept as they
    are. Other columns are ignored, whatever their names; an empty table gives an empty result.
    """
    path = tokenizer or tokenizer_path()
    on_workers(docs.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for batch in (b.slice(at, BATCH) for b in batches for at in range(0, b.num_rows, BATCH)):
            texts = batch.column(1)
            sizes = pc.cast(pc.binary_length(texts), pa.int64())
            counts = [enc.count(t, n) for t, n in zip(texts.to_pylist(), sizes.to_pylist())]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), sizes, pa.array(counts, pa.int64())],
                names=["id", "n_bytes", "n_tokens"],
            )

    rows = docs.select(F.col(key).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(count, f"id {kind}, n_bytes bigint, n_tokens bigint").select(
        F.col("id").alias(key), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
