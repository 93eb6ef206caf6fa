"""Token counts: lengths of the ids a public tokenizer gives, nothing else.

Batches are balanced by bytes (``ChunkMemo.rounds``), and texts are split at safe boundaries, so one very long text is many
small inputs to the library. The function that runs in a task returns lengths only; ids never leave it.
"""

from __future__ import annotations

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rootloom.llm.chunk_memo import memo_for, tokenizer_path


def token_counts(docs: DataFrame, tokenizer: str = "byte_bpe_50k.json", id_col: str = "doc_id", text_col: str = "text", limit: int = 512) -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit) for each row.

    A null text counts as empty (0 bytes, 0 tokens); a null id stays null; repeated rows each give a row; an empty table
    gives no rows; other columns are not read. ``limit``: over_limit is n_tokens > limit.
    """
    path = tokenizer_path(tokenizer)

    def lengths(batches):
        memo = memo_for(path)
        for batch in batches:
            text = pc.fill_null(batch.column(1), "")
            counts = [pa.array(c) for _, c, _ in memo.rounds(text, want_ids=False)]
            n_tokens = pa.concat_arrays(counts) if counts else pa.array([], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), pc.binary_length(text).cast(pa.int64()), n_tokens], ["id", "n_bytes", "n_tokens"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    schema = T.StructType([T.StructField("id", rows.schema["id"].dataType), T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType())])
    return rows.mapInArrow(lengths, schema).select(F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
