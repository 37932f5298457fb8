"""New texts are indexed as they arrive: texts don't depend on each other, so every micro-batch is a batch of its own."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..operators import local
from ..sources.corpus import from_strings


def index_stream(texts: DataFrame, doc_id: str, text: str, out: str, checkpoint: str, index=local.lz_encoded, once: bool = True) -> StreamingQuery:
    """Start a query that writes index(corpus) of the new rows of a streaming frame as Parquet to `out`.

    The file sink and the checkpoint make each row count once, also when a batch is repeated. With `once` the
    query takes what there is and ends.
    """
    made = index(from_strings(texts, doc_id, text))
    writer = made.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append")
    return (writer.trigger(availableNow=True) if once else writer).start()
