"""Documents that arrive as files: a stream whose micro-batches are upserts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from docpool.functions.storage import materialize, scratch
from docpool.operators import transitions as tr
from docpool.service import Service

MANIFEST = "key string, series string, pos long, path string, content string"


def manifests(spark: SparkSession, folder: str) -> DataFrame:
    """The stream of manifest rows, JSON lines of MANIFEST, in a folder."""
    return spark.readStream.schema(MANIFEST).json(folder)


def ingest(service: Service, rows: DataFrame, checkpoint: str, *, once: bool = True) -> StreamingQuery:
    """Upserts every micro-batch, key by key under the key's lock.

    A batch that is delivered again changes nothing, as its contents are known then; so at-least-once delivery
    is enough. The number of keys in a batch bounds the commits, not the number of documents.
    """

    def batch(docs: DataFrame, _: int) -> None:
        with scratch():
            written = materialize(docs.select("key", "series", "pos", "path", "content").withColumn("error", F.lit(None).cast("string")), "batch")  # its source is read once
            upsert_all(written)

    def upsert_all(docs: DataFrame) -> None:
        for row in docs.select("key").where(F.col("key").isNotNull()).distinct().toLocalIterator():
            with service._changing("ingest", row.key):
                own = docs.where(F.col("key") == row.key).select("key", "series", "pos", "path", "content", "error")
                state, _outcomes = tr.upsert(service.store.state(row.key), own, service._time(), service.embedder, service.max_chunk_size)
                service.store.commit(row.key, state)

    writer = rows.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="1 minute")).start()
