"""Documents that arrive in a folder, into the store."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from payspark.operators.dispatch import DEFAULT, Registry
from payspark.operators.ingest import ingest_batch
from payspark.sources.store import MANY_PARTS, DocumentStore

ARRIVING = T.StructType([T.StructField("filename", T.StringType()), T.StructField("text", T.StringType())])


def arriving(spark: SparkSession, folder: str, files_per_trigger: int = 1000) -> DataFrame:
    """Extracted texts (filename, text) from Parquet files as they appear."""
    return spark.readStream.schema(ARRIVING).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def ingest_stream(documents: DataFrame, store: DocumentStore, checkpoint: str, registry: Registry = DEFAULT) -> StreamingQuery:
    """Insert each micro-batch.

    The store skips ids that it has, so a batch that is repeated after a
    failure changes nothing. Its small parts are folded into one when there
    are many. Stops when all that is there is done.
    """

    def insert(batch: DataFrame, number: int) -> None:
        ingest_batch(batch, store, registry=registry)
        if not store.in_memory and len(store.version().parts) >= MANY_PARTS:
            store.compact()

    return documents.writeStream.foreachBatch(insert).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
