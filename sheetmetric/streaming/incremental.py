"""The incremental operator deployed on a directory of interchange documents."""
from __future__ import annotations

from typing import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from sheetmetric.sources.readers import BROKEN, DOCUMENT, broken_documents, flatten_cio

Handler = Callable[[DataFrame, int], None]


def process_new_documents(spark: SparkSession, directory: str, state: str, handle: Handler, broken: Handler, lines: bool = True) -> StreamingQuery:
    """Hands what is in files not seen before to ``handle(entities, batch)`` and ``broken(documents, batch)``, and stops.

    A file holds a document on each line (as ``write_cio`` leaves them), or one in all if ``lines`` is false. Documents
    that cannot be read go to ``broken`` with their file and text. The stream's own checkpoint below
    ``state`` is the manifest: a restart goes on where the last run ended, whatever executors were lost. A batch that was
    cut short comes again under its number, so handlers that write should overwrite what they wrote for that number.
    """
    documents = (spark.readStream.schema(DOCUMENT).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", BROKEN).option("multiLine", not lines)
                 .json(directory).withColumn("file", F.input_file_name()))

    def deal(batch: DataFrame, n: int) -> None:
        batch.persist()                 # parsed once for both
        try:
            handle(flatten_cio(batch.where(F.col(BROKEN).isNull())), n)
            broken(broken_documents(batch), n)
        finally:
            batch.unpersist()

    return documents.writeStream.foreachBatch(deal).option("checkpointLocation", state).trigger(availableNow=True).start()
