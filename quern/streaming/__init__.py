"""Continuous ingestion: each micro-batch of a stream becomes stripes of a dataset, once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from quern.catalog import Catalog
from quern.dataset import Dataset, write
from quern.storage import Files


def stream_into(stream: DataFrame, path: str, checkpoint: str, stripe_rows: int | None = None, catalog: Catalog | None = None, **trigger) -> StreamingQuery:
    """Starts a query that appends ``stream``'s rows to the dataset at ``path``, made by the first batch.

    The dataset's head names the last batch it holds, so a batch that Spark delivers again after a failure is not
    written twice. ``trigger`` is what ``DataStreamWriter.trigger`` takes; without it all that is there is read.
    """

    def take(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        if not Files(spark).exists(f"{path}/_dataset.json"):
            write(batch.limit(0), path, stripe_rows=stripe_rows, catalog=catalog)
        dataset = Dataset.open(spark, path, catalog)
        if dataset.options.get("mark", -1) < number:
            dataset.append(batch, mark=number)

    return stream.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
