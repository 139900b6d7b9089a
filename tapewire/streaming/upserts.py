"""The upserts as streaming sinks.

Each micro-batch goes through the same merge as a batch run. The table's list of files says which
batches of a stream it holds, so one that is replayed after a failure is passed over.
"""

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from tapewire.operators.prices import usable
from tapewire.sources.tables import BUCKETS, save_news, save_prices


def stream_prices(
    incoming: DataFrame, path: str, checkpoint: str, trigger: dict | None = None
) -> StreamingQuery:
    """Keep the price table at ``path`` current with a stream of normalised prices.

    Arrivals without a price are dropped and never replace one: otherwise what is stored would hang on how the
    arrivals are cut into batches. The stream is known by its ``checkpoint``.
    """

    def merge(batch: DataFrame, batch_id: int) -> None:
        batch = usable(batch).persist()
        try:
            if not batch.isEmpty():
                save_prices(path, batch, batch=(checkpoint, batch_id))
        finally:
            batch.unpersist()

    return _start(incoming, merge, checkpoint, trigger)


def stream_news(
    incoming: DataFrame,
    path: str,
    checkpoint: str,
    trigger: dict | None = None,
    null_wins: bool = False,
    buckets: int = BUCKETS,
) -> StreamingQuery:
    """Keep the news table at ``path`` current with a stream of flat articles.

    Each micro-batch rewrites the buckets it has urls for; a table that grows large wants
    more ``buckets`` from the start.
    """

    def merge(batch: DataFrame, batch_id: int) -> None:
        batch = batch.persist()
        try:
            save_news(path, batch, null_wins, buckets, (checkpoint, batch_id))
        finally:
            batch.unpersist()

    return _start(incoming, merge, checkpoint, trigger)


def _start(incoming, merge, checkpoint, trigger) -> StreamingQuery:
    return (
        incoming.writeStream.foreachBatch(merge)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )
