"""Starting, draining and stopping streaming queries."""

from __future__ import annotations

from pyspark.sql.streaming import DataStreamWriter, StreamingQuery

TRIGGER_INTERVAL = "5 seconds"


def start(writer: DataStreamWriter, interval: str = TRIGGER_INTERVAL) -> StreamingQuery:
    """Run until stopped, one micro-batch per interval."""
    return writer.trigger(processingTime=interval).start()


def drain(writer: DataStreamWriter) -> StreamingQuery:
    """Process everything there is now, in as many micro-batches as the source's intake limit
    asks for, and return the finished query."""
    query = writer.trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def stop(query: StreamingQuery, grace_seconds: int = 60) -> None:
    """Let the batch in flight finish, then stop; the checkpoint resumes from there."""
    waited = 0
    while query.isActive and query.status["isTriggerActive"] and waited < grace_seconds:
        query.awaitTermination(1)
        waited += 1
    query.stop()
