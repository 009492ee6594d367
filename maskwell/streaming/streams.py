"""The same scrub on streams, stateless, plus tokens and summaries per batch.

A batch of one large file has few parts; where batches are written by hand, they are spread over tasks first, which
costs a count of the batch.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import DataStreamWriter, StreamingQuery

from maskwell.operators import tokens as TK
from maskwell.operators.allow import exclude_allowed, held
from maskwell.operators.scrub import scrub_columns
from maskwell.plans.policy import Policy
from maskwell.plans.scratch import owned
from maskwell.sources.readers import spread
from maskwell.sources.writers import summary_events
from maskwell.streaming.token_store import BUCKETS, MERGE_AFTER, TokenStore


def scrub_stream(
    events: DataFrame,
    fields: Sequence[str] | str,
    policy: Policy,
    report: bool | None = None,
    allow: DataFrame | None = None,
) -> DataFrame:
    """Row by row, no state, no shuffle; runs in append mode.

    The policy, and an allowlist table, are fixed when the query is built;
    restart to change them.  See :func:`allowed_stream` for larger tables.
    """
    return scrub_columns(events, fields, policy, report, allow=None if allow is None else held(allow))


def allowed_stream(
    events: DataFrame,
    id_cols: Sequence[str] | str,
    fields: Sequence[str] | str,
    allow: Callable[[], DataFrame],
    policy: Policy,
    path: str,
    checkpoint: str,
) -> DataStreamWriter:
    """Scrub with an allowlist table of any size, read anew for each batch; a replayed batch replaces itself."""

    def write(batch: DataFrame, batch_id: int) -> None:
        with owned(batch.sparkSession):
            rows, _ = exclude_allowed(spread(batch), id_cols, fields, allow(), policy)
            rows.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return (
        events.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
    )


def summary_stream(
    events: DataFrame, fields: Sequence[str] | str, policy: Policy, path: str, checkpoint: str
) -> DataStreamWriter:
    """Scheduled scrub into a summary table: everything new, then stop.

    Each batch writes below its own id, so a replayed batch replaces itself.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        scrubbed = scrub_columns(spread(batch), fields, policy)
        summary_events(scrubbed).write.mode("overwrite").text(f"{path}/batch={batch_id}")

    return (
        events.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
    )


def stored_tokens(spark: SparkSession, path: str, before: int | None = None) -> DataFrame:
    """Tokens of all batches below a path, or of those before a batch."""
    return TokenStore(spark, path).table(before)


def token_stream(
    events: DataFrame,
    id_cols: Sequence[str] | str,
    fields: Sequence[str] | str,
    policy: Policy,
    path: str,
    checkpoint: str,
    buckets: int = BUCKETS,
    merge_after: int = MERGE_AFTER,
) -> DataStreamWriter:
    """Token style with one map carried over all batches.

    A batch continues from the tokens of earlier batches, of which it reads
    the buckets its own originals fall into, and stores its new ones under its
    own id; a replay reads the same earlier tokens and writes the same result
    again.  What it stores on the way is deleted with its end.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        store = TokenStore(spark, f"{path}/tokens", buckets, merge_after)
        with owned(spark):
            store.merge(batch_id)
            got = TK.tokenize(
                spread(batch), id_cols, fields, policy, known=lambda o: store.lookup(o, batch_id), last=store.last(batch_id)
            )
            store.add(got.tokens.where("n is not null"), batch_id)
            got.rows.write.mode("overwrite").parquet(f"{path}/rows/batch={batch_id}")

    return (
        events.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
    )


def run(writer: DataStreamWriter) -> None:
    """Start a bounded query and wait for it; its failure is raised here."""
    query: StreamingQuery = writer.start()
    query.awaitTermination()
