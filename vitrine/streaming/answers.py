"""Answering a stream of questions with Structured Streaming."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, functions as F


def stream_answers(
    questions: DataFrame,
    answer: Callable[[DataFrame], DataFrame],
    output: str,
    checkpoint: str,
    available_now: bool = True,
):
    """Start a query that answers each micro-batch of ``questions`` and stores it.

    ``answer`` is any batch operator, for instance ``answer_batch`` bound to
    its catalog, documents and index.  Ranking windows need a whole batch, so
    it runs inside ``foreachBatch``.  Each batch owns the folder
    ``batch_id=<n>``; a replay after a failure overwrites that folder, and the
    checkpoint remembers finished batches, so each question is stored once.
    """

    def store(batch: DataFrame, batch_id: int) -> None:
        answers = answer(batch)
        answers.write.mode("overwrite").parquet(f"{output}/batch_id={batch_id}")

    writer = questions.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def accepted_requests(requests: DataFrame) -> DataFrame:
    """Stream-safe request check: rows without a query do not go on."""
    return requests.filter(F.col("query").isNotNull())
