"""Row-wise operators on streams: validation, scoring and text checks need no state."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from factloom.modeling.predict import predict_batch, split_valid, validate_rows
from factloom.modeling.scoring import FittedModel


def validated_stream(
    stream: DataFrame, score: Callable[[DataFrame], DataFrame], contract: DataFrame, categories: DataFrame, out: str, checkpoint: str
) -> tuple[StreamingQuery, StreamingQuery]:
    """Valid rows go through ``score`` to ``out/scored``, the others with reasons to ``out/quarantine``.

    All that has arrived is worked off and the queries end. Both sinks are written once per batch, so a
    start after a failure goes on behind the last finished batch.
    """
    valid, rejected = split_valid(validate_rows(stream, contract, categories))

    def start(df: DataFrame, name: str) -> StreamingQuery:
        return (
            df.writeStream.format("parquet")
            .option("path", f"{out}/{name}")
            .option("checkpointLocation", f"{checkpoint}/{name}")
            .trigger(availableNow=True)
            .start()
        )

    return start(score(valid), "scored"), start(rejected.drop("violations"), "quarantine")


def score_stream(
    stream: DataFrame, model: FittedModel, contract: DataFrame, categories: DataFrame, out: str, checkpoint: str
) -> tuple[StreamingQuery, StreamingQuery]:
    """The stream scored by a model."""
    return validated_stream(stream, lambda valid: predict_batch(model, valid), contract, categories, out, checkpoint)
