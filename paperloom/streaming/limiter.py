"""Rate limiters as stateful streams: one short state per key."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from paperloom import kernels


def limit_stream(events: DataFrame, decide: Callable, *, key: str, order: str, clock: str) -> DataFrame:
    """Flag every event of a stream as admitted or not.

    Within a micro-batch the rows of a key are decided in clock order; across
    batches the state carries on.  Rows of one key must arrive in order between
    batches, as requests do.
    """
    schema = f"{order} {events.schema[order].dataType.simpleString()}, admitted boolean"
    return events.select(key, order, clock).groupBy(key).applyInPandasWithState(
        kernels.limiter_step(order, clock, decide), schema, "log array<double>", "append", "NoTimeout"
    )


def sliding_log_stream(events: DataFrame, limit: int, window: float, **columns: str) -> DataFrame:
    return limit_stream(events, kernels.SlidingLog(limit, window), **columns)


def fixed_window_stream(events: DataFrame, limit: int, window: float, **columns: str) -> DataFrame:
    return limit_stream(events, kernels.FixedWindow(limit, window), **columns)
