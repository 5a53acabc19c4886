"""The message ledger as a stream.  Late mail is never dropped, so nothing here sets a watermark on the ledger path."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from threadloom.operators.mail import TRANSITIONS, upsert


def lifecycle(events: DataFrame) -> DataFrame:
    """T6. State of every (account_id, message_key) after the events (order_no, event) that arrived; state is kept between batches."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        current, n = state.get if state.exists else ("new", 0)
        for b in batches:
            for event in b.sort_values("order_no")["event"]:
                current = TRANSITIONS.get(event, {}).get(current, current)
                n += 1
        state.update((current, n))
        yield pd.DataFrame({"account_id": [key[0]], "message_key": [key[1]], "state": [current], "n_events": [n]})

    return events.groupBy("account_id", "message_key").applyInPandasWithState(
        step, "account_id int, message_key string, state string, n_events int", "state string, n_events int", "update", GroupStateTimeout.NoTimeout
    )


def table_writer(path: str, key: list[str], order: str) -> Callable[[DataFrame, int], None]:
    """K13, K5. A foreachBatch sink: versions of a table under ``path``, each the last one with the batch's keys replaced; a batch that is
    delivered again overwrites its own version."""

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        rest = [c for c in batch.columns if c not in key]
        new = batch.groupBy(*key).agg(F.max_by(F.struct(*rest), order).alias("v")).select(*key, "v.*")
        if batch_id > 0:
            try:
                new = upsert(spark.read.parquet(f"{path}/version={batch_id - 1}"), new, key)
            except AnalysisException:
                pass
        new.write.mode("overwrite").parquet(f"{path}/version={batch_id}")

    return write


def dead_letters(parsed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """K14. Readable rows, and those to be set aside."""
    return parsed.where("error is null").drop("error"), parsed.where("error is not null")


def windowed_counts(events: DataFrame, ts: str, width: str, slide: str | None, late: str, keys: list[str]) -> DataFrame:
    """Extension: event-time windows with a watermark, for streams whose late rows may go."""
    w: Any = F.window(ts, width, slide) if slide else F.window(ts, width)
    return events.withWatermark(ts, late).groupBy(w.alias("w"), *keys).agg(F.count("*").alias("n")).select(F.col("w.start").alias("window_start"), *keys, "n")
