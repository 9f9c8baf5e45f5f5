"""Live figures of running streams: state size, watermark and rates."""

from __future__ import annotations

from collections import deque
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener


def counted(rows: DataFrame, name: str, **counters: Column) -> DataFrame:
    """Count conditions while the rows pass by; the figures show up in the query progress."""
    return rows.observe(name, *[F.count_if(c).alias(n) for n, c in counters.items()])


class ProgressLog(StreamingQueryListener):
    """Keeps the newest figures of each micro-batch (a bounded number of them)."""

    def __init__(self, keep: int = 1000):
        self.entries: deque[dict] = deque(maxlen=keep)

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        p = event.progress
        times = p.eventTime or {}
        self.entries.append(
            {
                "query": p.name or str(p.id),
                "batch": p.batchId,
                "rows": p.numInputRows,
                "rows_per_second": p.processedRowsPerSecond,
                "state_rows": sum(s.numRowsTotal for s in p.stateOperators),
                "dropped_late": sum(s.numRowsDroppedByWatermark for s in p.stateOperators),
                "watermark_lag_ms": watermark_lag_ms(times),
                "observed": {k: v.asDict() for k, v in (p.observedMetrics or {}).items()},
            }
        )


def watermark_lag_ms(times: dict) -> int | None:
    """Newest event time of the batch minus the watermark; None while there is no watermark."""
    if "watermark" not in times or "max" not in times:
        return None

    def ms(text: str) -> int:
        return int(datetime.fromisoformat(text).timestamp() * 1000)

    return ms(times["max"]) - ms(times["watermark"])
