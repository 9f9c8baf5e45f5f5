"""Reconciliation runs as they happened: measured, kept by run id, failed ones included."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from admeter.config import Settings
from admeter.operators import reconcile
from admeter.sources.parts import Parts

TEXT, LONG = T.StringType(), T.LongType()
RUN = T.StructType(
    [T.StructField(n, TEXT) for n in ("run_id", "status", "message")]
    + [
        T.StructField(n, LONG)
        for n in ("run_time_ms", "window_start_ms", "window_end_ms", "campaigns", "discrepancies", "auto_patched", "elapsed_ms")
    ]
    + [T.StructField("window", TEXT)]
)
RESULT = T.StructType(
    [T.StructField(n, TEXT) for n in ("run_id", "tenant_id", "campaign_id", "event_type", "reference_store", "observed_store")]
    + [T.StructField(n, LONG) for n in ("reference_count", "observed_count", "delta")]
    + [T.StructField("discrepancy_pct", T.DoubleType()), T.StructField("auto_patched", T.BooleanType()), T.StructField("window", TEXT)]
)


@dataclass(frozen=True)
class RunStore:
    spark: SparkSession
    path: str

    @property
    def _runs(self) -> Parts:
        return Parts(self.spark, f"{self.path}/runs", ("window",), RUN)

    @property
    def _results(self) -> Parts:
        return Parts(self.spark, f"{self.path}/results", ("window",), RESULT)

    def run(
        self, window: str, start_ms: int, end_ms: int, run_time_ms: int, settings: Settings, compute: Callable[[], DataFrame]
    ) -> None:
        """Compute, store the results and then the report; an error is stored as a failed run.

        A run that is done again under its id replaces what it stored before.
        """
        run_id, began = f"{window}:{run_time_ms}", time.perf_counter()

        def elapsed() -> int:
            return max(1, round((time.perf_counter() - began) * 1000))

        try:
            named = compute().withColumns({"run_id": F.lit(run_id), "window": F.lit(window)})
            self._results.add(named, run_id)
            mine = self._results.read_entries([e for e in self._results.live() if e["tag"] == run_id])
            report = reconcile.report(mine, window, start_ms, end_ms, run_time_ms, settings, elapsed())
        except Exception as error:  # a run must never take the scheduler down
            message = f"{type(error).__name__}: {str(error).splitlines()[0][:200]}"
            report = reconcile.failed_report(self.spark, window, start_ms, end_ms, run_time_ms, message)
            report = report.withColumn("elapsed_ms", F.lit(elapsed()).cast("long"))
        self._runs.add(report, run_id)

    def reports(self) -> DataFrame:
        return self._runs.read()

    def results(self) -> DataFrame:
        return self._results.read()

    def metrics(self) -> DataFrame:
        return reconcile.run_metrics(self.reports(), self.results())

    def retain(self, settings: Settings) -> None:
        """Forget all but the newest reports of every window, with their results."""
        kept = {r["run_id"] for r in reconcile.retained(self.reports(), settings).select("run_id").collect()}
        for table in (self._runs, self._results):
            table.commit(lambda old: [e for e in old if e["tag"] in kept])
