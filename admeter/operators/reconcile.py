"""Comparison of the counts that two stores hold for the same keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from admeter.config import DAY_MS, HOUR_MS, Settings
from admeter.functions import events as E
from admeter.model import COLD, COUNT_KEYS, HOT, WARM
from admeter.operators.aggregates import counts, countable, grouped_counts

# Windows and states of a run.
HOURLY, DAILY = "hourly", "daily"
OK, FOUND, ERROR, NO_RUN = "OK", "DISCREPANCIES_FOUND", "ERROR", "NO_RUN_YET"


def discrepancy_pct(reference: Column, delta: Column) -> Column:
    """0 when both are 0, 100 when only the reference is 0, else the relative difference."""
    relative = F.abs(delta).cast("double") * F.lit(100.0) / reference.cast("double")
    return F.when(reference == 0, F.when(delta == 0, 0.0).otherwise(100.0)).otherwise(relative)


def compare(
    reference: DataFrame,
    observed: DataFrame,
    driving: str,
    names: tuple[str, str],
    keys: list[str] = COUNT_KEYS,
) -> DataFrame:
    """Result rows for the keys of the ``driving`` side; a missing count on the other is 0."""
    r = reference.select(*keys, F.col("cnt").alias("reference_count"))
    o = observed.select(*keys, F.col("cnt").alias("observed_count"))
    joined = r.join(o, keys, "left") if driving == "reference" else o.join(r, keys, "left")
    joined = joined.fillna(0, ["reference_count", "observed_count"])
    delta = F.col("observed_count") - F.col("reference_count")
    return joined.select(
        *keys,
        F.lit(names[0]).alias("reference_store"),
        "reference_count",
        F.lit(names[1]).alias("observed_store"),
        "observed_count",
        delta.alias("delta"),
        discrepancy_pct(F.col("reference_count"), delta).alias("discrepancy_pct"),
    )


def hourly_results(
    warm: DataFrame, hot: DataFrame, settings: Settings, keys: list[str] = COUNT_KEYS
) -> DataFrame:
    """Warm groups against hot counters; a hot under-count is patched, an over-count reported."""
    rows = compare(warm, hot, "reference", (WARM, HOT), keys)
    short = F.col("observed_count") < F.col("reference_count")
    return rows.withColumn("auto_patched", short & F.lit(settings.auto_correct))


def daily_results(warm: DataFrame, cold: DataFrame, keys: list[str] = COUNT_KEYS) -> DataFrame:
    """Warm groups against cold counts; keys that cold does not hold at all are skipped."""
    rows = compare(cold, warm, "observed", (COLD, WARM), keys)
    absent = (F.col("reference_count") == 0) & (F.col("observed_count") > 0)
    return rows.where(~absent).withColumn("auto_patched", F.lit(False))


def hourly(warm: DataFrame, hot: DataFrame, settings: Settings) -> DataFrame:
    """Last 2 hours of the warm table against the (open-ended) hot counters."""
    start = settings.as_of_ms - 2 * HOUR_MS
    recent = grouped_counts(warm, start, settings.as_of_ms, settings.max_campaigns_per_run)
    return hourly_results(recent, hot, settings)


def daily(warm: DataFrame, cold: DataFrame, settings: Settings) -> DataFrame:
    """Previous UTC day of the warm table against the cold one, half-open on both sides."""
    end = settings.as_of_ms - settings.as_of_ms % DAY_MS
    limit = settings.max_campaigns_per_run
    w, c = (grouped_counts(t, end - DAY_MS, end, limit) for t in (warm, cold))
    return daily_results(w, c)


def patched_counters(hot: DataFrame, results: DataFrame) -> DataFrame:
    """Hot counters after the deficits of the patched keys were added."""
    deficit = results.where("auto_patched").select(
        *COUNT_KEYS, (-F.col("delta")).alias("deficit")
    )
    return hot.join(deficit, COUNT_KEYS, "full").select(
        *COUNT_KEYS,
        (F.coalesce("cnt", F.lit(0)) + F.coalesce("deficit", F.lit(0))).alias("cnt"),
    )


def _summary(settings: Settings) -> list[Column]:
    over = F.count_if(F.col("discrepancy_pct") > settings.discrepancy_threshold_pct)
    return [
        F.when(over > 0, F.lit(FOUND)).otherwise(F.lit(OK)).alias("status"),
        F.count("*").alias("campaigns"),
        F.count_if(F.col("delta") != 0).alias("discrepancies"),
        F.count_if(F.col("auto_patched")).alias("auto_patched"),
    ]


def report(
    results: DataFrame,
    window: str,
    start_ms: int,
    end_ms: int,
    run_time_ms: int,
    settings: Settings,
    elapsed_ms: int = 0,
) -> DataFrame:
    """The one report row of a run. Status goes by the threshold, discrepancies by delta <> 0."""
    return results.agg(*_summary(settings)).select(
        F.lit(f"{window}:{run_time_ms}").alias("run_id"),
        F.lit(window).alias("window"),
        "status",
        F.lit(run_time_ms).cast("bigint").alias("run_time_ms"),
        F.lit(start_ms).cast("bigint").alias("window_start_ms"),
        F.lit(end_ms).cast("bigint").alias("window_end_ms"),
        "campaigns",
        "discrepancies",
        "auto_patched",
        F.lit(elapsed_ms).cast("bigint").alias("elapsed_ms"),
        F.lit("").alias("message"),
    )


def failed_report(
    spark, window: str, start_ms: int, end_ms: int, run_time_ms: int, message: str
) -> DataFrame:
    """Report row of a run that ended with an error."""
    return spark.range(1).select(
        F.lit(f"{window}:{run_time_ms}").alias("run_id"),
        F.lit(window).alias("window"),
        F.lit(ERROR).alias("status"),
        *[
            F.lit(v).cast("bigint").alias(n)
            for n, v in (
                ("run_time_ms", run_time_ms),
                ("window_start_ms", start_ms),
                ("window_end_ms", end_ms),
                ("campaigns", 0),
                ("discrepancies", 0),
                ("auto_patched", 0),
                ("elapsed_ms", end_ms - start_ms),
            )
        ],
        F.lit(message).alias("message"),
    )


def history_results(
    hot_events: DataFrame, warm: DataFrame, cold: DataFrame, settings: Settings
) -> DataFrame:
    """Results of one hourly run per hour and one daily run per day of the data.

    All runs are computed together, grouped by period, instead of one job per run. Hourly runs
    compare like with like here: the hot hourly buckets with the same hours of the warm table.
    """
    hour = E.hour_bucket(F.col("event_timestamp_ms")).alias("window_start_ms")
    day = E.truncate_ms(F.col("event_timestamp_ms"), "day").alias("window_start_ms")
    keys = ["window_start_ms", *COUNT_KEYS]

    def per(rows: DataFrame, period: Column) -> DataFrame:
        return counts(countable(rows).select(*COUNT_KEYS, period), keys)

    by_hour = hourly_results(per(warm, hour), per(hot_events, hour), settings, keys)
    by_day = daily_results(per(warm, day), per(cold, day), keys)
    return by_hour.select(F.lit(HOURLY).alias("window"), "*").unionByName(
        by_day.select(F.lit(DAILY).alias("window"), "*")
    )


def history_reports(results: DataFrame, settings: Settings) -> DataFrame:
    """One report per run of the history; a run takes place when its period has ended."""
    length = F.when(F.col("window") == HOURLY, HOUR_MS).otherwise(DAY_MS)
    end = F.col("window_start_ms") + length
    return (
        results.groupBy("window", "window_start_ms")
        .agg(*_summary(settings))
        .withColumns({"window_end_ms": end, "run_time_ms": end})
        .withColumn("run_id", F.concat_ws(":", "window", F.col("run_time_ms").cast("string")))
    )


def newest(reports: DataFrame, limit: int, settings: Settings) -> DataFrame:
    """The newest reports per window: the limit is kept within 1 and the number of kept reports."""
    n = max(1, min(limit, settings.reports_kept))
    latest_first = Window.partitionBy("window").orderBy(F.desc("run_time_ms"), F.desc("run_id"))
    return (
        reports.withColumn("position", F.row_number().over(latest_first))
        .where(F.col("position") <= n)
        .withColumn("position", F.col("position").cast("int"))
    )


def retained(reports: DataFrame, settings: Settings) -> DataFrame:
    """What the report store keeps per window."""
    return newest(reports, settings.reports_kept, settings).drop("position")


def status(reports: DataFrame) -> DataFrame:
    """Latest report of every window, also of windows that have not run yet."""
    columns = ["run_id", "status", "run_time_ms", "campaigns", "discrepancies", "auto_patched"]
    latest = reports.groupBy("window").agg(
        F.max_by(F.struct(*columns), F.struct("run_time_ms", "run_id")).alias("r")
    )
    spark = reports.sparkSession
    windows = spark.createDataFrame([(HOURLY,), (DAILY,)], "window string")
    return windows.join(latest, "window", "left").select(
        "window",
        "r.run_id",
        F.coalesce("r.status", F.lit(NO_RUN)).alias("status"),
        "r.run_time_ms",
        *[F.coalesce(F.col(f"r.{c}"), F.lit(0)).alias(c) for c in columns[3:]],
    )


def details(reports: DataFrame, results: DataFrame, window: str) -> DataFrame:
    """Result rows of the latest run of a window, as they are shown to the caller."""
    latest = reports.where(F.col("window") == window).agg(
        F.max("window_start_ms").alias("window_start_ms")
    )
    return (
        results.where(F.col("window") == window)
        .join(latest, "window_start_ms", "left_semi")
        .withColumn("discrepancy_pct", E.pct_text(F.col("discrepancy_pct")))
    )


def run_metrics(reports: DataFrame, results: DataFrame) -> DataFrame:
    """Runs, failed runs, discrepancies by observed store and patches per window."""
    runs = reports.groupBy("window").agg(
        F.count("*").alias("runs"), F.count_if(F.col("status") == ERROR).alias("errors")
    )
    found = results.groupBy("window", "observed_store").agg(
        F.count_if(F.col("delta") != 0).alias("discrepancies"),
        F.count_if(F.col("auto_patched")).alias("patches"),
    )
    return runs.join(found, "window", "left")


