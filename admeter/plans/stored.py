"""What the read path serves from: tables that the write path keeps up to date, batch by batch.

    rollup     counts and costs per minute and dimension, by (tenant, date)      -> warm counts and series
    cube_*     every combination of dimensions, by (level, tenant)               -> counts without a time range
    latency    conversions per minute and bucket of their duration, by tenant    -> quantiles of any window
    hours      counts per key and hour with first and last event, by tenant      -> hot counters and series
    lake       the events, by (tenant, date)                                     -> cold tier, edges of windows
"""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark import inheritable_thread_target
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from admeter.config import DAY_MS, HOUR_MS, MINUTE_MS, Settings
from admeter.functions import events as E
from admeter.model import COLD, CONVERSION, COUNT_KEYS, HOT, WARM
from admeter.operators import aggregates as A
from admeter.operators import timeseries as S
from admeter.operators.attribution import duration_ms
from admeter.operators.quantiles import histogram
from admeter.plans.serving import Key, Stores, route_table
from admeter.sources import lake
from admeter.sources.parts import Parts
from admeter.sources.summed import Summed

TEXT, LONG, MONEY = T.StringType(), T.LongType(), T.DecimalType(28, 2)
#: Upper bounds (ms) of the latency buckets: 1 s to a day.
LATENCY_BOUNDS = [1_000, 10_000, 60_000, 300_000, 900_000, 3_600_000, 3 * 3_600_000, 6 * 3_600_000, 12 * 3_600_000, 86_400_000]
#: Deltas of a partition beyond which ``compact`` merges them.
MOST_DELTAS = 8


def _schema(*columns: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(n, t) for n, t in columns])


def rollup_table(spark: SparkSession, root: str) -> Summed:
    schema = _schema(*[(d, TEXT) for d in A.ROLLUP_DIMS], ("minute_ms", LONG), ("event_date", T.DateType()), ("cnt", LONG), ("cost", MONEY))
    return Summed(Parts(spark, f"{root}/rollup", ("tenant_id", "event_date"), schema), {"cnt": "sum", "cost": "sum"})


def cube_table(spark: SparkSession, root: str, name: str, dims: list[str]) -> Summed:
    schema = _schema(("level", T.IntegerType()), *[(d, TEXT) for d in dims], ("cnt", LONG), ("cost", MONEY))
    return Summed(Parts(spark, f"{root}/cube_{name}", ("level", "tenant_id"), schema), {"cnt": "sum", "cost": "sum"})


def hours_table(spark: SparkSession, root: str) -> Summed:
    schema = _schema(*[(k, TEXT) for k in COUNT_KEYS], ("bucket_ms", LONG), ("cnt", LONG), ("first_ms", LONG), ("last_ms", LONG))
    return Summed(Parts(spark, f"{root}/hours", ("tenant_id",), schema), {"cnt": "sum", "first_ms": "min", "last_ms": "max"})


def latency_table(spark: SparkSession, root: str) -> Summed:
    schema = _schema(("tenant_id", TEXT), ("minute_ms", LONG), ("le", T.IntegerType()), ("cnt", LONG))
    return Summed(Parts(spark, f"{root}/latency", ("tenant_id",), schema), {"cnt": "sum"})


def alive(hours: DataFrame, settings: Settings, as_of_ms: int) -> DataFrame:
    """Hours that a counter or series can still need at ``as_of_ms`` or later: the current life of live campaigns."""
    live = A.current_life(hours, ["tenant_id", "campaign_id"], settings, as_of_ms)
    return live.select(*hours.columns)


def together(spark: SparkSession, *steps: Callable[[], object]) -> None:
    """Run independent writes at the same time: the small jobs of one fill the cores that another leaves idle.

    All run to their end; the first that failed raises then.
    """
    with ThreadPoolExecutor(len(steps)) as pool:
        started = [pool.submit(inheritable_thread_target(spark)(s)) for s in steps]
    for s in started:
        s.result()


@dataclass(frozen=True)
class Tables:
    spark: SparkSession
    root: str

    @property
    def rollup(self) -> Summed:
        return rollup_table(self.spark, self.root)

    @property
    def placement(self) -> Summed:
        return cube_table(self.spark, self.root, "placement", A.PLACEMENT_DIMS)

    @property
    def geo(self) -> Summed:
        return cube_table(self.spark, self.root, "geo", A.GEO_DIMS)

    @property
    def hours(self) -> Summed:
        return hours_table(self.spark, self.root)

    @property
    def latency(self) -> Summed:
        return latency_table(self.spark, self.root)

    @property
    def lake(self) -> str:
        return f"{self.root}/lake"

    def add(self, enriched: DataFrame, tag: str) -> None:
        """Take in one batch of unique events and conversions; the same tag again replaces it."""
        minute = E.truncate_ms(F.col("event_timestamp_ms"), "minute").alias("minute_ms")
        made = enriched.where(F.col("event_type") == CONVERSION).select("tenant_id", minute, duration_ms().alias("duration_ms"))
        together(
            self.spark,
            lambda: lake.append(enriched, self.lake, tag),
            lambda: self._add_minutes(enriched, tag),
            lambda: self.hours.add(A.hourly(enriched), tag),
            lambda: self.latency.add(histogram(made, ["tenant_id", "minute_ms"], "duration_ms", LATENCY_BOUNDS), tag),
        )

    def _add_minutes(self, enriched: DataFrame, tag: str) -> None:
        minutes = A.minute_sums(enriched)
        minutes = minutes.withColumn("event_date", E.event_date(F.col("minute_ms")))
        self.rollup.add(minutes, tag)
        # everything coarser comes from the minutes just written, not from the events again
        mine = [e for e in self.rollup.parts.live() if e["tag"] == tag]
        minutes = self.rollup.parts.read_entries(mine)
        together(
            self.spark,
            lambda: self.placement.add(A.cube_sums(minutes, A.PLACEMENT_DIMS), tag),
            lambda: self.geo.add(A.cube_sums(minutes, A.GEO_DIMS), tag),
        )

    def compact(self, settings: Settings, horizon_ms: int, most: int = MOST_DELTAS) -> None:
        """Merge deltas; of the hours, drop counters that were dead at ``horizon_ms`` already.

        No event before ``horizon_ms`` may still come (the newest event time less the lateness).
        """
        together(
            self.spark,
            lambda: self.rollup.compact(most),
            lambda: self.placement.compact(most),
            lambda: self.geo.compact(most),
            lambda: self.latency.compact(most),
            lambda: self.hours.compact(most, lambda rows: alive(rows, settings, horizon_ms)),
            lambda: lake.compact(self.spark, self.lake, most),
        )


def one_tenant(tenant: str, first: str = "", last: str = "~"):
    def wanted(values: dict) -> bool:
        return values["tenant_id"] == tenant and first <= (values.get("event_date") or "") <= last

    return wanted


def cube_rows(cube: Summed, dims: list[str], group: list[str], **fixed: str) -> DataFrame:
    """cnt and cost per ``group`` for rows with the ``fixed`` values, from the smallest stored level that can tell.

    A level answers if it keeps every dimension asked for; the one that keeps fewest others has the
    fewest rows. Only that level's folders, and with a tenant given only the tenant's, are read.
    """
    asked = {*group, *fixed}
    bit = {d: 1 << (len(dims) - 1 - i) for i, d in enumerate(dims)}
    stored = {int(e["values"]["level"]) for e in cube.parts.live()}
    able = [level for level in stored if not any(level & bit[d] for d in asked)]
    if not able:
        raise LookupError(f"no stored level keeps {sorted(asked)}")
    level = max(able, key=lambda x: (x.bit_count(), x))
    tenant = fixed.get("tenant_id")
    rows = cube.parts.read(lambda v: int(v["level"]) == level and (tenant is None or v["tenant_id"] == tenant))
    rows = rows.where(F.col("level") == level)
    for name, value in fixed.items():
        rows = rows.where(F.col(name) == value)
    return rows.groupBy(*group).agg(F.sum("cnt").alias("cnt"), F.sum("cost").alias("cost"))


def matching(rows: DataFrame, key: Key, placement: str | None = None) -> DataFrame:
    return A.of_campaign(rows, *key, placement)


class StoredStores(Stores):
    """The three tiers on ``Tables``."""

    def __init__(self, tables: Tables, settings: Settings):
        self.tables, self.settings = tables, settings

    def _hours(self, tenant: str | None = None) -> DataFrame:
        until = F.col("first_ms") <= self.settings.as_of_ms
        if tenant is None:
            return self.tables.hours.read().where(until)
        return self.tables.hours.read(one_tenant(tenant)).where((F.col("tenant_id") == tenant) & until)

    def hot_counts(self, tenant: str | None = None) -> DataFrame:
        return A.counters_of(self._hours(tenant), self.settings)

    def hot_points(self, tenant: str | None = None) -> DataFrame:
        return A.series_of(self._hours(tenant), self.settings)

    def warm_count(self, key: Key, placement: str | None = None) -> DataFrame:
        fixed = dict(zip(COUNT_KEYS, key, strict=True)) | ({"placement_id": placement} if placement else {})
        rows = cube_rows(self.tables.placement, A.PLACEMENT_DIMS, [], **fixed)
        return rows.select(F.coalesce("cnt", F.lit(0)).alias("cnt"))

    def warm_counts(self) -> DataFrame:
        return cube_rows(self.tables.placement, A.PLACEMENT_DIMS, COUNT_KEYS).dropna(subset=COUNT_KEYS).drop("cost")

    def minutes(self, tenant: str, from_ms: int, to_ms: int) -> DataFrame:
        """Weighted rows (cnt) of ``from <= t <= to``: whole minutes from the roll-up, the two edges from events."""
        low, high = -(-from_ms // MINUTE_MS) * MINUTE_MS, (to_ms + 1) // MINUTE_MS * MINUTE_MS
        names = [*COUNT_KEYS, "placement_id", "event_timestamp_ms", "cnt"]
        edges = [(from_ms, to_ms)] if low >= high else [(a, b) for a, b in ((from_ms, low - 1), (high, to_ms)) if a <= b]
        parts = [
            lake.scan(self.tables.spark, self.tables.lake, tenant, a, b).withColumn("cnt", F.lit(1).cast("long")).select(*names)
            for a, b in edges
        ]
        if low < high:
            rows = self.tables.rollup.parts.read(one_tenant(tenant, lake.day_text(low), lake.day_text(high - 1)))
            minute = F.col("minute_ms")
            first, last = (E.event_date(F.lit(ms)) for ms in (low, high - 1))
            rows = rows.where((F.col("tenant_id") == tenant) & F.col("event_date").between(first, last))
            rows = rows.where((minute >= low) & (minute < high)).withColumn("event_timestamp_ms", minute)
            parts.append(rows.select(*names))
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out

    def warm_series(self, key: Key, placement: str | None, from_ms: int, to_ms: int, grain: str) -> DataFrame:
        rows = matching(self.minutes(key[0], from_ms, to_ms), key, placement)
        return S.bucketed(rows, grain, weight="cnt")

    def _days(self, key: Key, placement: str | None, from_ms: int, to_ms: int) -> DataFrame:
        """Minutes of whole UTC dates, both ends included."""
        rows = self.tables.rollup.parts.read(one_tenant(key[0], lake.day_text(from_ms), lake.day_text(to_ms)))
        first, last = (E.event_date(F.lit(ms)) for ms in (from_ms, to_ms))
        return matching(rows.where(F.col("event_date").between(first, last)), key, placement)

    def cold_count(self, key: Key, from_ms: int, to_ms: int) -> DataFrame:
        return self._days(key, None, from_ms, to_ms).agg(F.coalesce(F.sum("cnt"), F.lit(0)).alias("cnt"))

    def cold_series(self, key: Key, placement: str | None, from_ms: int, to_ms: int, grain: str) -> DataFrame:
        rows = self._days(key, placement, from_ms, to_ms).withColumn("event_timestamp_ms", F.col("minute_ms"))
        return S.bucketed(rows, S.clean_grain(grain), weight="cnt")

    def day_counts(self, until_ms: int) -> DataFrame:
        rows = self.tables.rollup.parts.read(lambda v: (v["event_date"] or "~") <= lake.day_text(until_ms))
        day = F.col("event_date").alias("day")
        return rows.dropna(subset=COUNT_KEYS).groupBy(*COUNT_KEYS, day).agg(F.sum("cnt").alias("cnt"))


def series_table(stores: StoredStores, requests: DataFrame, settings: Settings) -> DataFrame:
    """request, tier, bucket_ms, value for a table of requests, in the order of request and bucket.

    ``requests`` has request (unique), tenant_id, campaign_id, metric, from_ms, to_ms and grain. All
    joins are on key and time: a warm request is laid out by the hours it reaches and meets whole hours, or
    the minutes of an hour that it or its grain cuts; the minutes at its two ends, when they are not whole,
    meet their own events. A cold one meets sums of its grain by date. So what a request meets is bounded by
    its length, however many rows a key has in a day.
    Hot and warm requests without any bucket get the warm count spread evenly.
    """
    keys = ["tenant_id", "campaign_id", "metric"]
    asked = route_table(requests, settings).select("request", *keys, "tier", "from_ms", "to_ms", "grain", grain_of(F.col("grain")).alias("step"))
    low, high, at, minute = F.col("from_ms"), F.col("to_ms"), F.col("at"), F.lit(MINUTE_MS)

    def no(ms: Column, unit: int) -> Column:
        return F.floor(ms / unit)

    def laid_out(tier: str, unit: int) -> DataFrame:
        """Requests of a tier, once per unit of time that they reach."""
        reached = F.sequence(no(low, unit), no(high, unit))
        return asked.where(F.col("tier") == tier).withColumn("unit", F.explode(reached))

    def summed(rows: DataFrame, ms: str, grain: int) -> DataFrame:
        """cnt per key and ``at``, the start of a grain: one row however many dimensions there are."""
        rows = rows.withColumnRenamed("event_type", "metric").dropna(subset=keys)
        start = F.col(ms) - F.pmod(F.col(ms), F.lit(grain))
        return rows.groupBy(*keys, start.alias("at")).agg(F.sum("cnt").alias("cnt"))

    def met(wanted: DataFrame, rows: DataFrame, unit: int, *also: str) -> DataFrame:
        """Wanted units and rows (keys, ``at``, cnt) of the same key and unit."""
        return wanted.join(rows.withColumn("unit", no(at, unit)), [*keys, "unit", *also])

    minutes = stores.tables.rollup.parts.read()
    by_grain = {g: summed(minutes, "minute_ms", g) for g in E.GRAIN_MS.values()}
    points = stores.hot_points().withColumnRenamed("event_type", "metric").dropna(subset=keys)
    events = lake.whole(stores.tables.spark, stores.tables.lake).withColumnRenamed("event_type", "metric").dropna(subset=keys)
    events = events.select(*keys, F.col("event_timestamp_ms").alias("at"), F.lit(1).cast("long").alias("cnt"))
    edges = F.array_distinct(F.array(low - F.pmod(low, minute), high - F.pmod(high, minute)))
    cut = F.filter(edges, lambda m: (m < low) | (m + minute - 1 > high))
    ends = asked.where(F.col("tier") == WARM).withColumn("unit", F.explode(F.transform(cut, lambda m: no(m, MINUTE_MS))))
    warm = laid_out(WARM, HOUR_MS)
    inside = (F.col("unit") * HOUR_MS >= low) & ((F.col("unit") + 1) * HOUR_MS - 1 <= high)
    inside = inside & (F.col("step") % HOUR_MS == 0)  # hours that lie in the window and in one bucket as a whole
    each_grain = None
    for g, rows in by_grain.items():
        rows = rows.withColumn("step", F.lit(g).cast("long"))
        each_grain = rows if each_grain is None else each_grain.unionByName(rows)
    found = [
        met(laid_out(HOT, DAY_MS), points.select(*keys, F.col("bucket_ms").alias("at"), "cnt"), DAY_MS)
        .where(at.between(low, high)).withColumn("bucket_ms", at),
        met(warm.where(inside), by_grain[HOUR_MS], HOUR_MS),
        met(warm.where(~inside), by_grain[MINUTE_MS], HOUR_MS).where((at >= low) & (at + minute - 1 <= high)),
        met(ends, events, MINUTE_MS).where(at.between(low, high)),
        met(laid_out(COLD, DAY_MS), each_grain, DAY_MS, "step"),
    ]
    bucket = at - F.pmod(at, F.col("step"))
    own = None
    for i, part in enumerate(found):
        part = part if i == 0 else part.withColumn("bucket_ms", bucket)
        part = part.select("request", "tier", "bucket_ms", "cnt")
        own = part if own is None else own.unionByName(part)
    own = own.groupBy("request", "tier", "bucket_ms").agg(F.sum("cnt").alias("value"))
    counts = stores.warm_counts().withColumnRenamed("event_type", "metric")
    empty = asked.where(F.col("tier") != COLD).join(own.select("request").distinct(), "request", "left_anti")
    empty = empty.join(counts, keys, "left").withColumn("cnt", F.coalesce("cnt", F.lit(0)))
    for name, step in E.GRAIN_MS.items():
        points = S.even_split(F.col("cnt"), low, high, name, settings.max_buckets)
        spread = empty.where(F.col("step") == step).select("request", "tier", F.inline(points))
        own = own.unionByName(spread)
    return own.orderBy("request", "bucket_ms")


def grain_of(c: Column) -> Column:
    """Milliseconds of a grain name; unknown names mean hour."""
    out = F.lit(E.GRAIN_MS["hour"])
    for name, ms in E.GRAIN_MS.items():
        out = F.when(F.lower(c) == name, F.lit(ms)).otherwise(out)
    return out.cast("long")
