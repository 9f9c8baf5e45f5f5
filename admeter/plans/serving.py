"""Read path: check the request, choose the tier by age, count or build the series.

One request returns a lazy DataFrame; nothing is collected here. The ``*_table`` functions
answer a whole table of requests in one plan.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from admeter.config import Settings
from admeter.functions import events as E
from admeter.model import COLD, COUNT_KEYS, GRAINS, HOT, METRICS, WARM
from admeter.operators import aggregates as A
from admeter.operators import timeseries as S


#: (tenant, campaign, metric)
Key = tuple[str, str, str]


class Stores:
    """The three tiers behind the read path, each a DataFrame; ``warm`` and ``cold`` hold events.

    ``plans/stored.py`` has the form over tables that are kept up to date.
    """

    def __init__(self, hot_counters: DataFrame, hot_series: DataFrame, warm: DataFrame, cold: DataFrame):
        self.hot_counters, self.hot_series, self.warm, self.cold = hot_counters, hot_series, warm, cold

    def hot_counts(self, tenant: str | None = None) -> DataFrame:
        return self.hot_counters

    def hot_points(self, tenant: str | None = None) -> DataFrame:
        return self.hot_series

    def warm_count(self, key: Key, placement: str | None = None) -> DataFrame:
        return A.of_campaign(self.warm, *key, placement).agg(F.count("*").alias("cnt"))

    def warm_counts(self) -> DataFrame:
        return A.counts(A.countable(self.warm))

    def warm_series(self, key: Key, placement: str | None, from_ms: int, to_ms: int, grain: str) -> DataFrame:
        return S.warm_series(A.of_campaign(self.warm, *key, placement), from_ms, to_ms, grain)

    def cold_count(self, key: Key, from_ms: int, to_ms: int) -> DataFrame:
        """Events of whole UTC dates, both ends included."""
        first, last = (E.event_date(F.lit(ms)) for ms in (from_ms, to_ms))
        day = E.event_date(F.col("event_timestamp_ms"))
        return A.of_campaign(self.cold, *key).where(day.between(first, last)).agg(F.count("*").alias("cnt"))

    def cold_series(self, key: Key, placement: str | None, from_ms: int, to_ms: int, grain: str) -> DataFrame:
        return S.cold_series(A.of_campaign(self.cold, *key, placement), from_ms, to_ms, grain)

    def day_counts(self, until_ms: int) -> DataFrame:
        """Counts per key and UTC date up to a date."""
        day = E.event_date(F.col("event_timestamp_ms"))
        rows = A.countable(self.cold).where(day <= E.event_date(F.lit(until_ms)))
        return A.counts(rows.withColumn("day", day), [*COUNT_KEYS, "day"])


@dataclass(frozen=True)
class Request:
    tenant: str
    campaign: str
    metric: str
    from_text: str | None = None
    to_text: str | None = None
    grain: str = "hour"
    placement: str | None = None

    def check(self, allowed: set[str] | None = None) -> None:
        """Refuse malformed ids, unknown grains and campaigns outside a non-empty allow-list."""
        pattern = re.compile(r"[A-Za-z0-9_.:-]{1,128}")
        if not self.tenant or not self.tenant.strip():
            raise PermissionError("missing tenant")
        if not pattern.fullmatch(self.campaign):
            raise ValueError("Invalid campaignId format.")
        if self.placement and self.placement.strip() and not pattern.fullmatch(self.placement):
            raise ValueError("Invalid placement format.")
        if self.grain not in GRAINS:
            raise ValueError("Invalid grain. Allowed: minute, hour, day.")
        if allowed and self.campaign not in allowed:
            raise PermissionError(f"Not authorized for campaign: {self.campaign}")

    def window(self, settings: Settings) -> tuple[int, int]:
        """(from, to) in epoch ms, with the defaults: to = now, from = to - 2 h."""
        to_ms = instant_ms(self.to_text)
        to_ms = settings.as_of_ms if to_ms is None else to_ms
        from_ms = instant_ms(self.from_text)
        return (to_ms - settings.default_window_ms if from_ms is None else from_ms), to_ms


def instant_ms(text: str | None) -> int | None:
    """ISO-8601 instant to epoch ms; blank or malformed text gives None."""
    if text is None or not re.match(E.INSTANT_PATTERN.replace(r"\z", r"\Z"), text):
        return None
    try:
        moment = datetime.fromisoformat(re.sub(r"(\.\d{6})\d+", r"\1", text))
    except ValueError:
        return None
    whole = int(moment.replace(microsecond=0).timestamp())
    return whole * 1000 + moment.microsecond // 1000


def resolve_tier(from_ms: int | None, settings: Settings) -> str:
    """Tier of one request: without a start hot, else by age with inclusive bounds."""
    if from_ms is None:
        return HOT
    age = settings.as_of_ms - from_ms
    if age <= settings.hot_window_ms:
        return HOT
    return WARM if age <= settings.warm_window_ms else COLD


def tier_of(from_ms: Column, settings: Settings) -> Column:
    """The same choice for a column of requests."""
    age = F.lit(settings.as_of_ms) - from_ms
    return (
        F.when(from_ms.isNull() | (age <= settings.hot_window_ms), F.lit(HOT))
        .when(age <= settings.warm_window_ms, F.lit(WARM))
        .otherwise(F.lit(COLD))
    )


def tiered_count(stores: Stores, request: Request, settings: Settings) -> DataFrame:
    """One row (cnt). Hot and warm counts do not look at the start of the request."""
    key = (request.tenant, request.campaign, request.metric)
    from_ms = instant_ms(request.from_text)
    tier = resolve_tier(from_ms, settings)
    if tier == COLD:
        return stores.cold_count(key, from_ms, settings.as_of_ms)
    warm = stores.warm_count(key)
    if tier == WARM:
        return warm
    hot = A.of_campaign(stores.hot_counts(request.tenant), *key)
    found = hot.agg(F.max("cnt").alias("hot_cnt"), F.lit(None).cast("bigint").alias("warm_cnt"))
    other = warm.select(F.lit(None).cast("bigint").alias("hot_cnt"), F.col("cnt").alias("warm_cnt"))
    return found.unionByName(other).agg(
        F.coalesce(F.max("hot_cnt"), F.max("warm_cnt"), F.lit(0)).alias("cnt")
    )


def tiered_series(stores: Stores, request: Request, settings: Settings) -> DataFrame:
    """(bucket_ms, value) from the tier of the request, in the order of the buckets.

    Hot and warm fall back to the warm count spread evenly when they hold no bucket; cold
    does not. The choice is part of the plan: both candidates are the buckets of one request.
    """
    from_ms, to_ms = request.window(settings)
    tier = resolve_tier(from_ms, settings)
    key = (request.tenant, request.campaign, request.metric)
    placement = request.placement if request.placement and request.placement.strip() else None
    if tier == COLD:
        return stores.cold_series(key, placement, from_ms, to_ms, request.grain).orderBy("bucket_ms")
    if tier == HOT:
        stored = A.of_campaign(stores.hot_points(request.tenant), *key)
        own = S.hot_series(stored, from_ms, to_ms).select("bucket_ms", "value")
    else:
        own = stores.warm_series(key, placement, from_ms, to_ms, request.grain)
    points = S.even_split(F.col("cnt"), F.lit(from_ms), F.lit(to_ms), request.grain, settings.max_buckets)
    # two rows of one column each become one: the total, and how many buckets there are without it
    none = F.lit(None).cast("bigint")
    known = stores.warm_count(key, placement).select("cnt", none.alias("own")).unionByName(
        own.agg(F.count("*").alias("own")).select(none.alias("cnt"), "own")
    )
    known = known.agg(F.max("cnt").alias("cnt"), F.max("own").alias("own"))
    spread = known.where("own = 0").select(F.inline(points))
    return own.unionByName(spread).orderBy("bucket_ms")


def metric_response(
    stores: Stores, request: Request, settings: Settings, allowed: set[str] | None = None
) -> DataFrame:
    """The answer to one request, one row per bucket, with total and tier beside each."""
    request.check(allowed)
    from_ms, to_ms = request.window(settings)
    series = tiered_series(stores, request, settings)
    whole = Window.partitionBy("tenant_id", "campaign_id", "metric")
    rows = series.select(
        F.lit(request.tenant).alias("tenant_id"),
        F.lit(request.campaign).alias("campaign_id"),
        F.lit(request.metric.lower()).alias("metric"),
        E.iso_instant(F.lit(from_ms)).alias("from_time"),
        E.iso_instant(F.lit(to_ms)).alias("to_time"),
        F.lit(request.grain).alias("grain"),
        E.iso_instant(F.col("bucket_ms")).alias("bucket"),
        "value",
        F.lit(resolve_tier(from_ms, settings)).alias("source"),
        "bucket_ms",
    )
    # the buckets of one request
    rows = rows.withColumn("total", F.sum("value").over(whole)).orderBy("bucket_ms")
    return rows.select(*[c for c in rows.columns if c not in ("source", "bucket_ms")], "source")


def campaign_metrics(
    events: DataFrame, from_ms: int, to_ms: int, grain: str, settings: Settings
) -> DataFrame:
    """The response rows of every campaign and served metric at once.

    Events are counted per bucket with partial aggregation; the total is a window over the
    buckets of one (tenant, campaign, metric), whose number the time range bounds.
    """
    rows = A.countable(events).where(F.col("event_type").isin(METRICS))
    tier = resolve_tier(from_ms, settings)
    build = S.cold_series if tier == COLD else S.warm_series
    series = build(rows, from_ms, to_ms, grain, COUNT_KEYS)
    whole = Window.partitionBy(*COUNT_KEYS)
    return series.select(
        "tenant_id",
        "campaign_id",
        F.lower("event_type").alias("metric"),
        F.lit(grain).alias("grain"),
        E.iso_instant(F.col("bucket_ms")).alias("bucket"),
        "value",
        F.sum("value").over(whole).alias("total"),
        F.lit(tier).alias("source"),
    )


def route_table(requests: DataFrame, settings: Settings) -> DataFrame:
    return requests.withColumn("tier", tier_of(F.col("from_ms"), settings))


def tiered_count_table(stores: Stores, requests: DataFrame, settings: Settings) -> DataFrame:
    """Counts for a table of requests (tenant_id, campaign_id, metric, from_ms).

    Each store is counted once per key (cold: per key and date, summed from the newest date
    back), and distinct requests are joined to those counts.
    """
    keys = ["tenant_id", "campaign_id", "metric"]
    wanted = (
        route_table(requests, settings)
        .withColumn(
            "from_date", F.when(F.col("tier") == COLD, E.event_date(F.col("from_ms")))
        )
        .select(*keys, "tier", "from_date")
        .distinct()
    )

    def named(df: DataFrame, name: str) -> DataFrame:
        return df.withColumnsRenamed({"event_type": "metric", "cnt": name})

    hot = named(stores.hot_counts(), "hot_cnt")
    warm = named(stores.warm_counts(), "warm_cnt")
    per_day = named(stores.day_counts(settings.as_of_ms), "day_cnt")
    # Dates of requests are put among the dates with events, and one pass per key from the
    # newest date back gives every request the sum of the dates not before its own. Rows per
    # key are bounded by the calendar.
    asked = wanted.where(F.col("tier") == COLD).select(
        *keys, F.col("from_date").alias("day"), F.lit(0).alias("day_cnt"), F.lit(True).alias("_asked")
    )
    newest_first = (
        Window.partitionBy(*keys)
        .orderBy(F.desc("day"))
        .rangeBetween(Window.unboundedPreceding, Window.currentRow)
    )
    cold = (
        per_day.withColumn("_asked", F.lit(False))
        .unionByName(asked)
        .withColumn("cold_cnt", F.sum("day_cnt").over(newest_first))
        .where("_asked")
        .select(*keys, F.lit(COLD).alias("tier"), F.col("day").alias("from_date"), "cold_cnt")
    )
    cnt = (
        F.when(F.col("tier") == COLD, F.coalesce("cold_cnt", F.lit(0)))
        .when(F.col("tier") == WARM, F.coalesce("warm_cnt", F.lit(0)))
        .otherwise(F.coalesce("hot_cnt", "warm_cnt", F.lit(0)))
    )
    c = cold.withColumnsRenamed({k: f"c_{k}" for k in [*keys, "tier", "from_date"]})
    same = [
        F.col(k).eqNullSafe(F.col(f"c_{k}")) for k in [*keys, "tier", "from_date"]
    ]
    return (
        wanted.join(hot, keys, "left")
        .join(warm, keys, "left")
        .join(c, same, "left")
        .select(*keys, "tier", "from_date", cnt.alias("cnt"))
    )


def exists_in_hot(stores: Stores, campaigns: DataFrame) -> DataFrame:
    """Campaigns (tenant_id, campaign_id) with the flag whether the hot tier knows them."""
    keys = ["tenant_id", "campaign_id"]
    known = stores.hot_counts().select(*keys).distinct().withColumn("_known", F.lit(True))
    return campaigns.join(known, keys, "left").select(
        *keys, F.coalesce("_known", F.lit(False)).alias("in_hot")
    )
