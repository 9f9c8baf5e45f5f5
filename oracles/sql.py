"""DuckDB SQL that states each registered query independently, over the whole tables."""

from __future__ import annotations

AS_OF = 1706659200000
MINUTE, HOUR, DAY = 60_000, 3_600_000, 86_400_000
WARM_FROM = AS_OF - 9 * DAY

FLAT = (
    "event_id, tenant_id, user_id, session_id, campaign_id, event_type, event_timestamp_ms, "
    "cost, placement_id, geo_country, device_type, arrival_ms, seq"
)
KEYS = "tenant_id, campaign_id, event_type"
TYPES = "('IMPRESSION','CLICK','PRODUCT_VIEW','ADD_TO_CART','PURCHASE','CLICK_TO_BASKET')"
ONE = "tenant_id = 'tenant_1' AND campaign_id = 'camp_4' AND event_type = 'CLICK'"
DATE = "CAST(make_timestamp(event_timestamp_ms * 1000) AS DATE)"
PSEUDONYM = (
    "CASE WHEN user_id IS NULL OR trim(user_id) = '' THEN user_id "
    "ELSE concat('anon_', substr(sha256(user_id), 1, 12)) END"
)
MONEY = "CAST(sum(CAST(cost AS DECIMAL(18,2))) AS DOUBLE)"

CTE: dict[str, str] = {}
CTE["ev"] = """
SELECT
 concat('evt_', CAST(CASE WHEN event_id % 10 = 9 THEN event_id - 1
   WHEN event_id % 100 = 98 THEN event_id - 50 ELSE event_id END AS VARCHAR)) AS event_id,
 CASE WHEN event_id % 211 = 0 THEN '' ELSE concat('tenant_', CAST(user_id % 5 AS VARCHAR)) END
   AS tenant_id,
 CASE WHEN event_id % 97 = 0 THEN '   ' ELSE concat('user_', CAST(user_id AS VARCHAR)) END
   AS user_id,
 CASE WHEN event_id % 89 = 0 THEN NULL ELSE concat('sess_', CAST(user_id AS VARCHAR)) END
   AS session_id,
 CASE WHEN event_type = 'click' OR (event_type = 'view' AND k % 2 = 0)
   THEN concat('camp_', CAST(k % 8 AS VARCHAR)) END AS campaign_id,
 CASE event_type
   WHEN 'click' THEN CASE WHEN event_id % 7 = 0 THEN ' click ' ELSE 'CLICK' END
   WHEN 'view' THEN CASE WHEN k % 2 = 0 THEN 'IMPRESSION' ELSE 'PRODUCT_VIEW' END
   WHEN 'signup' THEN 'ADD_TO_CART' WHEN 'purchase' THEN 'PURCHASE' ELSE 'ERROR' END
   AS event_type,
 ts_ms AS event_timestamp_ms, value AS cost,
 concat('plc_', CAST(k % 4 AS VARCHAR)) AS placement_id,
 CASE user_id % 4 WHEN 0 THEN 'US' WHEN 1 THEN 'DE' WHEN 2 THEN 'IN' ELSE 'BR' END
   AS geo_country,
 CASE event_id % 3 WHEN 0 THEN 'ios' WHEN 1 THEN 'android' ELSE 'web' END AS device_type,
 ts_ms + CASE WHEN event_id % 20 = 7 THEN 600000 ELSE 0 END AS arrival_ms,
 event_id AS seq, CAST(user_id % 4 AS INTEGER) AS source_partition, k
FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k,
        epoch_us(ts) // 1000 AS ts_ms FROM events)
"""
NORMAL = f"""CASE WHEN upper(trim(event_type)) IN {TYPES}
   THEN upper(trim(event_type)) ELSE 'UNSPECIFIED' END"""
REASON = f"""CASE
   WHEN event_id IS NULL OR trim(event_id) = '' THEN 'Missing required field: eventId'
   WHEN user_id IS NULL OR trim(user_id) = '' THEN 'Missing required field: userId'
   WHEN session_id IS NULL OR trim(session_id) = '' THEN 'Missing required field: sessionId'
   WHEN {NORMAL} = 'UNSPECIFIED'
     THEN concat('Unrecognized or missing eventType: ', event_type) END"""
CTE["checked"] = f"""
SELECT *, {NORMAL} AS normal_type, {REASON} AS dlq_reason
FROM ev WHERE trim(tenant_id) <> ''
"""
CTE["valid"] = """
SELECT * REPLACE (normal_type AS event_type) FROM checked WHERE dlq_reason IS NULL
"""
CTE["rejected"] = f"""
SELECT * REPLACE ({PSEUDONYM} AS user_id), tenant_id AS key
FROM checked WHERE dlq_reason IS NOT NULL
"""
CTE["numbered"] = """
SELECT event_id, event_timestamp_ms AS t, seq,
 row_number() OVER (PARTITION BY event_id ORDER BY event_timestamp_ms, seq) AS rn FROM valid
"""
CTE["walk"] = f"""
SELECT event_id, rn, seq, t AS anchor, TRUE AS keep FROM numbered WHERE rn = 1
UNION ALL
SELECT n.event_id, n.rn, n.seq,
 CASE WHEN n.t - w.anchor > {HOUR} THEN n.t ELSE w.anchor END, n.t - w.anchor > {HOUR}
FROM walk w JOIN numbered n ON n.event_id = w.event_id AND n.rn = w.rn + 1
"""
CTE["kept"] = "SELECT v.* FROM valid v JOIN walk w ON v.seq = w.seq WHERE w.keep"
CTE["clicks_carts"] = """
SELECT *, last_value(CASE WHEN event_type = 'CLICK' THEN seq END IGNORE NULLS) OVER (
  PARTITION BY session_id ORDER BY event_timestamp_ms, seq
  ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS click_seq
FROM kept WHERE event_type IN ('CLICK', 'ADD_TO_CART')
"""
CTE["takers"] = f"""
SELECT a.*, c.event_id AS click_id, c.campaign_id AS click_campaign, c.cost AS click_cost,
 a.event_timestamp_ms - c.event_timestamp_ms AS duration_ms,
 row_number() OVER (PARTITION BY a.click_seq ORDER BY a.event_timestamp_ms, a.seq) AS nth
FROM clicks_carts a JOIN kept c ON c.seq = a.click_seq
WHERE a.event_type = 'ADD_TO_CART'
 AND a.event_timestamp_ms - c.event_timestamp_ms BETWEEN 0 AND {DAY}
"""
CTE["conv"] = """
SELECT concat(event_id, '_att') AS event_id, tenant_id, user_id, session_id,
 click_campaign AS campaign_id, 'CLICK_TO_BASKET' AS event_type, event_timestamp_ms,
 click_cost AS cost, CAST(NULL AS VARCHAR) AS placement_id, CAST(NULL AS VARCHAR) AS geo_country,
 CAST(NULL AS VARCHAR) AS device_type, arrival_ms, seq, duration_ms,
 click_id AS attributed_click_id
FROM takers WHERE nth = 1
"""
CTE["enriched"] = f"""
SELECT {FLAT}, CAST(NULL AS BIGINT) AS duration_ms FROM kept
UNION ALL SELECT {FLAT}, duration_ms FROM conv
"""
CTE["countable"] = "SELECT * FROM enriched WHERE tenant_id IS NOT NULL AND campaign_id IS NOT NULL"
CTE["warm"] = "SELECT * FROM enriched"
# What reconciliation compares: a warm table and hot counters that have lost events.
CTE["warm_lost"] = "SELECT * FROM enriched WHERE seq % 200 <> 0"
CTE["warm_counts"] = f"""
SELECT {KEYS}, count(*) AS cnt FROM warm WHERE campaign_id IS NOT NULL GROUP BY ALL
"""


def _alive(keys: str, rows: str = "TRUE") -> str:
    """Events of the current life of each key: no gap over 48 h since, and alive at as_of."""
    return f"""
SELECT * EXCLUDE (gap) FROM (
 SELECT *, max(life) OVER (PARTITION BY {keys}) AS last_life,
  max(event_timestamp_ms) OVER (PARTITION BY {keys}) AS last_ms
 FROM (
  SELECT *, sum(CASE WHEN gap IS NULL OR gap > {48 * HOUR} THEN 1 ELSE 0 END) OVER (
    PARTITION BY {keys} ORDER BY event_timestamp_ms, seq, event_id
    ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS life
  FROM (
   SELECT *, event_timestamp_ms - lag(event_timestamp_ms) OVER (
     PARTITION BY {keys} ORDER BY event_timestamp_ms, seq, event_id) AS gap
   FROM countable WHERE {rows} AND event_timestamp_ms <= {AS_OF})))
WHERE life = last_life AND {AS_OF} - last_ms <= {48 * HOUR}
"""


CTE["alive"] = _alive("tenant_id, campaign_id")
CTE["alive_typed"] = _alive(KEYS)
CTE["alive_lost"] = _alive("tenant_id, campaign_id", "seq % 50 <> 0")
CTE["hot"] = f"SELECT {KEYS}, count(*) AS cnt FROM alive GROUP BY ALL"
CTE["hot_lost"] = f"SELECT {KEYS}, count(*) AS cnt FROM alive_lost GROUP BY ALL"
CTE["hot_series"] = f"""
SELECT {KEYS}, event_timestamp_ms // {HOUR} * {HOUR} AS bucket_ms, count(*) AS cnt
FROM alive_typed GROUP BY ALL
"""
CTE["log"] = """
SELECT seq, tenant_id, concat('camp_', CAST(k % 8 AS VARCHAR)) AS campaign_id,
 CASE k % 3 WHEN 0 THEN 'CLICK' WHEN 1 THEN 'IMPRESSION' ELSE 'CLICK_TO_BASKET' END AS metric,
 event_timestamp_ms AS from_ms, event_timestamp_ms AS ts_ms, seq % 5 <> 0 AS cache_hit
FROM ev WHERE event_type = 'PRODUCT_VIEW'
"""


def _tier(c: str) -> str:
    return f"""CASE WHEN {c} IS NULL OR {AS_OF} - {c} <= {48 * HOUR} THEN 'hot'
 WHEN {AS_OF} - {c} <= {10 * DAY} THEN 'warm' ELSE 'cold' END"""


CTE["routed"] = f"SELECT *, {_tier('from_ms')} AS tier FROM log"
CTE["dlq"] = """
SELECT *, source_partition AS "partition",
 row_number() OVER (PARTITION BY source_partition ORDER BY seq) - 1 AS "offset" FROM rejected
"""


_POLLED = """
SELECT *, lower(key) = 'tenant_1' AND starts_with(dlq_reason, 'Missing required field')
  AS replayed FROM (SELECT * FROM dlq)
"""
CTE["polled"] = _POLLED
CTE["polled_all"] = _POLLED
PCT = """CASE WHEN reference_count = 0 THEN CASE WHEN observed_count = 0 THEN 0.0 ELSE 100.0 END
 ELSE CAST(abs(observed_count - reference_count) AS DOUBLE) * 100.0 / reference_count END"""


def _result(source: str, keys: str, reference: str, observed: str, patch: str) -> str:
    return f"""
SELECT {keys}, '{reference}' AS reference_store, reference_count,
 '{observed}' AS observed_store, observed_count,
 observed_count - reference_count AS delta, CAST({PCT} AS DOUBLE) AS discrepancy_pct,
 {patch} AS auto_patched
FROM ({source})
"""


CTE["hourly"] = _result(
    f"""
SELECT w.*, coalesce(h.cnt, 0) AS observed_count FROM (
  SELECT {KEYS}, count(*) AS reference_count FROM warm_lost WHERE campaign_id IS NOT NULL
   AND event_timestamp_ms >= {AS_OF - 2 * HOUR} AND event_timestamp_ms < {AS_OF}
  GROUP BY ALL) w LEFT JOIN hot_lost h USING ({KEYS})""",
    KEYS, "warm", "hot", "observed_count < reference_count",
)
_DAY = f"event_timestamp_ms >= {AS_OF - DAY} AND event_timestamp_ms < {AS_OF}"
CTE["daily"] = _result(
    f"""
SELECT w.*, c.reference_count FROM (
  SELECT {KEYS}, count(*) AS observed_count FROM warm_lost WHERE campaign_id IS NOT NULL AND {_DAY}
  GROUP BY ALL) w JOIN (
  SELECT {KEYS}, count(*) AS reference_count FROM countable WHERE {_DAY}
  GROUP BY ALL) c USING ({KEYS})""",
    KEYS, "cold", "warm", "FALSE",
)


def _per(period: int, name: str, where: str) -> str:
    return f"""(SELECT event_timestamp_ms // {period} * {period} AS window_start_ms, {KEYS},
  count(*) AS {name} FROM countable WHERE {where} GROUP BY ALL)"""


CTE["history"] = (
    "SELECT 'hourly' AS \"window\", * FROM ("
    + _result(
        f"""SELECT w.*, coalesce(h.observed_count, 0) AS observed_count
 FROM {_per(HOUR, "reference_count", "seq % 200 <> 0")} w
 LEFT JOIN {_per(HOUR, "observed_count", "seq % 50 <> 0")} h
 USING (window_start_ms, {KEYS})""",
        f"window_start_ms, {KEYS}", "warm", "hot", "observed_count < reference_count",
    )
    + ") UNION ALL SELECT 'daily', * FROM ("
    + _result(
        f"""SELECT w.*, c.reference_count
 FROM {_per(DAY, "observed_count", "seq % 200 <> 0")} w
 JOIN {_per(DAY, "reference_count", "TRUE")} c USING (window_start_ms, {KEYS})""",
        f"window_start_ms, {KEYS}", "cold", "warm", "FALSE",
    )
    + ")"
)
CTE["reports"] = f"""
SELECT *, concat("window", ':', CAST(run_time_ms AS VARCHAR)) AS run_id FROM (
 SELECT "window", window_start_ms,
  CASE WHEN count(*) FILTER (discrepancy_pct > 1.0) > 0 THEN 'DISCREPANCIES_FOUND' ELSE 'OK' END
   AS status,
  count(*) AS campaigns, count(*) FILTER (delta <> 0) AS discrepancies,
  count(*) FILTER (auto_patched) AS auto_patched,
  window_start_ms + CASE WHEN "window" = 'hourly' THEN {HOUR} ELSE {DAY} END AS window_end_ms,
  window_start_ms + CASE WHEN "window" = 'hourly' THEN {HOUR} ELSE {DAY} END AS run_time_ms
 FROM history GROUP BY "window", window_start_ms)
"""
CTE["latest_first"] = """
SELECT *, CAST(row_number() OVER (PARTITION BY "window" ORDER BY run_time_ms DESC) AS INTEGER)
 AS "position" FROM reports
"""


def _sql(select: str) -> str:
    """Put exactly the needed common tables in front of a query."""
    needed: list[str] = []

    def add(text: str) -> None:
        words = set(text.replace("(", " ").replace(")", " ").replace(",", " ").split())
        for name in CTE:
            if name in words and name not in needed and f"FROM {name} " in f"{text} ".replace(
                "\n", " "
            ).replace(")", " ").replace("JOIN", "FROM"):
                needed.append(name)
                add(CTE[name])

    add(select)
    once = {"walk", "numbered", "kept", "valid", "conv", "enriched", "dlq", "history"}
    tables = ",\n".join(
        f"{name} AS {'MATERIALIZED ' if name in once - {'walk'} else ''}({CTE[name]})"
        for name in CTE
        if name in needed
    )
    return f"WITH RECURSIVE {tables}\n{select}" if tables else select


def _sliding(source: str, keys: str, sums: str, width: int) -> str:
    """Windows of ``width`` minutes starting at every full minute."""
    start = f"event_timestamp_ms // {MINUTE} * {MINUTE} - o * {MINUTE}"
    return f"""SELECT {keys} {start} AS window_start_ms, {sums}
 FROM ({source}), (SELECT unnest(range({width})) AS o) GROUP BY ALL"""


def _warm_series(grain: int, low: int, high: int, where: str) -> str:
    return f"""SELECT event_timestamp_ms // {grain} * {grain} AS bucket_ms, count(*) AS value
 FROM enriched WHERE {where} AND event_timestamp_ms BETWEEN {low} AND {high} GROUP BY ALL"""


def _cube(dims: str, extra: str) -> str:
    return f"""SELECT {dims}, CAST(grouping({dims}) AS INTEGER) AS level, count(event_id) AS cnt
 {extra} FROM enriched GROUP BY CUBE ({dims})"""


def _iso(c: str) -> str:
    return f"""CASE WHEN {c} % 1000 = 0
 THEN strftime(make_timestamp({c} * 1000), '%Y-%m-%dT%H:%M:%SZ')
 ELSE concat(strftime(make_timestamp({c} * 1000), '%Y-%m-%dT%H:%M:%S'), '.',
   lpad(CAST({c} % 1000 AS VARCHAR), 3, '0'), 'Z') END"""


def _id_ok(c: str) -> str:
    return f"coalesce(regexp_full_match({c}, '[A-Za-z0-9_.:-]{{1,128}}'), FALSE) AS {c}_ok"


def _iso_ms(text: str) -> str:
    return f"epoch_ms(TIMESTAMP '{text}')"


_QUERIES: dict[str, str] = {
    "normalize_event_type": f"SELECT seq, event_type AS raw_type, {NORMAL} AS event_type FROM ev",
    "validate_events": "SELECT seq, event_id, dlq_reason FROM checked",
    "field_errors": """SELECT seq, concat_ws('; ', u, s) AS field_errors,
 CAST((u IS NOT NULL)::INT + (s IS NOT NULL)::INT AS INTEGER) AS error_count FROM (
 SELECT seq, CASE WHEN trim(user_id) = '' THEN 'userId is required' END AS u,
  CASE WHEN session_id IS NULL THEN 'sessionId is required' END AS s FROM ev)
 WHERE u IS NOT NULL OR s IS NOT NULL""",
    "valid_events": f"SELECT {FLAT}, CAST({DATE} AS VARCHAR) AS event_date FROM valid",
    "dlq_events": f"SELECT key, dlq_reason, {FLAT} FROM rejected",
    "dlq_redacted": f"SELECT seq, {PSEUDONYM} AS user_id, TRUE AS tags_dropped FROM ev",
    "mask_pii": r"""SELECT doc_id, regexp_replace(regexp_replace(text,
 '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}', '***@***', 'g'),
 '\b(?:[0-9]{1,3}\.){3}[0-9]{1,3}\b', '***.***.***.***', 'g') AS masked_text FROM documents""",
    "pseudonymize_users": f"SELECT seq, user_id, {PSEUDONYM} AS pseudonym FROM ev",
    "event_keys": """SELECT seq,
 concat(tenant_id, ':', coalesce(session_id, 'null')) AS raw_key,
 concat(tenant_id, ':', coalesce(campaign_id, 'null')) AS enriched_key,
 coalesce(tenant_id, 'unknown') AS dlq_key,
 concat('campaign:', tenant_id, ':', coalesce(campaign_id, 'null')) AS counter_key,
 concat('ts:', tenant_id, ':', coalesce(campaign_id, 'null'), ':', event_type) AS series_key
 FROM ev""",
    "time_buckets": f"""SELECT seq, event_timestamp_ms // {HOUR} * {HOUR} AS hour_bucket_ms,
 epoch_ms(date_trunc('minute', make_timestamp(event_timestamp_ms * 1000))) AS minute_ms,
 epoch_ms(date_trunc('hour', make_timestamp(event_timestamp_ms * 1000))) AS hour_ms,
 epoch_ms(date_trunc('day', make_timestamp(event_timestamp_ms * 1000))) AS day_ms,
 CAST({DATE} AS VARCHAR) AS event_date, {_iso("event_timestamp_ms")} AS instant FROM ev""",
    "request_binding": f"""SELECT seq, 'tenant_2' AS tenant_id,
 CASE WHEN seq % 10 = 0 THEN {AS_OF} ELSE event_timestamp_ms END AS event_timestamp_ms
 FROM ev""",
    "request_windows": f"""SELECT seq, parsed_from_ms, to_ms,
 coalesce(parsed_from_ms, to_ms - {2 * HOUR}) AS from_ms FROM (SELECT seq,
 CASE seq % 5 WHEN 0 THEN event_timestamp_ms // 1000 * 1000 WHEN 3 THEN event_timestamp_ms END
   AS parsed_from_ms,
 CASE WHEN seq % 3 = 0 THEN event_timestamp_ms // 1000 * 1000 + {HOUR} ELSE {AS_OF} END AS to_ms
 FROM ev)""",
    "valid_campaign_ids": f"""SELECT seq, {_id_ok("campaign_id")}, {_id_ok("placement_id")},
 {_id_ok("user_id")} FROM ev""",
    "label_cleanup": f"""SELECT seq, CASE WHEN trim(tenant_id) = '' THEN 'unknown'
 ELSE tenant_id END AS tenant_id, coalesce(CASE WHEN length(r) > 80
 THEN concat(substr(r, 1, 77), '...') ELSE r END, 'unknown') AS reason
 FROM (SELECT *, {REASON} AS r FROM ev )""",
    "abbreviate_texts": """SELECT doc_id, CASE WHEN text IS NULL THEN 'unknown'
 WHEN length(text) > 80 THEN concat(substr(text, 1, 77), '...') ELSE text END AS label
 FROM documents""",
    "dedup_ttl": f"SELECT {FLAT} FROM kept",
    "dedup_state_size": f"""SELECT count(*) AS live_keys FROM kept
 WHERE {AS_OF} - event_timestamp_ms BETWEEN 0 AND {HOUR}""",
    "billing_exact_counts": f"""SELECT {KEYS}, count(*) AS cnt FROM (SELECT *, row_number() OVER (
 PARTITION BY event_id ORDER BY event_timestamp_ms, seq) AS rn FROM valid )
 WHERE rn = 1 GROUP BY ALL""",
    "dedup_dropped_by_tenant": """SELECT tenant_id, count(*) AS dropped
 FROM valid v WHERE NOT EXISTS (SELECT 1 FROM kept k WHERE k.seq = v.seq) GROUP BY ALL""",
    "click_to_basket": """SELECT event_id, tenant_id, user_id, session_id, campaign_id, event_type,
 event_timestamp_ms, cost, seq, duration_ms, attributed_click_id FROM conv""",
    "enriched_events": f"""SELECT {FLAT}, concat(tenant_id, ':', coalesce(campaign_id, 'null'))
 AS key, duration_ms FROM enriched""",
    "campaign_count": f"SELECT count(*) AS cnt FROM enriched WHERE {ONE}",
    "grouped_counts": f"""SELECT {KEYS}, count(*) AS cnt FROM countable
 WHERE event_timestamp_ms >= {AS_OF - 10 * DAY} AND event_timestamp_ms < {AS_OF}
 GROUP BY ALL""",
    "hot_counters": f"SELECT {KEYS}, cnt FROM hot",
    "hot_hourly_series": f"SELECT {KEYS}, bucket_ms, cnt FROM hot_series",
    "star_cube_placement": _cube(
        "tenant_id, campaign_id, event_type, placement_id", f", {MONEY} AS sum_cost"
    ),
    "star_cube_geo_device": _cube("tenant_id, campaign_id, geo_country, device_type", ""),
    "cube_campaign_cost": f"""SELECT tenant_id, campaign_id, count(event_id) AS cnt,
 {MONEY} AS sum_cost FROM enriched WHERE tenant_id = 'tenant_1' GROUP BY ALL""",
    "minute_rollup": f"""SELECT {KEYS}, placement_id, geo_country, device_type,
 event_timestamp_ms // {MINUTE} * {MINUTE} AS minute_ms, count(*) AS cnt, {MONEY} AS sum_cost
 FROM enriched GROUP BY ALL""",
    "type_breakdown": f"""SELECT event_type, count(*) AS cnt FROM enriched
 WHERE tenant_id = 'tenant_1' AND campaign_id = 'camp_4'
 AND {DATE} BETWEEN DATE '2024-01-10' AND DATE '2024-01-25' GROUP BY ALL""",
    "ingest_outcomes": """SELECT tenant_id,
 CASE WHEN dlq_reason IS NULL THEN 'accepted' ELSE 'validation_failed' END AS status,
 CASE WHEN dlq_reason IS NULL THEN normal_type ELSE 'unknown' END AS event_type,
 coalesce(dlq_reason, '') AS reason, count(*) AS cnt FROM checked GROUP BY ALL""",
    "processed_by_type": "SELECT tenant_id, event_type, count(*) AS cnt FROM kept GROUP BY ALL",
    "attributed_by_campaign": """SELECT tenant_id, campaign_id, count(*) AS cnt FROM conv
 GROUP BY ALL""",
    "count_with_fallback": f"""SELECT {KEYS}, coalesce(h.cnt, w.cnt, 0) AS cnt
 FROM hot h FULL JOIN warm_counts w USING ({KEYS})""",
    "authorized_campaign_counts": f"""SELECT {KEYS}, count(*) AS cnt FROM countable
 WHERE tenant_id NOT IN ('tenant_0', 'tenant_1')
 OR (tenant_id = 'tenant_0' AND campaign_id IN ('camp_0', 'camp_1', 'camp_2'))
 OR (tenant_id = 'tenant_1' AND campaign_id = 'camp_3') GROUP BY ALL""",
    "series_warm_minute": _warm_series(MINUTE, WARM_FROM + 1234, AS_OF - DAY + 1, ONE),
    "series_warm_hour": _warm_series(HOUR, WARM_FROM + 1234, AS_OF - DAY + 1, ONE),
    "series_warm_day": _warm_series(DAY, WARM_FROM + 1234, AS_OF - DAY + 1, ONE),
    "series_by_placement": _warm_series(
        DAY, WARM_FROM, AS_OF,
        ONE.replace("'CLICK'", "'IMPRESSION'") + " AND placement_id = 'plc_0'",
    ),
    "series_cold": f"""SELECT event_timestamp_ms // {DAY} * {DAY} AS bucket_ms, count(*) AS value
 FROM enriched WHERE {ONE} AND {DATE} BETWEEN DATE '2024-01-06' AND DATE '2024-01-19'
 GROUP BY ALL""",
    "series_hot": f"""SELECT {KEYS}, bucket_ms, cnt AS value FROM hot_series
 WHERE bucket_ms BETWEEN {AS_OF - 2 * DAY + 1} AND {AS_OF}""",
    "bucket_spine": f"""SELECT tenant_id, grain, CAST(i AS INTEGER) AS "position",
 a // step * step + i * step AS bucket_ms FROM (
 SELECT tenant_id, grain, step, a, b,
  unnest(range((b - a // step * step) // step + 1)) AS i FROM (
  SELECT tenant_id, min(event_timestamp_ms) AS a, max(event_timestamp_ms) AS b
  FROM valid GROUP BY tenant_id), (VALUES ('hour', {HOUR}), ('minute', {MINUTE})) g(grain, step))""",
    "series_even_split": f"""SELECT tenant_id, event_type, {WARM_FROM} + i * {HOUR} AS bucket_ms,
 cnt // 217 + CASE WHEN i = 216 THEN cnt % 217 ELSE 0 END AS value, TRUE AS spread
 FROM (SELECT tenant_id, event_type, count(*) AS cnt FROM valid GROUP BY ALL),
 (SELECT unnest(range(217)) AS i)
 UNION ALL SELECT tenant_id, event_type, {AS_OF}, count(*), FALSE FROM valid GROUP BY ALL""",
    "rate_limit_admission": """SELECT *, "position" <= quota AS admitted FROM (
 SELECT seq, tenant_id, event_timestamp_ms // 1000 // 600 AS window_no,
 row_number() OVER (PARTITION BY tenant_id, event_timestamp_ms // 1000 // 600
   ORDER BY event_timestamp_ms, seq) AS "position",
 CAST(CASE WHEN tenant_id = 'tenant_0' THEN 3 ELSE 1 END AS INTEGER) AS quota FROM checked )""",
    "rate_limit_remaining": """SELECT tenant_id, window_no, used, greatest(0,
 CASE WHEN tenant_id = 'tenant_0' THEN 3 ELSE 1 END - used) AS remaining FROM (
 SELECT tenant_id, event_timestamp_ms // 1000 // 600 AS window_no, count(*) AS used
 FROM checked GROUP BY ALL)""",
    "route_requests": f"""SELECT seq, from_ms, {_tier("from_ms")} AS tier FROM (
 SELECT seq, CASE WHEN seq % 7 <> 0 THEN from_ms END AS from_ms FROM log )""",
    "tiered_counts": f"""SELECT r.tenant_id, r.campaign_id, r.metric, r.tier, r.from_date,
 CASE r.tier WHEN 'hot' THEN coalesce(h.cnt, w.cnt, 0) WHEN 'warm' THEN coalesce(w.cnt, 0)
  ELSE coalesce(c.cnt, 0) END AS cnt
 FROM (SELECT DISTINCT tenant_id, campaign_id, metric, tier, CASE WHEN tier = 'cold' THEN
   CAST(CAST(make_timestamp(from_ms * 1000) AS DATE) AS VARCHAR) END AS from_date
   FROM routed WHERE tenant_id <> '') r
 LEFT JOIN hot h ON h.tenant_id = r.tenant_id AND h.campaign_id = r.campaign_id
  AND h.event_type = r.metric
 LEFT JOIN warm_counts w ON w.tenant_id = r.tenant_id AND w.campaign_id = r.campaign_id
  AND w.event_type = r.metric
 LEFT JOIN (SELECT l.tenant_id, l.campaign_id, l.metric, l.from_date, count(*) AS cnt
  FROM (SELECT DISTINCT tenant_id, campaign_id, metric,
    CAST(make_timestamp(from_ms * 1000) AS DATE) AS from_date FROM routed WHERE tier = 'cold') l
  JOIN enriched e ON e.tenant_id = l.tenant_id AND e.campaign_id = l.campaign_id
   AND e.event_type = l.metric AND CAST(make_timestamp(e.event_timestamp_ms * 1000) AS DATE)
    BETWEEN l.from_date AND DATE '2024-01-31' GROUP BY ALL) c
  ON r.tier = 'cold' AND c.tenant_id = r.tenant_id AND c.campaign_id = r.campaign_id
  AND c.metric = r.metric AND CAST(c.from_date AS VARCHAR) = r.from_date""",
    "tiered_count_single": f"""SELECT 'hot' AS tier, coalesce(
  (SELECT cnt FROM hot WHERE {ONE}), (SELECT cnt FROM warm_counts WHERE {ONE}), 0) AS cnt
 UNION ALL SELECT 'warm', coalesce((SELECT cnt FROM warm_counts WHERE {ONE}), 0)
 UNION ALL SELECT 'cold', count(*) FROM enriched WHERE {ONE}
  AND {DATE} BETWEEN DATE '2024-01-11' AND DATE '2024-01-31'""",
    "series_tiered": f"""
 SELECT 'hot' AS request, bucket_ms, value FROM (
  SELECT bucket_ms, cnt AS value FROM hot_series
  WHERE {ONE} AND bucket_ms BETWEEN {AS_OF - DAY} AND {AS_OF}
  UNION ALL
  SELECT {AS_OF - DAY} + i * {HOUR}, n // 25 + CASE WHEN i = 24 THEN n % 25 ELSE 0 END
  FROM (SELECT count(*) AS n FROM warm WHERE {ONE}), (SELECT unnest(range(25)) AS i)
  WHERE NOT EXISTS (SELECT 1 FROM hot_series
   WHERE {ONE} AND bucket_ms BETWEEN {AS_OF - DAY} AND {AS_OF}))
 UNION ALL SELECT 'warm', bucket_ms, value FROM (
  SELECT event_timestamp_ms // {HOUR} * {HOUR} AS bucket_ms, count(*) AS value FROM warm
  WHERE {ONE} AND event_timestamp_ms BETWEEN {AS_OF - 6 * DAY} AND {AS_OF - 36 * HOUR}
  GROUP BY ALL
  UNION ALL
  SELECT {AS_OF - 6 * DAY} + i * {HOUR}, n // 109 + CASE WHEN i = 108 THEN n % 109 ELSE 0 END
  FROM (SELECT count(*) AS n FROM warm WHERE {ONE}), (SELECT unnest(range(109)) AS i)
  WHERE NOT EXISTS (SELECT 1 FROM warm WHERE {ONE}
   AND event_timestamp_ms BETWEEN {AS_OF - 6 * DAY} AND {AS_OF - 36 * HOUR}))
 UNION ALL SELECT 'cold', event_timestamp_ms // {DAY} * {DAY}, count(*) FROM enriched
  WHERE {ONE} AND {DATE} BETWEEN DATE '2024-01-05' AND DATE '2024-01-15' GROUP BY ALL
 UNION ALL SELECT 'split', {AS_OF + DAY} + i * {HOUR},
  n // 7 + CASE WHEN i = 6 THEN n % 7 ELSE 0 END
  FROM (SELECT count(*) AS n FROM warm WHERE {ONE}), (SELECT unnest(range(7)) AS i)""",
    "campaign_metrics": f"""SELECT tenant_id, campaign_id, lower(event_type) AS metric,
 'hour' AS grain, {_iso("bucket_ms")} AS bucket, value,
 CAST(sum(value) OVER (PARTITION BY {KEYS}) AS BIGINT) AS total, 'warm' AS source FROM (
 SELECT {KEYS}, event_timestamp_ms // {HOUR} * {HOUR} AS bucket_ms, count(*) AS value
 FROM countable WHERE event_type IN ('CLICK', 'IMPRESSION', 'CLICK_TO_BASKET')
 AND event_timestamp_ms BETWEEN {WARM_FROM} AND {AS_OF} GROUP BY ALL)""",
    "campaign_metric_response": f"""SELECT 'tenant_1' AS tenant_id, 'camp_4' AS campaign_id,
 'click' AS metric, '2024-01-24T00:00:00Z' AS from_time, '2024-01-31T00:00:00Z' AS to_time,
 'day' AS grain, {_iso("bucket_ms")} AS bucket, value,
 CAST(sum(value) OVER () AS BIGINT) AS total, 'warm' AS source FROM (
 SELECT event_timestamp_ms // {DAY} * {DAY} AS bucket_ms, count(*) AS value FROM warm
 WHERE {ONE} AND event_timestamp_ms BETWEEN {AS_OF - 7 * DAY} AND {AS_OF} GROUP BY ALL)""",
    "hot_exists": """SELECT tenant_id, campaign_id, EXISTS (SELECT 1 FROM hot h
 WHERE h.tenant_id = r.tenant_id AND h.campaign_id = r.campaign_id) AS in_hot
 FROM (SELECT DISTINCT tenant_id, campaign_id FROM log ) r""",
    "tier_usage": """SELECT CASE WHEN trim(tenant_id) = '' THEN 'unknown' ELSE tenant_id END
 AS tenant_id, metric, tier, count(*) AS queries, count(*) FILTER (cache_hit) AS hits,
 count(*) FILTER (NOT cache_hit) AS misses FROM routed GROUP BY ALL""",
    "recon_hourly": "SELECT * FROM hourly",
    "recon_hourly_bucketed": f"""SELECT * FROM history
 WHERE "window" = 'hourly' AND window_start_ms >= {AS_OF - DAY}""",
    "recon_patched_counters": f"""SELECT {KEYS}, coalesce(h.cnt, 0) + coalesce(p.deficit, 0) AS cnt
 FROM hot_lost h FULL JOIN (SELECT {KEYS}, -delta AS deficit FROM hourly WHERE auto_patched) p
 USING ({KEYS})""",
    "recon_daily": "SELECT * FROM daily",
    "recon_summary": "\nUNION ALL\n".join(
        f"""SELECT '{w}:{AS_OF}' AS run_id, '{w}' AS "window",
 CASE WHEN count(*) FILTER (discrepancy_pct > 1.0) > 0 THEN 'DISCREPANCIES_FOUND' ELSE 'OK' END
  AS status, {AS_OF} AS run_time_ms, {AS_OF - length} AS window_start_ms,
 {AS_OF} AS window_end_ms, count(*) AS campaigns,
 count(*) FILTER (delta <> 0) AS discrepancies, count(*) FILTER (auto_patched) AS auto_patched,
 CAST(0 AS BIGINT) AS elapsed_ms, '' AS message FROM {w} """
        for w, length in (("hourly", 2 * HOUR), ("daily", DAY))
    ),
    "recon_reports": 'SELECT * FROM latest_first WHERE "position" <= 48',
    "recon_status": """SELECT "window", run_id, status, run_time_ms, campaigns, discrepancies,
 auto_patched FROM latest_first WHERE "position" = 1""",
    "recon_details": f"""SELECT {KEYS}, reference_store, reference_count, observed_store,
 observed_count, delta, printf('%.4f', discrepancy_pct) AS discrepancy_pct, auto_patched
 FROM history WHERE "window" = 'daily' AND window_start_ms =
 (SELECT max(window_start_ms) FROM reports WHERE "window" = 'daily')""",
    "recon_metrics": """SELECT r."window", r.runs, CAST(0 AS BIGINT) AS errors, h.observed_store,
 h.discrepancies, h.patches FROM
 (SELECT "window", count(*) AS runs FROM reports GROUP BY ALL) r JOIN
 (SELECT "window", observed_store, count(*) FILTER (delta <> 0) AS discrepancies,
   count(*) FILTER (auto_patched) AS patches FROM history GROUP BY ALL) h
 ON r."window" = h."window" """,
    "dlq_stats": """SELECT "partition", min("offset") AS earliest, max("offset") + 1 AS latest,
 max("offset") + 1 - min("offset") AS lag FROM dlq GROUP BY ALL
 UNION ALL SELECT NULL, NULL, NULL, count(*) FROM dlq """,
    "dlq_replay": f"""SELECT "partition", "offset", key, dlq_reason, {FLAT}
 FROM polled WHERE replayed""",
    "dlq_replay_summary": """SELECT count(*) FILTER (replayed) AS replayed,
 count(*) FILTER (NOT replayed) AS skipped, count(*) FILTER (replayed) AS rejected_again,
 count(*) AS total FROM polled """,
    "replay_failures": """SELECT event_timestamp_ms // 600000 * 600000 AS window_start_ms,
 count(*) AS failed, count(*) > 3 AS alert FROM polled_all GROUP BY ALL""",
    "dlq_rate": "SELECT *, CAST(n AS DOUBLE) / 300 AS rate, CAST(n AS DOUBLE) / 300 > 0.004 "
    "AS warning, CAST(n AS DOUBLE) / 300 > 0.01 AS critical FROM ("
    + _sliding("SELECT * FROM rejected ", "tenant_id,", "count(*) AS n", 5) + ")",
    "dedup_drop_ratio": """SELECT window_start_ms, got - processed AS dropped, processed,
 CAST(got - processed AS DOUBLE) / nullif(CAST(processed AS DOUBLE), 0) AS drop_ratio,
 coalesce(CAST(got - processed AS DOUBLE) / nullif(CAST(processed AS DOUBLE), 0) > 0.1, FALSE)
 AS alert FROM ("""
    + _sliding(
        "SELECT event_timestamp_ms, 1 AS g, 0 AS p FROM valid "
        "UNION ALL SELECT event_timestamp_ms, 0, 1 FROM kept ",
        "", "CAST(sum(g) AS BIGINT) AS got, CAST(sum(p) AS BIGINT) AS processed", 5,
    )
    + ")",
    "attribution_gaps": f"""SELECT window_start_ms, n, recent = 0 AND seen = 2 AS alert FROM (
 SELECT *, sum(n) OVER (ORDER BY window_start_ms ROWS BETWEEN 1 PRECEDING AND CURRENT ROW)
  AS recent, count(*) OVER (ORDER BY window_start_ms ROWS BETWEEN 1 PRECEDING AND CURRENT ROW)
  AS seen FROM (
  SELECT s.w AS window_start_ms, count(c.seq) AS n FROM (
   SELECT unnest(range(min(event_timestamp_ms) // 900000 * 900000,
     max(event_timestamp_ms) + 1, 900000)) AS w FROM valid ) s
  LEFT JOIN conv c ON c.event_timestamp_ms // 900000 * 900000 = s.w GROUP BY s.w))
 WHERE n = 0""",
    "cache_hit_ratio": """SELECT window_start_ms, hits, misses,
 CAST(hits AS DOUBLE) / (hits + misses) AS hit_ratio,
 CAST(hits AS DOUBLE) / (hits + misses) < 0.8 AS alert FROM ("""
    + _sliding(
        "SELECT *, ts_ms AS event_timestamp_ms FROM log ", "",
        "count(*) FILTER (cache_hit) AS hits, count(*) FILTER (NOT cache_hit) AS misses", 5,
    )
    + ")",
    "conversion_latency_quantiles": """SELECT tenant_id, count(*) AS n,
 round(quantile_cont(duration_ms, 0.5), 3) AS p50, round(quantile_cont(duration_ms, 0.95), 3)
 AS p95, round(quantile_cont(duration_ms, 0.99), 3) AS p99 FROM conv GROUP BY ALL""",
    "conversion_latency_by_hour": f"""SELECT tenant_id,
 event_timestamp_ms // {HOUR} * {HOUR} AS window_start_ms, count(*) AS n,
 round(quantile_cont(duration_ms, 0.5), 3) AS p50, round(quantile_cont(duration_ms, 0.95), 3)
 AS p95, round(quantile_cont(duration_ms, 0.99), 3) AS p99 FROM conv GROUP BY ALL""",
    "ingest_rate_by_type": f"""SELECT event_type,
 event_timestamp_ms // {MINUTE} * {MINUTE} AS minute_ms, count(*) AS n,
 CAST(count(*) AS DOUBLE) / 60 AS rate FROM valid GROUP BY ALL""",
    "dlq_rate_by_reason": f"""SELECT dlq_reason AS reason,
 event_timestamp_ms // {MINUTE} * {MINUTE} AS minute_ms, count(*) AS n,
 CAST(count(*) AS DOUBLE) / 60 AS rate FROM rejected GROUP BY ALL""",
    "throughput_per_minute": f"""SELECT event_timestamp_ms // {MINUTE} * {MINUTE} AS minute_ms,
 count(*) FILTER (kind = 'k') AS processed,
 count(*) FILTER (kind = 'v') - count(*) FILTER (kind = 'k') AS dropped,
 count(*) FILTER (kind = 'c') AS attributed FROM (
 SELECT event_timestamp_ms, 'v' AS kind FROM valid
 UNION ALL SELECT event_timestamp_ms, 'k' FROM kept
 UNION ALL SELECT event_timestamp_ms, 'c' FROM conv ) GROUP BY ALL""",
    "last_5m_totals": f"""SELECT
 (SELECT count(*) FROM checked WHERE dlq_reason IS NULL AND event_timestamp_ms BETWEEN
  {AS_OF - 6 * HOUR - 5 * MINUTE} AND {AS_OF - 6 * HOUR}) AS ingested,
 (SELECT count(*) FROM checked WHERE dlq_reason IS NOT NULL AND event_timestamp_ms BETWEEN
  {AS_OF - 6 * HOUR - 5 * MINUTE} AND {AS_OF - 6 * HOUR}) AS dead_lettered,
 (SELECT count(*) FROM conv WHERE event_timestamp_ms BETWEEN
  {AS_OF - 6 * HOUR - 5 * MINUTE} AND {AS_OF - 6 * HOUR}) AS attributed""",
    "top_tenants": f"""SELECT tenant_id, count(*) AS cnt FROM valid
 WHERE event_timestamp_ms >= {AS_OF - DAY} AND event_timestamp_ms < {AS_OF}
 GROUP BY ALL ORDER BY cnt DESC, tenant_id LIMIT 10""",
    "watermark_lag": f"""SELECT source_partition, arrival_ms // {MINUTE} * {MINUTE} AS minute_ms,
 max(arrival_ms - seen) AS max_lag_ms, max(arrival_ms - seen) > 300000 AS alert FROM (
 SELECT *, max(event_timestamp_ms) OVER (PARTITION BY source_partition
  ORDER BY arrival_ms, seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS seen FROM ev )
 GROUP BY ALL""",
    "consumer_backlog": f"""SELECT source_partition, count(*) AS end_offset, lag, lag > 80 AS high,
 lag > 500 AS critical FROM (SELECT *, count(*) FILTER (arrival_ms > {AS_OF - DAY})
 OVER (PARTITION BY source_partition) AS lag FROM ev ) GROUP BY ALL""",
    "queries_per_tier": f"""SELECT tier, ts_ms // {MINUTE} * {MINUTE} AS minute_ms, count(*) AS n,
 CAST(count(*) AS DOUBLE) / 60 AS rate FROM routed GROUP BY ALL""",
    "retention_purge": "\nUNION ALL\n".join(
        f"""SELECT '{name}' AS dataset, CAST({DATE} AS VARCHAR) AS event_date, count(*) AS cnt
 FROM {table} WHERE event_timestamp_ms >= {AS_OF - keep} GROUP BY ALL"""
        for name, table, keep in (
            ("raw", "ev", DAY),
            ("dlq", "rejected", 7 * DAY),
            ("enriched", "enriched", HOUR),
            ("warm", "enriched", 30 * DAY),
        )
    ),
    "tenant_export": f"""SELECT {FLAT}, CAST({DATE} AS VARCHAR) AS event_date FROM enriched
 WHERE tenant_id = 'tenant_3' AND {DATE} BETWEEN DATE '2024-01-05' AND DATE '2024-01-20'""",
    "late_events": """SELECT seq, source_partition, event_timestamp_ms, arrival_ms, max_before
 FROM (SELECT *, max(event_timestamp_ms) OVER (PARTITION BY source_partition
  ORDER BY arrival_ms, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS max_before
  FROM ev ) WHERE max_before - event_timestamp_ms > 300000""",
    "late_upsert": f"""SELECT {FLAT} FROM (SELECT *, row_number() OVER (
 PARTITION BY tenant_id, event_id ORDER BY event_timestamp_ms, seq) AS rn FROM valid v WHERE arrival_ms - event_timestamp_ms >= 300000
 OR (tenant_id, {DATE}) IN (SELECT (tenant_id, {DATE}) FROM valid
   WHERE arrival_ms - event_timestamp_ms >= 300000)) WHERE rn = 1""",
}

# The lake holds pseudonyms in place of users.
LAKE_FLAT = FLAT.replace("user_id", f"{PSEUDONYM} AS user_id")
CTE["asked"] = f"""
SELECT seq AS request, tenant_id, campaign_id, metric, tier, from_ms, from_ms + {6 * HOUR} AS to_ms,
 CASE WHEN seq % 8 = 0 THEN {MINUTE} WHEN seq % 2 = 0 THEN {HOUR} ELSE {DAY} END AS step
FROM routed WHERE tenant_id <> ''
"""
_SAME = "x.tenant_id = r.tenant_id AND x.campaign_id = r.campaign_id AND x.event_type = r.metric"
CTE["answered"] = f"""
SELECT request, tier, bucket_ms, count(*) AS value FROM (
 SELECT request, tier, event_timestamp_ms // step * step AS bucket_ms FROM asked r
 JOIN enriched x ON {_SAME} WHERE (tier = 'warm' AND event_timestamp_ms BETWEEN from_ms AND to_ms)
 OR (tier = 'cold' AND event_timestamp_ms // {DAY} BETWEEN from_ms // {DAY} AND to_ms // {DAY})) GROUP BY ALL
UNION ALL SELECT request, tier, bucket_ms, cnt FROM asked r
 JOIN hot_series x ON {_SAME} WHERE tier = 'hot' AND bucket_ms BETWEEN from_ms AND to_ms
"""
_QUERIES["series_requests"] = f"""SELECT request, tier, bucket_ms, value FROM answered
UNION ALL SELECT request, tier, first + i * step, n // nb + CASE WHEN i = nb - 1 THEN n % nb ELSE 0 END FROM (
 SELECT *, unnest(range(nb)) AS i FROM (
  SELECT r.*, coalesce(x.cnt, 0) AS n, from_ms // step * step AS first,
   (to_ms - from_ms // step * step) // step + 1 AS nb
  FROM asked r LEFT JOIN warm_counts x ON {_SAME}
  WHERE tier <> 'cold' AND request NOT IN (SELECT request FROM answered )))"""
_BOUNDS = [1_000, 10_000, 60_000, 300_000, 900_000, HOUR, 3 * HOUR, 6 * HOUR, 12 * HOUR, DAY]
_EDGES = "[" + ", ".join(map(str, [0, *_BOUNDS, _BOUNDS[-1]])) + "]"
_LE = "CASE " + " ".join(f"WHEN duration_ms <= {b} THEN {i}" for i, b in enumerate(_BOUNDS)) + f" ELSE {len(_BOUNDS)} END"


def _in_bucket(p: float) -> str:
    low, high = f"CAST({_EDGES}[le + 1] AS DOUBLE)", f"CAST({_EDGES}[le + 2] AS DOUBLE)"
    return f"""round(max(CASE WHEN upto - cnt < n * CAST({p} AS DOUBLE) AND n * CAST({p} AS DOUBLE) <= upto
  THEN {low} + ({high} - {low}) * (n * CAST({p} AS DOUBLE) - (upto - cnt)) / cnt END), 3)"""


_QUERIES["latency_histogram_by_hour"] = f"""SELECT tenant_id, window_start_ms, n,
 {_in_bucket(0.5)} AS p50, {_in_bucket(0.95)} AS p95, {_in_bucket(0.99)} AS p99 FROM (
 SELECT *, CAST(sum(cnt) OVER (PARTITION BY tenant_id, window_start_ms ORDER BY le) AS BIGINT) AS upto,
  CAST(sum(cnt) OVER (PARTITION BY tenant_id, window_start_ms) AS BIGINT) AS n FROM (
  SELECT tenant_id, event_timestamp_ms // {HOUR} * {HOUR} AS window_start_ms, {_LE} AS le, count(*) AS cnt
  FROM conv GROUP BY ALL)) GROUP BY tenant_id, window_start_ms, n"""


def _held(rule: str, query: str, condition: str, group: str, step: int, hold: int) -> str:
    return f"""SELECT '{rule}' AS rule, {group} AS grp, window_start_ms AS at_ms, {step} AS step, {hold} AS hold
 FROM ({_QUERIES[query]}) WHERE {condition} AND window_start_ms <= {AS_OF - 2 * DAY}"""


_TICKS = " UNION ALL ".join(
    [
        _held("HighDlqRate", "dlq_rate", "warning", "tenant_id", MINUTE, 2 * MINUTE),
        _held("CriticalDlqRate", "dlq_rate", "critical", "tenant_id", MINUTE, MINUTE),
        _held("HighDedupDropRate", "dedup_drop_ratio", "alert", "''", MINUTE, 5 * MINUTE),
        _held("RedisCacheHitRateLow", "cache_hit_ratio", "alert", "''", MINUTE, 10 * MINUTE),
        _held("AttributionRateDrop", "attribution_gaps", "alert", "''", 15 * MINUTE, 30 * MINUTE),
    ]
)
_QUERIES["alert_episodes"] = f"""SELECT rule, grp, started_ms,
 CASE WHEN last_ms - started_ms >= hold THEN started_ms + hold END AS fired_ms,
 CASE WHEN last_ms + step <= {AS_OF - 2 * DAY} THEN last_ms + step END AS resolved_ms,
 CASE WHEN last_ms + step <= {AS_OF - 2 * DAY} THEN 'resolved' WHEN last_ms - started_ms >= hold THEN 'firing'
  ELSE 'pending' END AS state FROM (
 SELECT rule, grp, step, hold, min(at_ms) AS started_ms, max(at_ms) AS last_ms FROM (
  SELECT *, sum(CASE WHEN at_ms - before = step THEN 0 ELSE 1 END) OVER (
   PARTITION BY rule, grp ORDER BY at_ms ROWS UNBOUNDED PRECEDING) AS run FROM (
   SELECT *, lag(at_ms) OVER (PARTITION BY rule, grp ORDER BY at_ms) AS before FROM ({_TICKS})))
 GROUP BY rule, grp, step, hold, run)"""
_QUERIES["recon_runs"] = f"""SELECT run_id, "window", status, run_time_ms, window_start_ms, window_end_ms, campaigns,
 discrepancies, auto_patched, TRUE AS measured, FALSE AS explained FROM ({_QUERIES["recon_summary"]})
 UNION ALL SELECT 'hourly:{AS_OF - HOUR}', 'hourly', 'ERROR', {AS_OF - HOUR}, {AS_OF - 3 * HOUR}, {AS_OF - HOUR}, 0, 0, 0, TRUE, TRUE"""
_QUERIES["recon_run_metrics"] = "\nUNION ALL\n".join(
    f"""SELECT '{w}' AS "window", CAST({runs} AS BIGINT) AS runs, CAST({errors} AS BIGINT) AS errors, observed_store,
 count(*) FILTER (delta <> 0) AS discrepancies, count(*) FILTER (auto_patched) AS patches FROM {w} GROUP BY observed_store"""
    for w, runs, errors in (("hourly", 2, 1), ("daily", 1, 0))
)
_QUERIES["dlq_replay_runs"] = f"""SELECT "partition", "offset", key, dlq_reason, event_id, user_id, replayed,
 replayed AND {REASON} IS NOT NULL AS rejected_again FROM polled """
_QUERIES["avro_round_trip"] = """SELECT event_id, tenant_id, user_id, session_id, campaign_id, event_type,
 event_timestamp_ms, cost, CAST(NULL AS VARCHAR) AS dlq_reason FROM ev WHERE seq % 50 <> 0
 UNION ALL SELECT NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, 'Unreadable payload' FROM ev WHERE seq % 50 = 0"""
_QUERIES["store_build"] = f"""SELECT tenant_id, CAST({DATE} AS VARCHAR) AS event_date, count(*) AS cnt,
 {MONEY} AS sum_cost FROM enriched GROUP BY ALL"""
_QUERIES["cube_geo_totals"] = "SELECT geo_country, count(*) AS cnt FROM enriched GROUP BY ALL"
_LATE = "arrival_ms - event_timestamp_ms >= 300000"
_QUERIES["lake_upsert"] = f"""{_QUERIES["late_upsert"].replace(FLAT, LAKE_FLAT, 1)} UNION ALL
 SELECT {LAKE_FLAT} FROM valid WHERE NOT {_LATE} AND (tenant_id, {DATE}) NOT IN (
   SELECT (tenant_id, {DATE}) FROM valid WHERE {_LATE})"""
_QUERIES["lake_scan"] = f"""SELECT {LAKE_FLAT}, CAST({DATE} AS VARCHAR) AS event_date FROM enriched
 WHERE tenant_id = 'tenant_1'
 AND event_timestamp_ms BETWEEN {AS_OF - 12 * DAY} AND {AS_OF - 5 * DAY}"""
_QUERIES["lake_series"] = f"""SELECT {KEYS},
 event_timestamp_ms // {HOUR} * {HOUR} AS bucket_ms, count(*) AS value FROM countable
 WHERE tenant_id = 'tenant_1' AND event_timestamp_ms // {DAY}
 BETWEEN {(AS_OF - 20 * DAY) // DAY} AND {(AS_OF - 5 * DAY) // DAY} GROUP BY ALL"""
_QUERIES["lake_erase"] = f"""SELECT tenant_id, CAST({DATE} AS VARCHAR) AS event_date,
 count(*) AS cnt FROM enriched WHERE tenant_id <> 'tenant_1'
 AND event_timestamp_ms // {DAY} >= {(AS_OF - 7 * DAY) // DAY} GROUP BY ALL"""

# The streams: the same rows from the same events.
_NO_DEDUP = {name: CTE[name].replace("FROM kept", "FROM valid").replace("JOIN kept", "JOIN valid")
             for name in ("clicks_carts", "takers")}
CTE["clicks_carts_all"] = _NO_DEDUP["clicks_carts"]
CTE["takers_all"] = _NO_DEDUP["takers"].replace("FROM clicks_carts", "FROM clicks_carts_all")
CTE["conv_all"] = CTE["conv"].replace("FROM takers", "FROM takers_all")
CTE["alive_whole"] = CTE["alive"].replace(
    "FROM countable WHERE TRUE", "FROM valid WHERE campaign_id IS NOT NULL"
)
_QUERIES["stream_click_to_basket"] = _QUERIES["click_to_basket"].replace("conv", "conv_all")
_QUERIES["stream_counts"] = f"""SELECT {KEYS}, count(*) AS cnt FROM valid
 WHERE campaign_id IS NOT NULL GROUP BY ALL"""
_QUERIES["stream_unique_ids"] = "SELECT event_id FROM kept"
_QUERIES["stream_enriched"] = f"SELECT {FLAT}, duration_ms FROM enriched"
_QUERIES["stream_enriched_stateful"] = _QUERIES["stream_enriched"]
_QUERIES["stream_late"] = f"SELECT {FLAT} FROM valid WHERE arrival_ms - event_timestamp_ms > 300000"
_QUERIES["stream_hot_counters"] = f"SELECT {KEYS}, count(*) AS cnt FROM alive_whole GROUP BY ALL"


def oracle_sql() -> dict[str, str]:
    return {name: _sql(text) for name, text in _QUERIES.items()}
