"""Event model: column names, explicit schemas and fixed vocabularies."""

from __future__ import annotations

from pyspark.sql import types as T

# The recognised event types.
EVENT_TYPES = [
    "IMPRESSION",
    "CLICK",
    "PRODUCT_VIEW",
    "ADD_TO_CART",
    "PURCHASE",
    "CLICK_TO_BASKET",
]
UNSPECIFIED = "UNSPECIFIED"
CONVERSION = "CLICK_TO_BASKET"

# The metrics that the read side serves.
METRICS = ["CLICK", "IMPRESSION", "CLICK_TO_BASKET"]

# Grains of a time series.
GRAINS = ["minute", "hour", "day"]

# Names of the three serving tiers.
HOT, WARM, COLD = "hot", "warm", "cold"

COUNT_KEYS = ["tenant_id", "campaign_id", "event_type"]

# (event time, arrival number) is the total order that breaks every tie.
ORDER = ["event_timestamp_ms", "seq"]

EVENT_SCHEMA = T.StructType(
    [
        T.StructField("event_id", T.StringType()),
        T.StructField("tenant_id", T.StringType()),
        T.StructField("user_id", T.StringType()),
        T.StructField("session_id", T.StringType()),
        T.StructField("campaign_id", T.StringType()),
        T.StructField("event_type", T.StringType()),
        T.StructField("event_timestamp_ms", T.LongType()),
        T.StructField("cost", T.DoubleType()),
        T.StructField("custom_tags", T.MapType(T.StringType(), T.StringType())),
        T.StructField("placement_id", T.StringType()),
        T.StructField("geo_country", T.StringType()),
        T.StructField("device_type", T.StringType()),
        T.StructField("arrival_ms", T.LongType()),
        T.StructField("seq", T.LongType()),
    ]
)
EVENT_COLUMNS = EVENT_SCHEMA.fieldNames()

# The wire record: nine fields, camelCase, tags default to the empty map.
WIRE_AVRO_SCHEMA = """
{"type": "record", "name": "ShoppingEvent", "fields": [
  {"name": "eventId", "type": "string"},
  {"name": "tenantId", "type": "string"},
  {"name": "userId", "type": ["null", "string"], "default": null},
  {"name": "sessionId", "type": ["null", "string"], "default": null},
  {"name": "campaignId", "type": ["null", "string"], "default": null},
  {"name": "eventType", "type": "string"},
  {"name": "eventTimestampMs", "type": "long"},
  {"name": "cost", "type": "double", "default": 0.0},
  {"name": "customTags", "type": {"type": "map", "values": "string"}, "default": {}}
]}
"""

# wire field -> column
WIRE_FIELDS = {
    "eventId": "event_id",
    "tenantId": "tenant_id",
    "userId": "user_id",
    "sessionId": "session_id",
    "campaignId": "campaign_id",
    "eventType": "event_type",
    "eventTimestampMs": "event_timestamp_ms",
    "cost": "cost",
    "customTags": "custom_tags",
}

WIRE_SCHEMA = T.StructType(
    [T.StructField(wire, EVENT_SCHEMA[column].dataType) for wire, column in WIRE_FIELDS.items()]
)
