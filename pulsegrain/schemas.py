"""Explicit schemas; nothing is inferred on read."""

from __future__ import annotations

from pyspark.sql import types as T

S, I, L, B, TS = T.StringType(), T.IntegerType(), T.LongType(), T.BooleanType(), T.TimestampType()
PROPS = T.MapType(S, S)


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, dtype) for name, dtype in fields.items()])


EVENTS = _struct(
    id=S, project_id=S, user_id=S, session_id=S, event_name=S, properties=PROPS, timestamp=TS,
    ip=S, user_agent=S, platform=S, country=S, city=S, device_type=S, browser=S, os=S,
    screen_resolution=S, referrer=S, utm_source=S, utm_medium=S, utm_campaign=S,
    utm_content=S, utm_term=S)
EVENTS_PARTITIONED = T.StructType(EVENTS.fields + [T.StructField("event_month", S)])

# One event as clients send it. Both spellings (snake case with ISO time, camel case with epoch
# milliseconds) are read; property values stay raw JSON text until validated.
RAW_EVENT = _struct(
    user_id=S, userId=S, event_name=S, eventName=S, properties=S, timestamp=S,
    session_id=S, sessionId=S, platform=S)
# An envelope element is kept as text, so that one malformed event cannot null its neighbours.
ENVELOPE = _struct(events=T.ArrayType(S))

USERS = _struct(
    id=S, email=S, first_name=S, last_name=S, properties=PROPS, first_seen=TS, last_seen=TS,
    is_active=B, created_at=TS, updated_at=TS)
SESSIONS = _struct(
    id=S, user_id=S, session_start=TS, session_end=TS, duration_seconds=I, page_views=I,
    events_count=I, platform=S, device_info=PROPS, ip_address=S, user_agent=S, country=S,
    city=S, created_at=TS)
PROJECTS = _struct(
    id=S, name=S, api_key=S, description=S, settings=PROPS, created_by=S, is_active=B,
    created_at=TS, updated_at=TS)
API_KEYS = _struct(
    id=S, project_id=S, key_name=S, key_hash=S, permissions=PROPS, last_used_at=TS,
    expires_at=TS, is_active=B, created_at=TS)
DASHBOARDS = _struct(
    id=S, project_id=S, name=S, description=S, layout=S, filters=PROPS, is_public=B,
    created_by=S, created_at=TS, updated_at=TS)
AI_QUERIES = _struct(
    id=S, user_id=S, project_id=S, natural_language_query=S, generated_sql=S,
    execution_time_ms=I, result_count=I, error_message=S, context=PROPS, created_at=TS)

DIMENSIONS = {
    "users": USERS, "sessions": SESSIONS, "projects": PROJECTS, "api_keys": API_KEYS,
    "dashboards": DASHBOARDS, "ai_queries": AI_QUERIES}

# Fixed values.
PLATFORMS = ("web", "android", "ios")
MAX_NAME_LENGTH = 100
MAX_BATCH = 100
MAX_PROPERTIES = 50
MAX_PROPERTIES_CHARS = 10000
# \z and not $, which also matches before a last line break.
UUID_PATTERN = "^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}\\z"
STRICT_NAME_PATTERN = "^[a-zA-Z0-9_-]+\\z"
