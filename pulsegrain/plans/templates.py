"""Saved metrics as SQL with bound parameters.

Values are bound by Spark, never pasted into the text; the event frame is passed as ``{events}``.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession

TEMPLATES = {
    "total_events": """
        SELECT count(*) AS total_events FROM {events}
        WHERE project_id = :project_id AND timestamp >= :as_of - INTERVAL '30' DAY AND timestamp <= :as_of""",
    "daily_active_users": """
        SELECT to_date(timestamp) AS date, count(DISTINCT user_id) AS daily_active_users FROM {events}
        WHERE project_id = :project_id GROUP BY ALL ORDER BY date""",
    "event_counts": """
        SELECT event_name, count(*) AS event_count FROM {events}
        WHERE project_id = :project_id GROUP BY event_name ORDER BY event_count DESC, event_name""",
    "page_views": """
        SELECT coalesce(properties['page'], '') AS page, count(*) AS page_views FROM {events}
        WHERE project_id = :project_id AND event_name = 'page_view'
        GROUP BY ALL ORDER BY page_views DESC, page""",
    "top_engagement": """
        SELECT event_name, round(count(*) / count(DISTINCT user_id) * 100) / 100 AS events_per_user FROM {events}
        WHERE project_id = :project_id GROUP BY event_name
        ORDER BY events_per_user DESC, event_name LIMIT 5""",
    "conversion_by_platform": """
        SELECT platform, round(try_divide(count(DISTINCT CASE WHEN event_name = :goal THEN user_id END),
                                          count(DISTINCT user_id)) * 100 * 100) / 100 AS conversion_rate
        FROM {events} WHERE project_id = :project_id GROUP BY platform ORDER BY platform""",
    "inactive_users": """
        SELECT user_id, max(timestamp) AS last_seen FROM {events}
        WHERE project_id = :project_id GROUP BY user_id
        HAVING max(timestamp) < :as_of - INTERVAL '7' DAY ORDER BY last_seen, user_id""",
}


def run_template(spark: SparkSession, name: str, events: DataFrame, **args: str | dt.datetime) -> DataFrame:
    """Run a saved metric over ``events`` with its parameters bound by name."""
    return spark.sql(TEMPLATES[name], args=args, events=events)
