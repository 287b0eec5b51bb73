"""Campaign fields from URLs and device fields from user agents (definitions are ours)."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

UTM_KEYS = ("utm_source", "utm_medium", "utm_campaign", "utm_content", "utm_term")

# Fixed rules, first match wins.
TABLET = "(?i)ipad|tablet|android(?!.*mobile)"
MOBILE = "(?i)mobile|iphone|ipod|android"
BROWSERS = (("(?i)edg(e|a|ios)?/", "Edge"), ("(?i)opr/|opera", "Opera"), ("(?i)firefox|fxios", "Firefox"),
            ("(?i)chrome|crios", "Chrome"), ("(?i)safari", "Safari"))
SYSTEMS = (("(?i)windows", "Windows"), ("(?i)android", "Android"), ("(?i)iphone|ipad|ipod", "iOS"),
           ("(?i)mac os x|macintosh", "macOS"), ("(?i)linux|x11", "Linux"))


def _ladder(ua: Column, rules: tuple[tuple[str, str], ...]) -> Column:
    out = F.lit("Other")
    for pattern, name in reversed(rules):
        out = F.when(ua.rlike(pattern), F.lit(name)).otherwise(out)
    return out


def query_param(url: Column, key: str) -> Column:
    """A query parameter, '' when absent or when the URL cannot be parsed."""
    return F.coalesce(F.try_parse_url(url, F.lit("QUERY"), F.lit(key)), F.lit(""))


def url_host(url: Column) -> Column:
    return F.coalesce(F.try_parse_url(url, F.lit("HOST")), F.lit(""))


def device_type(ua: Column) -> Column:
    return F.when(ua.rlike(TABLET), "tablet").when(ua.rlike(MOBILE), "mobile").otherwise("desktop")


def browser(ua: Column) -> Column:
    return _ladder(ua, BROWSERS)


def operating_system(ua: Column) -> Column:
    return _ladder(ua, SYSTEMS)
