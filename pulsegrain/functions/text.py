"""Text clean-up, masking, and reading SQL out of logged replies."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Patterns, words and messages.
MARKUP_CHARS = "[<>'\"&]"
FENCED_SQL = "(?is)```sql\\n(.*?)\\n```"
BARE_FENCE = "(?is)```\\n(.*?)\\n```"
FIRST_SELECT = "(?is)(SELECT.*)"
FORBIDDEN_WORDS = ("drop", "delete", "update", "insert", "alter", "create")
NOT_SELECT = "Query must be a SELECT statement"
NO_PROJECT = "Query must include project_id filter for security"
FORBIDDEN = "Dangerous operation detected: "
NO_LIMIT = "Consider adding LIMIT clause for better performance"
NO_TIME_FILTER = "Consider adding timestamp filter for better performance"

# Dates (year-month-day) are no phone numbers, nor parts of one.
DATE = "\\b(?:19|20)[0-9]{2}-(?:0[1-9]|1[0-2])-(?:0[1-9]|[12][0-9]|3[01])\\b"
PHONE = "\\+?[0-9][0-9 ().-]{7,}[0-9]"
_OUTSIDE = "(?<![0-9])(?<!\\b(?:19|20)[0-9]{2}-)(?<!\\b(?:19|20)[0-9]{2}-[0-9]{2}-)"
PHONE_BESIDE_DATES = f"{_OUTSIDE}\\+?(?!{DATE})[0-9](?:(?!{DATE})[0-9 ().-]){{7,}}(?!{DATE})[0-9]"

# Personal data in free text (our own definitions), applied in this order: a text or a simple pattern that every match
# needs, the pattern, the tag.
PII_RULES = (
    ("@", "[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\\.[A-Za-z]{2,}", "[email]"),
    (".", "\\b[0-9]{1,3}\\.[0-9]{1,3}\\.[0-9]{1,3}\\.[0-9]{1,3}\\b", "[ip]"),
    (PHONE, PHONE_BESIDE_DATES, "[phone]"),
)


def sanitize_text(col: str | Column) -> Column:
    """Drop the markup characters ``< > ' " &``."""
    return F.regexp_replace(col, MARKUP_CHARS, "")


def mask_rule(col: Column, needed: str, pattern: str, tag: str) -> Column:
    """Replace one kind of personal data by its tag; a cheaper test spares most texts the pattern."""
    found = col.contains(needed) if len(needed) == 1 else col.rlike(needed)
    return F.when(found, F.regexp_replace(col, pattern, tag)).otherwise(col)


def _first_group(col: Column, pattern: str) -> Column:
    """Group 1 of the first match, NULL when the pattern does not occur."""
    return F.when(F.regexp_like(col, F.lit(pattern)), F.regexp_extract(col, pattern, 1))


def extract_sql(col: str | Column) -> Column:
    """The SQL in a reply: a ``sql`` fence, else any fence, else from the first SELECT, else all."""
    reply = F.col(col) if isinstance(col, str) else col
    picked = F.coalesce(*[_first_group(reply, p) for p in (FENCED_SQL, BARE_FENCE, FIRST_SELECT)], reply)
    stripped = F.regexp_replace(picked, "^\\s+|\\s+$", "")
    return F.regexp_replace(stripped, ";$", "")


def sql_errors(col: str | Column, strict: bool = False) -> Column:
    """Array of rule violations. ``strict`` matches the forbidden words as whole words only, so
    that a column such as ``created_at`` no longer counts as CREATE."""
    sql = F.col(col) if isinstance(col, str) else col
    lower = F.lower(sql)

    def forbidden(word: str) -> Column:
        return lower.rlike(f"\\b{word}\\b") if strict else lower.contains(word)

    checks = [F.when(~lower.contains("select"), F.lit(NOT_SELECT)),
              F.when(~sql.contains("project_id"), F.lit(NO_PROJECT))]
    checks += [F.when(forbidden(w), F.lit(FORBIDDEN + w.upper())) for w in FORBIDDEN_WORDS]
    return F.array_compact(F.array(*checks))


def sql_warnings(col: str | Column) -> Column:
    """Array of performance hints: no LIMIT, no time filter."""
    lower = F.lower(F.col(col) if isinstance(col, str) else col)
    timed = lower.contains("timestamp >=") | lower.contains("timestamp between")
    return F.array_compact(F.array(
        F.when(~lower.contains("limit"), F.lit(NO_LIMIT)), F.when(~timed, F.lit(NO_TIME_FILTER))))


def normalise_question(col: str | Column) -> Column:
    """Lower case, punctuation dropped, blanks collapsed: questions that differ only so are equal."""
    lower = F.lower(F.col(col) if isinstance(col, str) else col)
    return F.trim(F.regexp_replace(F.regexp_replace(lower, "[.,;:!?]", ""), "\\s+", " "))
