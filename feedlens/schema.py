"""Storage schemas and the fixed vocabularies of the feedback model."""

from __future__ import annotations

from pyspark.sql import types as T

# The one stored table. Timestamps are naive UTC at second precision or finer.
FEEDBACK = T.StructType([
    T.StructField("id", T.LongType(), False),
    T.StructField("text", T.StringType(), False),
    T.StructField("source", T.StringType(), True),
    T.StructField("channel", T.StringType(), True),
    T.StructField("severity_hint", T.StringType(), True),
    T.StructField("user_tier", T.StringType(), True),
    T.StructField("tag", T.StringType(), True),
    T.StructField("sentiment", T.DoubleType(), True),
    T.StructField("urgency_score", T.DoubleType(), True),
    T.StructField("summary", T.StringType(), True),
    T.StructField("status", T.StringType(), True),
    T.StructField("created_at", T.TimestampNTZType(), True),
    T.StructField("analyzed_at", T.TimestampNTZType(), True),
    T.StructField("updated_at", T.TimestampNTZType(), True),
])

FEEDBACK_COLUMNS = [f.name for f in FEEDBACK.fields]

# Append-only change log; one schema for batch and readStream. A null value
# column in a patch means "untouched".
EVENTS = T.StructType([
    T.StructField("seq", T.LongType(), False),
    T.StructField("event_ts", T.TimestampNTZType(), False),
    T.StructField("op", T.StringType(), False),  # insert | analysis | patch | delete
    T.StructField("id", T.LongType(), False),
    T.StructField("text", T.StringType(), True),
    T.StructField("source", T.StringType(), True),
    T.StructField("channel", T.StringType(), True),
    T.StructField("severity_hint", T.StringType(), True),
    T.StructField("user_tier", T.StringType(), True),
    T.StructField("status", T.StringType(), True),
    T.StructField("tag", T.StringType(), True),
    T.StructField("sentiment", T.DoubleType(), True),
    T.StructField("urgency_score", T.DoubleType(), True),
    T.StructField("summary", T.StringType(), True),
])

EVENT_VALUE_COLUMNS = ["text", "source", "channel", "severity_hint", "user_tier", "status",
                       "tag", "sentiment", "urgency_score", "summary"]
ANALYSIS_COLUMNS = ["tag", "sentiment", "urgency_score", "summary"]

# --- Fixed values: these must equal the reference application's vocabularies. ---
# Tags the classifier may emit.
TAGS = ["Bug Report", "Feature Request", "Urgent", "Praise", "Security", "Performance", "Other"]
# Workflow statuses offered by the library view.
STATUSES = ["To Do", "in progress", "to be reviewed", "done"]
# Stakeholder groups of user tiers ("developer" is the spelling used in the seed rows).
EXTERNAL_TIERS = ["free", "pro", "business", "enterprise"]
INTERNAL_TIERS = ["dev", "developer", "tester", "team lead", "manager"]
# Tags whose resolution time is charted (task-like tags).
ACTIONABLE_TAGS = ["Bug Report", "Feature Request", "Urgent", "Security", "Performance"]
# Tag normaliser: lower-cased substring cascade, first hit wins, otherwise "Other".
TAG_KEYWORDS = [
    ("Urgent", ["urgent"]),
    ("Feature Request", ["feature"]),
    ("Bug Report", ["bug"]),
    ("Praise", ["praise", "love"]),
    ("Security", ["security", "auth", "vulnerability"]),
    ("Performance", ["performance", "slow", "timeout"]),
]
# Classifier fallbacks: sentiment range and default, urgency range and default,
# summary cut length (UTF-16 units in the reference; code points here).
SENTIMENT_RANGE = (-1.0, 1.0, 0.0)
URGENCY_RANGE = (0.0, 1.0, 0.2)
SUMMARY_MAX = 140
# Library view: newest rows shown; latest analysed rows feeding the narrative;
# search hits; urgency chart points; number of dates offered for digests.
LIBRARY_LIMIT = 100
LATEST_ANALYZED_LIMIT = 25
SEARCH_LIMIT = 20
URGENCY_LIMIT = 50
DATES_LIMIT = 30
# Digest freshness windows in seconds (summary bundle, daily digest).
SUMMARY_MAX_AGE_S = 300
DIGEST_MAX_AGE_S = 86400
# Our bound on one digest prompt (the reference sends a whole day at once):
# a day is cut into prompts of at most this many characters plus one line;
# every line is kept. A line "i. [tag] text" is weighed as its text and tag
# label plus DIGEST_LINE_OVERHEAD for the number (up to 19 digits), ". [",
# "] " and the newline, so the weight is never below the line's length.
DIGEST_PROMPT_CHARS = 400_000
DIGEST_LINE_OVERHEAD = 25
DEFAULT_STATUS = "To Do"
DEFAULT_SOURCE = "user"
DEFAULT_CHANNEL = "web"
DEFAULT_TIER = "free"
