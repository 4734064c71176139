"""Feedback scans: stored table (S1), seed fixture (S2) and the adapter view
that derives a feedback table from the driver-generated tables."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from feedlens import schema as S

PARTITION_COLUMN = "created_date"


def read_feedback(spark: SparkSession, path: str) -> DataFrame:
    """Scan a stored feedback table (Parquet, partitioned by ``created_date``).

    The schema is declared, never inferred; column pruning and filter pushdown
    reach the Parquet reader, and predicates on ``created_date`` prune folders.
    """
    table = T.StructType([*S.FEEDBACK.fields, T.StructField(PARTITION_COLUMN, T.DateType(), True)])
    return spark.read.schema(table).option("basePath", path).parquet(path)


def seed_feedback(spark: SparkSession, path: str | None = None) -> DataFrame:
    """The 35-row seed fixture (analysis columns partly filled, ``analyzed_at`` null)."""
    path = path or os.path.join(os.path.dirname(__file__), "..", "..", "tests", "fixtures", "seed_feedback.csv")
    raw = spark.read.option("header", True).csv(os.path.abspath(path))
    return raw.select(
        F.col("id").cast("long").alias("id"), "text", "source", "channel", "severity_hint", "user_tier", "tag",
        F.col("sentiment").cast("double").alias("sentiment"),
        F.col("urgency_score").cast("double").alias("urgency_score"),
        F.lit(None).cast("string").alias("summary"), "status",
        F.to_timestamp_ntz("created_at").alias("created_at"),
        F.lit(None).cast("timestamp_ntz").alias("analyzed_at"),
        F.to_timestamp_ntz("updated_at").alias("updated_at"),
    )


# --- Adapter view -------------------------------------------------------------
# The driver's tables carry no feedback table. This view derives one from
# ``events`` (one feedback row per event) and ``documents`` (the body text).
# Every event maps to document ``event_id % count(documents)``, so all
# documents are used. The fixed phrases below give the keyword classifier and
# the text search something to find; the driver's prose alone never matches.
TEXT_PHRASES = [  # indexed by event_id % 12
    "URGENT: checkout is down.", "Feature idea: dark theme.", "Bug when saving a draft.",
    "I love the new editor.", "Author page shows an error.", "Very slow on mobile.",
    "Login timeout again.", "Please debug the slow export, urgent.", "Discount of 50% is unclear.",
    "Path C:\\temp is rejected.", "Écran noir au démarrage.", "Nothing to add.",
]
CHANNEL_CYCLE = ["web", "discord", "github", "twitter", "email", "support", "slack"]        # event_id % 7
SEVERITY_CYCLE = ["low", "medium", "high"]                                                   # event_id % 3
TIER_CYCLE = ["free", "pro", "business", "enterprise", "dev", "tester", "team lead", "manager", None]  # user_id % 9
TAG_CYCLE = ["Bug Report", "Feature Request", "Urgent", "Praise", "Security", "Performance", "Other"]  # (id*31+user) % 7
STATUS_CYCLE = ["To Do", "in progress", "to be reviewed", "done"]                            # event_id % 4
RAW_RESPONSES = [  # event_id % 10
    "not json", '{"tag":"bug","sentiment":"0.4","urgency":0.9,"summary":"ok"}',
    '{"tag":null,"sentiment":null,"urgency":null}', '{"sentiment":7,"urgency_score":-3}',
    '{"tag":"Slow page","sentiment":"Infinity","urgency":"abc","summary":5}',
    '{"urgency":null,"urgency_score":null}', '{"sentiment":"","urgency":true}',
    '{"sentiment":"0x10","urgency":"1f"}', "[]", None,
]


def _cycle(key, values):
    """``values[key]`` as one constant-array lookup (keeps generated code small)."""
    arr = F.array(*[F.lit(v) if v is not None else F.lit(None).cast("string") for v in values])
    return F.element_at(arr, (key + 1).cast("int"))


#: Least bytes of a scan that are worth a task of their own.
SPREAD_BYTES = 128 * 1024


def spread(df: DataFrame) -> DataFrame:
    """``df`` over as many tasks as the session runs at once, if its scan has fewer splits.

    For narrow rows in front of costly expressions. A scan of many splits - any
    large table - stays as it is; a small one in a single split would leave all
    but one core idle.
    """
    query = df._jdf.queryExecution()
    wanted = min(df.sparkSession.sparkContext.defaultParallelism, int(str(query.optimizedPlan().stats().sizeInBytes())) // SPREAD_BYTES)
    return df.repartition(wanted) if query.toRdd().getNumPartitions() < wanted else df


#: Bytes of text that a task of the join with the documents gives, about: what follows can sort them in memory.
TASK_TEXT_BYTES = 128 << 20


def _text_tasks(ev: DataFrame, docs: DataFrame) -> int:
    """Tasks that share the texts of ``ev``, one document each: the documents' files (as Parquet packs text, half its size)
    give their mean length, and a join by document repeats them."""
    stored, n = int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())), max(1, docs.count())
    return -(-ev.count() * 2 * stored // (n * TASK_TEXT_BYTES))


def feedback_from_tables(spark: SparkSession, sf_dir: str, with_text: bool = True,
                         with_raw_response: bool = False, keep: tuple[str, ...] = (),
                         only: DataFrame | None = None, spread_out: bool | None = None, joined: DataFrame | None = None) -> DataFrame:
    """Feedback rows derived from ``events`` (+ ``documents`` for the text).

    ``keep`` adds raw events columns as ``ev_<name>``; ``only`` (a frame with
    ``id``) keeps those rows before any text is joined; ``joined`` (a frame with
    ``id``) is the view joined with that frame by id, its other columns behind
    the view's, and again the texts come last.

    ``with_text=False`` skips the documents join altogether: the join is on a
    unique key (one document per event) so it never changes the row set, and
    operators that do not read ``text`` should not pay for it.
    ``spread_out`` (default: with texts or responses) calls ``spread`` for
    what follows the scan.
    """
    ev = spark.read.parquet(f"{sf_dir}/events.parquet")
    if (with_text or with_raw_response) if spread_out is None else spread_out:
        ev = spread(ev.select("event_id", "user_id", "ts", "event_type", "props"))
    if only is not None:
        ev = ev.join(only.select(F.col("id").alias("_only")), F.col("event_id") == F.col("_only"), "left_semi")
    if joined is not None:
        ev = ev.join(joined.withColumnRenamed("id", "_joined"), F.col("event_id") == F.col("_joined")).drop("_joined")
    eid, uid, ts = F.col("event_id"), F.col("user_id"), F.col("ts")
    pending = (eid % 17) == 0
    cols = {
        "id": eid,
        "source": F.concat(F.lit("user_"), uid.cast("string")),
        "channel": _cycle(eid % 7, CHANNEL_CYCLE),
        "severity_hint": _cycle(eid % 3, SEVERITY_CYCLE),
        "user_tier": _cycle(uid % 9, TIER_CYCLE),
        "tag": F.when(~pending, _cycle((eid * 31 + uid) % 7, TAG_CYCLE)),
        "sentiment": F.when(~pending, ((eid * 37) % 201 - 100).cast("double") / 100),
        "urgency_score": F.when(~pending, F.regexp_extract("props", "[0-9]+", 0).cast("double") / 100),
        "summary": F.lit(None).cast("string"),
        "status": _cycle(eid % 4, STATUS_CYCLE),
        "created_at": ts,
        "analyzed_at": F.when(~pending, F.timestamp_add("MINUTE", F.lit(1), ts)),
        "updated_at": F.when((eid % 3) == 0, ts).otherwise(F.timestamp_add("MINUTE", (eid % 240) * 37, ts)),
    }
    if with_raw_response:
        cols["raw_response"] = _cycle(eid % 10, RAW_RESPONSES)
    if with_text:
        docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.col("text").alias("_doc_text"))
        n_docs = docs.select(F.count(F.lit(1))).scalar()
        tasks = _text_tasks(spark.read.parquet(f"{sf_dir}/events.parquet"), docs) if only is None else 1
        if tasks > spark.sparkContext.defaultParallelism:
            docs, ev = docs.repartition(tasks, "doc_id"), ev.repartition(tasks, eid % n_docs)
        ev = ev.join(docs, docs["doc_id"] == eid % n_docs, "left")
        cols["text"] = F.concat(_cycle(eid % 12, TEXT_PHRASES), F.lit(" "), F.col("_doc_text"))
    order = [c for c in S.FEEDBACK_COLUMNS if c in cols] + (["raw_response"] if with_raw_response else [])
    more = [] if joined is None else [c for c in joined.columns if c != "id"]
    return ev.select(*[cols[c].alias(c) for c in order], *[F.col(c).alias(f"ev_{c}") for c in keep], *more)


# --- Derived request streams (for ingest / change-log queries) -------------------
def ingest_requests_from_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw new-feedback request bodies derived from ``conversations``: user
    turns are plain submissions, assistant turns exercise tier fallbacks,
    system turns send a non-string ``feedback`` (rejected)."""
    cv = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    role = F.col("role")
    channel = _cycle(F.col("conv_id") % 3, ["discord", "github", "email"])
    body = (F.when(role == "system", F.to_json(F.struct(F.col("turn").alias("feedback"))))
            .when(role == "user", F.to_json(F.struct(F.col("text").alias("feedback"), role.alias("source"),
                                                     channel.alias("channel"))))
            .otherwise(F.to_json(F.struct(F.col("text").alias("feedback"), F.lit("").alias("tier"),
                                          F.lit("pro").alias("user_tier"), F.lit("low").alias("severity_hint")))))
    return cv.select("conv_id", "turn", body.alias("value"))


def change_requests_from_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw change requests (op, id_text, body) derived from ``events``: error
    events delete, the others patch with bodies that cover the reference's
    patch rules and quirks; signups carry an unparsable id."""
    ev = spark.read.parquet(f"{sf_dir}/events.parquet")
    et, eid = F.col("event_type"), F.col("event_id")
    op = F.when(et == "error", F.lit("delete")).otherwise(F.lit("patch"))
    id_text = (F.when(et == "view", F.concat(F.lit(" "), (eid / 2).cast("long").cast("string"), F.lit("abc")))
               .when(et == "signup", F.concat(F.lit("x"), eid.cast("string")))
               .otherwise(eid.cast("string")))
    body = (F.when(et == "click", F.to_json(F.struct(F.lit("done").alias("status"),
                                                     (F.col("value") / 100).alias("sentiment"))))
            .when(et == "purchase", F.to_json(F.struct(F.lit("Praise").alias("tag"), F.lit("  ").alias("text"))))
            .when(et == "view", F.to_json(F.struct(F.lit(" B ").alias("text"), F.lit("").alias("tag"))))
            .when(et == "signup", F.to_json(F.struct(F.lit("0.5").alias("sentiment"))))
            .otherwise(F.lit(None).cast("string")))
    return ev.select(eid.alias("request_id"), op.alias("op"), id_text.alias("id_text"), body.alias("body"))


def conversation_changes_from_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw change requests on ingested conversations: request n, from the first
    turn of conversation n - 1, changes feedback n in one of the reference's six ways."""
    n = F.col("conv_id") + 1
    first = spark.read.parquet(f"{sf_dir}/conversations.parquet").where("turn = 0")
    kind = F.col("conv_id") % 6
    body = (F.when(kind == 0, F.to_json(F.struct(F.concat(F.lit(" edited "), n.cast("string"), F.lit("\t")).alias("text"))))
            .when(kind == 1, F.to_json(F.struct(((F.col("conv_id") % 21 - 10) / 8).alias("sentiment"))))
            .when(kind == 2, F.to_json(F.struct(F.lit("both").alias("text"), F.lit("Praise").alias("tag"))))
            .when(kind == 4, F.lit('{"status":"To Do","status":"done"}'))  # the last of repeated keys counts
            .when(kind == 5, F.to_json(F.struct(F.lit("Security").alias("tag")))))
    return first.select(n.alias("request_id"), F.when(kind == 3, F.lit("delete")).otherwise(F.lit("patch")).alias("op"),
                        n.cast("string").alias("id_text"), body.alias("body"))


def change_log_from_tables(spark: SparkSession, sf_dir: str, with_text: bool = True, joined: DataFrame | None = None) -> DataFrame:
    """An event log (``schema.EVENTS``) derived from the tables: every
    feedback row is inserted, analysed if it has ``analyzed_at``, moved to
    its status if not "To Do"; error events delete their row; click events
    patch the tag of row ``event_id / 2`` later on; signup events patch an
    id that was never inserted; view events send a patch with no effective
    column.

    Two scans: inserts (with text) from the feedback view; every other
    kind from one narrow scan where each events row emits the array of its
    log events (a null element where a kind does not apply), exploded.
    ``with_text=False`` leaves the inserts' texts null and joins no documents.
    ``joined`` (a frame with ``id`` and ``seq``): the log's rows that have a text, the inserts, joined with that frame
    by both, its other columns behind the log's; the texts come last, so no exchange behind that join carries them."""
    def ev(cond, **vals):
        # as text: a struct of 14 columns costs one call instead of fifty
        fields = ", ".join(f"'{f.name}', CAST({vals.get(f.name, 'NULL')} AS {f.dataType.simpleString()})" for f in S.EVENTS.fields)
        return F.expr(f"CASE WHEN {cond} THEN named_struct({fields}) END")

    seq = "id * 8"
    fb = feedback_from_tables(spark, sf_dir, with_text=with_text, joined=None if joined is None else joined.withColumnRenamed("seq", "_j_seq"))
    if joined is not None:
        fb = fb.where(F.expr(seq) == F.col("_j_seq"))
    more = [] if joined is None else [c for c in joined.columns if c not in ("id", "seq")]
    ins = fb.select(ev("TRUE", seq=seq, event_ts="created_at", op="'insert'", id="id", status=f"'{S.DEFAULT_STATUS}'",
                       **{c: c for c in ("text", "source", "channel", "severity_hint", "user_tier") if c in fb.columns}).alias("e"), *more).select("e.*", *more)
    if joined is not None:
        return ins
    narrow = feedback_from_tables(spark, sf_dir, with_text=False, keep=("event_type", "ts"), spread_out=True)
    kinds = [
        ev("analyzed_at IS NOT NULL", seq="id * 8 + 1", event_ts="analyzed_at", op="'analysis'", id="id", tag="tag", sentiment="sentiment",
           urgency_score="urgency_score", summary="''"),
        ev(f"status <> '{S.DEFAULT_STATUS}'", seq="id * 8 + 2", event_ts="updated_at", op="'patch'", id="id", status="status"),
        ev("ev_event_type = 'error'", seq="id * 8 + 3", event_ts="ev_ts", op="'delete'", id="id"),
        ev("ev_event_type = 'click'", seq="id * 8 + 4", event_ts="timestampadd(HOUR, 1, ev_ts)", op="'patch'", id="id div 2", tag="'Praise'"),
        ev("ev_event_type = 'signup'", seq="id * 8 + 5", event_ts="ev_ts", op="'patch'", id="id + 1000000000000", status="'done'"),
        ev("ev_event_type = 'view'", seq="id * 8 + 6", event_ts="timestampadd(DAY, 2, ev_ts)", op="'patch'", id="id"),
    ]
    rest = narrow.select(F.explode(F.filter(F.array(*kinds), lambda x: x.isNotNull())).alias("e")).select("e.*")
    return ins.unionByName(rest)
