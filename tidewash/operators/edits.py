"""Action edits from chat messages, and the texts of the conversation around them."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from tidewash.functions.parsing import strip
from tidewash.functions.text import json_answer, tagged_updates, visible_text
from tidewash.operators.joins import spread_join

# The words that ask for an action, first group found wins, and
# the reason and transformation an edit from that group carries.
FULL_KEYWORDS = (
    ("drop", ("drop", "remove", "delete", "eliminate"), "Dropped by user request in chat.", None),
    ("keep", ("keep", "add", "retain", "include"), "Kept by user request in chat.", None),
    ("transform", ("transform", "convert", "encode", "impute"), "Transform requested in chat.", "Custom transform"),
)
SHORT_KEYWORDS = (
    ("drop", ("drop", "remove", "delete"), "Dropped by user in chat (fallback).", None),
    ("keep", ("keep", "retain", "include"), "Kept by user in chat (fallback).", None),
)

# The replies (done, nothing done) of the chat, of its streamed
# form, and of the chat while no model can be reached. %s is the list of updated
# columns, or the goal.
REPLIES = {
    "chat": (
        "Done! I've updated the action for **%s**. The schema grid on the right has been refreshed.",
        "I'm here to help with your goal: **%s**. You can ask me to keep, drop, or transform any specific column by name.",
    ),
    "stream": (
        "Done! I've updated the action for **%s**. The schema grid has been refreshed.",
        "I'm here to help with your goal: **%s**. Mention a column name with 'drop', 'keep', or 'transform' to make changes.",
    ),
    "offline": (
        "⚠️ AI API unavailable. Applied local parsing. Updated: **%s**.",
        "⚠️ AI API unavailable. Applied local parsing. No column changes detected. "
        "Try mentioning a column name with 'drop', 'keep', or 'transform'.",
    ),
}
# The answer of a stream that failed, with the beginning of the error.
FAILED_STREAM = "⚠️ Streaming API unavailable (%s). Changes applied via local rule engine."
ERROR_CHARS = 60
DEFAULT_MESSAGE = "I have processed your request."

_NAMES, _LOWERED = "_names", "_lowered"
EDIT_FIELDS = ("action", "reason", "transformation")


def requested_action(message: Column, keywords=FULL_KEYWORDS) -> Column:
    """The action of the first keyword group that occurs in the message, else null."""
    lowered = F.lower(message)
    chosen = F.when(F.lit(False), F.lit(None).cast("string"))
    for action, words, _, _ in keywords:
        found = reduce(lambda a, b: a | b, [F.contains(lowered, F.lit(w)) for w in words])
        chosen = chosen.when(found, F.lit(action))
    return chosen.otherwise(F.lit(None))


def mentioned_columns(message: Column, columns: Sequence[str]) -> Column:
    """The column names that occur in the message, in column order, ignoring case."""
    names = F.array(*[F.lit(c) for c in columns]).cast("array<string>")
    return F.filter(names, lambda c: F.contains(F.lower(message), F.lower(c)))


def _edit_texts(edits: DataFrame, keywords) -> DataFrame:
    reason = F.create_map(*[F.lit(x) for k in keywords for x in (k[0], k[2])])
    text = F.create_map(*[F.lit(x).cast("string") for k in keywords for x in (k[0], k[3])])
    return edits.withColumn("reason", reason[F.col("action")]).withColumn("transformation", text[F.col("action")])


def edit_requests(
    messages: DataFrame,
    columns: Sequence[str] | DataFrame,
    text: str = "text",
    by: Sequence[str] = ("session_id",),
    keywords=FULL_KEYWORDS,
) -> DataFrame:
    """One row per message and mentioned column, with the action that is asked for.

    ``columns`` is the column list of the one table that is discussed, or a
    frame with the ``by`` keys and one row per ``column`` where sessions discuss
    different tables. A list needs no join at all. Of a frame, each session's
    names, no more than its table is wide, become one row, which meets the
    session's messages, spread for long sessions; so a message is not joined
    with every name, and only messages that ask for something take part.
    """
    asking = messages.withColumn("action", requested_action(F.col(text), keywords)).filter(F.col("action").isNotNull())
    if isinstance(columns, DataFrame):
        names = columns.groupBy(*by).agg(F.collect_list(F.struct("column", F.lower("column").alias("lowered"))).alias(_NAMES))
        met = spread_join(asking.withColumn(_LOWERED, F.lower(F.col(text))), names, list(by))
        found = F.filter(_NAMES, lambda n: F.contains(F.col(_LOWERED), n["lowered"]))
        edits = met.withColumn("column", F.explode(F.transform(found, lambda n: n["column"]))).drop(_NAMES, _LOWERED)
    else:
        edits = asking.withColumn("column", F.explode(mentioned_columns(F.col(text), columns)))
    return _edit_texts(edits, keywords)


def reply_text(message: Column, columns: Sequence[str], goal: Column, style: str = "chat", keywords=FULL_KEYWORDS) -> Column:
    """The answer to a message: the names that were updated, or a help text."""
    done, nothing = REPLIES[style]
    updated = F.when(requested_action(message, keywords).isNotNull(), mentioned_columns(message, columns))
    names = F.array_join(F.nullif(updated, F.array().cast("array<string>")), ", ")
    helped = F.format_string(nothing, goal) if "%s" in nothing else F.lit(nothing)
    return F.when(names.isNotNull(), F.format_string(done, names)).otherwise(helped)


def failed_stream_reply(error: Column) -> Column:
    """The answer where the model's stream broke off and keywords were used instead."""
    return F.format_string(FAILED_STREAM, F.substring(error, 1, ERROR_CHARS))


# -- model answers in chat ------------------------------------------------------

def parse_chat_answer(answers: DataFrame, text: str = "text") -> DataFrame:
    """Adds `message` and `updates` of a JSON chat answer.

    Text that is not a JSON object is itself the message, trimmed, without updates.
    """
    document = json_answer(F.col(text))
    keys = F.json_object_keys(F.col("document"))
    updates = F.from_json(
        F.col("document"),
        "schema_updates map<string,struct<action:string,reason:string,transformation:string>>",
        {"allowSingleQuotes": "false"},
    )["schema_updates"]
    is_object = F.col("keys").isNotNull()
    said = F.when(F.array_contains(F.col("keys"), "message"), F.get_json_object("document", "$.message"))
    return (
        answers.withColumn("document", document)
        .withColumn("keys", keys)
        .withColumn(
            "message",
            F.when(is_object & F.array_contains(F.col("keys"), "message"), said)
            .when(is_object, F.lit(DEFAULT_MESSAGE))
            .otherwise(strip(F.col(text))),
        )
        .withColumn("updates", F.when(is_object, updates))
        .drop("document", "keys")
    )


def parse_tagged_answer(answers: DataFrame, text: str = "text") -> DataFrame:
    """Adds `message` and `updates` of a streamed answer with a tagged block."""
    return answers.withColumn("message", visible_text(F.col(text))).withColumn("updates", tagged_updates(F.col(text)))


def update_rows(parsed: DataFrame, keep: Sequence[str]) -> DataFrame:
    """The updates of parsed answers as edits, one row per column, with its place in the answer.

    Of a name that an answer repeats the last entry counts, at the place of the first.
    """
    entries = F.map_entries("updates")
    rows = parsed.select(*keep, F.map_keys("updates").alias("names"), F.posexplode(entries).alias("pos", "update"))
    later = F.slice("names", F.col("pos") + 2, F.size("names"))
    return rows.where(~F.array_contains(later, F.col("update.key"))).select(
        *keep, F.col("update.key").alias("column"), *[F.col("update.value")[f].alias(f) for f in EDIT_FIELDS],
        (F.array_position("names", F.col("update.key")) - 1).cast("int").alias("pos"),
    )


# -- history --------------------------------------------------------------------

def append_turns(history: DataFrame, new: DataFrame, by: Sequence[str] = ("session_id",)) -> DataFrame:
    """History plus one new message per session, numbered behind its last turn."""
    by = list(by)
    last = history.groupBy(*by).agg(F.max("turn").alias("last"))
    added = new.join(last, by, "left").withColumn("turn", F.coalesce(F.col("last") + 1, F.lit(0)).cast("bigint"))
    return history.select(*by, "turn", "role", "content").unionByName(added.select(*by, "turn", "role", "content"))


def model_messages(
    history: DataFrame, system: str | Column | None = None, by: Sequence[str] = ("session_id",), inline: bool = False
) -> DataFrame:
    """The messages a model gets, as rows (`pos`, `role`, `content`) per session.

    The history without its newest turn, then the newest message. The system
    text comes first as a turn of its own, or stands before the newest message
    (``inline``). Rows stay rows: no conversation is gathered, and the newest
    turn is matched on session and turn, which spreads long conversations.
    """
    by = list(by)
    newest = history.groupBy(*by).agg(F.max("turn").alias("turn")).withColumn("newest", F.lit(True))
    marked = history.join(newest, [*by, "turn"], "left")
    told = F.lit(system) if isinstance(system, str) else system
    rows = marked.select(*by, (F.col("turn") + 1).cast("bigint").alias("pos"), "role", "content", "newest")
    if inline:
        joined = F.concat(told, F.lit("\n\nUser message: "), F.col("content"))
        rows = rows.withColumn("role", F.when(F.col("newest"), F.lit("user")).otherwise(F.col("role")))
        return rows.withColumn("content", F.when(F.col("newest"), joined).otherwise(F.col("content"))).drop("newest")
    rows = rows.withColumn("role", F.when(F.col("newest"), F.lit("user")).otherwise(F.col("role"))).drop("newest")
    first = newest.select(*by, F.lit(0).cast("bigint").alias("pos"), F.lit("system").alias("role"), told.alias("content"))
    return first.unionByName(rows)


def history_array(history: Column, system: Column, message: Column) -> Column:
    """The same for a session record that holds its history as an array."""
    turn = lambda role, content: F.struct(F.lit(role).alias("role"), content.alias("content"))
    earlier = F.slice(history, F.lit(1), F.greatest(F.size(history) - 1, F.lit(0)))
    return F.concat(F.array(turn("system", system)), earlier, F.array(turn("user", message)))
