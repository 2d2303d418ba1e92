"""Chat edits, answers and histories on the conversations."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tidewash.functions import text as X
from tidewash.operators import edits as E, recommend as R
from tidewash.plans import actions as A
from workload.registry import query, table

_COLUMNS = ["User_ID", "Age", "Gender", "Registration_Date", "Subscription_Fee"]

# The conversations hold none of the keywords, so both sides put one in front.
_MESSAGES_SQL = """SELECT conv_id AS session_id, turn, CASE turn % 5 WHEN 0 THEN 'Please DROP ' WHEN 1 THEN 'retain ' WHEN 2 THEN 'Encode '
    WHEN 3 THEN 'explain why not ' ELSE 'drop and keep ' END || ['user_id', 'Age', 'gender', 'registration_date', 'fees'][CAST((conv_id + turn) % 5 + 1 AS INTEGER)]
    || ' ' || text AS text FROM conversations"""


def _messages(spark, sf) -> DataFrame:
    t = F.col("turn")
    ask = (
        F.when(t % 5 == 0, "Please DROP ").when(t % 5 == 1, "retain ").when(t % 5 == 2, "Encode ")
        .when(t % 5 == 3, "explain why not ").otherwise("drop and keep ")
    )
    names = F.array(*[F.lit(n) for n in ("user_id", "Age", "gender", "registration_date", "fees")])
    name = F.get(names, ((F.col("conv_id") + t) % 5).cast("int"))
    return table(spark, sf, "conversations").select(
        F.col("conv_id").alias("session_id"), "turn", F.concat(ask, name, F.lit(" "), F.col("text")).alias("text")
    )


# Fixed values, written out here so that the SQL does not share them with the code under test.
_FULL_SQL = [
    ("drop", ("drop", "remove", "delete", "eliminate"), "Dropped by user request in chat.", None),
    ("keep", ("keep", "add", "retain", "include"), "Kept by user request in chat.", None),
    ("transform", ("transform", "convert", "encode", "impute"), "Transform requested in chat.", "Custom transform"),
]
_SHORT_SQL = [
    ("drop", ("drop", "remove", "delete"), "Dropped by user in chat (fallback).", None),
    ("keep", ("keep", "retain", "include"), "Kept by user in chat (fallback).", None),
]


def _edits_sql(columns: str, on: str, keywords=_FULL_SQL) -> str:
    case = lambda i: "CASE " + " ".join(
        "WHEN " + " OR ".join(f"contains(lower(text), '{w}')" for w in k[1]) + " THEN "
        + ("CAST(NULL AS VARCHAR)" if k[i] is None else f"'{k[i]}'") for k in keywords
    ) + " END"
    return f"""SELECT m.session_id, m.turn, c."column", {case(0)} AS action, {case(2)} AS reason, {case(3)} AS transformation
      FROM ({_MESSAGES_SQL}) m JOIN {columns} c ON {on} AND contains(lower(m.text), lower(c."column")) WHERE {case(0)} IS NOT NULL"""


_LIST_SQL = "(SELECT * FROM (VALUES " + ", ".join(f"('{c}')" for c in _COLUMNS) + ') AS v("column"))'
_LIST_EDITS = _edits_sql(_LIST_SQL, "true")


@query("edit_requests", _LIST_EDITS)
def edit_requests(spark, sf):
    return E.edit_requests(_messages(spark, sf), _COLUMNS).drop("text")


@query("edit_requests_short", _edits_sql(_LIST_SQL, "true", _SHORT_SQL))
def edit_requests_short(spark, sf):
    return E.edit_requests(_messages(spark, sf), _COLUMNS, keywords=E.SHORT_KEYWORDS).drop("text")


@query("edit_requests_per_session", _edits_sql(
    """(SELECT DISTINCT conv_id AS session_id, role AS "column" FROM conversations UNION ALL SELECT DISTINCT conv_id, 'Age' FROM conversations)""",
    "m.session_id = c.session_id"))
def edit_requests_per_session(spark, sf):
    """Each session has its own columns: the roles that speak in it, and Age."""
    turns = table(spark, sf, "conversations")
    session = F.col("conv_id").alias("session_id")
    columns = turns.select(session, F.col("role").alias("column")).distinct().unionByName(
        turns.select(session).distinct().withColumn("column", F.lit("Age"))
    )
    return E.edit_requests(_messages(spark, sf), columns).drop("text")


@query("fold_edits", f"""
    WITH e AS ({_LIST_EDITS} UNION ALL SELECT DISTINCT conv_id, -1, 'Age', 'keep', 'base', NULL FROM conversations
      UNION ALL SELECT DISTINCT conv_id, -1, 'Churned', 'keep', 'base', NULL FROM conversations),
    r AS (SELECT *, row_number() OVER (PARTITION BY session_id, "column" ORDER BY turn DESC) AS n FROM e)
    SELECT session_id, "column", action, reason, transformation FROM r WHERE n = 1""")
def fold_edits(spark, sf):
    messages = _messages(spark, sf)
    base = messages.select("session_id").distinct().select(
        "session_id", F.explode(F.array(F.lit("Age"), F.lit("Churned"))).alias("column"),
        F.lit("keep").alias("action"), F.lit("base").alias("reason"), F.lit(None).cast("string").alias("transformation"),
    )
    return A.fold_edits(base, E.edit_requests(messages, _COLUMNS))


@query("fold_answers", """
    SELECT conv_id AS session_id, 'Age' AS "column", 'keep' AS action, 'second' AS reason, CAST(NULL AS VARCHAR) AS transformation
    FROM conversations GROUP BY conv_id
    UNION ALL SELECT conv_id, 'fee', 'transform', 'turn ' || max(turn), 'again' FROM conversations GROUP BY conv_id
    UNION ALL SELECT conv_id, 'other', 'keep', 'base', NULL FROM conversations GROUP BY conv_id""")
def fold_answers(spark, sf):
    """Answers that name a column in two spellings, and names twice: a name's last entry counts, at the place of its first."""
    entry = lambda name, action, reason, extra: F.concat(
        F.lit(f'"{name}": {{"action": "{action}", "reason": "'), reason, F.lit(f'", "transformation": {extra}}}'))
    told = F.concat(F.lit("turn "), F.col("turn").cast("string"))
    block = F.concat(
        F.lit("{"), entry("AGE", "drop", F.lit("first"), "null"), F.lit(", "), entry("Fee", "drop", F.lit("x"), "null"), F.lit(", "),
        entry("age", "keep", F.lit("second"), "null"), F.lit(", "), entry("Fee", "transform", told, '"again"'), F.lit(", "),
        entry("AGE", "transform", F.lit("third"), "null"), F.lit("}"),
    )
    turns = table(spark, sf, "conversations")
    answers = turns.select(
        F.col("conv_id").alias("session_id"), "turn", F.concat("text", F.lit("<<<SCHEMA_UPDATES>>>"), block, F.lit("<<<END>>>")).alias("text")
    )
    names = F.array(*[F.struct(F.lit(k).alias("pos"), F.lit(n).alias("column")) for k, n in enumerate(("Age", "fee", "other"))])
    base = turns.select(F.col("conv_id").alias("session_id")).distinct().select("session_id", F.inline(names))
    edits = E.update_rows(E.parse_tagged_answer(answers), ["session_id", "turn"])
    actions = base.select(
        "session_id", "column", F.lit("keep").alias("action"), F.lit("base").alias("reason"), F.lit(None).cast("string").alias("transformation")
    )
    return A.fold_edits(actions, A.resolve_names(edits, base))


@query("resolve_names", f"""
    WITH e AS ({_LIST_EDITS}), k AS (SELECT DISTINCT conv_id AS session_id FROM conversations)
    SELECT e.session_id, turn, CASE WHEN e."column" = 'Age' AND e.session_id % 2 = 0 THEN 'AGE' WHEN e."column" = 'Gender' THEN 'gender'
      ELSE e."column" END AS "column", action FROM e""")
def resolve_names(spark, sf):
    messages = _messages(spark, sf)
    names = F.array(
        F.struct(F.lit(0).alias("pos"), F.lit("gender").alias("column")),
        F.struct(F.lit(1).alias("pos"), F.lit("GENDER").alias("column")),
        F.struct(F.lit(2).alias("pos"), F.when(F.col("session_id") % 2 == 0, "AGE").otherwise("other").alias("column")),
    )
    existing = messages.select("session_id").distinct().select("session_id", F.inline(names))
    edits = E.edit_requests(messages, _COLUMNS)
    return A.resolve_names(edits, existing).select("session_id", "turn", "column", "action")


def _tagged(spark, sf) -> DataFrame:
    """Streamed answers: with a block, without an end tag, with bad JSON, without tags."""
    k = F.col("doc_id")
    block = F.concat(F.lit('{"'), F.col("source"), F.lit('": {"action": "drop", "reason": "asked", "transformation": null}}'))
    tail = (
        F.when(k % 4 == 0, F.concat(F.lit(" <<<SCHEMA_UPDATES>>>\n"), block, F.lit("\n<<<END>>> bye")))
        .when(k % 4 == 1, F.concat(F.lit("<<<SCHEMA_UPDATES>>>"), block))
        .when(k % 4 == 2, F.lit("<<<SCHEMA_UPDATES>>>{oops<<<END>>>"))
        .otherwise(F.lit("  "))
    )
    return table(spark, sf, "documents").select("doc_id", F.concat("text", tail).alias("text"), "source")


_BLANKS = r"[\s\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"
_STRIP = lambda e: f"regexp_replace(regexp_replace({e}, '^{_BLANKS}', ''), '{_BLANKS}$', '')"


@query("tagged_answers", f"""
    SELECT doc_id, {_STRIP("CASE WHEN doc_id % 4 = 1 THEN text || '<<<SCHEMA_UPDATES>>>{\"' || source || '\": {\"action\": \"drop\", \"reason\": \"asked\", \"transformation\": null}}' ELSE text END")} AS message,
      CASE WHEN doc_id % 4 = 0 THEN source END AS "column", CASE WHEN doc_id % 4 = 0 THEN 'drop' END AS action FROM documents""")
def tagged_answers(spark, sf):
    parsed = E.parse_tagged_answer(_tagged(spark, sf))
    one = F.get(F.map_entries("updates"), F.lit(0))
    return parsed.select("doc_id", "message", one["key"].alias("column"), one["value"]["action"].alias("action"))


@query("tagged_updates", """
    SELECT doc_id, source AS "column", 'drop' AS action, 'asked' AS reason, CAST(NULL AS VARCHAR) AS transformation, CAST(0 AS INTEGER) AS pos FROM documents WHERE doc_id % 4 = 0""")
def tagged_updates(spark, sf):
    return E.update_rows(E.parse_tagged_answer(_tagged(spark, sf)), ["doc_id"])


@query("word_tokens", """
    SELECT doc_id, CAST(unnest(range(len(w))) AS INTEGER) AS pos, unnest(w) || ' ' AS token FROM (SELECT doc_id, string_split(text, ' ') AS w FROM documents)""")
def word_tokens(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.posexplode(X.word_tokens(F.col("text"))).alias("pos", "token"))


@query("visible_tokens", """
    WITH m AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN text ELSE left(text, CAST(length(text) // 2 AS BIGINT)) || '<<<SCHEMA_UPDATES>>>' || substr(text, length(text) // 2 + 1) END AS text FROM documents),
    t AS (SELECT doc_id, unnest(range(len(w))) AS pos, unnest(w) || ' ' AS token, full_text, instr(full_text, '<<<SCHEMA_UPDATES>>>') AS tag_at FROM
      (SELECT doc_id, string_split(text, ' ') AS w, array_to_string([x || ' ' for x in string_split(text, ' ')], '') AS full_text FROM m)),
    c AS (SELECT *, sum(length(token)) OVER (PARTITION BY doc_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS upto FROM t)
    SELECT doc_id, count(*) FILTER (tag_at = 0 OR upto < tag_at + 19) AS shown,
      CAST(coalesce(sum(length(token)) FILTER (tag_at = 0 OR upto < tag_at + 19), 0) AS BIGINT) AS chars FROM c GROUP BY doc_id""")
def visible_tokens(spark, sf):
    half = F.floor(F.length("text") / 2).cast("int")
    marked = F.concat(F.substr("text", F.lit(1), half), F.lit("<<<SCHEMA_UPDATES>>>"), F.substr("text", half + 1))
    answers = table(spark, sf, "documents").select(
        "doc_id", F.when(F.col("doc_id") % 3 == 0, F.col("text")).otherwise(marked).alias("text")
    )
    shown = answers.select("doc_id", X.visible_tokens(X.word_tokens(F.col("text"))).alias("tokens"))
    return shown.select(
        "doc_id", F.size("tokens").cast("bigint").alias("shown"), F.length(F.array_join("tokens", "")).cast("bigint").alias("chars")
    )


def _history(spark, sf) -> DataFrame:
    return table(spark, sf, "conversations").select(
        F.col("conv_id").alias("session_id"), "turn", "role", F.col("text").alias("content")
    )


@query("model_messages", """
    SELECT conv_id AS session_id, turn + 1 AS pos, CASE WHEN turn = max(turn) OVER (PARTITION BY conv_id) THEN 'user' ELSE role END AS role, text AS content FROM conversations
    UNION ALL SELECT DISTINCT conv_id, 0, 'system', 'You clean tables.' FROM conversations""")
def model_messages(spark, sf):
    return E.model_messages(_history(spark, sf), "You clean tables.")


@query("model_messages_inline", """
    SELECT conv_id AS session_id, turn + 1 AS pos, CASE WHEN newest THEN 'user' ELSE role END AS role,
      CASE WHEN newest THEN 'You clean tables.' || chr(10) || chr(10) || 'User message: ' || text ELSE text END AS content
    FROM (SELECT *, turn = max(turn) OVER (PARTITION BY conv_id) AS newest FROM conversations)""")
def model_messages_inline(spark, sf):
    return E.model_messages(_history(spark, sf), "You clean tables.", inline=True)


@query("reply_text", f"""
    WITH e AS ({_LIST_EDITS}), p AS (SELECT * FROM (VALUES {", ".join(f"('{c}', {i})" for i, c in enumerate(_COLUMNS))}) AS v("column", n)),
    r AS (SELECT session_id, turn, string_agg(e."column", ', ' ORDER BY n) AS names FROM e JOIN p ON p."column" = e."column" GROUP BY session_id, turn)
    SELECT m.session_id, m.turn, CASE WHEN names IS NULL THEN 'I''m here to help with your goal: **goal ' || m.session_id || '**. You can ask me to keep, drop, or transform any specific column by name.'
      ELSE 'Done! I''ve updated the action for **' || names || '**. The schema grid on the right has been refreshed.' END AS reply
    FROM ({_MESSAGES_SQL}) m LEFT JOIN r ON r.session_id = m.session_id AND r.turn = m.turn""")
def reply_text(spark, sf):
    goal = F.concat(F.lit("goal "), F.col("session_id").cast("string"))
    return _messages(spark, sf).select("session_id", "turn", E.reply_text(F.col("text"), _COLUMNS, goal).alias("reply"))


@query("offline_replies", """
    SELECT conv_id AS session_id, turn,
      'Goal set: **' || text || '**.<br>Using mock offline recommendations. I suggest dropping redundant columns. You can edit the suggestions in the grid.' AS intro,
      '⚠️ Streaming API unavailable (' || left(text, 60) || '). Changes applied via local rule engine.' AS failed FROM conversations""")
def offline_replies(spark, sf):
    said = table(spark, sf, "conversations")
    return said.select(
        F.col("conv_id").alias("session_id"), "turn", R.rules_intro(F.col("text")).alias("intro"), E.failed_stream_reply(F.col("text")).alias("failed")
    )


@query("append_turns", """
    SELECT conv_id AS session_id, turn, role, text AS content FROM conversations
    UNION ALL SELECT conv_id, max(turn) + 1, 'assistant', 'noted' FROM conversations GROUP BY conv_id""")
def append_turns(spark, sf):
    history = _history(spark, sf)
    new = history.select("session_id").distinct().select("session_id", F.lit("assistant").alias("role"), F.lit("noted").alias("content"))
    return E.append_turns(history, new)


@query("chat_answers", f"""
    SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'done' WHEN 1 THEN 'I have processed your request.' WHEN 2 THEN {_STRIP("text")}
        ELSE {_STRIP("text || ' {oops'")} END AS message,
      CASE WHEN doc_id % 4 = 0 THEN source END AS "column" FROM documents""")
def chat_answers(spark, sf):
    k = F.col("doc_id")
    answer = (
        F.when(k % 4 == 0, F.concat(F.lit('```\n{"message": "done", "schema_updates": {"'), F.col("source"), F.lit('": {"action": "keep"}}}\n```')))
        .when(k % 4 == 1, F.lit('{"schema_updates": {}}'))
        .when(k % 4 == 2, F.concat(F.lit("\n "), F.col("text")))
        .otherwise(F.concat("text", F.lit(" {oops")))
    )
    parsed = E.parse_chat_answer(table(spark, sf, "documents").select("doc_id", answer.alias("text"), "source"))
    return parsed.select("doc_id", "message", F.get(F.map_keys("updates"), F.lit(0)).alias("column"))
