"""Recommendations, action maps, chat edits and text functions."""

import json
import re

import pytest
from pyspark.sql import functions as F

from tidewash.functions import text as X
from tidewash.operators import edits as E, recommend as R
from tidewash.plans import actions as A


def one(spark, expression, **columns):
    df = spark.range(1).select(*[F.lit(v).alias(k) for k, v in columns.items()])
    return df.select(expression.alias("v")).first()["v"]


@pytest.mark.parametrize("name, action", [
    ("paid", "drop"), ("Width", "drop"), ("Churned_Status", "keep"), ("n_name", "drop"), ("System_x", "drop"), ("Null_x", "drop"),
    ("duplicated", "drop"), ("my_DATE", "transform"), ("Sex", "transform"), ("sexy", "keep"), ("AGE", "transform"), ("ages", "keep"), ("", "keep"),
])
def test_rules(spark, name, action):
    row = R.recommend(spark.createDataFrame([(name,)], "column string"), "sell").first()
    assert row.action == action
    assert ("'sell'" in row.reason) == (name in ("paid", "Width"))
    assert (row.transformation is not None) == (action == "transform")


def test_goal_by_row(spark):
    df = spark.createDataFrame([("id", "g1"), ("id", "g{goal}")], "column string, goal string")
    assert [r.reason[-6:] for r in R.recommend(df, F.col("goal")).collect()] == [" 'g1'."[-6:], "oal}'."]


GOOD = [{"column": "a", "action": "drop", "reason": "r", "transformation": None}]


@pytest.mark.parametrize("text, usable, entries", [
    (json.dumps({"recommendations": GOOD}), True, 1),
    ("```json\n" + json.dumps({"recommendations": GOOD}) + "\n```", True, 1),
    ("  ```\n" + json.dumps({"recommendations": GOOD}, indent=2) + "\n``` ", True, 1),
    (json.dumps({"recommendations": [{"column": "a", "action": "drop", "reason": "r"}]}), False, None),
    (json.dumps({"recommendations": GOOD}) + " trailing", False, None),
    (json.dumps({"other": 1}), True, 0), (json.dumps({"recommendations": []}), True, 0),
    (json.dumps({"recommendations": None}), False, None), (json.dumps({"recommendations": {"a": 1}}), False, None),
    ("[1]", False, None), ("{}, {}", False, None), ("plain", False, None), ("", False, None), (None, False, None), ("```", False, None), ("null", False, None),
])
def test_answers(spark, text, usable, entries):
    row = R.parse_recommendations(spark.createDataFrame([(text,)], "answer string")).first()
    assert row.usable is usable
    assert (None if row.recommendations is None else len(row.recommendations)) == entries


def test_fallback_is_all_or_nothing(spark):
    columns = spark.createDataFrame([(d, i, c) for d in "xyz" for i, c in enumerate(["user_id", "fee"])], "dataset string, pos int, column string")
    bad = GOOD + [{"column": "b"}]
    answers = spark.createDataFrame([("x", json.dumps({"recommendations": GOOD})), ("y", json.dumps({"recommendations": bad}))], "dataset string, answer string")
    got = {(r.dataset, r.column, r.action, r.origin) for r in R.recommendations_or_rules(columns, answers, "g").collect()}
    assert got == {("x", "a", "drop", "model")} | {(d, c, a, "rules") for d in "yz" for c, a in (("user_id", "drop"), ("fee", "keep"))}


def test_model_hook_and_prompt(spark):
    context = spark.createDataFrame([("t", 1, "b", None), ("t", 0, "a", "x"), ("u", 0, "c", "y")], "dataset string, pos int, column string, reason string")
    prompts = R.prompt_payload(context, "win", ["column", "reason"])
    got = {r.dataset: r for r in R.ask_model(prompts, lambda texts: [t[::-1] for t in texts]).collect()}
    assert json.loads(got["t"].payload) == [{"column": "a", "reason": "x"}, {"column": "b", "reason": None}]
    assert "win" in got["t"].prompt and got["t"].answer == got["t"].prompt[::-1]


def test_summary(spark):
    rows = [("t", i, f"c{i}", "drop" if i % 2 else "keep") for i in range(9)] + [("u", 0, "a", "keep"), ("w", 0, "z", "drop")]
    df = spark.createDataFrame(rows, "dataset string, pos int, column string, action string")
    got = {r.dataset: (r.drops, r.examples, r.message) for r in R.plan_summary(df, "win").collect()}
    assert got["t"][:2] == (4, "c1, c3") and "**win**" in got["t"][2] and "dropping 4 irrelevant features (like c1, c3...)" in got["t"][2]
    assert got["u"][:2] == (0, "") and got["w"][:2] == (1, "z")


COLUMNS = ["User_ID", "Age", "Gender", "Note"]


@pytest.mark.parametrize("message, expected", [
    ("Please drop User_ID", {"User_ID": "drop"}), ("drop and keep Age", {"Age": "drop"}), ("Explain why column Age is kept", {}),
    ("please drop the manager", {"Age": "drop"}), ("RETAIN gender and age", {"Age": "keep", "Gender": "keep"}),
    ("encode gender", {"Gender": "transform"}), ("hello", {}), ("", {}),
])
def test_edit_requests(spark, message, expected):
    messages = spark.createDataFrame([("s", 0, message)], "session_id string, turn int, text string")
    names = spark.createDataFrame([(s, c) for s in "st" for c in COLUMNS], "session_id string, column string")
    for columns in (COLUMNS, names):
        got = E.edit_requests(messages, columns).collect()
        assert {r.column: r.action for r in got} == expected
        assert all((r.transformation == "Custom transform") == (r.action == "transform") for r in got)
    short = {r.column for r in E.edit_requests(messages, COLUMNS, keywords=E.SHORT_KEYWORDS).collect()}
    assert short == {c for c, a in expected.items() if a != "transform"}
    for style in E.REPLIES:
        reply = one(spark, E.reply_text(F.lit(message), COLUMNS, F.lit("win"), style))
        nothing = "No column changes" if style == "offline" else "**win**"
        assert (f"**{', '.join(expected)}**" if expected else nothing) in reply


def test_fold_prefers_the_latest_turn(spark):
    base = spark.createDataFrame([("s", "a", "keep", "b", None), ("s", "b", "keep", "b", "t")], "session_id string, column string, action string, reason string, transformation string")
    edits = spark.createDataFrame([("s", 3, "a", "drop", "x", None), ("s", 9, "a", "transform", "y", "z"), ("s", 5, "a", "keep", "w", None), ("s", 0, "c", "drop", "q", None)],
                                  "session_id string, turn int, column string, action string, reason string, transformation string")
    got = {r.column: (r.action, r.reason, r.transformation) for r in A.fold_edits(base, edits).collect()}
    assert got == {"a": ("transform", "y", "z"), "b": ("keep", "b", "t"), "c": ("drop", "q", None)}
    assert A.fold_edits(None, edits).count() == 2


def test_action_map_and_names(spark):
    rows = [("t", 0, "a", "keep"), ("t", 1, "b", "drop"), ("t", 2, "a", "drop")]
    df = spark.createDataFrame(rows, "dataset string, pos int, column string, action string").withColumns({"reason": F.lit(""), "transformation": F.lit(None).cast("string")})
    assert [(r.pos, r.column, r.action) for r in A.action_map(df).orderBy("pos").collect()] == [(0, "a", "drop"), (1, "b", "drop")]
    existing = spark.createDataFrame([("s", 0, "Age"), ("s", 1, "AGE"), ("s", 2, "x")], "session_id string, pos int, column string")
    edits = spark.createDataFrame([("s", "age"), ("s", "X"), ("s", "new"), ("r", "age")], "session_id string, column string")
    assert sorted(r.column for r in A.resolve_names(edits, existing).collect()) == ["Age", "age", "new", "x"]


def test_context_defaults(spark):
    columns = spark.createDataFrame([("t", "a"), ("t", "b"), ("t", "c")], "dataset string, column string")
    actions = spark.createDataFrame([("t", "a", "drop", None, None), ("t", "b", "keep", "why", "how")], "dataset string, column string, action string, reason string, transformation string")
    got = {r.column: (r.current_action, r.reason, r.transformation) for r in R.schema_context(columns, actions).collect()}
    assert got == {"a": ("drop", "", None), "b": ("keep", "why", "how"), "c": ("keep", "Default", "")}


@pytest.mark.parametrize("text, shown, updates", [
    ('Hi <<<SCHEMA_UPDATES>>> {"a": {"action": "drop"}} <<<END>>> x', "Hi", {"a": "drop"}),
    ("Hi <<<SCHEMA_UPDATES>>> {oops <<<END>>>", "Hi", None),
    ("  Hi <<<SCHEMA_UPDATES>>> {} ", "Hi <<<SCHEMA_UPDATES>>> {}", None),
    ("　Hi\n", "Hi", None),
    ('a<<<SCHEMA_UPDATES>>>{"x":{"action":"keep"}}<<<SCHEMA_UPDATES>>>{}<<<END>>>', "a", {"x": "keep"}),
    ("<<<END>>> a <<<SCHEMA_UPDATES>>>{}", "<<<END>>> a", {}),
])
def test_tagged_block(spark, text, shown, updates):
    row = E.parse_tagged_answer(spark.createDataFrame([(text,)], "text string")).first()
    assert row.message == shown
    assert (None if row.updates is None else {k: v.action for k, v in row.updates.items()}) == updates


def test_chat_answers(spark):
    texts = ['{"message": "ok", "schema_updates": {"a": {"action": "keep"}}}', '{"schema_updates": {}}', " plain ", '{"message": null}', "[1]"]
    rows = E.parse_chat_answer(spark.createDataFrame([(t,) for t in texts], "text string")).collect()
    assert [r.message for r in rows] == ["ok", E.DEFAULT_MESSAGE, "plain", None, "[1]"]
    assert [r.updates and list(r.updates) for r in rows] == [["a"], {}, None, None, None]


@pytest.mark.parametrize("tokens", [
    ["a ", "<<<SCHEMA", "_UPDATES>>>", "{}"], ["x<<<SCHEMA_UPDATES>>>", "y"], ["a", None, "b"], [], ["", "<<<SCHEMA_UPDATES>>", "", ">", "", "z"],
])
def test_visible_tokens_brute_force(spark, tokens):
    shown, full = [], ""
    for t in tokens:
        if t is None:
            continue
        full += t
        if X.START_TAG not in full:
            shown.append(t)
    df = spark.createDataFrame([(tokens,)], "t array<string>")
    assert df.select(X.visible_tokens(F.col("t")).alias("v")).first()["v"] == shown


def test_word_tokens(spark):
    assert one(spark, X.word_tokens(F.col("t")), t="a  b") == ["a ", " ", "b "]


def test_history(spark):
    rows = [("s", 0, "user", "a"), ("s", 1, "assistant", "b"), ("s", 2, "user", "c"), ("r", 5, "user", "z")]
    history = spark.createDataFrame(rows, "session_id string, turn bigint, role string, content string")
    got = E.model_messages(history, "SYS").filter("session_id = 's'").orderBy("pos").collect()
    assert [(r.role, r.content) for r in got] == [("system", "SYS"), ("user", "a"), ("assistant", "b"), ("user", "c")]
    told = E.model_messages(history, "SYS", inline=True).filter("session_id = 's'").orderBy("pos").collect()
    assert [r.content for r in told] == ["a", "b", "SYS\n\nUser message: c"]
    added = E.append_turns(history, spark.createDataFrame([("s", "user", "n"), ("new", "user", "m")], "session_id string, role string, content string"))
    assert {(r.session_id, r.turn) for r in added.filter("content in ('n', 'm')").collect()} == {("s", 3), ("new", 0)}
    turns = spark.createDataFrame([([("user", "a"), ("assistant", "b")],), ([],)], "h array<struct<role:string,content:string>>")
    arrays = [r[0] for r in turns.select(E.history_array(F.col("h"), F.lit("SYS"), F.lit("new"))).collect()]
    assert [[m.content for m in a] for a in arrays] == [["SYS", "a", "new"], ["SYS", "new"]]


@pytest.mark.parametrize("text, html", [
    ("**b** *i* `c`\n<a> & b", "<strong>b</strong> <em>i</em> <code>c</code><br>&lt;a&gt; &amp; b"),
    ("**a\nb** *x", "**a<br>b<em>* </em>x"), ("***x***", None),
])
def test_markdown(spark, text, html):
    if html is None:
        html = re.sub(r"\*(.+?)\*", r"<em>\1</em>", re.sub(r"\*\*(.+?)\*\*", r"<strong>\1</strong>", text))
    assert one(spark, X.markdown_html(F.col("t")), t=text) == html


@pytest.mark.parametrize("model, explicit, provider, qualified", [
    ("gpt-4o", None, "openai", "openai/gpt-4o"), ("claude-3-7-sonnet", None, "anthropic", "anthropic/claude-3-7-sonnet"),
    ("gemini-2.5-flash", None, "gemini", "gemini/gemini-2.5-flash"), ("openrouter/meta/llama3", None, "openrouter", "openrouter/meta/llama3"),
    ("ollama/llama3", None, "ollama", "ollama/llama3"), ("custom-claude-model", "anthropic", "anthropic", "anthropic/custom-claude-model"),
    (None, None, "nvidia", "openai/z-ai/glm-5.2"), ("x", "Other", "other", "x"),
])
def test_providers(spark, model, explicit, provider, qualified):
    df = spark.createDataFrame([(model, explicit)], "m string, e string").select(X.model_name(F.col("m")).alias("m"), "e")
    df = df.withColumn("p", X.provider_of(F.col("m"), F.col("e")))
    row = df.select("p", X.qualified_model(F.col("m"), F.col("p")).alias("q"), X.qualified_model(F.col("m"), F.col("p"), True).alias("u")).first()
    assert (row.p, row.q) == (provider, qualified)
    assert row.u == ("openai/x" if provider == "other" else qualified)


def test_rules_table_and_counts(spark):
    rows = [("t", 0, "a", None, None, None), ("t", 1, "b", "transform", "r", "x"), ("t", 2, "c", "drop", "r", "")]
    df = spark.createDataFrame(rows, "dataset string, pos int, column string, action string, reason string, transformation string")
    assert [(r.action, r.explanation) for r in A.rules_table(df).orderBy("pos").collect()] == [("KEEP", ""), ("TRANSFORM", "r (Transformation: x)"), ("DROP", "r")]
    assert tuple(A.action_counts(df).first()) == ("t", 3, 0, 1, 1)


def test_hot_session_by_brute_force(spark):
    rows = [("hot" if i % 3 == 0 else f"s{i % 50}", i, f"{('drop', 'hello', 'keep')[i % 3 if i % 2 else 0]} c{i % 7} c{i % 5}") for i in range(3000)]
    names = [(s, f"c{k}") for s in {r[0] for r in rows} for k in range(0, 7, 2)]
    want = {
        (s, t, c, "drop" if "drop" in text else "keep") for s, t, text in rows for n, c in names
        if n == s and c in text and ("drop" in text or "keep" in text)
    }
    messages = spark.createDataFrame(rows, "session_id string, turn int, text string").repartition(5)
    got = E.edit_requests(messages, spark.createDataFrame(names, "session_id string, column string")).collect()
    assert len(got) == len(want) and {(r.session_id, r.turn, r.column, r.action) for r in got} == want
    last = {}
    for s, t, c, a in sorted(want, key=lambda w: w[1]):
        last[s, c] = a
    folded = A.fold_edits(None, E.edit_requests(messages, spark.createDataFrame(names, "session_id string, column string")))
    assert {(r.session_id, r.column): r.action for r in folded.collect()} == last
