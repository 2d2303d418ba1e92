"""Recommendations: rules, action maps, prompts, model answers."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from tidewash.operators import profile as P, recommend as R
from tidewash.plans import actions as A
from tidewash.session import shared_folder
from workload.registry import query, table

_GOAL = "predict churn"


# Fixed values, written out here so that the SQL does not share them with the code under test:
# condition on the lower-cased name, action, reason, transformation.
_RULES_SQL = [
    ("contains(n, 'id') OR contains(n, 'hash')", "drop",
     "Useless random identifier. High cardinality and zero correlation to goal 'predict churn'.", None),
    ("contains(n, 'name')", "drop", "Personally identifiable information (PII) that doesn't aid model training.", None),
    ("contains(n, 'noise') OR contains(n, 'system')", "drop", "Synthetic noise column representing non-predictive random signals.", None),
    ("contains(n, 'empty') OR contains(n, 'null')", "drop", "Empty column with 100% missing values.", None),
    ("contains(n, 'duplicated')", "drop", "Duplicate copy of fee column. Redundant features cause multicollinearity.", None),
    ("contains(n, 'date')", "transform",
     "Date string needs to be parsed to allow extraction of chronological metrics like tenure.", "Convert to datetime object"),
    ("n IN ('gender', 'sex')", "transform",
     "Categorical string column with missing values. Requires imputation and label encoding.", "Impute missing with mode and label encode"),
    ("n IN ('age', 'income')", "transform",
     "Numeric column containing missing values that need numerical imputation.", "Impute missing values using column median"),
    ("n IN ('churn', 'churned', 'churned_status', 'status')", "keep", "Direct target label representing the classification outcome.", None),
    ("true", "keep", "Key numerical or categorical feature directly relevant to predicting user behavior.", None),
]


def _rule_case(column: str, field: int) -> str:
    """The rules as one SQL CASE; field 0 action, 1 reason, 2 transformation."""
    shown = lambda v: "CAST(NULL AS VARCHAR)" if v is None else "'" + v.replace("'", "''") + "'"
    parts = [f"WHEN {test.replace('n, ', f'lower({column}), ').replace('n IN', f'lower({column}) IN')} THEN {shown(rule[field])}"
             for test, *rule in _RULES_SQL]
    return "CASE " + " ".join(parts) + " END"


def _words(spark, sf) -> DataFrame:
    """Every word of every document as a column name of the table `doc_id`."""
    return table(spark, sf, "documents").select(
        F.col("doc_id").alias("dataset"), F.posexplode(F.split("text", " ")).alias("pos", "column")
    )


_WORDS_SQL = """(SELECT doc_id AS dataset, unnest(range(len(w))) AS pos, unnest(w) AS "column" FROM
    (SELECT doc_id, string_split(text, ' ') AS w FROM documents))"""


# Words made into names that reach every rule.
_NAMED_SQL = f"""(SELECT CASE pos % 12 WHEN 0 THEN "column" || '_Noise' WHEN 1 THEN 'EMPTY ' || "column" WHEN 2 THEN 'Duplicated' || "column"
    WHEN 3 THEN 'Gender' WHEN 4 THEN 'income' WHEN 5 THEN 'Churned_Status' WHEN 6 THEN "column" || '_Date' WHEN 7 THEN 'First' || "column" || 'Name'
    WHEN 8 THEN 'Hash_' || "column" WHEN 9 THEN 'SEX' WHEN 10 THEN 'Age' ELSE "column" END AS "column" FROM {_WORDS_SQL})"""


@query("rule_recommend", f"""
    SELECT "column", count(*) AS uses, {_rule_case('"column"', 0)} AS action, {_rule_case('"column"', 1)} AS reason,
      {_rule_case('"column"', 2)} AS transformation FROM {_NAMED_SQL} GROUP BY "column" """)
def rule_recommend(spark, sf):
    """A catalogue of names, counted first, so each distinct name is decided once."""
    k, word = F.col("pos") % 12, F.col("column")
    name = (
        F.when(k == 0, F.concat(word, F.lit("_Noise"))).when(k == 1, F.concat(F.lit("EMPTY "), word)).when(k == 2, F.concat(F.lit("Duplicated"), word))
        .when(k == 3, "Gender").when(k == 4, "income").when(k == 5, "Churned_Status").when(k == 6, F.concat(word, F.lit("_Date")))
        .when(k == 7, F.concat(F.lit("First"), word, F.lit("Name"))).when(k == 8, F.concat(F.lit("Hash_"), word)).when(k == 9, "SEX").when(k == 10, "Age")
        .otherwise(word)
    )
    names = _words(spark, sf).groupBy(name.alias("column")).agg(F.count(F.lit(1)).alias("uses"))
    return R.recommend(names, _GOAL)


_ANALYZED = {
    "customer": ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"],
    "orders": ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"],
    "part": ["p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice"],
}


def _analysis(spark, sf) -> DataFrame:
    frames = []
    for name in _ANALYZED:
        df = table(spark, sf, name)
        summary = P.column_counts(df).withColumnRenamed("column_name", "column")
        frames.append(R.recommend(summary, _GOAL).withColumn("dataset", F.lit(name)))
    return reduce(DataFrame.unionByName, frames)


_ANALYSIS_SQL = "\nUNION ALL ".join(
    f"""SELECT '{t}' AS dataset, CAST({i} AS INTEGER) AS pos, '{c}' AS "column", count(*) AS row_count, count(DISTINCT {c}) AS unique_values_count,
      {_rule_case(f"'{c}'", 0)} AS action, {_rule_case(f"'{c}'", 2)} AS transformation FROM {t}"""
    for t, columns in _ANALYZED.items() for i, c in enumerate(columns)
)


@query("analyze_tables", _ANALYSIS_SQL)
def analyze_tables(spark, sf):
    return _analysis(spark, sf).select(
        "dataset", "pos", "column", "row_count", "unique_values_count", "action", "transformation"
    )


_REPEATED_SQL = """SELECT lang AS dataset, doc_id AS pos, source AS "column",
    CASE doc_id % 3 WHEN 0 THEN 'drop' WHEN 1 THEN 'keep' ELSE 'transform' END AS action,
    'r' || doc_id AS reason, CASE WHEN doc_id % 3 = 2 THEN source END AS transformation FROM documents"""


def _repeated(spark, sf) -> DataFrame:
    k = F.col("doc_id")
    return table(spark, sf, "documents").select(
        F.col("lang").alias("dataset"), k.alias("pos"), F.col("source").alias("column"),
        F.when(k % 3 == 0, "drop").when(k % 3 == 1, "keep").otherwise("transform").alias("action"),
        F.concat(F.lit("r"), k.cast("string")).alias("reason"),
        F.when(k % 3 == 2, F.col("source")).alias("transformation"),
    )


@query("action_map", f"""
    WITH t AS ({_REPEATED_SQL}), k AS (SELECT dataset, "column", min(pos) AS first, max(pos) AS last FROM t GROUP BY ALL)
    SELECT k.dataset, k.first AS pos, k."column", t.action, t.reason, t.transformation
    FROM k JOIN t ON t.dataset = k.dataset AND t."column" = k."column" AND t.pos = k.last""")
def action_map(spark, sf):
    return A.action_map(_repeated(spark, sf))


@query("action_counts", f"""
    SELECT dataset, count(*) AS total, count(*) FILTER (action = 'keep') AS keep, count(*) FILTER (action = 'drop') AS "drop",
      count(*) FILTER (action = 'transform') AS transform FROM ({_REPEATED_SQL}) GROUP BY dataset""")
def action_counts(spark, sf):
    return A.action_counts(_repeated(spark, sf))


@query("plan_summary", f"""
    WITH r AS (SELECT *, {_rule_case('"column"', 0)} AS action FROM {_WORDS_SQL}),
    d AS (SELECT *, row_number() OVER (PARTITION BY dataset ORDER BY pos) AS n FROM r WHERE action = 'drop'),
    s AS (SELECT dataset, count(*) FILTER (action = 'drop') AS drops FROM r GROUP BY dataset),
    e AS (SELECT s.dataset, drops, concat_ws(', ', (SELECT "column" FROM d WHERE n = 1 AND d.dataset = s.dataset),
            (SELECT "column" FROM d WHERE n = 2 AND d.dataset = s.dataset)) AS examples FROM s)
    SELECT *, 'Goal set: **{_GOAL}**.<br>I have completed scanning the dataset. I recommend dropping ' || drops || ' irrelevant features (like ' || examples
      || '...) to prepare for your modeling objective. Let me know if you want to make overrides.' AS message FROM e""")
def plan_summary(spark, sf):
    return R.plan_summary(R.recommend(_words(spark, sf), _GOAL), _GOAL)


_CONTEXT_SQL = """
    SELECT c.conv_id AS dataset, c.turn AS pos, 'turn_' || c.turn AS "column", c.role AS type, length(c.text) AS null_count,
      CASE WHEN c.turn % 2 = 0 THEN CASE WHEN length(c.text) % 2 = 0 THEN 'drop' ELSE 'transform' END ELSE 'keep' END AS current_action,
      CASE WHEN c.turn % 2 = 0 THEN CASE WHEN c.turn % 4 = 0 THEN '' ELSE 'because' END ELSE 'Default' END AS reason,
      CASE WHEN c.turn % 2 = 0 THEN CASE WHEN length(c.text) % 2 = 1 THEN 'to text' END ELSE '' END AS transformation
    FROM conversations c"""


def _context(spark, sf) -> DataFrame:
    turns = table(spark, sf, "conversations")
    key = [F.col("conv_id").alias("dataset"), F.concat(F.lit("turn_"), F.col("turn").cast("string")).alias("column")]
    chars = F.length("text")
    columns = turns.select(*key, F.col("turn").alias("pos"), F.col("role").alias("type"), chars.cast("bigint").alias("null_count"))
    actions = turns.filter("turn % 2 = 0").select(
        *key,
        F.when(chars % 2 == 0, "drop").otherwise("transform").alias("action"),
        F.when(F.col("turn") % 4 != 0, "because").alias("reason"),
        F.when(chars % 2 == 1, "to text").alias("transformation"),
    )
    return R.schema_context(columns, actions)


@query("schema_context", _CONTEXT_SQL)
def schema_context(spark, sf):
    return _context(spark, sf)


_PAYLOAD_FIELDS = ["column", "data_type", "row_count", "unique_values_count", "action", "transformation"]
_SPARK_TYPES = {
    "c_custkey": "bigint", "c_name": "string", "c_nationkey": "int", "c_acctbal": "double", "c_mktsegment": "string",
    "o_orderkey": "bigint", "o_custkey": "bigint", "o_orderstatus": "string", "o_totalprice": "double",
    "o_orderdate": "timestamp_ntz", "o_orderpriority": "string",
    "p_partkey": "bigint", "p_name": "string", "p_brand": "string", "p_type": "string", "p_size": "int", "p_retailprice": "double",
}


@query("prompt_payload", f"""
    WITH a AS ({_ANALYSIS_SQL}), j AS (SELECT dataset, '[' || string_agg('{{"column":"' || "column" || '","data_type":"'
      || CASE {" ".join(f"WHEN a.column = '{c}' THEN '{t}'" for c, t in _SPARK_TYPES.items())} END || '","row_count":' || row_count
      || ',"unique_values_count":' || unique_values_count || ',"action":"' || action || '","transformation":'
      || coalesce('"' || transformation || '"', 'null') || '}}', ',' ORDER BY pos) || ']' AS payload FROM a GROUP BY dataset)
    SELECT dataset, payload, 'Goal: {_GOAL}' || chr(10) || 'Columns:' || chr(10) || payload AS prompt FROM j""")
def prompt_payload(spark, sf):
    return R.prompt_payload(_analysis(spark, sf), _GOAL, _PAYLOAD_FIELDS)


@query("model_answers", "SELECT doc_id, length(text) || ' ' || upper(left(text, 1)) AS answer FROM documents")
def model_answers(spark, sf):
    """The batch call with a stand-in for the model, which is asked once for each text.

    The SQL maps one letter to one letter, so a letter whose upper case is several ("SS", "FI")
    takes its capital, where it has one, or stays.
    """
    prompts = table(spark, sf, "documents").select("doc_id", F.col("text").alias("prompt"))

    def upper(letter: str) -> str:
        forms = [letter.upper(), "\u1e9e" if letter == "\xdf" else letter.title(), letter]
        return next(form for form in forms if len(form) == len(letter))

    stand_in = lambda texts: [None if t is None else f"{len(t)} {upper(t[:1])}" for t in texts]
    return R.ask_model(prompts, stand_in, store=shared_folder(spark, "answers"), rounds=2).select("doc_id", "answer")


def _answers(spark, sf) -> DataFrame:
    """One made-up answer per document: fenced, bare, plain text, incomplete, trailing text, no list."""
    k, word = F.col("doc_id"), F.col("source")
    entry = F.concat(
        F.lit('{"recommendations":[{"column":"'), word, F.lit('","action":"drop","reason":"r","transformation":null},'),
        F.lit('{"column":"n_chars","action":"keep","reason":"it is needed","transformation":""}]}'),
    )
    text = (
        F.when(k % 6 == 0, F.concat(F.lit("  ```json\n"), entry, F.lit("\n```\n")))
        .when(k % 6 == 1, entry)
        .when(k % 6 == 2, F.col("text"))
        .when(k % 6 == 3, F.replace(entry, F.lit(',"reason":"r"'), F.lit("")))
        .when(k % 6 == 4, F.concat(entry, F.lit(" Hope this helps!")))
        .otherwise(F.lit('{"note": "nothing to do"}'))
    )
    return table(spark, sf, "documents").select(k.alias("dataset"), text.alias("answer"), "source")


@query("parse_answers", """
    SELECT doc_id AS dataset, doc_id % 6 IN (0, 1, 5) AS usable,
      CAST(CASE WHEN doc_id % 6 IN (0, 1) THEN 2 WHEN doc_id % 6 = 5 THEN 0 ELSE -1 END AS INTEGER) AS entries FROM documents""")
def parse_answers(spark, sf):
    parsed = R.parse_recommendations(_answers(spark, sf))
    return parsed.select("dataset", "usable", F.coalesce(F.size("recommendations"), F.lit(-1)).alias("entries"))


@query("answers_or_rules", f"""
    SELECT doc_id AS dataset, CAST(0 AS INTEGER) AS pos, source AS "column", 'drop' AS action, 'r' AS reason, CAST(NULL AS VARCHAR) AS transformation, 'model' AS origin
      FROM documents WHERE doc_id % 6 IN (0, 1)
    UNION ALL SELECT doc_id, 1, 'n_chars', 'keep', 'it is needed', '', 'model' FROM documents WHERE doc_id % 6 IN (0, 1)
    UNION ALL SELECT dataset, CAST(pos AS INTEGER), "column", {_rule_case('"column"', 0)}, {_rule_case('"column"', 1)}, {_rule_case('"column"', 2)}, 'rules' FROM
      (SELECT doc_id AS dataset, 0 AS pos, source AS "column" FROM documents UNION ALL SELECT doc_id, 1, lang || '_id' FROM documents)
      WHERE dataset % 6 NOT IN (0, 1, 5)""")
def answers_or_rules(spark, sf):
    docs = table(spark, sf, "documents")
    columns = docs.select(
        F.col("doc_id").alias("dataset"),
        F.posexplode(F.array(F.col("source"), F.concat("lang", F.lit("_id")))).alias("pos", "column"),
    )
    return R.recommendations_or_rules(columns, _answers(spark, sf), _GOAL)


@query("latest_actions", """
    SELECT dataset, version, "column", action FROM (SELECT user_id AS dataset, date_diff('hour', TIMESTAMP '2024-01-01', ts) AS version,
      event_type || '_' || event_id AS "column", event_type AS action,
      max(date_diff('hour', TIMESTAMP '2024-01-01', ts)) OVER (PARTITION BY user_id) AS newest FROM events) WHERE version = newest""")
def latest_actions(spark, sf):
    hours = F.timestamp_diff("HOUR", F.lit("2024-01-01 00:00:00").cast("timestamp_ntz"), F.col("ts"))
    versions = table(spark, sf, "events").select(
        F.col("user_id").alias("dataset"), hours.alias("version"),
        F.concat_ws("_", "event_type", F.col("event_id").cast("string")).alias("column"), F.col("event_type").alias("action"),
    )
    return A.latest_actions(versions)


@query("override_actions", """
    SELECT c_nationkey AS dataset, c_name AS "column",
      CASE WHEN c_custkey % 3 = 0 THEN 'drop' ELSE 'keep' END AS action, c_mktsegment AS reason,
      CASE WHEN c_custkey % 6 = 0 THEN 'by hand' WHEN c_custkey % 2 = 0 THEN 'rule' END AS transformation FROM customer""")
def override_actions(spark, sf):
    k = F.col("c_custkey")
    customers = table(spark, sf, "customer")
    key = [F.col("c_nationkey").alias("dataset"), F.col("c_name").alias("column")]
    actions = customers.select(
        *key, F.lit("keep").alias("action"), F.col("c_mktsegment").alias("reason"), F.when(k % 2 == 0, "rule").alias("transformation")
    )
    overrides = customers.filter(k % 3 == 0).select(
        *key, F.lit("drop").alias("action"), F.when(k % 6 == 0, "by hand").alias("transformation")
    )
    return A.override_actions(actions, overrides)
