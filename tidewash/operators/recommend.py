"""One recommended action per column: rules by name, or a model's answer."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from functools import reduce

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from tidewash.functions.columns import literal_rows
from tidewash.functions.text import json_answer
from tidewash.operators.joins import spread_join


@dataclass(frozen=True)
class Rule:
    """`contains` words may stand anywhere in the name, `equals` words are the name."""

    contains: tuple[str, ...]
    equals: tuple[str, ...]
    action: str
    reason: str
    transformation: str | None = None


# The rules by column name, first match wins. {goal} is the user's goal.
RULES = (
    Rule(("id", "hash"), (), "drop",
         "Useless random identifier. High cardinality and zero correlation to goal '{goal}'."),
    Rule(("name",), (), "drop",
         "Personally identifiable information (PII) that doesn't aid model training."),
    Rule(("noise", "system"), (), "drop",
         "Synthetic noise column representing non-predictive random signals."),
    Rule(("empty", "null"), (), "drop",
         "Empty column with 100% missing values."),
    Rule(("duplicated",), (), "drop",
         "Duplicate copy of fee column. Redundant features cause multicollinearity."),
    Rule(("date",), (), "transform",
         "Date string needs to be parsed to allow extraction of chronological metrics like tenure.",
         "Convert to datetime object"),
    Rule((), ("gender", "sex"), "transform",
         "Categorical string column with missing values. Requires imputation and label encoding.",
         "Impute missing with mode and label encode"),
    Rule((), ("age", "income"), "transform",
         "Numeric column containing missing values that need numerical imputation.",
         "Impute missing values using column median"),
    Rule((), ("churn", "churned", "churned_status", "status"), "keep",
         "Direct target label representing the classification outcome."),
    Rule(("",), (), "keep",
         "Key numerical or categorical feature directly relevant to predicting user behavior."),
)

# Keys that every recommendation in a model's answer must have.
ANSWER_KEYS = ("column", "action", "reason", "transformation")
# What the assistant says about a new plan, by where it comes from.
PLAN_MESSAGE = (
    "Goal set: **%s**.<br>I have completed scanning the dataset. I recommend dropping %d irrelevant features (like %s...) "
    "to prepare for your modeling objective. Let me know if you want to make overrides."
)
RULES_MESSAGE = (
    "Goal set: **%s**.<br>Using mock offline recommendations. I suggest dropping redundant columns. You can edit the suggestions in the grid."
)
_KEY = "_prompt_key"


def _matches(rule: Rule, name: Column) -> Column:
    tests = [F.contains(name, F.lit(w)) for w in rule.contains]
    if rule.equals:
        tests.append(name.isin(*rule.equals))
    return reduce(lambda a, b: a | b, tests)


def recommend(columns: DataFrame, goal: str | Column = "", name: str = "column") -> DataFrame:
    """Adds action, reason and transformation to a table of column names.

    ``goal`` is one text, or the column that holds each row's goal, so a
    catalogue of many tables is decided in one projection.
    """
    goal = F.lit(goal) if isinstance(goal, str) else goal
    lowered = F.lower(F.col(name))
    number = F.when(F.lit(False), F.lit(-1))
    for i, rule in enumerate(RULES):
        number = number.when(_matches(rule, lowered), F.lit(i))
    pick = lambda texts: F.get(F.array(*[F.lit(t).cast("string") for t in texts]), F.col("rule"))
    return (
        columns.withColumn("rule", number)
        .withColumn("action", pick([r.action for r in RULES]))
        .withColumn("reason", F.replace(pick([r.reason for r in RULES]), F.lit("{goal}"), goal))
        .withColumn("transformation", pick([r.transformation for r in RULES]))
        .drop("rule")
    )


def recommend_for(df: DataFrame, goal: str = "") -> DataFrame:
    """Rule recommendations for the columns of one table, in their order."""
    rows = [(i, c) for i, c in enumerate(df.columns)]
    return recommend(literal_rows(df, rows, ["pos", "column"], ["int", "string"]), goal)


def actions_of(recommendations: DataFrame) -> dict[str, dict[str, str | None]]:
    """The action map of one table, as `fit` takes it; one entry per schema column."""
    rows = recommendations.orderBy("pos").collect()
    return {r["column"]: {k: r[k] for k in ANSWER_KEYS[1:]} for r in rows}


def rules_intro(goal: Column) -> Column:
    """What the assistant says about a plan that the rules made, without a model."""
    return F.format_string(RULES_MESSAGE, goal)


def plan_summary(recommendations: DataFrame, goal: str, by: Sequence[str] = ("dataset",)) -> DataFrame:
    """Number of drops and the first two dropped names of each table, and the message about them.

    The rank limit is applied before the shuffle, so no table's columns are gathered.
    """
    by = list(by)
    counts = recommendations.groupBy(*by).agg(F.count_if(F.col("action") == "drop").alias("drops"))
    rank = F.row_number().over(Window.partitionBy(*by).orderBy("pos"))
    firsts = (
        recommendations.filter(F.col("action") == "drop")
        .select(*by, "pos", "column")
        .withColumn("rank", rank)
        .filter(F.col("rank") <= 2)
        .groupBy(*by)
        .agg(
            F.max(F.when(F.col("rank") == 1, F.col("column"))).alias("one"),
            F.max(F.when(F.col("rank") == 2, F.col("column"))).alias("two"),
        )
    )
    named = F.concat_ws(", ", "one", "two")
    return counts.join(firsts, by, "left").select(
        *by, "drops", named.alias("examples"),
        F.format_string(PLAN_MESSAGE, F.lit(goal), F.col("drops"), named).alias("message"),
    )


# -- the model's part ---------------------------------------------------------

def schema_context(columns: DataFrame, actions: DataFrame, by: Sequence[str] = ("dataset",)) -> DataFrame:
    """Every column with its current action; defaults only where there is no action at all."""
    keys = [*by, "column"]
    known = actions.select(*keys, "action", "reason", "transformation", F.lit(True).alias("known"))
    joined = columns.join(known, keys, "left")
    known_or = lambda value, default: F.when(F.col("known"), value).otherwise(F.lit(default))
    return (
        joined.withColumn("current_action", known_or(F.col("action"), "keep"))
        .withColumn("reason", known_or(F.coalesce("reason", F.lit("")), "Default"))
        .withColumn("transformation", known_or(F.col("transformation"), ""))
        .drop("action", "known")
    )


def prompt_payload(
    context: DataFrame, goal: str | Column, fields: Sequence[str], by: Sequence[str] = ("dataset",),
    template: str = "Goal: %s\nColumns:\n%s",
) -> DataFrame:
    """One prompt per table: the goal and all context rows as JSON.

    A group holds the columns of one table, never its rows.
    """
    goal = F.lit(goal) if isinstance(goal, str) else goal
    entry = F.struct("pos", *fields)
    listed = F.array_sort(F.collect_list(entry))
    shown = F.transform(listed, lambda e: F.struct(*[e[f].alias(f) for f in fields]))
    payload = F.to_json(shown, {"ignoreNullFields": "false"})
    return context.groupBy(*by).agg(payload.alias("payload")).withColumn(
        "prompt", F.format_string(template, goal, F.col("payload"))
    )


def ask_model(
    prompts: DataFrame, answer: Callable[[list[str]], Sequence[str | None]], prompt: str = "prompt", store: str | None = None, rounds: int = 1
) -> DataFrame:
    """Adds the model's answer to every prompt; the caller's function gets batches of texts.

    With ``store``, a folder, answers are kept under their prompt's digest: a prompt that several
    rows share is asked once, and one that was answered before, by whatever run, not at all. Each
    of ``rounds`` is kept as it ends, so a failure costs the answers of its round.
    """
    if store is None:
        return _answered(prompts, answer, prompt, prompts.schema)
    spark, schema = prompts.sparkSession, T.StructType([T.StructField(_KEY, T.StringType()), T.StructField(prompt, prompts.schema[prompt].dataType)])
    keyed = prompts.withColumn(_KEY, F.sha2(F.concat(F.when(F.col(prompt).isNull(), "0").otherwise("1"), F.coalesce(prompt, F.lit(""))), 256))
    texts = keyed.groupBy(_KEY).agg(F.first(prompt).alias(prompt))
    for turn in range(rounds):
        part = texts.filter(F.pmod(F.xxhash64(_KEY), F.lit(rounds)) == turn)
        new = part.join(_kept_answers(spark, store), _KEY, "left_anti")
        _answered(new, answer, prompt, schema).select(_KEY, "answer").write.parquet(f"{store}/round={uuid.uuid4().hex}")
    return spread_join(keyed, _kept_answers(spark, store), [_KEY]).drop(_KEY)


def _answered(prompts: DataFrame, answer: Callable[[list[str]], Sequence[str | None]], prompt: str, schema: T.StructType) -> DataFrame:
    def answered(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch.assign(answer=list(answer(batch[prompt].tolist())))

    return prompts.mapInPandas(answered, T.StructType([*schema.fields, T.StructField("answer", T.StringType())]))


def _kept_answers(spark, store: str) -> DataFrame:
    """One answer a prompt; two runs at a time may have asked for the same."""
    schema = T.StructType([T.StructField(_KEY, T.StringType()), T.StructField("answer", T.StringType())])
    try:
        kept = spark.read.schema(schema).parquet(store)
    except AnalysisException:
        return spark.createDataFrame([], schema)
    return kept.select(*schema.names).groupBy(_KEY).agg(F.min("answer").alias("answer"))


def parse_recommendations(answers: DataFrame, text: str = "answer") -> DataFrame:
    """Adds `usable` and the parsed recommendations, an array of field maps.

    An answer is used whole or not at all: it must be one JSON object and every
    recommendation in it must have all keys. A key may hold null.
    """
    document = json_answer(F.col(text))
    keys = F.json_object_keys(F.col("document"))
    parsed = F.from_json(F.col("document"), "recommendations array<map<string,string>>", {"allowSingleQuotes": "false"})
    listed = F.array_contains(F.col("keys"), "recommendations")
    complete = F.forall(
        F.col("parsed"),
        lambda r: reduce(lambda a, b: a & b, [F.map_contains_key(r, k) for k in ANSWER_KEYS]),
    )
    return (
        answers.withColumn("document", document)
        .withColumn("keys", keys)
        .withColumn("parsed", parsed["recommendations"])
        .withColumn(
            "usable",
            F.coalesce(F.col("keys").isNotNull() & (~listed | F.coalesce(complete, F.lit(False))), F.lit(False)),
        )
        .withColumn(
            "recommendations",
            F.when(F.col("usable"), F.coalesce(F.col("parsed"), F.array().cast("array<map<string,string>>"))),
        )
        .drop("document", "keys", "parsed")
    )


def recommendations_or_rules(
    columns: DataFrame, answers: DataFrame, goal: str | Column = "", by: Sequence[str] = ("dataset",), text: str = "answer"
) -> DataFrame:
    """The model's recommendations per table, or all rule recommendations of that table.

    `origin` tells which.
    ``columns`` has one row per table and column, ``answers`` one per table.
    A table without an answer gets the rules too.
    """
    by = list(by)
    parsed = parse_recommendations(answers, text)
    from_model = (
        parsed.filter("usable")
        .select(*by, F.posexplode("recommendations").alias("pos", "fields"))
        .select(
            *by, F.col("pos").cast("int").alias("pos"),
            *[F.col("fields")[k].alias(k) for k in ANSWER_KEYS],
            F.lit("model").alias("origin"),
        )
    )
    answered = parsed.filter("usable").select(*by)
    from_rules = (
        recommend(spread_join(columns, answered, by, "left_anti"), goal)
        .select(*by, F.col("pos").cast("int").alias("pos"), *ANSWER_KEYS, F.lit("rules").alias("origin"))
    )
    return from_model.unionByName(from_rules)
