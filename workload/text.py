"""Scalar functions on the given texts."""

from __future__ import annotations

from pyspark.sql import functions as F, types as T

from tidewash.functions import columns as K, text as X
from tidewash.functions.parsing import strip
from workload.edits import _STRIP
from workload.registry import query, table


@query("markdown_html", r"""
    WITH t AS (SELECT doc_id, 'a & **' || lang || '** <b>*' || source || '*</b> `' || lang || '` ' || text AS text FROM documents),
    e AS (SELECT doc_id, replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') AS h FROM t)
    SELECT doc_id, replace(regexp_replace(regexp_replace(regexp_replace(h, '\*\*(.+?)\*\*', '<strong>\1</strong>', 'g'),
      '\*(.+?)\*', '<em>\1</em>', 'g'), '`(.+?)`', '<code>\1</code>', 'g'), chr(10), '<br>') AS html FROM e""")
def markdown_html(spark, sf):
    text = F.concat(
        F.lit("a & **"), F.col("lang"), F.lit("** <b>*"), F.col("source"), F.lit("*</b> `"), F.col("lang"), F.lit("` "), F.col("text")
    )
    return table(spark, sf, "documents").select("doc_id", X.markdown_html(text).alias("html"))


_MODELS = ["claude-x", "Gemini-y", "openrouter/z", "OLLAMA/w", "gpt-4", "glm-5", "nvidia-m", "other"]


@query("provider_of", f"""
    WITH t AS (SELECT p_partkey, CASE WHEN p_partkey % 11 = 0 THEN NULL ELSE [{", ".join(f"'{m}'" for m in _MODELS)}][CAST(p_partkey % 8 + 1 AS INTEGER)] || '-' || p_size END AS requested,
        CASE WHEN p_partkey % 5 = 0 THEN 'Anthropic' WHEN p_partkey % 7 = 0 THEN 'my host' WHEN p_partkey % 3 = 0 THEN '' END AS explicit, p_size > 25 AS has_url FROM part),
    m AS (SELECT *, coalesce(requested, 'z-ai/glm-5.2') AS model FROM t),
    p AS (SELECT *, lower(coalesce(nullif(explicit, ''), CASE WHEN contains(lower(model), 'claude') THEN 'anthropic' WHEN contains(lower(model), 'gemini') THEN 'gemini'
        WHEN contains(lower(model), 'openrouter') THEN 'openrouter' WHEN contains(lower(model), 'ollama') THEN 'ollama' WHEN contains(lower(model), 'gpt-') THEN 'openai' ELSE 'nvidia' END)) AS provider FROM m),
    f AS (SELECT *, CASE WHEN provider = 'nvidia' THEN 'openai/' WHEN provider = 'my host' THEN CASE WHEN has_url THEN 'openai/' ELSE '' END ELSE provider || '/' END AS prefix FROM p)
    SELECT p_partkey, provider, CASE WHEN starts_with(model, prefix) THEN model ELSE prefix || model END AS qualified FROM f""")
def provider_of(spark, sf):
    k = F.col("p_partkey")
    model = F.concat(F.get(F.array(*[F.lit(m) for m in _MODELS]), (k % 8).cast("int")), F.lit("-"), F.col("p_size").cast("string"))
    requests = table(spark, sf, "part").select(
        "p_partkey",
        X.model_name(F.when(k % 11 != 0, model)).alias("model"),
        F.when(k % 5 == 0, "Anthropic").when(k % 7 == 0, "my host").when(k % 3 == 0, "").alias("explicit"),
        (F.col("p_size") > 25).alias("has_url"),
    )
    provided = requests.withColumn("provider", X.provider_of(F.col("model"), F.col("explicit")))
    return provided.select("p_partkey", "provider", X.qualified_model(F.col("model"), F.col("provider"), F.col("has_url")).alias("qualified"))


@query("scalar_functions", f"""
    SELECT doc_id, lower(text) AS lowered, upper(source) AS uppered, contains(lower(text), 'the') AS has_the, lang IN ('en', 'fr') AS is_listed,
      {_STRIP("' ' || text || chr(9)")} AS stripped, split_part(text, ' ', 1) AS first_word, string_split(text, ' ')[-1] AS last_word,
      CASE WHEN starts_with(source, 'src1') THEN source ELSE 'src1/' || source END AS prefixed,
      array_to_string([lang, source], ', ') AS joined, printf('DOC_%06d', doc_id) AS padded,
      round_even(n_chars / 8.0, 2) AS rounded, CAST(n_chars / 8.0 AS VARCHAR) AS as_text, CAST(n_chars AS DOUBLE) AS as_double,
      coalesce(nullif(CASE WHEN doc_id % 2 = 0 THEN '' ELSE source END, ''), lang) AS filled,
      strftime(TIMESTAMP '2024-03-10 02:30:00' + to_seconds(doc_id), '%Y-%m-%dT%H:%M:%S') AS iso,
      lower(CASE WHEN contains(source || '.' || upper(lang), '.') THEN upper(lang) END) AS extension FROM documents""")
def scalar_functions(spark, sf):
    docs = table(spark, sf, "documents")
    eighth = F.col("n_chars") / 8.0
    text = F.col("text")
    return docs.select(
        "doc_id",
        F.lower(text).alias("lowered"),
        F.upper("source").alias("uppered"),
        F.contains(F.lower(text), F.lit("the")).alias("has_the"),
        F.col("lang").isin("en", "fr").alias("is_listed"),
        strip(F.concat(F.lit(" "), text, F.lit("\t"))).alias("stripped"),
        F.substring_index(text, " ", 1).alias("first_word"),
        F.substring_index(text, " ", -1).alias("last_word"),
        F.when(F.startswith("source", F.lit("src1")), F.col("source")).otherwise(F.concat(F.lit("src1/"), "source")).alias("prefixed"),
        F.array_join(F.array("lang", "source"), ", ").alias("joined"),
        F.format_string("DOC_%06d", "doc_id").alias("padded"),
        F.bround(eighth, 2).alias("rounded"),
        K.value_text(eighth.cast("double"), T.DoubleType()).alias("as_text"),
        F.col("n_chars").cast("double").alias("as_double"),
        X.first_filled(F.when(F.col("doc_id") % 2 == 0, "").otherwise(F.col("source")), F.col("lang")).alias("filled"),
        X.iso_text(F.timestamp_add("SECOND", F.col("doc_id"), F.lit("2024-03-10 02:30:00").cast("timestamp_ntz"))).alias("iso"),
        X.file_extension(F.concat("source", F.lit("."), F.upper("lang"))).alias("extension"),
    )
