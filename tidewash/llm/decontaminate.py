"""Benchmark decontamination with word windows of the test items.

The benchmark is small and bounded (checked), so its normalised windows become a hash set
inside the scan of the corpus: a document is read once, its windows are tested where they
are, and no text is shuffled. A window is first tested by a hash of its first words, then
its whole text is compared, so a hit is exact.

Only DataFrame functions are used. Defined results: a null text has no words; an item
without words has no windows; repeated rows of the corpus are judged one by one; repeated
item ids count as one item, a null item id is the id "". An empty benchmark or corpus
gives no hits or no rows. Extra columns, whatever their names, are kept by ``with_hits``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewash.llm.shared import table, whole_row

WINDOW = 10
#: Words of a window that the cheap first test hashes.
PREFIX = 3
#: Above so many distinct windows, or bytes of them, the set no longer travels with the plan but is joined.
MAX_GRAMS = 200_000
MAX_GRAM_BYTES = 32 << 20
#: Hashes of 8 bytes, of windows that are joined: up to so many are broadcast.
MAX_HASHES = 4_000_000

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
WORD_BREAK = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def normal_words(text: Column) -> Column:
    """A-Z lower-cased, then the runs of digits, a-z and non-ASCII characters."""
    text = F.coalesce(text, F.lit(""))
    ascii_only = F.octet_length(text) == F.length(text)
    lowered = F.when(ascii_only, F.lower(text)).otherwise(F.translate(text, UPPER, UPPER.lower()))
    return F.array_remove(F.split(lowered, WORD_BREAK), "")


def benchmark_grams(benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """One row per distinct window: gram, its number of words, and the ids of its items."""
    words = benchmark.select(
        F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), normal_words(F.col("text")).alias("words")
    )
    n = F.size("words")
    starts = F.sequence(F.lit(1), F.greatest(n - (window - 1), F.lit(1)))
    grams = words.where(n > 0).select(
        "item", F.explode(F.transform(starts, lambda i: F.slice("words", i, window))).alias("gram")
    )
    return grams.groupBy(F.array_join("gram", " ").alias("gram"), F.size("gram").alias("n")).agg(
        F.collect_set("item").alias("items")
    )


def _head_hash(words: Column, n: int) -> Column:
    return F.xxhash64(*[F.get(words, F.lit(k)) for k in range(min(PREFIX, n))])


def _windows(n: int, condition: str) -> str:
    """SQL: the hits of windows of ``n`` words that meet ``condition`` on position ``i``."""
    starts = f"if(size(words) >= {n}, sequence(1, size(words) - {n - 1}), cast(array() as array<int>))"
    picked = f"filter({starts}, i -> {condition})" if condition else starts
    return (
        f"transform({picked}, i -> named_struct('start', i, 'n', {n}, 'gram', array_join(slice(words, i, {n}), ' ')))"
    )


def with_hits(
    docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, max_grams: int = MAX_GRAMS
) -> tuple[DataFrame, DataFrame]:
    """(marked, grams): each row of ``docs`` as ``row``, its ``key``, ``words``, ``n_words`` and ``hits``.

    ``hits`` is an array of (start from 1, n, gram) in order of start for each window length.
    Beyond ``max_grams`` windows the same rows come from a join instead of a set.
    """
    grams = benchmark_grams(benchmark, window)
    grams_words = F.split("gram", " ")
    head = F.when(F.col("n") >= PREFIX, _head_hash(grams_words, PREFIX))
    for n in range(1, PREFIX):
        head = head.when(F.col("n") == n, _head_hash(grams_words, n))
    sizes = grams.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("gram")), F.lit(0))).first()
    fits = sizes[0] <= max_grams and sizes[1] <= MAX_GRAM_BYTES
    known = [tuple(r) for r in grams.select("gram", "n", head).collect()] if fits else []
    # A filter on hits must not move below this projection, where it would cut the words anew for
    # each window; the number of the row, which is not deterministic, holds it above.
    rows = docs.select(
        whole_row(docs).alias("row"), normal_words(F.col("text")).alias("words"), F.monotonically_increasing_id().alias("key")
    )
    if not fits:
        return _joined_hits(rows, grams, sizes[0] <= MAX_HASHES), grams
    lists = []
    for n in sorted({n for _, n, _ in known}):
        quoted = ", ".join(sorted(f"'{gram}'" for gram, m, _ in known if m == n))
        heads = ", ".join(sorted({f"{head}L" for _, m, head in known if m == n}))
        head_words = ", ".join(f"words[i - 1 + {k}]" for k in range(min(PREFIX, n)))
        lists.append(_windows(
            n, f"xxhash64({head_words}) IN ({heads}) AND array_join(slice(words, i, {n}), ' ') IN ({quoted})"
        ))
    nothing = "cast(array() as array<struct<start:int,n:int,gram:string>>)"
    hits = F.expr(f"concat({', '.join([nothing, *lists])})")
    return rows.select("key", "row", "words", F.size("words").alias("n_words"), hits.alias("hits")), grams


def _joined_hits(rows: DataFrame, grams: DataFrame, few: bool) -> DataFrame:
    """The rows of ``with_hits`` for a set too large for the plan: windows are joined by their text.

    Where the hashes of the set are ``few`` enough to broadcast, only windows that meet one are shuffled.
    """
    lengths = [r[0] for r in grams.select("n").distinct().collect()]
    windows = F.expr(f"concat({', '.join(_windows(n, '') for n in sorted(lengths))})")
    hits = rows.select("key", F.explode(windows).alias("hit"))
    if few:
        hashes = grams.select(F.xxhash64("gram").alias("hash")).distinct()
        hits = hits.join(F.broadcast(hashes), F.xxhash64("hit.gram") == F.col("hash"), "left_semi")
    found = (
        hits.join(grams.select(F.col("gram").alias("known")), F.col("hit.gram") == F.col("known"), "left_semi")
        .groupBy("key").agg(F.array_sort(F.collect_list("hit")).alias("hits"))
    )
    nothing = F.array().cast("array<struct<start:int,n:int,gram:string>>")
    return rows.join(found, "key", "left").select("key", "row", "words", F.size("words").alias("n_words"), F.coalesce("hits", nothing).alias("hits"))


def covered_spans(hits: Column) -> Column:
    """Hits merged into disjoint spans (start, stop), both counted from 1, ``stop`` exclusive."""
    spans = F.array_sort(F.transform(hits, lambda h: F.struct(h["start"].alias("start"), (h["start"] + h["n"]).alias("stop"))))

    def step(done: Column, span: Column) -> Column:
        last = F.element_at(done, -1)
        joined = F.concat(
            F.slice(done, 1, F.size(done) - 1),
            F.array(F.struct(last["start"].alias("start"), F.greatest(last["stop"], span["stop"]).alias("stop"))),
        )
        return F.when((F.size(done) > 0) & (F.get(done, F.size(done) - 1)["stop"] >= span["start"]), joined).otherwise(
            F.concat(done, F.array(span))
        )

    return F.aggregate(spans, F.array().cast("array<struct<start:int,stop:int>>"), step)


def n_covered(hits: Column) -> Column:
    """How many words the hits cover, each counted once; linear in the hits."""
    spans = F.array_sort(F.transform(hits, lambda h: F.struct(h["start"].alias("start"), (h["start"] + h["n"]).alias("stop"))))
    state = F.struct(F.lit(0).alias("stop"), F.lit(0).alias("total"))
    return F.aggregate(
        spans, state,
        lambda done, s: F.struct(
            F.greatest(done["stop"], s["stop"]).alias("stop"),
            (done["total"] + F.greatest(F.lit(0), s["stop"] - F.greatest(done["stop"], s["start"]))).alias("total"),
        ),
        lambda done: done["total"],
    )


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, max_grams: int = MAX_GRAMS) -> DataFrame:
    """Per row of ``docs``: doc_id, n_words, n_hit, n_items, items_sha256, contaminated, items.

    The windows hit are looked up in the (checked, broadcast) table of grams; only the few
    numbers of a document travel to its group. Row numbers are stable because the frame is a
    scan of files; write any other frame first.
    """
    marked, grams = with_hits(docs, benchmark, window, max_grams)
    lookup = grams.select(F.col("gram").alias("known"), "items")
    if grams.limit(max_grams + 1).count() <= max_grams:
        lookup = F.broadcast(lookup)
    hits = (
        marked.select(
            "key", F.col("row.doc_id").alias("doc_id"), "n_words",
            n_covered(F.col("hits")).alias("n_hit"),
            F.array_distinct(F.transform("hits", lambda h: h["gram"])).alias("found"),
        )
        .select("key", "doc_id", "n_words", "n_hit", F.explode_outer("found").alias("gram"))
        .join(lookup, F.col("gram") == F.col("known"), "left")
    )
    items = F.array_sort(F.array_distinct(F.flatten(F.collect_set("items"))))
    return hits.groupBy("key").agg(
        F.first("doc_id").alias("doc_id"), F.first("n_words").cast("long").alias("n_words"),
        F.first("n_hit").cast("long").alias("n_hit"), items.alias("items"),
    ).select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"), "items",
    )


def clean_documents(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """The rows of ``docs`` without any hit, unchanged; no shuffle while the set is bounded."""
    marked, _ = with_hits(docs, benchmark, window)
    return marked.where((F.size("hits") == 0) & (F.col("key") >= 0)).select("row.*")


def remove_spans(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """``docs`` where the text of a hit document is the normalised words outside its hits."""
    marked, _ = with_hits(docs, benchmark, window)
    words = F.col("words")
    spans = covered_spans(F.col("hits"))
    starts = F.concat(F.array(F.lit(1)), F.transform(spans, lambda s: s["stop"]))
    stops = F.concat(F.transform(spans, lambda s: s["start"]), F.array(F.col("n_words") + 1))
    kept = F.flatten(F.zip_with(starts, stops, lambda a, b: F.slice(words, a, F.greatest(b - a, F.lit(0)))))
    text = F.when(F.size("hits") > 0, F.array_join(kept, " ")).otherwise(F.col("row.text"))
    return marked.select(F.col("row").withField("text", text).alias("row")).select("row.*")


def op8_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("items")


ORACLE = r"""
WITH docs AS (
  SELECT row_number() OVER () AS k, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents
), items AS (
  SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark
), item_at AS (
  SELECT item, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM items WHERE len(w) > 0
), grams AS (
  SELECT DISTINCT item, least(len(w), 10) AS n, array_to_string(w[i : i + 9], ' ') AS gram FROM item_at
), doc_at AS (
  SELECT k, w, n, unnest(range(1, len(w) - n + 2)) AS i
  FROM docs, (SELECT DISTINCT n FROM grams) WHERE len(w) >= n
), doc_grams AS (
  SELECT k, n, i, array_to_string(w[i : i + n - 1], ' ') AS gram FROM doc_at
), hits AS (
  SELECT k, d.n, i, item FROM doc_grams d JOIN grams g ON d.gram = g.gram AND d.n = g.n
), words_hit AS (
  SELECT k, count(DISTINCT p) AS n_hit FROM (SELECT k, unnest(range(i, i + n)) AS p FROM (SELECT DISTINCT k, n, i FROM hits)) GROUP BY k
), items_hit AS (
  SELECT k, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT k, item FROM hits) GROUP BY k
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM docs LEFT JOIN words_hit USING (k) LEFT JOIN items_hit USING (k)
"""
