"""Runs: stretches of words that repeat with a period, and texts without their repetitions.

Every run is found from its Lyndon root. Phase one of Baier's suffix sorter groups the suffixes
of a text by their longest Lyndon prefix, so it yields the Lyndon array, and equal roots have
one group; it is run under an order of the words and under its reverse, and each run shows as
neighbouring equal roots under one of the two. A chain of equal roots, extended to both sides by
the longest common extension (LCE) of the text with itself one period on, is the run. An LCE is
found by comparing words in chunks that double; it goes at most a period beyond its chain.

Before that, words that no run can hold are set aside: a run of the asked length and exponent
has each of its ``GRAM`` consecutive words twice, one period apart, so a word outside all
repeated grams of its text is in none. What is left between such words is searched whole. The
hashes of this screening can only keep too much.

A document is one row and one unit of work; texts of a few megabytes go through together.

Defined results: a null or blank text has no words, no runs and the empty text; repeated rows
and ids are separate; words are compared as bytes, in their case; ties of two runs in length or
start are both returned, by start, then period; the other columns stay as they are, whatever
their names; an empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewash.llm.shared import table, whole_row
from tidewash.llm.tokens import slices
from tidewash.llm.word_hashes import FACTORS, NOT_BLANK, Words, mixed

MIN_LENGTH = 24
MIN_EXPONENT = 3

RUN_TYPE = "array<struct<start:bigint,length:bigint,period:bigint>>"


def plain_words(doc_id: int | None, text: str | None) -> list[bytes]:
    """The words of a text: whatever stands between ASCII blanks."""
    return (text or "").encode().split()


def lyndon_groups(ranks: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Baier's phase one: for each suffix the number of its group, and the length of its longest Lyndon prefix.

    Groups begin as equal first words and are gone through from the largest on. The suffixes of
    a group leave the text; each hands its prefix on to the nearest one left before it, which is
    smaller. Those that got the same prefix equally often, and were one group, become a group
    just above their old one.
    """
    n = len(ranks)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    members: list[list[int]] = [[] for _ in range(max(ranks) + 1)]
    for at, rank in enumerate(ranks):
        members[rank].append(at)
    group = list(ranks)
    length = [1] * len(members)
    below = list(range(-1, len(members) - 1))  # neighbours in the order of groups
    above = [*range(1, len(members)), -1]
    before = [*range(-1, n - 1), n - 1]  # neighbours among the suffixes that are left; n is the end
    after = list(range(1, n + 1))
    now = len(members) - 1
    while now >= 0:
        handed: dict[int, int] = {}
        for at in members[now]:
            if group[at] == now:
                left, right = before[at], after[at]
                before[right] = left
                if left >= 0:
                    after[left] = right
                    handed[left] = handed.get(left, 0) + 1
        new: dict[tuple[int, int], int] = {}
        for at, times in handed.items():  # in order of place
            key = (group[at], times)
            if key not in new:
                new[key] = len(members)
                members.append([])
                length.append(length[key[0]] + times * length[now])
                below.append(-1)
                above.append(-1)
            members[new[key]].append(at)
            group[at] = new[key]
        for old, times in sorted(new, reverse=True):  # each goes just above its old group, so more times stand higher
            one, over = new[old, times], above[old]
            above[old], below[one], above[one] = one, old, over
            if over >= 0:
                below[over] = one
        now = below[now]
    found = np.array(group, np.int64)
    return found, np.array(length, np.int64)[found]


def common_extension(ids: np.ndarray, at: int, period: int, step: int) -> int:
    """The LCE of the places ``at`` and ``at + period``, to the right (``step`` 1) or to the left (-1)."""
    room = len(ids) - at - period if step > 0 else at + 1
    done, chunk = 0, 16
    while done < room:
        size = min(chunk, room - done)
        low = at + done if step > 0 else at - done - size + 1
        differs = np.flatnonzero((ids[low : low + size] != ids[low + period : low + period + size])[::step])
        if len(differs):
            return done + int(differs[0])
        done, chunk = done + size, 2 * chunk
    return max(done, 0)


def runs(words: list, min_length: int = MIN_LENGTH, min_exponent: int = MIN_EXPONENT) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs of the least length and exponent (at least 3), sorted."""
    codes: dict = {}
    ids = [codes.setdefault(word, len(codes)) for word in words]
    same, n = np.array(ids, np.int64), len(ids)
    found: set[tuple[int, int, int]] = set()
    for ranks in (ids, [len(codes) - 1 - x for x in ids]):
        group, length = lyndon_groups(ranks)
        at = np.arange(n)
        to = at + length  # where the next root of the same run begins
        again = np.zeros(n, bool)
        inside = np.flatnonzero(to < n)
        again[inside] = group[to[inside]] == group[inside]
        back = at - length
        first = again & ~((back >= 0) & (group[np.maximum(back, 0)] == group))
        for k in np.flatnonzero(first).tolist():
            period = int(length[k])
            left = common_extension(same, k - 1, period, -1)
            right = common_extension(same, k, period, 1)
            if left + right + period >= max(min_length, min_exponent * period):
                found.add((k - left, left + right + period, period))
    return sorted(found)


def suspect_stretches(texts: list[bytes], gram: int) -> list[list[tuple[int, int]]]:
    """For each text (words joined by one blank) the stretches (from, to) of words in grams that it repeats."""
    words = Words([text.decode() for text in texts], NOT_BLANK)
    n, out = len(words.starts), [[] for _ in texts]
    if n < 2 * gram:
        return out
    grams = np.zeros(n - gram + 1, np.uint64)
    for k in range(gram):
        grams = mixed(grams * FACTORS[2] + words.hashes[k : n - gram + 1 + k])
    whole = words.text[: n - gram + 1] == words.text[gram - 1 :]
    grams = mixed(grams + words.text[: n - gram + 1].astype(np.uint64) * FACTORS[1])
    at = np.flatnonzero(whole)
    order = at[np.argsort(grams[at], kind="stable")]
    equal = grams[order][1:] == grams[order][:-1]
    repeated = np.concatenate([order[1:][equal], order[:-1][equal]])
    change = np.zeros(n + 1, np.int64)
    np.add.at(change, repeated, 1)
    np.add.at(change, repeated + gram, -1)
    kept = np.cumsum(change[:n]) > 0
    edge = np.diff(np.concatenate([[False], kept, [False]]).astype(np.int8))
    first_word = np.searchsorted(words.text, np.arange(len(texts)))
    cut = np.concatenate([[False], kept[1:] & kept[:-1] & (words.text[1:] != words.text[:-1])])  # kept on both sides of a text's end
    starts = np.sort(np.concatenate([np.flatnonzero(edge == 1), np.flatnonzero(cut)]))
    ends = np.sort(np.concatenate([np.flatnonzero(edge == -1), np.flatnonzero(cut)]))
    for lo, hi in zip(starts.tolist(), ends.tolist()):
        text = int(words.text[lo])
        out[text].append((lo - int(first_word[text]), hi - int(first_word[text])))
    return out


def collapsed_words(words: list[bytes], found: list[tuple[int, int, int]]) -> list[bytes]:
    """The words without those that a run holds after its first period."""
    dropped = np.zeros(len(words) + 1, np.int64)
    for start, length, period in found:
        dropped[start + period] += 1
        dropped[start + length] -= 1
    keeps = np.cumsum(dropped[:-1]) == 0
    return [word for word, kept in zip(words, keeps.tolist()) if kept]


def with_runs(
    docs: DataFrame,
    words: Callable[[int | None, str | None], list[bytes]] = plain_words,
    min_length: int = MIN_LENGTH,
    min_exponent: int = MIN_EXPONENT,
) -> DataFrame:
    """(row, runs, collapsed): all columns of ``docs`` as one struct, the runs of its text, and its words without repetitions.

    ``words`` takes the words of a text, by doc_id and text; ``min_exponent`` is 3 or more. Runs
    are maximal stretches with a smallest period, of ``min_length`` words and ``min_exponent``
    periods at least.
    """
    if min_exponent < 3 or min_length < 1:
        raise ValueError("runs of fewer than three periods or without words are not searched for")
    # A run of length L >= e * period has at least L - gram + 1 >= 2 * period grams, so each occurs twice.
    gram = max(1, min_length * (min_exponent - 2) // min_exponent)
    row_type = docs.select(whole_row(docs).alias("row")).schema["row"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run_type = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
        for batch in slices(batches):
            own = [words(i, text) for i, text in zip(batch["id"].to_pylist(), batch["text"].to_pylist())]
            texts = [b" ".join(x) for x in own]
            found: list[list[tuple[int, int, int]]] = [[] for _ in own]
            for at, stretches in enumerate(suspect_stretches(texts, gram)):
                for lo, hi in stretches:
                    if hi - lo >= min_length:
                        found[at] += [(lo + start, length, period) for start, length, period in runs(own[at][lo:hi], min_length, min_exponent)]
                if found[at]:
                    texts[at] = b" ".join(collapsed_words(own[at], found[at]))
            listed = pa.array([[dict(zip(("start", "length", "period"), x)) for x in f] for f in found], run_type)
            collapsed = pa.array(texts, pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays([batch["row"], listed, collapsed], ["row", "runs", "collapsed"])

    taken = docs.select(whole_row(docs).alias("row"), F.col("doc_id").cast("bigint").alias("id"), F.col("text").cast("string").alias("text"))
    return taken.mapInArrow(run, f"row {row_type}, runs {RUN_TYPE}, collapsed string")


def without_runs(docs: DataFrame) -> DataFrame:
    """``docs`` with each text that holds runs replaced by its words without their repetitions; others stay as written."""
    names = [f"`{name.replace('`', '``')}`" for name in docs.columns]
    own = lambda name: F.when(F.size("runs") > 0, F.col("collapsed")).otherwise(F.col(f"row.{name}"))
    return with_runs(docs).select(*[own(name).alias(plain) if plain == "text" else F.col(f"row.{name}") for plain, name in zip(docs.columns, names)])


def planted_words(doc_id: int | None, text: str | None) -> list[bytes]:
    """The words of a text; where crc32(doc_id) is divisible by ten, its later part is made to repeat."""
    words = plain_words(doc_id, text)
    if doc_id is None or not words:
        return words
    h = zlib.crc32(str(doc_id).encode())
    if h % 10:
        return words
    n, g = len(words), h // 10
    first = g % n
    period = 1 + (n - first) // (3 + g % 8)
    return words[:first] + [words[first + k % period] for k in range(n - first)]


def strongest(found: Column) -> Column:
    """The run with the greatest exact length/period; ties go to the smallest start, then period."""
    def order(a: Column, b: Column) -> Column:
        left, right = a["length"] * b["period"], b["length"] * a["period"]
        return (
            F.when(left > right, -1).when(left < right, 1)
            .when(a["start"] < b["start"], -1).when(a["start"] > b["start"], 1)
            .otherwise(F.signum(a["period"] - b["period"]).cast("int"))
        )

    return F.get(F.array_sort(found, order), 0)


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = with_runs(table(spark, sf_dir, "documents").select("doc_id", "text"), planted_words)
    lines = F.transform("runs", lambda x: F.concat(F.concat_ws(",", *[x[name].cast("string") for name in ("start", "length", "period")]), F.lit("\n")))
    best = found.select(F.col("row.doc_id").alias("doc_id"), "runs", "collapsed", strongest(F.col("runs")).alias("best"))
    return best.select(
        "doc_id", F.size("runs").cast("bigint").alias("n_runs"), "best.start", "best.length", "best.period",
        F.floor(1000 * F.col("best.length") / F.col("best.period")).cast("bigint").alias("exponent_milli"),
        F.sha2(F.concat_ws("", lines).cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )
