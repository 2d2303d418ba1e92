"""Text functions on columns: model answers, tagged blocks, tokens, markdown, model names."""

from __future__ import annotations

import re

from pyspark.sql import Column, functions as F

from tidewash.functions.parsing import let, strip

# The tags around the updates in a chat answer, and the code fence.
START_TAG = "<<<SCHEMA_UPDATES>>>"
END_TAG = "<<<END>>>"
FENCE = "```"

# Part of a model name -> provider, first match wins.
PROVIDER_HINTS = (
    ("claude", "anthropic"),
    ("gemini", "gemini"),
    ("openrouter", "openrouter"),
    ("ollama", "ollama"),
    ("gpt-", "openai"),
    ("glm", "nvidia"),
    ("nvidia", "nvidia"),
)
DEFAULT_PROVIDER = "nvidia"
DEFAULT_MODEL = "z-ai/glm-5.2"
# Provider -> prefix of the qualified model name.
PROVIDER_PREFIX = {
    "openai": "openai/",
    "anthropic": "anthropic/",
    "gemini": "gemini/",
    "openrouter": "openrouter/",
    "ollama": "ollama/",
    "nvidia": "openai/",
}
OTHER_PREFIX = "openai/"

UPDATES_TYPE = "map<string,struct<action:string,reason:string,transformation:string>>"


def first_filled(*texts: Column) -> Column:
    """The first text that is neither null nor empty."""
    return F.coalesce(*[F.nullif(t, F.lit("")) for t in texts])


def prefix_if_absent(text: Column, prefix: str | Column) -> Column:
    head = F.lit(prefix) if isinstance(prefix, str) else prefix
    return F.when(F.startswith(text, head), text).otherwise(F.concat(head, text))


def file_extension(name: Column) -> Column:
    """Lower-cased text behind the last dot; null without a dot."""
    return F.when(F.contains(name, F.lit(".")), F.lower(F.substring_index(name, ".", -1)))


def iso_text(stamp: Column) -> Column:
    """ISO text of a timestamp; microseconds only when there are any."""
    text = F.replace(stamp.cast("string"), F.lit(" "), F.lit("T"))
    return F.when(F.contains(text, F.lit(".")), F.rpad(text, 26, "0")).otherwise(text)


# -- JSON answers -------------------------------------------------------------

def without_fence(text: Column) -> Column:
    """The text inside a code fence; text that does not start with one is only trimmed."""
    trimmed = strip(text)
    inside = F.regexp_replace(trimmed, rf"^{FENCE}[^\n]*(\n|\z)|\n{FENCE}[^\n]*\z", "")
    return F.when(F.startswith(trimmed, F.lit(FENCE)), strip(inside)).otherwise(trimmed)


def json_document(text: Column) -> Column:
    """The text if it is exactly one JSON value, else null.

    The JSON functions ignore what stands behind a value. So it is read as the only
    element of an array and as a field with another behind it: text that closes the
    one early leaves the other broken.
    """
    strict = {"allowSingleQuotes": "false"}
    items = F.from_json(F.concat(F.lit("["), text, F.lit("]")), "array<string>", strict)
    fields = F.from_json(F.concat(F.lit('{"value":'), text, F.lit(',"end":1}')), "value string, end int", strict)
    whole = F.coalesce(fields["end"] == 1, F.lit(False))
    return let(items, lambda found: F.when((F.size(found) == 1) & whole, F.get(found, F.lit(0))))


def json_answer(text: Column) -> Column:
    return json_document(without_fence(text))


# -- tagged block -------------------------------------------------------------

def _has_block(text: Column) -> Column:
    return F.contains(text, F.lit(START_TAG)) & F.contains(text, F.lit(END_TAG))


def visible_text(text: Column) -> Column:
    """What the user sees: the trimmed text before the block, or all of it without one."""
    before = F.substring_index(text, START_TAG, 1)
    return strip(F.when(_has_block(text), before).otherwise(text))


def tagged_updates(text: Column) -> Column:
    """The updates in the block as a map; no block or bad JSON gives null."""
    after = F.get(F.split(text, START_TAG), F.lit(1))
    block = strip(F.substring_index(after, END_TAG, 1))
    return F.when(_has_block(text), F.from_json(json_document(block), UPDATES_TYPE))


#: A private character between joined tokens.
MARK = "\ue000"


# -- tokens -------------------------------------------------------------------

def word_tokens(text: Column) -> Column:
    """The text cut at every blank, each piece with a trailing blank."""
    return F.transform(F.split(text, " "), lambda w: F.concat(w, F.lit(" ")))


def visible_tokens(tokens: Column) -> Column:
    """The leading tokens that are shown before the start tag is complete.

    A token is shown if it ends before the last character of the tag in the joined text. The
    tokens are joined with a mark between them, and the tag is searched with marks allowed
    inside it: the marks before its last character are the tokens that are shown. Null tokens
    are left out.
    """
    return let(F.array_compact(tokens), _shown_tokens)


def _shown_tokens(present: Column) -> Column:
    safe = F.when(
        F.contains(F.array_join(present, ""), F.lit(MARK)), F.transform(present, lambda t: F.translate(t, MARK, "?"))
    ).otherwise(present)
    tag = f"{MARK}*".join(re.escape(c) for c in START_TAG)
    # Up to the tag, if there is one, else nothing.
    before = F.regexp_extract(F.array_join(safe, MARK), f"(?s)\\A(.*?{tag})", 1)
    shown = F.length(before) - F.length(F.replace(before, F.lit(MARK)))
    return F.when(F.contains(F.array_join(present, ""), F.lit(START_TAG)), F.slice(present, F.lit(1), shown)).otherwise(present)


# -- markdown -----------------------------------------------------------------

def markdown_html(text: Column) -> Column:
    """Chat markdown as HTML: escape, bold, italic, code, line breaks, in this order."""
    out = F.replace(text, F.lit("&"), F.lit("&amp;"))
    out = F.replace(out, F.lit("<"), F.lit("&lt;"))
    out = F.replace(out, F.lit(">"), F.lit("&gt;"))
    for mark, tag in ((r"\*\*", "strong"), (r"\*", "em"), ("`", "code")):
        out = F.regexp_replace(out, f"{mark}(.+?){mark}", f"<{tag}>$1</{tag}>")
    return F.replace(out, F.lit("\n"), F.lit("<br>"))


# -- model names --------------------------------------------------------------

def model_name(requested: Column, configured: Column | None = None) -> Column:
    choices = [requested] + ([configured] if configured is not None else [])
    return F.coalesce(first_filled(*choices), F.lit(DEFAULT_MODEL))


def provider_of(model: Column, explicit: Column | None = None) -> Column:
    """The given provider, else the one the model name hints at."""
    hints = F.when(F.lit(False), F.lit(None).cast("string"))
    for part, provider in PROVIDER_HINTS:
        hints = hints.when(F.contains(F.lower(model), F.lit(part)), F.lit(provider))
    hinted = hints.otherwise(F.lit(DEFAULT_PROVIDER))
    return F.lower(hinted if explicit is None else F.coalesce(first_filled(explicit), hinted))


def qualified_model(model: Column, provider: Column, has_base_url: Column | bool = False) -> Column:
    """The model name with its provider's prefix.

    An unknown provider takes a prefix only together with a base address.
    """
    prefix = F.when(F.lit(False), F.lit(None).cast("string"))
    for name, text in PROVIDER_PREFIX.items():
        prefix = prefix.when(provider == name, F.lit(text))
    prefix = prefix.when(F.lit(has_base_url) if isinstance(has_base_url, bool) else has_base_url, F.lit(OTHER_PREFIX))
    prefix = prefix.otherwise(F.lit(""))
    return prefix_if_absent(model, prefix)
