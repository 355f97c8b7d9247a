"""Text clean-up and tokenising as built-in column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------
# Patterns, written with explicit Unicode classes so that they
# mean the same in Java and in other regular-expression engines.
# ---------------------------------------------------------------------------
SPACE = r"\t\n\x0B\f\r\x1C-\x1F\x85\p{Z}"
WORD = r"\p{L}\p{N}_"
URL_PATTERN = rf"https?://[^{SPACE}]+"
LOOSE_URL_PATTERN = rf"http[^{SPACE}]+"
MENTION_PATTERN = rf"@[{WORD}]+"
ASCII_MENTION_PATTERN = r"@[A-Za-z0-9_]+"
HASHTAG_PATTERN = rf"#[{WORD}]+"
TOKEN_PATTERN = rf"[{WORD}]+"


def _without(text: Column, mark: str, pattern: str) -> Column:
    """Delete matches; text that lacks the mark every match contains skips the pattern."""
    return F.when(F.contains(text, F.lit(mark)), F.regexp_replace(text, pattern, "")).otherwise(text)


def clean_for_terms(text: Column) -> Column:
    """Drop URLs, ASCII mentions and the repost mark; tabs and newlines become spaces."""
    out = _without(text, "http", LOOSE_URL_PATTERN)
    out = _without(out, "@", ASCII_MENTION_PATTERN)
    out = F.replace(out, F.lit("RT "), F.lit(""))
    return F.translate(out, "\n\t", "  ")


def clean_for_lexicon(text: Column) -> Column:
    """Drop URLs, Unicode mentions and hashtags."""
    out = _without(text, "http", URL_PATTERN)
    out = _without(out, "@", MENTION_PATTERN)
    return _without(out, "#", HASHTAG_PATTERN)


def collapse_spaces(text: Column) -> Column:
    """Trim and squeeze runs of white space; null becomes the empty string."""
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), f"[{SPACE}]+", " "))


def flatten_lines(text: Column) -> Column:
    """Null becomes empty, newline becomes space, carriage return is dropped."""
    return F.translate(F.coalesce(text, F.lit("")), "\n\r", " ")


def tokenize(text: Column) -> Column:
    """Runs of letters, digits and underscores; null text has no tokens."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(TOKEN_PATTERN), 0)


def topic_prefixed(topic: Column, text: Column) -> Column:
    """Input text of a topic-aware stance scorer."""
    return F.concat_ws(" [SEP] ", topic, F.coalesce(text, F.lit("")))
