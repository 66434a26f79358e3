"""Text functions as Columns: stripping, padding, query clean-up, citations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Prompt fragments that must not show in an answer, removed in this order.
PROMPT_MARKERS = [
    "Available research papers:",
    "User's question:",
    "CRITICAL INSTRUCTIONS:",
    "Research papers:",
    "Papers:",
    "Query:",
    "Question:",
    "{context}",
    "{question}",
    "RESPONSE GUIDELINES:",
    "Remember:",
]
APOLOGY = "I apologize, but I couldn't generate a proper response. Could you please rephrase your question?"
NO_DOCUMENTS = (
    "I don't have specific information about that in the current research papers."
    " Could you rephrase your question or ask about something else from the research?"
)
COVERAGE_WORDS = ["all articles", "every study", "comprehensive", "systematic review"]


def strip(text: Column) -> Column:
    """text without white space of any kind at its ends; trim() knows spaces alone."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def contains_any(text: Column, words: list[str]) -> Column:
    """Whether the lower-cased text contains one of the words."""
    return reduce(lambda a, b: a | b, [F.contains(F.lower(text), F.lit(w)) for w in words])


def sanitize_topic(topic: Column) -> Column:
    """A topic for a search: quoted phrases as they are, else without quotes and extra space; blank is empty."""
    bare = strip(F.coalesce(topic, F.lit("")))
    quoted = F.startswith(bare, F.lit('"')) & F.endswith(bare, F.lit('"'))
    loose = F.regexp_replace(F.replace(bare, F.lit('"'), F.lit("")), r"(?U)\s+", " ")
    return F.when(quoted, bare).otherwise(loose)


def normalize_boolean(query: Column) -> Column:
    """A boolean query with single spaces and upper-case AND, OR, NOT."""
    out = F.regexp_replace(strip(query), r"(?U)\s+", " ")
    for word in ("AND", "OR", "NOT"):
        out = F.regexp_replace(out, rf"(?iU)\s*\b{word}\b\s*", f" {word} ")
    return out


def clean_answer(answer: Column) -> Column:
    """An answer without prompt fragments and blank lines in a row; too short ones become an apology."""
    out = reduce(lambda text, marker: F.replace(text, F.lit(marker), F.lit("")), PROMPT_MARKERS, F.coalesce(answer, F.lit("")))
    out = strip(F.regexp_replace(out, "\n{3,}", "\n\n"))
    return F.when(F.length(out) < 10, F.lit(APOLOGY)).otherwise(out)


def cited_ids(answer: Column) -> Column:
    """Distinct article ids cited as `PMID: n`."""
    return F.array_distinct(F.regexp_extract_all(answer, F.lit(r"PMID:(?U:\s)*(\d+)"), 1))


def with_coverage_note(question: Column, answer: Column, expected: Column) -> Column:
    """The cleaned answer; if a question about all studies got less than half of them, with a note."""
    cleaned = clean_answer(answer)
    cited = F.size(cited_ids(cleaned))
    # Fixed value: the note.
    note = F.format_string(
        "\n\n*Note: This analysis covers %d of %d available studies. For a complete analysis of all studies,"
        " consider breaking down your query into specific aspects.*",
        cited.cast("long"),
        expected.cast("long"),
    )
    short = contains_any(question, COVERAGE_WORDS) & (cited < 0.5 * expected) & (expected > 5)
    return F.when(short, F.concat(cleaned, note)).otherwise(cleaned)
