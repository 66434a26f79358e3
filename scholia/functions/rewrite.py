"""Natural-language questions to fielded boolean queries, as Columns over a table of questions."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scholia.functions.text import contains_any, strip

# Vocabularies of the rewrite; order matters in all of them.
SYNTAX = ["[mesh]", "[title/abstract]", "[ptyp]", " and ", " or ", " not "]
INDICATORS = [
    "?", " is ", " are ", " was ", " were ", "how ", "what ", "when ", "where ", "why ", "which ",
    "effect", "relationship", "between", "among", "cause", "treatment", "diagnos", "prevent", "risk",
    "what's", "how's", "i'm", "i am", "research", "studying", "looking for", "interested in",
]
SYNONYMS = [
    ("heart attack", "myocardial infarction"),
    ("high blood pressure", "hypertension"),
    ("low blood pressure", "hypotension"),
    ("sugar", "glucose"),
    ("diabetes", "diabetes mellitus"),
    ("cancer", "neoplasm"),
    ("tumor", "neoplasm"),
    ("stroke", "cerebrovascular accident"),
    ("copd", "chronic obstructive pulmonary disease"),
    ("ptsd", "post traumatic stress disorder"),
    ("adhd", "attention deficit hyperactivity disorder"),
    ("mrsa", "methicillin resistant staphylococcus aureus"),
    ("uti", "urinary tract infection"),
    ("mi", "myocardial infarction"),
    ("hiv", "human immunodeficiency virus"),
    ("aids", "acquired immunodeficiency syndrome"),
    ("covid", "COVID-19"),
    ("covid-19", "SARS-CoV-2"),
    ("coronavirus", "COVID-19"),
    ("covid vaccine", "COVID-19 vaccines"),
    ("covid-19 vaccine", "SARS-CoV-2 vaccine"),
    ("covid vaccines", "COVID-19 vaccines"),
]
END = r"(?:\?|$)"
TOPIC = "({X}[MeSH] OR {X}[Title/Abstract])"
TEMPLATES = [
    (
        f"{TOPIC} AND ({{Y}}[MeSH] OR {{Y}}[Title/Abstract])",
        [rf"(?:what is the |what's the |)effect(?:s|) of (.+?) on (.+?){END}", rf"how does (.+?) affect (.+?){END}", rf"impact of (.+?) on (.+?){END}"],
    ),
    (
        "({X}[Title/Abstract] OR {Y}[Title/Abstract]) AND (comparison[MeSH] OR versus[Title/Abstract] OR compared[Title/Abstract])",
        [rf"(.+?) (?:vs\.?|versus|compared to|compared with) (.+?){END}", rf"difference(?:s|) between (.+?) and (.+?){END}", rf"comparison of (.+?) and (.+?){END}"],
    ),
    (
        f"{TOPIC} AND (therapeutics[MeSH] OR therapy[MeSH] OR treatment[Title/Abstract])",
        [rf"(?:treatment|therapy|therapies|medication|medicine) (?:for|of) (.+?){END}", rf"how to treat (.+?){END}", r"(.+?) treatment options", rf"what treats (.+?){END}"],
    ),
    (
        f"{TOPIC} AND (adverse effects[MeSH] OR side effects[Title/Abstract] OR adverse events[Title/Abstract])",
        [rf"(.+?) side effect(?:s|){END}", rf"side effect(?:s|) of (.+?){END}", rf"adverse effect(?:s|) of (.+?){END}", rf"(.+?) adverse effect(?:s|){END}", rf"risks of (.+?){END}"],
    ),
    (
        f"{TOPIC} AND (mechanism[MeSH] OR mechanism of action[Title/Abstract] OR pathophysiology[MeSH])",
        [rf"how does (.+?) work{END}", rf"mechanism of (.+?){END}", r"(.+?) mechanism of action", rf"pathophysiology of (.+?){END}"],
    ),
    (
        f"{TOPIC} AND (diagnosis[MeSH] OR diagnostic[Title/Abstract])",
        [rf"how to diagnose (.+?){END}", rf"diagnosis of (.+?){END}", r"(.+?) diagnosis", rf"diagnostic (?:test|tests|criteria) for (.+?){END}"],
    ),
    (f"{TOPIC} AND ({{Y}}[MeSH] OR {{Y}}[Title/Abstract])", [rf"(.+?) in (.+?){END}", rf"(.+?) among (.+?){END}"]),
]
#: The last template holds for these populations alone.
POPULATIONS = ["children", "elderly", "women", "men", "adults", "patients"]
LEADING = ["latest", "recent", "new", "current", "emerging", "novel"]
NOW_WORDS = ["latest", "recent", "new", "current", "emerging"]
STUDY_TYPES = [
    ("clinical trial", "Clinical Trial[ptyp]"),
    ("randomized", "Randomized Controlled Trial[ptyp]"),
    ("meta-analysis", "Meta-Analysis[ptyp]"),
    ("systematic review", "Systematic Review[ptyp]"),
    ("review", "Review[ptyp]"),
    ("case study", "Case Reports[ptyp]"),
    ("cohort", "Cohort Studies[ptyp]"),
]
#: First years of the spans that questions name, by default those of the original vocabulary.
YEARS = {"now": "2019", "last year": "2023", "5 years": "2019", "10 years": "2014"}


def is_natural_language(text: Column) -> Column:
    """Whether a text is a question in words and has no query syntax."""
    return ~contains_any(text, SYNTAX) & contains_any(text, INDICATORS)


def _entries(rows: list[tuple], *names: str) -> Column:
    """A constant array of structs, to be looked through in order."""
    return F.array(*[F.struct(*[F.lit(v).alias(n) for n, v in zip(names, row, strict=True)]) for row in rows])


def expand_synonyms(term: Column) -> Column:
    """A term with its synonym: an exact entry first, else the first entry that it contains anywhere."""
    lowered = strip(F.lower(term))
    entries = _entries(SYNONYMS, "word", "synonym")
    exact = F.get(F.filter(entries, lambda e: e["word"] == lowered), F.lit(0))
    inside = F.get(F.filter(entries, lambda e: F.contains(lowered, e["word"])), F.lit(0))
    swapped = F.replace(lowered, inside["word"], F.concat(inside["word"], F.lit(" OR "), inside["synonym"]))
    whole = F.concat(F.lit("("), term, F.lit(" OR "), exact["synonym"], F.lit(")"))
    return F.coalesce(whole, F.concat(F.lit("("), swapped, F.lit(")")), term)


def _without_leading(term: Column) -> Column:
    """The stripped term without temporal words at its start, tried once each in order."""
    return reduce(lambda t, word: F.regexp_replace(t, f"^{word} ", ""), LEADING, strip(term))


def match_template(text: Column) -> Column:
    """struct(template, x, y) of the first pattern that fits, null if none; y is empty for one-part templates."""
    lowered = strip(F.lower(text))
    rows = [(n, pattern, pattern.count("(.+?)") == 2) for n, (_, patterns) in enumerate(TEMPLATES) for pattern in patterns]

    def terms(entry: Column) -> Column:
        y = F.when(entry["two"], _without_leading(F.call_function("regexp_extract", lowered, entry["pattern"], F.lit(2)))).otherwise(F.lit(""))
        return F.struct(entry["template"].alias("template"), _without_leading(F.call_function("regexp_extract", lowered, entry["pattern"], F.lit(1))).alias("x"), y.alias("y"))

    fitting = F.filter(_entries(rows, "template", "pattern", "two"), lambda e: F.rlike(lowered, e["pattern"]))
    last = len(TEMPLATES) - 1
    return F.get(F.filter(F.transform(fitting, terms), lambda m: (m["template"] < last) | contains_any(m["y"], POPULATIONS)), F.lit(0))


def fill_template(number: Column, x: Column, y: Column) -> Column:
    """The template of that number with its terms."""
    template = F.get(F.array(*[F.lit(t) for t, _ in TEMPLATES]), number)
    return F.replace(F.replace(template, F.lit("{X}"), x), F.lit("{Y}"), y)


def temporal_suffix(text: Column, years: dict[str, str] = YEARS) -> Column:
    """The date clause that a question asks for, or an empty text."""
    clause = lambda year: F.lit(f' AND ("{year}"[Date - Publication] : "3000"[Date - Publication])')
    return (
        F.when(contains_any(text, NOW_WORDS), clause(years["now"]))
        .when(contains_any(text, ["last year"]), clause(years["last year"]))
        .when(contains_any(text, ["last 5 years", "past 5 years"]), clause(years["5 years"]))
        .when(contains_any(text, ["last 10 years", "past 10 years"]), clause(years["10 years"]))
        .otherwise(F.lit(""))
    )


def study_type_suffix(text: Column) -> Column:
    """The clause of the first study type that a question names, or an empty text."""
    out = None
    for word, clause in STUDY_TYPES:
        named, value = contains_any(text, [word]), F.lit(f" AND {clause}")
        out = F.when(named, value) if out is None else out.when(named, value)
    return out.otherwise(F.lit(""))


def rewrite_questions(questions: DataFrame, text_col: str = "text", fallback: Callable[[Column], Column] | None = None) -> DataFrame:
    """questions with natural (is it one in words), template (number of the pattern, null if none) and query.

    Texts in query syntax stay as they are. Questions without a pattern take
    fallback(text), by default themselves; date and study clauses follow.
    """
    text = F.col(text_col)
    # One projection for each step, so that no step's expression is repeated inside the next.
    matched = questions.withColumn("natural", is_natural_language(text)).withColumn("_match", F.when(F.col("natural"), match_template(text)))
    spread = matched.withColumn("_x", expand_synonyms(F.col("_match.x"))).withColumn("_y", expand_synonyms(F.col("_match.y")))
    filled = fill_template(F.col("_match.template"), F.col("_x"), F.col("_y"))
    body = F.coalesce(filled, fallback(text) if fallback else text, text)
    query = F.when(F.col("natural"), F.concat(body, temporal_suffix(text), study_type_suffix(text))).otherwise(text)
    return spread.select(*questions.columns, "natural", F.col("_match.template").alias("template"), query.alias("query"))


def explanation(original: Column, transformed: Column) -> Column:
    """What a rewrite did, in a few lines."""
    # The notes, in this order.
    notes = [
        ("[MeSH]", "Added MeSH terms for precise medical concept matching"),
        (" OR ", "Included synonyms to capture more relevant articles"),
        ("[Date - Publication]", "Added date filter for recent research"),
        ("[ptyp]", "Filtered by study type for higher quality evidence"),
    ]
    lines = [F.when(F.contains(transformed, F.lit(mark)), F.lit(f"• {note}\n")).otherwise(F.lit("")) for mark, note in notes]
    return F.concat(F.lit("Original: "), original, F.lit("\nTransformed: "), transformed, F.lit("\n\n"), *lines)
