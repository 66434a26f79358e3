"""The fielded boolean query of a request, as text."""

from __future__ import annotations

import re
from datetime import date, timedelta

from scholia.plans.request import AGE_GROUPS, ARTICLE_TYPES, DATE_SPANS, OTHER_FILTERS, TEXT_AVAILABILITY, Filters, InvalidRequest, TopicRequest

DATE_TAG = "[Date - Publication]"


def sanitize(topic: str) -> str:
    bare = topic.strip()
    if bare.startswith('"') and bare.endswith('"'):
        return bare
    return " ".join(bare.replace('"', "").split()) if bare.replace('"', "").strip() else re.sub(r"\s+", " ", bare.replace('"', ""))


def normalize(query: str) -> str:
    out = re.sub(r"\s+", " ", query.strip())
    for word in ("AND", "OR", "NOT"):
        out = re.sub(rf"\s*\b{word}\b\s*", f" {word} ", out, flags=re.I)
    return out


def topics_query(topics: list[str], operator: str = "AND") -> str:
    """Topics under one operator; NOT takes the first without the others."""
    clean = [s for t in topics if (s := sanitize(t))]
    if not clean:
        raise InvalidRequest("no topic with words")
    grouped = [f"({t})" for t in clean]
    if operator == "NOT":
        if len(clean) < 2:
            raise InvalidRequest("NOT needs two topics or more")
        rest = " AND ".join(f"NOT {t}" for t in grouped[1:])
        return f"{grouped[0]} AND ({rest})"
    return grouped[0] if len(grouped) == 1 else f"({f' {operator} '.join(grouped)})"


def date_clause(filters: Filters, as_of: date) -> str:
    start, end = filters.custom_start_date, filters.custom_end_date
    if filters.publication_date in DATE_SPANS:
        days = 365 * DATE_SPANS[filters.publication_date]
        start, end = ((as_of - timedelta(days=n)).strftime("%Y/%m/%d") for n in (days, 0))
    elif filters.publication_date != "custom" or not (start or end):
        return ""
    if start and end:
        return f'("{start}"{DATE_TAG} : "{end}"{DATE_TAG})'
    return f'"{start}"{DATE_TAG} : 3000{DATE_TAG}' if start else f'1900{DATE_TAG} : "{end}"{DATE_TAG}'


def _species(name: str) -> str:
    return "animals[mh] NOT humans[mh]" if name == "other_animals" else f"{name}[mh]"


def filter_clauses(filters: Filters, as_of: date) -> list[str]:
    """One clause for each kind of filter; values of a kind are alternatives, other filters stand alone."""
    kinds = [
        [TEXT_AVAILABILITY[v] for v in filters.text_availability or []],
        [f"{ARTICLE_TYPES[v]}[ptyp]" for v in filters.article_types or []],
        [f"{v}[lang]" for v in filters.languages or []],
        [_species(v) for v in filters.species or []],
        [f"{v}[mh]" for v in filters.sex or []],
        [f"{AGE_GROUPS[v]}[mh]" for v in filters.age_groups or []],
    ]
    dates = date_clause(filters, as_of)
    clauses = [dates] if dates else []
    clauses += [f"({' OR '.join(values)})" for values in kinds if values]
    clauses += [OTHER_FILTERS[v] for v in filters.other_filters or []]
    return clauses + [f"({normalize(v)})" for v in filters.custom_filters or []]


def complete_query(request: TopicRequest, as_of: date) -> str:
    """The whole query: an advanced one, else topics, else one topic, with all filters."""
    if request.advanced_query:
        base = normalize(request.advanced_query)
    elif request.topics:
        base = topics_query(request.topics, request.operator)
    else:
        base = normalize(request.topic)
    clauses = filter_clauses(request.filters, as_of)
    return f"{base} AND ({' AND '.join(clauses)})" if clauses else base
