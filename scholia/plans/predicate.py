"""Boolean queries as Spark predicates over articles.

Every term of a query is put in the place of a SQL condition on the article's
columns, AND, OR, NOT and parentheses stay, and Spark's own SQL grammar reads the
whole as one expression for Catalyst. Queries are read from left to right: at
each operator what was read so far is put in parentheses, so that `a OR b AND c`
is `(a OR b) AND c`; `a NOT b` and `a b` mean a AND NOT b and a AND b. A tag behind
a group goes to each of its terms.

A condition is true or false, never null: an article without a title has no word
in its title, so that NOT finds it. Conditions on whole columns (languages, dates,
abstracts) are left as Parquet's readers know them and reach the scan.

Articles have title, abstract, authors, lang, mesh_terms, publication_types,
subsets, date_from and date_to (the days that a partial date may mean); columns
that a table lacks are added empty by with_search_columns().
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scholia.operators.topics import term_score
from scholia.plans.request import LANGUAGES, InvalidRequest

_GROUP_END = re.compile(r"\)\s*\[([^\]]+)\]")
_RANGE = re.compile(r'("?)(\d{4}(?:/\d{2}(?:/\d{2})?)?)\1\s*\[Date - Publication\]\s*:\s*("?)(\d{4}(?:/\d{2}(?:/\d{2})?)?)\3\s*\[Date - Publication\]')
_PIECE = re.compile(r'"([^"]*)"(?:\s*\[([^\]]+)\])?|(\()|(\))|\b(AND|OR|NOT)\b|((?:(?!\b(?:AND|OR|NOT)\b)[^()"\[\]])+)(?:\[([^\]]+)\])?')
_SEARCHED = {"title/abstract": ["title", "abstract"], "title": ["title"], "abstract": ["abstract"], "author": ["authors"], "all_fields": ["title", "abstract", "authors", "journal"]}
_ARRAYS = {"mesh": "mesh_terms", "mh": "mesh_terms", "ptyp": "publication_types", "pt": "publication_types"}


def _quoted(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _words(text: str, columns: list[str], phrase: bool) -> str:
    terms = [text] if phrase else text.split()
    either = lambda t: "(" + " OR ".join(f"coalesce(contains(lower({c}), {_quoted(t.lower())}), false)" for c in columns) + ")"
    return "(" + " AND ".join(map(either, terms)) + ")"


def _condition(text: str, tag: str | None, phrase: bool, columns: list[str]) -> str:
    text, kind = " ".join(text.split()), (tag or "").strip().lower()
    if kind in _ARRAYS:
        return f"coalesce(exists({_ARRAYS[kind]}, x -> lower(x) <=> {_quoted(text.lower())}), false)"
    if kind == "lang":
        return f"(lang <=> {_quoted(LANGUAGES.get(text.lower(), text.lower()))})"
    if kind == "text" and text == "hasabstract":
        return "(abstract IS NOT NULL AND abstract <> '' AND abstract <> 'No Abstract')"
    if kind == "sb":
        return f"coalesce(exists(subsets, x -> x <=> {_quoted(text.lower())}), false)"
    return _words(text, _SEARCHED.get(kind, columns), phrase)


def _day(text: str, last: bool) -> str:
    parts = [int(p) for p in text.split("/")]
    try:
        if len(parts) == 3:
            return f"DATE'{date(*parts).isoformat()}'"
        month = parts[1] if len(parts) == 2 else (12 if last else 1)
        first = date(parts[0], month, 1).isoformat()
    except ValueError as error:
        raise InvalidRequest(f"no such date: {text}") from error
    return f"last_day(DATE'{first}')" if last else f"DATE'{first}'"


def _tagged_groups(query: str) -> str:
    """The query with every tag behind a group moved to the group's terms without a tag of their own."""
    while (end := _GROUP_END.search(query)) is not None:
        depth, start = 1, end.start()
        while depth:
            start -= 1
            if start < 0:
                raise InvalidRequest("parentheses do not match")
            depth += (query[start] == ")") - (query[start] == "(")

        def tagged(piece: re.Match, tag: str = end[1]) -> str:
            phrase, phrase_tag, _, _, _, term, term_tag = piece.groups()
            if (phrase is None and not (term or "").strip()) or phrase_tag or term_tag:
                return piece[0]
            return f'"{phrase}"[{tag}]' if phrase is not None else f" {term.strip()}[{tag}] "

        query = query[:start] + "(" + _PIECE.sub(tagged, query[start + 1 : end.start()]) + ")" + query[end.end() :]
    return query


def _pieces(query: str) -> Iterator[tuple[str, re.Match]]:
    """range, open, close, AND, OR, NOT or term, with its match; InvalidRequest for what is none of these."""
    at = 0
    for span in [*_RANGE.finditer(query), None]:
        stop = span.start() if span else len(query)
        while at < stop:
            piece = _PIECE.match(query, at, stop)
            if piece is None:
                if not query[at].isspace():
                    raise InvalidRequest(f"cannot read the query at {query[at : at + 20]!r}")
                at += 1
                continue
            at = piece.end()
            _, _, opened, closed, word, term, _ = piece.groups()
            if term is None or term.strip():
                yield "open" if opened else "close" if closed else word or "term", piece
        if span:
            yield "range", span
            at = span.end()


def read(query: str, search_field: str, term: Callable, dates: Callable, both: Callable, either: Callable, negated: Callable):
    """A query folded from left to right: term(text, tag, is_phrase, columns) and dates(first, last) give values, the others combine them."""
    columns = _SEARCHED[search_field]
    # What was read on each level of parentheses, the operator that waits for an operand, and whether it is negated.
    levels: list[list] = [[None, "", False]]

    def operand(value) -> None:
        held, word, minus = levels[-1]
        value = negated(value) if minus else value
        levels[-1] = [value if held is None else (either if word == "OR" else both)(held, value), "", False]

    for kind, piece in _pieces(_tagged_groups(query)):
        held, word, minus = levels[-1]
        if kind in ("AND", "OR"):
            if held is None or word or minus:
                raise InvalidRequest(f"{kind} without a term before it")
            levels[-1][1] = kind
        elif kind == "NOT":
            levels[-1][2] = not minus
        elif kind == "open":
            levels.append([None, "", False])
        elif kind == "close":
            if len(levels) == 1 or held is None or word or minus:
                raise InvalidRequest("a closing parenthesis without a group or a term before it")
            levels.pop()
            operand(held)
        elif kind == "range":
            operand(dates(_day(piece[2], False), _day(piece[4], True)))
        else:
            phrase, phrase_tag, _, _, _, text, tag = piece.groups()
            if phrase is not None and not phrase.strip():
                raise InvalidRequest("an empty phrase")
            operand(term(phrase if phrase is not None else text, phrase_tag if phrase is not None else tag, phrase is not None, columns))
    held, word, minus = levels[-1]
    if len(levels) > 1 or word or minus or held is None:
        raise InvalidRequest("a query that ends too early" if held is not None else "a query without terms")
    return held


def condition_sql(query: str, search_field: str = "title/abstract") -> str:
    """The SQL condition of a normalised boolean query; InvalidRequest if it is not one."""
    return read(
        query, search_field, _condition, lambda first, last: f"(date_to IS NOT NULL AND date_from IS NOT NULL AND date_to >= {first} AND date_from <= {last})",
        "({} AND {})".format, "({} OR {})".format, "NOT {}".format,
    )


def searched_columns(tag: str | None, columns: list[str]) -> list[str] | None:
    """The columns whose texts a term with that tag is looked for in; None for tags of another kind."""
    kind = (tag or "").strip().lower()
    return None if kind in _ARRAYS or kind in ("lang", "text", "sb") else _SEARCHED.get(kind, columns)


def compile_query(query: str, search_field: str = "title/abstract") -> Column:
    """A boolean query as one Column, true or false for every article."""
    return F.expr(condition_sql(query, search_field))


def query_words(query: str) -> list[str]:
    """What a query looks for in texts: phrases and words that are not behind a NOT or a tag of another column."""
    found: list[str] = []
    negated, depth = [False], False
    for kind, piece in _pieces(_tagged_groups(query)):
        if kind == "open":
            negated.append(negated[-1] or depth)
        elif kind == "close":
            negated = negated[:-1] or [False]
        elif kind == "term" and not (negated[-1] or depth):
            phrase, phrase_tag, _, _, _, term, tag = piece.groups()
            if ((phrase_tag if phrase is not None else tag) or "title").strip().lower() in _SEARCHED:
                found += [phrase.lower()] if phrase is not None else term.lower().split()
        depth = kind == "NOT"
    return list(dict.fromkeys(found))


def relevance(query: str, search_field: str = "title/abstract") -> Column:
    """How often what a query looks for occurs in the columns that it searches."""
    return term_score(F.concat_ws("\n", *_SEARCHED[search_field]), query_words(query))


def with_search_columns(articles: DataFrame) -> DataFrame:
    """articles with every column that queries may name."""
    empty = F.array().cast("array<string>")
    missing = {
        "authors": F.lit("Unknown Authors"), "journal": F.lit("Unknown Journal"), "lang": F.lit(None).cast("string"), "mesh_terms": empty, "publication_types": empty,
        "keywords": empty, "subsets": empty, "date_from": F.lit(None).cast("date"), "date_to": F.lit(None).cast("date"),
    }
    return articles.withColumns({name: value for name, value in missing.items() if name not in articles.columns})


def search(articles: DataFrame, query: str, search_field: str = "title/abstract") -> DataFrame:
    """The articles that a boolean query finds."""
    return with_search_columns(articles).where(compile_query(query, search_field))
