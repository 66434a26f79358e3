"""Search requests and their filters: validation, parameters, description."""

from __future__ import annotations

import re
from dataclasses import asdict, dataclass, field
from datetime import datetime

# The options of a request and the query fragments that they stand for.
OPERATORS = ["AND", "OR", "NOT"]
DATE_SPANS = {"1_year": 1, "5_years": 5, "10_years": 10}
TEXT_AVAILABILITY = {"abstract": "hasabstract[text]", "full_text": "full text[sb]", "free_full_text": "free full text[sb]"}
ARTICLE_TYPES = {
    "clinical_trial": "Clinical Trial",
    "randomized_controlled_trial": "Randomized Controlled Trial",
    "meta_analysis": "Meta-Analysis",
    "systematic_review": "Systematic Review",
    "review": "Review",
    "case_reports": "Case Reports",
    "comparative_study": "Comparative Study",
    "observational_study": "Observational Study",
    "practice_guideline": "Practice Guideline",
    "editorial": "Editorial",
    "letter": "Letter",
    "comment": "Comment",
    "news": "News",
    "biography": "Biography",
    "congress": "Congress",
    "consensus_development_conference": "Consensus Development Conference",
    "guideline": "Guideline",
}
#: Languages with the codes that tables use.
LANGUAGES = {
    "english": "en", "spanish": "es", "french": "fr", "german": "de", "italian": "it", "japanese": "ja", "portuguese": "pt",
    "russian": "ru", "chinese": "zh", "dutch": "nl", "polish": "pl", "swedish": "sv", "danish": "da", "norwegian": "no",
    "finnish": "fi", "czech": "cs", "hungarian": "hu", "korean": "ko", "turkish": "tr", "arabic": "ar", "hebrew": "he",
}
SPECIES = ["humans", "other_animals", "mice", "rats", "dogs", "cats", "rabbits", "primates", "swine", "sheep", "cattle"]
SEX = ["female", "male"]
AGE_GROUPS = {
    "child": "child",
    "adult": "adult",
    "aged": "aged",
    "infant": "infant",
    "infant_newborn": "infant, newborn",
    "child_preschool": "child, preschool",
    "adolescent": "adolescent",
    "young_adult": "young adult",
    "middle_aged": "middle aged",
    "aged_80_and_over": "aged, 80 and over",
}
OTHER_FILTERS = {
    "exclude_preprints": "NOT preprint[pt]",
    "medline": "medline[sb]",
    "pubmed_not_medline": "pubmed not medline[sb]",
    "in_process": "in process[sb]",
    "publisher": "publisher[sb]",
    "pmc": "pmc[sb]",
    "nihms": "nihms[sb]",
}
SORTS = ["relevance", "publication_date", "first_author", "last_author", "journal", "title"]
SEARCH_FIELDS = ["title/abstract", "title", "abstract", "author", "all_fields"]

_CHOICES = {
    "text_availability": list(TEXT_AVAILABILITY), "article_types": list(ARTICLE_TYPES), "languages": list(LANGUAGES), "species": SPECIES,
    "sex": SEX, "age_groups": list(AGE_GROUPS), "other_filters": list(OTHER_FILTERS),
}


class InvalidRequest(ValueError):
    """A request that cannot be searched for."""


@dataclass
class Filters:
    publication_date: str | None = None
    custom_start_date: str | None = None
    custom_end_date: str | None = None
    text_availability: list[str] | None = None
    article_types: list[str] | None = None
    languages: list[str] | None = None
    species: list[str] | None = None
    sex: list[str] | None = None
    age_groups: list[str] | None = None
    other_filters: list[str] | None = None
    custom_filters: list[str] | None = None
    sort_by: str = "relevance"
    search_field: str = "title/abstract"

    def __post_init__(self) -> None:
        """Empty options become none; dates must be real, the rest from the vocabularies."""
        for name, value in asdict(self).items():
            if value in ("", []):
                setattr(self, name, None)
        self.sort_by = self.sort_by or "relevance"
        self.search_field = self.search_field or "title/abstract"
        if self.publication_date not in (None, "custom", *DATE_SPANS):
            raise InvalidRequest(f"unknown publication date {self.publication_date!r}")
        for value in (self.custom_start_date, self.custom_end_date):
            if value is not None:
                if not re.fullmatch(r"\d{4}/\d{2}/\d{2}", value):
                    raise InvalidRequest("dates are written YYYY/MM/DD")
                try:
                    datetime.strptime(value, "%Y/%m/%d")
                except ValueError as error:
                    raise InvalidRequest(f"no such date: {value}") from error
        for name, known in _CHOICES.items():
            if unknown := set(getattr(self, name) or []) - set(known):
                raise InvalidRequest(f"unknown {name}: {sorted(unknown)}")
        if self.sort_by not in SORTS or self.search_field not in SEARCH_FIELDS:
            raise InvalidRequest("unknown sort or search field")

    def params(self) -> dict:
        """The options that are set."""
        return {k: v for k, v in asdict(self).items() if v is not None}


@dataclass
class TopicRequest:
    topics: list[str] | None = None
    operator: str = "AND"
    topic: str | None = None
    advanced_query: str | None = None
    max_results: int = 20
    filters: Filters = field(default_factory=Filters)
    auto_transform: bool = True
    create_embeddings: bool = True

    def __post_init__(self) -> None:
        """Exactly one way of searching, with something in it."""
        given = [bool([t for t in self.topics or [] if t and t.strip()]), bool((self.topic or "").strip()), bool((self.advanced_query or "").strip())]
        if sum(given) != 1:
            raise InvalidRequest("give one of topics, topic and advanced_query" if sum(given) else "nothing to search for")
        if self.operator not in OPERATORS:
            raise InvalidRequest(f"unknown operator {self.operator!r}")
        if self.topics:
            self.topics = [t.strip() for t in self.topics if t and t.strip()]
            if self.operator == "NOT" and len(self.topics) < 2:
                raise InvalidRequest("NOT needs two topics or more")
        if not isinstance(self.max_results, int) or not 1 <= self.max_results <= 10_000:
            raise InvalidRequest("max_results is a number from 1 to 10000")
        if isinstance(self.filters, dict):
            self.filters = Filters(**self.filters)

    def params(self) -> dict:
        """What is set, with the filters' own parameters."""
        own = {k: v for k, v in asdict(self).items() if v is not None and k != "filters"}
        return own | ({"filters": self.filters.params()} if self.filters else {})

    def description(self) -> str:
        """One line that names the search."""
        if self.topics:
            return f"Multi-topic search: {self.topics} with {self.operator}"
        return f"Single topic: {self.topic}" if self.topic else f"Advanced query: {self.advanced_query[:100]}..."

    def timeout(self) -> int:
        """Seconds that an ingest of this size may take."""
        return 60 + 2 * self.max_results
