"""Requests, query text, rewriting and predicates."""

import re
from datetime import date

import pytest
from pyspark.sql import functions as F

from scholia.functions.rewrite import rewrite_questions
from scholia.functions.text import APOLOGY, clean_answer, normalize_boolean, sanitize_topic, strip, with_coverage_note
from scholia.plans import engine
from scholia.plans.predicate import compile_query, condition_sql, query_words, relevance, search
from scholia.plans.query_text import complete_query, date_clause, normalize, sanitize, topics_query
from scholia.plans.request import Filters, InvalidRequest, TopicRequest

X = "({0}[MeSH] OR {0}[Title/Abstract])".format
NOW = ' AND ("2019"[Date - Publication] : "3000"[Date - Publication])'
EFFECTS = " AND (adverse effects[MeSH] OR side effects[Title/Abstract] OR adverse events[Title/Abstract])"
REWRITES = {
    "Effects of shift work on blood sugar": f"{X('shift work')} AND {X('(blood sugar OR glucose)')}",
    "Is walking versus running better for knees?": "(is walking[Title/Abstract] OR running better for knees[Title/Abstract]) AND (comparison[MeSH] OR versus[Title/Abstract] OR compared[Title/Abstract])",
    "how to treat gout": f"{X('gout')} AND (therapeutics[MeSH] OR therapy[MeSH] OR treatment[Title/Abstract])",
    "what treats ptsd?": f"{X('(ptsd OR post traumatic stress disorder)')} AND (therapeutics[MeSH] OR therapy[MeSH] OR treatment[Title/Abstract])",
    "side effects of vitamins?": f"{X('(vitami OR myocardial infarctionns)')}{EFFECTS}",
    "diagnosis of new coronavirus": f"{X('(coronavirus OR COVID-19)')} AND (diagnosis[MeSH] OR diagnostic[Title/Abstract]){NOW}",
    "asthma in children?": f"{X('asthma')} AND {X('children')}",
    "asthma in gardens?": "asthma in gardens?",
    "which review should I read?": "which review should I read? AND Review[ptyp]",
    "What should a traveller know?": "What should a traveller know?",
    "(asthma[MeSH]) AND steroids[Title/Abstract]": "(asthma[MeSH]) AND steroids[Title/Abstract]",
    "plain words only": "plain words only",
}


def test_rewrites(spark):
    asked = spark.createDataFrame([(q,) for q in REWRITES], "text string")
    assert {r["text"]: r["query"] for r in rewrite_questions(asked).collect()} == REWRITES


def test_rewrite_takes_a_fallback(spark):
    asked = spark.createDataFrame([("What should a traveller know?",), ("plain words",)], "text string")
    found = {r["text"]: r["query"] for r in rewrite_questions(asked, fallback=lambda t: F.concat(F.lit("model: "), t)).collect()}
    assert found == {"What should a traveller know?": "model: What should a traveller know?", "plain words": "plain words"}


@pytest.mark.parametrize(("topics", "operator", "want"), [(["a", "b"], "AND", "((a) AND (b))"), (["a"], "OR", "(a)"), (["a", "b", "c"], "NOT", "(a) AND (NOT (b) AND NOT (c))"), (['"x  y"', ' p "q"  r '], "OR", '(("x  y") OR (p q r))')])
def test_topics(topics, operator, want):
    assert topics_query(topics, operator) == want


def test_filters_and_dates():
    filters = Filters(languages=["english", "french"], other_filters=["exclude_preprints"])
    assert complete_query(TopicRequest(topic="x", filters=filters), date(2024, 1, 1)) == "x AND ((english[lang] OR french[lang]) AND NOT preprint[pt])"
    assert date_clause(Filters(publication_date="5_years"), date(2024, 1, 31)) == '("2019/02/01"[Date - Publication] : "2024/01/31"[Date - Publication])'
    assert date_clause(Filters(publication_date="custom", custom_end_date="2020/01/02"), date(2024, 1, 1)) == '1900[Date - Publication] : "2020/01/02"[Date - Publication]'
    assert date_clause(Filters(publication_date="custom"), date(2024, 1, 1)) == "" == date_clause(Filters(custom_end_date="2020/01/02"), date(2024, 1, 1))
    species = Filters(species=["other_animals", "mice"], age_groups=["aged_80_and_over"], sex=["male"], article_types=["review"], custom_filters=["a  or b"])
    assert complete_query(TopicRequest(advanced_query="q and r", filters=species), date(2024, 1, 1)) == "q AND r AND ((Review[ptyp]) AND (animals[mh] NOT humans[mh] OR mice[mh]) AND (male[mh]) AND (aged, 80 and over[mh]) AND (a OR b))"


def test_normalize_in_python_and_columns(spark):
    texts = ["foo and bar  or NOT baz", "in-and-out", "  a\tAND  b ", "android or not"]
    found = spark.createDataFrame([(t,) for t in texts], "t string").select(normalize_boolean(F.col("t"))).collect()
    assert [r[0] for r in found] == [normalize(t) for t in texts]
    assert normalize(texts[0]) == "foo AND bar OR NOT baz" and normalize(texts[1]) == "in- AND -out"
    topics = ['  "a  b" ', 'a "b"   c', "   ", ""]
    found = spark.createDataFrame([(t,) for t in topics], "t string").select(sanitize_topic(F.col("t"))).collect()
    assert [r[0] for r in found] == ['"a  b"', "a b c", "", ""] == [sanitize(t) for t in topics]


@pytest.mark.parametrize("options", [{}, {"topic": "a", "topics": ["b"]}, {"topics": ["a"], "operator": "NOT"}, {"topics": [" ", ""]}, {"topic": "a", "max_results": 0}, {"topic": "a", "max_results": 10001}, {"topic": "a", "max_results": None}, {"topic": "a", "operator": "XOR"}, {"topics": ["a", " "], "operator": "NOT"}])
def test_bad_requests(options):
    with pytest.raises(InvalidRequest):
        TopicRequest(**options)


@pytest.mark.parametrize("options", [{"custom_start_date": "2024/02/30"}, {"custom_start_date": "2024-02-03"}, {"publication_date": "2_years"}, {"languages": ["klingon"]}, {"sort_by": "size"}])
def test_bad_filters(options):
    with pytest.raises(InvalidRequest):
        Filters(**options)


def test_good_requests():
    request = TopicRequest(topics=[" a ", "", "b"], filters={"languages": [], "publication_date": ""})
    assert request.topics == ["a", "b"] and request.filters.languages is None and request.timeout() == 100
    assert request.params()["filters"] == {"sort_by": "relevance", "search_field": "title/abstract"}
    assert request.description() == "Multi-topic search: ['a', 'b'] with AND"
    assert TopicRequest(advanced_query="z" * 150).description() == "Advanced query: " + "z" * 100 + "..."


ARTICLES = [
    ("1", "Insulin in mice", "A study of insulin.", ["Mice", "Animals"], ["Review"], "en", "2020-05-01"),
    ("2", "Insulin in people", "No Abstract", ["Humans", "Animals"], ["Letter"], "fr", "2021"),
    ("3", "Fish oil", "Fish oil helps the heart.", ["Humans"], ["preprint"], "en", "2022-03"),
    ("4", "Bird's song", None, [], [], None, "Unknown Date"),
]


@pytest.mark.parametrize(
    ("query", "want"),
    [
        ("insulin", "12"), ('"fish oil"', "3"), ("oil fish", "3"), ("insulin NOT people", "1"), ("animals[mh] NOT humans[mh] OR letter[pt]", "12"),
        ("(mice OR humans)[MeSH] AND english[lang]", "13"), ("NOT preprint[pt]", "124"), ("insulin AND NOT (review[ptyp] OR preprint[pt])", "2"), ("hasabstract[text]", "13"),
        ('("2021"[Date - Publication] : "3000"[Date - Publication])', "23"), ('insulin AND "2020/06/01"[Date - Publication] : 3000[Date - Publication]', "2"), ('1900[Date - Publication] : "2020/05/01"[Date - Publication]', "1"),
        ("bird's", "4"), ("nothing here", ""), ("(insulin)", "12"), ("(insulin) AND (NOT (mice) AND NOT (fish))", "2"), ("fish[Title]", "3"),
    ],
)
def test_predicates(spark, query, want):
    from scholia.operators.articles import with_date_bounds

    frame = spark.createDataFrame(ARTICLES, "pmid string, title string, abstract string, mesh_terms array<string>, publication_types array<string>, lang string, publication_date string")
    assert "".join(sorted(r["pmid"] for r in search(with_date_bounds(frame), query).collect())) == want


@pytest.mark.parametrize(
    ("query", "want"),
    [
        ("insulin OR oil AND review[pt]", "1"), ("review[pt] AND insulin OR oil", "13"), ("animals[mh] NOT humans[mh] OR fish NOT preprint[pt]", "1"), ("NOT oil", "124"), ("NOT english[lang]", "24"),
        ("(insulin) AND (NOT cats)", "12"), ("NOT (insulin OR oil)", "4"), ('NOT ("2021"[Date - Publication] : "3000"[Date - Publication])', "14"), ("(insulin AND (mice OR people))[Title]", "12"),
        ("NOT NOT oil", "3"), ("insulin oil OR song", "4"), ("((insulin OR oil) AND \"heart\")[Title/Abstract]", "3"), ("NOT hasabstract[text]", "24"), ("NOT mice[mh]", "234"),
    ],
)
def test_queries_are_read_from_left_to_right(spark, query, want):
    from scholia.operators.articles import with_date_bounds

    frame = spark.createDataFrame(ARTICLES, "pmid string, title string, abstract string, mesh_terms array<string>, publication_types array<string>, lang string, publication_date string")
    assert "".join(sorted(r["pmid"] for r in search(with_date_bounds(frame), query).collect())) == want


@pytest.mark.parametrize("query", ["a AND", "OR a", "a AND OR b", "(a", "a)", "()", "a AND (b OR)", "NOT", "a NOT", '"open', "a [mh", "[mh]", "a AND ()", '""', '"2021/02/30"[Date - Publication] : "3000"[Date - Publication]', "(a OR b))[mh]"])
def test_malformed_queries_are_refused(query):
    with pytest.raises(InvalidRequest):
        condition_sql(query)


def pushed(frame):
    frame.sparkSession.conf.set("spark.sql.maxMetadataStringLength", 2000)
    plan = frame._jdf.queryExecution().executedPlan().toString()
    return re.search(r"PushedFilters: \[(.*?)\]", plan)[1]


def test_predicates_reach_the_scan(spark, small, tmp_path):
    from scholia.operators.articles import articles_of_documents

    found = search(articles_of_documents(spark.read.parquet(f"{small}/documents.parquet")), "e AND (hasabstract[text] AND (english[lang] OR french[lang]))")
    filters = pushed(found)
    assert "EqualNullSafe(lang,en)" in filters and "EqualNullSafe(lang,fr)" in filters and "IsNotNull(text)" in filters and "Not(EqualTo(text," in filters
    spark.createDataFrame([(date(2020, 1, 1), date(2020, 1, 31), "x", "y")], "date_from date, date_to date, title string, abstract string").write.parquet(str(tmp_path / "dated"))
    filters = pushed(search(spark.read.parquet(str(tmp_path / "dated")), '("2019"[Date - Publication] : "2020/06"[Date - Publication])'))
    assert "GreaterThanOrEqual(date_to,2019-01-01)" in filters and "LessThanOrEqual(date_from,2020-06-30)" in filters


def test_relevance_counts_words_literally(spark):
    frame = spark.createDataFrame([(1, "a.b axb A.B", None), (2, None, "oil and oil"), (3, "foil", "no")], "i int, title string, abstract string")
    assert query_words('a.b OR "oil" NOT foil AND mice[mh] AND (NOT (x y))') == ["a.b", "oil"]
    assert [r[0] for r in frame.orderBy("i").select(relevance("a.b OR oil")).collect()] == [2, 2, 1]


def test_empty_query_is_an_error():
    with pytest.raises(InvalidRequest):
        compile_query("  ")


def test_text_functions(spark):
    frame = spark.createDataFrame([("  x\n",)], "t string")
    assert frame.select(strip(F.col("t"))).first()[0] == "x"
    told = spark.createDataFrame([("Question: a long enough answer\n\n\n\nend Remember:",), ("short",), (None,)], "t string")
    assert [r[0] for r in told.select(clean_answer(F.col("t"))).collect()] == ["a long enough answer\n\nend", APOLOGY, APOLOGY]
    note = frame.select(with_coverage_note(F.lit("A Comprehensive view"), F.lit("See PMID: 1, PMID:1 and PMID: 22."), F.lit(6))).first()[0]
    assert note.endswith("covers 2 of 6 available studies. For a complete analysis of all studies, consider breaking down your query into specific aspects.*")


def test_preview_and_transform(spark):
    request = TopicRequest(topic="diagnosis of new coronavirus")
    assert engine.preview(spark, request, date(2024, 1, 1))["final_query"] == REWRITES["diagnosis of new coronavirus"]
    plain = TopicRequest(topic="diagnosis of new coronavirus", auto_transform=False)
    assert engine.preview(spark, plain, date(2024, 1, 1))["final_query"] == "diagnosis of new coronavirus"
    with pytest.raises(ValueError):
        engine.transform_query(spark, " ")
