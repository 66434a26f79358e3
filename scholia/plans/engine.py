"""What a service offers on top of the operators: ingest, search, preview, status, cleanup, answers."""

from __future__ import annotations

import json
import threading
import time
import uuid
from datetime import UTC, date, datetime

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from scholia.functions.rewrite import explanation, rewrite_questions
from scholia.operators import answers, articles, gram_index, ranking, retrieval, topics
from scholia.plans.predicate import relevance, search
from scholia.plans.query_text import complete_query
from scholia.plans.request import TopicRequest
from scholia.session import Settings, stored
from scholia.sources import generations, records
from scholia.sources.generations import LOG, read_log

TURNS = "conversation_id string, turn long, role string, text string, at timestamp, topic_id string"


def transform_query(spark: SparkSession, question: str) -> dict:
    """The query of one question and what was done to it."""
    if not question or not question.strip():
        raise ValueError("nothing to transform")
    asked = spark.createDataFrame([(question,)], "text string")
    row = rewrite_questions(asked).select("natural", "query", explanation(F.col("text"), F.col("query")).alias("explanation")).first()
    return {"original": question, "transformed": row["query"], "is_natural_language": row["natural"], "explanation": row["explanation"]}


def query_of(spark: SparkSession, request: TopicRequest, as_of: date) -> str:
    """The query that a request runs: a single topic in words is rewritten first."""
    if request.topic and request.auto_transform:
        rewritten = transform_query(spark, request.topic)["transformed"]
        request = TopicRequest(**{**request.__dict__, "topic": rewritten})
    return complete_query(request, as_of)


def preview(spark: SparkSession, request: TopicRequest, as_of: date) -> dict:
    """How a request would be searched for."""
    method = "topics" if request.topics else "topic" if request.topic else "advanced_query"
    return {"search_method": method, "description": request.description(), "inputs": request.params(), "final_query": query_of(spark, request, as_of)}


def hits(source: DataFrame, spark: SparkSession, request: TopicRequest, as_of: date, index: str | None = None, statistics: str | None = None) -> DataFrame:
    """The first max_results articles that a request finds, in its sort order; by default those with most of its words.

    With an index (gram_index.build() of the source) texts are not read to search
    them; with statistics (ranking.statistics()) relevance is BM25.
    """
    query, field = query_of(spark, request, as_of), request.filters.search_field
    if index is not None:
        found = gram_index.search(spark, index, query, field)
    else:
        if "publication_date" in source.columns and not {"date_from", "date_to"} & set(source.columns):
            source = articles.with_date_bounds(source)
        found = search(source, query, field)
    score = relevance(query, field) if statistics is None else ranking.score(spark, statistics, query)
    return topics.ranked(found, request.filters.sort_by, score, "pmid").limit(request.max_results)


def append_status(spark: SparkSession, path: str, topic_id: str, status: str, at: datetime | None = None, event_id: int | None = None, generation: str | None = None, **detail) -> None:
    """One more entry in the log of statuses, which is never rewritten; detail is kept as JSON."""
    number = time.time_ns() if event_id is None else event_id
    row = (topic_id, status, at or datetime.now(UTC), number, json.dumps(detail, default=str) if detail else None, generation)
    generations.append(spark.createDataFrame([row], LOG).coalesce(1), path)


def ingest(
    source: DataFrame, spark: SparkSession, request: TopicRequest, topic_id: str | None, path: str, as_of: date, timeout: float | None = None,
    generation: str | None = None, settings: Settings | None = None,
) -> dict:
    """Search, filter, store articles and chunks, and index them unless the request says not to.

    path gets articles/, chunks/ and, with embeddings, index/, each by topic and
    generation, and the log: processing at the start, then completed, failed or
    timeout. A job that takes longer than the request allows is cancelled. What
    was fetched before stays until the new generation is completed, and for good
    if it does not. A generation's name is given by a job that may be tried again,
    else it is new. Without a topic_id a new one is made.
    """
    topic_id, generation = topic_id or str(uuid.uuid4()), generation or uuid.uuid4().hex
    context, late, ended = spark.sparkContext, threading.Event(), threading.Event()
    seconds = request.timeout() if timeout is None else timeout
    append_status(spark, path, topic_id, topics.PROCESSING, description=request.description(), params=request.params())

    def watch() -> None:
        if not ended.wait(seconds):
            late.set()
            while not ended.wait(0.2):  # a job that is being planned begins later
                context.cancelJobGroup(generation)

    context.setJobGroup(generation, request.description(), interruptOnCancel=True)
    threading.Thread(target=watch, daemon=True).start()
    found: dict = {}
    try:
        found = _store(source, spark, request, topic_id, path, as_of, generation, settings or Settings.from_env())
        status = topics.COMPLETED
    except Exception as error:  # whatever it is, the topic must not stay in processing
        status, found = (topics.TIMEOUT if late.is_set() else topics.FAILED), {"error": str(error)[:200]}
    finally:
        ended.set()
        for name in ("spark.jobGroup.id", "spark.job.description", "spark.job.interruptOnCancel"):
            context.setLocalProperty(name, None)
    if status == topics.COMPLETED:
        append_status(spark, path, topic_id, status, generation=generation, **found)
        for row in generations.replaced(read_log(spark, path).where(F.col("topic_id") == topic_id)).collect():  # of one topic
            _drop_folders(spark, path, topic_id, TABLES, row["generation"])
    else:
        _drop_folders(spark, path, topic_id, TABLES, generation)
        append_status(spark, path, topic_id, status, **found)
    return {"topic_id": topic_id, "status": status, "article_count": 0, "chunk_count": 0} | found


#: The tables that have generations, and the column that names the topic in each.
TABLES = {"index": "topic_id", "chunks": "topic", "articles": "topic_id"}


def _store(source: DataFrame, spark: SparkSession, request: TopicRequest, topic_id: str, path: str, as_of: date, generation: str, settings: Settings) -> dict:
    """Write a generation; its numbers are observed while it is written, without a pass of their own."""
    found = hits(source, spark, request, as_of).drop("topic_id").withColumn("topic_id", F.lit(topic_id))
    good = stored(found.where(articles.is_valid(F.col("pmid"), F.col("title"), F.col("abstract"))))
    written, cut = Observation(), Observation()
    generations.write(articles.stored_articles(good).observe(written, F.count(F.lit(1)).alias("n")), f"{path}/articles", generation)
    count = written.get["n"]
    if not count:
        return {"article_count": 0, "chunk_count": 0}
    pieces = articles.chunks(good).withColumn("topic", F.col("metadata.topic_id"))
    generations.write(pieces.observe(cut, F.count(F.lit(1)).alias("n")), f"{path}/chunks", generation, "topic", "json")
    if request.create_embeddings:
        held = generations.of_topic(records.read_chunks(spark, f"{path}/chunks"), generation, topic_id, "topic")
        number = F.coalesce(F.col("metadata.chunk_index"), F.lit(-1))
        vectors = retrieval.embed(
            held.select("content", F.col("metadata.topic_id").alias("topic_id"), F.col("metadata.pubmed_id").alias("pubmed_id"), F.col("metadata.chunk_type").alias("chunk_type"), number.alias("chunk_index")),
            "content", retrieval.hash_embedder(settings.embedding_dims),
        )
        generations.write(vectors, f"{path}/index", generation)
    return {"article_count": count, "chunk_count": cut.get["n"]}


def memory(spark: SparkSession, path: str, keep: int | None = None) -> DataFrame:
    """Turns of the conversations that are kept: the `keep` that began last, over all topics."""
    keep = Settings.from_env().max_conversations if keep is None else keep
    try:
        turns = spark.read.schema(TURNS).parquet(f"{path}/conversations")
    except AnalysisException:
        return spark.createDataFrame([], TURNS)
    newest = answers.newest_conversations(turns, "at", "conversation_id", keep)
    return turns.join(F.broadcast(newest.select("conversation_id")), "conversation_id", "left_semi")  # `keep` rows


def answer(spark: SparkSession, path: str, questions: DataFrame, topic_id: str, generator: answers.Generator | None = None, settings: Settings | None = None) -> DataFrame:
    """query_id, conversation_id, answer for questions (query_id, text, and conversation_id if they go on with one).

    The topic must have a generation that holds (require_answerable) and an index,
    else NotFound; all is read from that one generation. What a conversation said before is put before the question for the
    retrieval, and question and answer are added to its turns.
    """
    settings = settings or Settings.from_env()
    log = read_log(spark, path)
    generation = valid_generation(log, topic_id)
    if generation is None:
        require_answerable(topic_status(log, topic_id))
    vectors = records.read_index(spark, f"{path}/index", topic_id, generation).withColumn("chunk_id", F.concat_ws("_", "pubmed_id", "chunk_type", "chunk_index"))
    counts = topics.article_counts(generations.of_topic(spark.read.parquet(f"{path}/articles"), generation, topic_id))
    given = F.col("conversation_id") if "conversation_id" in questions.columns else F.lit(None).cast("string")
    asked = stored(questions.select("query_id", "text", F.coalesce(given, F.uuid()).alias("conversation_id")))
    turns = memory(spark, path, settings.max_conversations).where(F.col("topic_id") == topic_id).join(asked.select("conversation_id").distinct(), "conversation_id", "left_semi")
    told = answers.history(turns, "conversation_id").select("conversation_id", "history", F.col("turns").alias("before"))
    asked = asked.join(told, "conversation_id", "left").withColumns({"topic_id": F.lit(topic_id), "standalone": answers.condensed(F.col("text"), F.col("history"))})
    asked = stored(asked)
    found = retrieval.retrieve(vectors, asked.select("query_id", "topic_id", F.col("standalone").alias("text")), counts, retrieval.hash_embedder(settings.embedding_dims), scope_col="topic_id").join(vectors.select("chunk_id", "content"), "chunk_id")
    done = stored(answers.answer_questions(asked, found, counts, generator, settings.max_answer_sentences).join(asked.select("query_id", "conversation_id", "text", "before"), "query_id"))
    order = Window.partitionBy("conversation_id").orderBy("query_id")
    number = F.coalesce("before", F.lit(0)) + 2 * (F.row_number().over(order) - 1)
    both = F.array(F.struct(F.lit(0).alias("k"), F.lit("user").alias("role"), F.col("text").alias("said")), F.struct(F.lit(1).alias("k"), F.lit("assistant").alias("role"), F.col("answer").alias("said")))
    said = done.withColumn("turn", number).withColumn("part", F.explode(both))
    said = said.select("conversation_id", (F.col("turn") + F.col("part.k")).cast("long").alias("turn"), "part.role", F.col("part.said").alias("text"), F.lit(datetime.now(UTC)).alias("at"), F.lit(topic_id).alias("topic_id"))
    said.write.mode("append").partitionBy("topic_id").parquet(f"{path}/conversations")
    return done.select("query_id", "conversation_id", "answer")


def articles_page(spark: SparkSession, path: str, topic_id: str, limit: int = 100, offset: int = 0) -> tuple[DataFrame, DataFrame]:
    """A page of a topic's stored articles in the generation that holds, and its totals; NotFound for a topic that the log does not know."""
    log = read_log(spark, path)
    if topic_status(log, topic_id) == topics.NOT_FOUND:
        raise records.NotFound(topic_id)
    rows = generations.of_topic(spark.read.parquet(f"{path}/articles"), valid_generation(log, topic_id), topic_id)
    return topics.page(rows, F.lit(True), limit, offset, "pubmed_id"), topics.page_info(rows, F.lit(True), limit, offset)


def _drop_folders(spark: SparkSession, path: str, topic_id: str, names: dict[str, str], generation: str | None = None) -> bool:
    """Drop a topic's folders in these tables, or those of one generation, in whatever store they are; whether there was one."""
    gone = False
    for name, column in names.items():
        folder = records.topic_folder(spark, f"{path}/{name}", column, topic_id)
        if generation is not None:
            folder = records.topic_folder(spark, folder, "generation", generation)
        place = spark._jvm.org.apache.hadoop.fs.Path(folder)
        files = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        gone = (files.exists(place) and files.delete(place, True)) or gone
    return gone


#: What a cleanup drops.
CLEANED_TABLES = {"index": "topic_id", "chunks": "topic"}


def cleanup_topic(spark: SparkSession, path: str, topic_id: str) -> dict:
    """Drop a topic's index, chunks and conversations and say so in the log; NotFound for a topic that the log does not know."""
    if topic_status(read_log(spark, path), topic_id) == topics.NOT_FOUND:
        raise records.NotFound(topic_id)
    talks = memory(spark, path).where(F.col("topic_id") == topic_id).select("conversation_id").distinct().count()
    # Logged first, so that no reader looks for what is being dropped.
    append_status(spark, path, topic_id, topics.CLEANED)
    gone = _drop_folders(spark, path, topic_id, CLEANED_TABLES)
    _drop_folders(spark, path, topic_id, {"conversations": "topic_id"})
    return {"topic_id": topic_id, "files_cleaned": gone, "conversations_removed": talks, "status": topics.CLEANED}


def cleanup_old(spark: SparkSession, path: str, as_of: datetime, days: int | None = None) -> dict:
    """Drop what expired topics keep; total, cleaned and failed (those without files).

    One job lists the expired topics and one writes their log entries, however
    many they are; what is left for each is to drop its folders.
    """
    days = Settings.from_env().retention_days if days is None else days
    gone = stored(topics.expired(_created(read_log(spark, path)), F.lit(as_of), days).select("topic_id"))
    none = F.lit(None).cast("string")
    number = F.lit(time.time_ns()) + F.monotonically_increasing_id()
    generations.append(gone.select("topic_id", F.lit(topics.CLEANED).alias("status"), F.lit(datetime.now(UTC)).alias("ts"), number.alias("event_id"), none.alias("detail"), none.alias("generation")), path)
    total = cleaned = 0
    for row in gone.toLocalIterator():  # the list is walked through, not held
        total += 1
        cleaned += _drop_folders(spark, path, row["topic_id"], CLEANED_TABLES)
        _drop_folders(spark, path, row["topic_id"], {"conversations": "topic_id"})
    return {"total": total, "cleaned": cleaned, "failed": total - cleaned}


def _created(log: DataFrame) -> DataFrame:
    return log.groupBy("topic_id").agg(F.min("ts").alias("created_at"), F.max_by("status", F.struct("ts", "event_id")).alias("status"))


def topic_status(log: DataFrame, topic_id: str) -> str:
    """The last status of a topic in the log, or not_found."""
    row = topics.latest(log.where(F.col("topic_id") == topic_id)).select("status").first()
    return row["status"] if row else topics.NOT_FOUND


def valid_generation(log: DataFrame, topic_id: str) -> str | None:
    """The generation of a topic that holds; a later fetch that failed or goes on changes nothing."""
    row = generations.valid(log.where(F.col("topic_id") == topic_id)).first()
    return row["generation"] if row else None


def require_answerable(status: str) -> None:
    """Questions are for completed topics."""
    if status == topics.NOT_FOUND:
        raise records.NotFound("no such topic")
    if status != topics.COMPLETED:
        raise RuntimeError(f"the topic is {status}")


def active_tasks(log: DataFrame) -> int:
    """Topics whose last status is processing."""
    return topics.latest(log).where(F.col("status") == topics.PROCESSING).count()


def catalog_status(spark: SparkSession, path: str) -> dict:
    """Which of the store's tables can be read, with their rows that hold."""
    found: dict = {}
    log = read_log(spark, path)
    for name, column in {"log": None, **TABLES}.items():
        try:
            rows = log if column is None else generations.whole(records.read_chunks(spark, f"{path}/{name}") if name == "chunks" else spark.read.parquet(f"{path}/{name}"), log, column)
            found[name] = rows.count()
        except AnalysisException:
            found[name] = None
    return found


def model_status(embedder: retrieval.Embedder | None = None, generator: answers.Generator | None = None) -> dict:
    """Which models are in use, and the length of vectors."""
    vector = (embedder or retrieval.hash_embedder())(["probe"])
    return {"embedder": "custom" if embedder else "hashing", "dims": int(vector.shape[1]), "generator": "custom" if generator else "extractive"}


def embedding_rate(spark: SparkSession, texts: DataFrame, text_col: str = "text", embedder: retrieval.Embedder | None = None) -> dict:
    """Seconds to embed all texts, and texts a second."""
    began = time.perf_counter()
    count = retrieval.embed(texts.select(text_col), text_col, embedder).where(F.size("embedding") > 0).count()
    took = time.perf_counter() - began
    return {"texts": count, "seconds": round(took, 3), "per_second": round(count / took, 1)}


def storage_status(spark: SparkSession, path: str) -> dict:
    """Topics indexed and megabytes used."""
    row = records.folder_sizes(spark, f"{path}/index").first()
    return {"topics": row["topics"], "megabytes": round(row["bytes"] / 1024 / 1024, 2)}


def health(spark: SparkSession) -> dict:
    """Whether the session runs a job."""
    return {"status": "ok" if spark.range(1).count() == 1 else "down", "spark": spark.version}
