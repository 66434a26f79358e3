"""From retrieved chunks to answers: compression, prompts, generation, clean-up, coverage, chat memory."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scholia.functions.text import NO_DOCUMENTS, cited_ids, with_coverage_note
from scholia.operators import ranking
from scholia.session import stored

#: Takes prompts, gives answers; a batch model in a task.
Generator = Callable[[list[str]], list[str]]
KEPT_CONVERSATIONS = 100


def relevant_sentences(question: Column, content: Column) -> Column:
    """The default compression: sentences of a chunk that share a word of four letters or more with the question."""
    words = F.filter(F.split(F.lower(question), r"[^\p{L}\p{N}]+"), lambda w: F.length(w) >= 4)
    sentences = F.split(content, r"(?<=[.!?])\s+|\n+")
    return F.array_join(F.filter(sentences, lambda s: F.arrays_overlap(F.split(F.lower(s), r"[^\p{L}\p{N}]+"), words)), " ")


def compress(passages: DataFrame, question_col: str = "question", content_col: str = "content") -> DataFrame:
    """passages with the relevant part of their content; those without one go.

    Stored before the empty ones go: as a condition of the join that brings
    question and content together, the sentences are bound to one of its sides.
    """
    return stored(passages.withColumn(content_col, relevant_sentences(F.col(question_col), F.col(content_col)))).where(F.col(content_col) != "")


def stuffed(passages: DataFrame, key: str = "query_id", position: str = "position", content: str = "content") -> DataFrame:
    """key and context: the passages of each question in order; a question's passages are bounded by its depth."""
    ordered = F.array_sort(F.collect_list(F.struct(position, content)))
    return passages.groupBy(key).agg(F.array_join(F.transform(ordered, lambda p: p[content]), "\n\n").alias("context"), F.count("*").alias("passages"))


def condensed(question: Column, history: Column) -> Column:
    """The default condensation: the question after the user's last turn, if there is one."""
    return F.when(F.coalesce(history, F.lit("")) == "", question).otherwise(F.concat_ws("\n", history, question))


def chat_role(role: Column) -> Column:
    """The model's name for a role."""
    return F.when(role.isin("human", "user"), "user").when(role.isin("ai", "assistant"), "assistant").otherwise("system")


def generate(prompts: DataFrame, generator: Generator | None = None, prompt_col: str = "context", out_col: str = "answer", sentences: int = 3) -> DataFrame:
    """prompts with answers of a batch model; by default the first sentences of the prompt."""
    if generator is None:
        return prompts.withColumn(out_col, F.array_join(F.slice(F.split(prompt_col, r"(?<=[.!?])\s+|\n+"), 1, sentences), " "))

    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series(generator(batch.fillna("").tolist()), dtype=object)

    return prompts.withColumn(out_col, run(prompt_col))


#: How much of a sentence's rank comes from the question itself, rounds of the ranking, and the likeness from which a sentence repeats another.
RESTART, RANK_ROUNDS, REPEATS = 0.3, 50, 0.8


def rank_sentences(vectors: np.ndarray, question: np.ndarray, restart: float = RESTART, rounds: int = RANK_ROUNDS) -> np.ndarray:
    """Rank of sentences (rows of word weights) by their likeness to each other and to the question: power iteration with restart."""
    unit = vectors / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-30)
    like = unit @ unit.T
    np.fill_diagonal(like, 0.0)
    asked = unit @ (question / max(np.linalg.norm(question), 1e-30))
    start = asked / asked.sum() if asked.sum() > 0 else np.full(len(unit), 1 / max(1, len(unit)))
    out = like.sum(axis=1)
    rank = start
    for _ in range(rounds):
        # A sentence that is like no other hands its rank back to the start.
        spread = like.T @ np.divide(rank, out, out=np.zeros_like(rank), where=out > 0) + rank[out == 0].sum() * start
        rank = restart * start + (1 - restart) * spread
    return rank


def pick_sentences(rank: np.ndarray, vectors: np.ndarray, k: int, repeats: float = REPEATS) -> list[int]:
    """The k best sentences in their own order, none of which repeats a better one; ties to the earlier one."""
    unit = vectors / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-30)
    chosen: list[int] = []
    for n in np.lexsort((np.arange(len(rank)), -rank.round(12))).tolist():
        if len(chosen) < k and all(unit[n] @ unit[c] < repeats for c in chosen):
            chosen.append(n)
    return sorted(chosen)


def extracted(questions: DataFrame, passages: DataFrame, statistics: str, k: int = 3, key: str = "query_id", text_col: str = "text", position: str = "position", content: str = "content") -> DataFrame:
    """key and answer: the k sentences of a question's passages that its sentence graph ranks highest.

    Words weigh by the corpus (ranking.statistics()). A group is the sentences of
    one question's passages, of bounded number. Questions without passages, or
    whose passages have no words, have no row.
    """
    spark = questions.sparkSession
    total = spark.read.parquet(f"{statistics}/totals").first()["articles"]
    parts = passages.select(key, position, F.posexplode(F.split(content, r"(?<=[.!?])\s+|\n+")).alias("n", "sentence")).where(F.trim("sentence") != "")
    asked = questions.join(passages.select(key).distinct(), key, "left_semi").select(key, F.lit(-1).alias(position), F.lit(-1).alias("n"), F.col(text_col).alias("sentence"))
    split = parts.unionByName(asked).withColumn("word", F.explode(ranking.words_of(("sentence",))))
    counts = split.groupBy(key, position, "n", "sentence", "word").agg(F.count("*").alias("tf"))
    known = spark.read.parquet(f"{statistics}/words").select("word", "articles")
    df = F.coalesce("articles", F.lit(0))
    weighed = counts.join(known, "word", "left").withColumn("weight", F.col("tf") * F.log(1 + (F.lit(total) - df + 0.5) / (df + 0.5)))

    def pick(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = pdf.sort_values([position, "n", "word"], kind="stable")
        words = {w: i for i, w in enumerate(sorted(set(rows["word"])))}
        places = rows.drop_duplicates([position, "n"])
        number = {at: i for i, at in enumerate(zip(places[position], places["n"], strict=True))}
        matrix = np.zeros((len(number), len(words)))
        for at, n, word, weight in zip(rows[position], rows["n"], rows["word"], rows["weight"], strict=True):
            matrix[number[at, n], words[word]] = weight
        asked = number.get((-1, -1))
        held = [i for i in range(len(number)) if i != asked]
        if not held:
            return pd.DataFrame({key: [], "answer": []})
        vectors = matrix[held]
        rank = rank_sentences(vectors, matrix[asked] if asked is not None else np.zeros(len(words)))
        texts = places["sentence"].to_list()
        return pd.DataFrame({key: [pdf[key].iloc[0]], "answer": [" ".join(texts[held[i]].strip() for i in pick_sentences(rank, vectors, k))]})

    kind = dict(questions.dtypes)[key]
    return weighed.select(key, position, "n", "sentence", "word", "weight").groupBy(key).applyInPandas(pick, f"{key} {kind}, answer string")


def answer_questions(questions: DataFrame, passages: DataFrame, counts: DataFrame, generator: Generator | None = None, sentences: int = 3) -> DataFrame:
    """query_id, answer for questions (query_id, topic_id, text); without passages, the sentence that says so.

    questions may have `standalone`, the question with what a conversation said
    before it, which passages are compressed for; the note on coverage follows the
    question as asked. counts: topic_id and its number of articles.
    """
    asked = questions if "standalone" in questions.columns else questions.withColumn("standalone", F.col("text"))
    context = stuffed(compress(passages.join(asked.select("query_id", F.col("standalone").alias("question")), "query_id")))
    drafted = generate(asked.join(context, "query_id", "left").join(counts, "topic_id", "left"), generator, sentences=sentences)
    raw = F.when(F.coalesce("passages", F.lit(0)) == 0, F.lit(NO_DOCUMENTS)).otherwise(F.col("answer"))
    return drafted.select("query_id", with_coverage_note(F.col("text"), raw, F.coalesce("articles", F.lit(0))).alias("answer"))


def retrieved_coverage(found: DataFrame, counts: DataFrame, key: str = "topic_id", query_col: str = "query_id", article_col: str = "pubmed_id") -> DataFrame:
    """query, chunks, articles (different ones among its chunks), expected (articles of the topic), percent of what was retrieved for each query.

    found has a row for each retrieved chunk with its topic.
    """
    held = found.groupBy(query_col, key).agg(F.count("*").alias("chunks"), F.count_distinct(article_col).alias("articles"))
    joined = held.join(counts.select(key, F.col("articles").alias("expected")), key, "left")
    return joined.select(query_col, "chunks", "articles", "expected", F.when(F.col("expected") > 0, F.round(100.0 * F.col("articles") / F.col("expected"), 1)).alias("percent"))


def coverage(answers: DataFrame, expected: DataFrame, key: str = "topic_id", answer_col: str = "answer") -> DataFrame:
    """answers with cited (distinct ids), expected (articles of the topic) and percent."""
    joined = answers.join(expected.select(key, F.col("articles").alias("expected")), key, "left").withColumn("cited", F.size(cited_ids(F.col(answer_col))).cast("long"))
    share = F.when(F.col("expected") > 0, F.round(100.0 * F.col("cited") / F.col("expected"), 2))
    return joined.withColumn("percent", share)


def history(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """conv and history: its turns in order as `role: text` lines; a conversation's memory is one value."""
    line = F.concat(chat_role(F.col(role)), F.lit(": "), F.col(text))
    ordered = F.array_sort(F.collect_list(F.struct(F.col(turn), line.alias("line"))))
    return turns.groupBy(conv).agg(F.array_join(F.transform(ordered, lambda t: t["line"]), "\n").alias("history"), F.count("*").alias("turns"))


def newest_conversations(turns: DataFrame, first_seen: str, conv: str = "conv_id", keep: int = KEPT_CONVERSATIONS) -> DataFrame:
    """The `keep` conversations seen first most lately; later use of one does not renew it."""
    seen = turns.groupBy(conv).agg(F.min(first_seen).alias("first_seen"))
    return seen.orderBy(F.desc("first_seen"), F.desc(conv)).limit(keep)
