"""Queries opN_<name> of the subpackage and their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from scholia.llm import bpe, centroids, chat, decontamination, html_text, language, lexical, lines, neighbours, secrets, sharding, simhash, training_order
from scholia.session import checkpoint_dir, spread, table

#: Place of the public tokenizer file; every executor reads the same one.
TOKENIZER = "word_bpe_49k.json"


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_decontamination(spark, sf_dir):
    report = decontamination.contamination(spread(table(spark, sf_dir, "documents")), table(spark, sf_dir, "benchmark"))
    return decontamination.digest(report)


def op6_simhash(spark, sf_dir):
    return simhash.digest(simhash.near_duplicates(spread(table(spark, sf_dir, "documents"))))


def op8_sharding(spark, sf_dir):
    return sharding.digest(sharding.balanced_shards(table(spark, sf_dir, "documents")))


def op10_language(spark, sf_dir):
    docs = spread(table(spark, sf_dir, "documents"))
    return language.digest(language.identify(docs, language.fit(docs)))


def op4_bpe(spark, sf_dir):
    return bpe.digest(bpe.encode(spread(table(spark, sf_dir, "documents")), tokenizer_path(), ids=False))


def op2_html_text(spark, sf_dir):
    return html_text.digest(html_text.main_text(spread(table(spark, sf_dir, "pages"))))


def op3_neighbours(spark, sf_dir):
    return neighbours.neighbours(table(spark, sf_dir, "embeddings"), F.col("id") % 20 == 0)


def op5_lines(spark, sf_dir):
    return lines.digest(spread(table(spark, sf_dir, "documents")))


def op7_chat(spark, sf_dir):
    return chat.digest(chat.turns_of(table(spark, sf_dir, "conversations")))


def op9_training_order(spark, sf_dir):
    """Every document's ids from the encoder, written as shards and read again."""
    tokenizer = tokenizer_path()
    path = f"{checkpoint_dir(spark)}/order-{uuid.uuid4().hex}"
    training_order.write(spread(table(spark, sf_dir, "documents")), path, vocabulary=bpe.vocabulary(tokenizer), tokenizer=tokenizer)
    return training_order.digest(spark.read.parquet(path))


def op11_centroids(spark, sf_dir):
    return centroids.digest(*centroids.cluster(table(spark, sf_dir, "embeddings")))


def op12_lexical(spark, sf_dir):
    return lexical.digest(lexical.search(spread(table(spark, sf_dir, "documents")), table(spark, sf_dir, "benchmark")))


def op13_secrets(spark, sf_dir):
    return secrets.digest(secrets.secrets(spread(table(spark, sf_dir, "documents"))))


def queries():
    return {
        "op1_decontamination": op1_decontamination,
        "op2_html_text": op2_html_text,
        "op3_neighbours": op3_neighbours,
        "op4_bpe": op4_bpe,
        "op5_lines": op5_lines,
        "op6_simhash": op6_simhash,
        "op7_chat": op7_chat,
        "op8_sharding": op8_sharding,
        "op9_training_order": op9_training_order,
        "op10_language": op10_language,
        "op11_centroids": op11_centroids,
        "op12_lexical": op12_lexical,
        "op13_secrets": op13_secrets,
    }


def oracle_sql():
    return {
        "op1_decontamination": decontamination.ORACLE,
        "op5_lines": lines.ORACLE,
        "op7_chat": chat.ORACLE,
        "op11_centroids": centroids.ORACLE,
        "op12_lexical": lexical.ORACLE,
        "op13_secrets": secrets.ORACLE,
    }
