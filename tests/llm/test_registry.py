"""The registered queries of the subpackage against SQL, and their columns."""

import re

import duckdb
import pytest

import __spark_entry__ as entry

COLUMNS = {
    "op1_decontamination": ["doc_id:bigint", "n_words:bigint", "n_hit:bigint", "n_items:bigint", "items_sha256:string", "contaminated:boolean"],
    "op2_html_text": ["page_id:bigint", "url:string", "text:string", "n_chars:bigint"],
    "op3_neighbours": ["query_id:bigint", "rank:int", "vec_id:bigint", "score:double"],
    "op4_bpe": ["doc_id:bigint", "n_tokens:bigint", "ids_sha256:string", "decoded_sha256:string"],
    "op6_simhash": ["doc_id:bigint", "fingerprint:string", "component_id:bigint"],
    "op8_sharding": ["doc_id:bigint", "size:bigint", "text_crc32:bigint", "law:string", "shard:int", "slot:bigint", "grown_shard:int"],
    "op10_language": ["doc_id:bigint", "held_out:boolean", "lang_pred:string", "score:double"],
    "op11_centroids": ["vec_id:bigint", "cluster:int", "distance:bigint", "cluster_inertia:bigint", "inertia:bigint", "centroid_sha256:string"],
    "op12_lexical": ["item_id:bigint", "rank:int", "doc_id:bigint", "score:bigint"],
    "op13_secrets": ["doc_id:bigint", "n_assign:bigint", "n_access:bigint", "n_hex:bigint", "base_sha256:string", "spans:string"],
}


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_columns(spark, small, name):
    frame = entry.queries()[name](spark, small)
    assert [f"{n}:{t}" for n, t in frame.dtypes][: len(COLUMNS[name])] == COLUMNS[name]


def test_one_query_for_each_operator():
    names = [n for n in entry.queries() if re.match(r"op\d", n)]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 14))


@pytest.mark.parametrize("name", ["op1_decontamination", "op5_lines", "op7_chat", "op11_centroids", "op12_lexical", "op13_secrets"])
def test_sql(spark, small, name):
    con = duckdb.connect()
    for table in ("documents", "benchmark", "conversations", "embeddings"):
        con.execute(f"create view {table} as select * from read_parquet('{small}/{table}.parquet')")
    result = con.execute(entry.oracle_sql()[name])
    columns = [d[0] for d in result.description]
    found = entry.queries()[name](spark, small)
    assert sorted(found.columns) == sorted(columns)
    assert sorted(map(tuple, found.select(*columns).collect()), key=repr) == sorted(map(tuple, result.fetchall()), key=repr)
