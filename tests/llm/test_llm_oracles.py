"""Corpus queries against their SQL, and that every operator is registered."""

import re

import pytest
from oracle import compare, duck

from querywarden.llm.queries import ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_against_sql(spark, sf_dir, name):
    con = duck(sf_dir)
    for table in ("documents", "conversations"):
        con.execute(f"create or replace view {table} as select * from read_parquet('{sf_dir}/{table}.parquet')")
    assert compare(spark, con, sf_dir, QUERIES[name], ORACLES[name]) is None


def test_each_operator_has_one_query():
    import __spark_entry__ as contract

    names = [n for n in contract.queries() if n.startswith("op")]
    assert sorted(int(re.match(r"op(\d+)_", n)[1]) for n in names) == list(range(1, 14))
    assert "pipeline" in contract.queries()


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_contract_columns(spark, sf_dir, name):
    want = {
        "op1_bpe_tree": "doc_id n_tokens ids_sha256 decoded_sha256",
        "op2_weak_pii": "doc_id n_email n_ip n_card n_phone base_sha256 spans",
        "op3_mixing_tree": "doc_id size source_size target taken",
        "op4_kd_shards": "doc_id size text_crc32 law shard slot grown_shard",
        "op5_quality_gam": "doc_id held_out score predicted",
        "op7_hmm_scores": "doc_id held_out n_tokens n_known train_tokens base_score score",
    }[name].split()
    df = QUERIES[name](spark, sf_dir)
    assert set(want) <= set(df.columns)
    assert len(df.collect()) == spark.read.parquet(f"{sf_dir}/documents.parquet").count()
