"""The registered queries over whole tables: against SQL where there is some, and by contract."""

from __future__ import annotations

from pathlib import Path

import duckdb
import pytest

from periodica.llm.queries import ORACLES, QUERIES

FOLDER = Path("/root/testdata/sf0.001")


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, name):
    con = duckdb.connect()
    for file in FOLDER.glob("*.parquet"):
        con.execute(f"create view {file.stem} as select * from '{file}'")
    df = QUERIES[name](spark, str(FOLDER))
    expected = con.sql(ORACLES[name])
    columns = sorted(df.columns)
    assert columns == sorted(expected.columns)
    got = sorted(repr(tuple(r[c] for c in columns)) for r in df.collect())
    order = [expected.columns.index(c) for c in columns]
    assert got == sorted(repr(tuple(row[i] for i in order)) for row in expected.fetchall())


CONTRACT = {
    "op1_bitmask_langid": {"held_out": "boolean", "lang_pred": "string", "score": "double"},
    "op2_line_crf_quality": {"held_out": "boolean", "score": "double", "predicted": "int"},
    "op4_pareto_mix": {
        **{"size": "bigint", "source_size": "bigint", "target": "double", "taken": "bigint"},
    },
    "op5_skip_chain_pii": {
        **{f"n_{k}": "bigint" for k in ("email", "ip", "card", "phone")},
        **{"base_sha256": "string", "spans": "string"},
    },
    "op6_byte_shards": {
        **{"size": "bigint", "text_crc32": "bigint", "law": "string", "shard": "int"},
        **{"slot": "bigint", "grown_shard": "int"},
    },
    "op8_prefix_tree_join": {"n_shingles": "bigint", "component_id": "bigint"},
    "op11_regex_importance": {k: "bigint" for k in ("n_features", "weight", "score", "rank")},
    "op9_byte_bpe": {"n_tokens": "bigint", "ids_sha256": "string", "decoded_sha256": "string"},
}


@pytest.mark.parametrize("name", sorted(CONTRACT))
def test_one_row_per_document(spark, documents, name):
    df = QUERIES[name](spark, str(FOLDER))
    types = dict(df.dtypes)
    assert CONTRACT[name].items() <= types.items()
    ids = [r["doc_id"] for r in df.select("doc_id").collect()]
    assert sorted(ids) == sorted(r["doc_id"] for r in documents.select("doc_id").collect())


def test_all_operators_are_registered():
    assert {q.split("_")[0] for q in QUERIES} == {f"op{n}" for n in range(1, 14)} | {"pipeline"}
