"""Every registered query on a folder of small tables: the columns its contract names, a row for each row it judges, and its folds."""

import zlib

import pytest
from pyspark.sql import functions as F

from fleetshape.llm import queries

LONG, TEXT, FLAG, INT, REAL = "bigint", "string", "boolean", "int", "double"
#: Query: (table with one result row per row, or None; columns).
CONTRACTS = {
    "op1_language": ("documents", {"doc_id": LONG, "held_out": FLAG, "lang_pred": TEXT, "score": REAL}),
    "op2_sharding": ("documents", {"doc_id": LONG, "size": LONG, "text_crc32": LONG, "law": TEXT, "shard": INT, "slot": LONG, "grown_shard": INT}),
    "op3_quality_rules": ("documents", {"doc_id": LONG, **dict.fromkeys(("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"), LONG), "base_failed": FLAG, "kept": FLAG}),
    "op4_mixing": ("documents", {"doc_id": LONG, "size": LONG, "source_size": LONG, "target": REAL, "taken": LONG}),
    "op5_chat": (None, {"conv_id": LONG, "n_turns": LONG, "turns_sha256": TEXT, "loss_chars": LONG, "loss_sha256": TEXT, "formatted_chars": LONG}),
    "op6_decontamination": ("documents", {"doc_id": LONG, "n_words": LONG, "n_hit": LONG, "n_items": LONG, "items_sha256": TEXT, "contaminated": FLAG}),
    "op7_simhash": ("documents", {"doc_id": LONG, "fingerprint": TEXT, "component_id": LONG}),
    "op8_url_filter": ("pages", {"page_id": LONG, "host": TEXT, "path": TEXT, "rule": TEXT, "verdict": TEXT}),
    "op9_license_scan": ("documents", {"doc_id": LONG, "licenses": TEXT, "license": TEXT, "dice": REAL}),
    "op10_token_counts": ("documents", {"doc_id": LONG, "n_bytes": LONG, "n_tokens": LONG, "over_limit": FLAG}),
    "op11_quality_classifier": ("documents", {"doc_id": LONG, "held_out": FLAG, "score": REAL, "predicted": INT}),
    "op12_hard_negatives": (None, {"anchor_id": LONG, "positive_id": LONG, "rank": INT, "negative_id": LONG, "positive_score": LONG, "negative_score": LONG}),
    "op13_alignment": ("documents", {"doc_id": LONG, **dict.fromkeys(("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum"), LONG), "groups_sha256": TEXT}),
}


@pytest.fixture(scope="module")
def folder(spark, docs, texts, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("tables"))
    tables = {
        # Contracts name the columns of documents; the operators' own tests have clashing ones.
        "documents": docs.select("doc_id", "text", "lang", "source").withColumn("n_chars", F.char_length("text").cast("long")),
        "labels": spark.createDataFrame([(i, i % 2, 0) for i in range(0, 50, 2)] + [(3, None, None), (None, 1, 0)], "doc_id long, quality int, toxic int"),
        "benchmark": spark.createDataFrame([(1, " ".join(texts[9].split()[:14])), (2, "one"), (None, None)], "item_id long, text string"),
        "pages": spark.createDataFrame([(1, "http://a.net/x/4"), (2, None), (None, "https://b.org/fr/6"), (1, "http://a.net/x/4")], "page_id long, url string").withColumn("html", F.lit("")),
        "conversations": spark.createDataFrame([(1, 0, "user", "q"), (1, 1, "assistant", None), (2, None, None, "x")], "conv_id long, turn long, role string, text string"),
        "embeddings": spark.createDataFrame([(i, [float(i % 5), 1.0, float(i % 3)], i % 10) for i in range(150)] + [(None, None, None)], "vec_id long, embedding array<float>, label int"),
    }
    for name, df in tables.items():
        df.write.parquet(f"{path}/{name}.parquet")
    return path


def test_all_queries_are_stated():
    assert set(CONTRACTS) == set(queries.QUERIES) - {"pipeline"}


@pytest.mark.parametrize("name", CONTRACTS)
def test_contract(spark, folder, name):
    of, columns = CONTRACTS[name]
    got = queries.QUERIES[name](spark, folder)
    assert {c: t for c, t in got.dtypes if c in columns} == columns
    rows = got.collect()
    if of:
        assert len(rows) == spark.read.parquet(f"{folder}/{of}.parquet").count()
    else:
        assert rows
    divisor, out = {"op1_language": (5, 0), "op11_quality_classifier": (4, 2)}.get(name, (None, None))
    if divisor:
        assert all(r.held_out == (r.doc_id is None or zlib.crc32(str(r.doc_id).encode()) % divisor == out) for r in rows)


@pytest.mark.parametrize("name", [n for n, (of, _) in CONTRACTS.items() if n != "op5_chat"])
def test_empty_tables(spark, folder, name, tmp_path):
    for table in ("documents", "labels", "benchmark", "pages", "embeddings"):
        spark.read.parquet(f"{folder}/{table}.parquet").limit(0).write.parquet(f"{tmp_path}/{table}.parquet")
    assert queries.QUERIES[name](spark, str(tmp_path)).count() == 0
