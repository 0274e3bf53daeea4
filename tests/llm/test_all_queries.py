"""Every opN_ query over its whole smallest tables: its contract's columns, and a row for each row of its table."""

import pytest

from mapweave.llm import queries

SF = "/root/testdata/sf0.001"
WANT = {
    "op1_near_dedup": ("documents", "doc_id class_id class_size kept"),
    "op2_quality": ("documents", "doc_id held_out score predicted"),
    "op3_jpeg_media": ("documents", "doc_id n_bytes payload_bytes payload_sha256 tail_crc32 media_bytes media_sha256 feature"),
    "op4_bpe_chunks": ("documents", "doc_id n_tokens ids_sha256 decoded_sha256"),
    "op5_best_fit_packing": (None, "doc_id piece start length ids_crc32 sequence_id offset"),
    "op6_exact_dedup": ("documents", "doc_id keep_id group_size kept text_sha256"),
    "op7_token_counts": (None, "source lang tokenizer_version n_docs n_tokens n_bytes"),
    "op8_chat_format": (None, "conv_id n_turns turns_sha256 loss_chars loss_sha256 formatted_chars"),
    "op9_warc": ("pages", "page_id payload_bytes payload_digest record_type refers_to"),
    "op10_sharding": ("documents", "doc_id size text_crc32 law shard slot grown_shard"),
    "op11_alignment": ("documents", "doc_id n_a n_b n_groups n_links n_best count_sum groups_sha256"),
    "op12_id_files": ("documents", "doc_id start n_tokens ids_crc32"),
    "op13_collocations": (None, "lang rank phrase a l r n score"),
}


@pytest.mark.parametrize("name", WANT)
def test_columns_and_rows(spark, name):
    source, columns = WANT[name]
    d = queries.queries()[name](spark, SF)
    assert set(columns.split()) <= set(d.columns)
    n = d.count()
    assert n == spark.read.parquet(f"{SF}/{source}.parquet").count() if source else n > 0


def test_all_are_here():
    assert set(queries.queries()) == set(WANT)
