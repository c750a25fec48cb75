"""Column names and types that each operator's query returns first."""

import pytest

from seamark.llm import queries

COLUMNS = {
    "op1_secret_ledger": "doc_id bigint, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string",
    "op2_minhash_near_dedup": "doc_id bigint, n_shingles bigint, component_id bigint, kept boolean",
    "op3_png_media": "doc_id bigint, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string",
    "op4_warc_archive": "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint",
    "op5_fm_decontamination": "doc_id bigint, n_words bigint, n_hit bigint, n_items bigint, items_sha256 string, contaminated boolean",
    "op6_token_store": "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint",
    "op7_bradley_terry_quality": "doc_id bigint, held_out boolean, score double, predicted int",
    "op8_chat_grammar": "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint",
    "op9_label_shards": "doc_id bigint, size bigint, text_crc32 bigint, law string, shard int, slot bigint, grown_shard int",
    "op10_best_fit_packing": "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint",
}


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_columns_and_types(spark, sf, name):
    got = [f"{c} {t}" for c, t in queries.QUERIES[name](spark, sf).dtypes]
    assert got[: len(COLUMNS[name].split(", "))] == COLUMNS[name].split(", ")
