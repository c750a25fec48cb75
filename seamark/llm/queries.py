"""The registered queries of this subpackage and, where SQL can express one, its DuckDB equivalent."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .bestfit_pack import op10_best_fit_packing
from .chat_grammar import OP8_SQL, op8_chat_grammar
from .fm_decontam import OP5_SQL, op5_fm_decontamination
from .label_shards import op9_label_shards
from .near_dedup import OP2_SQL, op2_minhash_near_dedup
from .png_media import op3_png_media
from .quality_rank import op7_bradley_terry_quality
from .secret_ledger import op1_secret_ledger
from .token_store import op6_token_store
from .warc import OP4_SQL, op4_warc_archive

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_secret_ledger": op1_secret_ledger,
    "op2_minhash_near_dedup": op2_minhash_near_dedup,
    "op3_png_media": op3_png_media,
    "op4_warc_archive": op4_warc_archive,
    "op5_fm_decontamination": op5_fm_decontamination,
    "op6_token_store": op6_token_store,
    "op7_bradley_terry_quality": op7_bradley_terry_quality,
    "op8_chat_grammar": op8_chat_grammar,
    "op9_label_shards": op9_label_shards,
    "op10_best_fit_packing": op10_best_fit_packing,
}

ORACLE_SQL: dict[str, str] = {
    "op2_minhash_near_dedup": OP2_SQL,
    "op4_warc_archive": OP4_SQL,
    "op5_fm_decontamination": OP5_SQL,
    "op8_chat_grammar": OP8_SQL,
}
