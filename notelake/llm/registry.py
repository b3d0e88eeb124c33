"""The queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from notelake.llm.block_max import OP11_SQL, op11_block_max
from notelake.llm.context_tree import op12_context_tree
from notelake.llm.hamming_topk import OP9_SQL, op9_hamming_topk
from notelake.llm.mixing import OP3_SQL, op3_mixing
from notelake.llm.near_dedup import op2_minhash_near_dedup
from notelake.llm.packing import op7_packing
from notelake.llm.pii import op5_pii
from notelake.llm.sharding import op8_sharding
from notelake.llm.spotsigs import op6_spotsigs
from notelake.llm.token_counts import op10_token_counts
from notelake.llm.toxicity import op4_toxicity
from notelake.llm.warc import OP1_SQL, op1_warc
from notelake.llm.whitening import op13_whitening


def queries():
    return {
        "op1_warc": op1_warc,
        "op2_minhash_near_dedup": op2_minhash_near_dedup,
        "op3_mixing": op3_mixing,
        "op4_toxicity": op4_toxicity,
        "op5_pii": op5_pii,
        "op6_spotsigs": op6_spotsigs,
        "op7_packing": op7_packing,
        "op8_sharding": op8_sharding,
        "op9_hamming_topk": op9_hamming_topk,
        "op10_token_counts": op10_token_counts,
        "op11_block_max": op11_block_max,
        "op12_context_tree": op12_context_tree,
        "op13_whitening": op13_whitening,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_warc": OP1_SQL,
        "op3_mixing": OP3_SQL,
        "op9_hamming_topk": OP9_SQL,
        "op11_block_max": OP11_SQL,
    }
