"""The queries of this package and their SQL."""

from __future__ import annotations

from . import embeddings, fingerprint, mixing, packing, passages, quality, simhash, token_store, toxicity, url_filter

QUERIES = {
    "op1_url_filter": url_filter.op1_url_filter,
    "op2_fingerprint": fingerprint.op2_fingerprint,
    "op3_packing": packing.op3_packing,
    "op4_quality": quality.op4_quality,
    "op5_token_store": token_store.op5_token_store,
    "op6_passages": passages.op6_passages,
    "op7_toxicity": toxicity.op7_toxicity,
    "op8_simhash": simhash.op8_simhash,
    "op9_mixing": mixing.op9_mixing,
    "op10_embeddings": embeddings.op10_embeddings,
}
ORACLE_SQL = {"op1_url_filter": url_filter.OP1_SQL, "op9_mixing": mixing.OP9_SQL}
