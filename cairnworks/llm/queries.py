"""The numbered queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from cairnworks.llm import (
    chunk_dedup, filter_audit, isomedia, kneser_ney, mixing, near_vectors, sentencepiece_backend, sigtree, spotsigs, token_files, toxicity, url_filter, whitening,
)

QUERIES = {
    "op1_token_files": token_files.op1_token_files,
    "op2_spotsigs": spotsigs.op2_spotsigs,
    "op3_toxicity": toxicity.op3_toxicity,
    "op4_sentencepiece": sentencepiece_backend.op4_sentencepiece,
    "op5_jaccard_join": sigtree.op5_jaccard_join,
    "op6_mixing": mixing.op6_mixing,
    "op7_media": isomedia.op7_media,
    "op8_kneser_ney": kneser_ney.op8_kneser_ney,
    "op9_chunk_dedup": chunk_dedup.op9_chunk_dedup,
    "op10_url_filter": url_filter.op10_url_filter,
    "op11_filter_audit": filter_audit.op11_filter_audit,
    "op12_whitening": whitening.op12_whitening,
    "op13_near_vectors": near_vectors.op13_near_vectors,
}
ORACLE_SQL = {"op6_mixing": mixing.SQL, "op11_filter_audit": filter_audit.SQL}
