"""The queries of this subpackage and their SQL."""

from __future__ import annotations

import corpus_pipeline
from taleframe.llm import bm25, chat, conversation_trie, filter_audit, language, lm_score, minhash, mixing, near_vectors, packing, pii, url_filter, warc

QUERIES = {
    "pipeline": corpus_pipeline.run,
    "op7_bm25": bm25.op7_bm25,
    "op2_lm_score": lm_score.op2_lm_score,
    "op4_near_vectors": near_vectors.op4_near_vectors,
    "op6_minhash": minhash.op6_minhash,
    "op1_language_id": language.op1_language_id,
    "op5_pack": packing.op5_pack,
    "op3_chat_format": chat.op3_chat_format,
    "op8_pii": pii.op8_pii,
    "op9_url_filter": url_filter.op9_url_filter,
    "op10_mix_sources": mixing.op10_mix_sources,
    "op11_filter_audit": filter_audit.op11_filter_audit,
    "op12_conversation_trie": conversation_trie.op12_conversation_trie,
    "op13_warc": warc.op13_warc,
}
ORACLE_SQL = {
    "op7_bm25": bm25.OP7_SQL,
    "op4_near_vectors": near_vectors.OP4_SQL,
    "op6_minhash": minhash.OP6_SQL,
    "op3_chat_format": chat.OP3_SQL,
    "op8_pii": pii.OP8_SQL,
    "op9_url_filter": url_filter.OP9_SQL,
    "op10_mix_sources": mixing.OP10_SQL,
    "op11_filter_audit": filter_audit.OP11_SQL,
    "op12_conversation_trie": conversation_trie.OP12_SQL,
    "op13_warc": warc.OP13_SQL,
}
