"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from . import chat, decontam, embeddings, licenses, mixing, ppm, prefix_trie, sentencepieces, simhash, tokens, toxicity, urls

QUERIES = {
    "op1_decontamination": decontam.op1_decontamination,
    "op2_toxicity": toxicity.op2_toxicity,
    "op3_mixing": mixing.op3_mixing,
    "op4_url_filter": urls.op4_url_filter,
    "op5_lm_scores": ppm.op5_lm_scores,
    "op6_simhash": simhash.op6_simhash,
    "op7_token_output": tokens.op7_token_output,
    "op8_embedding_dedup": embeddings.op8_embedding_dedup,
    "op9_licenses": licenses.op9_licenses,
    "op10_chat_format": chat.op10_chat_format,
    "op11_sentencepiece": sentencepieces.op11_sentencepiece,
    "op12_prefix_trie": prefix_trie.op12_prefix_trie,
}

ORACLE_SQL = {
    "op4_url_filter": urls.OP4_SQL,
    "op8_embedding_dedup": embeddings.OP8_SQL,
    "op9_licenses": licenses.OP9_SQL,
    "op10_chat_format": chat.OP10_SQL,
    "op12_prefix_trie": prefix_trie.OP12_SQL,
}
