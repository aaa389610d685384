"""The queries of this subpackage, and the SQL of those that SQL can express."""

from tessera.llm import ann, chat, decontaminate, html_main, kdtree, langid, licenses, merkle, mixing, pii, sharding, simhash, whitening

QUERIES = {
    "op1_mix_sources": mixing.op1_mix_sources,
    "op2_shard_documents": sharding.op2_shard_documents,
    "op3_extract_main_text": html_main.op3_extract_main_text,
    "op4_decontaminate": decontaminate.op4_decontaminate,
    "op5_find_personal_data": pii.op5_find_personal_data,
    "op6_language_id": langid.op6_language_id,
    "op7_format_chats": chat.op7_format_chats,
    "op8_scan_licenses": licenses.op8_scan_licenses,
    "op9_nearest_neighbours": ann.op9_nearest_neighbours,
    "op10_simhash_near_duplicates": simhash.op10_simhash_near_duplicates,
    "op11_merkle_manifest": merkle.op11_merkle_manifest,
    "op12_exact_top_k": kdtree.op12_exact_top_k,
    "op13_whiten_embeddings": whitening.op13_whiten_embeddings,
}

ORACLES = {
    "op1_mix_sources": mixing.OP1_SQL,
    "op4_decontaminate": decontaminate.OP4_SQL,
    "op7_format_chats": chat.OP7_SQL,
    "op8_scan_licenses": licenses.OP8_SQL,
    "op11_merkle_manifest": merkle.OP11_SQL,
    "op12_exact_top_k": kdtree.OP12_SQL,
}
