"""The queries of the operators, and their SQL where there is one."""

from lodeframe.llm import decontaminate, language_id, near_dedup, neighbours, pii, reply_trees, sentencepiece_fst, substring_dedup, token_files, url_filter

QUERIES = {
    "op1_token_files": token_files.token_files_query,
    "op2_neighbours": neighbours.neighbours_query,
    "op3_url_filter": url_filter.url_filter_query,
    "op4_substring_dedup": substring_dedup.substring_dedup_query,
    "op5_language_id": language_id.language_id_query,
    "op6_reply_trees": reply_trees.reply_trees_query,
    "op7_near_dedup": near_dedup.near_dedup_query,
    "op8_decontaminate": decontaminate.decontaminate_query,
    "op9_sentencepiece": sentencepiece_fst.sentencepiece_query,
    "op10_pseudonyms": pii.pii_query,
}
ORACLES = {
    "op3_url_filter": url_filter.ORACLE,
    "op4_substring_dedup": substring_dedup.ORACLE,
    "op6_reply_trees": reply_trees.ORACLE,
    "op8_decontaminate": decontaminate.ORACLE,
}
