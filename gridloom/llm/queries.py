"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from . import decontaminate, host_reputation, language_id, lexical_search, media, mixing, near_dedup, simhash, spelling, substring_dedup, token_counts, token_ids, warc

QUERIES = {
    "op1_decontaminate": decontaminate.op1_decontaminate,
    "op2_substring_dedup": substring_dedup.op2_substring_dedup,
    "op3_mixing": mixing.op3_mixing,
    "op4_token_ids": token_ids.op4_token_ids,
    "op5_language_id": language_id.op5_language_id,
    "op6_url_filter": host_reputation.op6_url_filter,
    "op7_near_duplicates": near_dedup.op7_near_duplicates,
    "op8_token_counts": token_counts.op8_token_counts,
    "op9_media_copies": media.op9_media_copies,
    "op10_warc": warc.op10_warc,
    "op11_simhash": simhash.op11_simhash,
    "op12_lexical_search": lexical_search.op12_lexical_search,
    "op13_spelling_variants": spelling.op13_spelling_variants,
}

#: The other queries run a tokenizer, word windows, set similarities, learned models or files, which SQL can't
#: express, or not in bounded time; tests/llm holds them against brute force.
ORACLE_SQL: dict[str, str] = {
    "op6_url_filter": host_reputation.ORACLE,
    "op12_lexical_search": lexical_search.ORACLE,
    "op13_spelling_variants": spelling.ORACLE,
}
