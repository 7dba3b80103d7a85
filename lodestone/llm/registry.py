"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from lodestone.llm import (chat, codes, decontaminate, exact_dedup, language, mixing, packing, paragraphs, prefix_trie, secrets,
                           simhash, token_files, toxicity)

QUERIES = {
    "op1_simhash": simhash.op1_simhash,
    "op2_decontaminate": decontaminate.op2_decontaminate,
    "op3_secret_scan": secrets.op3_secret_scan,
    "op4_exact_dedup": exact_dedup.op4_exact_dedup,
    "op5_chat_format": chat.op5_chat_format,
    "op6_token_counts": token_files.op6_token_counts,
    "op7_toxicity": toxicity.op7_toxicity,
    "op8_mixing": mixing.op8_mixing,
    "op9_paragraphs": paragraphs.op9_paragraphs,
    "op10_language": language.op10_language,
    "op11_packing": packing.op11_packing,
    "op12_prefix_trie": prefix_trie.op12_prefix_trie,
    "op13_codes": codes.op13_codes,
}

ORACLES = {
    "op4_exact_dedup": exact_dedup.ORACLE,
    "op5_chat_format": chat.ORACLE,
    "op8_mixing": mixing.ORACLE,
    "op12_prefix_trie": prefix_trie.ORACLE,
    "op13_codes": codes.ORACLE,
}
