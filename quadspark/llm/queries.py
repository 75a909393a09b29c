"""The corpus queries and, where SQL can express one, its oracle."""

from __future__ import annotations

from .chat_format import ORACLE_OP5, op5_chat_format
from .decontaminate import op3_decontamination
from .jaccard_join import op4_jaccard_join
from .language_id import op2_language_id
from .lexical_search import ORACLE_OP13, op13_lexical_search
from .merkle import op7_merkle_fingerprint
from .packing import op8_packing
from .prefix_trie import ORACLE_OP12, op12_prefix_trie
from .quality import op6_quality
from .secret_scan import op10_secret_scan
from .substring_dedup import op1_substring_dedup
from .token_store import op11_token_store
from .toxicity import op9_toxicity

QUERIES = {
    "op1_substring_dedup": op1_substring_dedup,
    "op2_language_id": op2_language_id,
    "op3_decontamination": op3_decontamination,
    "op4_jaccard_join": op4_jaccard_join,
    "op5_chat_format": op5_chat_format,
    "op6_quality": op6_quality,
    "op7_merkle_fingerprint": op7_merkle_fingerprint,
    "op8_packing": op8_packing,
    "op9_toxicity": op9_toxicity,
    "op10_secret_scan": op10_secret_scan,
    "op11_token_store": op11_token_store,
    "op12_prefix_trie": op12_prefix_trie,
    "op13_lexical_search": op13_lexical_search,
}

ORACLE_SQL = {"op5_chat_format": ORACLE_OP5, "op12_prefix_trie": ORACLE_OP12, "op13_lexical_search": ORACLE_OP13}
