"""The queries of the corpus operators and, where SQL can express them, their SQL."""

from __future__ import annotations

from tessera.llm.chat import OP8_SQL, op8_chat
from tessera.llm.decontamination import OP9_SQL, op9_decontamination
from tessera.llm.language_id import op6_language_id
from tessera.llm.licences import op2_licences
from tessera.llm.media import op1_media
from tessera.llm.sentencepiece_bpe import op10_sentencepiece
from tessera.llm.simhash import op3_simhash
from tessera.llm.substrings import OP4_SQL, op4_substrings
from tessera.llm.token_counts import op7_token_counts
from tessera.llm.url_filter import OP5_SQL, op5_url_filter

QUERIES = {
    "op1_media": op1_media,
    "op2_licences": op2_licences,
    "op3_simhash": op3_simhash,
    "op4_substrings": op4_substrings,
    "op5_url_filter": op5_url_filter,
    "op6_language_id": op6_language_id,
    "op7_token_counts": op7_token_counts,
    "op8_chat": op8_chat,
    "op9_decontamination": op9_decontamination,
    "op10_sentencepiece": op10_sentencepiece,
}

ORACLES: dict[str, str] = {
    "op4_substrings": OP4_SQL,
    "op5_url_filter": OP5_SQL,
    "op8_chat": OP8_SQL,
    "op9_decontamination": OP9_SQL,
}
