"""The queries of this package, and SQL for those that SQL can express."""

from __future__ import annotations

from impactlens.llm import chat, decontam, langid, lm, media, mixing, ngram_join, pii, tokens, warc

QUERIES = {
    "op1_pii": pii.query,
    "op2_mixing": mixing.query,
    "op3_langid": langid.query,
    "op4_warc": warc.query,
    "op5_media": media.query,
    "op6_ngram_join": ngram_join.query,
    "op7_chat": chat.query,
    "op8_lm": lm.query,
    "op9_tokens": tokens.query,
    "op10_decontam": decontam.query,
}
ORACLE_SQL = {"op2_mixing": mixing.SQL, "op4_warc": warc.SQL}
