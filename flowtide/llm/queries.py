"""Queries of the corpus operators and, where SQL can express them, their SQL."""

from __future__ import annotations

from . import bpe, chat, jaccard, langid, licenses, lines, media, mixing, quality, substrings

QUERIES = {
    "op1_chat_format": chat.op1,
    "op2_jaccard": jaccard.op2,
    "op3_mix": mixing.op3,
    "op4_substring_dedup": substrings.op4,
    "op5_media": media.op5,
    "op6_langid": langid.op6,
    "op7_quality": quality.op7,
    "op8_line_dedup": lines.op8,
    "op9_licenses": licenses.op9,
    "op10_bpe": bpe.op10,
}
ORACLES = {"op1_chat_format": chat.ORACLE, "op2_jaccard": jaccard.ORACLE, "op3_mix": mixing.ORACLE, "op4_substring_dedup": substrings.ORACLE, "op7_quality": quality.ORACLE, "op8_line_dedup": lines.ORACLE}
