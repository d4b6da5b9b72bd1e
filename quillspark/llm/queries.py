"""The subpackage's queries and, where SQL can express them, their oracles."""

from __future__ import annotations

from quillspark.llm import (chat_format, decontaminate, ngram_join, packing, pii, quality_mil, quality_rules, sstable,
                            suffix_dedup, warc)

QUERIES = {
    "op1_ngram_join": ngram_join.op1_ngram_join,
    "op2_pii": pii.op2_pii,
    "op3_decontaminate": decontaminate.op3_decontaminate,
    "op4_packing": packing.op4_packing,
    "op5_quality_mil": quality_mil.op5_quality_mil,
    "op6_suffix_dedup": suffix_dedup.op6_suffix_dedup,
    "op7_quality_rules": quality_rules.op7_quality_rules,
    "op8_token_tables": sstable.op8_token_tables,
    "op9_chat_format": chat_format.op9_chat_format,
    "op10_warc": warc.op10_warc,
}

ORACLE_SQL = {
    "op7_quality_rules": quality_rules.OP7_SQL,
    "op9_chat_format": chat_format.OP9_SQL,
    "op10_warc": warc.OP10_SQL,
}
