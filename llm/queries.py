"""The queries of this package by name, and SQL for those that SQL can express."""

from llm import (
    chat_format,
    collocations,
    decontaminate,
    filter_audit,
    language_id,
    line_dedup,
    mixing,
    ngram_join,
    pii,
    quality_lm,
    quality_rules,
    url_filter,
    warc_audit,
)

QUERIES = {
    "op1_warc_fixity_audit": warc_audit.op1_warc_fixity_audit,
    "op2_quality_classifier": quality_lm.op2_quality_classifier,
    "op3_ngram_jaccard_join": ngram_join.op3_ngram_jaccard_join,
    "op4_mixing": mixing.op4_mixing,
    "op5_chat_formatting": chat_format.op5_chat_formatting,
    "op6_pii": pii.op6_pii,
    "op7_quality_rules": quality_rules.op7_quality_rules,
    "op8_url_filter": url_filter.op8_url_filter,
    "op9_line_dedup": line_dedup.op9_line_dedup,
    "op10_benchmark_decontamination": decontaminate.op10_benchmark_decontamination,
    "op11_filter_audit": filter_audit.op11_filter_audit,
    "op12_language_id": language_id.op12_language_id,
    "op13_collocations": collocations.op13_collocations,
}
SQL = {**warc_audit.SQL, **chat_format.SQL, **decontaminate.SQL, **filter_audit.SQL, **collocations.SQL}
