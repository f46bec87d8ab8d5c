"""The registered query of each operator, and its SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from waymark.llm import decontaminate, filter_audit, language_model, lexical_search, maxscore, minhash, mixing, personal, phrase_automata, suffix_dedup, token_counts, toxicity, urls

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_token_counts": token_counts.op1_token_counts,
    "op2_suffix_dedup": suffix_dedup.op2_suffix_dedup,
    "op3_mixing": mixing.op3_mixing,
    "op4_decontaminate": decontaminate.op4_decontaminate,
    "op5_personal": personal.op5_personal,
    "op6_language_model": language_model.op6_language_model,
    "op7_urls": urls.op7_urls,
    "op8_minhash": minhash.op8_minhash,
    "op9_maxscore": maxscore.op9_maxscore,
    "op10_toxicity": toxicity.op10_toxicity,
    "op11_filter_audit": filter_audit.op11_filter_audit,
    "op12_phrases": phrase_automata.op12_phrases,
    "op13_search": lexical_search.op13_search,
}
SQL: dict[str, str] = {
    "op2_suffix_dedup": suffix_dedup.SQL,
    "op3_mixing": mixing.SQL,
    "op4_decontaminate": decontaminate.SQL,
    "op7_urls": urls.SQL,
    "op8_minhash": minhash.SQL,
    "op9_maxscore": maxscore.SQL,
    "op11_filter_audit": filter_audit.SQL,
    "op12_phrases": phrase_automata.SQL,
    "op13_search": lexical_search.SQL,
}
