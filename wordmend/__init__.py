"""Spell checking of large text collections as Spark DataFrame jobs."""

from wordmend.functions.patterns import DEFAULT_IGNORE, DEFAULT_REGIONS, MAX_SUGGESTIONS
from wordmend.operators.suggest import suggest
from wordmend.operators.tokens import tokens
from wordmend.plans.check import check, find, misspellings_per_document, summarize
from wordmend.plans.fix import apply_decisions, fix, new_personal_words, summarize_fixes
from wordmend.plans.report import (
    append_personal_words,
    flat_report,
    json_report,
    review_list,
    write_corrected,
    write_flat_report,
    write_json_report,
)
from wordmend.plans.watch import check_new_files, checked_files
from wordmend.sources.dictionaries import (
    build_dictionary,
    describe_dictionary,
    dictionary_catalog,
    install_dictionary,
    load_dictionary,
    load_word_table,
    update_dictionaries,
)
from wordmend.sources.documents import read_documents, read_lines
from wordmend.sources.wordlists import builtin_words, read_personal_words, read_word_list

__all__ = [
    "DEFAULT_IGNORE",
    "DEFAULT_REGIONS",
    "MAX_SUGGESTIONS",
    "append_personal_words",
    "apply_decisions",
    "build_dictionary",
    "builtin_words",
    "check",
    "check_new_files",
    "checked_files",
    "describe_dictionary",
    "dictionary_catalog",
    "find",
    "fix",
    "flat_report",
    "install_dictionary",
    "json_report",
    "load_dictionary",
    "load_word_table",
    "misspellings_per_document",
    "new_personal_words",
    "read_documents",
    "read_lines",
    "read_personal_words",
    "read_word_list",
    "review_list",
    "suggest",
    "summarize",
    "summarize_fixes",
    "tokens",
    "update_dictionaries",
    "write_corrected",
    "write_flat_report",
    "write_json_report",
]
