"""All queries of this package, and the SQL of those that SQL can express."""

from __future__ import annotations

from tideline.llm import (
    bpe, conversations, decontaminate, html_text, language, neardup, quality_model, quality_rules, resampling, secret_scan,
    toxicity, url_filter, word_bpe,
)

_MODULES = (
    quality_rules, toxicity, neardup, html_text, bpe, url_filter, quality_model, secret_scan, decontaminate, language,
    word_bpe, conversations, resampling,
)
QUERIES = {name: query for module in _MODULES for name, query in module.QUERIES.items()}
SQL = {name: text for module in _MODULES for name, text in module.SQL.items()}
