"""The corpus queries and their SQL, gathered from the operators' modules."""

from . import bpe, decontamination, language_id, language_model, near_dedup, substring_dedup, token_files, topk_search, toxicity, url_filter

_MODULES = [substring_dedup, decontamination, near_dedup, bpe, toxicity, token_files, url_filter, topk_search, language_model, language_id]
QUERIES = {k: v for m in _MODULES for k, v in m.QUERIES.items()}
ORACLE = {k: v for m in _MODULES for k, v in m.ORACLE.items()}
