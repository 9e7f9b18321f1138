"""The corpus queries and, where SQL can say them, their DuckDB equivalents."""

from __future__ import annotations

from . import chat, collocations, decontaminate, importance, jaccard, language, licenses, mixing, quality, substrings, token_counts, topk, toxicity

_MODULES = [language, decontaminate, licenses, topk, jaccard, quality, substrings, mixing, token_counts, toxicity, importance, collocations, chat]


def _by_number(name: str) -> int:
    return int(name[2:].split("_")[0])


def queries() -> dict:
    found = {n: f for m in _MODULES for n, f in vars(m).items() if n.startswith("op") and n[2].isdigit()}
    return {n: found[n] for n in sorted(found, key=_by_number)}


def oracle_sql() -> dict[str, str]:
    return {n: m.ORACLE_SQL for m in _MODULES if getattr(m, "ORACLE_SQL", None) for n in vars(m) if n.startswith("op") and n[2].isdigit()}
