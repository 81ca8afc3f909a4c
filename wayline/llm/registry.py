"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from . import exact_dedup, html_text, licenses, mixing, near_dedup, piece_tokens, quality, sharding, spot_signatures, substring_dedup, token_alignment, vector_codes, vector_dedup

_MODULES = (sharding, substring_dedup, exact_dedup, spot_signatures, piece_tokens, near_dedup, mixing, licenses, quality, html_text, vector_codes, token_alignment, vector_dedup)


def queries() -> dict:
    numbered = {name: getattr(m, name) for m in _MODULES for name in vars(m) if name.startswith("op") and name[2].isdigit()}
    return numbered | {k: f for m in _MODULES for k, f in getattr(m, "QUERIES", {}).items()}


def oracle_sql() -> dict[str, str]:
    return {k: v for m in _MODULES for k, v in getattr(m, "ORACLE_SQL", {}).items()}
