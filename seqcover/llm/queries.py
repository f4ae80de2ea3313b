"""The operators of this subpackage as queries over the given tables, and their SQL where SQL can express them."""

from __future__ import annotations

from . import bpe, decontaminate, fim, html, linededup, lm, pii, quality, simhash, spelling, substring, tokens, urlfilter

QUERIES = {
    "op1_lm_score": lm.query,
    "op2_decontaminate": decontaminate.query,
    "op3_quality_rules": quality.query,
    "op4_line_dedup": linededup.query,
    "op5_byte_bpe": bpe.query,
    "op6_substring_dedup": substring.query,
    "op7_token_ids": tokens.query,
    "op8_pii": pii.query,
    "op9_simhash": simhash.query,
    "op10_html_text": html.query,
    "op11_spelling_variants": spelling.query,
    "op12_fill_in_middle": fim.query,
    "op13_url_filters": urlfilter.query,
}

ORACLE_SQL: dict[str, str] = {
    "op2_decontaminate": decontaminate.ORACLE,
    "op4_line_dedup": linededup.ORACLE,
    "op6_substring_dedup": substring.ORACLE,
    "op12_fill_in_middle": fim.ORACLE,
    "op13_url_filters": urlfilter.ORACLE,
}
