"""The queries of this subpackage, and the DuckDB SQL of those that SQL can express."""

from __future__ import annotations

from leafmill.llm import chat, decontaminate, html_extract, licenses, lm, pieces, pii, quality, secret_scan, simhash

QUERIES = {
    "op1_decontaminate": decontaminate.op1_decontaminate,
    "op2_sentencepiece": pieces.op2_sentencepiece,
    "op3_simhash": simhash.op3_simhash,
    "op4_quality_rules": quality.op4_quality_rules,
    "op5_lm_score": lm.op5_lm_score,
    "op6_chat": chat.op6_chat,
    "op7_html_extract": html_extract.op7_html_extract,
    "op8_license_scan": licenses.op8_license_scan,
    "op9_pii": pii.op9_pii,
    "op10_secret_scan": secret_scan.op10_secret_scan,
}

ORACLE_SQL = {"op1_decontaminate": decontaminate.OP1_SQL, "op6_chat": chat.OP6_SQL}
