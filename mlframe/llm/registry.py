"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from mlframe.llm import decontamination, html_text, language_id, licenses, near_dedup, packing, secrets, substring_dedup, topk, urls


def queries() -> dict:
    return {
        "op1_language_id": language_id.op1_language_id,
        "op2_license_scan": licenses.op2_license_scan,
        "op3_substring_dedup": substring_dedup.op3_substring_dedup,
        "op4_packing": packing.op4_packing,
        "op5_secret_scan": secrets.op5_secret_scan,
        "op6_topk": topk.op6_topk,
        "op7_near_dedup": near_dedup.op7_near_dedup,
        "op8_url_filter": urls.op8_url_filter,
        "op9_decontamination": decontamination.op9_decontamination,
        "op10_html_text": html_text.op10_html_text,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op3_substring_dedup": substring_dedup.OP3_SQL,
        "op6_topk": topk.OP6_SQL,
        "op7_near_dedup": near_dedup.OP7_SQL,
        "op8_url_filter": urls.OP8_SQL,
        "op9_decontamination": decontamination.OP9_SQL,
    }
