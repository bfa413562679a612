"""The queries of this subpackage and their SQL, where SQL can express them."""

from __future__ import annotations

from . import fingerprints, html_extract, language_id, license_scan, line_dedup, lm_score, mixing, packing, quality, simhash

QUERIES = {
    f.__name__: f
    for f in (
        packing.op1_best_fit_packing, line_dedup.op2_line_dedup, license_scan.op3_license_scan, mixing.op4_mixing, html_extract.op5_html_extraction,
        simhash.op6_simhash_near_dedup, lm_score.op7_lm_score, fingerprints.op8_document_fingerprints, language_id.op9_language_id, quality.op10_quality_rules,
    )
}

ORACLE_SQL = {"op2_line_dedup": line_dedup.OP2_SQL, "op3_license_scan": license_scan.OP3_SQL}
