"""The queries of this subpackage, with SQL where it can express them."""

from __future__ import annotations

import corpus_pipeline
from quernstone.llm import bpe, decontaminate, fill_middle, fingerprints, html_text, jaccard, language, licenses, line_dedup, quality, secrets, spelling, substrings

QUERIES = {
    "op1_byte_bpe": bpe.op1_byte_bpe,
    "op10_license_scan": licenses.op10_license_scan,
    "op11_spelling_variants": spelling.op11_spelling_variants,
    "op12_fill_middle": fill_middle.op12_fill_middle,
    "op13_fingerprints": fingerprints.op13_fingerprints,
    "fingerprint_classes": fingerprints.fingerprint_classes,
    "op2_jaccard_join": jaccard.op2_jaccard_join,
    "op3_decontamination": decontaminate.op3_decontamination,
    "op4_html_extraction": html_text.op4_html_extraction,
    "op5_quality_rules": quality.op5_quality_rules,
    "op6_substring_dedup": substrings.op6_substring_dedup,
    "op7_language_id": language.op7_language_id,
    "op8_secret_scan": secrets.op8_secret_scan,
    "op9_line_dedup": line_dedup.op9_line_dedup,
    "quality_rules_v1": quality.quality_rules_v1,
    "quality_ablations": quality.quality_ablations,
    "pipeline": corpus_pipeline.run,
}

ORACLES = {
    "op11_spelling_variants": spelling.ORACLE_OP11,
    "op12_fill_middle": fill_middle.ORACLE_OP12,
    "op2_jaccard_join": jaccard.ORACLE_OP2,
    "op5_quality_rules": quality.ORACLE_OP5,
    "op6_substring_dedup": substrings.ORACLE_OP6,
    "op9_line_dedup": line_dedup.ORACLE_OP9,
    "quality_rules_v1": quality.ORACLE_V1,
    "quality_ablations": quality.ORACLE_ABLATIONS,
}
