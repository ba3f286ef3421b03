"""The training-data operators' queries and, where SQL can express them, their oracles."""

from __future__ import annotations

from palimpsest.llm.bpe import op1_bpe
from palimpsest.llm.classifier import op7_quality_classifier
from palimpsest.llm.fingerprint import op3_fingerprint
from palimpsest.llm.line_dedup import op9_line_dedup
from palimpsest.llm.packing import op6_packing
from palimpsest.llm.quality_rules import op10_quality_rules
from palimpsest.llm.secret_scan import op8_secret_scan
from palimpsest.llm.simhash import op5_simhash
from palimpsest.llm.suffix_dedup import op4_suffix_dedup
from palimpsest.llm.training_order import op2_training_order

QUERIES = {
    "op1_bpe": op1_bpe,
    "op2_training_order": op2_training_order,
    "op3_fingerprint": op3_fingerprint,
    "op4_suffix_dedup": op4_suffix_dedup,
    "op5_simhash": op5_simhash,
    "op6_packing": op6_packing,
    "op7_quality_classifier": op7_quality_classifier,
    "op8_secret_scan": op8_secret_scan,
    "op9_line_dedup": op9_line_dedup,
    "op10_quality_rules": op10_quality_rules,
}

ORACLES: dict[str, str] = {}
