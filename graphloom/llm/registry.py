"""The queries of this subpackage and the SQL that checks them."""

from __future__ import annotations

from . import op08_quality_rules, op10_url_rules, op11_vector_codes, op13_hard_negatives
from .op01_near_dedup import op1_near_dedup
from .op02_toxicity import op2_toxicity
from .op03_decontaminate import op3_decontaminate
from .op04_paragraphs import op4_paragraphs
from .op05_suffix_dedup import op5_suffix_dedup
from .op06_token_orc import op6_token_orc
from .op07_mixing import op7_mixing
from .op08_quality_rules import op8_quality_rules
from .op09_line_chunks import op9_line_chunks
from .op10_url_rules import op10_url_rules as _op10
from .op11_vector_codes import op11_vector_codes as _op11
from .op12_packing import op12_packing
from .op13_hard_negatives import op13_hard_negatives as _op13


def queries() -> dict:
    return {f.__name__: f for f in (op1_near_dedup, op2_toxicity, op3_decontaminate, op4_paragraphs, op5_suffix_dedup, op6_token_orc, op7_mixing, op8_quality_rules, op9_line_chunks, _op10, _op11, op12_packing, _op13)}


def oracle_sql() -> dict[str, str]:
    """Operators whose results SQL can express; the others are tested against brute force."""
    return {"op8_quality_rules": op08_quality_rules.ORACLE, "op10_url_rules": op10_url_rules.ORACLE, "op11_vector_codes": op11_vector_codes.ORACLE, "op13_hard_negatives": op13_hard_negatives.ORACLE}
