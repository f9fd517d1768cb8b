"""The registered queries of this subpackage and their DuckDB equivalents."""

from __future__ import annotations

from .align import op11_align
from .bpe import op13_bpe
from .decontaminate import op3_decontaminate
from .html_text import op10_html_text
from .licenses import op8_licenses
from .mixing import op4_mixing
from .near_dedup import op1_near_dedup
from .oracles import ORACLE_SQL
from .pii import op5_pii
from .quality import op2_quality
from .runs import op12_periodic_runs
from .substring_dedup import op6_substring_dedup
from .token_ids import op7_token_ids
from .warc import op9_warc

QUERIES = {
    "op1_near_dedup": op1_near_dedup,
    "op2_quality": op2_quality,
    "op3_decontaminate": op3_decontaminate,
    "op4_mixing": op4_mixing,
    "op5_pii": op5_pii,
    "op6_substring_dedup": op6_substring_dedup,
    "op7_token_ids": op7_token_ids,
    "op8_licenses": op8_licenses,
    "op9_warc": op9_warc,
    "op10_html_text": op10_html_text,
    "op11_align": op11_align,
    "op12_periodic_runs": op12_periodic_runs,
    "op13_bpe": op13_bpe,
}

__all__ = ["ORACLE_SQL", "QUERIES"]
