"""Queries of this folder and SQL for those that SQL can express."""

from __future__ import annotations

from .alignment import op13_alignment
from .byte_bpe import op12_byte_bpe
from .decontaminate import op1_decontaminate
from .language import op10_language
from .line_dedup import op5_line_dedup
from .mixing import op7_mixing
from .pii import op4_pii
from .search import op9_search
from .sharding import op6_sharding
from .simhash import op8_simhash
from .suffix_dedup import op3_suffix_dedup
from .token_files import op2_token_files
from .variants import op11_variants

QUERIES = {
    "op1_decontaminate": op1_decontaminate,
    "op2_token_files": op2_token_files,
    "op3_suffix_dedup": op3_suffix_dedup,
    "op4_pii": op4_pii,
    "op5_line_dedup": op5_line_dedup,
    "op6_sharding": op6_sharding,
    "op7_mixing": op7_mixing,
    "op8_simhash": op8_simhash,
    "op9_search": op9_search,
    "op10_language": op10_language,
    "op11_variants": op11_variants,
    "op12_byte_bpe": op12_byte_bpe,
    "op13_alignment": op13_alignment,
}

SQL: dict[str, str] = {}
