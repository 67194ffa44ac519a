"""The queries of this subpackage and their SQL, for the entry module."""

from __future__ import annotations

from rillway.llm.language import op10_language_id
from rillway.llm.lines import OP2_SQL, op2_line_dedup
from rillway.llm.mixing import OP6_SQL, op6_mix_sources
from rillway.llm.near import op4_jaccard_join
from rillway.llm.packing import op1_best_fit_packing
from rillway.llm.pages import op5_html_extraction
from rillway.llm.quality import OP9_SQL, op9_quality_rules
from rillway.llm.suffixes import op8_suffix_dedup
from rillway.llm.token_files import op3_token_files
from rillway.llm.topk import OP7_SQL, op7_maxscore_top_k

QUERIES = {
    "op1_best_fit_packing": op1_best_fit_packing,
    "op2_line_dedup": op2_line_dedup,
    "op3_token_files": op3_token_files,
    "op4_jaccard_join": op4_jaccard_join,
    "op5_html_extraction": op5_html_extraction,
    "op6_mix_sources": op6_mix_sources,
    "op7_maxscore_top_k": op7_maxscore_top_k,
    "op8_suffix_dedup": op8_suffix_dedup,
    "op9_quality_rules": op9_quality_rules,
    "op10_language_id": op10_language_id,
}

SQL: dict[str, str] = {
    "op2_line_dedup": OP2_SQL,
    "op6_mix_sources": OP6_SQL,
    "op7_maxscore_top_k": OP7_SQL,
    "op9_quality_rules": OP9_SQL,
}
