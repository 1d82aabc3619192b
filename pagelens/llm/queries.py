"""The corpus operators' queries by name, and the SQL that gives the same rows where SQL can express them."""

from __future__ import annotations

import corpus_pipeline

from .chat_format import OP8_SQL, op8_chat_format
from .hard_negatives import OP12_SQL, op12_hard_negatives
from .jaccard_join import OP10_SQL, op10_jaccard_join
from .language_id import op3_language_id
from .lm_scoring import op7_lm_scoring
from .main_text import op13_html_extraction
from .media import op9_media_columns
from .mixing import op6_mixing
from .packing import op2_packing
from .substring_dedup import OP1_SQL, op1_substring_dedup
from .token_alignment import op11_token_alignment
from .topk import OP5_SQL, op5_topk_search
from .url_filters import op4_url_filters

_ALL = (
    op1_substring_dedup,
    op2_packing,
    op3_language_id,
    op4_url_filters,
    op5_topk_search,
    op6_mixing,
    op7_lm_scoring,
    op8_chat_format,
    op9_media_columns,
    op10_jaccard_join,
    op11_token_alignment,
    op12_hard_negatives,
    op13_html_extraction,
)
QUERIES = {f.__name__: f for f in _ALL} | {"pipeline": corpus_pipeline.run}

ORACLES: dict[str, str] = {"op1_substring_dedup": OP1_SQL, "op5_topk_search": OP5_SQL, "op8_chat_format": OP8_SQL, "op10_jaccard_join": OP10_SQL, "op12_hard_negatives": OP12_SQL}
