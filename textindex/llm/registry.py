"""The queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from .bpe import op9_bpe
from .fingerprints import EDITED_SQL, edited_texts, op3_fingerprints
from .jaccard import OP7_SQL, op7_jaccard_join
from .language import op5_language
from .lines import op10_line_dedup
from .mixing import OP2_SQL, op2_mix_sources
from .quality import BASE_SQL, base_counts, op6_quality
from .scoring import op1_lm_scores
from .token_files import op8_token_files
from .warc import OP4_SQL, op4_warc

QUERIES = {f.__name__: f for f in (op1_lm_scores, op2_mix_sources, op3_fingerprints, op4_warc, op5_language, op6_quality, op7_jaccard_join, op8_token_files, op9_bpe, op10_line_dedup, edited_texts, base_counts)}
SQL = {"op2_mix_sources": OP2_SQL, "op4_warc": OP4_SQL, "op7_jaccard_join": OP7_SQL, "edited_texts": EDITED_SQL, "base_counts": BASE_SQL}
