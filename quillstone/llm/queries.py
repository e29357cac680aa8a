"""The queries of the training-data operators and, where SQL can express them, their SQL."""

from __future__ import annotations

from .fingerprints import op7_fingerprints
from .jaccard import OP10_SQL, op10_jaccard_join
from .mixing import OP9_SQL, op9_mixing
from .packing import op2_packing
from .quality import op6_quality
from .substring import OP3_SQL, op3_substring_dedup
from .token_files import op1_token_files
from .urlfilter import op8_url_filter
from .vafile import OP4_SQL, op4_top_k
from .warc import OP5_SQL, op5_warc

QUERIES = {
    "op1_token_files": op1_token_files,
    "op2_packing": op2_packing,
    "op3_substring_dedup": op3_substring_dedup,
    "op4_top_k": op4_top_k,
    "op5_warc": op5_warc,
    "op6_quality": op6_quality,
    "op7_fingerprints": op7_fingerprints,
    "op8_url_filter": op8_url_filter,
    "op9_mixing": op9_mixing,
    "op10_jaccard_join": op10_jaccard_join,
}
ORACLES = {"op3_substring_dedup": OP3_SQL, "op4_top_k": OP4_SQL, "op5_warc": OP5_SQL, "op9_mixing": OP9_SQL, "op10_jaccard_join": OP10_SQL}
