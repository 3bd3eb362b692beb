"""The queries of this subpackage and their SQL."""
from __future__ import annotations

import corpus_pipeline

from .chat import op4_chat_format
from .decontaminate import op1_decontamination
from .fingerprint import op6_fingerprint
from .html_text import op10_html_text
from .language import op2_language
from .lines import op8_line_dedup
from .oracles import OP1
from .packing import op5_packing
from .secrets import op3_secret_scan
from .simhash import op9_simhash
from .token_files import op7_token_files

QUERIES = {f.__name__: f for f in (op1_decontamination, op2_language, op3_secret_scan, op4_chat_format, op5_packing, op6_fingerprint, op7_token_files, op8_line_dedup, op9_simhash, op10_html_text)}
QUERIES["pipeline"] = corpus_pipeline.run
ORACLES = {"op1_decontamination": OP1}
