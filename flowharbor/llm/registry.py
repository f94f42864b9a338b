"""The queries of the training-data operators and the corpus pipeline."""

from __future__ import annotations

import corpus_pipeline

from . import trie, urls
from .align import op13_token_alignment
from .chat import op10_chat
from .html import op4_html
from .language import op2_language_id
from .mixing import op8_mixing
from .packing import op7_packing
from .quality import op3_quality
from .rules import op6_quality_rules
from .simhash import op1_simhash
from .topk import op5_topk
from .toxicity import op9_toxicity
from .trie import op12_prefix_trie
from .urls import op11_url_reputation

OPERATORS = (op1_simhash, op2_language_id, op3_quality, op4_html, op5_topk, op6_quality_rules, op7_packing, op8_mixing, op9_toxicity, op10_chat, op11_url_reputation, op12_prefix_trie, op13_token_alignment)
QUERIES = {f.__name__: f for f in OPERATORS} | {"pipeline": corpus_pipeline.run}
ORACLES = {"op11_url_reputation": urls.ORACLE_SQL, "op12_prefix_trie": trie.ORACLE_SQL}
if corpus_pipeline.ORACLE_SQL:
    ORACLES["pipeline"] = corpus_pipeline.ORACLE_SQL
