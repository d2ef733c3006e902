"""The queries of this subpackage and their SQL, by name."""

from __future__ import annotations

from .ann import op9_ann
from .audit import OP13_SQL, op13_audit
from .bpe import op5_bpe
from .bytebpe import op12_bytebpe
from .jaccard import OP7_SQL, op7_jaccard
from .kmeans import OP11_SQL, op11_kmeans
from .lines import OP8_SQL, op8_lines
from .lm import op4_lm
from .mixing import OP3_SQL, op3_mixing
from .pii import op10_pii
from .quality import op6_quality
from .suffix import op1_suffix
from .toxicity import op2_toxicity

QUERIES = {
    "op1_suffix": op1_suffix,
    "op2_toxicity": op2_toxicity,
    "op3_mixing": op3_mixing,
    "op4_lm": op4_lm,
    "op5_bpe": op5_bpe,
    "op6_quality": op6_quality,
    "op7_jaccard": op7_jaccard,
    "op8_lines": op8_lines,
    "op9_ann": op9_ann,
    "op10_pii": op10_pii,
    "op11_kmeans": op11_kmeans,
    "op12_bytebpe": op12_bytebpe,
    "op13_audit": op13_audit,
}

ORACLE_SQL: dict[str, str] = {
    "op3_mixing": OP3_SQL,
    "op7_jaccard": OP7_SQL,
    "op8_lines": OP8_SQL,
    "op11_kmeans": OP11_SQL,
    "op13_audit": OP13_SQL,
}
