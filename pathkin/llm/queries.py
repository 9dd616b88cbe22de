"""The queries of this subpackage by name, and the SQL of those that SQL can express."""

from __future__ import annotations

from .bpe import op3_bpe_roundtrip
from .lm import op10_lm_scores
from .materialise import op6_training_order
from .mixing import ORACLE as OP1_SQL
from .mixing import op1_source_mix
from .permutation import op7_permutation_index
from .quality import op8_quality_rff
from .secrets import op9_secret_findings
from .simhash import op5_simhash
from .toxicity import op2_toxicity_nnpu
from .vafile import ORACLE as OP4_SQL
from .vafile import op4_exact_top_k

QUERIES = {
    "op1_source_mix": op1_source_mix,
    "op2_toxicity_nnpu": op2_toxicity_nnpu,
    "op3_bpe_roundtrip": op3_bpe_roundtrip,
    "op4_exact_top_k": op4_exact_top_k,
    "op5_simhash": op5_simhash,
    "op6_training_order": op6_training_order,
    "op7_permutation_index": op7_permutation_index,
    "op8_quality_rff": op8_quality_rff,
    "op9_secret_findings": op9_secret_findings,
    "op10_lm_scores": op10_lm_scores,
}
ORACLE_SQL: dict[str, str] = {
    "op1_source_mix": OP1_SQL,
    "op4_exact_top_k": OP4_SQL,
}
