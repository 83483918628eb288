"""The queries of this subpackage by name, and the SQL of those that SQL can express."""

from __future__ import annotations

from .ann import op7_ann
from .bpe_codec import op4_bpe_codec
from .exact_search import OP1_SQL, op1_exact_top_k
from .language_id import op2_language_id
from .line_templates import op5_line_templates
from .minhash import OP9_SQL, op9_minhash
from .packing import op8_best_fit
from .suffix_dedup import OP3_SQL, op3_suffix_dedup
from .token_files import op6_token_files
from .toxicity import op10_toxicity


def queries() -> dict:
    found = [op1_exact_top_k, op2_language_id, op3_suffix_dedup, op4_bpe_codec, op5_line_templates, op6_token_files, op7_ann, op8_best_fit, op9_minhash, op10_toxicity]
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {"op1_exact_top_k": OP1_SQL, "op3_suffix_dedup": OP3_SQL, "op9_minhash": OP9_SQL}
