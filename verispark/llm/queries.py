"""The queries of this package and their SQL, for the registry."""

from __future__ import annotations

from .best_fit_packing import op10_best_fit_packing
from .decontamination import OP5_SQL, op5_decontamination
from .embedding_dedup import OP11_SQL, op11_embedding_dedup
from .exact_dedup import OP1_SQL, op1_exact_dedup
from .importance_resampling import OP13_SQL, op13_importance_resampling
from .kneser_ney import op4_lm_scoring
from .language_id import op7_language_id
from .quality_classifier import op6_quality
from .secret_scan import OP9_SQL, op9_secret_scan
from .simhash_dedup import op2_simhash_dedup
from .spelling_variants import OP12_SQL, op12_spelling_variants
from .token_binary import op3_token_binary
from .token_counts import op8_token_counts

QUERIES = {f.__name__: f for f in (op1_exact_dedup, op2_simhash_dedup, op3_token_binary, op4_lm_scoring, op5_decontamination, op6_quality, op7_language_id, op8_token_counts, op9_secret_scan, op10_best_fit_packing, op11_embedding_dedup, op12_spelling_variants, op13_importance_resampling)}
ORACLE_SQL = {"op1_exact_dedup": OP1_SQL, "op5_decontamination": OP5_SQL, "op9_secret_scan": OP9_SQL, "op11_embedding_dedup": OP11_SQL, "op12_spelling_variants": OP12_SQL, "op13_importance_resampling": OP13_SQL}
