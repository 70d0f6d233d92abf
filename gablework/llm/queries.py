"""The registered queries of this subpackage and the SQL that checks those SQL can express."""

from __future__ import annotations

from .decontaminate import DECONTAMINATE_SQL, op7_decontaminate
from .exact_dedup import EXACT_SQL, op10_exact_dedup
from .html_text import op1_main_text
from .jaccard_join import JACCARD_SQL, op9_jaccard_join
from .language import op3_language
from .language_model import op13_language_model
from .licenses import op8_license_scan
from .line_dedup import LINES_SQL, op6_line_dedup
from .merkle import MERKLE_SQL, op12_merkle_manifest
from .packing import op5_best_fit_packing
from .pii import op4_pii
from .token_alignment import op11_token_alignment
from .urls import op2_url_filter

QUERIES = {
    q.__name__: q
    for q in (
        op1_main_text,
        op2_url_filter,
        op3_language,
        op4_pii,
        op5_best_fit_packing,
        op6_line_dedup,
        op7_decontaminate,
        op8_license_scan,
        op9_jaccard_join,
        op10_exact_dedup,
        op11_token_alignment,
        op12_merkle_manifest,
        op13_language_model,
    )
}
ORACLES = {
    "op6_line_dedup": LINES_SQL,
    "op7_decontaminate": DECONTAMINATE_SQL,
    "op9_jaccard_join": JACCARD_SQL,
    "op10_exact_dedup": EXACT_SQL,
    "op12_merkle_manifest": MERKLE_SQL,
}
