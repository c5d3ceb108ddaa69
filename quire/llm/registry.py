"""The queries of this subpackage and the SQL that gives the same rows, where SQL can."""

from __future__ import annotations

from .decontaminate import OP1_SQL, op1_decontaminate
from .divergence import OP12_SQL, op12_divergence
from .fingerprints import op13_fingerprints
from .html_text import op7_html
from .knn import OP2_SQL, op2_knn
from .packing import op5_pack
from .private import op8_private
from .simhash import op6_simhash
from .substrings import OP3_SQL, op3_substrings
from .token_matrix import op9_matrices
from .toxicity import op4_toxicity
from .warc import op10_warc
from .whitening import op11_whiten


def queries() -> dict:
    return {"op1_decontaminate": op1_decontaminate, "op2_knn": op2_knn, "op3_substrings": op3_substrings, "op4_toxicity": op4_toxicity, "op5_pack": op5_pack, "op6_simhash": op6_simhash, "op7_html": op7_html, "op8_private": op8_private, "op9_matrices": op9_matrices, "op10_warc": op10_warc, "op11_whiten": op11_whiten, "op12_divergence": op12_divergence, "op13_fingerprints": op13_fingerprints}


def oracle_sql() -> dict[str, str]:
    return {"op1_decontaminate": OP1_SQL, "op2_knn": OP2_SQL, "op3_substrings": OP3_SQL, "op12_divergence": OP12_SQL}
