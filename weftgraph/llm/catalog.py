"""Queries of the corpus operators, and their SQL where SQL can express them."""

from __future__ import annotations

from .fertility import op5_tokeniser_fertility
from .langid import op1_language_id
from .licences import OP3_SQL, op3_licence_scan
from .linededup import op8_line_dedup
from .lmscore import op4_lm_scoring
from .mixing import OP7_SQL, op7_mixing_sources
from .neardup import op9_minhash_near_dedup
from .packing import op6_best_fit_packing
from .substrings import op10_substring_dedup
from .tries import OP13_SQL, op13_source_divergence
from .turns import OP12_SQL, op12_turn_repair
from .warc import OP11_SQL, op11_warc
from .winnowing import op2_document_fingerprints

QUERIES = {
    "op1_language_id": op1_language_id,
    "op2_document_fingerprints": op2_document_fingerprints,
    "op3_licence_scan": op3_licence_scan,
    "op4_lm_scoring": op4_lm_scoring,
    "op5_tokeniser_fertility": op5_tokeniser_fertility,
    "op6_best_fit_packing": op6_best_fit_packing,
    "op7_mixing_sources": op7_mixing_sources,
    "op8_line_dedup": op8_line_dedup,
    "op9_minhash_near_dedup": op9_minhash_near_dedup,
    "op10_substring_dedup": op10_substring_dedup,
    "op11_warc": op11_warc,
    "op12_turn_repair": op12_turn_repair,
    "op13_source_divergence": op13_source_divergence,
}
ORACLES = {"op3_licence_scan": OP3_SQL, "op7_mixing_sources": OP7_SQL, "op11_warc": OP11_SQL, "op12_turn_repair": OP12_SQL, "op13_source_divergence": OP13_SQL}
