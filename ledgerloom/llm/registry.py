"""Queries of this subpackage."""

from __future__ import annotations

from . import collocations, fingerprints, source_mixing
from .alignment import op11_alignment
from .collocations import op12_collocations
from .decontamination import op3_decontamination
from .fingerprints import op13_fingerprints
from .jaccard_join import op4_ngram_jaccard_join
from .language_id import op6_language_id
from .line_dedup import op2_line_dedup
from .source_mixing import op9_source_mixing
from .substring_dedup import op1_substring_dedup
from .token_counts import op5_token_counts
from .token_files import op7_token_files
from .toxicity import op8_toxicity
from .vector_search import op10_vector_search

_ALL = (op1_substring_dedup, op2_line_dedup, op3_decontamination, op4_ngram_jaccard_join, op5_token_counts, op6_language_id, op7_token_files, op8_toxicity, op9_source_mixing, op10_vector_search, op11_alignment, op12_collocations, op13_fingerprints)


def queries() -> dict:
    return {f.__name__: f for f in _ALL}


def oracle_sql() -> dict[str, str]:
    return {"op9_source_mixing": source_mixing.ORACLE, "op12_collocations": collocations.ORACLE, "op13_fingerprints": fingerprints.ORACLE}
