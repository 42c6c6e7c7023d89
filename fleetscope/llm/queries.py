"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from .decontaminate import OP2_SQL, op2_ngram_set
from .fingerprints import op3_paragraph_sketch
from .hard_negatives import OP11_SQL, op11_hilbert_zones
from .jaccard import OP9_SQL, op9_count_vector_rtree
from .licenses import op8_license_alignment
from .lsh_forest import OP13_SQL, op13_lsh_forest
from .merkle import OP12_SQL, op12_merkle_rollup
from .packing import op6_vector_packing
from .sharding import op5_sampled_splitters
from .token_files import op1_arrow_sequences
from .substring import OP4_SQL, op4_debruijn_spans
from .toxicity import op7_nb_ngram_svm
from .url_rules import OP10_SQL, op10_url_expressions

QUERIES = {
    "op1_arrow_sequences": op1_arrow_sequences,
    "op2_ngram_set": op2_ngram_set,
    "op3_paragraph_sketch": op3_paragraph_sketch,
    "op4_debruijn_spans": op4_debruijn_spans,
    "op5_sampled_splitters": op5_sampled_splitters,
    "op6_vector_packing": op6_vector_packing,
    "op7_nb_ngram_svm": op7_nb_ngram_svm,
    "op8_license_alignment": op8_license_alignment,
    "op9_count_vector_rtree": op9_count_vector_rtree,
    "op10_url_expressions": op10_url_expressions,
    "op11_hilbert_zones": op11_hilbert_zones,
    "op12_merkle_rollup": op12_merkle_rollup,
    "op13_lsh_forest": op13_lsh_forest,
}

ORACLES = {
    "op2_ngram_set": OP2_SQL,
    "op4_debruijn_spans": OP4_SQL,
    "op9_count_vector_rtree": OP9_SQL,
    "op10_url_expressions": OP10_SQL,
    "op11_hilbert_zones": OP11_SQL,
    "op12_merkle_rollup": OP12_SQL,
    "op13_lsh_forest": OP13_SQL,
}
