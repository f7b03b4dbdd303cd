"""The registered queries of this subpackage, and SQL twins where SQL can express them."""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from marquee.llm.decontamination import OP1_SQL, op1_positional_index
from marquee.llm.language import op3_hierarchical_svm
from marquee.llm.lexical_search import OP12_SQL, op12_fp_tree
from marquee.llm.near_duplicates import OP5_SQL, op5_parity_sketch
from marquee.llm.packing import op7_best_two_fit
from marquee.llm.pages import op4_composite_density
from marquee.llm.phrases import op9_phrase_fingerprint
from marquee.llm.prefix_trie import OP13_SQL, op13_centroid_trie
from marquee.llm.scoring import op6_backoff_automaton
from marquee.llm.secrets import op8_blob_ledger
from marquee.llm.sharding import op2_permutation_table
from marquee.llm.token_counts import op11_token_counts
from marquee.llm.toxicity import op10_string_kernel

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {q.__name__: q for q in (op1_positional_index, op2_permutation_table, op3_hierarchical_svm, op4_composite_density, op5_parity_sketch, op6_backoff_automaton, op7_best_two_fit, op8_blob_ledger, op9_phrase_fingerprint, op10_string_kernel, op11_token_counts, op12_fp_tree, op13_centroid_trie)}
ORACLES: dict[str, str] = {"op1_positional_index": OP1_SQL, "op5_parity_sketch": OP5_SQL, "op12_fp_tree": OP12_SQL, "op13_centroid_trie": OP13_SQL}
