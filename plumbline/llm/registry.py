"""The queries of the corpus operators and their SQL."""

from plumbline.llm import clustering, decontaminate, divergence, forest, licenses, pii, quality, rules, suffixes, warc
from plumbline.llm.packing import op6
from plumbline.llm.sharding import op2
from plumbline.llm.simhash import op10

QUERIES = {
    "op2_interleave": op2,
    "op3_fm_index": decontaminate.op3,
    "op1_bootstrapped_pii": pii.op1,
    "op4_weak_labels": quality.op4,
    "op5_deep_shallow": suffixes.op5,
    "op6_bin_slack": op6,
    "op7_boosted_rules": rules.op7,
    "op8_conditional_license": licenses.op8,
    "op9_warc_zstd": warc.op9,
    "op10_pivot_simhash": op10,
    "op11_row_accumulation": divergence.op11,
    "op12_prefix_forest": forest.op12,
    "op13_heap_bounds": clustering.op13,
}
ORACLES: dict[str, str] = {"op3_fm_index": decontaminate.SQL, "op9_warc_zstd": warc.SQL, "op11_row_accumulation": divergence.SQL,
                           "op13_heap_bounds": clustering.SQL}
