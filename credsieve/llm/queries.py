"""The registered queries of the operators and their SQL, by operator number."""

from credsieve.llm import (
    compression,
    decontaminate,
    linededup,
    mixing,
    negatives,
    packing,
    quality_rules,
    simhash,
    suffixes,
    surrogates,
    toolcalls,
    urlfilter,
    vectorcodes,
)

QUERIES = {
    "op1_pii_surrogates": surrogates.op1_pii_surrogates,
    "op2_tool_call_linking": toolcalls.op2_tool_call_linking,
    "op3_url_filters": urlfilter.op3_url_filters,
    "op4_mixing_to_targets": mixing.op4_mixing_to_targets,
    "op5_quality_rules": quality_rules.op5_quality_rules,
    "op6_line_dedup": linededup.op6_line_dedup,
    "op7_simhash_near_dedup": simhash.op7_simhash_near_dedup,
    "op8_quality_classifier": compression.op8_quality_classifier,
    "op9_benchmark_decontamination": decontaminate.op9_benchmark_decontamination,
    "op10_suffix_array_dedup": suffixes.op10_suffix_array_dedup,
    "op11_hard_negatives": negatives.op11_hard_negatives,
    "op12_best_fit_packing": packing.op12_best_fit_packing,
    "op13_vector_codes": vectorcodes.op13_vector_codes,
}

ORACLES = {
    "op3_url_filters": urlfilter.ORACLE,
    "op11_hard_negatives": negatives.ORACLE,
}
