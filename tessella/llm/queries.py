"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from .boosting import op5_boosted_quality_rules
from .bpe import op8_bpe_prefix_dp
from .collocations import OP13_SQL, op13_collocations
from .decontamination import OP7_SQL, op7_suffix_decontamination
from .extraction import op9_dom_extraction
from .line_dedup import OP10_SQL, op10_line_dedup
from .periodic import op12_periodic_runs
from .quadratic import op2_qda_quality
from .quotations import OP1_SQL, op1_quote_links
from .secrets import op4_secret_forest
from .simhash import op6_simhash_golay
from .toxicity import op3_toxicity_chain
from .warc import OP11_SQL, op11_warc_bundles

QUERIES = {
    "op4_secret_forest": op4_secret_forest,
    "op1_quote_links": op1_quote_links,
    "op3_toxicity_chain": op3_toxicity_chain,
    "op9_dom_extraction": op9_dom_extraction,
    "op2_qda_quality": op2_qda_quality,
    "op5_boosted_quality_rules": op5_boosted_quality_rules,
    "op6_simhash_golay": op6_simhash_golay,
    "op7_suffix_decontamination": op7_suffix_decontamination,
    "op8_bpe_prefix_dp": op8_bpe_prefix_dp,
    "op10_line_dedup": op10_line_dedup,
    "op11_warc_bundles": op11_warc_bundles,
    "op12_periodic_runs": op12_periodic_runs,
    "op13_collocations": op13_collocations,
}

#: DuckDB SQL, where SQL can express the operator.
ORACLES = {
    "op1_quote_links": OP1_SQL,
    "op7_suffix_decontamination": OP7_SQL,
    "op10_line_dedup": OP10_SQL,
    "op11_warc_bundles": OP11_SQL,
    "op13_collocations": OP13_SQL,
}
