"""The queries of this subpackage, and SQL where it can express them."""

from __future__ import annotations

from quarry.llm.ann import op2_nearest_neighbours
from quarry.llm.counts import op6_token_counts
from quarry.llm.decontaminate import op4_benchmark_decontamination
from quarry.llm.divergence import SOURCE_DIVERGENCE_SQL, op11_source_divergence
from quarry.llm.html import op12_html_extraction
from quarry.llm.language import op9_language_id
from quarry.llm.mixing import op3_mix_sources
from quarry.llm.repeats import op5_suffix_dedup
from quarry.llm.simhash import op7_simhash_near_dedup
from quarry.llm.tokens import op1_token_output
from quarry.llm.toxicity import op10_toxicity
from quarry.llm.urls import op8_url_filters
from quarry.llm.variants import op13_spelling_variants


def queries() -> dict:
    return {f.__name__: f for f in (op1_token_output, op2_nearest_neighbours, op3_mix_sources, op4_benchmark_decontamination, op5_suffix_dedup, op6_token_counts, op7_simhash_near_dedup, op8_url_filters, op9_language_id, op10_toxicity, op11_source_divergence, op12_html_extraction, op13_spelling_variants)}


def oracle_sql() -> dict[str, str]:
    return {"op11_source_divergence": SOURCE_DIVERGENCE_SQL}
