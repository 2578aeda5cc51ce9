"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from . import decontaminate, html_text, jaccard, mixing, oracles, pii, pipeline, quality, quotes, syncmers, toxicity, warc


def queries():
    return {
        "pipeline": pipeline.run,
        "op1_quotation_linking": quotes.query,
        "op2_tag_path_ratios": html_text.query,
        "op3_pigeonhole_decontamination": decontaminate.query,
        "op4_syncmer_fingerprints": syncmers.query,
        "op5_min_cost_flow_mixing": mixing.query,
        "op6_ngram_jaccard_join": jaccard.query,
        "op7_bootstrapped_pii": pii.query,
        "op8_warc_index_first": warc.query,
        "op9_nb_svm_quality": quality.query,
        "op10_ftrl_toxicity": toxicity.query,
    }


def oracle_sql():
    return {"op1_quotation_linking": oracles.QUOTES, "op6_ngram_jaccard_join": jaccard.ORACLE, "op8_warc_index_first": oracles.WARC}
