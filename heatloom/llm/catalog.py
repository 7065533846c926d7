"""The queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from heatloom.llm import kd_shards, mixing, nearest, packing, quality, ranked, resampling, secrets, simhash, sketches, toxicity, warc, wrappers


def queries() -> dict:
    return {
        "op1_toxicity": toxicity.op1_toxicity,
        "op2_warc": warc.op2_warc,
        "op3_mixing": mixing.op3_mixing,
        "op4_html": wrappers.op4_html,
        "op5_sharding": kd_shards.op5_sharding,
        "op6_fingerprints": sketches.op6_fingerprints,
        "op7_simhash": simhash.op7_simhash,
        "op8_nearest": nearest.op8_nearest,
        "op9_packing": packing.op9_packing,
        "op10_quality": quality.op10_quality,
        "op11_ranked_search": ranked.op11_ranked_search,
        "op12_secrets": secrets.op12_secrets,
        "op13_resampling": resampling.op13_resampling,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op2_warc": warc.OP2_SQL,
        "op3_mixing": mixing.OP3_SQL,
        "op8_nearest": nearest.OP8_SQL,
        "op11_ranked_search": ranked.OP11_SQL,
        "op12_secrets": secrets.OP12_SQL,
        "op13_resampling": resampling.OP13_SQL,
    }
