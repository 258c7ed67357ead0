"""The queries of this subpackage, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from factloom.llm import ann, langid, lm, mixing, neardup, packing, secrets, sketch, urlfilter, warc

QUERIES = {
    "op1_lm_score": lm.op1_lm_score,
    "op3_nearest": ann.op3_nearest,
    "op7_near_duplicates": neardup.op7_near_duplicates,
    "op9_language": langid.op9_language,
    "op8_pack": packing.op8_pack,
    "op2_warc_revisits": warc.op2_warc_revisits,
    "op4_mix": mixing.op4_mix,
    "op5_temporal_url_filter": urlfilter.op5_temporal_url_filter,
    "op6_scaled_sketch": sketch.op6_scaled_sketch,
    "op10_secret_scan": secrets.op10_secret_scan,
}
ORACLE = {
    "op2_warc_revisits": warc.OP2_SQL,
    "op5_temporal_url_filter": urlfilter.OP5_SQL,
    "op6_scaled_sketch": sketch.OP6_SQL,
}
