"""The corpus queries and the DuckDB SQL of those that SQL can express."""

from __future__ import annotations

from keelstone.llm import hostrules, language, mixing, neighbours, packing, quality, secrets, simhash, substrings, tokencount

QUERIES = {
    "op1_pack": packing.op1_pack,
    "op2_substrings": substrings.op2_substrings,
    "op3_tokens": tokencount.op3_tokens,
    "op5_neighbours": neighbours.op5_neighbours,
    "op4_mix": mixing.op4_mix,
    "op6_quality": quality.op6_quality,
    "op7_secrets": secrets.op7_secrets,
    "op8_simhash": simhash.op8_simhash,
    "op9_host_rules": hostrules.op9_host_rules,
    "op10_language": language.op10_language,
}
ORACLES: dict[str, str] = {
    "op4_mix": mixing.ORACLE,
    "op9_host_rules": hostrules.ORACLE,
}
