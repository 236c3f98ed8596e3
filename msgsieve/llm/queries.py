"""Queries of the operators in this package, and SQL counterparts where SQL can express them."""

from __future__ import annotations

from msgsieve.llm import manifest, quality_rules, sharding, spelling, tool_calls
from msgsieve.llm.ann import op8_nearest
from msgsieve.llm.language_id import op2_language_id
from msgsieve.llm.language_model import op1_language_model
from msgsieve.llm.line_dedup import op10_line_dedup
from msgsieve.llm.manifest import op11_manifest
from msgsieve.llm.mixing import op9_mixing
from msgsieve.llm.near_dedup import op3_near_dedup
from msgsieve.llm.packing import op6_packing
from msgsieve.llm.quality_rules import op7_quality_rules
from msgsieve.llm.sharding import op13_sharding
from msgsieve.llm.spelling import op12_spelling
from msgsieve.llm.tool_calls import op4_tool_calls
from msgsieve.llm.toxicity import op5_toxicity

QUERIES = {
    f.__name__: f
    for f in (
        op1_language_model, op2_language_id, op3_near_dedup, op4_tool_calls, op5_toxicity, op6_packing,
        op7_quality_rules, op8_nearest, op9_mixing, op10_line_dedup, op11_manifest,
        op12_spelling, op13_sharding,
    )
}

ORACLE: dict[str, str] = {
    "op4_tool_calls": tool_calls.ORACLE_SQL,
    "op7_quality_rules": quality_rules.ORACLE_SQL,
    "op11_manifest": manifest.ORACLE_SQL,
    "op12_spelling": spelling.ORACLE_SQL,
    "op13_sharding": sharding.ORACLE_SQL,
}
