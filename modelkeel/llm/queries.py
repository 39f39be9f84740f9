"""The operators of this package as queries over the given tables, with their SQL where SQL can say it."""

from __future__ import annotations

from modelkeel.llm import (
    bottomk, chat, decontam, editembed, linededup, logbilinear, mixing, nbsvm, periodic, personal, spelling, suffixdedup, warc,
)

QUERIES = {
    "op1_edit_fingerprint": editembed.op1_edit_fingerprint,
    "op2_mix_sources": mixing.op2_mix_sources,
    "op3_suffix_dedup": suffixdedup.op3_suffix_dedup,
    "op4_warc": warc.op4_warc,
    "op5_lm_score": logbilinear.op5_lm_score,
    "op6_line_dedup": linededup.op6_line_dedup,
    "op7_quality_nbsvm": nbsvm.op7_quality_nbsvm,
    "op8_bottom_k": bottomk.op8_bottom_k,
    "op9_chat_format": chat.op9_chat_format,
    "op10_decontaminate": decontam.op10_decontaminate,
    "op11_personal_data": personal.op11_personal_data,
    "op12_spelling_variants": spelling.op12_spelling_variants,
    "op13_periodic_runs": periodic.op13_periodic_runs,
}
ORACLES = {"op2_mix_sources": mixing.ORACLE, "op4_warc": warc.ORACLE}
