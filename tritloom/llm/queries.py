"""The queries of the training-data operators, and SQL for those that SQL can express."""

from __future__ import annotations

from . import bpe, chatfmt, decontam, htmlmain, langid, licenses, pii, simhash, topk, toxicity

QUERIES = {
    "op1_exact_topk": topk.op1,
    "op2_byte_bpe": bpe.op2,
    "op3_license_scan": licenses.op3,
    "op4_pii_feistel": pii.op4,
    "op5_toxicity_neighbours": toxicity.op5,
    "op6_html_line_blocks": htmlmain.op6,
    "op7_language_id": langid.op7,
    "op8_chat_windows": chatfmt.op8,
    "op9_simhash_neardup": simhash.op9,
    "op10_decontamination": decontam.op10,
}
ORACLE_SQL = {
    "op1_exact_topk": topk.SQL,
    "op3_license_scan": licenses.SQL,
    "op10_decontamination": decontam.SQL,
}
