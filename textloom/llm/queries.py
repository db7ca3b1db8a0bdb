"""The queries of this folder by name, and the SQL of those that SQL can express."""

from textloom.llm import ann, bpe, chat, html_extract, licenses, line_dedup, mixing, quality, sharding, simhash

QUERIES = {
    "op1_html": html_extract.op1_html,
    "op2_sharding": sharding.op2_sharding,
    "op3_bpe": bpe.op3_bpe,
    "op4_simhash": simhash.op4_simhash,
    "op5_line_dedup": line_dedup.op5_line_dedup,
    "op6_ann": ann.op6_ann,
    "op7_chat": chat.op7_chat,
    "op8_mixing": mixing.op8_mixing,
    "op9_quality": quality.op9_quality,
    "op10_licenses": licenses.op10_licenses,
    "quality_texts": quality.quality_text_digests,
}
ORACLES = {
    "op5_line_dedup": line_dedup.OP5_SQL,
    "op7_chat": chat.OP7_SQL,
    "op8_mixing": mixing.OP8_SQL,
    "op9_quality": quality.OP9_SQL,
    "op10_licenses": licenses.OP10_SQL,
    "quality_texts": quality.TEXTS_SQL,
}
