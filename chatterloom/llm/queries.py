"""The queries of this subpackage, and the SQL that must agree with them."""

from chatterloom.llm import alignment, bpe, credentials, langid, lines, minhash, mixing, quality, quotes, substrings, templates, topk, variants

QUERIES = {
    "op1_lines": lines.op1_lines,
    "op2_html": templates.op2_html,
    "op3_secrets": credentials.op3_secrets,
    "op4_minhash": minhash.op4_minhash,
    "op5_topk": topk.op5_topk,
    "op6_mixing": mixing.op6_mixing,
    "op7_quality": quality.op7_quality,
    "op8_bpe": bpe.op8_bpe,
    "op9_quotes": quotes.op9_quotes,
    "op10_langid": langid.op10_langid,
    "op11_substrings": substrings.op11_substrings,
    "op12_alignment": alignment.op12_alignment,
    "op13_variants": variants.op13_variants,
}

#: Operators that SQL cannot express have none: they are tested against brute force.
ORACLES = {
    "op1_lines": lines.OP1_SQL,
    "op4_minhash": minhash.OP4_SQL,
    "op5_topk": topk.OP5_SQL,
    "op6_mixing": mixing.OP6_SQL,
    "op7_quality": quality.OP7_SQL,
    "op11_substrings": substrings.OP11_SQL,
    "op13_variants": variants.OP13_SQL,
}
