"""The registered queries of this subpackage, one for each operator, and SQL where it can express them."""

from . import chat, embedding_dedup, mixing, sentencepiece, simhash, suffix_dedup, token_file, topk, toxicity, warc

QUERIES = {
    "op1_sentencepiece": sentencepiece.op1_sentencepiece,
    "op2_suffix_dedup": suffix_dedup.op2_suffix_dedup,
    "op3_toxicity": toxicity.op3_toxicity,
    "op4_chat": chat.op4_chat,
    "op5_warc": warc.op5_warc,
    "op6_topk": topk.op6_topk,
    "op7_mixing": mixing.op7_mixing,
    "op8_simhash": simhash.op8_simhash,
    "op9_token_file": token_file.op9_token_file,
    "op10_embedding_dedup": embedding_dedup.op10_embedding_dedup,
}

ORACLE = {
    "op2_suffix_dedup": suffix_dedup.OP2_SQL,
    "op4_chat": chat.OP4_SQL,
    "op5_warc": warc.OP5_SQL,
    "op6_topk": topk.OP6_SQL,
    "op10_embedding_dedup": embedding_dedup.OP10_SQL,
}
