"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from . import bpe, chat, embed, langid, minhash, mix, quality, suffix, topk, warc


def queries():
    return {
        "op1_warc": warc.op1_warc,
        "op2_topk": topk.op2_topk,
        "op3_chat": chat.op3_chat,
        "op4_embed": embed.op4_embed,
        "op5_mix": mix.op5_mix,
        "op6_suffix": suffix.op6_suffix,
        "op7_langid": langid.op7_langid,
        "op8_minhash": minhash.op8_minhash,
        "op9_bpe": bpe.op9_bpe,
        "op10_quality": quality.op10_quality,
    }


def oracle_sql():
    return {
        "op1_warc": warc.OP1_SQL,
        "op2_topk": topk.OP2_SQL,
        "op3_chat": chat.OP3_SQL,
        "op4_embed": embed.OP4_SQL,
        "op5_mix": mix.OP5_SQL,
        "op6_suffix": suffix.OP6_SQL,
        "op8_minhash": minhash.OP8_SQL,
        "op9_bpe": bpe.op9_sql(),
    }
