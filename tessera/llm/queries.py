"""Queries of the subpackage and their SQL, as __spark_entry__.py registers them."""

from __future__ import annotations

from . import audit, chat, decontaminate, exactdedup, htmltext, licenses, minhash, mixing, ngramjoin, quality, search, sharding, tokenout

QUERIES = {
    "op1_token_ids": tokenout.op1_token_ids,
    "op2_mixing": mixing.op2_mixing,
    "op3_sharding": sharding.op3_sharding,
    "op4_licenses": licenses.op4_licenses,
    "op5_ngram_join": ngramjoin.op5_ngram_join,
    "op6_html": htmltext.op6_html,
    "op7_chat": chat.op7_chat,
    "op8_quality": quality.op8_quality,
    "op9_decontamination": decontaminate.op9_decontamination,
    "op10_exact_dedup": exactdedup.op10_exact_dedup,
    "op11_divergence": audit.op11_divergence,
    "op12_near_dedup": minhash.op12_near_dedup,
    "op13_search": search.op13_search,
}

ORACLE_SQL = {
    "op5_ngram_join": ngramjoin.OP5_SQL,
    "op7_chat": chat.OP7_SQL,
    "op9_decontamination": decontaminate.OP9_SQL,
    "op10_exact_dedup": exactdedup.OP10_SQL,
    "op11_divergence": audit.OP11_SQL,
    "op12_near_dedup": minhash.OP12_SQL,
    "op13_search": search.OP13_SQL,
}
