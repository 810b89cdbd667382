"""Queries of the operators of this subpackage, and SQL where it can express them."""
from __future__ import annotations

import corpus_pipeline
from glare.llm.bpe_codec import op1_bpe_codec
from glare.llm.embeddings import op10_embeddings
from glare.llm.fim import op11_fim
from glare.llm.hard_negatives import op12_hard_negatives
from glare.llm.minhash import op6_minhash
from glare.llm.pii import op9_pii
from glare.llm.packing import op3_packing
from glare.llm import chat, fim, hard_negatives, quality, warc
from glare.llm.toxicity import op7_toxicity
from glare.llm.rans import op4_rans
from glare.llm.token_counts import op13_token_counts

QUERIES = {
    "op1_bpe_codec": op1_bpe_codec,
    "op2_quality": quality.op2_quality,
    "op3_packing": op3_packing,
    "op4_rans": op4_rans,
    "op5_chat": chat.op5_chat,
    "op6_minhash": op6_minhash,
    "op7_toxicity": op7_toxicity,
    "op8_warc": warc.op8_warc,
    "op9_pii": op9_pii,
    "op10_embeddings": op10_embeddings,
    "op11_fim": op11_fim,
    "op12_hard_negatives": op12_hard_negatives,
    "op13_token_counts": op13_token_counts,
    "pipeline": corpus_pipeline.run,
}

ORACLES: dict[str, str] = {
    "op2_quality": quality.SQL,
    "op5_chat": chat.SQL,
    "op8_warc": warc.SQL,
    "op11_fim": fim.SQL,
    "op12_hard_negatives": hard_negatives.SQL,
}
