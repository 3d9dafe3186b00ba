"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from skein.llm import chat, decontaminate, jaccard, line_dedup, lm, mixing, pq, prefix_trie, style_tree, toxicity, url_filter, warc, whiten


def _op1(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return decontaminate.report(spark, docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


QUERIES = {
    "op1_decontaminate": _op1,
    "op2_embedding_dedup": pq.query,
    "op3_jaccard_join": jaccard.query,
    "op4_warc": warc.query,
    "op5_mix": mixing.query,
    "op6_lm_score": lm.query,
    "op7_toxicity": toxicity.query,
    "op8_chat_collapse": chat.query,
    "op9_line_dedup": line_dedup.query,
    "op10_url_filter": url_filter.query,
    "op11_whiten": whiten.query,
    "op12_prefix_trie": prefix_trie.query,
    "op13_main_text": style_tree.query,
}

ORACLES = {
    "op1_decontaminate": decontaminate.ORACLE,
    "op2_embedding_dedup": pq.ORACLE,
    "op3_jaccard_join": jaccard.ORACLE,
    "op4_warc": warc.ORACLE,
    "op5_mix": mixing.ORACLE,
    "op8_chat_collapse": chat.ORACLE,
    "op9_line_dedup": line_dedup.ORACLE,
    "op10_url_filter": url_filter.ORACLE,
    "op12_prefix_trie": prefix_trie.ORACLE,
    "op13_main_text": style_tree.ORACLE,
}
