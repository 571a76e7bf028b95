"""Queries of the training-data operators, with SQL where SQL can express them."""

from contactloom.llm import (
    centroid_cluster,
    chat_format,
    exact_dedup,
    html_extract,
    minhash_dedup,
    mixing,
    piece_tokenizer,
    prefix_trie,
    quality_classifier,
    quality_rules,
    simhash_dedup,
    toxicity,
    url_filter,
)


def queries():
    return {
        "op1_sentencepiece": piece_tokenizer.query,
        "op2_url_filter": url_filter.query,
        "op3_exact_dedup": exact_dedup.query,
        "op4_toxicity": toxicity.query,
        "op5_html_extraction": html_extract.query,
        "op6_mixing": mixing.query,
        "op7_chat_format": chat_format.query,
        "op8_quality_classifier": quality_classifier.query,
        "op9_simhash": simhash_dedup.query,
        "op10_quality_rules": quality_rules.query,
        "op11_centroid_clustering": centroid_cluster.query,
        "op12_prefix_trie": prefix_trie.query,
        "op13_minhash": minhash_dedup.query,
    }


def oracle_sql():
    return {
        "op3_exact_dedup": exact_dedup.SQL,
        "op6_mixing": mixing.SQL,
        "op7_chat_format": chat_format.SQL,
        "op11_centroid_clustering": centroid_cluster.SQL,
        "op12_prefix_trie": prefix_trie.SQL,
        "op13_minhash": minhash_dedup.SQL,
    }
