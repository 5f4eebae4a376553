"""Registered queries of the subpackage: each applies one operator, with
production parameters, to its whole table (language ID to both of its)."""

from __future__ import annotations

from wirelens.llm import op1_secrets, op2_lm, op3_minhash, op4_bpe, op5_mix, op6_language, op7_embeddings, op8_repeats, op9_html, op10_fingerprint, op11_trie, op12_spelling, op13_exact
from wirelens.llm.common import table


def _over(name, fn):
    return lambda spark, sf_dir: fn(table(spark, sf_dir, name))


def queries():
    return {
        "op1_secret_scan": _over("documents", op1_secrets.query),
        "op2_lm_score": _over("documents", op2_lm.query),
        "op3_minhash_dedup": _over("documents", op3_minhash.query),
        "op4_bpe": _over("documents", op4_bpe.query),
        "op5_mix_sources": _over("documents", op5_mix.query),
        "op6_language_id": _over("documents", op6_language.query),
        "op6_language_id_pages": lambda spark, sf_dir: op6_language.identify_pages(table(spark, sf_dir, "pages"), table(spark, sf_dir, "documents")),
        "op7_embedding_dedup": _over("embeddings", op7_embeddings.query),
        "op8_suffix_dedup": _over("documents", op8_repeats.query),
        "op9_html_text": _over("pages", op9_html.query),
        "op10_fingerprint": _over("documents", op10_fingerprint.query),
        "op11_prefix_trie": _over("conversations", op11_trie.query),
        "op12_spelling_groups": _over("documents", op12_spelling.query),
        "op13_exact_dedup": _over("documents", op13_exact.query),
    }


def oracle_sql():
    return {"op1_secret_scan": op1_secrets.oracle(), "op11_prefix_trie": op11_trie.oracle(),
            "op12_spelling_groups": op12_spelling.oracle(), "op13_exact_dedup": op13_exact.oracle()}
