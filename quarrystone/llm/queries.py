"""The registered queries of the training-data operators, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quarrystone.llm import bpe_lexicon, budget_mix, grace_dedup, lang_rank, license_scan, line_templates, lsh_forest, packed_ids, secret_grammar, weighted_sampling
from quarrystone.llm.common import documents


def word_bpe() -> str:
    """The tokenizer file of the queries."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_token_ids": lambda s, d: packed_ids.op1_token_ids(s, documents(s, d), word_bpe()),
        "op2_license_scan": license_scan.op2_license_scan,
        "op3_exact_dedup": lambda s, d: grace_dedup.op3_exact_dedup(s, documents(s, d)),
        "op4_line_dedup": line_templates.op4_line_dedup,
        "op5_secrets": lambda s, d: secret_grammar.op5_secrets(s, documents(s, d)),
        "op6_bpe": lambda s, d: bpe_lexicon.op6_bpe(s, documents(s, d), word_bpe()),
        "op7_fingerprints": weighted_sampling.op7_fingerprints,
        "op8_near_dedup": lambda s, d: lsh_forest.op8_near_dedup(s, documents(s, d)),
        "op9_budget_mix": budget_mix.op9_budget_mix,
        "op10_language_id": lang_rank.op10_language_id,
    }


def oracle_sql() -> dict[str, str]:
    return {"op3_exact_dedup": grace_dedup.OP3_SQL}
