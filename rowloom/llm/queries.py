"""All queries of the subpackage."""

from . import chat_format, context_mixing, conversation_repair, exact_dedup, kd_shards, language_id, latent_leaks, mixing, ngram_join, phrase_mining, token_counts, toxicity, url_rules  # noqa: F401
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
