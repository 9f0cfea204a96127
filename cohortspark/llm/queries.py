"""All queries of the subpackage, registered by importing their modules."""

from cohortspark.llm import (  # noqa: F401
    conversations, mixing, near_copies, packing, phrases, quality, secrets, sharding, substrings, token_counts,
    url_rules, vectors, wrappers,
)
from cohortspark.llm.registry import LLM_ORACLES, LLM_QUERIES

__all__ = ["LLM_ORACLES", "LLM_QUERIES"]
