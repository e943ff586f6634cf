"""Settings of the retrieval engine, passed explicitly."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass


@dataclass(frozen=True)
class Settings:
    vector_top_k: int = 10
    keyword_top_k: int = 10
    top_n: int = 5
    max_words: int = 400
    overlap_sentences: int = 1
    overfetch: int = 5
    k1: float = 1.5
    b: float = 0.75
    delta: float = 1.0
    high: float = 2.0
    moderate: float = -2.0
    abstain: float = -6.0
    min_supporting: int = 2
    provider: str | None = None

    def __post_init__(self) -> None:
        if not self.high > self.moderate > self.abstain:
            raise ValueError("thresholds must fall from high over moderate to abstain")
        if self.min_supporting < 1:
            raise ValueError("min_supporting must be 1 at least")
        if min(self.vector_top_k, self.keyword_top_k) < 1 or self.overlap_sentences < 0:
            raise ValueError("candidate counts must be positive")
        if self.top_n < 1 or self.max_words < 1 or self.overfetch < 1:
            raise ValueError("top_n, max_words and overfetch must be positive")
        if not 0 <= self.b <= 1 or self.k1 < 0 or self.delta < 0:
            raise ValueError("b must lie between 0 and 1, k1 and delta must not be negative")

    @classmethod
    def from_variables(cls, variables: Mapping[str, str]) -> Settings:
        """Settings from named variables, such as those of the environment; blank ones keep the default, and a bad value names its variable."""
        found = {}
        for name, field in VARIABLES.items():
            value = (variables.get(name) or "").strip()
            if value:
                kind = type(getattr(cls, field))
                try:
                    found[field] = value.lower() if field == "provider" else kind(value)
                except ValueError as e:
                    raise ValueError(f"{name} is {value!r}, not {kind.__name__}") from e
        return cls(**found)


#: The variables that set a value.
VARIABLES = {
    "VECTOR_TOP_K": "vector_top_k",
    "BM25_TOP_K": "keyword_top_k",
    "FINAL_TOP_N": "top_n",
    "MAX_CHUNK_TOKENS": "max_words",
    "CHUNK_OVERLAP_SENTENCES": "overlap_sentences",
    "RERANK_HIGH_THRESHOLD": "high",
    "RERANK_MODERATE_THRESHOLD": "moderate",
    "RERANK_ABSTAIN_THRESHOLD": "abstain",
    "CONFIDENCE_MIN_SUPPORTING": "min_supporting",
    "GENERATION_PROVIDER": "provider",
}


DEFAULTS = Settings()
