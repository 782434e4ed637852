"""Settings of the engine, from the environment or as given; unset and malformed values are the defaults."""

from __future__ import annotations

import os
from collections.abc import Mapping
from dataclasses import dataclass, fields

from tarn.functions import fixed_values as V


@dataclass(frozen=True)
class Config:
    """Paths, retrieval depths, weights and model names. The variable of a field is TARN_ and its name in capitals."""

    corpus: str = "corpus"
    index: str = "index"
    runs: str = "runs"
    bm25_metadata_mode: str = "unweighted"
    source_k: int = 100
    candidates_each: int = 5
    least_candidates: int = 25
    rrf_k: float = float(V.RRF_K)
    bm25_weight: float = V.LINEAR_WEIGHTS["bm25"]
    embedding_weight: float = V.LINEAR_WEIGHTS["embedding"]
    embedding_model: str = ""
    reranker_model: str = ""
    generation_model: str = ""
    judge_model: str = ""
    local_files_only: bool = True

    @classmethod
    def of(cls, environment: Mapping[str, str] | None = None) -> Config:
        environment = os.environ if environment is None else environment
        found = {}
        for field in fields(cls):
            text = environment.get(f"TARN_{field.name.upper()}", "").strip()
            if text:
                found[field.name] = _parsed(text, field.default)
        return cls(**found)


def _parsed(text: str, default):
    if isinstance(default, bool):
        return text.lower() not in ("0", "false", "no")
    try:
        return type(default)(text)
    except ValueError:
        return default
