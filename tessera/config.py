"""The semantic settings of the engine in one frozen object."""

from __future__ import annotations

import os
from dataclasses import dataclass

# Content kinds in tie order, symbol roots, model widths.
KINDS = ("api", "tutorial", "guide")
SYMBOL_ROOTS = ("torch", "torchvision", "torchaudio")
MODEL_DIMS = {"small": 384, "base": 768, "large": 1024}


@dataclass(frozen=True)
class Config:
    part_chars: int = 2000
    embed_chars: int = 2000
    synopsis_chars: int = 240
    section_chars: int = 2500
    page_chars: int = 30_000
    batch_rows: int = 128
    pool: int = 20
    k: int = 8
    rrf: int = 60
    relevance_gap: float = 0.15
    topicality: float = 0.35
    question_chars: int = 2000
    ttl_seconds: float = 3600.0
    rate_limit: int = 8
    rate_window_seconds: float = 60.0
    cooldown_cap_seconds: float = 900.0
    page_bytes: int = 20 * 1024 * 1024
    fetch_tries: int = 3
    redirect_hops: int = 3
    crawl_delay: float = 0.2
    guard: bool = True


def env_float(name: str, default: float) -> float:
    """A number from the environment; a missing or malformed one gives the default."""
    try:
        return float(os.environ[name])
    except (KeyError, ValueError):
        return default


def embed_dims(model: str, override: int | None = None) -> int:
    """Vector width of a model; an unknown model without an override is an error."""
    if override is not None:
        return override
    if model not in MODEL_DIMS:
        raise ValueError(f"unknown embedding model {model!r}; give its width")
    return MODEL_DIMS[model]
