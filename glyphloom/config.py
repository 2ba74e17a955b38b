"""Settings, each with its environment variable."""

from __future__ import annotations

import os
from dataclasses import dataclass, fields


@dataclass(frozen=True)
class Config:
    batch_rows: int = 100_000
    total_rows: int = 5_000_000
    k_best: int = 5
    expand_limit: int = 20
    merged_limit: int = 20
    temperature: float = 1.8
    least_posterior: float = 0.1
    most_paths: int = 3
    structure_mass: float = 0.98
    emission_mass: float = 0.99

    @classmethod
    def from_env(cls, prefix: str = "GLYPHLOOM_") -> Config:
        given = {f.name: os.environ.get(prefix + f.name.upper()) for f in fields(cls)}
        return cls(**{k: type(getattr(cls, k))(v) for k, v in given.items() if v})
