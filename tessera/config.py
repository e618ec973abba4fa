"""Engine settings."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Config:
    sample_target: int = 3000
    seed: int = 42
    artifacts: str = "artifacts"
