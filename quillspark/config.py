"""Settings of a run, with the environment's overrides, and the stages as functions of DataFrames."""

from __future__ import annotations

import os
from collections.abc import Callable, Mapping
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame


@dataclass(frozen=True)
class Cleaning:
    enabled: bool = True


@dataclass(frozen=True)
class Generation:
    model: str = ""
    text_only: bool = False
    syllogism: bool = True
    batch: int = 32
    retries: int = 2


@dataclass(frozen=True)
class Judging:
    model: str = ""
    skip: bool = False
    threshold: float = 1.0
    alignment: bool = True


@dataclass(frozen=True)
class Settings:
    root: str = "."
    data: str = "data"
    seed: int = 42
    cleaning: Cleaning = field(default_factory=Cleaning)
    generation: Generation = field(default_factory=Generation)
    judging: Judging = field(default_factory=Judging)


def from_environment(settings: Settings, environment: Mapping[str, str] = os.environ, prefix: str = "QUILL_") -> Settings:
    """Settings with QUILL_ROOT, QUILL_DATA_DIR, QUILL_GENERATOR and QUILL_JUDGE where they are set."""
    get = lambda name, old: environment.get(prefix + name, old)
    return replace(
        settings, root=get("ROOT", settings.root), data=get("DATA_DIR", settings.data),
        generation=replace(settings.generation, model=get("GENERATOR", settings.generation.model)), judging=replace(settings.judging, model=get("JUDGE", settings.judging.model)),
    )


Stage = tuple[str, Callable[[DataFrame, Settings], DataFrame]]


def run_stages(rows: DataFrame, settings: Settings, stages: list[Stage], start: str | None = None, store: Callable[[DataFrame, str], DataFrame] | None = None) -> DataFrame:
    """The stages one after the other, from `start` on; store keeps each result and reads it back."""
    names = [n for n, _ in stages]
    for name, stage in stages[names.index(start) if start else 0 :]:
        rows = stage(rows, settings)
        rows = store(rows, name) if store else rows
    return rows
