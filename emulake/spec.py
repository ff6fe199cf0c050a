"""Plain descriptions of datasets and runs."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field, fields
from typing import Any


@dataclass
class DatasetSpec:
    """Column roles of one table."""

    inputs: list[str]
    outputs: list[str]
    groups: dict[str, list[str]] = field(default_factory=dict)
    key: list[str] = field(default_factory=list)


@dataclass
class TuneSpec:
    """Search over ``space``: name -> {type, low, high, ...}.

    ``method`` is "random" (every trial sees all rows) or "halving": in each of ``rungs`` the trials see ``eta`` times the rows of the
    rung before, all in the last, and the best 1 / ``eta`` of them go on.
    """

    space: dict[str, dict[str, Any]]
    n_trials: int = 10
    metric: str = "val_rmse"
    direction: str = "minimize"
    method: str = "random"
    seed: int = 42
    eta: int = 3
    rungs: int = 3


@dataclass
class ModelSpec:
    """A registered model with its parameters."""

    key: str
    name: str | None = None
    params: dict[str, Any] = field(default_factory=dict)
    tune: TuneSpec | None = None
    uncertainty: bool = False

    @property
    def label(self) -> str:
        return self.name or self.key


@dataclass
class RunSpec:
    """One declarative run: where the table is, how to split and scale, which models to fit."""

    path: str | None = None
    format: str = "auto"
    key: list[str] = field(default_factory=list)
    metadata: dict[str, Any] = field(default_factory=dict)
    hints: dict[str, Any] = field(default_factory=dict)
    sample: int | None = None
    test_fraction: float = 0.2
    val_fraction: float = 0.2
    shuffle: bool = True
    row_idx: str | None = None
    standardize_inputs: bool = True
    standardize_outputs: bool = False
    seed: int = 42
    cv_folds: int | None = None
    check_keys: bool = True
    models: list[ModelSpec] = field(default_factory=list)
    output_dir: str | None = None
    predictions_format: str = "parquet"
    finetune_from: str | None = None

    @classmethod
    def from_dict(cls, raw: Mapping[str, Any]) -> RunSpec:
        """Build from parsed YAML or JSON; unknown keys are errors."""
        known = {f.name for f in fields(cls)}
        unknown = set(raw) - known
        if unknown:
            raise ValueError(f"unknown run settings: {sorted(unknown)}")
        data = dict(raw)
        models = []
        for m in data.pop("models", []):
            m = dict(m)
            if m.get("tune"):
                m["tune"] = TuneSpec(**m["tune"])
            models.append(ModelSpec(**m))
        return cls(models=models, **data)
