"""Settings of a run, read from YAML; unknown keys are refused."""

from __future__ import annotations

import os
import re
from datetime import date, datetime, time, timedelta
from pathlib import Path

import yaml
from pydantic import BaseModel, ConfigDict, model_validator

from ..operators.pairs import RelParams
from ..operators.periods import Annotation
from ..operators.ranking import BANDS
from ..sources.contract import load_contract
from ..sources.flows import FIELDS


class ConfigError(ValueError):
    """The settings can't be used."""


class Strict(BaseModel):
    model_config = ConfigDict(extra="forbid")


class SplitSettings(Strict):
    """Explicit periods [start, end), or fractions of the days with data."""

    train: tuple[date, date] | None = None
    validation: tuple[date, date] | None = None
    test: tuple[date, date] | None = None
    fractions: dict[str, float] = {"train": 0.5, "validation": 0.25, "test": 0.25}

    @model_validator(mode="after")
    def _whole(self) -> SplitSettings:
        if bool(self.train) != bool(self.validation):
            raise ValueError("train and validation go together")
        return self


class ModelSettings(Strict):
    kind: str
    label: str = ""
    scaler: str = "robust"
    seed: int = 0
    max_rows: int | None = None
    settings: dict = {}


class BandSettings(Strict):
    quantiles: dict[str, float] = dict(BANDS)
    budgets: dict[str, float] | None = None
    review: list[str] = ["Critical", "High"]

    @model_validator(mode="after")
    def _ordered(self) -> BandSettings:
        q = list(self.quantiles.values())
        if q != sorted(q, reverse=True) or not all(0 < x < 1 for x in q) or not set(self.review) <= set(self.quantiles):
            raise ValueError("bands go from the highest quantile down, within (0, 1); review bands must be bands")
        return self


class RelationshipSettings(Strict):
    """Pair analysis. It is for the report only, unless include_model_features makes its host summaries inputs of the models."""

    enabled: bool = False
    include_model_features: bool = False
    window_minutes: int | None = None
    novelty_lookback_days: float = 7
    baseline_lookback_days: float = 7
    warmup_days: float = 7
    min_support: int = 4
    log2_threshold: float = 2.0
    top_pairs: int = 25
    group_by_port: bool = False
    group_by_protocol: bool = False


class DiagnosticSettings(Strict):
    """Daily top-k, top n of a period, buffer widths (hours) that are compared, rows in one model's top but not the other's, and the
    quantile of training scores beyond which a refit leaves rows out."""

    top_k_per_day: int = 20
    top_n: int = 200
    buffers: list[float] = [0, 24, 72, 168]
    disagreements: int = 15
    trim_quantile: float = 0.99


class Config(Strict):
    """All settings."""

    inputs: list[str]
    output: str
    allow_inside_repository: bool = False
    contract: str | None = None
    field_map: dict[str, str] = {}
    epoch_unit: str | None = None
    window_minutes: int = 60
    include: list[str] | None = None
    exclude: list[str] = []
    split: SplitSettings = SplitSettings()
    models: list[ModelSettings] = [ModelSettings(kind="iforest")]
    bands: BandSettings = BandSettings()
    annotations: str | None = None
    buffer_hours: float = 6
    exclude_annotated: bool = False
    relationships: RelationshipSettings = RelationshipSettings()
    diagnostics: DiagnosticSettings = DiagnosticSettings()
    top_n_traces: int = 50
    trace_rows: int = 5
    robustness_seeds: list[int] = []
    search: list[dict] = []

    @model_validator(mode="after")
    def _windows(self) -> Config:
        for m in (self.window_minutes, self.relationships.window_minutes or self.window_minutes):
            if m <= 0 or 1440 % m:
                raise ValueError("windows must divide a day")
        r = self.relationships
        if r.include_model_features and not r.enabled:
            raise ValueError("relationships.include_model_features needs relationships.enabled")
        if r.include_model_features and r.window_minutes not in (None, self.window_minutes):
            raise ValueError("pair features join the host windows: relationships.window_minutes must be window_minutes")
        return self

    def mapping(self) -> dict[str, str]:
        """The source column of canonical fields: what the contract says, and field_map before that."""
        named = load_contract(self.contract).field_map(f.name for f in FIELDS) if self.contract else {}
        return named | self.field_map

    def rel_params(self) -> RelParams:
        r = self.relationships
        return RelParams(r.window_minutes or self.window_minutes, r.novelty_lookback_days, r.baseline_lookback_days, r.warmup_days, r.min_support, r.log2_threshold, r.group_by_port, r.group_by_protocol)


def expand_env(value: object) -> object:
    """${NAME} from the environment, everywhere; unset names are refused."""
    if isinstance(value, dict):
        return {k: expand_env(v) for k, v in value.items()}
    if isinstance(value, list):
        return [expand_env(v) for v in value]
    if not isinstance(value, str):
        return value

    def put(m: re.Match) -> str:
        if m[1] not in os.environ:
            raise ConfigError(f"environment variable {m[1]} isn't set")
        return os.environ[m[1]]

    return re.sub(r"\$\{(\w+)\}", put, value)


def load_config(path: str, overrides: dict | None = None) -> Config:
    """Settings of a file; relative paths hang on the file's folder."""
    data = expand_env(yaml.safe_load(Path(path).read_text()) or {}) | (overrides or {})
    base = Path(path).resolve().parent
    at = lambda p: str(p if Path(p).is_absolute() else base / p)
    data["inputs"] = [at(p) for p in data.get("inputs", [])]
    for key in ("output", "annotations", "contract"):
        if data.get(key):
            data[key] = at(data[key])
    return Config(**data)


def _instant(value: object, end: bool) -> datetime:
    if isinstance(value, datetime):
        return value.replace(tzinfo=None) if value.tzinfo is None else (value - value.utcoffset()).replace(tzinfo=None)
    if isinstance(value, date):
        return datetime.combine(value, time()) + timedelta(days=end)
    raise ConfigError(f"not a date: {value!r}")


def load_annotations(path: str) -> list[Annotation]:
    """Intervals of a YAML file: a date is a whole day (end inclusive), a date with time is exact (end exclusive); names are unique."""
    rows = (yaml.safe_load(Path(path).read_text()) or {}).get("intervals", [])
    out = [Annotation(r["name"], _instant(r["start"], False), _instant(r["end"], True), *(str(r.get(k, "")) for k in ("source", "notes", "confidence"))) for r in rows]
    if len({a.name for a in out}) != len(out):
        raise ConfigError("annotation names must be unique")
    if bad := [a.name for a in out if a.start >= a.end]:
        raise ConfigError(f"empty intervals: {bad}")
    return out
