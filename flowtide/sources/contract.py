"""The contract of a raw export: what its columns are called, hold, and may be used for; read from YAML."""

from __future__ import annotations

from collections.abc import Iterable
from pathlib import Path
from typing import Literal

import yaml
from pydantic import BaseModel, ConfigDict, model_validator
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The contract that comes with the package.
DEFAULT = Path(__file__).parent / "contracts" / "flow_export.yaml"


class ColumnContract(BaseModel):
    """A raw column. ``confirmed`` is for meanings that the exporter's documentation states."""

    model_config = ConfigDict(extra="forbid")
    raw: str
    name: str
    type: str
    use: Literal["entity", "feature", "derive", "provenance", "exclude"]
    confidence: Literal["high", "medium", "low", "unknown"]
    meaning: str
    confirmed: bool = False

    @model_validator(mode="after")
    def _sure_enough(self) -> ColumnContract:
        if self.use == "feature" and self.confidence not in ("high", "medium"):
            raise ValueError(f"{self.raw}: a column of {self.confidence} confidence can't be a feature")
        return self


class Contract(BaseModel):
    """All columns of an export, in order; names are unique."""

    model_config = ConfigDict(extra="forbid")
    version: int
    name: str
    columns: list[ColumnContract]

    @model_validator(mode="after")
    def _unique(self) -> Contract:
        for kind in ("raw", "name"):
            names = [getattr(c, kind) for c in self.columns]
            if twice := sorted({n for n in names if names.count(n) > 1}):
                raise ValueError(f"{kind} names stand twice: {twice}")
        return self

    def field_map(self, names: Iterable[str]) -> dict[str, str]:
        """The raw column of each of these canonical names that the contract has."""
        raw = {c.name: c.raw for c in self.columns}
        return {n: raw[n] for n in names if n in raw}

    def compare(self, found: Iterable[str]) -> tuple[list[str], list[str]]:
        """Columns that a file lacks, and columns that the contract doesn't know."""
        expected, present = {c.raw for c in self.columns}, set(found)
        return sorted(expected - present), sorted(present - expected)

    def project(self, raw: DataFrame) -> DataFrame:
        """All columns under canonical names and types; a value that doesn't fit its type is null, as is a column that isn't there."""
        there = set(raw.columns)
        return raw.select(*[(F.col(f"`{c.raw}`") if c.raw in there else F.lit(None)).try_cast(c.type).alias(c.name) for c in self.columns])

    def to_markdown(self) -> str:
        """The reference of the columns."""
        plain = lambda s: s.replace("|", "\\|")
        rows = [f"| `{c.raw}` | `{c.name}` | {c.type} | {c.use} | {c.confidence} | {'yes' if c.confirmed else 'no'} | {plain(c.meaning)} |" for c in self.columns]
        sure = sum(c.confirmed for c in self.columns)
        head = [f"# Columns of {self.name}, version {self.version}", "", f"{sure} of {len(self.columns)} meanings are confirmed; the others are read off the names.", ""]
        return "\n".join([*head, "| raw | canonical | type | use | confidence | confirmed | meaning |", "|---|---|---|---|---|---|---|", *rows])


def load_contract(path: str | Path | None = None) -> Contract:
    """The contract of a file, or the one that comes with the package."""
    return Contract.model_validate(yaml.safe_load(Path(path or DEFAULT).read_text()))
