"""Feature specifications, naming and column roles."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any


@dataclass(frozen=True)
class FeatureSpec:
    """One feature: a registered function, the columns it reads, parameters.

    ``cols`` follow the reference convention: for most group functions the
    last column is the measured one and the others are the group keys; for
    time functions the last column is the time.
    """
    function: str
    cols: tuple[str, ...]
    params: tuple[tuple[str, Any], ...] = ()
    name: str | None = None

    @staticmethod
    def of(function: str, cols, params: dict | None = None, name: str | None = None) -> "FeatureSpec":
        return FeatureSpec(function, tuple(cols), tuple(sorted((params or {}).items())), name)

    @property
    def p(self) -> dict:
        return dict(self.params)

    @property
    def feature_name(self) -> str:
        return self.name or feature_name(self.function, self.cols, self.p)


def feature_name(function: str, cols, params: dict | None = None) -> str:
    """Deterministic name ``function__col1_col2__k1_v1`` (stable across runs, so
    a stored feature can be found again by its spec)."""
    base = f"{function}__{'_'.join(cols)}"
    if params:
        base += "__" + "_".join(f"{k}_{v}" for k, v in sorted(params.items()))
    return base.replace(".", "p").replace("-", "m")


@dataclass
class Roles:
    """What each column is: the row id, label, categoricals, ignored columns,
    and the train/test split column."""
    id: str
    label: str | None = None
    categorical: list[str] = field(default_factory=list)
    ignore: list[str] = field(default_factory=list)
    split: str = "split"

    def features(self, columns) -> list[str]:
        skip = {self.id, self.label, self.split, *self.ignore}
        return [c for c in columns if c not in skip]
