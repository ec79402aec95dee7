"""What a panel looks like: resolved from the schema on the driver, without a job."""

from __future__ import annotations

import json
import re
from dataclasses import asdict, dataclass, field

from pyspark.sql.types import NumericType, StringType, StructType

from cohortlens import constants as C

_YEAR_SUFFIX = re.compile(r"^(?P<stem>.+)_(?P<year>\d{4})$")


def split_year(name: str, year_range=C.YEAR_RANGE) -> tuple[str, int] | None:
    """('INDE', 2022) for 'INDE_2022'.

    None without a year suffix, and for derived names that carry two years.
    """
    match = _YEAR_SUFFIX.match(name)
    if not match or not year_range[0] <= int(match["year"]) <= year_range[1]:
        return None
    stem = match["stem"]
    inner = _YEAR_SUFFIX.match(stem)
    if inner and year_range[0] <= int(inner["year"]) <= year_range[1]:
        return None
    return stem, int(match["year"])


@dataclass(frozen=True)
class Feature:
    """One derived column. `kind` picks the formula, `inputs` its columns, `params` its constants."""

    name: str
    kind: str
    inputs: tuple[str, ...]
    params: tuple[float, ...] = ()


@dataclass(frozen=True)
class PanelSpec:
    """Key, years and column roles of a wide panel."""

    key: str
    years: tuple[int, ...]
    numeric: tuple[str, ...] = ()
    text: tuple[str, ...] = ()
    indicators: tuple[str, ...] = C.SCORE_INDICATORS
    target: str = C.TARGET
    identifiers: tuple[str, ...] = C.IDENTIFIER_NAMES
    leakage: tuple[str, ...] = C.LEAKAGE_NAMES
    ordinal_stem: str = C.ORDINAL
    ordinal_levels: dict = field(default_factory=lambda: dict(C.ORDINAL_LEVELS))
    target_mode: str = "negative_is_risk"
    leakage_match: str = "token"

    @classmethod
    def from_schema(cls, schema: StructType, key: str, year_range=C.YEAR_RANGE, **roles) -> "PanelSpec":
        found = [split_year(f.name, year_range) for f in schema.fields]
        return cls(
            key=key,
            years=tuple(sorted({hit[1] for hit in found if hit})),
            numeric=tuple(f.name for f in schema.fields if isinstance(f.dataType, NumericType)),
            text=tuple(f.name for f in schema.fields if isinstance(f.dataType, StringType)),
            **roles,
        )

    @property
    def latest_year(self) -> int:
        if not self.years:
            raise ValueError("no column ends in a year")
        return self.years[-1]

    def to_json(self) -> str:
        return json.dumps(asdict(self), ensure_ascii=False)

    @classmethod
    def from_json(cls, text: str) -> "PanelSpec":
        values = json.loads(text)
        return cls(**{k: tuple(v) if isinstance(v, list) else v for k, v in values.items()})
