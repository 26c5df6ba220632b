"""Display metadata of a node: name, units, colour limits and the legend of enumerated values."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass
class Style:
    name: str | None = None
    units: str | None = None
    clim: tuple[float | None, float | None] = (None, None)
    colormap: str | None = None
    enumeration_legend: dict[int, str] = field(default_factory=dict)
    enumeration_colors: dict[int, str] = field(default_factory=dict)
    default_enumeration_legend: str = "unknown"

    def __post_init__(self) -> None:
        if self.enumeration_colors and set(self.enumeration_legend) - set(self.enumeration_colors):
            raise ValueError("every value of the legend needs a colour")

    @property
    def json(self) -> str:
        return json.dumps({k: v for k, v in asdict(self).items() if v}, separators=(",", ":"))

    @classmethod
    def from_json(cls, text: str) -> Style:
        d = json.loads(text)
        for k in ("enumeration_legend", "enumeration_colors"):
            if k in d:
                d[k] = {int(a): b for a, b in d[k].items()}
        return cls(**(d | ({"clim": tuple(d["clim"])} if "clim" in d else {})))

    def label(self, value: Column) -> Column:
        """The legend's text for a value."""
        out = F.lit(self.default_enumeration_legend)
        for k, text in self.enumeration_legend.items():
            out = F.when(value == k, text).otherwise(out)
        return out
