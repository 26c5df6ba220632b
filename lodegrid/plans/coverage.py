"""A coverage: a table long by cell and wide by output.

Columns are the dimensions (DOUBLE or TIMESTAMP, never null, unique together) and one DOUBLE for each
output ("value" if there is one). Missing data is NULL: NaN is turned into NULL where data come in and
back only where they leave. Metadata (units, CRS, style, bounds) ride beside the table.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def clean(value: Column) -> Column:
    """DOUBLE with NaN as NULL."""
    v = value.cast("double")
    return F.when(F.isnan(v), None).otherwise(v)


@dataclass(frozen=True)
class Coverage:
    df: DataFrame
    dims: tuple[str, ...]
    outputs: tuple[str, ...] = ("value",)
    attrs: dict = field(default_factory=dict)

    @classmethod
    def of(cls, df: DataFrame, dims: list[str], outputs: list[str] | None = None, nan_vals: list[float] | None = None, **attrs: object) -> Coverage:
        """Adopt a table: picks the columns, turns NaN and ``nan_vals`` into NULL, drops rows without a key."""
        outputs = outputs or [c for c in df.columns if c not in dims]
        if not outputs:
            raise ValueError("no data columns found")
        bad = lambda v: F.when(v.isin([float(x) for x in nan_vals]), None).otherwise(v) if nan_vals else v
        keyed = df
        for d in dims:
            keyed = keyed.where(F.col(d).isNotNull())
        return cls(keyed.select(*dims, *(bad(clean(F.col(o))).alias(o) for o in outputs)), tuple(dims), tuple(outputs), attrs)

    def with_df(self, df: DataFrame, dims: list[str] | None = None, outputs: list[str] | None = None) -> Coverage:
        return replace(self, df=df, dims=tuple(dims if dims is not None else self.dims), outputs=tuple(outputs or self.outputs))

    def select(self, output: str) -> Coverage:
        """One output, as "value"."""
        if output not in self.outputs:
            raise ValueError(f"no output {output!r} among {self.outputs}")
        return self.with_df(self.df.select(*self.dims, F.col(output).alias("value")), outputs=["value"])

    def mapped(self, f) -> Coverage:
        """Each output through ``f`` (Column to Column)."""
        return self.with_df(self.df.select(*self.dims, *(f(F.col(o)).alias(o) for o in self.outputs)))

    def __getitem__(self, key: Coverage | str) -> Coverage:
        """An output by name, or the cells at the labels of one dimension where ``key``'s value is true (neither missing nor 0)."""
        if isinstance(key, str):
            return self.select(key)
        shared = [d for d in key.dims if d in self.dims]
        if len(key.dims) != 1 or not shared:
            raise ValueError("a labelled key has one dimension, which the data share")
        labels = key.df.where(F.col(key.outputs[0]) != 0).select(*shared)
        return self.with_df(self.df.join(labels, shared, "left_semi").select(*self.dims, *self.outputs))

    def renamed(self, names: dict[str, str]) -> Coverage:
        return self.with_df(self.df.withColumnsRenamed(names), outputs=[names.get(o, o) for o in self.outputs])

    def within(self, bounds: dict[str, list]) -> Coverage:
        """Raw selection by bounds; the filters are literals, so they reach Parquet's row groups."""
        from lodegrid.plans.coordinates import literal

        df = self.df
        for d, (lo, hi) in bounds.items():
            if d in self.dims:
                df = df.where((F.col(d) >= literal(lo)) & (F.col(d) <= literal(hi)))
        return self.with_df(df)

    def transpose(self, *dims: str) -> Coverage:
        """Named dimensions first; order is presentation only."""
        order = [*dims, *(d for d in self.dims if d not in dims)]
        return self.with_df(self.df.select(*order, *self.outputs), dims=order)

    @property
    def units(self) -> str | None:
        return self.attrs.get("units")

    def with_attrs(self, **attrs: object) -> Coverage:
        return replace(self, attrs=self.attrs | attrs)
