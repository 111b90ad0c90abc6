"""The annotated matrix as long DataFrames."""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from functools import cached_property
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class AnnFrame:
    """obs (obs_id, ...), var (var_id, ...), x (obs_id, var_id, value); implicit zeros count.

    layers hold other x, raw a pair (x, var), obsm vectors (obs_id, vec), varm (var_id, vec), obsp edges (src, dst,
    weight), uns small results and parameters. Frames are immutable: every function returns a new one.
    """

    obs: DataFrame
    var: DataFrame
    x: DataFrame
    layers: dict[str, DataFrame] = field(default_factory=dict)
    raw: tuple[DataFrame, DataFrame] | None = None
    obsm: dict[str, DataFrame] = field(default_factory=dict)
    varm: dict[str, DataFrame] = field(default_factory=dict)
    obsp: dict[str, DataFrame] = field(default_factory=dict)
    uns: dict[str, Any] = field(default_factory=dict)

    @cached_property
    def n_obs(self) -> int:
        return self.obs.count()

    @cached_property
    def n_vars(self) -> int:
        return self.var.count()

    def matrix(self, layer: str | None = None) -> DataFrame:
        """x or a layer; an unknown layer raises KeyError."""
        return self.x if layer is None else self.layers[layer]

    def expression(self, layer: str | None = None, use_raw: bool | None = None) -> tuple[DataFrame, DataFrame]:
        """(x, var) that marker statistics use: raw where it exists, no layer is named and use_raw is not False."""
        if use_raw and (layer is not None or self.raw is None):
            raise ValueError("use_raw needs raw, and no layer")
        if layer is None and use_raw is not False and self.raw is not None:
            return self.raw
        return self.matrix(layer), self.var

    def with_x(self, x: DataFrame, layer: str | None = None) -> AnnFrame:
        return replace(self, x=x) if layer is None else replace(self, layers=self.layers | {layer: x})

    def with_obs_cols(self, cols: DataFrame) -> AnnFrame:
        """Columns of cols (obs_id, ...) joined to obs; those that obs has already are replaced."""
        return replace(self, obs=_joined(self.obs, cols, "obs_id"))

    def with_var_cols(self, cols: DataFrame) -> AnnFrame:
        return replace(self, var=_joined(self.var, cols, "var_id"))

    def with_obsm(self, key: str, df: DataFrame) -> AnnFrame:
        return replace(self, obsm=self.obsm | {key: df})

    def with_varm(self, key: str, df: DataFrame) -> AnnFrame:
        return replace(self, varm=self.varm | {key: df})

    def with_obsp(self, key: str, df: DataFrame) -> AnnFrame:
        return replace(self, obsp=self.obsp | {key: df})

    def with_uns(self, **values: Any) -> AnnFrame:
        return replace(self, uns=self.uns | values)

    def with_raw(self) -> AnnFrame:
        return replace(self, raw=(self.x, self.var))

    def _without(self, side: str, column: str) -> AnnFrame:
        return replace(self, **{side: getattr(self, side).drop(column)})

    def where_obs(self, condition: Column | str) -> AnnFrame:
        """Rows that meet the condition, in every slot."""
        obs = self.obs.where(condition)
        ids = obs.select("obs_id")
        keep = lambda df: df.join(ids, "obs_id", "left_semi")
        edge = lambda df: df.join(ids.toDF("src"), "src", "left_semi").join(ids.toDF("dst"), "dst", "left_semi").select(*df.columns)
        return replace(self, obs=obs, x=keep(self.x), layers={k: keep(v) for k, v in self.layers.items()}, obsm={k: keep(v) for k, v in self.obsm.items()}, obsp={k: edge(v) for k, v in self.obsp.items()}, raw=(keep(self.raw[0]), self.raw[1]) if self.raw else None)

    def where_var(self, condition: Column | str) -> AnnFrame:
        var = self.var.where(condition)
        ids = var.select("var_id")
        keep = lambda df: df.join(ids, "var_id", "left_semi")
        return replace(self, var=var, x=keep(self.x), layers={k: keep(v) for k, v in self.layers.items()}, varm={k: keep(v) for k, v in self.varm.items()})


def _joined(side: DataFrame, cols: DataFrame, key: str) -> DataFrame:
    new = [c for c in cols.columns if c != key]
    return side.drop(*new).join(cols, key, "left")


def value_matrix(obs: DataFrame, var: DataFrame, x: DataFrame) -> AnnFrame:
    """AnnFrame of the non-zero entries; repeated (obs_id, var_id) are summed."""
    total = x.groupBy("obs_id", "var_id").agg(F.sum("value").cast("double").alias("value")).filter("value <> 0")
    return AnnFrame(obs, var, total)
