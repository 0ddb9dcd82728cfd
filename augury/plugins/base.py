"""The plugin contract, a registry, and discovery by entry point."""

from __future__ import annotations

from abc import ABC, abstractmethod
from importlib.metadata import entry_points

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from augury.config import logger
from augury.operators.markets import training_rows

GROUP = "augury.plugins"


class MarketPlugin(ABC):
    """A family of markets.  Everything is set-based: tables in, tables out."""

    family: str = ""

    @abstractmethod
    def discover_markets(self, raw: DataFrame) -> DataFrame:
        """Specs of the raw listings that belong to the family."""

    @abstractmethod
    def fetch_features(self, specs: DataFrame, horizon: str) -> DataFrame:
        """market_id and numbers."""

    @abstractmethod
    def fetch_truth(self, specs: DataFrame) -> DataFrame:
        """market_id, truth_value, truth_label; null where not known."""

    def build_training_rows(self, specs: DataFrame, horizon: str) -> DataFrame:
        return training_rows(specs, self.fetch_truth(specs), self.fetch_features(specs, horizon), horizon)

    def is_truth_final(self, specs: DataFrame) -> DataFrame:
        """The truth with is_final: by default, final once there is one."""
        return self.fetch_truth(specs).withColumn("is_final", F.col("truth_value").isNotNull() | F.col("truth_label").isNotNull())


class PluginRegistry:
    def __init__(self):
        self._plugins: dict[str, MarketPlugin] = {}

    def register(self, plugin: MarketPlugin) -> None:
        if plugin.family in self._plugins:
            raise ValueError(f"family {plugin.family!r} is registered already")
        self._plugins[plugin.family] = plugin

    def get(self, family: str) -> MarketPlugin:
        if family not in self._plugins:
            raise KeyError(f"no plugin {family!r}; there are {self.list_families()}")
        return self._plugins[family]

    def list_families(self) -> list[str]:
        return sorted(self._plugins)

    def unregister(self, family: str) -> None:
        self._plugins.pop(family, None)


def discover_plugins(group: str = GROUP) -> dict[str, type[MarketPlugin]]:
    """Plugin classes by entry-point name; those that fail to load or are no plugins are logged and left out."""
    out = {}
    for point in entry_points(group=group):
        try:
            found = point.load()
        except Exception as e:  # a foreign package may fail in any way
            logger("plugins").warning("plugin %s does not load: %s", point.name, e)
            continue
        if not (isinstance(found, type) and issubclass(found, MarketPlugin)):
            logger("plugins").warning("plugin %s is no MarketPlugin", point.name)
            continue
        out[point.name] = found
    return out


def load_entry_points(registry: PluginRegistry, group: str = GROUP) -> list[str]:
    """Register what discovery finds; returns the families added."""
    added = []
    for name, kind in discover_plugins(group).items():
        try:
            plugin = kind()
            registry.register(plugin)
        except Exception as e:
            logger("plugins").warning("plugin %s is left out: %s", name, e)
            continue
        added.append(plugin.family)
    return added
