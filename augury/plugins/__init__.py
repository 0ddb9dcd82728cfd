"""Market families as plugins: how to find, describe, and resolve their markets."""

from augury.plugins.base import MarketPlugin, PluginRegistry, discover_plugins, load_entry_points
from augury.plugins.families import RacePlugin, TemperaturePlugin

__all__ = ["MarketPlugin", "PluginRegistry", "RacePlugin", "TemperaturePlugin", "discover_plugins", "load_entry_points"]
