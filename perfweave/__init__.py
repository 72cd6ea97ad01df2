"""Server performance-log analytics as Spark jobs."""

from perfweave.config import DEFAULT_CONFIG, EngineConfig, TimeWindow
from perfweave.tables import LogTables

__all__ = ["DEFAULT_CONFIG", "EngineConfig", "LogTables", "TimeWindow"]
