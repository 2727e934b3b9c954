"""Where rows go: five write modes over files, memory, SQL databases and the console."""

from weftline.sinks.modes import MERGES, apply_mode
from weftline.sinks.stores import register_sink, write

__all__ = ["MERGES", "apply_mode", "register_sink", "write"]
