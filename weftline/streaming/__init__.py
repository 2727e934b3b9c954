"""Jobs over streams."""

from weftline.streaming.runner import StateTable, run_stream, tumbling

__all__ = ["StateTable", "run_stream", "tumbling"]
