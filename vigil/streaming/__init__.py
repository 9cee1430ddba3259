"""Structured Streaming forms of the operators whose reference behaviour is
incremental (polling, cursors, timers): file-source streams with a
checkpoint replace cursors; watermarks bound state; stateful rules keep
per-key state with ``applyInPandasWithState``."""
