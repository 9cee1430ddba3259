"""Column-expression helpers (JVM-side built-ins only, codegen friendly)."""

from .common import *  # noqa: F401,F403
