"""Column expressions used across the operators (all JVM-side, inside whole-stage codegen)."""

from carelens.functions.scalar import (  # noqa: F401
    decayed_weight, dot, labelled, log_credibility, presence_flag, sqrt_credibility,
)
