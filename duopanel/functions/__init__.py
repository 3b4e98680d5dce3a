"""Column functions that several operators share."""

from ..operators.blm import log_density
from ..operators.moments import weighted_mean
from ..operators.panel import round_to

__all__ = ["log_density", "round_to", "weighted_mean"]
