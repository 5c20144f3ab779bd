"""quantloom: panel analytics (many symbols x dates) written for Spark DataFrames."""

from quantloom.plans.panel import with_features
from quantloom.functions.feature import Feature, col, lit

__all__ = ["Feature", "col", "lit", "with_features"]
