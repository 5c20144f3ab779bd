"""Catalogs of ready features. Each catalog maps a name to a feature over bar columns."""

from quantloom.plans.catalog.alpha101 import alpha101
from quantloom.plans.catalog.alpha158 import alpha158
from quantloom.plans.catalog.alpha191 import alpha191
from quantloom.plans.catalog.simple import basic, industry

CATALOGS = {"alpha101": alpha101, "alpha191": alpha191, "alpha158": alpha158, "basic": basic,
            "industry": industry}

__all__ = ["CATALOGS", "alpha101", "alpha158", "alpha191", "basic", "industry"]
