"""Declarative row and table constraints: check, filter, encode away, rebuild."""

from .base import Constraint, filter_valid, prepare, reverse_all, transform_all
from .combinations import UniqueCombinations
from .custom import ColumnFormula, Custom
from .onehot import OneHot
from .ranges import Between, GreaterThan, Negative, Positive
from .rounding import Rounding
from .unique import Unique

__all__ = [
    "Between", "ColumnFormula", "Constraint", "Custom", "GreaterThan", "Negative", "OneHot", "Positive",
    "Rounding", "Unique", "UniqueCombinations", "filter_valid", "prepare", "reverse_all", "transform_all",
]
