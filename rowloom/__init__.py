"""Learn the shape of a table on Spark and generate realistic rows of the same shape."""

import sys

from pyspark import cloudpickle

from .errors import ConstraintsNotMetError, MetadataError, MetadataNotFittedError, MissingConstraintColumnError, NotFittedError
from .operators.constraints import (
    Between, ColumnFormula, Constraint, Custom, GreaterThan, Negative, OneHot, Positive, Rounding, Unique, UniqueCombinations,
)
from .operators.release import Ledger, Private
from .plans import Profile, Synthesizer
from .spec import DatasetSpec, FieldSpec, TableSpec, project

# the few functions that run in Python workers travel with their code, so that the executors
# do not need this package installed
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__all__ = [
    "Between", "ColumnFormula", "Constraint", "ConstraintsNotMetError", "Custom", "DatasetSpec", "FieldSpec", "GreaterThan",
    "Ledger", "MetadataError", "MetadataNotFittedError", "MissingConstraintColumnError", "Negative", "NotFittedError", "OneHot",
    "Positive", "Private", "Profile", "Rounding", "Synthesizer", "TableSpec", "Unique", "UniqueCombinations", "project",
]
