"""Common behaviour of constraints and the chains that apply several of them."""

from __future__ import annotations

import importlib
import warnings

from pyspark.sql import Column, DataFrame, functions as F

from ...errors import MissingConstraintColumnError

HANDLING = ("transform", "reject_sampling", "all")


def resolve(target):
    """A callable, or the object behind a dotted path."""
    if isinstance(target, str):
        module, _, name = target.rpartition(".")
        return getattr(importlib.import_module(module), name)
    return target


def free_name(parts: list[str], taken) -> str:
    """Join ``parts`` with as many ``#`` as it takes to get a new column name (without dots)."""
    token = "#"
    parts = [p.replace(".", "_") for p in parts]
    while token.join(parts) in taken:
        token += "#"
    return token.join(parts)


class Constraint:
    """Base class. Subclasses are known by their name, also those of users.

    ``handling='transform'`` encodes the rule away and rebuilds it, so nothing is filtered;
    ``'reject_sampling'`` only filters; ``'all'`` does both.
    """

    registry: dict[str, type] = {}
    columns: tuple[str, ...] = ()
    rebuilds: tuple[str, ...] = ()
    row_local = True
    model = None
    learned: tuple[str, ...] = ()  # attributes set by fitting, saved with a profile

    def __init_subclass__(cls, **kwargs):
        super().__init_subclass__(**kwargs)
        Constraint.registry[cls.__name__] = cls

    def __new__(cls, *args, **kwargs):
        made = super().__new__(cls)
        made._arguments = (args, kwargs)
        return made

    def __init__(self, handling: str = "transform", fit_columns_model: bool = False):
        if handling not in HANDLING:
            raise ValueError(f"handling must be one of {HANDLING}, not {handling!r}")
        self.handling = handling
        self.fit_columns_model = fit_columns_model
        if handling == "reject_sampling":
            self.rebuilds = ()

    # -- learning ------------------------------------------------------------------
    def fit(self, df: DataFrame) -> Constraint:
        self._fit(df)
        if self.fit_columns_model and len(self.columns) > 1:
            from ..copula import Copula

            self.model = Copula.fit(df, list(self.columns))
        return self

    def _fit(self, df: DataFrame) -> None:
        """Learn what is needed; most constraints only look at the schema."""

    # -- checking ------------------------------------------------------------------
    def valid(self, df: DataFrame) -> Column:
        """Boolean column, never null, of a constraint that looks at one row at a time."""
        return F.lit(True)

    def flag(self, df: DataFrame, name: str = "is_valid") -> DataFrame:
        """``df`` with the verdict on every row in column ``name``."""
        return df.withColumn(name, self.valid(df))

    def count_invalid(self, df: DataFrame) -> DataFrame:
        """One row (invalid): how many rows break the constraint."""
        return df.agg(F.count_if(~self.valid(df)).alias("invalid"))

    def _keep(self, df: DataFrame) -> DataFrame:
        return df.filter(self.valid(df))

    def filter_valid(self, df: DataFrame) -> DataFrame:
        return df if self.handling == "transform" else self._keep(df)

    def applies_to(self, df: DataFrame) -> bool:
        return set(self.columns) <= set(df.columns)

    # -- encoding ------------------------------------------------------------------
    def _transform(self, df: DataFrame) -> DataFrame:
        return df

    def _reverse(self, df: DataFrame) -> DataFrame:
        return df

    def transform(self, df: DataFrame) -> DataFrame:
        if self.handling == "reject_sampling":
            return df
        return self._transform(self._with_columns(df))

    def _with_columns(self, df: DataFrame) -> DataFrame:
        missing = [c for c in self.columns if c not in df.columns]
        if not missing:
            return df
        if self.model is None:
            warnings.warn(
                "conditions name only some columns of a constraint without a column model; "
                "rows will be found by rejection, which can be slow",
                UserWarning,
                stacklevel=3,
            )
        if self.model is None or len(missing) == len(self.columns):
            raise MissingConstraintColumnError(f"missing columns {missing}")
        return self.complete(df)

    def complete(self, df: DataFrame) -> DataFrame:
        """Fill the missing columns of partial conditions from the column model."""
        from ..copula import complete_conditions

        return complete_conditions(df, self)

    def reverse(self, df: DataFrame) -> DataFrame:
        return df if self.handling == "reject_sampling" else self._reverse(df)

    # -- description ---------------------------------------------------------------
    @classmethod
    def from_dict(cls, data: dict) -> Constraint:
        """``{"constraint": name or dotted path, ...constructor arguments}``."""
        data = dict(data)
        name = data.pop("constraint")
        made = resolve(name) if "." in name else cls.registry[name]
        return made(**data)

    def to_dict(self) -> dict:
        import inspect

        args, kwargs = self._arguments
        given = inspect.signature(type(self).__init__).bind(self, *args, **kwargs).arguments
        return {"constraint": type(self).__name__, **{k: v for k, v in given.items() if k != "self"}}


def prepare(constraints) -> list[Constraint]:
    """Order constraints: those that rebuild nothing first, then the rebuilding ones.

    Two constraints must not both change a column that one of them rebuilds.
    """
    made = []
    for c in constraints or []:
        made.append(Constraint.from_dict(c) if isinstance(c, dict) else c() if isinstance(c, type) else c)
    checks = [c for c in made if not c.rebuilds]
    rebuilding = [c for c in made if c.rebuilds]
    taken: set[str] = set()
    for c in rebuilding:
        both = taken & set(c.columns)
        if both:
            raise ValueError(
                f"two constraints change the columns {sorted(both)}; "
                'use "reject_sampling" for one of them'
            )
        taken.update(c.rebuilds)
    return checks + rebuilding


def filter_valid(df: DataFrame, constraints) -> DataFrame:
    """Apply the filters one after the other; the order matters once Unique takes part."""
    for c in [constraints] if isinstance(constraints, Constraint) else constraints:
        df = c.filter_valid(df)
    return df


def transform_all(df: DataFrame, constraints, on_missing: str = "error") -> DataFrame:
    """Encode all constraints in order. ``on_missing='drop'`` gives up the columns of a
    constraint that cannot be applied because some of them are absent."""
    if on_missing not in ("error", "drop"):
        raise ValueError("on_missing must be 'drop' or 'error'")
    for c in constraints:
        try:
            df = c.transform(df)
        except MissingConstraintColumnError:
            if on_missing == "error":
                raise
            df = df.drop(*[n for n in df.columns if n in c.columns])
    return df


def reverse_all(df: DataFrame, constraints) -> DataFrame:
    """Rebuild in the opposite order of encoding."""
    for c in reversed(list(constraints)):
        df = c.reverse(df)
    return df
