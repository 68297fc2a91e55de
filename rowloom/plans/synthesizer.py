"""Learn one table and generate rows like it, for seen labels, unseen labels or conditions."""

from __future__ import annotations

import warnings
from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from ..errors import ConstraintsNotMetError, NotFittedError
from ..operators.anonymize import anonymize, learn_maps, make_ids, make_ids_unique, new_salt
from ..operators.constraints import Constraint, Unique, prepare, transform_all
from ..operators.copula import Copula, _Dim
from ..operators.encoders import Numeric
from ..operators.factors import FactorModel
from ..operators.generate import Model, finalize, fit_model, generate, ids_only
from ..operators.guided import KNOWN, ConditionIndex, known_values
from ..operators.joins import lookup
from ..operators.labels import label_quota, mixed_weights, nearest_labels
from ..operators.mixture import Mixture
from ..operators.rejection import (
    FLOAT_RTOL,
    MAX_RETRIES,
    MAX_ROWS_MULTIPLIER,
    make_conditions,
    sample_conditional,
    sample_valid,
)
from ..operators.release import Ledger, Private, fit_private_model
from ..operators.summary import BROKEN, write_observed
from ..operators.validate import assert_constraints
from ..session import materialize
from ..sources import profiles
from ..spec import FieldSpec, TableSpec, project


class Synthesizer:
    """What to learn: the table's description, its label column and the label embeddings."""

    def __init__(self, label_col: str, spec: TableSpec | None = None, embeddings: DataFrame | None = None, field_names=None,
                 field_types=None, anonymize_fields=None, primary_key=None, constraints=None, rounding="auto",
                 min_value="auto", max_value="auto", private: Private | None = None):
        others = (field_names, field_types, anonymize_fields, primary_key, constraints)
        if spec is not None and any(o is not None for o in others):
            raise ValueError("a given spec excludes the other descriptions of the table")
        self.label_col, self.spec, self.embeddings = label_col, spec, embeddings
        self.inferred = dict(field_names=field_names, field_types=field_types, anonymize=anonymize_fields, primary_key=primary_key)
        self.constraints = constraints if spec is None else spec.constraints
        self.limits = (rounding, min_value, max_value)
        self.private = private

    def fit(self, df: DataFrame) -> Profile:
        if self.private is not None:
            return self._fit_private(df)
        spec = self.spec or TableSpec.infer(df, **self.inferred)
        constraints = prepare(self.constraints)
        types = {f.name: df.schema[f.name].dataType for f in spec.fields if f.name in df.columns}
        maps = learn_maps(df, spec, new_salt())
        rows = anonymize(project(df, spec), maps)
        if not rows.columns:
            return Profile(spec, self.label_col, constraints, None, {}, types, df.count(), self.embeddings)
        local = {f"{i}:{type(c).__name__}": c for i, c in enumerate(constraints) if c.row_local and c.applies_to(rows)}
        assert_constraints(rows, [c for c in constraints if not c.row_local])
        rows = rows.withColumns({BROKEN + n: ~c.valid(rows) for n, c in local.items()}) if local else rows
        for c in constraints:
            rows = c.fit(rows).transform(rows)
        hidden = [f.name for f in spec.fields if f.pii and f.type != "id"]
        rows = rows.drop(*[h for h in hidden if h != self.label_col])
        known = {f.name: {"type": f.type, "subtype": f.subtype} for f in spec.fields if f.name in rows.columns}
        rows, seen = write_observed(rows, known, "learned-rows")
        bad = seen.broken()
        if bad:
            raise ConstraintsNotMetError(f"rows break the constraints: {bad}", bad)
        columns = [c for c in rows.columns if c != self.label_col and seen.discrete(c)]
        continuous = [c for c in rows.columns if c != self.label_col and c not in columns]
        model = fit_model(rows, self.label_col, columns, continuous, ranges={c: seen.range(c) for c in continuous})
        numbers = {}
        for c in continuous:
            if c in spec and isinstance(rows.schema[c].dataType, T.NumericType):
                numbers[c] = Numeric(*self.limits).bind(rows, c)
                numbers[c].learn(seen.numeric(c))
        return Profile(spec, self.label_col, constraints, model, numbers, types, seen.rows, self.embeddings)

    def _fit_private(self, df: DataFrame) -> Profile:
        """Learn from released tables only: no constraint, limit, row count or value list is read off the rows.

        Rows that break a constraint are left out.
        """
        how, constraints = self.private, prepare(self.constraints)
        for c in constraints:
            if c.fit_columns_model or not (c.row_local or isinstance(c, Unique)):
                raise ValueError(f"{type(c).__name__} learns from rows and cannot be part of a private profile")
        learned = {self.label_col, *how.domain, *how.bounds}
        named = [c for c in df.columns if c in learned or any(c in k.columns for k in constraints)]
        spec = self.spec or TableSpec.infer(df.select(*[F.col(f"`{c}`") for c in named]), **self.inferred)
        rows = df
        for c in constraints:
            rows = c.fit(rows)._keep(rows) if c.row_local else rows
            rows = c.transform(rows)
        unknown = learned - set(rows.columns)
        if unknown:
            raise ValueError(f"no columns {sorted(unknown)}")
        left = [f.name for f in spec.fields if f.type != "id" and not f.pii and f.name in rows.columns and f.name not in learned]
        if left:
            raise ValueError(f"neither public values nor bounds are given for {left}")
        types = {f.name: df.schema[f.name].dataType for f in spec.fields if f.name in df.columns}
        model, ledger = fit_private_model(rows, self.label_col, how)
        numbers = {}
        for c, (low, high) in how.bounds.items():
            if isinstance(rows.schema[c].dataType, T.NumericType):
                e = Numeric()
                e.name, e.type, e.mean, e.low, e.high, e.digits = c, rows.schema[c].dataType, (low + high) / 2, low, high, None
                numbers[c] = e
        n = model.counts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
        return Profile(spec, self.label_col, constraints, model, numbers, types, n, self.embeddings, ledger)


@dataclass
class Profile:
    """Everything learned from a table; open tables and a few numbers."""

    spec: TableSpec
    label: str
    constraints: list[Constraint]
    model: Model | None
    numbers: dict[str, Numeric]
    types: dict[str, T.DataType]
    rows: int
    embeddings: DataFrame | None = None
    ledger: Ledger | None = None
    _mixed: dict = field(default_factory=dict)

    @property
    def epsilon(self) -> float | None:
        """Privacy loss of everything learned; None if it was not learned privately."""
        return None if self.ledger is None else self.ledger.epsilon

    # -- generation ----------------------------------------------------------------
    def _generator(self, model: Model, seed: int, id_cols: list[str], given: bool = False, index: ConditionIndex | None = None):
        row = "_row"

        def make(ids: DataFrame) -> DataFrame:
            drawn = generate(model, ids, id_cols, seed, given) if index is None else index.generate(ids, id_cols, seed)
            limits = {c: e.decoded(F.array(F.col(f"`{c}`").cast("double"))) for c, e in self.numbers.items()}
            drawn = drawn.withColumns(limits) if limits else drawn
            numbered = drawn.withColumn(row, F.xxhash64(*[F.col(f"`{c}`").cast("bigint") for c in id_cols]))
            carried = [c for c in ids.columns if c != "label"]
            ready = finalize_fields(numbered, self.spec, self.constraints, seed, row, self.types)
            names = [f.name for f in self.spec.fields if f.type != "id"]
            return ready.select(*carried, *[F.col(f"`{c}`") for c in names])

        return make

    def _with_ids(self, rows: DataFrame, order_by: str, n: int | None = None) -> DataFrame:
        for f in self.spec.fields:
            if f.type == "id":
                rows = make_ids(rows, f, order_by, rows=n)
        return rows

    def sample(self, n: int | None = None, labels=None, unseen=None, conditions=None, k: int = 3,
               max_retries: int = MAX_RETRIES, max_rows_multiplier: int = MAX_ROWS_MULTIPLIER, rtol: float = FLOAT_RTOL,
               graceful: bool = False, seed: int = 0, sort: bool = False, spark: SparkSession | None = None) -> DataFrame:
        """``n`` rows (as many as were learned from, if not given) that hold all constraints.

        ``labels`` / ``unseen`` restrict the labels, with near-equal shares; unseen labels are
        generated from the mix of their ``k`` nearest seen labels. ``conditions`` asks for one
        row per condition. ``sort`` orders by label (conditions: by their order). Rows that are still missing when the
        retries run out are an error, or a warning with ``graceful``.
        """
        spark = spark or self._spark()
        if conditions is not None:
            return self._sample_conditions(spark, conditions, n, max_retries, max_rows_multiplier, rtol, graceful, seed, sort)
        n = n or self.rows
        if self.model is None:
            return ids_only(spark, self.spec, n)
        model, given = self.model, False
        quota = None
        if unseen:
            model, given = self._unseen_model(spark, list(unseen), k), True
            quota = list(unseen)
        elif labels:
            given, quota = True, [str(x) for x in labels]
            asked = spark.createDataFrame([(x,) for x in set(quota)], "label string")
            strange = asked.join(model.counts.select("label"), "label", "left_anti").limit(5).collect()
            if strange:
                raise ValueError(f"labels that were never learned: {sorted(r['label'] for r in strange)}")
        make = self._generator(model, seed, ["cand_id"], given)
        if quota is not None:
            table = spark.createDataFrame([(str(x), i) for i, x in enumerate(quota)], "label string, position bigint")

            def source(ids: DataFrame) -> DataFrame:
                return make(label_quota(table, ids, "cand_id"))
        else:
            source = make
        rows = sample_valid(spark, source, self.constraints, n, max_retries, max_rows_multiplier, graceful=graceful)
        rows = self._with_ids(rows, "cand_id") if self.spec.names() != self.spec.names(ids=False) else rows
        out = rows.select(*[F.col(f"`{c}`") for c in self.spec.names()])
        return out.orderBy(self.label) if sort else out

    def _spark(self) -> SparkSession:
        found = SparkSession.getActiveSession()
        if found is None:
            raise NotFittedError("no active Spark session")
        return found

    def _unseen_model(self, spark: SparkSession, unseen: list[str], k: int) -> Model:
        key = (tuple(unseen), k)
        if key in self._mixed:
            return self._mixed[key]
        if self.embeddings is None:
            raise NotFittedError("unseen labels need label embeddings")
        wanted = spark.createDataFrame([(str(u),) for u in unseen], "key string")
        known = lookup(self.embeddings.select(F.col("key").cast("string").alias("key"), "embedding"), wanted, ["key"], how="left_semi")
        if known.count() != len(set(unseen)):
            raise KeyError("some unseen labels have no embedding")
        seen = self.model.counts.select(F.col("label").alias("key"))
        others = lookup(self.embeddings.select(F.col("key").cast("string").alias("key"), "embedding"), seen, ["key"], how="left_semi")
        others = lookup(others, wanted, ["key"], how="left_anti")
        near = materialize(nearest_labels(known, others, k).select("key", "neighbour", "weight"), "neighbours")
        m = self.model

        def mixed(table: DataFrame | None, values: list[str], tag: str) -> DataFrame | None:
            return None if table is None else materialize(mixed_weights(near, table, "label", values), tag)

        made = replace(
            m, guides={}, joint=mixed(m.joint, ["pair", "a", "b"], "joint"),
            conditional=mixed(m.conditional, ["column", "value"], "conditional"),
            components=mixed(m.components, ["column", "component"], "components"),
        )
        self._mixed[key] = made
        return made

    def _sample_conditions(self, spark, conditions, n, max_retries, multiplier, rtol, graceful, seed, sort):
        asked = make_conditions(spark, conditions, n)
        names = [c for c in asked.columns if c != "cond_id"]
        for c in names:
            if c not in self.spec:
                raise ValueError(f"condition on the unknown column `{c}`")
        try:
            assert_constraints(asked.select(*names), self.constraints)
        except ConstraintsNotMetError as e:
            raise ConstraintsNotMetError("the conditions break the constraints", e.counts) from e
        asked = materialize(asked, "asked")
        fixed = self._completed(asked, names)
        extra = [] if fixed is None else [c for c in fixed.columns if c not in ("cond_id", *names)]
        if extra:
            asked = materialize(asked.join(fixed.select("cond_id", *[F.col(f"`{c}`").alias(f"_fix_{c}") for c in extra]), "cond_id"), "asked")
        known = self._guiding(asked, names, extra)
        columns = [c for c in known.columns if c != "cond_id"]
        index, given = None, self.label in names
        if columns:
            known = materialize(known_values(known, self.model, columns, ["cond_id"]), "known")
            index = ConditionIndex(self.model, known, columns)
            if not index.impossible().isEmpty():
                raise ValueError("some conditions were never met")
            asked = lookup(asked, known, ["cond_id"], "inner")
        make = self._generator(self.model, seed, ["cond_id", "attempt"], given, index)
        carry = [*[f"_fix_{c}" for c in extra], *[KNOWN + c for c in columns]]

        def source(tries: DataFrame) -> DataFrame:
            ids = tries.withColumn("label", F.col(f"_want_{self.label}").cast("string")) if given and index is None else tries
            rows = make(ids)
            return rows.withColumns({c: F.col(f"`_fix_{c}`").cast(rows.schema[c].dataType) for c in extra}) if extra else rows

        rows = sample_conditional(asked, source, self.constraints, self.spec.names(), max_retries, multiplier, rtol, graceful, carry=carry)
        rows = materialize(rows, "conditional")
        rows = make_ids_unique(self._with_ids(rows, "cond_id"), self.spec, "cond_id")
        out = rows.select("cond_id", *[F.col(f"`{c}`") for c in self.spec.names()])
        return out.orderBy("cond_id") if sort else out

    def _guiding(self, asked: DataFrame, names: list[str], extra: list[str]) -> DataFrame:
        """(cond_id, given values) in the columns of the model: the conditions as the constraints encode them.

        What a constraint cannot encode, because other columns of it are open, is left to the check of the finished rows.
        """
        typed = asked.filter(reduce(lambda a, b: a & b, [F.col(f"`{c}`").isNotNull() for c in names], F.lit(True))).select(
            "cond_id", *[(F.col(f"`{c}`").cast(self.types[c]) if c in self.types else F.col(f"`{c}`")).alias(c) for c in names],
            *[F.col(f"`_fix_{c}`").alias(c) for c in extra],
        )
        with warnings.catch_warnings():
            warnings.simplefilter("ignore", UserWarning)  # an open column is what this is for
            coded = transform_all(typed, self.constraints, on_missing="drop")
        m = self.model
        return coded.select("cond_id", *[c for c in coded.columns if c in m.columns or c in m.mixtures or c == m.label])

    def _completed(self, asked: DataFrame, names: list[str]) -> DataFrame | None:
        """Constraint columns that a column model adds to the conditions, keyed by condition."""
        fixed = None
        for c in self.constraints:
            has = [x for x in c.columns if x in names]
            if c.model is not None and has and len(has) < len(c.columns):
                from ..operators.copula import complete_conditions

                part = complete_conditions(asked.select("cond_id", *has), c, id_col="cond_id")
                fixed = part if fixed is None else fixed.join(part, "cond_id")
        return fixed

    # -- saving --------------------------------------------------------------------
    def save(self, path: str) -> None:
        """Write everything learned as parquet tables and one JSON file."""
        m, spark = self.model, self._spark()
        constraints = []
        for c in self.constraints:
            entry = {"arguments": {**c.to_dict(), "constraint": constraint_name(c)}, "learned": {a: getattr(c, a) for a in c.learned if hasattr(c, a)}}
            if isinstance(c.model, FactorModel):
                cm = c.model
                entry["factors"] = [cm.columns, cm.types, cm.table, cm.numbers, cm.rank]
            elif c.model is not None:
                cm = c.model
                entry["model"] = {
                    "columns": cm.columns, "types": cm.types, "mean": cm.mean, "cov": cm.cov,
                    "dims": [[d.column, None if d.category is None else list(d.category)] for d in cm.dims],
                }
            constraints.append(entry)
        content = {
            "fields": [
                {k: v for k, v in vars(f).items() if v is not None} for f in self.spec.fields
            ],
            "name": self.spec.name, "primary_key": self.spec.primary_key, "label": self.label, "rows": self.rows,
            "types": self.types, "constraints": constraints, "embeddings": self.embeddings,
            "ledger": None if self.ledger is None else [self.ledger.delta, [list(e) for e in self.ledger.entries]],
            "numbers": {c: [e.type, e.mean, e.low, e.high, e.digits] for c, e in self.numbers.items()},
            "model": None if m is None else {
                "label": m.label, "columns": m.columns, "types": m.types,
                "mixtures": {c: [x.means, x.stds, x.weights] for c, x in m.mixtures.items()},
                "counts": m.counts, "joint": m.joint, "conditional": m.conditional, "components": m.components,
            },
        }
        profiles.save(spark, path, content)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Profile:
        data = profiles.load(spark, path)
        constraints = []
        for entry in data["constraints"]:
            c = Constraint.from_dict(entry["arguments"])
            for name, value in entry["learned"].items():
                setattr(c, name, value)
            if entry.get("factors"):
                c.model = FactorModel(*entry["factors"])
            if entry.get("model"):
                cm = entry["model"]
                dims = [_Dim(col, None if cat is None else tuple(cat)) for col, cat in cm["dims"]]
                c.model = Copula(cm["columns"], cm["types"], dims, cm["mean"], cm["cov"])
            constraints.append(c)
        numbers = {}
        for c, (dtype, mean, low, high, digits) in data["numbers"].items():
            e = Numeric()
            e.name, e.type, e.mean, e.low, e.high, e.digits = c, dtype, mean, low, high, digits
            numbers[c] = e
        m = data["model"]
        model = None
        if m is not None:
            mixtures = {c: Mixture(*parts) for c, parts in m["mixtures"].items()}
            model = Model(m["label"], m["columns"], mixtures, m["types"], m["counts"], m["joint"], m["conditional"], m["components"])
        spec = TableSpec([FieldSpec(**f) for f in data["fields"]], data["name"], data["primary_key"])
        ledger = data.get("ledger") and Ledger(data["ledger"][0], [tuple(e) for e in data["ledger"][1]])
        return cls(spec, data["label"], constraints, model, numbers, data["types"], data["rows"], data["embeddings"], ledger)


def constraint_name(c: Constraint) -> str:
    """Name under which a constraint is found again: users' own by their dotted path, where they have one."""
    kind = type(c)
    own = kind.__module__.partition(".")[0] != __name__.partition(".")[0] and kind.__module__ != "__main__" and "<locals>" not in kind.__qualname__
    return f"{kind.__module__}.{kind.__qualname__}" if own else kind.__name__


def finalize_fields(rows: DataFrame, spec: TableSpec, constraints, seed: int, row: str, types) -> DataFrame:
    """``finalize`` for candidate rows: everything but the ids, other columns kept."""
    fields = TableSpec([f for f in spec.fields if f.type != "id"], spec.name)
    others = [c for c in rows.columns if c not in fields.names() and c != row]
    done = finalize(rows, fields, constraints, seed, row, types, keep=others)
    return done.drop(row)

