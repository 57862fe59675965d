"""A domain as data: what each column of a case table is, and what the jobs make of it.

A contract is a list of column rules. It can be kept as a table, one row for each column and
value, and read back from one; the jobs that check, encode, impute, scale and extend cases build
their projections from it, so another domain is another table and no new code. ``KIDNEY`` is the
contract that they use by default.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from abstain_eval import contracts as k

KINDS = ("id", "number", "nominal", "target")
TABLE = (
    "place int, `column` string, kind string, feature boolean, low double, high double, ceiled boolean, "
    "value string, code double, shifted boolean, sets map<string,int>, stratum boolean"
)


@dataclass(frozen=True)
class ColumnRule:
    """One column: its kind, the code of each allowed text, texts read as missing, and bounds of numbers.

    ``sets`` gives the column's place in named feature sets; ``ceiled`` columns are rounded up
    after scaling in all but the full one. ``feature`` is false for columns that are only checked.
    """

    name: str
    kind: str
    codes: tuple[tuple[str, float], ...] = ()
    shifted: tuple[str, ...] = ()
    low: float | None = None
    high: float | None = None
    feature: bool = True
    ceiled: bool = False
    sets: tuple[tuple[str, int], ...] = ()

    def __post_init__(self) -> None:
        if self.kind not in KINDS:
            raise ValueError(f"column {self.name!r} has unknown kind {self.kind!r}")


@dataclass(frozen=True)
class Contract:
    """The rules of a case table in the order of its columns; statistics are taken by ``stratum``."""

    rules: tuple[ColumnRule, ...]
    stratum: str = ""
    by_name: dict[str, ColumnRule] = field(init=False, repr=False, compare=False)

    def __post_init__(self) -> None:
        object.__setattr__(self, "by_name", {r.name: r for r in self.rules})
        for kind in ("id", "target"):
            if len(self._of(kind)) != 1:
                raise ValueError(f"a contract has one {kind} column, not {len(self._of(kind))}")

    def _of(self, *kinds: str) -> list[ColumnRule]:
        return [r for r in self.rules if r.kind in kinds]

    @property
    def id(self) -> str:
        return self._of("id")[0].name

    @property
    def target(self) -> str:
        return self._of("target")[0].name

    @property
    def labels(self) -> list[str]:
        return [value for value, _ in sorted(self.by_name[self.target].codes, key=lambda c: c[1])]

    @property
    def columns(self) -> list[str]:
        return [r.name for r in self.rules]

    @property
    def numeric(self) -> list[str]:
        """Columns whose texts must be numbers."""
        return [r.name for r in self._of("id", "number")]

    def _features(self, kind: str) -> list[str]:
        return [c for c in self.feature_set("full") if self.by_name[c].kind == kind]

    @property
    def numbers(self) -> list[str]:
        return self._features("number")

    @property
    def nominal(self) -> list[str]:
        return self._features("nominal")

    @property
    def imputed(self) -> list[str]:
        return [*self.nominal, *self.numbers, self.target]

    @property
    def strata(self) -> str:
        return self.stratum or self.target

    def feature_set(self, name: str) -> list[str]:
        """A named set in its order; ``full``, if no column names it, is all nominal and then all numeric ones."""
        placed = sorted((dict(r.sets)[name], r.name) for r in self.rules if name in dict(r.sets))
        if not placed and name == "full":
            return [r.name for kind in ("nominal", "number") for r in self._of(kind) if r.feature]
        if not placed:
            raise ValueError(f"unknown feature set: {name!r}")
        return [column for _, column in placed]

    def to_table(self, spark: SparkSession) -> DataFrame:
        """One row for each column and value."""
        rows = []
        for place, r in enumerate(self.rules):
            values = [(v, c, False) for v, c in r.codes] + [(v, None, True) for v in r.shifted] or [(None, None, None)]
            for value, code, shifted in values:
                rows.append((place, r.name, r.kind, r.feature, r.low, r.high, r.ceiled, value, code, shifted, dict(r.sets), r.name == self.stratum))
        if self.stratum and self.stratum not in self.by_name:  # a derived column
            rows.append((None, self.stratum, None, None, None, None, None, None, None, None, None, True))
        return spark.createDataFrame(rows, TABLE)

    @staticmethod
    def from_table(table: DataFrame) -> Contract:
        """The contract that a table holds; it is as long as the columns' allowed values."""
        found: dict[str, list] = {}
        stratum = ""
        for row in table.select(*[F.col(c.split()[0]) for c in TABLE.split(", ")]).collect():
            stratum = row["column"] if row["stratum"] else stratum
            if row["kind"] is not None:
                found.setdefault(row["column"], []).append(row)
        rules = []
        for name, rows in sorted(found.items(), key=lambda item: item[1][0]["place"]):
            first = rows[0]
            codes = sorted(((r["value"], r["code"]) for r in rows if r["value"] is not None and not r["shifted"]), key=lambda c: (c[1], c[0]))
            shifted = tuple(sorted(r["value"] for r in rows if r["shifted"]))
            rules.append(
                ColumnRule(
                    name, first["kind"], tuple(codes), shifted, first["low"], first["high"], first["feature"], first["ceiled"],
                    tuple(sorted((first["sets"] or {}).items())),
                )
            )
        return Contract(tuple(rules), stratum)


_FULL = [*k.NOMINAL_COLUMNS, *k.NUMERIC_FEATURES]


def _kidney_rule(name: str) -> ColumnRule:
    sets = tuple((of, columns.index(name)) for of, columns in (("full", _FULL), ("reduced", k.REDUCED_FEATURES)) if name in columns)
    if name == k.ID_COLUMN:
        return ColumnRule(name, "id")
    if name == k.TARGET_COLUMN:
        return ColumnRule(name, "target", tuple((v, float(i)) for i, v in enumerate(k.LABEL_CLASSES)))
    if name in k.ORDINAL_CODES:
        codes = tuple((v, float(c)) for v, c in k.ORDINAL_CODES[name].items())
        return ColumnRule(name, "nominal", codes, tuple(k.SHIFTED_VALUES.get(name, ())), ceiled=name in k.CEILED_COLUMNS, sets=sets)
    low, high = k.CONTINUOUS_BOUNDS.get(name, (None, None))
    return ColumnRule(name, "number", low=low, high=high, feature=name in k.NUMERIC_FEATURES, sets=sets)


KIDNEY = Contract(tuple(_kidney_rule(c) for c in k.RAW_COLUMNS), "ckd_stage")
