"""Another domain: its contract through the five jobs, or steps of its own.

``prepare_domain`` takes a contract (``schema.Contract``, which may come from a table) through
checking, encoding, imputation, scaling and synthesis without further code. ``Domain`` chains
steps that a user writes.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame

from abstain_eval.operators import encode, impute, synthesize, validate
from abstain_eval.schema import Contract
from abstain_eval.session import cut_lineage

Step = Callable[[DataFrame], DataFrame]


@dataclass(frozen=True)
class Domain:
    name: str
    required: tuple[str, ...]
    steps: tuple[Step, ...] = field(default_factory=tuple)

    def run(self, raw: DataFrame) -> DataFrame:
        missing = sorted(set(self.required) - set(raw.columns))
        if missing:
            raise ValueError(f"{self.name} needs columns {missing}")
        out = raw
        for step in self.steps:
            out = out.transform(step)
        return out


@dataclass
class DomainTables:
    """What the five jobs make of one raw table."""

    clean: DataFrame
    imputed: DataFrame
    imputation: impute.FittedImputation
    scaled: DataFrame
    ranges: DataFrame
    statistics: DataFrame
    synthetic: DataFrame


def prepare_domain(
    raw: DataFrame,
    contract: Contract,
    n_synthetic: int = 200,
    seed: int = 42,
    features: str = "full",
    estimator: str | impute.Boosting = "gbt",
    rounds: int = 10,
    derive: Callable[[DataFrame], DataFrame] | None = None,
    derive_synthetic: Callable[[DataFrame, int], DataFrame] | None = None,
) -> DomainTables:
    """Check a raw table by its contract, encode, impute and scale it, and draw synthetic cases.

    ``derive`` computes a stratum that is no column of the raw table.
    """
    validate.assert_valid(validate.violations(raw, contract=contract))
    clean = validate.clean_cases(raw, contract=contract)
    frame = encode.encoded_frame(clean, contract=contract)
    fitted, done = impute.fit_imputation(frame, contract.imputed, estimator, rounds)
    imputed = cut_lineage(encode.round_target(done, contract.target))
    scaled, ranges = encode.fit_scale(imputed, features, [contract.id], contract)
    cases = derive(imputed) if derive else imputed
    statistics = cut_lineage(synthesize.fit_stage_stats(cases, contract))
    synthetic = synthesize.generate(statistics, n_synthetic, seed, contract, derive_synthetic)
    return DomainTables(clean, imputed, fitted, scaled, ranges, statistics, synthetic)
