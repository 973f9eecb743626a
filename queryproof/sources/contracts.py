"""Contracts: which rows break required, enum, range or field rules, and where they go."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from queryproof.functions.rules import matching_codes


@dataclass(frozen=True)
class Contract:
    """Rules of a row: required columns, allowed values, and allowed keys of JSON columns."""

    required: Sequence[str] = ()
    enums: Mapping[str, Sequence[str]] = field(default_factory=dict)
    json_keys: Mapping[str, Sequence[str]] = field(default_factory=dict)
    checks: Mapping[str, Column] = field(default_factory=dict)

    def violations(self) -> Column:
        """Array of violation codes of a row, empty when it keeps the contract."""
        rules = [(F.col(c).isNull(), f"MISSING:{c}") for c in self.required]
        for c, allowed in self.enums.items():
            rules.append((F.col(c).isNotNull() & ~F.col(c).isin(*allowed), f"ENUM:{c}"))
        for c, allowed in self.json_keys.items():
            keys = F.json_object_keys(c)
            known = F.array(*[F.lit(k) for k in allowed])
            rules.append((F.col(c).isNotNull() & keys.isNull(), f"NOT_JSON:{c}"))
            rules.append((F.size(F.array_except(keys, known)) > 0, f"UNEXPECTED:{c}"))
        rules += [(~ok, code) for code, ok in self.checks.items()]
        return matching_codes(rules)


def split_by_contract(df: DataFrame, contract: Contract) -> tuple[DataFrame, DataFrame]:
    """Valid rows, and quarantined rows with their ``violations``."""
    judged = df.withColumn("violations", contract.violations())
    return judged.filter(F.size("violations") == 0).drop("violations"), judged.filter(F.size("violations") > 0)


def violation_counts(df: DataFrame, contract: Contract) -> DataFrame:
    """``(code, n)`` per violation, with the code VALID for rows that have none."""
    codes = contract.violations()
    shown = F.when(F.size(codes) == 0, F.array(F.lit("VALID"))).otherwise(codes)
    return df.select(F.explode(shown).alias("code")).groupBy("code").agg(F.count("*").alias("n"))
