"""Rule cascades: the first rule that fails names the reason, flags are gathered beside it."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rule:
    """A code, the condition under which a row fails, and what is said after the code."""

    code: str
    fails: Column
    detail: Column | None = None

    @property
    def reason(self) -> Column:
        return F.lit(self.code) if self.detail is None else F.concat(F.lit(self.code + ":"), self.detail)


def first_failure(rules: Sequence[Rule]) -> Column:
    """The reason of the first rule that fails, null if all pass; a null condition passes."""
    return F.coalesce(*[F.when(r.fails, r.reason) for r in rules])


def all_flags(rules: Sequence[Rule], between: str = " | ") -> Column:
    """The reasons of all rules that hold, joined; empty if none does."""
    return F.concat_ws(between, *[F.when(r.fails, r.reason) for r in rules])


def reason_code(reason: Column) -> Column:
    return F.split(reason, ":")[0]


def ladder(value: Column, steps: Sequence[tuple[float, str]], below: str) -> Column:
    """The first name whose bound the value reaches; bounds descend."""
    out = F.lit(below)
    for bound, name in reversed(steps):
        out = F.when(value >= bound, F.lit(name)).otherwise(out)
    return out
