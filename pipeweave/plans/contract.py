"""Data contracts: named rules over rows, violations as data, and quarantine."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from pipeweave.operators.rel import Rel


@dataclass(frozen=True)
class Rule:
    name: str
    holds: Column
    warn: bool = False


@dataclass
class Contract:
    """Required fields with types, and rules. ``closed``: a row's other fields are dropped."""

    name: str
    fields: dict[str, str] = field(default_factory=dict)
    optional: frozenset[str] = frozenset()
    rules: list[Rule] = field(default_factory=list)
    closed: bool = True

    def require(self, name: str, holds: Column) -> Contract:
        self.rules.append(Rule(name, holds))
        return self

    def warn(self, name: str, holds: Column) -> Contract:
        self.rules.append(Rule(name, holds, True))
        return self

    def validate_field(self, column: str, validator: Callable[[Column], Column], name: str | None = None) -> Contract:
        return self.require(name or f"{column} {validator.__name__}", validator(F.col(column)))

    def violations(self, warnings: bool = False) -> Column:
        """The names of the rules a row breaks; a rule that cannot be decided is broken."""
        parts = []
        if not warnings:
            for f, kind in self.fields.items():
                bad = F.col(f).isNotNull() & F.col(f).try_cast(kind).isNull()
                if f not in self.optional:
                    bad = bad | F.col(f).isNull()
                parts.append(F.when(bad, F.lit(f"{f} is {kind}")))
        parts += [F.when(~F.coalesce(r.holds, F.lit(False)), F.lit(r.name)) for r in self.rules if r.warn == warnings]
        return F.array_compact(F.array(*parts)) if parts else F.array().cast("array<string>")

    def validate(self, rel: Rel, name: str = "result") -> Rel:
        """Each row as a result: ok with the declared fields read as their types, or err with the row and its violations."""
        good = F.struct(*[F.col(c).try_cast(self.fields[c]).alias(c) if c in self.fields else F.col(c) for c in (self.fields if self.closed and self.fields else rel.columns)])
        broken = F.col("__v")
        bad = F.struct(F.lit(self.name).alias("contract"), F.struct(*rel.columns).alias("value"), broken.alias("violations"))
        out = rel.extend(__v=self.violations())
        holds = F.size("__v") == 0
        return Rel(out.raw.withColumn(name, F.struct(holds.alias("is_ok"), F.when(holds, good).alias("ok"), F.when(~holds, bad).alias("err"))), rel.order).map(name)


# validators

_LABEL = "[A-Za-z0-9](?:[A-Za-z0-9-]{0,61}[A-Za-z0-9])?"


def is_domain(s: Column) -> Column:
    return s.rlike(rf"^(?:{_LABEL}\.)+[A-Za-z]{{2,63}}$") & (F.char_length(s) <= 253)


def email(s: Column) -> Column:
    """One @, a local part of ordinary signs, and a domain."""
    return s.rlike(r"^[A-Za-z0-9._%+'-]{1,64}@[^@]+$") & is_domain(F.substring_index(s, "@", -1))


def url(s: Column) -> Column:
    return s.rlike(r"^https?://[^\s/?#]+([/?#]\S*)?$")


def uuid(s: Column) -> Column:
    return s.rlike(r"^[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$")
