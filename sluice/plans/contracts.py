"""What a scorer and an actuator promise. All of them build plans and never run a job.

A batch is a DataFrame with a ``step`` column, one row a response. Rows of one prompt share ``uid``. Every ranking
ends in the ``tie`` columns, so that results don't depend on partitioning.
"""

from __future__ import annotations

from collections.abc import Mapping
from typing import Any

from pyspark.sql import DataFrame

from .registry import CATALOGUE

TIMINGS = ("pre_rollout", "post_reward", "post_advantage", "in_loss")
GRANULARITIES = ("domain", "prompt", "response", "token")


class Component:
    """What a schedule is made of. A subclass with a ``name`` enters the catalogue under the kind of its contract."""

    kind = ""
    name: str | None = None

    def __init_subclass__(cls, name: str | None = None, **kw: object) -> None:
        super().__init_subclass__(**kw)
        if name is not None:
            cls.name = name
            CATALOGUE.add(cls.kind, name, cls)

    @classmethod
    def named(cls, name: str, *layers: Mapping[str, Any] | None) -> Any:
        """The component of this kind with that name; ``layers`` of options, the first wins."""
        return CATALOGUE.find(cls.kind, name).make(*layers)

    @classmethod
    def names(cls) -> list[str]:
        return CATALOGUE.names(cls.kind)


class Scorer(Component):
    """Adds a ``score`` column: DOUBLE, or ARRAY<DOUBLE> at token granularity."""

    kind = "scorer"
    requires: tuple[str, ...] = ()
    timing = "post_reward"
    granularity = "response"
    needs_groups = False

    def __init_subclass__(cls, **kw: Any) -> None:
        for field, allowed in (("timing", TIMINGS), ("granularity", GRANULARITIES)):
            if getattr(cls, field) not in allowed:
                raise ValueError(f"{cls.__name__}: {field} is {getattr(cls, field)!r}, which is none of {', '.join(allowed)}")
        super().__init_subclass__(**kw)

    def check(self, df: DataFrame) -> None:
        """Fails before any job where a required column is missing."""
        need = [*self.requires, *(["uid"] if self.needs_groups else [])]
        if missing := [c for c in need if c not in df.columns]:
            raise KeyError(f"{type(self).__name__} needs columns {missing}")

    def score(self, df: DataFrame) -> DataFrame:
        raise NotImplementedError


class Actuator(Component):
    #: score granularities that the actuator can take
    takes: tuple[str, ...] = ("prompt", "response")

    def __init__(self, scorer: Scorer | None = None, step: str = "step", tie: tuple[str, ...] = ("row_id",)):
        self.scorer, self.step, self.tie = scorer, step, tuple(tie)


class Selector(Actuator):
    kind = "selector"

    def select(self, df: DataFrame) -> DataFrame:
        """Adds a boolean ``kept``."""
        raise NotImplementedError


class Reweighter(Actuator):
    kind = "reweighter"

    def reweight(self, df: DataFrame) -> DataFrame:
        """Adds ``weight``, or ``weight_tok`` at token granularity."""
        raise NotImplementedError


class Mixer(Actuator):
    kind = "mixer"
    takes = ("domain", "prompt", "response")

    def mix(self, stats: DataFrame) -> DataFrame:
        """(domain_ord, domain, p) for each group of ``by`` columns of a table of domain statistics."""
        raise NotImplementedError
