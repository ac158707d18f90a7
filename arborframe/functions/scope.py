"""Tenant, user and job scope, lowered to filters that prune partitions."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .keys import PUBLIC


@dataclass(frozen=True)
class Scope:
    """None stands for no restriction."""

    tenant_id: str | None = None
    include_public: bool = False
    users: Sequence[str] | None = None
    jobs: Sequence[str] | None = None

    def __post_init__(self) -> None:
        if self.tenant_id == "":
            raise ValueError("an empty tenant")
        for x in (self.users, self.jobs):
            if x is not None and not list(x):
                raise ValueError("an empty list restricts to nothing")

    def narrowed(self, **more) -> Scope:
        """The scope with further restrictions; what is set already cannot be changed."""
        for k, v in more.items():
            if getattr(self, k) not in (None, False) and getattr(self, k) != v:
                raise ValueError(f"{k} is fixed by the view")
        return replace(self, **more)

    def anchors(self, df: DataFrame) -> DataFrame:
        """Only the tenant's rows."""
        if self.tenant_id is None:
            return df
        tenants = [self.tenant_id] + [PUBLIC] * self.include_public
        return df.where(F.col("tenant_id").isin(tenants))

    def members(self, df: DataFrame) -> DataFrame:
        """The users' and jobs' rows; array columns need any of them."""
        for values, scalar, several in ((self.users, "created_by_user_id", "created_by_user_ids"), (self.jobs, "job_id", "job_ids")):
            if values is not None and scalar in df.columns:
                df = df.where(F.col(scalar).isin(list(values)))
            elif values is not None and several in df.columns:
                df = df.where(F.arrays_overlap(F.coalesce(F.col(several), F.array().cast("array<string>")), F.array(*map(F.lit, values))))
        return df

    def all(self, df: DataFrame) -> DataFrame:
        return self.members(self.anchors(df))
