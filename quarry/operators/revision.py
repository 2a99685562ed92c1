"""Revisions, releases and the persons they name."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.operators.content import new_rows
from quarry.operators.graph import parent_lists
from quarry.operators.policy import with_display_names


def revision_add(new: DataFrame, revision: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(revisions, parent edges) to append from rows with an array ``parents``."""
    rows = new_rows(new, revision, ["id"])
    edges = rows.select("id", F.posexplode("parents").alias("parent_rank", "parent_id"))
    return rows.drop("parents"), edges


def release_add(new: DataFrame, release: DataFrame) -> DataFrame:
    return new_rows(new, release, ["id"])


def revision_get(ids: DataFrame, revision: DataFrame, parents: DataFrame, names: DataFrame | None = None) -> DataFrame:
    """Aligned revisions with their parents in order; nulls for unknown ids. ``names``: display names of persons to show."""
    own = revision if names is None else with_display_names(revision, names, [c for c in ("author", "committer") if c in revision.columns])
    return ids.join(own, "id", "left").join(parent_lists(parents), "id", "left")


def release_get(ids: DataFrame, release: DataFrame, names: DataFrame | None = None) -> DataFrame:
    return ids.join(release if names is None else with_display_names(release, names, ["author"]), "id", "left")


def persons(df: DataFrame, columns: list[str], known: DataFrame | None = None) -> DataFrame:
    """New persons by full name among struct columns; of several readings the smallest (name, email)."""
    every = df.select(F.explode(F.array(*columns)).alias("p")).where("p is not null").select("p.*")
    one = every.groupBy("fullname").agg(F.min(F.struct("name", "email")).alias("p")).select("fullname", "p.name", "p.email")
    return one if known is None else one.join(known, "fullname", "left_anti")
