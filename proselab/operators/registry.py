"""Detectors and judges by name, and which of them a configuration allows (D-07 to D-10, J-09, M-09)."""

from __future__ import annotations

from collections.abc import Iterable
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class Judge(NamedTuple):
    name: str
    #: The setting that must hold a key for the judge to be used.
    key: str
    weight: float


LOCAL = "local"


def configured(judges: Iterable[Judge], keys: dict[str, str], prefer: list[str] | None = None) -> list[Judge]:
    """J-09, M-09: the judges, in the order in which an ensemble names them, whose keys are set, of those preferred."""
    return [j for j in judges if (prefer is None or j.name in prefer) and keys.get(j.key)]


def judge(judges: Iterable[Judge], keys: dict[str, str], prefer: list[str] | None = None, local: bool = True) -> tuple[str, list[Judge]]:
    """D-10: name and members of the judge that a configuration gives: one alone, several as an ensemble, else the local one."""
    found = configured(judges, keys, prefer)
    if not found:
        if not local:
            raise LookupError("no judge is configured, and the local one is not allowed")
        return LOCAL, []
    return (found[0].name if len(found) == 1 else f"ensemble({'+'.join(j.name for j in found)})"), found


def resolved(settings: DataFrame, judges: DataFrame) -> DataFrame:
    """D-10 over a table: id and judge of each configuration in rows (id, key), by the rows (place, name, key, weight) of the judges.

    Configurations without a row of a known key have the local judge; a row with a null key stands for none.
    """
    met = settings.join(judges, "key", "left").groupBy("id").agg(F.array_sort(F.collect_set(F.when(F.col("name").isNotNull(), F.struct("place", "name")))).alias("j"))
    names = F.transform("j", lambda x: x["name"])
    name = F.when(F.size("j") == 0, LOCAL).when(F.size("j") == 1, names[0]).otherwise(F.concat(F.lit("ensemble("), F.array_join(names, "+"), F.lit(")")))
    return met.select("id", name.alias("judge"), F.size("j").alias("members"))


def available(scores: DataFrame, members: DataFrame, detector: str = "detector") -> DataFrame:
    """D-08: the scores of the members that loaded; rows (detector, loaded), an error without any."""
    loaded = members.where("loaded").select(F.col("detector").alias(detector))
    if loaded.isEmpty():
        raise LookupError("no detector of the ensemble is there")
    return scores.join(loaded, detector, "left_semi")


#: D-07: the default ensemble's detectors of texts, as native stand-ins (name, weight); the small one has the first alone.
DETECTORS: tuple[tuple[str, float], ...] = (("pattern", 1.0), ("reduced", 1.0), ("evenness", 0.5))


def ensemble(lite: bool = False) -> tuple[tuple[str, float], ...]:
    """D-07."""
    return DETECTORS[:1] if lite else DETECTORS
