"""Plans for a reviewer: of each kind of finding the first few, in the order of the kinds, with what has to be proved first."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Step:
    """A kind of finding: what to do with one, how many at most, and the proofs it takes."""

    action: str
    most: int
    proof: tuple[str, ...]


# The steps, their limits and proofs.
CLEANUP = {
    "dependencies": Step("review_dependency_removal", 5, ("inspect package scripts/runtime loaders", "run focused tests")),
    "exports": Step("review_unused_export", 5, ("read exact file", "check public API and dynamic references", "run focused tests")),
    "duplicates": Step("review_duplicate_block", 4, ("read exact files", "check behavioral divergence", "run focused tests")),
    "cycles": Step("break_import_cycle", 4, ("read exact files", "preserve module initialization order", "run build/tests")),
    "hotspots": Step("contain_complexity_hotspot", 3, ("read exact file", "avoid cosmetic churn", "add tests before risky refactor")),
}
DOCUMENTS = {
    "links": Step("fix_or_remove_broken_link", 5, ("verify intended target", "update source doc", "run the documentation checks if logic changes")),
    "anchors": Step("fix_broken_anchor", 5, ("verify target heading", "preserve external backlinks when possible")),
    "orphans": Step("review_orphan_doc", 5, ("check external references", "choose owner or archive target", "do not delete without reviewed replacement")),
    "sections": Step("review_duplicate_section", 4, ("read exact sections", "pick SSOT target", "preserve backlinks")),
    "references": Step("fix_stale_code_reference", 4, ("verify renamed/deleted target", "update doc path or mark obsolete")),
    "claims": Step("review_ssot_claim", 3, ("confirm repo markdown remains canonical", "update wording or mirror registry")),
}


def plan(steps: dict[str, Step], findings: dict[str, tuple[DataFrame, Column, list[Column]]], most: int | None = None) -> DataFrame:
    """(place, action, target, evidence, proof): findings give rows, their target and their order for each step by name.

    A step without findings is left out. Each kind is cut to its few first rows before anything is put together, so
    the rows that are numbered in one place are no more than the steps allow.
    """
    parts = []
    for at, (name, step) in enumerate(steps.items()):
        if name in findings:
            rows, target, order = findings[name]
            evidence = F.to_json(F.struct(*(F.col(f"`{c}`") for c in sorted(rows.columns))))
            first = rows.orderBy(*order).limit(step.most)
            number = F.row_number().over(Window.orderBy(*order))
            parts.append(first.select(F.lit(at).alias("step"), number.alias("nth"), F.lit(step.action).alias("action"), target.cast("string").alias("target"), evidence.alias("evidence"), F.array(*map(F.lit, step.proof)).alias("proof")))
    every = reduce(DataFrame.unionByName, parts)
    out = every.withColumn("place", F.row_number().over(Window.orderBy("step", "nth"))).select("place", "action", "target", "evidence", "proof")
    return out if most is None else out.filter(F.col("place") <= most)
