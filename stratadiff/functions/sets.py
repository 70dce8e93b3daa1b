"""Relations and measures of sets, as column expressions over arrays."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

RELATIONS = ["Equal", "Disjoint", "Intersecting", "Subset", "Superset"]


def relation(truth: Column, found: Column) -> Column:
    """How two arrays relate as sets. An empty ``found`` beside a filled ``truth`` is Disjoint, the other way round Subset."""
    more, less = F.size(F.array_except(truth, found)), F.size(F.array_except(found, truth))
    return (
        F.when((more == 0) & (less == 0), "Equal").when(F.size(found) == 0, "Disjoint").when(more == 0, "Subset").when(less == 0, "Superset")
        .when(F.arrays_overlap(truth, found), "Intersecting").otherwise("Disjoint")
    )


def rolled_up(relations: Column) -> Column:
    """One relation for a case from those of its parts: the only one there is, else Intersecting; of none, Equal."""
    kinds = F.array_distinct(relations)
    return F.when(F.size(kinds) == 0, "Equal").when(F.size(kinds) == 1, F.element_at(kinds, 1)).otherwise("Intersecting")


def jaccard(a: Column, b: Column) -> Column:
    """Shared over all elements of two arrays as sets; two empty ones are alike."""
    every = F.size(F.array_union(a, b))
    return F.when(every == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)) / F.nullif(every, F.lit(0)))


def same_bag(a: Column, b: Column) -> Column:
    """Whether two arrays have the same elements as often, in any order."""
    return F.array_sort(a).eqNullSafe(F.array_sort(b))


def joined_lists(a: Column, b: Column) -> Column:
    """The distinct elements of two lists in order of their first place; null beside a list is nothing."""
    return F.coalesce(F.array_union(a, b), F.array_distinct(a), F.array_distinct(b))


def without(a: Column, b: Column) -> Column:
    """The elements of ``a`` that ``b`` lacks, repeats and order kept."""
    return F.filter(a, lambda x: ~F.array_contains(b, x))


def filled_range(lines: Column) -> Column:
    """Every number from the least to the greatest of an array; an empty array stays empty."""
    return F.when(F.size(lines) == 0, F.array().cast("array<int>")).otherwise(F.sequence(F.array_min(lines), F.array_max(lines)))


def holds_part(names: Column, part: Column) -> Column:
    """Whether some element of an array contains ``part`` as a substring."""
    return F.exists(names, lambda n: F.contains(n, part))


def merged_contexts(contexts: Column) -> Column:
    """Contexts joined by line feeds, each left out that what stands before contains already."""
    kept = F.aggregate(contexts, F.lit(""), lambda out, x: F.when(F.contains(out, x), out).otherwise(F.when(out == "", x).otherwise(F.concat(out, F.lit("\n"), x))))
    return kept
