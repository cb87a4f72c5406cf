"""Offence category of a heading, decided by its prefix."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from vigia.model import CATEGORY_PREFIXES, OTHER_CATEGORY


def is_category(heading: Column, label: str) -> Column:
    """Three-valued test: null for a null heading, for the remaining category too."""
    if label == OTHER_CATEGORY:
        return reduce(and_, (~heading.startswith(p) for p in CATEGORY_PREFIXES.values()))
    return heading.startswith(CATEGORY_PREFIXES[label])


def in_categories(heading: Column, labels: Iterable[str]) -> Column | None:
    """Any of the labels; labels that do not exist are ignored, None when none is left."""
    known = [x for x in (*CATEGORY_PREFIXES, OTHER_CATEGORY) if x in set(labels)]
    if not known:
        return None
    return reduce(or_, (is_category(heading, x) for x in known))


def category_of(heading: Column) -> Column:
    """Label of the category. A null heading counts as the remaining category here."""
    return F.coalesce(
        *(F.when(heading.startswith(p), F.lit(x)) for x, p in CATEGORY_PREFIXES.items()),
        F.lit(OTHER_CATEGORY),
    )
