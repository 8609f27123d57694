"""Prompt rendering: a text template with named slots becomes one string Column."""

from __future__ import annotations

from string import Formatter

from pyspark.sql import Column
from pyspark.sql import functions as F


def render(template: str, slots: dict[str, Column]) -> Column:
    """Fill ``{name}`` slots; ``{{`` and ``}}`` stand for single braces.

    The template is taken apart once on the driver, so each row is a single ``concat`` of
    literals and columns. A null slot renders as the empty string rather than a null prompt.
    """
    parts: list[Column] = []
    for literal, name, spec, conversion in Formatter().parse(template):
        if literal:
            parts.append(F.lit(literal))
        if name is None:
            continue
        if spec or conversion:
            raise ValueError(f"format options are not supported in slot {name!r}")
        if name not in slots:
            raise KeyError(f"no value for prompt slot {name!r}")
        parts.append(F.coalesce(slots[name].cast("string"), F.lit("")))
    return F.concat(*parts) if parts else F.lit("")
