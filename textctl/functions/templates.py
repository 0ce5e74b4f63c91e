"""Template rendering as one native ``concat`` expression.

A template is plain text with ``{slot}`` marks. It is split into literal
and slot parts once, on the driver, when the expression is built; the
data is never searched for marks, so text that happens to contain
``{base_text}`` is copied as is (no chained ``replace``). A family of
templates keyed by a column (task, chat family, ...) compiles to one
``CASE`` over ``concat`` expressions: no join, no Python per row.
"""

from __future__ import annotations

from string import Formatter

from pyspark.sql import Column
from pyspark.sql import functions as F


def parts(template: str) -> list[tuple[str, str | None]]:
    """Split ``template`` into ``(literal, slot)`` pairs."""
    out = []
    for literal, field, spec, conv in Formatter().parse(template):
        if spec or conv:
            raise ValueError(f"format spec not supported in template slot {field!r}")
        out.append((literal, field if field is not None else None))
    return out


def slots(template: str) -> list[str]:
    return [s for _, s in parts(template) if s is not None]


def render(template: str, values: dict[str, Column]) -> Column:
    """``concat`` of the literal parts and the slot columns of ``template``."""
    pieces: list[Column] = []
    for literal, slot in parts(template):
        if literal:
            pieces.append(F.lit(literal))
        if slot is not None:
            if slot not in values:
                raise KeyError(f"template slot {slot!r} has no column")
            pieces.append(values[slot])
    if not pieces:
        return F.lit("")
    return pieces[0] if len(pieces) == 1 else F.concat(*pieces)


def render_by(key: Column, templates: dict[str, str], values: dict[str, Column], default: Column | None = None) -> Column:
    """One ``CASE key WHEN name THEN render(template) ... ELSE default END``."""
    out = None
    for name, template in templates.items():
        branch = render(template, values)
        out = F.when(key == F.lit(name), branch) if out is None else out.when(key == F.lit(name), branch)
    if out is None:
        return default if default is not None else F.lit(None).cast("string")
    return out.otherwise(default) if default is not None else out
