"""Format strings of the info line and of town labels, compiled to columns.

A bad format raises ValueError when it is compiled.
"""

from __future__ import annotations

import re
import string

from pyspark.sql import Column
from pyspark.sql import functions as F

from waytrace.functions.scalar import leading_zeros

NUMBER = re.compile(r"(0?)(\d*)(?:\.(\d+))?([fd])")
TEXT = re.compile(r"([<>]?)(\d*)s?")
SEGMENTS = "array<struct<text:string,is_dim:boolean>>"


def formatted(value: Column, spec: str, numeric: bool) -> Column:
    if numeric and spec:
        found = NUMBER.fullmatch(spec)
        if not found:
            raise ValueError(f"number format {spec!r}")
        zero, width, places, kind = found.groups()
        places = int(places or (6 if kind == "f" else 0))
        text = F.format_string(f"%.{places}f", value) if places else F.bround(value, 0).cast("bigint").cast("string")
        if not width:
            return text
        if not zero:
            return F.when(F.length(text) < int(width), F.lpad(text, int(width), " ")).otherwise(text)
        sign = F.when(F.startswith(text, F.lit("-")), "-").otherwise("")
        bare = F.substr(text, F.length(sign) + 1)
        return F.when(F.length(text) < int(width), F.concat(sign, F.lpad(bare, F.lit(int(width)) - F.length(sign), F.lit("0")))).otherwise(text)
    found = TEXT.fullmatch(spec)
    if numeric and not spec:
        return value.cast("string")
    if not found:
        raise ValueError(f"text format {spec!r}")
    side, width = found.groups()
    text = value.cast("string")
    if not width:
        return text
    pad = F.lpad if side == ">" else F.rpad
    return F.when(F.length(text) < int(width), pad(text, int(width), " ")).otherwise(text)


def _parts(template: str, fields: set[str]) -> list[tuple[str, str | None, str]]:
    out = []
    for literal, name, spec, _ in string.Formatter().parse(template):
        if name is not None and name not in fields:
            raise ValueError(f"unknown field {name!r}")
        out.append((literal, name, spec or ""))
    return out


def segments(template: str, numbers: dict[str, Column], texts: dict[str, Column]) -> Column:
    """(text, is_dim) pieces; the leading zeros of numbers are dim."""
    pieces: list[Column] = []
    piece = lambda text, is_dim: F.struct(text.alias("text"), F.lit(is_dim).alias("is_dim"))
    for literal, name, spec in _parts(template, set(numbers) | set(texts)):
        if literal:
            pieces.append(piece(F.lit(literal), False))
        if name in numbers:
            halves = leading_zeros(formatted(numbers[name], spec, True))
            pieces += [piece(halves["dim"], True), piece(halves["bright"], False)]
        elif name is not None:
            pieces.append(piece(formatted(texts[name], spec, False), False))
    return F.filter(F.array(*pieces), lambda p: ~(p["is_dim"] & (p["text"] == ""))) if pieces else F.array().cast(SEGMENTS)


def joined(template: str, texts: dict[str, Column]) -> Column:
    """The template as one text."""
    parts = [F.lit("")]
    for literal, name, spec in _parts(template, set(texts)):
        parts.append(F.lit(literal))
        if name is not None:
            parts.append(formatted(texts[name], spec, False))
    return F.concat(*parts)


def ass_text(pieces: Column, dim: str = "{\\c&H808080&}", bright: str = "{\\c&HFFFFFF&}") -> Column:
    """One text, with a colour tag wherever dimness changes."""
    start = F.struct(F.lit("").alias("out"), F.lit(None).cast("boolean").alias("now"))

    def step(acc: Column, p: Column) -> Column:
        tag = F.when(acc["now"].eqNullSafe(p["is_dim"]), "").otherwise(F.when(p["is_dim"], dim).otherwise(bright))
        return F.struct(F.concat(acc["out"], tag, p["text"]).alias("out"), p["is_dim"].alias("now"))

    return F.aggregate(pieces, start, step, lambda acc: acc["out"])
