"""Warnings and notices as lines: a level, a code, and what it is about."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _line(template: str, *parts: Column) -> Column:
    """`template` with each `{}` replaced by the next column."""
    texts = template.split("{}")
    out = [F.lit(texts[0])]
    for part, text in zip(parts, texts[1:], strict=True):
        out += [part, F.lit(text)]
    return F.concat(*out)


def add_not_null(name: Column) -> Column:
    return _line("-- warning add_not_null [{}]", name)


def identity_differs(name: Column) -> Column:
    return _line("-- warning identity [{}]", name)


def becomes_not_null(name: Column) -> Column:
    return _line("-- warning not_null [{}]", name)


def narrows(name: Column, before: Column, after: Column) -> Column:
    return _line("-- warning narrower [{}] {} -> {}", name, before, after)


def column_kept(name: Column) -> Column:
    return _line("-- warning column_kept [{}]", name)


def column_dropped(name: Column) -> Column:
    return _line("-- warning column_lost [{}]", name)


def item_kept(label: Column, name: Column) -> Column:
    return _line("-- warning item_kept {} [{}]", label, name)


def table_skipped(ident: Column) -> Column:
    return _line("-- warning table_skipped {}", ident)


def table_kept(ident: Column) -> Column:
    return _line("-- warning table_kept {}", ident)


ADD_ONLY_NOTICE = "-- info add_only_keeps_all"
CYCLE_NOTICE = "-- warning dependency_cycle"


def history_skipped(ident: Column) -> Column:
    return _line("skipped {}: history_table", ident)


def versioned(ident: Column) -> Column:
    return _line("{}: versioned_table", ident)


def index_skipped(name: Column, ident: Column, type_desc: Column) -> Column:
    return _line("skipped index [{}] on {}: index_kind {}", name, ident, type_desc)
