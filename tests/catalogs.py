"""Small catalogs for the tests: many cases become one fleet, one pair per case.

An item of a table is a pair (relation, row). Rows follow the relation's own fields: what a test
does not name is false, zero or null, by type.
"""

from __future__ import annotations

from dataclasses import dataclass

from fleetshape.compare import FleetDiff
from fleetshape.model import RELATION_FIELDS, relation_schema

RELATIONS = ("objects", "columns", "keys", "foreign_keys", "checks", "indexes")
_EMPTY = {"boolean": False, "integer": 0, "short": 0, "byte": 0, "long": 0}


def item(relation, **given):
    fields = RELATION_FIELDS[relation]
    assert set(given) <= set(fields), set(given) - set(fields)
    return relation, {f: given.get(f, _EMPTY.get(kind.typeName())) for f, kind in fields.items()}


def column(name, type_name="int", **facets):
    return item("columns", **{"name": name, "type_schema": "sys", "type_name": type_name, "is_nullable": True, **facets})


def spots(names, included=(), descending=()):
    """Index columns in the order of a text of names."""
    return [{"name": n, "key_ordinal": i, "index_column_id": i, "is_included": n in included, "is_descending": n in descending}
            for i, n in enumerate(names.split(), 1)]


def key(name, names, **facets):
    return item("keys", **{"name": name, "type_code": "PK", "index_type_desc": "CLUSTERED", "columns": spots(names), **facets})


def index(name, names, included=(), descending=(), **facets):
    return item("indexes", **{"name": name, "type_desc": "NONCLUSTERED", "columns": spots(names, included, descending), **facets})


def reference(name, parent, table_name, referenced, **facets):
    pairs = [{"parent_column": p, "referenced_column": r} for p, r in zip(parent.split(), referenced.split())]
    return item("foreign_keys", **{"name": name, "referenced_schema": "store", "referenced_table": table_name, "delete_action": "NO_ACTION",
                                   "update_action": "NO_ACTION", "columns": pairs, **facets})


def table(name, *items, schema="store", definition=None, model=True):
    return {"obj_type": "Table", "schema_name": schema, "obj_name": name, "has_model": model, "items": items,
            "definition": definition or f"{schema}.{name} with {len(items)} items"}


def module(kind, name, definition, schema="store"):
    return {"obj_type": kind, "schema_name": schema, "obj_name": name, "has_model": False, "items": (), "definition": definition}


@dataclass
class Case:
    source: list
    target: list
    include_drops: bool = False
    include_table_drops: bool = False
    allow_rebuild: bool = False
    add_only: bool = False


def side(spark, scoped, scope="pair_id"):
    """Relations of (scope id, objects) pairs."""
    rows = {name: [] for name in RELATIONS}
    for scope_id, objects in scoped:
        for obj in objects:
            rows["objects"].append({scope: scope_id, **{k: v for k, v in obj.items() if k != "items"}})
            place = dict.fromkeys(RELATIONS, 0)
            for relation, row in obj["items"]:
                place[relation] += 1
                rows[relation].append({**row, scope: scope_id, "schema_name": obj["schema_name"], "table_name": obj["obj_name"],
                                       "ordinal": place[relation]})
    return {name: spark.createDataFrame(data, relation_schema(name, scope)) for name, data in rows.items()}


def fleet(spark, cases):
    """FleetDiff over cases by number; the case's position is its pair id."""
    options = ("include_drops", "include_table_drops", "allow_rebuild", "add_only")
    schema = "pair_id long, source_name string, target_name string, " + ", ".join(f"{o} boolean" for o in options)
    cases = list(cases)
    pairs = spark.createDataFrame([(i, "Plan", "Live", *(getattr(c, o) for o in options)) for i, c in enumerate(cases)], schema)
    return FleetDiff(pairs, *(side(spark, [(i, getattr(c, s)) for i, c in enumerate(cases)]) for s in ("source", "target")))
