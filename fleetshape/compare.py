"""The comparison of a whole fleet, wired from the operators."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetshape.operators import columns as C
from fleetshape.operators import constraints as K
from fleetshape.operators import objects as O
from fleetshape.operators.matching import touched, union_all
from fleetshape.plans.ordering import stored

CONSTRAINT_RELATIONS = tuple(K.KINDS)


@dataclass
class FleetDiff:
    """Lazy DataFrames of one comparison.

    `src` and `tgt` are relation dicts scoped by `pair_id` (see `objects.attach_side`). A pair with a key that
    repeats on one side cannot be compared: it is refused as a whole, appears in `rejects` alone, and no
    result has rows of it. That list is written when it is first needed; all else runs when it is consumed.
    """

    pairs: DataFrame
    src: dict[str, DataFrame]
    tgt: dict[str, DataFrame]

    @cached_property
    def rejects(self) -> DataFrame:
        """Object keys that repeat: pair_id, side, obj_key, copies."""
        return stored(O.repeated_keys(self.src["objects"], self.tgt["objects"]), "rejects")

    @cached_property
    def accepted(self) -> DataFrame:
        """The pairs that are compared."""
        return self.pairs.join(self.rejects.select("pair_id").distinct(), "pair_id", "left_anti")

    @cached_property
    def matched(self) -> DataFrame:
        return O.match_objects(self.src["objects"], self.tgt["objects"]).join(self.rejects.select("pair_id").distinct(), "pair_id", "left_anti")

    @cached_property
    def tables(self) -> DataFrame:
        return O.comparable_tables(self.matched, self.accepted)

    @cached_property
    def columns(self) -> DataFrame:
        return C.match_columns(self.src["columns"], self.tgt["columns"], self.tables)

    @cached_property
    def column_diff(self) -> DataFrame:
        return C.diff_columns(self.columns)

    def share(self) -> FleetDiff:
        """Writes what several results start from: the comparable tables, the differing columns and items. Worth it for more than one result.

        The tables that are touched are told from what was written: no hashes of all columns and items are compared besides.
        """
        self.tables = stored(self.tables, "tables")
        self.column_diff = stored(self.column_diff, "columns")
        differing = [self.column_diff.select("pair_id", "obj_key")]
        if self.has_constraints:
            self.constraint_diff = stored(self.constraint_diff, "items")
            # What only steps aside is no change, nor is an item whose facets are unknown.
            differing.append(self.constraint_diff.where("s is null or t is null or s.facets <> t.facets").select("pair_id", "obj_key"))
        self.touched = union_all(differing).distinct()
        return self

    @cached_property
    def has_constraints(self) -> bool:
        return any(name in self.src for name in CONSTRAINT_RELATIONS)

    @cached_property
    def table_summary(self) -> DataFrame:
        return C.table_summary(self.tables, self.column_diff)

    def _diff_constraints(self, text: bool) -> DataFrame:
        matched = K.match_constraints(
            K.constraint_items(self.src, text), K.constraint_items(self.tgt, text), self.table_summary)
        return K.diff_constraints(matched)

    @cached_property
    def constraint_diff(self) -> DataFrame:
        return self._diff_constraints(text=True)

    @cached_property
    def constraint_changes(self) -> DataFrame:
        """The same without statement text."""
        return self._diff_constraints(text=False)

    @cached_property
    def item_changes(self) -> DataFrame:
        """Items that differ, without those that only step aside for a column: columns are not read."""
        bare = self.tables.withColumn("rewritten_cols", F.lit(None).cast("array<string>"))
        return K.diff_constraints(K.match_constraints(K.constraint_items(self.src, False), K.constraint_items(self.tgt, False), bare))

    @cached_property
    def touched(self) -> DataFrame:
        """Tables with a change or a warning, told from hashes: whatever differs is one or the other."""
        def compared(side: dict[str, DataFrame]) -> DataFrame:
            columns = C.compared_columns(side["columns"])
            return columns.unionByName(K.compared_items(side)) if self.has_constraints else columns

        return touched(compared(self.src), compared(self.tgt))

    @cached_property
    def table_counts(self) -> DataFrame:
        """Changes and warnings of tables that have any. What steps aside for a column counts for nothing, so items
        need no word from the columns here: columns are compared once."""
        parts = [self.column_diff.select("pair_id", "obj_key", "changes", "warnings")]
        if self.has_constraints:
            matched = K.match_constraints(K.counted_items(self.src), K.counted_items(self.tgt), self.tables)
            parts.append(K.count_items(matched))
        return union_all(parts).groupBy("pair_id", "obj_key").agg(
            F.sum("changes").alias("changes"), F.sum("warnings").alias("warnings")).where("changes > 0 or warnings > 0")

    @cached_property
    def steps(self) -> DataFrame:
        """Every step and warning inside compared tables, one row each."""
        own = C.column_steps(self.column_diff)
        return union_all([own, K.constraint_steps(self.constraint_diff)]) if self.has_constraints else own

    @cached_property
    def actions(self) -> DataFrame:
        counts = self.touched.withColumns({"changes": F.lit(1), "warnings": F.lit(0)})
        return O.classify_objects(self.matched, self.accepted, counts)

    @cached_property
    def drift(self) -> DataFrame:
        return O.drift(self.accepted, self.actions)
