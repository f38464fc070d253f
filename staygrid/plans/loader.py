"""Loading named concepts of a source as one lazy plan.

Item concepts of the same table share one scan: the scan is filtered to all
wanted items, each row is tagged with its concept, and one grouped aggregation
reduces it to (id, t, concept). Derived concepts are then computed on the wide
grid, which is much smaller than the source.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from staygrid.functions.scalars import any_known
from staygrid.functions.times import floor_to, seconds_between
from staygrid.functions.units import UNITLESS, unit_key_column, unit_steps
from staygrid.operators import cohort, select
from staygrid.operators.aggregate import BY_COUNTS, aggregator, by_counts
from staygrid.operators.grid import expand_windows
from staygrid.operators.merge import merge_wide
from staygrid.operators.rules import Roles, apply_rule, helpers, rewrites
from staygrid.plans import derived, modules
from staygrid.plans.derived import Context
from staygrid.plans.spec import LENGTH_OF_STAY, Catalogue, Concept, Item
from staygrid.schema import HOUR
from staygrid.session import settle

TEXT_KINDS = ("fct", "chr")
EXACT = "_exact"  # seconds with their fraction, which order the rows of one second


@dataclass(frozen=True)
class SourceLayout:
    """Column names a source uses by default, and its stay table.

    ``stays`` has the id, the admission time (origin) and the end of the stay.
    ``time_unit`` seconds make one unit of a numeric time column.
    """

    name: str
    id: str
    read: Callable[[str], DataFrame]
    time: str = "charttime"
    value: str = "value"
    item: str = "itemid"
    unit: str | None = None
    stays: str | None = None
    intime: str = "intime"
    outtime: str = "outtime"
    time_unit: int | None = None
    roles: dict[str, str] = field(default_factory=dict)


@dataclass
class Loader:
    """Concept loading for one source.

    ``units`` says what becomes of a row whose unit is not one of its concept's: ``convert`` (the default) converts what the unit
    table can and keeps the rest as it is, ``strict`` drops the rest, ``ignore`` looks at no unit. Rows without a unit are kept.
    ``unit_report`` and ``level_report`` count what was found.
    """

    spark: SparkSession
    catalogue: Catalogue
    layout: SourceLayout
    interval: int = HOUR
    settle_grid: bool = True
    units: str = "convert"

    ids = ["id"]
    time = "t"

    # --- item concepts ---------------------------------------------------------

    def _sources(self, concept: Concept) -> tuple[Item, ...]:
        return concept.sources.get(self.layout.name, ())

    def _roles(self, item: Item) -> Roles:
        named = {**self.layout.roles, **{k: v for k, v in item.params.items() if k in Roles.__dataclass_fields__}}
        return replace(Roles(tuple(self.ids), self.time), **named)

    def _rows(self, table: str, items: list[tuple[str, Item]], wanted: DataFrame | None) -> DataFrame:
        """Rows of the wanted items of one table with canonical columns and a concept tag."""
        first, lay = items[0][1], self.layout
        item_col = first.item or lay.item
        id_col, time_col = first.id or lay.id, first.time or lay.time
        value_col, unit_col = first.value or lay.value, first.unit or lay.unit
        df = lay.read(table)
        listed = sorted({i for _, it in items for i in it.items}, key=str)
        patterns = [it.pattern for _, it in items if it.pattern]
        if listed or patterns:
            hit = F.col(item_col).isin(listed) if listed else F.lit(False)
            for p in patterns:
                hit = hit | F.coalesce(F.col(item_col).rlike("(?i)" + p), F.lit(False))
            df = df.where(hit)
        if wanted is not None:
            df = df.join(wanted.select(F.col("id").alias(id_col)).distinct(), id_col, "left_semi")
        if lay.stays and first.id is None and lay.id not in df.columns:
            raise ValueError(f"{table} has no {lay.id}; give the item an id column")
        df = self._with_seconds(df, id_col, [c for c in (time_col, first.stop) if c and c in df.columns], time_col)
        tagged = self._tagged(df, item_col, items)
        renames = {id_col: "id", value_col: "value"}
        if time_col in df.columns:
            renames[time_col] = self.time
        if unit_col and unit_col in df.columns:
            renames[unit_col] = "unit"
        if item_col in df.columns and item_col not in renames:
            renames[item_col] = "item"
        if first.stop:
            renames[first.stop] = "stop"
        if first.dur:
            renames[first.dur] = "dur"
        return tagged.withColumnsRenamed({k: v for k, v in renames.items() if k != v})

    def _tagged(self, df: DataFrame, item_col: str, items: list[tuple[str, Item]]) -> DataFrame:
        """Each row with the concept it belongs to; an item may serve several concepts."""
        pairs = sorted({(i, name) for name, it in items for i in it.items}, key=str)
        parts = []
        if pairs:
            # one row per item named in the spec, whatever the size of the data
            kind = df.schema[item_col].dataType.simpleString()
            listed = self.spark.createDataFrame(pairs, f"_item {kind}, concept string")
            parts.append(df.join(F.broadcast(listed), F.col(item_col) == F.col("_item")).drop("_item"))
        tags = [
            F.when(F.col(item_col).rlike("(?i)" + it.pattern), F.lit(name)) if it.pattern else F.lit(name)
            for name, it in items if not it.items
        ]
        if tags:
            parts.append(df.withColumn("concept", F.explode(F.filter(F.array(*tags), lambda x: x.isNotNull()))))
        return reduce(DataFrame.unionByName, parts)

    def _with_seconds(self, df: DataFrame, id_col: str, times: list[str], main: str | None = None) -> DataFrame:
        """Times as whole seconds since admission; of the ``main`` one the fraction is kept aside."""
        lay = self.layout
        if not times:
            return df
        if lay.time_unit is not None:
            exact = {EXACT: (F.col(main) * lay.time_unit).cast("double")} if main in times else {}
            return df.withColumns({**exact, **{c: F.floor(F.col(c) * lay.time_unit) for c in times}})
        if lay.stays is None:
            return df
        origin = lay.read(lay.stays).select(F.col(lay.id).alias(id_col), F.col(lay.intime).alias("_origin"))
        # one row per stay is hashed where it is shuffled, so that the source's rows are not sorted for it
        exact = {EXACT: F.timestamp_diff("MICROSECOND", F.col("_origin"), F.col(main)) / F.lit(1_000_000)} if main in times else {}
        return df.join(origin.hint("shuffle_hash"), id_col).withColumns({**exact, **{c: seconds_between("_origin", c) for c in times}}).drop("_origin")

    def _helped(self, rows: DataFrame, items: list[tuple[str, Item]], wanted: DataFrame | None) -> DataFrame:
        """Rows with the values of other concepts that their rules read, null where this source has none.

        A weight is the stay's first, one row per id; a value of a time is that of the row's interval.
        """
        needed = {(h, getattr(self._roles(it), h[0])) for _, it in items if it.rule for h in helpers(it.rule)}
        for (_, name, timed), column in sorted(needed):
            if column in rows.columns:
                continue
            source = self.catalogue[name] if name in self.catalogue else None
            if source is None or not self._sources(source):
                rows = rows.withColumn(column, F.lit(None).cast("double"))
            elif timed:
                values = self.long([name], wanted).select("id", F.col("t").alias("_at"), F.col("value").alias(column))
                rows = rows.withColumn("_at", floor_to("t", self.interval)).join(values, ["id", "_at"], "left").drop("_at")
            else:
                rows = rows.join(self.static([name], wanted)[name].withColumnRenamed(name, column), "id", "left")
        return rows

    def _ruled(
        self, rows: DataFrame, items: list[tuple[str, Item]], wanted: DataFrame | None = None, text: bool = False
    ) -> list[tuple[DataFrame, str | None]]:
        """Rules applied. Row-wise rules keep one scan; others get a branch each."""
        for name, it in items:
            if it.untranslated:
                raise ValueError(f"{name}: write the rule of {it.table} as a named rule: {it.untranslated}")
        branches: list[tuple[DataFrame, str | None]] = []
        shared = []
        for name, it in items:
            if it.rule and rewrites(it.rule) is None:
                params = {k: v for k, v in it.rule.items() if k != "rule"}
                mine = self._helped(rows.where(F.col("concept") == name), [(name, it)], wanted)
                own = apply_rule(mine, self._roles(it), it.rule["rule"], **params)
                branches.append((own.withColumn("concept", F.lit(name)), it.target))
            else:
                shared.append((name, it))
        if shared:
            common = self._helped(rows.where(F.col("concept").isin([n for n, _ in shared])), shared, wanted)
            branches.append((self._row_rules(common, shared, text), None))
        return branches

    def _row_rules(self, rows: DataFrame, shared: list[tuple[str, Item]], text: bool = False) -> DataFrame:
        """Every row-wise rule works on its own copy of the columns; the concept picks the copy."""
        parts = {"value": "value", "unit": "unit", "time": "t", "dur": "dur"}
        by_rule: dict[str, tuple[Item, list[str]]] = {}
        for name, it in shared:
            if it.rule:
                by_rule.setdefault(repr((it.rule, it.params)), (it, []))[1].append(name)
        columns = {i: [p for p in parts if p in rewrites(it.rule)] for i, (it, _) in enumerate(by_rule.values())}
        none = F.lit(None).cast("string")
        copies = rows.select("*", *[
            (F.col(parts[p]) if parts[p] in rows.columns else none).alias(f"_{p}{i}") for i, ps in columns.items() for p in ps
        ])
        for i, (it, _) in enumerate(by_rule.values()):
            own = replace(self._roles(it), **{p: f"_{p}{i}" for p in columns[i]})
            copies = apply_rule(copies, own, it.rule["rule"], **{k: v for k, v in it.rule.items() if k != "rule"})
        kinds = dict(copies.dtypes)

        def picked(part: str) -> Column:
            here = [(i, names) for i, (_, names) in enumerate(by_rule.values()) if part in columns[i]]
            old = parts[part] if parts[part] in rows.columns else None
            types = {kinds[f"_{part}{i}"] for i, _ in here} | ({kinds[old]} if old else set())

            def typed(c: str) -> Column:
                if part != "value" or len(types) == 1:
                    return F.col(c)
                if text:
                    return F.col(c).cast("string")
                return F.col(c).try_cast("double") if kinds[c] == "string" else F.col(c).cast("double")

            chain = F
            for i, names in here:
                chain = chain.when(F.col("concept").isin(names), typed(f"_{part}{i}"))
            return chain.otherwise(typed(old)) if old else chain

        changed = {p for ps in columns.values() for p in ps}
        kept = [c for c in rows.columns if c not in {parts[p] for p in changed}]
        return copies.select(*kept, *[picked(p).alias(parts[p]) for p in parts if p in changed])

    # --- units and levels --------------------------------------------------------

    def _with_unit_rules(self, rows: DataFrame, concepts: list[Concept]) -> DataFrame:
        """Each row with the steps from its unit to the concept's unit, null where the unit does not lead there, and whether the
        concept's units are known at all.

        The rules are one row per concept and spelling, whatever the data.
        """
        known = [c for c in concepts if c.units and c.kind not in TEXT_KINDS]
        rules = [(c.name, key, *rule) for c in known for key, rule in unit_steps(list(c.units), c.name).items()]
        table = self.spark.createDataFrame(rules, "_of string, _spelled string, _before double, _factor double, _divisor double, _after double")
        table = table.withColumn("_own", F.expr("_before = 0 AND _factor = _divisor AND _after = 0"))
        text = F.lower(F.trim(F.col("unit").cast("string")))
        keyed = rows.withColumns({
            "_unit": unit_key_column(text), "_bare": F.coalesce(text.isin(list(UNITLESS)), F.lit(True)), "_checked": F.col("concept").isin([c.name for c in known])})
        return keyed.join(F.broadcast(table), (F.col("concept") == F.col("_of")) & (F.col("_unit") == F.col("_spelled")), "left")

    def _harmonised(self, rows: DataFrame, concepts: list[Concept]) -> DataFrame:
        """Values in the unit of their concept."""
        if self.units == "ignore" or "unit" not in rows.columns or not any(c.units and c.kind not in TEXT_KINDS for c in concepts):
            return rows
        ruled = self._with_unit_rules(rows, concepts)
        if self.units == "strict":
            ruled = ruled.where(~F.col("_checked") | F.col("_bare") | F.col("_factor").isNotNull())
        value = F.col("value")
        number = value.try_cast("double") if rows.schema["value"].dataType.simpleString() == "string" else value.cast("double")
        changed = F.when(~F.col("_own"), (number + F.col("_before")) * F.col("_factor") / F.col("_divisor") + F.col("_after"))
        return ruled.withColumn("value", F.coalesce(changed.cast(rows.schema["value"].dataType), value)).select(*rows.columns)

    def _in_levels(self, rows: DataFrame, concepts: list[Concept]) -> DataFrame:
        """Rows of categorical concepts whose value is one of the concept's levels."""
        wrong = [(F.col("concept") == c.name) & ~F.col("value").cast("string").isin([str(x) for x in c.levels]) for c in concepts if c.levels and c.kind in TEXT_KINDS]
        return rows.where(~reduce(lambda a, b: a | b, wrong)) if wrong else rows

    def _branches(self, names: list[str], wanted: DataFrame | None, text: bool) -> list[tuple[DataFrame, str | None]]:
        """Rows of the concepts after their rules, one frame per table and kind of rule."""
        by_table: dict[tuple, list[tuple[str, Item]]] = {}
        for n in names:
            for it in self._sources(self.catalogue[n]):
                key = (it.table, it.id, it.time, it.value, it.unit, it.item, it.stop, it.dur)
                by_table.setdefault(key, []).append((n, it))
        return [b for (table, *_), items in by_table.items() for b in self._ruled(self._rows(table, items, wanted), items, wanted, text)]

    def unit_report(self, names: list[str], wanted: DataFrame | None = None) -> DataFrame:
        """Rows per concept and unit as given, with what becomes of them: ``own``, ``converted``, ``bare`` (no unit) or ``foreign``."""
        concepts = [self.catalogue[n] for n in names]
        parts = [df for df, _ in self._branches(names, wanted, False) if "unit" in df.columns]
        if not parts:
            return self.spark.createDataFrame([], "concept string, unit string, found string, n long")
        rows = reduce(DataFrame.unionByName, [df.select("concept", F.col("unit").cast("string").alias("unit")) for df in parts])
        found = (
            F.when(F.col("_factor").isNotNull(), F.when(F.col("_own"), "own").otherwise("converted"))
            .when(F.col("_bare"), "bare").otherwise("foreign")
        )
        return self._with_unit_rules(rows, concepts).where("_checked").groupBy("concept", "unit", found.alias("found")).agg(F.count(F.lit(1)).alias("n"))

    def level_report(self, names: list[str], wanted: DataFrame | None = None) -> DataFrame:
        """Rows per categorical concept and value, with whether the value is one of the concept's levels."""
        concepts = [self.catalogue[n] for n in names if self.catalogue[n].levels]
        levels = [(c.name, str(x)) for c in concepts for x in c.levels]
        rows = [df.select("concept", F.col("value").cast("string").alias("value")) for df, _ in self._branches([c.name for c in concepts], wanted, True)]
        if not rows:
            return self.spark.createDataFrame([], "concept string, value string, known boolean, n long")
        table = self.spark.createDataFrame(levels, "_of string, _level string")  # a row per level of the spec
        counts = reduce(DataFrame.unionByName, rows).where("value IS NOT NULL").groupBy("concept", "value").agg(F.count(F.lit(1)).alias("n"))
        hit = counts.join(F.broadcast(table), (F.col("concept") == F.col("_of")) & (F.col("value") == F.col("_level")), "left")
        return hit.select("concept", "value", F.col("_of").isNotNull().alias("known"), "n")

    # --- aggregation ---------------------------------------------------------------

    def _slot(self, concepts: list[Concept], step: int, fixed: list[str]) -> Column:
        """The start of a row's half-open interval: the grid's, or the concept's own where that is longer."""
        by_length: dict[int, list[str]] = {}
        for c in concepts:
            length = max(c.seconds or 0, self.interval if c.name in fixed else step)
            if length != step:
                by_length.setdefault(length, []).append(c.name)
        out = floor_to("t", step)
        for seconds, names in by_length.items():
            out = F.when(F.col("concept").isin(names), floor_to("t", seconds)).otherwise(out)
        return out

    def long(self, names: list[str], wanted: DataFrame | None = None, interval: int | None = None,
             aggregate: dict[str, str] | str | None = None, text: bool = False, fixed: list[str] | None = None) -> DataFrame | None:
        """(id, t, concept, value): in the concept's unit and levels, aggregated per interval, then bounded.

        The ``fixed`` concepts keep the loader's interval and their own aggregate, whatever is asked for the others.
        """
        step = interval or self.interval
        concepts = [self.catalogue[n] for n in names]
        how = {c.name: c.how if c.name in (fixed or ()) else self._how(c, aggregate) for c in concepts}
        parts = []
        for df, target in self._branches(names, wanted, text):
            df = self._in_levels(df, concepts) if text else self._harmonised(df, concepts)
            if "t" not in df.columns:
                df = df.withColumn("t", F.lit(None).cast("long"))
            if target == "win_tbl":
                df = df.withColumn("dur", F.col("dur").cast("long"))
                df = expand_windows(df, ["id", "concept"], "t", "dur", "value", step)
            value = F.col("value").cast("string") if text else F.col("value").try_cast("double")
            exact = F.col(EXACT) if EXACT in df.columns else F.col("t").cast("double")
            parts.append(df.select("id", "t", "concept", value.alias("value"), exact.alias(EXACT)))
        if not parts:
            return None
        rows = reduce(DataFrame.unionByName, parts).where(F.col("value").isNotNull())
        used = sorted(set(how.values()))
        keys = ["id", self._slot(concepts, step, fixed or []).alias("t"), "concept"]
        if not text and "median" in used and set(used) <= BY_COUNTS:
            aggs = by_counts(rows, keys, "value", {f"_{h}": h for h in used})
            aggs = aggs.withColumns({f"_{h}": F.col(f"_{h}").cast("double") for h in used})
        else:
            aggs = rows.groupBy(*keys).agg(
                *[aggregator(h, "value", ["t", EXACT]).cast("string" if text else "double").alias(f"_{h}") for h in used]
            )
        chosen = F.coalesce(*[
            F.when(F.col("concept").isin([n for n, f in how.items() if f == h]), F.col(f"_{h}")) for h in used
        ])
        out = aggs.select("id", "t", "concept", chosen.alias("value"))
        return out if text else self._bounded(out, concepts)

    @staticmethod
    def _how(c: Concept, aggregate: dict[str, str] | str | None) -> str:
        if isinstance(aggregate, str):
            return aggregate
        return (aggregate or {}).get(c.name, c.how)

    @staticmethod
    def _bounded(df: DataFrame, concepts: list[Concept]) -> DataFrame:
        """Bounds apply to the aggregated value."""
        ok = F.lit(True)
        for c in concepts:
            mine, v = F.col("concept") == c.name, F.col("value")
            if c.low is not None:
                ok = ok & ~(mine & (v < c.low))
            if c.high is not None:
                ok = ok & ~(mine & (v > c.high))
        return df.where(ok)

    # --- static concepts ---------------------------------------------------------

    def length_of_stay(self, name: str) -> DataFrame:
        """Days between the ends of the stay."""
        lay = self.layout
        days = F.timestamp_diff("SECOND", F.col(lay.intime), F.col(lay.outtime)) / 86_400.0
        return lay.read(lay.stays).select(F.col(lay.id).alias("id"), days.alias(name)).where(F.col(name) >= 0)

    def _is_stay_length(self, name: str) -> bool:
        return any(it.rule == {"rule": LENGTH_OF_STAY} for it in self._sources(self.catalogue[name]))

    @staticmethod
    def _first_values(long: DataFrame, names: list[str]) -> DataFrame:
        """One row per id with the earliest value of each concept."""
        def first(n: str) -> Column:
            mine = F.col("concept") == n
            return F.min_by(F.when(mine, F.col("value")), F.when(mine, F.struct(F.coalesce("t", F.lit(0)), "value"))).alias(n)

        return long.groupBy("id").agg(*[first(n) for n in names])

    def static(self, names: list[str], wanted: DataFrame | None = None) -> dict[str, DataFrame]:
        """One row per id for each static concept."""
        out = {}
        for n in names:
            c = self.catalogue[n]
            if self._is_stay_length(n) or not self._sources(c):
                if (self._is_stay_length(n) or n.startswith("los_")) and self.layout.stays:
                    out[n] = self.length_of_stay(n)
                continue
            out[n] = self._first_values(self.long([n], wanted, text=c.kind in TEXT_KINDS, fixed=[n]), [n]).where(F.col(n).isNotNull())
        return out

    # --- the wide plan -------------------------------------------------------------

    def load(
        self, names: list[str], wanted: DataFrame | None = None, interval: int | None = None,
        aggregate: dict[str, str] | str | None = None, window: int = 24 * HOUR, keep_components: bool = False,
        compat: bool = False, **options,
    ) -> DataFrame:
        """Named concepts, wide: one row per id and interval, one column per concept.

        ``wanted`` is a frame of ids. Further options go to the derivations.
        """
        step = interval or self.interval
        names = [self._resolve(n) for n in names]
        needed = [n for n in self.catalogue.order(names)]
        static = [n for n in needed if self._is_static(n)]
        items = [n for n in needed if n not in static and self._sources(self.catalogue[n])]
        numeric = [n for n in items if self.catalogue[n].kind not in TEXT_KINDS]
        text = [n for n in items if n not in numeric]
        ctx = Context(self.ids, self.time, step, window, compat, options)

        # timed and static concepts of one kind come from one aggregation, so each table is read once for them
        wide, first = None, []
        for kind, timed in ((False, numeric), (True, text)):
            fixed = [n for n in static if self._sources(self.catalogue[n]) and not self._is_stay_length(n) and (self.catalogue[n].kind in TEXT_KINDS) == kind]
            long = self.long([*timed, *fixed], wanted, step, aggregate, text=kind, fixed=fixed)
            if timed and long is not None:
                grid = self._pivot(long, timed, "first" if kind else "max")
                grid = grid.dropna("all", subset=timed) if fixed else grid
                wide = grid if wide is None else wide.join(grid, ["id", "t"], "full")
            if fixed and long is not None:
                first.append(self._first_values(long, fixed).dropna("all", subset=fixed))
        first += [df for n, df in self.static([n for n in static if not self._sources(self.catalogue[n]) or self._is_stay_length(n)], wanted).items()]
        if wide is None and first:
            wide = reduce(lambda a, b: a.join(b, ["id"], "full"), first).withColumn("t", F.lit(None).cast("long"))
        else:
            wide = reduce(lambda a, b: a.join(b, ["id"], "left"), first, wide)
        if wide is None:
            raise ValueError(f"{self.layout.name} has none of: {', '.join(names)}")
        return self._derive(wide, names, [n for n in needed if n not in items and n not in static], ctx, keep_components)

    def _derive(self, wide: DataFrame, names: list[str], pending: list[str], ctx: Context, keep_components: bool) -> DataFrame:
        """Derived concepts in stages.

        Column derivations are chained on the wide frame. All row derivations
        whose inputs are ready are computed from one settled frame, stacked and
        joined to it once, so no stage repeats the scans of the stages before.
        """
        static = {n for n in names if self._is_static(n)}
        while pending:
            left = []
            for n in pending:
                c = self.catalogue[n]
                ready = not any(p in left for p in c.parts)
                if ready and c.derived in derived.COLUMNS:
                    wide = derived.COLUMNS[c.derived](wide, ctx, n, list(c.parts))
                elif ready and (c.derived not in derived.ROWS or not derived.possible(c.derived, c.parts, wide.columns)):
                    continue  # nothing to derive it from in this source
                else:
                    left.append(n)
            batch = [n for n in left if not any(p in left for p in self.catalogue[n].parts)]
            if not batch:
                break
            if self.settle_grid:
                wide = settle(wide)
            frames = {}
            for n in batch:
                c = self.catalogue[n]
                frames[n] = derived.ROWS[c.derived](wide, ctx, n, list(c.parts)).select("id", "t", n)
            pending = [n for n in left if n not in batch]
            if pending and not keep_components and set(names) <= set(pending) and all(self.catalogue[n].derived in derived.APART for n in pending):
                # stacked, not joined: the long grids of scores are neither shuffled nor sorted
                parts = {p for n in pending for p in self.catalogue[n].parts}
                old = [c for c in wide.columns if c in parts and c not in frames]
                known = [wide.select("id", "t", *old).where(any_known(*old))] if old else []
                wide = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [*frames.values(), *known])
                continue
            kinds = {n: df.schema[n].dataType for n, df in frames.items()}
            rows = next(iter(frames.values())) if len(frames) == 1 else merge_wide(frames, self.ids, self.time).select(
                "id", "t", *[F.col(n).cast(kinds[n]).alias(n) for n in frames])
            if not pending and set(names) <= set(frames) and not keep_components:
                return rows.select("id", "t", *names)
            wide = wide.join(rows, ["id", "t"], "full")
        keep = [n for n in names if n in wide.columns]
        if keep_components:
            keep += [p for n in names for p in self.catalogue[n].parts if p in wide.columns and p not in keep]
        timed = [n for n in keep if n not in static]
        out = wide.select("id", "t", *keep)
        return out.dropna("all", subset=timed) if timed else out

    def _resolve(self, name: str) -> str:
        seen = set()
        while name in self.catalogue and self.catalogue[name].forward and name not in seen:
            seen.add(name)
            name = self.catalogue[name].forward
        return name

    def _is_static(self, name: str) -> bool:
        c = self.catalogue[name]
        return c.derived is None and (c.target == "id_tbl" or name in modules.STATIC)

    @staticmethod
    def _pivot(long: DataFrame | None, names: list[str], how: str = "max") -> DataFrame | None:
        if long is None or not names:
            return None
        return long.groupBy("id", "t").agg(*[aggregator(how, F.when(F.col("concept") == n, F.col("value")), ["value"]).alias(n) for n in names])

    def load_tables(self, names: list[str], wanted: DataFrame | None = None, **kwargs) -> dict[str, DataFrame]:
        """The same as one table per concept."""
        wide = self.load(names, wanted, **kwargs)
        return {n: wide.select("id", "t", n).dropna(subset=[n]) for n in names if n in wide.columns}

    # --- presets --------------------------------------------------------------------

    def available(self, names: list[str]) -> list[str]:
        return [n for n in names if n in self.catalogue and self.catalogue.available(n, self.layout.name)]

    def load_module(self, module: str, wanted: DataFrame | None = None, **kwargs) -> DataFrame:
        return self.load(self.available(modules.module_concepts(module)), wanted, **kwargs)

    def load_vitals(self, wanted: DataFrame | None = None, **kwargs) -> DataFrame:
        return self.load(self.available(modules.VITALS), wanted, **kwargs)

    def load_labs(self, wanted: DataFrame | None = None, **kwargs) -> DataFrame:
        return self.load(self.available(modules.LABS), wanted, **kwargs)

    def load_sofa(self, wanted: DataFrame | None = None, **kwargs) -> DataFrame:
        return self.load(["sofa"], wanted, **kwargs)

    def load_sofa2(self, wanted: DataFrame | None = None, **kwargs) -> DataFrame:
        return self.load(["sofa2"], wanted, **kwargs)

    def load_sepsis3_sofa2(self, wanted: DataFrame | None = None, **kwargs) -> DataFrame:
        return self.load(["sep3_sofa2"], wanted, **kwargs)

    def load_sepsis3(self, wanted: DataFrame | None = None, **kwargs) -> DataFrame:
        return self.load(["sep3"], wanted, **kwargs)

    def load_filtered(
        self, names: list[str], demographics: DataFrame, criteria: cohort.Criteria, sepsis: DataFrame | None = None, **kwargs
    ) -> DataFrame:
        """Concepts of a cohort; the id list restricts the scans before any aggregation."""
        wanted = cohort.filter_cohort(demographics, criteria, sepsis).select(F.col("patient_id").alias("id"))
        return self.load(names, wanted, **kwargs)

    def sample(self, table: str, n: int, seed: int | None = None) -> DataFrame:
        ids = self.layout.read(table).select(F.col(self.layout.id).alias("id"))
        return select.sample_ids(ids, "id", n, seed)

    def quick_summary(self, wanted: DataFrame | None = None) -> DataFrame:
        """One row: ids, vital and laboratory rows, mean SOFA and sepsis rows."""
        aggs = {
            "patients": ("hr", lambda: F.countDistinct(F.when(F.col("hr").isNotNull(), F.col("id")))),
            "vitals_records": ("hr", lambda: F.count("hr")),
            "lab_records": ("wbc", lambda: F.count("wbc")),
            "sofa_mean": ("sofa", lambda: F.avg("sofa")),
            "sepsis_positive": ("sep3", lambda: F.sum("sep3")),
        }
        names = self.available(["hr", "wbc", "sofa", "sep3"])
        wide = self.load(names, wanted)
        return wide.agg(*[make().cast("double").alias(out) for out, (n, make) in aggs.items() if n in names])


def merge_sources(frames: dict[str, DataFrame]) -> DataFrame:
    """Results of several sources with a source column."""
    tagged = [df.withColumn("source", F.lit(name)) for name, df in frames.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged)


__all__ = ["Loader", "SourceLayout", "merge_sources"]
