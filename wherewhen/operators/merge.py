"""Survivorship merge of a refresh into a directory.

A sequential program folds the new rows into a dictionary one after the other.
Here each new row is routed to a target (an existing id, an existing name
without id, or itself), and all rows of a target, old and new, are folded into
one by a single aggregate. It combines before the shuffle, so it does not matter
how many rows hit one target. Routes are found on ids and names alone; whole rows
move twice, to their route and to their target.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ..functions.text import filled
from ..schema import EXTRACTED_COLUMNS
from .keyed import splittable_join, spread_key


def _truthy(name: str, kind: str) -> Column:
    """Neither NULL, nor empty, nor zero."""
    value = F.col(name)
    return filled(value) if kind == "string" else F.coalesce(value != 0, F.lit(False))


def _prefixed(mark: str, value: Column) -> Column:
    return F.concat(F.lit(mark), value)


def _claims(keyed: DataFrame, known_ids: DataFrame, legacy: DataFrame) -> DataFrame:
    """``__route, __home``: ids that a name without id goes to, and that mean that name's row from then on.

    A name goes to the first new id that carries it and is not known; other ids of
    the name are new places.
    """
    fresh = keyed.where("__name IS NOT NULL").join(known_ids, keyed["__id"] == known_ids["place_id"], "left_anti")
    named = fresh.select("__name", F.struct("__seq", "__id").alias("__claim"), F.lit(False).alias("__is_legacy")).unionByName(
        legacy.select("__name", F.lit(True).alias("__is_legacy")), allowMissingColumns=True
    )
    claimed = named.groupBy("__name").agg(F.min("__claim").alias("__claim"), F.max("__is_legacy").alias("__is_legacy"))
    return (
        claimed.where("__is_legacy AND __claim IS NOT NULL").select("__claim.__id", "__claim.__seq", "__name")
        .groupBy("__id").agg(F.min(F.struct("__seq", "__name"))["__name"].alias("__home"))
        .select(_prefixed("i:", F.col("__id")).alias("__route"), "__home")
    )


def _claimed_rows(keyed: DataFrame, known_ids: DataFrame, legacy: DataFrame) -> DataFrame:
    """``__route, __home``: rows with an id that a name claims all the same, as a sequential merge would do.

    An id joins the keyed rows with its first row that no name claims.
    """
    named = keyed.withColumn("__name", spread_key(F.col("__name"), F.col("__seq")))
    rows = splittable_join(named, legacy.distinct().withColumn("__is_legacy", F.lit(True)), "__name")
    marked = rows.select("__id", "__seq", "__name", F.coalesce("__is_legacy", F.lit(False)).alias("__is_legacy"))
    ids = marked.select("__id", F.when(~F.col("__is_legacy"), F.col("__seq")).alias("__append")).unionByName(
        known_ids.select(F.col("place_id").alias("__id"), F.lit(True).alias("__known")), allowMissingColumns=True
    ).groupBy("__id").agg(F.min("__append").alias("__append"), F.max("__known").alias("__known"))
    found = splittable_join(marked.where("__is_legacy"), ids, "__id")
    late = F.col("__known").isNotNull() | F.coalesce(F.col("__seq") >= F.col("__append"), F.lit(False))
    return found.where(~late).select(_prefixed("s:", F.col("__seq").cast("string")).alias("__route"), F.col("__name").alias("__home"))


def _route(new: DataFrame, existing: DataFrame, compat: bool) -> DataFrame:
    """Adds ``target`` to the new rows."""
    ids, names = F.nullif(F.col("place_id"), F.lit("")), F.nullif(F.col("restaurant_name"), F.lit(""))
    known_ids = existing.filter(filled(F.col("place_id"))).select("place_id")
    legacy = existing.filter(~filled(F.col("place_id")) & filled(F.col("restaurant_name"))).select(F.col("restaurant_name").alias("__name"))
    keyed = new.select(ids.alias("__id"), names.alias("__name"), "__seq").where("__id IS NOT NULL")
    claims = (_claimed_rows if compat else _claims)(keyed, known_ids, legacy)
    by_name = legacy.distinct().select(_prefixed("n:", F.col("__name")).alias("__route"), F.col("__name").alias("__home"))
    with_id = _prefixed("s:", F.col("__seq").cast("string")) if compat else _prefixed("i:", ids)
    route = F.when(ids.isNotNull(), with_id).otherwise(_prefixed("n:", names))
    rows = new.withColumn("__route", spread_key(route, F.col("__seq")))
    routed = splittable_join(rows, claims.unionByName(by_name), "__route")
    own = F.coalesce(_prefixed("id:", ids), _prefixed("row:", F.col("__seq").cast("string")))
    return routed.withColumn("target", F.coalesce(_prefixed("name:", F.col("__home")), own)).drop("__route", "__home")


def survivorship_merge(
    existing: DataFrame, new: DataFrame, order: str = "ord", prune: bool = False, compat: bool = False,
    extracted: tuple[str, ...] = EXTRACTED_COLUMNS, date_column: str = "freshness_date",
) -> DataFrame:
    """Merge ``new`` into ``existing``; both have ``place_id``, ``restaurant_name`` and ``order``.

    Rules per column, for the rows that meet in one target, oldest first: an
    ordinary column takes the last value that is not NULL (an empty text does
    overwrite), an extracted column the last one that is neither NULL, empty
    nor zero, and the date always the last row's. ``prune`` drops existing ids
    that no new row has; rows without id stay.

    Adds ``action`` (``kept``, ``updated``, ``added``), ``upgraded`` (a row
    without id got one), ``n_updates``, and ``section``/``appended``/
    ``position``, which give the output order: keyed rows by first appearance,
    then rows known by name only.

    ``compat`` lets all new rows of a name fold into the existing row of that
    name even when their ids differ, as a sequential merge would; by default
    only the first id does and the others are places of their own.
    """
    columns = [c for c in existing.columns if c != order]
    kinds = dict(existing.dtypes)
    has_id, has_name = filled(F.col("place_id")), filled(F.col("restaurant_name"))
    # Rows with neither id nor name have no target and are dropped.
    old = existing.withColumnRenamed(order, "__seq").withColumn(
        "target",
        F.when(has_id, F.concat(F.lit("id:"), F.col("place_id"))).when(
            has_name, F.concat(F.lit("name:"), F.col("restaurant_name"))
        ),
    ).filter(F.col("target").isNotNull())
    incoming = _route(new.withColumnRenamed(order, "__seq"), existing, compat)
    rows = old.select("target", "__seq", *columns, F.lit(False).alias("__new")).unionByName(
        incoming.select("target", "__seq", *columns, F.lit(True).alias("__new"))
    )
    is_new = F.col("__new")

    def last(name: str) -> Column:
        value = F.col(name)
        if name == date_column or (name == "place_id" and compat):
            return F.max_by(F.struct(value), F.when(is_new, F.col("__seq"))).alias(f"__last_{name}")
        if name in extracted:
            allowed = _truthy(name, kinds[name])
        elif name == "place_id":
            allowed = filled(value)
        else:
            allowed = value.isNotNull()
        # NULL order values are left out, so this is the last admissible value.
        return F.max_by(F.struct(value), F.when(is_new & allowed, F.col("__seq"))).alias(f"__last_{name}")

    # A repeated old target keeps its first position and its last row.
    both = rows.groupBy("target").agg(
        F.max(F.when(~is_new, F.struct("__seq", *columns))).alias("old"),
        F.min(F.when(~is_new, F.col("__seq"))).alias("__pos"),
        F.min_by(F.struct(*columns), F.when(is_new, F.col("__seq"))).alias("first"),
        *[last(c) for c in columns],
        F.count_if(is_new).alias("__n_new"),
        F.min(F.when(is_new, F.col("__seq"))).alias("__first_new"),
    )
    known, touched = F.col("old").isNotNull(), F.col("first").isNotNull()

    def survivor(name: str) -> Column:
        # Without an admissible value the oldest row of the target stands as it is.
        oldest = F.when(known, F.col(f"old.{name}")).otherwise(F.col(f"first.{name}"))
        newest = F.col(f"__last_{name}")
        return F.when(newest.isNotNull(), newest[name]).otherwise(oldest).alias(name)

    by_name = F.startswith("target", F.lit("name:"))
    out = both.select(
        *[survivor(c) for c in columns],
        F.when(~known, "added").when(touched, "updated").otherwise("kept").alias("action"),
        (F.col("__n_new") - (~known).cast("int")).alias("n_updates"),
        by_name.cast("int").alias("section"),
        (~known).cast("int").alias("appended"),
        F.coalesce("__pos", "__first_new").alias("position"),
    ).withColumn("upgraded", (F.col("section") == 1) & filled(F.col("place_id")))
    # New rows of a known id always meet it, so an id no new row has is one that
    # was not touched.
    return out.filter(~_stale()) if prune else out


def _stale() -> Column:
    return (F.col("section") == 0) & (F.col("action") == "kept")


def _metrics(prune: bool) -> list[Column]:
    stale = _stale() if prune else F.lit(False)
    return [
        F.coalesce(F.sum("n_updates"), F.lit(0)).alias("updated"),
        F.count_if(F.col("action") == "added").alias("added"),
        F.count_if(F.col("upgraded")).alias("upgraded"),
        F.count_if(stale).alias("pruned"),
        F.count_if(~stale).alias("total"),
    ]


def observed_merge(
    existing: DataFrame, new: DataFrame, observation: Observation, order: str = "ord", prune: bool = False, **options
) -> DataFrame:
    """``survivorship_merge`` whose figures are taken by the run that writes it.

    Once that is through, ``observation.get`` has updated, added, upgraded, pruned and total.
    """
    merged = survivorship_merge(existing, new, order, **options).observe(observation, *_metrics(prune))
    return merged.filter(~_stale()) if prune else merged


def merge_metrics(
    existing: DataFrame, new: DataFrame, order: str = "ord", prune: bool = False, **options
) -> DataFrame:
    """One row: updates applied, rows added, rows upgraded, rows pruned, rows left. ``observed_merge`` has them beside the merge."""
    return survivorship_merge(existing, new, order, **options).agg(*_metrics(prune))


def restore_skipped(fetched: DataFrame, existing: DataFrame, skipped: DataFrame) -> DataFrame:
    """Append existing rows whose id was skipped and that the fetch did not return."""
    ids = skipped.select("place_id").filter(filled(F.col("place_id"))).distinct()
    seen = fetched.select("place_id").filter(filled(F.col("place_id"))).distinct()
    kept = splittable_join(existing.filter(filled(F.col("place_id"))), ids, "place_id", "left_semi")
    kept = splittable_join(kept, seen, "place_id", "left_anti").select(*existing.columns)
    return fetched.unionByName(kept)
