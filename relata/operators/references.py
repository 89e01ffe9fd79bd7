"""References to records that don't exist (problem 3).

References are counted per key and period first, combined within tasks. Keys with more references than a fixed share of
a mean task are heavy; there can only be so many of them, and they are checked against a broadcast of what is known
of them. All other keys go through shuffled anti joins. The orphan counts of both are united. Where the references
themselves are asked for, the orphan keys are joined back in the same two ways.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from relata.functions.titles import canonical_title, present
from relata.session import reliable, table

#: A key is heavy from this share of the references of a mean task on. With p tasks at most p / HEAVY_SHARE keys are.
HEAVY_SHARE = 1 / 16
#: A key with fewer references is never heavy.
LEAST_HEAVY = 100


def counted(refs: DataFrame, period: Column) -> DataFrame:
    """(target, tab, ym, refs, first, last): references per key, table and period, with the times of the first and the last."""
    return refs.groupBy("target", "tab", period.alias("ym")).agg(
        F.count(F.lit(1)).alias("refs"), F.min("seen").alias("first"), F.max("seen").alias("last")
    )


def heavy_keys(counts: DataFrame, share: float = HEAVY_SHARE, least: int = LEAST_HEAVY) -> DataFrame:
    """(target) of the heavy keys of ``counts``: at most 1 / share for each task of a shuffle, whatever the data."""
    tasks = int(counts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    total = counts.agg(F.sum("refs")).first()[0] or 0
    limit = max(least, total * share / tasks)
    return counts.groupBy("target").agg(F.sum("refs").alias("refs")).where(F.col("refs") >= limit).select("target")


def orphan_keys(counts: DataFrame, targets: DataFrame, deletions: DataFrame, heavy: DataFrame) -> DataFrame:
    """(target, tab, ym, refs, first, last, why, since, is_heavy): the counts of keys whose record is missing, deleted or late.

    Late groups are those with a reference before ``since``, the time from which the record exists; of these some
    references may be later. targets: (target, since), one row a key; deletions: (target), distinct.
    """
    some = F.broadcast(heavy)  # bounded, see heavy_keys
    many = counts.join(some, "target", "left_semi")
    known = F.broadcast(targets.join(some, "target", "left_semi").withColumn("here", F.lit(True)))
    gone = F.broadcast(deletions.join(some, "target", "left_semi").withColumn("gone", F.lit(True)))
    late = F.col("since") > F.col("first")
    why = F.when(late, "late").when(F.col("here"), None).when(F.col("gone"), "deleted").otherwise("missing")
    of_heavy = many.join(known, "target", "left").join(gone, "target", "left").withColumn("why", why).where("why is not null").drop("here", "gone")

    few = counts.join(some, "target", "left_anti")
    absent = few.join(targets.select("target"), "target", "left_anti")
    absent = absent.join(deletions.withColumn("gone", F.lit(True)), "target", "left").select(
        *counts.columns, F.when(F.col("gone"), "deleted").otherwise("missing").alias("why"), F.lit(None).cast("timestamp").alias("since")
    )
    tardy = few.join(targets, "target").where(late).select(*counts.columns, F.lit("late").alias("why"), "since")
    of_light = absent.unionByName(tardy)
    return of_heavy.select(*of_light.columns, F.lit(True).alias("is_heavy")).unionByName(of_light.withColumn("is_heavy", F.lit(False)))


def _with_why(refs: DataFrame, orphans: DataFrame) -> DataFrame:
    """The references of orphan keys with why; of late keys those before ``since``."""
    keys = orphans.select("target", "why", "since", "is_heavy").distinct()
    heavy = keys.where("is_heavy").drop("is_heavy")
    of_heavy = refs.join(F.broadcast(heavy), "target")
    rest = refs.join(F.broadcast(heavy.select("target")), "target", "left_anti")
    of_light = rest.join(keys.where("not is_heavy").drop("is_heavy"), "target")
    return of_heavy.unionByName(of_light).where("why <> 'late' or since > seen")


def orphan_references(refs: DataFrame, targets: DataFrame, deletions: DataFrame, share: float = HEAVY_SHARE, least: int = LEAST_HEAVY) -> DataFrame:
    """References whose target is missing, deleted or arrives later.

    refs: (tab, src_id, target, seen), one row per reference. targets: (target, since), one row per existing key.
    deletions: (target), distinct. Result: (tab, src_id, target, why, seen), why being ``late`` if the target exists
    only after the reference was seen, ``deleted`` if it never exists but was deleted, else ``missing``.
    Null keys must be dropped before. A reference without a time is never late; a target without a time exists from
    the beginning. Empty tables give the empty result or, without targets, only missing and deleted ones.
    """
    refs = reliable(refs)
    counts = reliable(counted(refs, _month(F.col("seen"))))
    orphans = reliable(orphan_keys(counts, targets, deletions, reliable(heavy_keys(counts, share, least))))
    return _with_why(refs, orphans).select("tab", "src_id", "target", "why", "seen")


def orphan_counts(refs: DataFrame, targets: DataFrame, deletions: DataFrame, share: float = HEAVY_SHARE, least: int = LEAST_HEAVY) -> DataFrame:
    """(tab, why, ym, refs, targets): orphan references per table, reason and month, from the counts alone.

    Only the references of keys whose record arrives within the very month are looked at one by one.
    """
    refs = reliable(refs)
    counts = reliable(counted(refs, _month(F.col("seen"))))
    orphans = reliable(orphan_keys(counts, targets, deletions, reliable(heavy_keys(counts, share, least))))
    mixed = (F.col("why") == "late") & ~F.coalesce(F.col("since") > F.col("last"), F.lit(True))
    whole = orphans.where(~mixed).select("tab", "why", "ym", "target", "refs")
    split = orphans.where(mixed).select("target", "why", "since", "is_heavy").distinct()
    months = orphans.where(mixed).select("target", "tab", "ym")
    each = _with_why(refs, split).withColumn("ym", _month(F.col("seen"))).groupBy("tab", "why", "ym", "target").agg(F.count(F.lit(1)).alias("refs"))
    each = each.join(months, ["target", "tab", "ym"], "left_semi").select(*whole.columns)
    # A key stands once in each group of (tab, why, ym), so its rows count it.
    return whole.unionByName(each).groupBy("tab", "why", "ym").agg(F.sum("refs").alias("refs"), F.count(F.lit(1)).alias("targets"))


def _month(time: Column) -> Column:
    return F.date_format(time, "yyyy-MM")


def _inputs(spark, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    loaded = F.col("loaded").cast("timestamp")
    links = table(spark, sf_dir, "links").select(
        F.lit("links").alias("tab"), "src_id", canonical_title(F.col("target_title")).alias("target"), loaded.alias("seen")
    )
    links = links.where(~F.lower("target").startswith("image:"))
    pages = table(spark, sf_dir, "pages")
    moved = pages.where("redirect is not null").select(
        F.lit("pages").alias("tab"), F.col("id").alias("src_id"), canonical_title(F.col("redirect")).alias("target"), loaded.alias("seen")
    )
    # Repeats of a reference count once, at the first time it was seen: combined map-side, before any join.
    refs = (
        links.unionByName(moved)
        .where(present(F.col("target")))
        .groupBy("tab", "src_id", "target")
        .agg(F.min("seen").alias("seen"))
    )
    targets = (
        pages.select(canonical_title(F.col("title")).alias("target"), loaded.alias("since"))
        .where(present(F.col("target")))
        .groupBy("target")
        .agg(F.min("since").alias("since"))
    )
    deletions = (
        table(spark, sf_dir, "deletions")
        .select(canonical_title(F.col("title")).alias("target"))
        .where(present(F.col("target")))
        .distinct()
    )
    return refs, reliable(targets), deletions


def p3_found(spark, sf_dir: str) -> DataFrame:
    found = orphan_references(*_inputs(spark, sf_dir))
    return found.select("tab", "src_id", "target", "why", _month(F.col("seen")).alias("ym"))


def p3_report(spark, sf_dir: str) -> DataFrame:
    return orphan_counts(*_inputs(spark, sf_dir))


_CANON = "trim(regexp_replace(split_part({0}, '#', 1), '[\\s_\\x{{a0}}]+', ' ', 'g'))"

_REFS_SQL = f"""
refs as (
  select tab, src_id, target, min(loaded) as seen from (
    select 'links' as tab, src_id, {_CANON.format('target_title')} as target, loaded from links
    union all
    select 'pages', id, {_CANON.format('redirect')}, loaded from pages where redirect is not null)
  where target <> '' and not (tab = 'links' and lower(target) like 'image:%')
  group by all),
targets as (
  select {_CANON.format('title')} as target, min(loaded) as since from pages
  where {_CANON.format('title')} <> '' group by 1),
gone as (select distinct {_CANON.format('title')} as target from deletions),
found as (
  select r.tab, r.src_id, r.target,
    case when t.since > r.seen then 'late' when t.target is not null then null
         when g.target is not null then 'deleted' else 'missing' end as why, r.seen
  from refs r left join targets t using (target) left join gone g using (target))
"""

SQL = {
    "p3_found": f"with {_REFS_SQL} select tab, src_id, target, why, strftime(seen, '%Y-%m') as ym from found where why is not null",
    "p3_report": f"with {_REFS_SQL} select tab, why, strftime(seen, '%Y-%m') as ym, count(*) as refs, count(distinct target) as targets"
    " from found where why is not null group by all",
}
