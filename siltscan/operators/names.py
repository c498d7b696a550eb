"""Names of inodes as of a position of the scan, and what was moved or renamed.

All state concerns one inode: of each (inode, generation) the first name is taken, and a directory entry replaces it
only by a shorter one, while a reference never does. So the name as of a position is a minimum over what came before, by
(length, position), and a window over the inode's events gives it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _claim(kind: Column, pos: Column, first: Column, name: Column) -> Column:
    """What an event may set the name to, ordered by which wins; null if it can't. Length counts code points."""
    return F.when((kind != "INODE_REF") | (pos == first), F.struct(F.length(name).alias("n"), pos.alias("pos"), name.alias("name")))


def distinct_events(events: DataFrame) -> DataFrame:
    """The first of each (inode, gen, kind, name), summed up before the shuffle: copies of a node, and the directories that
    every subvolume has, add no rows to the windows. Later ones never change a name."""
    return events.groupBy("inode", "gen", "kind", "name").agg(F.min("pos").alias("pos"))


def resolved(probes: DataFrame, events: DataFrame) -> DataFrame:
    """``probes`` (pos, inode, gen and more) with ``filename``.

    The name of the same inode and generation; else that of the generation of the inode's first event; else
    ``inode_N``; each as of the probe's position. One shuffle by inode serves all windows.
    """
    extra = [c for c in probes.columns if c not in ("pos", "inode", "gen")]
    rows = probes.select("pos", "inode", "gen", F.struct(*extra, F.lit(1).alias("__probe")).alias("rest")).unionByName(
        distinct_events(events), allowMissingColumns=True
    )
    rows = rows.repartition("inode")
    key, inode = Window.partitionBy("inode", "gen"), Window.partitionBy("inode")
    event = F.col("kind").isNotNull()
    rows = rows.withColumn("first", F.min(F.when(event, F.col("pos"))).over(key))
    rows = rows.withColumn("c", F.when(event, _claim(F.col("kind"), F.col("pos"), F.col("first"), F.col("name"))))
    rows = rows.withColumn("g0", F.min(F.when(event, F.struct("pos", "gen"))).over(inode)["gen"])
    before = (Window.unboundedPreceding, -1)
    rows = rows.withColumn("own", F.min("c").over(key.orderBy("pos").rowsBetween(*before)))
    rows = rows.withColumn("other", F.min(F.when(F.col("gen") == F.col("g0"), F.col("c"))).over(inode.orderBy("pos").rowsBetween(*before)))
    name = F.coalesce(F.col("own.name"), F.col("other.name"), F.concat(F.lit("inode_"), F.col("inode").cast("string")))
    return rows.where(~event).select("pos", "inode", "gen", *[F.col("rest")[c].alias(c) for c in extra], name.alias("filename"))


def changes(events: DataFrame) -> DataFrame:
    """The events that set a name: (inode, gen, name, since, until, first); in force after ``since``, up to and at ``until``.

    Far fewer than the events, as a name only changes to a shorter one, so copies of a node add nothing.
    """
    key = Window.partitionBy("inode", "gen")
    rows = distinct_events(events).repartition("inode").withColumn("first", F.min("pos").over(key))
    rows = rows.withColumn("c", _claim(F.col("kind"), F.col("pos"), F.col("first"), F.col("name")))
    rows = rows.withColumn("best", F.min("c").over(key.orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)))
    rows = rows.where(F.col("c").isNotNull() & (F.col("best").isNull() | (F.col("c") < F.col("best"))))
    until = F.lead("pos").over(key.orderBy("pos"))
    return rows.select("inode", "gen", "name", F.col("pos").alias("since"), until.alias("until"), "first")


def moves(events: DataFrame) -> DataFrame:
    """(pos, inode, original_path, current_path): directory entries whose inode already goes by another name.

    The other name is that of the first generation, in order of first event, whose name differs just before the entry.
    An interval join on the inode: each entry meets the names in force at its position, one per generation.
    """
    seen = events.where("kind <> 'INODE_REF'").select("pos", "inode", "name").alias("p")
    held = changes(events).alias("q")
    on = (
        (F.col("p.inode") == F.col("q.inode")) & (F.col("q.since") < F.col("p.pos")) & (F.col("q.until").isNull() | (F.col("p.pos") <= F.col("q.until")))
        & (F.col("q.name") != F.col("p.name"))
    )
    hits = seen.join(held, on).groupBy("p.pos", "p.inode", "p.name").agg(F.min_by("q.name", "q.first").alias("current_path"))
    return hits.select("pos", "inode", F.col("name").alias("original_path"), "current_path")


def final_names(events: DataFrame) -> DataFrame:
    """(inode, gen, name) when the scan has ended."""
    return changes(events).where("until IS NULL").select("inode", "gen", "name")
