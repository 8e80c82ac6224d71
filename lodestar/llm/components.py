"""Connected components of a link table, and of the links found among the members of buckets.

All state is in DataFrames; the driver sees counts only.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import cut, drop, small

#: Pairs a member that a join may look at, which costs little, as its condition keeps nearly none.
CHEAP = 200
#: Members of a bucket on either side that one task compares with each other at most; larger buckets are dealt out in a grid.
CELL = 1_000
#: Links that one task solves at most, in some 100 MB. More are contracted by joins.
MOST_IN_TASK = 1_000_000


def components(links: DataFrame, most_in_task: int = MOST_IN_TASK) -> DataFrame:
    """links (a, b) -> (id, label): the smallest id reachable, for every id that has a link.

    Null ends and loops are ignored; an empty table gives an empty table. A link table of checked
    size is solved by one task, a larger one by rounds of joins, as all are if most_in_task is 0.
    """
    links = links.where("a <> b").select("a", "b")
    if not most_in_task or links.limit(most_in_task + 1).count() > most_in_task:
        return contracted(links)
    return cut(links.coalesce(1).mapInArrow(solve, "id long, label long"), "labels")


def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held = [(x.column(0).to_numpy(), x.column(1).to_numpy()) for x in batches if x.num_rows]
    if not held:
        return
    ids, ends = np.unique(np.concatenate([np.concatenate(x) for x in zip(*held, strict=True)]), return_inverse=True)
    one, two = np.split(ends, 2)
    label = np.arange(len(ids))
    while True:
        low = np.minimum(label[one], label[two])
        before = label.copy()
        np.minimum.at(label, label[one], low)
        np.minimum.at(label, label[two], low)
        while (label != (up := label[label])).any():
            label = up
        if (label == before).all():
            break
    yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(ids[label], pa.int64())], ["id", "label"])


def contracted(links: DataFrame) -> DataFrame:
    """Each round gives every node its smallest neighbour as parent, follows parents twice and
    contracts the edges, so stars end in one round and chains in a logarithmic number. Minima are
    pre-aggregated: a hub with any number of links costs one row for each map task.
    """
    edges = cut(
        links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges"
    )
    assigned = None
    while not edges.isEmpty():
        both = edges.union(edges.select("b", "a"))
        parent = both.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.first("a")).alias("p"))
        parent = cut(parent, "parents")
        up = parent.select(F.col("id").alias("p"), F.col("p").alias("pp"))
        hop = parent.join(up, "p").select("id", F.col("pp").alias("p"))
        hop = cut(hop.join(up, "p").select("id", F.col("pp").alias("p")), "hops")
        if assigned is None:
            assigned = hop.select("id", F.col("p").alias("label"))
        else:
            moved = hop.select(F.col("id").alias("label"), "p")
            assigned = cut(
                assigned.join(moved, "label", "left").select("id", F.coalesce("p", "label").alias("label")), "labels"
            )
        left = hop.select(F.col("id").alias("a"), F.col("p").alias("pa"))
        right = hop.select(F.col("id").alias("b"), F.col("p").alias("pb"))
        edges = cut(
            edges.join(left, "a")
            .join(right, "b")
            .where("pa <> pb")
            .select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b"))
            .distinct(),
            "edges",
        )
    if assigned is None:
        return edges.select(F.col("a").alias("id"), F.col("b").alias("label"))
    return assigned


def linked(
    members: DataFrame,
    verify: Callable[[DataFrame], DataFrame],
    attributes: DataFrame,
    join_filter: Callable[[], Column],
    screen: Callable[[DataFrame], DataFrame] | None = None,
    alive: Callable[[], Column] | None = None,
    carried: bool = False,
    stars: int = 2,
    hubs: bool = False,
    pivots: int = 1,
    most_rounds: int = 8,
    cheap: int = CHEAP,
    most_in_task: int = MOST_IN_TASK,
    decided: tuple[DataFrame, Callable[[], Column]] | None = None,
) -> DataFrame:
    """Components of all verified links between members of a bucket, without emitting a bucket's pairs.

    members (key, id): distinct, at least two ids to a key. verify: pairs (a, b) -> the linked ones.
    attributes: (id, ...), one row an id. join_filter: a condition on them, prefixed l_ and r_, and
    on l_key, the bucket, that every link meets in some bucket.
    Star rounds compare each bucket's pivot with the members outside the pivot's component, which
    merges a group of near copies in time linear in its size. Then, in each bucket, only the
    members outside its largest component matter: each link still unknown has one of them. Further
    rounds compare these with that many pivots of the largest component.
    hubs: the first pivots are the members that meet most others in all their buckets. Where copies were each edited by
    themselves, that is the text they come from, which links with all of them, while they may not link with each other.
    carried: attributes are narrow and stand with the members in each bucket, so that the pairs of a round meet join_filter where they
    are made, and only those that do are dealt out; without it verify sees to that. The first pivot of a bucket then leaves it, as it has met all
    others there, so that buckets of two, which are most, are done with.
    decided: more attributes (id, ...) and a condition on them that says what verify does. The last pairs, which are close but
    mostly no links, are then decided where they meet, and only links are dealt out: of those with a bucket's largest component
    one for each member outside it, as more of them say the same.
    screen (nodes (id, label)) gives attributes that tell more, for join_filter too; alive is a condition on n, shared
    and n_lo, the least n of the bucket, that members with a link to another label meet. Once the
    pairs left are few against the members, all are verified, so the result equals that of
    verifying every pair; until then star rounds go on.
    """
    labels, links, stale, screened = None, None, 0, False
    if hubs:
        sizes = members.groupBy("key").agg(F.count("*").alias("n"))
        weights = members.join(sizes, "key").groupBy("id").agg(F.sum("n").alias("weight"))
        members = members.join(weights, "id")
    if carried:
        members = members.join(attributes, "id")
    if hubs or carried:
        members = cut(members, "weighted-members")
    size, columns = members.count(), members.columns
    facts_of = [c for c in attributes.columns if c != "id"] if carried else []

    def close(pairs: DataFrame) -> DataFrame:
        """Pairs (label, id, a) of a bucket, with a as (id, facts), that may be links."""
        pairs = pairs.select("id", F.col("a.id").alias("a"), *(F.col(f"{x}{c}").alias(f"{p}_{c}") for p, x in (("l", ""), ("r", "a.")) for c in facts_of))
        return (pairs.where(join_filter()) if carried else pairs).select(F.least("a", "id").alias("a"), F.greatest("a", "id").alias("b")).distinct()

    for turn in range(most_rounds):
        at = members.withColumn("label", F.col("id")) if labels is None else labelled(members, labels)
        order = F.xxhash64("id", F.lit(turn)) if turn else F.struct(-F.col("weight"), "id") if hubs else F.col("id")
        if turn < stars:
            heads = at.groupBy("key").agg(
                F.count("*").alias("n"), F.min("label").alias("lo"), F.max("label").alias("hi"), F.min_by(F.struct("id", "label", *facts_of), order).alias("a")
            )
            heads = heads.where("lo < hi").select("key", "a", "n", F.col("a.label").alias("la"))
            pairs = at.join(heads, "key").where("label <> la")
            if carried and labels is None:
                pairs = cut(pairs, "met")
                members = pairs.where("n > 2").select(*columns)
        else:
            slot = F.pmod(F.xxhash64("id", F.lit(turn), F.lit("slot")), F.lit(pivots))
            groups = at.groupBy("key", "label", slot.alias("slot")).agg(F.count("*").alias("n"), F.min_by(F.struct("id", *facts_of), order).alias("a"))
            groups = groups.groupBy("key", "label").agg(F.sum("n").alias("n"), F.collect_list("a").alias("a"))  # pivots at most
            tops = groups.groupBy("key").agg(
                F.count("*").alias("groups"), F.max_by(F.struct("label", "a"), F.struct("n", "label")).alias("top")
            )
            tops = tops.where("groups > 1").select("key", F.col("top.label").alias("la"), F.col("top.a").alias("a"))
            at = cut(at.join(tops, "key"), "unresolved")
            if screen is not None:
                if not screened:
                    attributes, screened = cut(screen(at.select("id", "label").distinct()), "screened"), True
            if alive is not None:
                facts = at.join(attributes.select("id", "n", "shared"), "id")
                least = facts.groupBy("key").agg(F.min("n").alias("n_lo"))
                facts = facts.join(least, "key").where((F.col("label") == F.col("la")) | alive())
                at = cut(facts.select(*at.columns), "unresolved")
            counts = at.groupBy("key").agg(F.count("*").alias("n"), F.count_if(F.col("label") != F.col("la")).alias("out"))
            left = counts.select(F.sum(F.col("n") * F.col("out"))).first()[0] or 0
            if left == 0:
                return labels
            if left <= cheap * size or stale >= 2 or turn == most_rounds - 1:
                break
            pairs = at.where("label <> la").withColumn("a", F.explode("a"))
        found = cut(verify(close(pairs)), "links")
        drop(members.sparkSession)  # the shuffles of this round
        if labels is not None and found.isEmpty():
            stale += 1
            continue
        stale = 0
        links = found if links is None else links.union(found)
        labels = components(links, most_in_task)
        drop(members.sparkSession)
    out, every = dealt(at, counts, attributes, facts_of)
    if decided is not None:
        meet = (F.col("l_key") == F.col("r_key")) & (F.col("l_cell") == F.col("r_cell")) & (F.col("l_label") != F.col("r_label")) & join_filter()
        # what says more, and is wide, is dealt out for members alone that may have a link here
        out = cut(out.join(every, meet, "left_semi"), "unresolved-out")
        every = cut(every.join(out, meet, "left_semi"), "unresolved-all")
        drop(members.sparkSession)
        ids = small(out.select(F.col("l_id").alias("id")).union(every.select("r_id")).distinct())
        told = cut(decided[0].join(ids, "id", "left_semi"), "told")
        out, every = (rows.join(prefixed(told, p), f"{p}_id") for rows, p in ((out, "l"), (every, "r")))
        return decided_links(out, every, links, labels, join_filter, decided[1], most_in_task)
    once = (F.col("l_label") != F.col("r_label")) & (F.col("r_top") | (F.col("l_id") < F.col("r_id")))
    pairs = out.join(every, (F.col("l_key") == F.col("r_key")) & (F.col("l_cell") == F.col("r_cell")) & once & join_filter())
    pairs = pairs.select(F.least("l_id", "r_id").alias("a"), F.greatest("l_id", "r_id").alias("b")).distinct()
    found = cut(verify(pairs), "links")
    return labels if found.isEmpty() else components(links.union(found), most_in_task)


def decided_links(out: DataFrame, every: DataFrame, links: DataFrame, labels: DataFrame, join_filter: Callable[[], Column], linked_: Callable[[], Column], most_in_task: int) -> DataFrame:
    """Components once each member outside a bucket's largest component has met all of the bucket: first that component, where one link
    is enough, then the others outside, of which those that the first have joined to it need not meet each other.
    """
    meet = (F.col("l_key") == F.col("r_key")) & (F.col("l_cell") == F.col("r_cell"))
    first = out.join(every.where("r_top"), meet & (F.col("l_label") != F.col("r_label")) & join_filter() & linked_(), "left_semi")
    first = cut(first.select(F.least("l_id", "l_la").alias("a"), F.greatest("l_id", "l_la").alias("b")).distinct(), "links")
    if not first.isEmpty():
        links = links.union(first)
        labels = components(links, most_in_task)
    now = {p: labels.select(F.col("id").alias(f"{p}_id"), F.col("label").alias(f"{p}_now")) for p in "lr"}
    out = out.join(now["l"], "l_id", "left").withColumn("l_now", F.coalesce("l_now", "l_id"))
    others = every.where("not r_top").join(now["r"], "r_id", "left").withColumn("r_now", F.coalesce("r_now", "r_id"))
    pairs = out.join(others, meet & (F.col("l_now") != F.col("r_now")) & (F.col("l_id") < F.col("r_id")) & join_filter() & linked_())
    found = cut(pairs.select(F.col("l_id").alias("a"), F.col("r_id").alias("b")).distinct(), "links")
    return labels if found.isEmpty() else components(links.union(found), most_in_task)


def dealt(at: DataFrame, counts: DataFrame, attributes: DataFrame, carried: list[str]) -> tuple[DataFrame, DataFrame]:
    """The members outside their bucket's top label, and all members, so that each of the first meets each of the second once.

    A bucket of many members is a grid of cells of CELL members a side: one of the first stands in
    each cell of its row, one of the second in each of its column. Attributes that are carried are columns of at.
    """
    parts = [F.ceil(F.col(c) / CELL).cast("int").alias(p) for c, p in (("out", "rows"), ("n", "columns"))]
    at = at.join(counts.where("out > 0").select("key", *parts), "key")
    row, column = F.pmod(F.xxhash64("id", F.lit("row")), F.col("rows")).cast("int"), F.pmod(F.xxhash64("id", F.lit("column")), F.col("columns")).cast("int")
    cells = F.transform(F.sequence(F.lit(0), F.col("columns") - 1), lambda c: F.col("rows") * c + row)
    out = at.where("label <> la").select(F.col("key").alias("l_key"), F.col("label").alias("l_label"), F.col("la").alias("l_la"), F.col("id").alias("l_id"), F.explode(cells).alias("l_cell"), *(F.col(c).alias(f"l_{c}") for c in carried))
    cells = F.transform(F.sequence(F.lit(0), F.col("rows") - 1), lambda r: F.col("rows") * column + r)
    every = at.select(F.col("key").alias("r_key"), F.col("label").alias("r_label"), F.col("id").alias("r_id"), (F.col("label") == F.col("la")).alias("r_top"), F.explode(cells).alias("r_cell"), *(F.col(c).alias(f"r_{c}") for c in carried))
    if carried:
        return out, every
    return out.join(prefixed(attributes, "l"), "l_id"), every.join(prefixed(attributes, "r"), "r_id")


def prefixed(rows: DataFrame, prefix: str) -> DataFrame:
    return rows.select(*(F.col(c).alias(f"{prefix}_{c}") for c in rows.columns))


def labelled(members: DataFrame, labels: DataFrame) -> DataFrame:
    return members.join(labels, "id", "left").withColumn("label", F.coalesce("label", "id"))
