"""Decision chains, event chains and reachability over links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from memlake.session import cut_lineage, written


def chain_roots(df: DataFrame, key: str, prev: str) -> DataFrame:
    """(key, root, position): where the ``prev`` links of each row lead to, and how far it is.

    Every round doubles the length of all pointers, so a chain of n rows takes about
    log2(n) rounds. Rows on a cycle, or behind a link to nothing, get a null position.
    """
    state = cut_lineage(
        df.select(
            F.col(key).alias("id"), F.col(prev).alias("ptr"),
            F.when(F.col(prev).isNull(), F.col(key)).alias("root"),
            F.when(F.col(prev).isNull(), 0).otherwise(1).cast("long").alias("dist"),
            F.lit(False).alias("lost"),
        )
    )
    rounds_left = max(state.count(), 2).bit_length() + 1
    while rounds_left > 0:
        moving = state.filter("ptr is not null")
        if moving.isEmpty():
            break
        target = state.select(
            F.col("id").alias("ptr"), F.col("ptr").alias("next"), F.col("root").alias("r"),
            F.col("dist").alias("more"), F.col("lost").alias("gone"),
        )
        moved = moving.join(target, "ptr", "left").select(
            "id", F.col("next").alias("ptr"), F.col("r").alias("root"), (F.col("dist") + F.col("more")).alias("dist"),
            F.coalesce("gone", F.lit(True)).alias("lost"),
        )
        state = cut_lineage(state.filter("ptr is null").unionByName(moved))
        rounds_left -= 1
    position = F.when(F.col("ptr").isNull() & ~F.col("lost"), F.col("dist"))
    return state.select(F.col("id").alias(key), F.when(position.isNotNull(), F.col("root")).alias("root"), position.alias("position"))


def chain_positions(df: DataFrame, key: str, prev: str) -> DataFrame:
    """(key, position): distance of each row from the root its ``prev`` links lead to."""
    return chain_roots(df, key, prev).select(key, "position")


def ordered_decisions(decisions: DataFrame) -> DataFrame:
    """Decisions with their place in the chain of their proposal."""
    return decisions.join(chain_positions(decisions, "decision_id", "previous_decision_id"), "decision_id")


def decision_tips(decisions: DataFrame) -> DataFrame:
    """Tip of each proposal's decision chain, or the reason why it has none.

    A chain has one root, no branch, no cycle, and goes on only after a deferral.
    """
    d = ordered_decisions(decisions).select("decision_id", "proposal_id", "previous_decision_id", "decision", "position")
    parent = d.select(F.col("decision_id").alias("previous_decision_id"), F.col("decision").alias("before"),
                      F.col("proposal_id").alias("p_proposal"))
    children = d.filter("previous_decision_id is not null").groupBy("previous_decision_id").agg(
        F.count(F.lit(1)).alias("n_children")
    )
    rows = d.join(parent, "previous_decision_id", "left").join(
        children.select(F.col("previous_decision_id").alias("decision_id"), "n_children"), "decision_id", "left"
    )
    linked = F.col("previous_decision_id").isNotNull()
    per = rows.groupBy("proposal_id").agg(
        F.count_if(~linked).alias("roots"),
        F.bool_or(F.col("position").isNull()).alias("unreached"),
        F.bool_or(F.coalesce(F.col("n_children"), F.lit(0)) > 1).alias("branch"),
        F.bool_or(linked & ~(F.col("before").eqNullSafe("defer") & F.col("p_proposal").eqNullSafe(F.col("proposal_id")))).alias("after_end"),
        F.max(F.when(F.col("n_children").isNull(), F.struct("position", "decision_id", "decision"))).alias("tip"),
        F.count(F.lit(1)).alias("n_decisions"),
    )
    broken = (F.col("roots") != 1) | F.col("unreached") | F.col("branch") | F.col("after_end")
    return per.select(
        "proposal_id", "n_decisions",
        F.when(~broken, F.col("tip.decision_id")).alias("tip_decision_id"),
        F.when(~broken, F.col("tip.decision")).alias("tip_decision"),
        F.when(broken, F.lit("DecisionChain")).alias("problem"),
    )


def memory_current(events: DataFrame) -> DataFrame:
    """Current state per memory: its terminal event if there is one, else its first.

    Nothing follows a terminal state, so the depth of an event is 0 or 1 and no walk is
    needed.
    """
    depth = F.col("previous_event_id").isNotNull().cast("int")
    tip = F.max(F.struct(depth.alias("depth"), "event_type", "event_id")).alias("t")
    return events.groupBy("namespace_id", "memory_id").agg(tip).select(
        "memory_id", "namespace_id",
        F.col("t.event_type").alias("current_state"),
        F.col("t.event_id").alias("last_state_event_id"),
    )


def reachable(seeds: DataFrame, edges: DataFrame, group: str) -> DataFrame:
    """(group, node): seeds and all nodes their edges (src, dst) lead to; safe on cycles.

    Seeds that their edges do not leave are the answer after one step, whatever the length of
    the paths among them. Else nodes with one edge make paths, which pointers of doubling length jump along: a path of n
    nodes takes about log2(n) steps. Only nodes with several edges are walked one after
    another, from the end of one path to the starts of the next; each step reads what the
    one before has added. At last every path that was entered is filled in by the same jumps.
    """
    start = written(seeds.select(group, "node").distinct())
    step = edges.select(F.col("src").alias("node"), "dst").join(start, "node").select(group, F.col("dst").alias("node"))
    if step.join(start, [group, "node"], "left_anti").isEmpty():
        return start
    links = cut_lineage(edges.select("src", "dst").distinct())
    degree = links.groupBy("src").agg(F.count(F.lit(1)).alias("n"))
    branching = cut_lineage(links.join(degree.filter("n > 1"), "src").select("src", "dst"))
    level = links.join(degree.filter("n = 1"), "src").select(F.col("src").alias("node"), F.col("dst").alias("ptr"), F.lit(True).alias("full"))
    jumps, rounds = [level.drop("full")], max(links.count(), 1).bit_length()
    for i in range(rounds):
        # "full" pointers go on; the others have met the end of their path
        ahead = level.select(F.col("node").alias("ptr"), F.col("ptr").alias("next"), F.col("full").alias("more"))
        moved = level.filter("full").join(ahead, "ptr", "left").select("node", F.coalesce("next", "ptr").alias("ptr"), F.coalesce("more", F.lit(False)).alias("full"))
        level = level.filter("NOT full").unionByName(moved)
        if i % 2:
            level = cut_lineage(level)
            if level.filter("full").isEmpty():
                break
        jumps.append(level.filter("full").drop("full"))
    ends = cut_lineage(level.filter("NOT full").select("node", F.col("ptr").alias("end")))
    entered = frontier = start
    while not branching.isEmpty():
        at = frontier.join(ends, "node", "left").select(group, F.coalesce("end", "node").alias("src")).distinct()
        step = at.join(branching, "src").select(group, F.col("dst").alias("node")).distinct()
        frontier = cut_lineage(step.join(entered, [group, "node"], "left_anti"))
        if frontier.isEmpty():
            break
        entered = entered.unionByName(frontier)
    seen = entered
    for i, jump in enumerate(jumps):
        seen = seen.unionByName(seen.join(jump, "node").select(group, F.col("ptr").alias("node"))).distinct()
        if i % 5 == 4:
            seen = cut_lineage(seen)
    return seen
