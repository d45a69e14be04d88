"""Roots on one account: comparing captures by pairs, the detector's state, and groups with vetoes."""

from __future__ import annotations

import hashlib
from dataclasses import dataclass
from itertools import chain
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from meterlark.functions.keys import pair_key
from meterlark.operators.limit_events import SAME_INSTANCE_MS

#: Fixed values, in seconds but for the tolerance (ms).
PAIR_WINDOW_S, CLOSE_S, CONFIRM_SPAN_S, CONFIRM = 600, 60, 660, 2
RESET_TOLERANCE_MS = 2000

COMPARISON = "pair string, a string, b string, at_a long, at_b long, shared long, resets_agree boolean, same_use boolean, close boolean, kinds array<struct<kind:string,u:double,r:long>>"
STATE = "pair string, agree int, disagree int, inconclusive int, linked boolean, detected_at long, at_a long, at_b long, agreed_at long, kinds array<struct<kind:string,u:double,r:long>>"


def compared(windows: DataFrame) -> DataFrame:
    """Each two accounts of a provider whose captures (one per identity and `round`) are at most ten minutes apart, compared.

    windows: round, identity, provider, at, kind, utilization, resets_at, and owner where they are of several users.  Windows both have
    are compared, less those whose instance ended by the later capture.  Pairs meet by round, provider, window kind and owner: the few
    accounts of one user, however many users there are.
    """
    keys = ["round", "provider", "kind"] + ["owner"] * ("owner" in windows.columns)
    own = [F.col(c) for c in keys]
    a = windows.select(*own, F.col("identity").alias("a"), F.col("at").alias("at_a"), F.col("utilization").alias("u_a"), F.col("resets_at").alias("r_a"))
    b = windows.select(*own, F.col("identity").alias("b"), F.col("at").alias("at_b"), F.col("utilization").alias("u_b"), F.col("resets_at").alias("r_b"))
    both = a.join(b, keys).where((F.col("a") < F.col("b")) & (F.abs(F.col("at_a") - F.col("at_b")) <= PAIR_WINDOW_S * 1000) & (F.least("r_a", "r_b") > F.greatest("at_a", "at_b")))
    return both.groupBy(pair_key(F.col("a"), F.col("b")).alias("pair"), "a", "b", "at_a", "at_b").agg(
        F.count(F.lit(1)).alias("shared"), F.bool_and(F.abs(F.col("r_a") - F.col("r_b")) <= RESET_TOLERANCE_MS).alias("resets_agree"), F.bool_and(F.col("u_a") == F.col("u_b")).alias("same_use"),
        (F.abs(F.col("at_a") - F.col("at_b")) <= CLOSE_S * 1000).alias("close"), F.array_sort(F.collect_list(F.struct("kind", F.col("u_a").alias("u"), F.col("r_a").alias("r")))).alias("kinds"))


def judged(comparisons: DataFrame) -> DataFrame:
    """Comparisons that can decide something: `kind` is `same`, `apart` or, where resets agree and use differs, `maybe`.

    Those without a common window, and those whose resets agree while the captures are too far apart for their use to be compared, go.
    """
    kind = F.when(~F.col("resets_agree"), "apart").when(F.col("same_use"), "same").otherwise("maybe")
    return comparisons.where("shared > 0 and (close or not resets_agree)").select("pair", F.lit(1).alias("step"), "at_a", "at_b", kind.alias("kind"), "kinds")


def weighed(rows: DataFrame) -> DataFrame:
    """Rows of a pair in time order, less those not later on both sides than all before; every second `maybe` in a row is `apart`, the others `pause`."""
    own = W.partitionBy("pair").orderBy("step", "at_a", "at_b")
    rows = rows.withColumn("late", F.max("at_b").over(own.rowsBetween(W.unboundedPreceding, -1))).withColumn("same_a", F.lag("at_a").over(own) == F.col("at_a"))
    rows = rows.where("step = 0 or ((late is null or at_b > late) and not coalesce(same_a, false))")
    rows = rows.withColumn("turn", F.sum(F.when(F.col("kind") == F.lag("kind").over(own), 0).otherwise(1)).over(own))
    place = F.row_number().over(W.partitionBy("pair", "turn").orderBy("step", "at_a"))
    return rows.withColumn("kind", F.when(F.col("kind") != "maybe", F.col("kind")).when(place % 2 == 0, "apart").otherwise("pause"))


def pair_states(comparisons: DataFrame, stored: DataFrame | None = None) -> DataFrame:
    """The state of every pair after its comparisons in time order, from stored states on.

    agree: length of the streak of `same` comparisons, each at most CONFIRM_SPAN_S after the one before and none `apart` between.  disagree: `apart`
    ones since the last `same`.  A pair is linked once a streak's window moved on both sides alike (same instance, other use, some use),
    and until CONFIRM are `apart` in a row; detected_at is when that link began.  inconclusive: the last comparison was set aside.
    All of it is counts and last values over windows of one pair's comparisons, of which there is one a round.
    A stored state takes part as the row before all others.
    """
    columns = [c.split(" ")[0] for c in STATE.split(", ")]
    fresh = judged(comparisons)
    for c, kind in (("agree", "int"), ("disagree", "int"), ("linked", "boolean"), ("detected_at", "long"), ("agreed_at", "long")):
        fresh = fresh.withColumn(c, F.lit(None).cast(kind))
    rows = fresh
    if stored is not None:
        kind = F.when(F.col("inconclusive") == 1, "maybe").otherwise("stored")
        rows = fresh.unionByName(stored.select("pair", F.lit(0).alias("step"), "at_a", "at_b", kind.alias("kind"), "kinds", "agree", "disagree", "linked", "detected_at", "agreed_at"))
    rows = weighed(rows).withColumn("at", F.greatest("at_a", "at_b"))
    own = W.partitionBy("pair").orderBy("step", "at_a")
    events = rows.where("step = 0 or kind != 'pause'").withColumn("same", F.expr("step = 1 and kind = 'same'")).withColumn("apart", F.expr("step = 1 and kind = 'apart'"))
    events = events.withColumn("agreed_at", F.when(F.col("same"), F.col("at_a")).when(F.col("step") == 0, F.col("agreed_at")))
    events = events.withColumn("kinds", F.when(~F.col("apart"), F.col("kinds"))).withColumn("_gap", F.col("at_a") - F.lag("agreed_at").over(own)).withColumn("_was", F.lag("kinds").over(own))
    # streaks and runs
    events = events.withColumn("_joined", F.expr(f"same and coalesce(_gap <= {CONFIRM_SPAN_S * 1000}, false)"))
    events = events.withColumn("_streak", F.sum(F.when(F.col("_joined"), 0).otherwise(1)).over(own)).withColumn("_run", F.sum(F.col("same").cast("int")).over(own))
    events = events.withColumn("agree", F.when(F.col("apart"), 0).otherwise(F.sum(F.coalesce("agree", F.col("same").cast("int"))).over(W.partitionBy("pair", "_streak").orderBy("step", "at_a"))))
    events = events.withColumn("disagree", F.sum(F.coalesce("disagree", F.col("apart").cast("int"))).over(W.partitionBy("pair", "_run").orderBy("step", "at_a")))
    # links
    moved = F.exists("kinds", lambda k: F.exists("_was", lambda w: (w["kind"] == k["kind"]) & (F.abs(w["r"] - k["r"]) < SAME_INSTANCE_MS) & (w["u"] != k["u"])))
    events = events.withColumn("_linking", F.col("_joined") & (F.col("agree") >= CONFIRM) & F.coalesce(moved, F.lit(False)) & F.exists("kinds", lambda k: k["u"] > 0))
    events = events.withColumn("_breaking", F.col("apart") & (F.col("disagree") >= CONFIRM))
    events = events.withColumn("_epoch", F.sum(F.col("_breaking").cast("int")).over(own))
    signal = F.when(F.col("step") == 0, F.col("linked")).when(F.col("_linking"), True).when(F.col("_breaking"), False)
    events = events.withColumn("linked", F.coalesce(F.last(signal, ignorenulls=True).over(own), F.lit(False)))
    since = F.first(F.when(F.col("step") == 0, F.col("detected_at")).when(F.col("_linking"), F.col("at")), ignorenulls=True).over(W.partitionBy("pair", "_epoch").orderBy("step", "at_a"))
    events = events.withColumn("detected_at", F.when(F.col("linked"), since))
    # the last of each pair
    order = F.struct("step", "at_a")
    state = events.groupBy("pair").agg(F.max_by(F.struct("agree", "disagree", "linked", "detected_at", "agreed_at", "kinds"), order).alias("_s")).select("pair", "_s.*")
    last = rows.groupBy("pair").agg(F.max("at_a").alias("at_a"), F.max("at_b").alias("at_b"), F.max_by(F.col("kind") == "pause", order).cast("int").alias("inconclusive"))
    none = {"agree": F.lit(0), "disagree": F.lit(0), "linked": F.lit(False)}
    out = last.join(state, "pair", "left").withColumns({c: F.coalesce(c, x) for c, x in none.items()})
    return out.select(*(F.col(c).cast("int") if c in ("agree", "disagree") else F.col(c) for c in columns))


def linked_now(states: DataFrame) -> DataFrame:
    return states.where("linked and disagree = 0")


def proven_different(states: DataFrame) -> DataFrame:
    return states.where(f"not linked and disagree >= {CONFIRM}")


@dataclass(frozen=True)
class Group:
    """Roots held to be one account, and those that must not join them."""

    members: frozenset[str]
    foes: frozenset[str]
    by_hand: bool = False

    def with_(self, other: Group, by_hand: bool) -> Group:
        return Group(self.members | other.members, self.foes | other.foes, by_hand or self.by_hand or other.by_hand)


def resolve_groups(roots: list[tuple[str, str]], same: list[list[str]], separate: list[tuple[str, str]], linked: list[str]) -> dict[str, dict[str, Any]]:
    """Groups of one user's roots (provider, identity) by member: manual links first, then detected ones in key order.

    A link between providers, or to a root that must stay apart, is left out; as that depends on the links before it, this stays a
    small reduction on the driver: roots are directories listed in one configuration.
    """
    provider = {identity: name for name, identity in roots}
    foes = {identity: frozenset(y for pair in separate if identity in pair for y in pair if y != identity) for identity in provider}
    by_hand = ((entry[0], x, True) for names in same for entry in _by_provider(names, provider) for x in entry[1:])
    detected = ((*key.split("|"), False) for key in sorted(linked))
    group_of = {identity: Group(frozenset([identity]), foes[identity]) for identity in provider}
    for a, b, manual in chain(by_hand, detected):
        x, y = group_of.get(a), group_of.get(b)
        if x and y and x is not y and provider[a] == provider[b] and not x.members & y.foes:
            group_of |= dict.fromkeys(x.members | y.members, x.with_(y, manual))
    listed = list(provider)
    return {
        identity: {"id": hashlib.sha256("\n".join(sorted(g.members)).encode()).hexdigest()[:32], "members": sorted(g.members, key=listed.index), "source": "manual" if g.by_hand else "auto"}
        for identity, g in group_of.items() if len(g.members) > 1
    }


def _by_provider(names: list[str], provider: dict[str, str]) -> list[list[str]]:
    """The known ones among names, one list for each provider."""
    out: dict[str, list[str]] = {}
    for x in names:
        if x in provider:
            out.setdefault(provider[x], []).append(x)
    return list(out.values())
