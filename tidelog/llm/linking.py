"""Connected groups from candidate lists, without all pairs of a list.

A list is the nodes posted under one key. Large lists are mostly members of one group, so the first step tries one
pair per node, with the most central member of its lists, and joins the confirmed pairs into groups. Further turns
work on the lists that still hold members of several groups: each of their nodes tries one member, another one each
turn, of its lists' largest other group (``draws`` of them), and one of a group that changes with the turn; confirmed
pairs join groups. So a node that is like a share p of a large group stays outside for t turns with a chance of about
(1 - p)^(draws t), and a turn costs at most draws + 1 pairs per node. Turns end when few pairs are confirmed. What is left then is nodes with almost
no link into their lists' groups; the last step enumerates, so that no link between groups is lost, the pairs of
members of different groups that a sound bound on the nodes' features does not rule out. A pair inside one group needs
no test: a list of n members of one group costs n pairs.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidelog.llm.cluster import discard, release, saved, shuffle_parts

Verify = Callable[[DataFrame], DataFrame]
Possible = Callable[[str, str], Column]
Exact = tuple[DataFrame, Possible]
Seeds = tuple[Callable[[DataFrame], DataFrame], Possible]
#: At most so many turns; members of the largest group tried in each; the share of a turn's pairs that must be links for another one.
TURNS, DRAWS, YIELD = 4, 4, 0.05


def components(edges: DataFrame) -> DataFrame:
    """(node, label) of each node of the edges (a, b): label is the smallest node of its connected component.

    Alternates large-star and small-star steps, in which every node's neighbours move to the smallest of them; the
    number of rounds is logarithmic in practice, and each round is joins and partial minima over pairs. A hub's
    neighbours are never gathered in one row or task.
    """
    edges = saved(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u > v").distinct())
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("m", "u").alias("m"))
        large = both.join(low, "u").where("v > u and v > m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct("v", "m"), F.struct(F.col("u").alias("v"), "m"))).alias("e"))
        old, edges = edges, saved(small.select(F.col("e.v").alias("u"), F.col("e.m").alias("v")).where("u > v").distinct())
        discard(old)
        now = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == before or not now[0]:
            break
        before = now
    return edges.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct())


def lists_of(postings: DataFrame) -> DataFrame:
    """(key, node, pivot) of the lists of two or more members; the pivot of a long list is the member of largest weight.

    One aggregate tells how long a list is and its least and largest members, which are all of a list of two; the
    postings are read again for the keys of longer lists only.
    """
    keys = saved(postings.groupBy("key").agg(F.count("*").alias("n"), F.min("node").alias("lo"), F.max("node").alias("hi")).where("n > 1"))
    release(postings.sparkSession)
    short = keys.where("n = 2").select("key", F.explode(F.array("lo", "hi")).alias("node"), F.col("lo").alias("pivot"))
    long = saved(postings.join(keys.where("n > 2").select("key"), "key"))
    release(postings.sparkSession)
    central = long.groupBy("key").agg(F.max(F.struct("weight", F.col("node").alias("pivot"))).alias("top")).select("key", "top.pivot")
    made = saved(short.unionByName(long.select("key", "node").join(central, "key")))
    discard(keys, long)
    return made


def lists_at_once(postings: DataFrame) -> DataFrame:
    """What ``lists_of`` makes, of postings that cost too much to be made or shuffled twice; a list of two has a pivot like any other."""
    own = Window.partitionBy("key")
    top = F.max(F.struct("weight", F.col("node").alias("pivot"))).over(own)
    more = [c for c in postings.columns if c not in ("key", "node", "weight")]  # what else a posting has stays
    made = saved(postings.select("key", "node", *more, F.count("*").over(own).alias("n"), top.alias("top")).where("n > 1").select("key", "node", "top.pivot", *more))
    release(postings.sparkSession)
    return made


class _Linker:
    """What ``groups`` works with: features of nodes, and the pairs tried and links found so far."""

    def __init__(self, features: DataFrame, possible: Possible, verify: Verify):
        self.features, self.possible, self.verify = features, possible, verify
        self.tried: list[DataFrame] = []
        self.links: list[DataFrame] = []
        self.spark = features.sparkSession

    def side(self, x: str, features: DataFrame | None = None) -> DataFrame:
        features = self.features if features is None else features
        return features.select(F.col("node").alias(x), *(F.col(c).alias(f"{x}_{c}") for c in features.columns if c != "node"))

    def confirmed(self, pairs: DataFrame) -> tuple[DataFrame, int, int]:
        """The links among the pairs (x, y, u, v) that are possible and were not tried; how many pairs these were, and how many of them are links.

        u and v are the groups of a pair's nodes. A pair's smaller node becomes a, the other one b.
        """
        swap = F.col("x") > F.col("y")
        both = [F.when(swap, F.col(j)).otherwise(F.col(i)).alias(c) for c, i, j in (("a", "x", "y"), ("b", "y", "x"), ("u", "u", "v"), ("v", "v", "u"))]
        pairs = pairs.select(*both).dropDuplicates(["a", "b"])
        if self.tried:
            pairs = pairs.join(reduce(DataFrame.unionByName, self.tried).select("a", "b"), ["a", "b"], "left_anti")
        pairs = pairs.join(self.side("a"), "a").join(self.side("b"), "b").where(self.possible("a", "b")).select("a", "b", "u", "v")
        pairs = saved(pairs)
        linked = saved(self.verify(pairs).select("a", "b", "u", "v"))
        self.tried.append(pairs)
        self.links.append(linked.select("a", "b"))
        release(self.spark)
        return linked, pairs.count(), linked.count()

    def attempts(self, named: DataFrame, turn: int, draws: int, shared: int = 1) -> DataFrame:
        """(x, y, u, v): for each node members of its lists' largest other group, and one of another group, drawn by ``shared`` lists or more."""
        drawn = [F.min(F.struct(F.xxhash64("node", F.lit(turn), F.lit(i)).alias("h"), "node"))["node"].alias(f"y{i}") for i in range(draws)]
        own = named.groupBy("key", "label").agg(F.count("*").alias("n"), *drawn)
        most = F.max(F.struct("n", F.col("label").alias("l"), *(f"y{i}" for i in range(draws)))).alias("most")
        some = F.min(F.struct(F.xxhash64("label", F.lit(turn)).alias("h"), F.col("label").alias("l"), F.col("y0").alias("y"))).alias("some")
        tops = own.groupBy("key").agg(most, some)
        to = [F.struct(F.lit(i).alias("kind"), F.col("most.l").alias("l"), F.col(f"most.y{i}").alias("y")) for i in range(draws)]
        to.append(F.struct(F.lit(draws).alias("kind"), F.col("some.l").alias("l"), F.col("some.y").alias("y")))
        each = named.join(tops, "key").select(F.col("node").alias("x"), F.col("label").alias("u"), F.explode(F.array(*to)).alias("to"))
        each = each.where("u <> to.l").groupBy("x", "u", "to.kind", "to.y", F.col("to.l").alias("v")).agg(F.count("*").alias("n"))
        return each.groupBy("x", "kind").agg(F.max_by(F.struct("y", "u", "v", "n"), F.struct("n", "y")).alias("p")).where(F.col("p.n") >= shared).select("x", "p.y", "p.u", "p.v")

    def rest(self, named: DataFrame, exact: Exact | None = None) -> DataFrame:
        """Pairs (x, y, u, v) of members of different groups that may be links, each from the first list where both are."""
        if exact:
            return self.settled(named.join(_most(named), "key").join(_keys(named), "node"), *exact)
        keys = _keys(named)
        named = named.join(_most(named), "key")
        side = lambda x: self.side(x).join(keys.select(F.col("node").alias(x), F.col("keys").alias(f"{x}_keys")), x)
        left = named.where("label <> most").select("key", F.col("node").alias("x"), F.col("label").alias("u")).join(side("x"), "x")
        right = named.select("key", F.col("node").alias("y"), F.col("label").alias("v"), (F.col("label") == F.col("most")).alias("main")).join(side("y"), "y")
        both = (left["key"] == right["key"]) & F.expr("u <> v and (main or x < y)") & self.possible("x", "y") & (F.array_min(F.array_intersect("x_keys", "y_keys")) == left["key"])
        return left.join(right, both).select("x", "y", "u", "v")

    def rest_by_seeds(self, named: DataFrame, features: DataFrame, seeds: Seeds) -> DataFrame:
        """Pairs (x, y, u, v) of members of different groups that pass the test of seeds in some list, as a table, some of the
        lists at a time. seeds: what makes the rows that are compared of postings with their features, and what compares two."""
        parts = max(1, -(-named.count() // max(1, 3 * self.features.count())))
        most, found = saved(_most(named)), []
        for i in range(parts):
            some = named.where(F.pmod(F.xxhash64("key", F.lit("part")), F.lit(parts)) == i)
            found.append(saved(self.met(seeds[0](some.join(most, "key").join(features, "node")), seeds[1], parts).distinct()))
            release(self.spark)
        out = saved(reduce(DataFrame.unionByName, found))
        discard(most, *found)
        return out

    def rest_by_parts(self, named: DataFrame, exact: Exact) -> DataFrame:
        """What ``rest`` makes with exact, as a table, some of the lists at a time: in all lists together a node's wide features
        stand as often as it is posted; of a part, there are about half as many as nodes, whatever the lists are."""
        parts = max(1, -(-2 * named.count() // max(1, self.features.count())))
        most, keys = saved(_most(named)), saved(_keys(named))
        found = []
        for i in range(parts):
            some = named.where(F.pmod(F.xxhash64("key", F.lit("part")), F.lit(parts)) == i)
            found.append(saved(self.settled(some.join(most, "key").join(keys, "node"), *exact, parts)))
            release(self.spark)
        out = saved(reduce(DataFrame.unionByName, found))
        discard(most, keys, *found)
        return out

    def settled(self, named: DataFrame, features: DataFrame, test: Possible, parts: int = 1) -> DataFrame:
        """Those pairs of ``rest`` that test finds to be links. named (key, node, label, most, keys), of one of so many parts of
        the lists, meets its wide features once; both sides of the join are that one table, dealt by key, so it is shuffled once."""
        return self.met(named.join(features, "node"), lambda x, y: (F.array_min(F.array_intersect(f"{x}_keys", f"{y}_keys")) == F.col(f"{x}_key")) & test(x, y), parts)

    def met(self, wide: DataFrame, test: Possible, parts: int) -> DataFrame:
        """Pairs (x, y, u, v) of rows of wide (key, node, label, most, and more columns) of one list and different groups that may be links and pass test."""
        known = " and ".join(f"{c} is not null" for c in sorted(wide.columns))  # or Spark asks it of one side
        wide = wide.where(known).repartition(max(2, 4 // parts) * shuffle_parts(self.spark), "key")  # by work, not by size: distances are what costs
        of = lambda x, u: wide.select(F.col("node").alias(x), F.col("label").alias(u), *(F.col(c).alias(f"{x}_{c}") for c in wide.columns if c not in ("node", "label")))
        # most is equal on both sides: asked for across them, lest one side is cut before the shuffle and becomes another table
        both = F.expr("x_key = y_key and u <> v and u <> y_most and (v = x_most or x < y)") & self.possible("x", "y") & test("x", "y")
        return of("x", "u").join(of("y", "v"), both).select("x", "y", "u", "v")


def _most(named: DataFrame) -> DataFrame:
    """(key, most): the label that most members of the list have."""
    return named.groupBy("key", "label").agg(F.count("*").alias("n")).groupBy("key").agg(F.max_by("label", F.struct("n", "label")).alias("most"))


def _keys(named: DataFrame) -> DataFrame:
    """(node, keys): the lists that a node is in, which are few."""
    return named.groupBy("node").agg(F.collect_list("key").alias("keys"))


def _mixed(named: DataFrame) -> DataFrame:
    """The rows (key, node, label) of the lists that hold members of several groups."""
    keys = named.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo < hi").select("key")
    return named.join(keys, "key")


def _moved(linked: DataFrame) -> DataFrame:
    """(label, to): groups that links join move to the smallest group next to them, or next to that.

    Groups of one label are always connected; connected groups may keep different labels for a turn.
    """
    both = linked.select("u", "v").unionByName(linked.select(F.col("v").alias("u"), F.col("u").alias("v")))
    near = both.groupBy("u").agg(F.min("v").alias("v")).select("u", F.least("u", "v").alias("v"))
    beyond = near.select(F.col("u").alias("v"), F.col("v").alias("w"))
    return near.join(beyond, "v").select(F.col("u").alias("label"), F.col("w").alias("to"))


def groups(lists: DataFrame, features: DataFrame, possible: Possible, verify: Verify, turns: int = TURNS, draws: int = DRAWS, exact: Exact | None = None, short: int = 0, seeds: Seeds | None = None) -> DataFrame:
    """(node, label) of the nodes in groups of two or more.

    lists: (key, node, pivot) as ``lists_of`` makes them, a saved table; it is discarded. features: a row per node.
    possible: of two prefixes of feature columns, false only if such nodes cannot be a link. verify: gets distinct
    candidate pairs (a, b, and more columns), a < b, and returns the rows of those that are links. The groups are those
    of all links between nodes that share a key, whatever the numbers of turns and draws are. exact: features, a row per
    node, and what tells by them that nodes are a link; given these, the last step makes no row of a pair that is none.
    short: lists of up to so many members take no turns; the last step, which has all their pairs, costs less. With
    exact, only pairs that share two lists are tried before the last step: it tests pairs of one list anyway, of which few
    are links, and would test them again. seeds, with exact: lists has more columns, and of the last step's pairs only those
    that pass the test of seeds (see ``rest_by_seeds``) are candidates.
    """
    work, shared = _Linker(features, possible, verify), 2 if exact else 1
    stars = lists.where("node <> pivot").groupBy("pivot", "node").agg(F.count("*").alias("n"))
    stars = stars.where(F.col("n") >= shared).groupBy("node").agg(F.max_by("pivot", F.struct("n", "pivot")).alias("y")).select(F.col("node").alias("x"), "y", F.col("node").alias("u"), F.col("y").alias("v"))
    linked, tried, found = work.confirmed(stars)
    labels = saved(components(linked))
    work.links = [labels.select(F.col("node").alias("a"), F.col("label").alias("b"))]
    posted = [c for c in lists.columns if c != "pivot"]
    named = saved(_mixed(lists.select(posted).join(labels, "node", "left").select(*posted, F.coalesce("label", "node").alias("label"))))
    discard(lists, linked)
    used = [labels]
    for turn in range(turns):
        if named.isEmpty():
            break
        long = named.join(named.groupBy("key").agg(F.count("*").alias("n")).where(f"n > {short}").select("key"), "key") if short else named
        linked, tried, found = work.confirmed(work.attempts(long, turn, draws, shared))
        used.append(linked)
        if found:
            moved = named.join(_moved(linked), "label", "left").select(*posted, F.coalesce("to", "label").alias("label"))
            old, named = named, saved(_mixed(moved))
            discard(old)
            release(work.spark)
        if found <= YIELD * tried:
            break
    rest = work.rest_by_seeds(named, exact[0], seeds) if exact and seeds else work.rest_by_parts(named, exact) if exact else work.rest(named)
    used.append(work.confirmed(rest)[0])
    out = saved(components(reduce(DataFrame.unionByName, work.links)))
    discard(named, rest, *used, *work.tried)
    release(work.spark)
    return out
