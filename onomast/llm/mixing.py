"""Mixing overlapping sources to target weights by min-cost flow.

Documents are aggregated by membership pattern (the set of sources they belong to). Each pattern offers its words once at
cost 1, a second time at cost 2, a third time at cost 3; edges lead from patterns to their sources and from sources to a sink
with each source's quota. The cheapest flow of greatest size says how many words each pattern gives; convex costs make it use
fresh words before repeats. Documents are then taken whole: every document of a pattern as often as the flow fills it, and
once more those in a run of the seeded hash order that fits into what is left, then behind the document that it stopped at a run of
those that fit into the rest, and so on.

Scale: sizes are counted in one pass over the text; the ends of runs are found from partial sums over hash prefixes (three levels),
combined on the map side, so a source with a third of all rows is never brought together. The driver sees one row
for each pattern; there may be ``max_patterns`` (more are refused: the flow is solved on one machine).

Defined cases: a null source is a source of its own (last in order); a null or empty text has size 0 and takes 0; no row or no
word gives targets of 0; repeated rows have the same hash and are taken alike; a null doc_id is hashed as a value. Extra
columns are ignored.
"""

from __future__ import annotations

import functools

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from onomast.llm.columns import free_name
from onomast.plans.shared import materialize

WORD = r"[^\x20\x09-\x0D]+"
COPIES = 3
#: Runs of the hash order from which a pattern's last copies are taken; each leaves less than the document that it stopped at.
RUNS = 2
WEIGHTS = (1, 2, 3)


def targets(sizes: dict, weights: dict, total: float, most: int = COPIES) -> dict:
    """Share ``total`` by weight; a source stops at ``most`` times its size and its excess is shared again by weight."""
    out, left, rest = {}, dict(sizes), float(total)
    while left:
        w = sum(weights[s] for s in left)
        full = {s for s in left if rest * weights[s] / w > most * left[s]}
        if not full:
            out |= {s: rest * weights[s] / w for s in left}
            break
        for s in full:
            out[s] = float(most * left.pop(s))
        rest = float(total) - sum(out.values())
    return out


def min_cost_flow(patterns: dict[int, tuple[int, list]], quotas: dict) -> dict[int, int]:
    """Words that each pattern gives. patterns: key -> (size, its sources).

    Only the edges to the patterns cost anything, 1, 2 and 3, so a cheapest augmenting path is one whose first edge is cheapest: the
    flow is made greatest with first copies alone, then with second copies too, then with third ones. What no path of a dearer copy
    can reach stays out of reach, so earlier copies never become useful again. Each is a blocking-flow computation over levels."""
    source_at = {s: i for i, s in enumerate(quotas)}
    P, S = len(patterns), len(quotas)
    sink = P + S
    to: list[int] = []
    room: list[int] = []
    edges: list[list[int]] = [[] for _ in range(P + S + 1)]

    def edge(a: int, b: int, capacity: int) -> None:
        edges[a].append(len(to))
        edges[b].append(len(to) + 1)
        to.extend((b, a))
        room.extend((capacity, 0))

    sizes = [n for n, _ in patterns.values()]
    for i, (size, members) in enumerate(patterns.values()):
        for s in members:
            edge(i, P + source_at[s], COPIES * size)
    for s, quota in quotas.items():
        edge(P + source_at[s], sink, quota)
    used = [0] * P
    for copy in range(1, COPIES + 1):
        offer = [copy * n - u for n, u in zip(sizes, used)]
        while True:
            level, queue = {sink: 0}, [sink]
            for v in queue:  # distances to the sink over edges with room
                for e in edges[v]:
                    if room[e ^ 1] and to[e] not in level:
                        level[to[e]] = level[v] + 1
                        queue.append(to[e])
            open_ = [i for i in range(P) if offer[i] and i in level]
            if not open_:
                break
            at = dict.fromkeys(level, 0)
            for i in open_:
                while offer[i]:
                    path, v = [], i
                    while v != sink:
                        while at[v] < len(edges[v]):
                            e = edges[v][at[v]]
                            if room[e] and level.get(to[e], -1) == level[v] - 1:
                                break
                            at[v] += 1
                        if at[v] < len(edges[v]):
                            path.append(edges[v][at[v]])
                            v = to[path[-1]]
                        elif path:  # a dead end: back, and past the edge that led here
                            v = to[path.pop() ^ 1]
                            at[v] += 1
                        else:
                            break
                    if v != sink:
                        break
                    n = min(offer[i], *(room[e] for e in path))
                    for e in path:
                        room[e] -= n
                        room[e ^ 1] += n
                    offer[i] -= n
                    used[i] += n
    return dict(zip(patterns, used))


def seeded_order(seed: int) -> Column:
    """The seeded hash of a document, 32 bits."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), "doc_id", F.xxhash64("text")), 32)


def word_count(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def _table(spark: SparkSession, rows: list[tuple], *names: str) -> DataFrame:
    """Rows of longs as a local table, which costs no job."""
    return spark.createDataFrame(pa.table({n: pa.array(c, pa.int64()) for n, c in zip(names, zip(*rows))}))


def _next_cut(sized: DataFrame, asked: dict[int, tuple[int, int]]) -> dict[int, tuple[int, int]]:
    """For each pattern, of its documents from ``low`` on in the order of hashes that are no larger than ``room``, the longest run of
    hashes that fits into it: the hash behind it and the room that is left. Three levels, of 11, 11 and 10 bits, so that at most 2048
    sums of a pattern meet; a row a pattern comes back."""
    spark, state, done = sized.sparkSession, {p: (low, room, 0, room) for p, (low, room) in asked.items()}, {}
    for above, bits in ((32, 21), (21, 10), (10, 0)):
        if not state:
            break
        at = _table(spark, [(p, *x) for p, x in state.items()], "__pattern", "__low", "__room", "__above", "__most")
        prefix = F.shiftrightunsigned("__order", bits)
        inside = sized.join(F.broadcast(at), "__pattern").where((F.col("__order") >= F.col("__low")) & (F.col("__size") <= F.col("__most")))  # a row a pattern
        inside = inside.where(F.shiftrightunsigned("__order", above) == F.col("__above"))
        sums = inside.groupBy("__pattern", "__room", prefix.alias("__prefix")).agg(F.sum("__size").alias("n"))
        upto = F.sum("n").over(Window.partitionBy("__pattern").orderBy("__prefix"))
        over = sums.withColumn("upto", upto).groupBy("__pattern").agg(F.min(F.when(F.col("upto") > F.col("__room"), F.struct("__prefix", (F.col("upto") - F.col("n")).alias("before")))).alias("x"), F.max("upto").alias("all"))
        for r in over.collect():
            low, room, _, most = state.pop(r["__pattern"])
            if r["x"] is None:  # all of them fit
                done[r["__pattern"]] = (1 << 32, room - r["all"])
            elif bits:
                state[r["__pattern"]] = (low, room - r["x"]["before"], r["x"]["__prefix"], most)
            else:
                done[r["__pattern"]] = (r["x"]["__prefix"], room - r["x"]["before"])
    return done


def _cuts(sized: DataFrame, extra: dict[int, int]) -> dict[int, list[tuple[int, int, int]]]:
    """For each pattern runs (low, high, most): documents with ``low <= __order < high`` and no more than ``most`` words are taken once
    more. A run ends before the document that would take too much; the next goes on behind it with what fits into the rest."""
    out: dict[int, list[tuple[int, int, int]]] = {p: [] for p in extra}
    asked = {p: (0, room) for p, room in extra.items() if room > 0}
    for _ in range(RUNS):
        if not asked:
            break
        found = _next_cut(sized, asked)
        for p, (high, _) in found.items():
            out[p].append((asked[p][0], high, asked[p][1]))
        asked = {p: x for p, x in found.items() if x[0] < 1 << 32 and x[1] > 0}
    return out


def _times(runs: Column, copies: Column, order: Column, size: Column) -> Column:
    """How often a document is taken."""
    inside = lambda r: F.coalesce((order >= r["low"]) & (order < r["high"]) & (size <= r["most"]), F.lit(False))
    more = functools.reduce(lambda a, b: a | b, (inside(F.get(runs, i)) for i in range(RUNS)))
    return F.coalesce(copies + more.cast("long"), F.lit(0).cast("long"))


def plan_mix(docs: DataFrame, sources: Column, seed: int = 11, max_patterns: int = 100_000, weights: dict | None = None) -> tuple[DataFrame, DataFrame, dict, dict]:
    """(rows ``doc_id, __pattern, __size, __order``; pattern table with copies and cut; source sizes; targets).

    ``sources``: an array column, the sources of a row. ``weights``: by source; by default 1, 2, 3 in turn by code point."""
    spark = docs.sparkSession
    members = F.array_sort(F.array_distinct(F.coalesce(sources, F.array().cast("array<string>"))))
    rows = docs.select("doc_id", members.alias("__sources"), word_count().alias("__size"), seeded_order(seed).alias("__order"))
    rows = materialize(rows.withColumn("__pattern", F.xxhash64("__sources", F.size("__sources"))), "mix-sizes")
    found = rows.groupBy("__pattern", "__sources").agg(F.sum("__size").alias("n")).limit(max_patterns + 1).collect()
    if len(found) > max_patterns:
        raise ValueError(f"more than {max_patterns} membership patterns")
    if len({r["__pattern"] for r in found}) < len(found):
        raise ValueError("two membership patterns share a hash; use another seed")
    patterns = {r["__pattern"]: (int(r["n"]), list(r["__sources"])) for r in sorted(found, key=lambda r: r["__pattern"])}
    sizes: dict = {}
    for n, members in patterns.values():
        for s in members:
            sizes[s] = sizes.get(s, 0) + n
    ordered = sorted(sizes, key=lambda s: (s is None, s or ""))
    shares = weights or {s: WEIGHTS[i % len(WEIGHTS)] for i, s in enumerate(ordered)}
    wanted = targets({s: sizes[s] for s in ordered}, shares, sum(n for n, _ in patterns.values()))
    flow = min_cost_flow(patterns, {s: round(wanted[s]) for s in ordered})
    plan = [(p, min(COPIES, flow[p] // n) if n else 0, flow[p] % n if n and flow[p] // n < COPIES else 0) for p, (n, _) in patterns.items()]
    cuts = _cuts(rows.select("__pattern", "__size", "__order"), {p: x for p, _, x in plan if x})
    table = spark.createDataFrame([(p, c, cuts.get(p, [])) for p, c, _ in plan], "__pattern long, __copies long, __runs array<struct<low:long,high:long,most:long>>")
    return rows, table, sizes, wanted


def mix(docs: DataFrame, sources: Column | None = None, seed: int = 11) -> DataFrame:
    """doc_id, size, source_size, target, taken for every document of single-source rows (``source`` column)."""
    single = sources is None
    rows, table, sizes, wanted = plan_mix(docs, F.array("source") if single else sources, seed)
    spark = docs.sparkSession
    named = spark.createDataFrame([(s, n, float(wanted[s])) for s, n in sizes.items()], "__named string, source_size long, target double")
    # Both tables have at most max_patterns rows, the bound that the solver needs as well.
    out = rows.join(F.broadcast(table), "__pattern", "left")
    if single:
        out = out.join(F.broadcast(named), F.element_at("__sources", 1).eqNullSafe(F.col("__named")), "left")
    else:
        out = out.withColumns({"source_size": F.lit(None).cast("long"), "target": F.lit(None).cast("double")})
    times = _times(F.col("__runs"), F.col("__copies"), F.col("__order"), F.col("__size"))
    return out.select("doc_id", F.col("__size").alias("size"), "source_size", "target", (F.col("__size") * times).alias("taken"))


def copies_of(docs: DataFrame, seed: int = 11) -> DataFrame:
    """The mixed corpus itself: every row of ``docs`` as often as the mix takes it, with the columns of ``docs``; rows without words
    give the mix nothing and aren't taken."""
    _, table, _, _ = plan_mix(docs, F.array("source"), seed)
    pattern, copies, runs, place, size, again = (free_name(docs, c) for c in ("pattern", "copies", "runs", "place", "words", "again"))
    table = table.select(F.col("__pattern").alias(pattern), F.col("__copies").alias(copies), F.col("__runs").alias(runs))
    keyed = docs.where(F.col("text").rlike(WORD)).withColumns({pattern: F.xxhash64(F.array("source"), F.lit(1)), place: seeded_order(seed)})
    placed = keyed.join(F.broadcast(table), pattern)  # a row a pattern
    # Words are counted again only where a run may take the document.
    order = F.col(place)
    within = F.exists(runs, lambda r: (order >= r["low"]) & (order < r["high"]))
    times = _times(F.col(runs), F.col(copies), order, F.col(size))
    return placed.withColumn(size, F.when(within, word_count())).withColumn(again, F.explode(F.array_repeat(F.lit(0), times.cast("int")))).select(docs.columns)
