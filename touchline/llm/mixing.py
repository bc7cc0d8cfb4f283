"""Mixing sources to target weights, by min-cost flow over membership patterns.

Documents that belong to the same set of sources are one pattern. Words flow from each
pattern, at a cost that rises with every repetition (0, 1, 2, ... a word for the first,
second, third pass), through the pattern's sources to their targets. The flow runs over
patterns and sources only, never over documents; how many patterns there may be is the
documented bound max_patterns. A pattern that is to give f words out of w gives f // w
whole passes and f % w words of seeded, randomly ranked documents. The rank at which
these end is found by radix selection: sums by rank digit, then within the digit that
holds the end, and so on, so no task ever orders all documents of a pattern. What is then
open goes to the largest later documents that fit, counted by size, until none fits.
"""

from __future__ import annotations

from collections import deque
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from touchline.llm.common import cut, discard

WORD = r"[^\\x20\\x09-\\x0D]+"
DIGIT_BITS = 10
RUNS = "array<struct<low: long, high: long, least: long, most: long>>"
LAST = (1 << 63) - 1  # above every rank but itself


def word_count(text_col: str = "text") -> Column:
    """Words between ASCII white space; null: 0."""
    return F.coalesce(F.expr(f"regexp_count(`{text_col}`, '{WORD}')"), F.lit(0)).cast("long")


def water_fill(sizes: list[int], weights: list[float], total: float, most: float) -> list[float]:
    """Shares of total by weight, none above most times its size; the excess is shared again by weight."""
    targets, free, left = [0.0] * len(sizes), set(range(len(sizes))), float(total)
    while free and left > 0:
        unit = left / sum(weights[i] for i in free)
        full = {i for i in free if unit * weights[i] > most * sizes[i]}
        if not full:
            for i in free:
                targets[i] = unit * weights[i]
            break
        for i in full:
            targets[i] = float(most * sizes[i])
            left -= targets[i]
        free -= full
    return targets


def min_cost_flow(n: int, arcs: list[tuple[int, int, int, int]], start: int, end: int) -> list[int]:
    """Flow of each arc (from, to, capacity, cost) in a maximal flow of least cost, by shortest augmenting paths."""
    at: list[list[int]] = [[] for _ in range(n)]
    to, room, cost = [], [], []
    for u, v, c, w in arcs:
        at[u].append(len(to))
        at[v].append(len(to) + 1)
        to += [v, u]
        room += [c, 0]
        cost += [w, -w]
    while True:
        far, via, queue, waits = {start: 0}, {}, deque([start]), {start}
        while queue:
            u = queue.popleft()
            waits.discard(u)
            for e in at[u]:
                if room[e] > 0 and far[u] + cost[e] < far.get(to[e], 1 << 60):
                    far[to[e]], via[to[e]] = far[u] + cost[e], e
                    if to[e] not in waits:
                        waits.add(to[e])
                        queue.append(to[e])
        if end not in far:
            return [room[2 * i + 1] for i in range(len(arcs))]
        path, v = [], end
        while v != start:
            path.append(via[v])
            v = to[via[v] ^ 1]
        more = min(room[e] for e in path)
        for e in path:
            room[e] -= more
            room[e ^ 1] += more


@dataclass
class Plan:
    """Sources as (name, words there are, target); for each pattern its whole passes and words of the last pass."""

    sources: list[tuple[str | None, int, float]] = field(default_factory=list)
    passes: dict[str, int] = field(default_factory=dict)
    rest: dict[str, int] = field(default_factory=dict)


def route(patterns: list[tuple[str, list[str | None], int]], weights: dict | None, max_repeats: int) -> Plan:
    """Targets, and the flow from patterns (key, sources, words) to them."""
    held: dict[str | None, int] = {}
    for _, sources, words in patterns:
        for s in sources:
            held[s] = held.get(s, 0) + words
    names = sorted(held, key=lambda s: (s is None, s or ""))
    share = [weights[s] if weights else i % 3 + 1 for i, s in enumerate(names)]
    total = sum(words for _, sources, words in patterns if sources)
    targets = water_fill([held[s] for s in names], share, total, max_repeats)
    node = {s: 1 + len(patterns) + i for i, s in enumerate(names)}
    end = 1 + len(patterns) + len(names)
    arcs = [(0, 1 + i, words, tier) for i, (_, _, words) in enumerate(patterns) for tier in range(max_repeats)]
    arcs += [(1 + i, node[s], max_repeats * words, 0) for i, (_, sources, words) in enumerate(patterns) for s in sources]
    arcs += [(node[s], end, round(t), 0) for s, t in zip(names, targets, strict=True)]
    flow = min_cost_flow(end + 1, arcs, 0, end)
    plan = Plan([(s, held[s], t) for s, t in zip(names, targets, strict=True)])
    for i, (key, _, words) in enumerate(patterns):
        given = sum(flow[i * max_repeats : (i + 1) * max_repeats])
        plan.passes[key], plan.rest[key] = divmod(given, words) if words else (0, 0)
    return plan


def _ends(ranked: DataFrame, keys: list[str], asked: dict[tuple, tuple[int, int]]) -> dict[tuple, tuple[int, int]]:
    """For each group of rows the rank before which documents fit into its words, and the words then left.

    asked: by the group's values of keys, the rank to begin at and the words. All groups are looked
    at together, in one job for each digit of the rank.
    """
    spark = ranked.sparkSession
    kinds = [ranked.schema[k].dataType.simpleString() for k in keys]
    names = [f"{k} {kind}" for k, kind in zip(keys, kinds, strict=True)]
    ends = {key: (low, left) for key, (low, left) in asked.items() if left <= 0}
    open_ = {key: (low, 0, left) for key, (low, left) in asked.items() if left > 0}  # first rank, start of the open digit, words left
    for level in range(1, 63 // DIGIT_BITS + 1):
        if not open_:
            break
        shift = 63 - DIGIT_BITS * level
        state = spark.createDataFrame([(*k, *v) for k, v in open_.items()], f"{', '.join(names)}, first_rank long, low long, open_words long")
        inside = ranked.join(F.broadcast(state), keys).where("rank >= first_rank")
        if level > 1:
            inside = inside.where(F.expr(f"shiftright(rank, {shift + DIGIT_BITS}) = shiftright(low, {shift + DIGIT_BITS})"))
        sums = inside.groupBy(*keys, "open_words", F.expr(f"shiftright(rank, {shift})").alias("digit")).agg(
            F.sum("size").alias("words"), F.count(F.lit(1)).alias("n")
        )
        upto = Window.partitionBy(*keys).orderBy("digit")
        sums = sums.withColumn("before", F.sum("words").over(upto) - F.col("words"))
        over = sums.where("before + words > open_words")
        first = over.groupBy(*keys).agg(F.min(F.struct("digit", "before", "n")).alias("at"))
        whole = sums.groupBy(*keys).agg(F.sum("words").alias("words"))
        found = {tuple(r[k] for k in keys): (r["at"], r["words"]) for r in whole.join(first, keys, "left").collect()}  # a row a group
        for key, (start, low, left) in list(open_.items()):
            at, words = found.get(key, (None, 0))
            if at is None:  # everything in this digit fits
                ends[key] = (low + (1 << (shift + DIGIT_BITS)) if level > 1 else LAST, left - words)
                del open_[key]
                continue
            open_[key] = (start, at["digit"] << shift, left - at["before"])
            if at["n"] == 1 or shift < DIGIT_BITS:
                ends[key] = open_.pop(key)[1:]
    return ends


def _fill(ranked: DataFrame, rest: dict[str, tuple[int, int]]) -> dict[tuple[str, int], int]:
    """How many more documents of which size a pattern takes, by (pattern, size): the largest that fit, down to none.

    rest: for each pattern the rank from which documents are free, and the words left. A job looks
    at the largest sizes that together fit, which are no more than the root of twice the words.
    """
    take: dict[tuple[str, int], int] = {}
    open_ = {key: (rank, left, left + 1) for key, (rank, left) in rest.items() if left > 0}
    while open_:
        rows = [(key, *v) for key, v in open_.items()]
        state = ranked.sparkSession.createDataFrame(rows, "pattern string, free long, open_words long, below long")
        fits = ranked.join(F.broadcast(state), "pattern").where("rank >= free and size <= open_words and size < below")
        sizes = fits.groupBy("pattern", "open_words", "size").agg(F.count(F.lit(1)).alias("n"))
        down = Window.partitionBy("pattern").orderBy(F.desc("size")).rowsBetween(Window.unboundedPreceding, -1)
        sizes = sizes.withColumn("before", F.coalesce(F.sum("size").over(down), F.lit(0))).where("before < open_words")
        seen = set()
        for r in sorted(sizes.collect(), key=lambda r: -r["size"]):
            key, size = r["pattern"], r["size"]
            free, left, _ = open_[key]
            n = min(r["n"], left // size)
            if n:
                take[key, size] = n
            open_[key] = (free, left - n * size, size)
            seen.add(key)
        open_ = {key: v for key, v in open_.items() if key in seen and v[1] > 0}
    return take


def _tiers(ranked: DataFrame, plan: Plan, max_repeats: int) -> dict[str, list[list[tuple[int, int, int, int]]]]:
    """For each pattern the runs (ranks from, before; sizes from, to) of its last pass, and of further ones for words still open.

    A pass takes documents by rank as long as they fit, then the largest later ones that fit. A further
    pass costs a repetition more, so it only gets what the pass before it left open,
    and no document is taken more than max_repeats times.
    """
    tiers: dict[str, list[list[tuple[int, int, int, int]]]] = {key: [] for key in plan.rest}
    left = dict(plan.rest)
    while left:
        ends = {key[0]: end for key, end in _ends(ranked, ["pattern"], {(key,): (0, n) for key, n in left.items()}).items()}
        take = _fill(ranked, ends)
        more = _ends(ranked, ["pattern", "size"], {(key, size): (ends[key][0], n * size) for (key, size), n in take.items()})
        still = {}
        for key, (end, words) in ends.items():
            own = [(end, more[k][0], k[1], k[1]) for k in take if k[0] == key]
            tiers[key].append([(0, end, 0, LAST), *own])
            still[key] = words - sum(take[k] * k[1] - more[k][1] for k in take if k[0] == key)
        left = {key: n for key, n in still.items() if 0 < n < left[key] and plan.passes[key] + len(tiers[key]) < max_repeats}
    return tiers


def _drawn(docs: DataFrame, id_col: str, text_col: str, memberships: Column | None, seed: int) -> Column:
    """size, members, pattern and rank of a document, as a struct. The rank is 40 bits drawn by id and text, then 23 by the row."""
    members = F.array("source") if memberships is None else memberships
    members = F.sort_array(F.array_distinct(F.coalesce(members, F.array().cast("array<string>"))))
    drawn = F.shiftleft(F.xxhash64(docs[id_col], docs[text_col], F.lit(seed)).bitwiseAND((1 << 40) - 1), 23)
    rank = drawn.bitwiseOR(F.xxhash64(F.monotonically_increasing_id(), F.lit(seed)).bitwiseAND((1 << 23) - 1))
    return F.struct(
        word_count(text_col).alias("size"), members.alias("members"), F.to_json(members).alias("pattern"), rank.alias("rank")
    )


def mix(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    memberships: Column | None = None,
    weights: dict | None = None,
    max_repeats: int = 3,
    seed: int = 42,
    max_patterns: int = 4096,
) -> tuple[DataFrame, Plan]:
    """docs with a struct ``mix`` (size, members, pattern, taken) added, and the plan.

    memberships: array of the sources of a document (default: its one source; null is a
    source of its own, an empty array none). weights: by source (default 1, 2, 3,
    repeating, over sources by code point, null last). taken is a multiple of size:
    documents are taken whole. A document that does not fit is passed
    over for smaller ones, until none that is left fits the pattern's words; words that are then
    open go to one more repetition of documents that fit. Rows equal in id
    and text are drawn one after another (their place in docs, which must read alike twice, tells
    them apart, and as they are alike reruns agree); empty and null texts have size 0 and nothing is taken of
    them; texts of any length are counted whole; an empty table gives no rows. A column named mix is
    replaced. More than max_patterns patterns raise an error.
    """
    spark = docs.sparkSession
    drawn = _drawn(docs, id_col, text_col, memberships, seed)
    sized = cut(docs.select(drawn.alias("mix")).select("mix.*"), "sized")
    found = sized.groupBy("pattern").agg(F.first("members").alias("members"), F.sum("size").alias("words"))
    rows = found.orderBy("pattern").limit(max_patterns + 1).collect()
    if len(rows) > max_patterns:
        raise ValueError(f"more than max_patterns={max_patterns} membership patterns")
    plan = route([(r["pattern"], list(r["members"]), r["words"]) for r in rows], weights, max_repeats)

    ranked = sized.select("pattern", "rank", "size").where("size > 0")
    tiers = _tiers(ranked, plan, max_repeats)
    discard(sized)

    state_type = f"pattern string, passes long, tiers array<{RUNS}>"
    state = spark.createDataFrame([(k, plan.passes[k], tiers[k]) for k in tiers], state_type)
    state = state.select(*(F.col(c).alias(f"__{c}") for c in state.columns))
    chosen = F.expr("size(filter(__tiers, t -> exists(t, r -> mix.rank >= r.low and mix.rank < r.high and mix.size between r.least and r.most)))")
    taken = F.col("mix.size") * (F.col("__passes") + chosen)
    drawn_docs = docs.withColumn("mix", drawn)  # patterns are bounded by max_patterns, so their state is broadcast
    joined = drawn_docs.join(F.broadcast(state), F.col("mix.pattern") == F.col("__pattern"))
    out = F.struct("mix.size", "mix.members", "mix.pattern", taken.alias("taken")).alias("mix")
    columns = docs.columns if "mix" in docs.columns else [*docs.columns, "mix"]
    return joined.select(*(out if c == "mix" else f"`{c}`" for c in columns)), plan


def apply_mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """docs as the mix takes them: a row for each time a document is taken, none for those left out."""
    mixed, _ = mix(docs.withColumnRenamed("mix", "__own_mix"), id_col, text_col, **options)
    times = F.expr("cast(mix.taken div mix.size as int)")
    again = mixed.where("mix.taken > 0").withColumn("__again", F.explode(F.array_repeat(F.lit(0), times)))
    return again.drop("mix", "__again").withColumnRenamed("__own_mix", "mix").select(*docs.columns)
