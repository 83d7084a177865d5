"""Coupled quotas: seats for (cluster, cell) pairs under caps on pairs and sources.

Quotas come from tables with one row a pair and class, aggregates over all candidates. The caps couple
all pairs, so the last step is sequential. It runs on an extract whose size is bounded by the seats: of
each pair and class somewhat more rows than it has seats, and the best rows of all. Should the step
come to the end of what it was given where there is more, it is run again on a larger extract, so the
seats are those of all candidates.
"""

from __future__ import annotations

import heapq
import itertools
from collections import Counter, defaultdict
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sieveloom.runtime import materialize

COLUMNS = ["row_id", "cls", "pair", "source", "score"]
OUT = "row_id long, cls string, pair string, seats_round int"
#: Pairs and classes together, one row each on the driver.
MAX_GROUPS = 200_000


def prepared(df: DataFrame) -> DataFrame:
    pair = F.concat_ws("_", F.coalesce(F.col("cluster_id").cast("string"), F.lit("-")), F.col("cell_key"))
    return df.select("row_id", F.coalesce("class_key", F.lit("_")).alias("cls"), pair.alias("pair"), "source", F.round("score", 9).alias("score"), "deficit")


def contenders(df: DataFrame, source_cap: int | None) -> DataFrame:
    """Rows that could get a seat: of one source in one pair and class no more than its cap, all without a cap.

    A row that repeats a source is its best one of a pair with room, so others aren't needed for that either."""
    df = df.select(*COLUMNS)
    if not source_cap:
        return df
    w = Window.partitionBy("cls", "pair", "source").orderBy(F.col("score").desc(), F.col("row_id"))
    return df.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= source_cap).drop("_r")


@dataclass
class Group:
    """What is known of a pair, of a pair within a class, or of a class."""

    size: int
    mean: float
    seen: int
    mass: float = 0.0


class Short(Exception):
    """The extract ended where there are more candidates."""


class Rows:
    """The extract, and how far it is complete: ``complete`` rows of each group, ``horizon`` rows of all."""

    def __init__(self, rows: list) -> None:
        self.ranked = sorted((r for r in rows if r.rank_all is not None), key=lambda r: r.rank_all)
        self.of_pair: dict[tuple, list] = defaultdict(list)
        self.of_class: dict[str, list] = defaultdict(list)
        for r in rows:
            if r.rank_pair is not None:
                self.of_pair[(r.cls if r.by_class else None, r.pair)].append(r)
            if r.rank_class is not None:
                self.of_class[r.cls].append(r)
        for g in self.of_pair.values():
            g.sort(key=lambda r: r.rank_pair)
        for g in self.of_class.values():
            g.sort(key=lambda r: r.rank_class)


def walk(rows: list, total: int):
    """The rows in order; beyond the last of an incomplete list there is no telling."""
    yield from rows
    if len(rows) < total:
        raise Short


class Ledger:
    """What has been selected so far, against the caps."""

    def __init__(self, top_k: int, pair_cap: int | None, source_cap: int | None, n_pairs: int) -> None:
        self.top_k, self.pair_cap, self.source_cap, self.n_pairs = top_k, pair_cap, source_cap, n_pairs
        self.rows: list[tuple] = []
        self.taken: set[int] = set()
        self.pairs: Counter = Counter()
        self.sources: Counter = Counter()

    def full(self) -> bool:
        """No seat is left, or no pair has room."""
        return len(self.rows) >= self.top_k or bool(self.pair_cap) and len(self.rows) >= self.n_pairs * self.pair_cap

    def take(self, r, again: bool = False, source_cap: int | None = None, mark: int = 0) -> bool:
        cap = source_cap or self.source_cap
        if self.full() or (r.row_id in self.taken and not again):
            return False
        if cap and self.sources[r.source] >= cap or self.pair_cap and self.pairs[r.pair] >= self.pair_cap:
            return False
        self.rows.append((r.row_id, r.cls, r.pair, mark, r))
        self.taken.add(r.row_id)
        self.pairs[r.pair] += 1
        self.sources[r.source] += 1
        return True

    def in_order(self, rows: Rows, plan: Plan):
        """All rows by score; under a cap on pairs the lists of the pairs with room merged, which end later."""
        if not self.pair_cap or not rows.of_pair:
            yield from walk(rows.ranked, plan.contenders[()])
            return
        lists = {k: walk(g, plan.contenders[k]) for k, g in rows.of_pair.items()}
        heap = [(-g[0].score, g[0].row_id, k) for k, g in rows.of_pair.items() if self.pairs[k[1]] < self.pair_cap]
        heapq.heapify(heap)
        for _, _, k in iter(lambda: heapq.heappop(heap) if heap else None, None):
            if self.pairs[k[1]] >= self.pair_cap:
                continue
            # what was only looked at is the list's next row
            r = next(lists[k])
            yield r
            if self.pairs[k[1]] < self.pair_cap and not self.full() and (n := next(lists[k], None)) is not None:
                lists[k] = itertools.chain([n], lists[k])
                heapq.heappush(heap, (-n.score, n.row_id, k))

    def fill(self, rows: Rows, plan: Plan, room=None) -> None:
        """The best rows of all, as long as seats are empty."""
        if not self.full() and (room is None or room() > 0):
            for r in self.in_order(rows, plan):
                self.take(r)
                if self.full() or room is not None and room() <= 0:
                    return

    def relax(self, rows: Rows, plan: Plan) -> None:
        """While seats are empty, let sources repeat once more a round; a row may then come twice."""
        cap = self.source_cap
        while cap and not self.full():
            cap, before = cap + 1, len(self.rows)
            for r in self.in_order(rows, plan):
                self.take(r, again=True, source_cap=cap, mark=cap)
                if self.full():
                    return
            if len(self.rows) == before:
                return


def apportion(weights: dict, seats: int, order: dict) -> dict:
    """Largest remainder in proportion to positive weights, evenly if there are none; ``order`` decides ties."""
    keys = [k for k in weights if weights[k] > 0] or list(weights)
    total = sum(weights[k] for k in keys)
    ideal = {k: seats * weights[k] / total if total > 0 else seats / len(keys) for k in keys}
    out = dict.fromkeys(weights, 0) | {k: int(v) for k, v in ideal.items()}
    for k in sorted(keys, key=lambda k: (-round(ideal[k] - int(ideal[k]), 9), order[k]))[: seats - sum(out.values())]:
        out[k] += 1
    return out


def pair_quotas(groups: dict[str, Group], seats: int, cap: int | None) -> dict[str, int]:
    """One seat a pair and the rest by mean deficit, within the cap; fewer seats than pairs are one each in order of need."""
    if seats <= len(groups):
        return dict.fromkeys(groups, 1)
    order = {p: i for i, p in enumerate(sorted(groups, key=lambda p: groups[p].seen))}
    extra = apportion({p: g.mean for p, g in groups.items()}, seats - len(groups), order)
    quota = {p: 1 + extra[p] for p in groups}
    if cap:
        spare = 0
        for p, g in groups.items():
            lost = min(quota[p], g.size) - min(cap, g.size)
            if quota[p] > cap and lost > 0:
                quota[p], spare = cap, spare + lost
        going = True
        while spare and going:
            going = False
            for p in sorted(groups, key=lambda p: (-groups[p].mean, order[p])):
                if spare and quota[p] < min(cap, groups[p].size):
                    quota[p], spare, going = quota[p] + 1, spare - 1, True
    return quota


def class_quotas(classes: dict[str, Group], seats: int) -> dict[str, int]:
    """A floor for every class, the rest by the classes' deficit, within what they have."""
    order = {c: i for i, c in enumerate(sorted(classes, key=lambda c: classes[c].seen))}
    floor = seats // len(classes)
    extra = apportion({c: max(0.0, g.mass) for c, g in classes.items()}, seats - floor * len(classes), order)
    quota, spare = {c: floor + extra[c] for c in classes}, 0
    for c, g in classes.items():
        spare, quota[c] = spare + max(0, quota[c] - g.size), min(quota[c], g.size)
    going = True
    while spare and going:
        going = False
        for c in order:
            if spare and quota[c] < classes[c].size:
                quota[c], spare, going = quota[c] + 1, spare - 1, True
    return quota


@dataclass
class Plan:
    """Sizes and quotas: pairs under (None, pair) or (class, pair), classes under their name."""

    total: int
    top_k: int
    pair_cap: int | None
    source_cap: int | None
    strategy: str
    classes: dict[str, Group]
    pairs: dict[str | None, dict[str, Group]]
    contenders: dict[tuple, int]

    @property
    def one(self) -> bool:
        return self.strategy == "pair_aware" or self.strategy == "stratified" and len(self.classes) == 1

    def class_seats(self) -> dict[str, int]:
        if self.strategy == "stratified_floor":
            return dict.fromkeys(self.classes, self.top_k // max(1, len(self.classes)))
        return class_quotas(self.classes, self.top_k)

    def seats(self) -> dict[tuple, int]:
        """Seats of each pair, (None, pair), or pair within a class, (class, pair)."""
        if self.strategy == "stratified_floor":
            return {}
        if self.one:
            return {(None, p): n for p, n in pair_quotas(self.pairs[None], self.top_k, self.pair_cap).items()}
        return {(c, p): n for c, k in self.class_seats().items() for p, n in pair_quotas(self.pairs[c], k, None).items()}


def pair_aware(rows: Rows, led: Ledger, plan: Plan, cls: str | None, seats: int, cap: int | None) -> None:
    groups, start = plan.pairs[cls], len(led.rows)
    room = lambda: seats - (len(led.rows) - start)
    quota = pair_quotas(groups, seats, cap)
    if seats <= len(groups):
        order = sorted(groups, key=lambda p: (-groups[p].mean, -groups[p].size, groups[p].seen))
    else:
        order = sorted(groups, key=lambda p: groups[p].seen)
    for p in order:
        got = 0
        if room() <= 0:
            break
        for r in walk(rows.of_pair[(cls, p)], plan.contenders[(cls, p)]):
            got += led.take(r)
            if got >= quota[p] or room() <= 0 or cap and led.pairs[p] >= cap:
                break
    if cls is None:
        led.fill(rows, plan, room)
    elif room() > 0:
        for r in walk(rows.of_class[cls], plan.contenders[(cls,)]):
            led.take(r)
            if room() <= 0:
                break


def stratified(rows: Rows, led: Ledger, plan: Plan) -> None:
    """Each class by pairs; the cap on pairs holds over all classes: the lowest keys of pairs above it leave,
    then floors are restored where possible and the seats left go to the best."""
    quota, floor = plan.class_seats(), plan.top_k // len(plan.classes)
    cap, led.pair_cap = led.pair_cap, None
    for c in sorted(plan.classes, key=lambda c: plan.classes[c].seen):
        pair_aware(rows, led, plan, c, quota[c], None)
    led.pair_cap = cap
    if cap:
        for row in sorted(led.rows, key=lambda x: (x[4].score, -x[0])):
            if led.pairs[row[2]] > cap:
                led.rows.remove(row)
                led.taken.discard(row[0])
                led.pairs[row[2]] -= 1
                led.sources[row[4].source] -= 1
        have = Counter(x[1] for x in led.rows)
        short = [c for c in plan.classes if have[c] < min(floor, quota[c])]
        # in the order of all rows: the lists of the pairs with room merged
        wants = lambda k: have[k[0]] < min(floor, quota[k[0]]) and led.pairs[k[1]] < cap
        lists = {(c, p): iter(walk(rows.of_pair[(c, p)], plan.contenders[(c, p)])) for c in short for p in plan.pairs[c]}
        ahead = {k: next(lists[k], None) for k in lists if wants(k)}
        while live := [k for k, r in ahead.items() if r is not None and wants(k)]:
            k = min(live, key=lambda k: (-ahead[k].score, ahead[k].row_id))
            have[k[0]] += led.take(ahead[k])
            ahead[k] = next(lists[k], None) if wants(k) else None
    led.fill(rows, plan)


def stratified_floor(rows: Rows, led: Ledger, plan: Plan) -> None:
    """The best of every class up to the floor, in the order of all rows, then the best of all."""
    floor, have = plan.top_k // max(1, len(plan.classes)), Counter()
    lists = {c: iter(walk(rows.of_class[c], plan.contenders[(c,)])) for c in plan.classes}
    ahead = {c: next(lists[c], None) for c in plan.classes} if floor else {}
    while live := [c for c in ahead if ahead[c] is not None and have[c] < floor and not led.full()]:
        c = min(live, key=lambda c: (-ahead[c].score, ahead[c].row_id))
        have[c] += led.take(ahead[c])
        if have[c] < floor:
            ahead[c] = next(lists[c], None)
    led.fill(rows, plan)


STRATEGIES = {"pair_aware": lambda rows, led, plan: pair_aware(rows, led, plan, None, led.top_k, led.pair_cap), "stratified": stratified, "stratified_floor": stratified_floor}


def _known(df: DataFrame, top_k: int, strategy: str, pair_cap: int | None, source_cap: int | None, rivals: DataFrame) -> Plan:
    """Aggregates over all candidates, one row a pair and class."""
    mean = df.groupBy("pair").agg(F.round(F.avg("deficit"), 9).alias("mean"))
    cells = df.groupBy("cls", "pair").agg(F.count("*").alias("n"), F.min("row_id").alias("seen"), F.round(F.avg("deficit"), 9).alias("own")).join(mean, "pair")
    left = rivals.groupBy("cls", "pair").agg(F.count("*").alias("rivals"))
    rows = cells.join(left, ["cls", "pair"]).limit(MAX_GROUPS + 1).collect()
    if len(rows) > MAX_GROUPS:
        raise ValueError(f"more than {MAX_GROUPS} pairs and classes")
    rows.sort(key=lambda r: r["seen"])
    classes: dict[str, Group] = {}
    pairs: dict[str | None, dict[str, Group]] = {None: {}}
    count: Counter = Counter()
    for r in rows:
        c, p, n, mean_ = r["cls"], r["pair"], r["n"], r["mean"] or 0.0
        k = classes.setdefault(c, Group(0, 0.0, r["seen"]))
        k.size, k.mass = k.size + n, k.mass + n * mean_
        k = pairs[None].setdefault(p, Group(0, mean_, r["seen"]))
        k.size += n
        pairs.setdefault(c, {})[p] = Group(n, r["own"] or 0.0, r["seen"])
        for key in ((), (c,), (c, p), (None, p)):
            count[key] += r["rivals"]
    total = sum(g.size for g in classes.values())
    return Plan(total, min(top_k, total), pair_cap, source_cap, strategy, classes, pairs, count)


def extract(rivals: DataFrame, plan: Plan, times: int) -> DataFrame:
    """Rows with their ranks among all, in their class and in their pair, null where too low for the extract.

    A group with n seats gives ``times`` (n + 4) rows, all rows together ``times`` (top_k + 4)."""
    spark, order = rivals.sparkSession, [F.col("score").desc(), F.col("row_id")]

    def best(keys: list[str], limits: dict[tuple, int], rank: str) -> DataFrame:
        most = times * (max(limits.values()) + 4)
        r = rivals.withColumn(rank, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col(rank) <= most)
        t = spark.createDataFrame([(*k, times * (n + 4)) for k, n in limits.items()], ", ".join(f"`_{k}` string" for k in keys) + ", _most long")
        return r.join(F.broadcast(t), [F.col(k) == F.col(f"_{k}") for k in keys]).where(F.col(rank) <= F.col("_most")).select(*COLUMNS, rank)  # a row a group, MAX_GROUPS at most

    parts = [rivals.orderBy(*order).limit(times * (plan.top_k + 4)).select(*COLUMNS, F.row_number().over(Window.orderBy(*order)).alias("rank_all"))]
    seats = plan.seats()
    if seats:
        by_class = not plan.one
        parts.append(best(["cls", "pair"] if by_class else ["pair"], {(k if by_class else k[1:]): n for k, n in seats.items()}, "rank_pair"))
    if not plan.one:
        parts.append(best(["cls"], {(c,): n for c, n in plan.class_seats().items()}, "rank_class"))
    out = None
    for x in parts:
        x = x.select(*COLUMNS, *[F.col(c) if c in x.columns else F.lit(None).cast("int").alias(c) for c in ("rank_all", "rank_pair", "rank_class")])
        out = x if out is None else out.unionByName(x)
    ranks = [F.max(c).alias(c) for c in ("rank_all", "rank_pair", "rank_class")]
    return out.groupBy(*COLUMNS).agg(*ranks).withColumn("by_class", F.lit(not plan.one))


def allocate(df: DataFrame, top_k: int, strategy: str = "pair_aware", pair_cap: int | None = None, source_cap: int | None = 1, times: int = 2) -> DataFrame:
    """(row_id, cls, pair, seats_round): at most top_k seats; seats_round is the source cap a repeat needed, else 0.

    Null classes are a class of their own, null clusters too; equal scores go by row_id; no candidates
    give no seats. Sources and pairs keep to their caps; only after every row has been looked at may a
    source repeat.
    """
    if strategy not in STRATEGIES:
        raise ValueError(f"unknown strategy {strategy}")
    df = materialize(prepared(df))
    rivals = materialize(contenders(df, source_cap))
    plan = _known(df, top_k, strategy, pair_cap, source_cap, rivals)
    if not plan.total:
        return df.sparkSession.createDataFrame([], OUT)

    def run(b: pd.DataFrame) -> pd.DataFrame:
        b = b.astype({c: object for c in ("rank_all", "rank_pair", "rank_class")}).where(b.notna(), None)
        rows, led = Rows(list(b.itertuples(index=False))), Ledger(plan.top_k, pair_cap, source_cap, len(plan.pairs[None]))
        try:
            STRATEGIES[strategy](rows, led, plan)
            led.relax(rows, plan)
        except Short:
            return pd.DataFrame([(None, None, None, -1)], columns=["row_id", "cls", "pair", "seats_round"])
        return pd.DataFrame([x[:4] for x in led.rows], columns=["row_id", "cls", "pair", "seats_round"])

    while True:
        seats = materialize(extract(rivals, plan, times).groupBy().applyInPandas(run, OUT))
        if not seats.where("seats_round = -1").limit(1).count():
            return seats
        times *= 4
