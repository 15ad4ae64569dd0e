"""Probabilistic linkage (Fellegi-Sunter): blocking, comparison levels, parameters by EM, weights and clusters."""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetweave.functions.similarity import level_edits, level_exact, level_similarity
from fleetweave.session import discard, staged


@dataclass(frozen=True)
class Comparison:
    """How one column is compared; `by_frequency` adjusts exact agreement by how common the value is."""

    kind: str
    column: str
    thresholds: tuple[float, ...] = ()
    by_frequency: bool = False

    @property
    def levels(self) -> int:
        return len(self.thresholds) + 2

    def level(self, a: Column, b: Column) -> Column:
        if self.kind == "levenshtein":
            return level_edits(a, b, tuple(int(t) for t in self.thresholds))
        if self.kind == "jaro_winkler":
            return level_similarity(a, b, self.thresholds)
        if self.kind == "exact":
            return level_exact(a, b)
        raise ValueError(f"unknown comparison {self.kind}")


#: Comparisons and blocking columns of devices (fixed values of the default profile).
DEVICE_COMPARISONS = (
    Comparison("levenshtein", "serial_number", (1.0, 2.0)), Comparison("levenshtein", "mac_clean", (1.0, 2.0)), Comparison("exact", "name_clean"),
    Comparison("exact", "ip_address", by_frequency=True), Comparison("exact", "manufacturer", by_frequency=True), Comparison("exact", "assigned_user", by_frequency=True), Comparison("exact", "os_family", by_frequency=True),
)
DEVICE_BLOCKING = ("serial_number", "mac_clean", "name_clean", "name_fallback")
#: The comparison that a rule on a column without one decides: pairs equal on the rule are equal on it.
IMPLIED = {"name_fallback": "name_clean"}
SWEEP = (10.0, 5.0, 0.0, -2.0, -5.0, -10.0)
_SMALL = 1e-9


def prepared(records: DataFrame, columns) -> DataFrame:
    """One row per unique_id (the last fetched) with blanks as null, so that they neither block nor match."""
    cols = list(dict.fromkeys(columns))
    uid = F.concat_ws("::", "source", "source_id")
    pick = F.max_by(F.struct(*(F.nullif(F.trim(c), F.lit("")).alias(c) for c in cols)), F.struct("fetched_at", F.hash(*cols)))
    return records.groupBy(uid.alias("uid"), "source").agg(pick.alias("r")).select("uid", "source", "r.*")


def blocked(rows: DataFrame, rules) -> DataFrame:
    """`(uid_l, uid_r, match_key)` of pairs equal on at least one rule's column, with the first such rule.

    A union of equi-joins, one per rule, each without the pairs of earlier rules; an OR of equalities would compare
    everything with everything.
    """
    out = []
    for i, c in enumerate(rules):
        l = rows.select(F.col("uid").alias("uid_l"), F.col(c).alias("k"), *(F.col(p).alias(f"l{j}") for j, p in enumerate(rules[:i])))
        r = rows.select(F.col("uid").alias("uid_r"), F.col(c).alias("k"), *(F.col(p).alias(f"r{j}") for j, p in enumerate(rules[:i])))
        fresh = reduce(Column.__and__, [~F.coalesce(F.col(f"l{j}") == F.col(f"r{j}"), F.lit(False)) for j in range(i)], F.lit(True))
        out.append(l.join(r, "k").where((F.col("uid_l") < F.col("uid_r")) & fresh).select("uid_l", "uid_r", F.lit(c).alias("match_key")))
    return reduce(DataFrame.unionByName, out)


def levels(pairs: DataFrame, rows: DataFrame, comparisons, rules=()) -> DataFrame:
    """`pairs` with a column `g_<column>` per comparison, and the left value of those adjusted by frequency.

    For those of `rules` that aren't compared, `b_<rule>` is whether the pair agrees on the rule (not only as the first).
    """
    more = [r for r in rules if r not in {c.column for c in comparisons}]
    cols = [*(c.column for c in comparisons), *more]
    l = rows.select(F.col("uid").alias("uid_l"), *(F.col(c).alias(f"l_{c}") for c in cols))
    r = rows.select(F.col("uid").alias("uid_r"), *(F.col(c).alias(f"r_{c}") for c in cols))
    both = pairs.join(l, "uid_l").join(r, "uid_r")
    return both.select(*pairs.columns, *(c.level(F.col(f"l_{c.column}"), F.col(f"r_{c.column}")).alias(f"g_{c.column}") for c in comparisons), *(F.col(f"l_{c.column}").alias(f"v_{c.column}") for c in comparisons if c.by_frequency), *(F.coalesce(F.col(f"l_{r}") == F.col(f"r_{r}"), F.lit(False)).alias(f"b_{r}") for r in more))


def prior(rows: DataFrame, rules, recall: float = 0.5) -> float:
    """Share of all pairs that match: pairs that agree on a rule over the recall of the rules.

    Counted from block sizes by inclusion of the rules one by one, so no pair is built to be counted.
    """
    n = rows.count()
    if n < 2:
        return 0.0
    size = F.col("count") * (F.col("count") - 1) / 2
    pairs = 0.0
    for i in range(len(rules)):
        # pairs equal on rule i but on none before: alternating sum over subsets of the earlier rules
        for mask in range(1 << i):
            keys = [rules[i], *(rules[j] for j in range(i) if mask >> j & 1)]
            if len(set(keys)) < len(keys):
                continue
            filled = rows.where(reduce(Column.__and__, [F.col(k).isNotNull() for k in keys]))
            k = filled.groupBy(*keys).count().agg(F.coalesce(F.sum(size), F.lit(0.0))).first()[0]
            pairs += (-1) ** bin(mask).count("1") * k
    return min(1 - _SMALL, max(_SMALL, pairs / recall / (n * (n - 1) / 2)))


def chance_agreement(rows: DataFrame, comparisons, most_pairs: int = 2_000_000) -> dict[str, list[float]]:
    """u: how often unrelated records reach each level, from at most `most_pairs` random pairs.

    The pairs are every sampled row with those that follow it by a fixed number of places in a hash order, so the work is
    in proportion to the sample and no product of tables is formed.
    """
    n = rows.count()
    if n < 2:
        return {c.column: [1.0 / c.levels] * c.levels for c in comparisons}
    take = min(n, 100_000)
    shifts = max(1, min(20, most_pairs // take))
    cols = [c.column for c in comparisons]
    sample = rows.where(F.pmod(F.xxhash64("uid"), F.lit(1_000_000)) < math.ceil(1_000_000 * take / n)).select("uid", *cols)
    buckets = max(1, take // 50)
    keyed = sample.withColumn("b", F.pmod(F.xxhash64("uid", F.lit(7)), F.lit(buckets)))
    l = keyed.select(F.col("b"), F.col("uid").alias("uid_l"), *(F.col(c).alias(f"l_{c}") for c in cols))
    r = keyed.select(F.col("b"), F.col("uid").alias("uid_r"), *(F.col(c).alias(f"r_{c}") for c in cols))
    pairs = l.join(r, "b").where((F.col("uid_l") < F.col("uid_r")) & (F.pmod(F.xxhash64("uid_l", "uid_r"), F.lit(50)) < shifts))
    aggs = [F.count_if(c.level(F.col(f"l_{c.column}"), F.col(f"r_{c.column}")) == g).alias(f"{c.column}_{g}") for c in comparisons for g in range(c.levels)]
    got = pairs.agg(*aggs).first().asDict()
    out = {}
    for c in comparisons:
        k = [got[f"{c.column}_{g}"] + 0.5 for g in range(c.levels)]
        out[c.column] = [x / sum(k) for x in k]
    return out


def patterns(leveled: DataFrame, comparisons, where: Column | None = None) -> list[tuple[tuple[int, ...], int]]:
    """How many pairs show each combination of levels; at most the product of the levels, whatever the number of pairs."""
    cols = [f"g_{c.column}" for c in comparisons]
    rows = (leveled if where is None else leveled.where(where)).groupBy(*cols).count().collect()
    return [(tuple(r[c] for c in cols), r["count"]) for r in rows]


def expectation_maximisation(counts, comparisons, lam: float, u: dict[str, list[float]], skip: str | None = None, rounds: int = 25) -> dict[str, list[float]]:
    """m: how often matches reach each level; `lam` and `u` stay fixed, the comparison on `skip` is left out."""
    used = [(i, c) for i, c in enumerate(comparisons) if c.column != skip]
    m = {c.column: [0.1 / (c.levels - 1)] * (c.levels - 1) + [0.9] for _, c in used}
    for _ in range(rounds):
        sums = {c.column: [_SMALL] * c.levels for _, c in used}
        for gammas, k in counts:
            odds = math.log(lam / (1 - lam))
            for i, c in used:
                if gammas[i] >= 0:
                    odds += math.log(max(m[c.column][gammas[i]], _SMALL) / max(u[c.column][gammas[i]], _SMALL))
            p = 1 / (1 + math.exp(-max(-700.0, min(700.0, odds))))
            for i, c in used:
                if gammas[i] >= 0:
                    sums[c.column][gammas[i]] += p * k
        m = {name: [x / sum(s) for x in s] for name, s in sums.items()}
    return m


def trained(leveled: DataFrame, comparisons, rules, lam: float, u: dict[str, list[float]], labels: DataFrame | None = None) -> dict[str, list[float]]:
    """m as the mean of one pass per blocking rule (within its pairs, the prior raised by what the rule implies) and of labelled pairs."""
    found: dict[str, list[list[float]]] = {c.column: [] for c in comparisons}
    by_name = {c.column: c for c in comparisons}
    for rule in rules:
        here = F.col(f"g_{rule}") == by_name[rule].levels - 1 if rule in by_name else F.col(f"b_{rule}") if f"b_{rule}" in leveled.columns else F.col("match_key") == rule
        counts = patterns(leveled, comparisons, here)
        if not counts:
            continue
        decided = IMPLIED.get(rule, rule)
        lift = 0.9 / max(u[decided][-1], _SMALL) if decided in u else 1.0
        inside = min(1 - 1e-6, max(1e-6, lam * lift / (lam * lift + 1 - lam)))
        seen = {c.column for i, c in enumerate(comparisons) if any(g[i] >= 0 for g, _ in counts)}  # without a value on both sides a pass says nothing
        for name, v in expectation_maximisation(counts, comparisons, inside, u, decided).items():
            if name in seen:
                found[name].append(v)
    if labels is not None:
        pos = leveled.join(labels.where("label = 1").select("uid_l", "uid_r"), ["uid_l", "uid_r"], "left_semi")
        counts = patterns(pos, comparisons)
        for i, c in enumerate(comparisons):
            k = [0.5] * c.levels
            for gammas, n in counts:
                if gammas[i] >= 0:
                    k[gammas[i]] += n
            found[c.column].append([x / sum(k) for x in k])
    default = lambda c: [0.1 / (c.levels - 1)] * (c.levels - 1) + [0.9]
    return {c.column: [sum(x) / len(x) for x in zip(*found[c.column])] if found[c.column] else default(c) for c in comparisons}


def weights(leveled: DataFrame, comparisons, lam: float, m: dict, u: dict, rows: DataFrame | None = None, least: float = -10.0) -> DataFrame:
    """Pairs with their `match_weight` (log2 of the odds), at least `least`. With `rows`, exact agreement counts more for rare values."""
    total = F.lit(math.log2(lam / (1 - lam)) if 0 < lam < 1 else 0.0)
    out = leveled
    adjusted = [c for c in comparisons if c.by_frequency and rows is not None]
    # how many rows have a value at all, for every adjusted column from one scan
    filled = rows.agg(*(F.count(c.column).alias(c.column) for c in adjusted)).first() if adjusted else {}
    for c in comparisons:
        g = F.col(f"g_{c.column}")
        part = F.lit(0.0)
        for k in range(c.levels):
            part = F.when(g == k, math.log2(max(m[c.column][k], _SMALL) / max(u[c.column][k], _SMALL))).otherwise(part)
        total = total + part
        if c in adjusted:
            tf = rows.where(F.col(c.column).isNotNull()).groupBy(F.col(c.column).alias(f"v_{c.column}")).agg((F.count(F.lit(1)) / max(filled[c.column], 1)).alias(f"tf_{c.column}"))
            out = out.join(tf, f"v_{c.column}", "left")
            total = total + F.when((g == c.levels - 1) & F.col(f"tf_{c.column}").isNotNull(), F.log2(F.lit(max(u[c.column][-1], _SMALL)) / F.col(f"tf_{c.column}"))).otherwise(0.0)
    return out.withColumn("match_weight", total).where(F.col("match_weight") >= least).select("uid_l", "uid_r", "match_key", "match_weight")


def clusters(edges: DataFrame, a: str = "uid_l", b: str = "uid_r") -> DataFrame:
    """`(uid, cluster_id)` of every end of an edge: the smallest id it is connected with.

    Alternates the large-star and small-star steps (Kiveris et al. 2014); each is one aggregate and one join, and rounds
    end when the edges no longer change. State is written between rounds.
    """
    now = staged(edges.where(F.col(a) != F.col(b)).select(F.least(a, b).alias("x"), F.greatest(a, b).alias("y")).distinct(), "star")
    key = lambda df: df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("x", "y").cast("decimal(38,0)"))).first()
    state = key(now)
    while state[0]:
        before = now
        both = now.select(F.col("x").alias("u"), F.col("y").alias("v")).unionByName(now.select(F.col("y").alias("u"), F.col("x").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("m").alias("x"), F.col("v").alias("y")).where("x <> y").distinct()
        down = large.select(F.col("y").alias("u"), F.col("x").alias("v"))
        low2 = down.groupBy("u").agg(F.min("v").alias("m"))
        small = down.join(low2, "u").select(F.col("m").alias("x"), F.col("v").alias("y")).where("x <> y").unionByName(low2.select(F.col("m").alias("x"), F.col("u").alias("y")))
        now = staged(small.distinct(), "star")
        discard(before)
        last, state = state, key(now)
        if state == last:
            break
    members = now.select(F.col("y").alias("uid"), F.col("x").alias("cluster_id"))
    return members.unionByName(now.select(F.col("x").alias("uid"), F.col("x").alias("cluster_id"))).distinct()


def with_singles(rows: DataFrame, found: DataFrame) -> DataFrame:
    """Every `uid` of `rows` with its cluster, its own id if it is in none."""
    return rows.select("uid").distinct().join(found, "uid", "left").select("uid", F.coalesce("cluster_id", "uid").alias("cluster_id"))


def sweep(rows: DataFrame, weighed: DataFrame, thresholds=SWEEP) -> DataFrame:
    """`(threshold, clusters, multi_source, three_plus)`. From high to low each labelling goes on from the one before."""
    out, label = [], rows.select("uid", F.col("uid").alias("cluster_id"))
    upper = None
    for t in sorted(thresholds, reverse=True):
        new = weighed.where(F.col("match_weight") >= t if upper is None else (F.col("match_weight") >= t) & (F.col("match_weight") < upper))
        l, r = label.select(F.col("uid").alias("uid_l"), F.col("cluster_id").alias("cl")), label.select(F.col("uid").alias("uid_r"), F.col("cluster_id").alias("cr"))
        merged = clusters(new.join(l, "uid_l").join(r, "uid_r").select("cl", "cr"), "cl", "cr").withColumnRenamed("cluster_id", "to")
        label = staged(label.join(merged.withColumnRenamed("uid", "cluster_id"), "cluster_id", "left").select("uid", F.coalesce("to", "cluster_id").alias("cluster_id")), "sweep")
        per = label.join(rows.select("uid", "source"), "uid").groupBy("cluster_id").agg(F.count_distinct("source").alias("s"))
        out.append(per.agg(F.lit(float(t)).alias("threshold"), F.count(F.lit(1)).alias("clusters"), F.count_if(F.col("s") > 1).alias("multi_source"), F.count_if(F.col("s") > 2).alias("three_plus")))
        upper = t
    return reduce(DataFrame.unionByName, out)


def training_pairs(records: DataFrame, keys: dict[str, Column]) -> DataFrame:
    """Positive pairs: for each key value and pair of sources, the smallest id of either; repeated pairs once."""
    out = []
    for k in keys.values():
        first = records.select(k.alias("k"), "source", "uid").where("k <> ''").groupBy("k", "source").agg(F.min("uid").alias("uid"))
        l, r = first.select("k", F.col("source").alias("source_l"), F.col("uid").alias("uid_l")), first.select("k", F.col("source").alias("source_r"), F.col("uid").alias("uid_r"))
        out.append(l.join(r, "k").where("source_l < source_r").select("uid_l", "uid_r", "source_l", "source_r"))
    return reduce(DataFrame.unionByName, out).distinct()


def negative_pairs(records: DataFrame, positives: DataFrame, per_bucket: int = 16, seed: int = 42) -> DataFrame:
    """Pairs of different sources that aren't positive, about two per positive, drawn by hash.

    Records meet in buckets of about `per_bucket`, however many records there are, so the pairs grow in proportion to them.
    """
    buckets = max(1, records.count() // per_bucket)
    b = F.pmod(F.xxhash64("uid", F.lit(seed)), F.lit(buckets))
    rows = records.select("uid", "source", b.alias("b"))
    l, r = rows.select("b", F.col("uid").alias("uid_l"), F.col("source").alias("source_l")), rows.select("b", F.col("uid").alias("uid_r"), F.col("source").alias("source_r"))
    drawn = l.join(r, "b").where("source_l < source_r").select("uid_l", "uid_r", "source_l", "source_r")
    fresh = drawn.join(positives.select("uid_l", "uid_r"), ["uid_l", "uid_r"], "left_anti")
    return fresh.orderBy(F.xxhash64("uid_l", "uid_r", F.lit(seed)), "uid_l", "uid_r").limit(2 * positives.count())


def assigned(new: DataFrame, mesh: DataFrame) -> DataFrame:
    """Incremental assignment: known records keep their cluster (a resolved one before a provisional one), others get `new-<system>-<8 hex>`."""
    rank = F.struct(F.col("cluster_id").startswith("new-"), F.col("cluster_id"))
    known = mesh.where("cluster_id <> ''").groupBy("source", "source_id").agg(F.min_by("cluster_id", rank).alias("known"))
    fresh = F.concat(F.lit("new-"), F.substring_index("source", "_", 1), F.lit("-"), F.substring(F.sha2(F.concat_ws("::", "source", "source_id"), 256), 1, 8))
    rows = new.drop("cluster_id").distinct()
    return rows.join(known, ["source", "source_id"], "left").withColumn("cluster_id", F.coalesce("known", fresh)).drop("known")
