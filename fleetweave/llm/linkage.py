"""p4: the same thing in tables without a common key.

1. Retrieval: an inverted index over parts of all attributes, scored by BM25 (a record has a part once, so a shared part
   counts its inverse document frequency). Of each record the `K` best of every other source are kept, among those that
   reach the least score. Pruning is exact: a pair that reaches it must share a part from the front of both records'
   lists, rarest first, up to where the rest of a list can't make up the score any more; a posting carries its record's
   list, so the first part two records share forms their pair, and is the only one that does. A frequent part is split
   over several tasks on one side and goes to all of them on the other.
2. Check: the odds that a pair is one thing by how each attribute agrees, as a mixture of matching and other pairs that
   expectation maximisation finds in the counts of agreement patterns of all candidates; no labels, no weights set by hand.
3. Mutual nearest: pairs that pass, and of which each is the other's best by score in the other's source.
4. Confidence: a logistic curve over these odds and the gap in score to the next best, fitted on a bounded sample of resolved
   records. Pairs of 0.5 and more are matches.

Records that agree in all attributes are one class in the index, however many they are; in a class the smallest id of
a source stands for that source, and `members` says which class every record is in.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetweave.llm.golden import real_value
from fleetweave.session import discard, staged

#: Letters that are read or typed for digits (fixed values).
CONFUSED = ("OILSBZ", "011582")
#: Least BM25 score of a candidate, as a share of the score of one part that two of N records have.
SHARE = 0.6
#: Candidates kept of each record in each other source.
K = 5
#: Records of a part above which its pairs are formed in several tasks.
HOT = 500
_ATTRIBUTES = ("ser", "mac", "nm", "ip")


def attributes(records: DataFrame, key: Column, source: str, serial: str, mac: str, name: str, ip: str, fetched: str) -> DataFrame:
    """`(u, source, ser, mac, nm, ip)` in one notation, null where a value says nothing; the last state of a key."""
    rows = records.select(key.alias("u"), F.col(source).alias("source"), F.struct(F.coalesce(F.col(fetched).cast("timestamp"), F.timestamp_seconds(F.lit(0))).alias("at"), F.col(serial).alias("s"), F.col(mac).alias("m"), F.col(name).alias("n"), F.col(ip).alias("i")).alias("r"))
    last = rows.where("u is not null and source is not null").groupBy("u", "source").agg(F.max("r").alias("r"))
    bare = F.regexp_replace(F.upper(real_value(F.col("r.s"))), r"^(S/N|SN|SVC|SERIAL|PC|CND|CN)\s*[-:# ]\s*", "")
    ser = F.translate(F.regexp_replace(bare, "[^A-Z0-9]", ""), *CONFUSED)
    hexa = F.regexp_replace(F.lower(F.coalesce(F.col("r.m"), F.lit(""))), "[^0-9a-f]", "")
    # a locally administered address (docks, virtual machines) names no machine
    local = F.substring(hexa, 2, 1).isin(*"2367abef")
    low = F.regexp_replace(F.lower(F.coalesce(real_value(F.col("r.n")), F.lit(""))), r"([-_ ]?(old|new|reimaged|bak|copy)|[-_ ]?x(64|86)|[-_ ]\d)+$", "")
    plain = F.regexp_replace(low, "[^a-z0-9]", "")
    nm = F.when(F.length(plain) > 2, F.translate(plain, CONFUSED[0].lower(), CONFUSED[1]))
    addr = F.trim(F.coalesce(F.col("r.i"), F.lit("")))
    return last.select(
        "u", "source", F.when(F.length(ser) >= 5, ser).alias("ser"), F.when(hexa.rlike("^[0-9a-f]{12}$") & ~local & ~hexa.rlike("^(0+|f+)$"), hexa).alias("mac"),
        nm.alias("nm"), F.when(addr.rlike("[.:]") & ~addr.isin("0.0.0.0", "127.0.0.1", "::", "::1"), addr).alias("ip"),
    )


def classes(attrs: DataFrame) -> DataFrame:
    """One row per distinct set of attributes: `(c, ser, mac, nm, ip, reps)`, `reps` with one record per source."""
    by = list(_ATTRIBUTES)
    one = attrs.where("coalesce(ser, mac, nm, ip) is not null").groupBy(*by, "source").agg(F.min("u").alias("u"))
    return one.groupBy(*by).agg(F.min("u").alias("c"), F.collect_list(F.struct("source", "u")).alias("reps"))  # as many as sources


def members(attrs: DataFrame) -> DataFrame:
    """`(unique_id, source, representative)`: the record of the same source and attributes that stands for each record.

    Records without any attribute stand for themselves. No window: the representative is a `min` joined back.
    """
    by = [*_ATTRIBUTES, "source"]
    first = attrs.groupBy(*by).agg(F.min("u").alias("first"))
    same = reduce(Column.__and__, [F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}")) for c in by])
    joined = attrs.alias("l").join(first.alias("r"), same)
    some = F.coalesce(*(F.col(f"l.{c}") for c in _ATTRIBUTES)).isNotNull()
    return joined.select(F.col("l.u").alias("unique_id"), F.col("l.source").alias("source"), F.when(some, F.col("first")).otherwise(F.col("l.u")).alias("representative"))


def _parts() -> Column:
    """`(tag, part)` of a row: each attribute as a whole and by halves that survive an error in the other half."""
    ser, mac, nm, ip = (F.col(c) for c in _ATTRIBUTES)
    half = lambda c, n, at: F.when(F.length(c) >= n + 1, F.substring(c, at, n))
    made = [
        (0, "s", ser), (0, "sl", half(ser, 6, 1)), (0, "sr", half(ser, 6, -6)), (1, "m", mac), (1, "ml", F.substring(mac, 1, 9)), (1, "mr", F.substring(mac, -7, 7)),
        (2, "n", nm), (2, "nl", half(nm, 6, 1)), (2, "nr", half(nm, 6, -6)), (3, "i", ip),
    ]
    return F.array_compact(F.array(*(F.when(c.isNotNull(), F.struct(F.lit(tag).alias("tag"), F.concat(F.lit(f"{name}:"), c).alias("part"))) for tag, name, c in made)))


def indexed(cls: DataFrame) -> DataFrame:
    """`cls` with `n` (records, one per class and source), `scale` and `parts`: `(idf, part, tag, open, classes)`, rarest first.

    `open` parts are in several classes. Frequencies count a class once for each source it has a record of.
    """
    posting = cls.select("c", F.size("reps").alias("k"), F.explode(_parts()).alias("p")).select("c", "k", "p.tag", "p.part")
    freq = posting.groupBy("part").agg(F.sum("k").alias("df"), F.count(F.lit(1)).alias("classes")).where("df > 1")
    total = cls.agg(F.coalesce(F.sum(F.size("reps")), F.lit(0)).alias("n"))
    n = total.scalar()
    idf = F.log(1.0 + (n - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weighed = posting.join(freq, "part").groupBy("c").agg(F.sort_array(F.collect_list(F.struct(idf.alias("idf"), "part", "tag", (F.col("classes") > 1).alias("open"), "classes")), asc=False).alias("parts"))  # ten at most
    return cls.join(weighed, "c").withColumn("scale", F.greatest(F.log(1.0 + (n - 1.5) / 2.5), F.lit(0.01)))


def _sum(parts: Column) -> Column:
    return F.aggregate(parts, F.lit(0.0), lambda s, x: s + x["idf"])


#: Levels of an attribute: missing on a side, different, close, equal in a common value, equal in a telling one.
LEVELS = (MISSING, DIFFERENT, CLOSE, COMMON, TELLING) = range(5)


def _levels(l: str, r: str, shared: Column | None = None, least: Column | None = None) -> dict[str, Column]:
    """The level of each attribute. Close is within two edits, of which none changes the last character, where numbers of one
    batch differ; an address also in another port of one machine. A value is telling if its part alone reaches `least`."""
    a = lambda c: F.col(f"{l}.{c}")
    b = lambda c: F.col(f"{r}.{c}")
    tail = lambda s: F.conv(F.substring(F.col(f"{s}.mac"), 5, 8), 16, 10).cast("long")
    edits = lambda c: F.levenshtein(a(c), b(c), 2) >= 0
    ends = lambda c: F.substring(a(c), -1, 1) == F.substring(b(c), -1, 1)
    close = {
        "ser": edits("ser") & ends("ser"), "nm": edits("nm") & ends("nm"), "ip": F.lit(False),
        "mac": edits("mac") | (F.substring(a("mac"), 1, 4) == F.substring(b("mac"), 1, 4)) & (F.abs(tail(l) - tail(r)) <= 1024),
    }
    out = {}
    for i, c in enumerate(_ATTRIBUTES):
        equal = F.lit(TELLING) if shared is None else F.when(F.exists(shared, lambda x: (x["tag"] == i) & F.substring(x["part"], 2, 1).eqNullSafe(F.lit(":")) & (x["idf"] >= least)), TELLING).otherwise(COMMON)
        out[c] = F.when(a(c).isNull() | b(c).isNull(), MISSING).when(a(c) == b(c), equal).when(close[c], CLOSE).otherwise(DIFFERENT)
    return out


def _pattern(shared: Column, least: Column) -> Column:
    """The levels of a pair as the digits of one number."""
    got = _levels("l", "r", shared, least)
    return reduce(lambda n, c: n * len(LEVELS) + got[c], _ATTRIBUTES, F.lit(0)).cast("int").alias("pattern")


def candidates(index: DataFrame, share: float = SHARE) -> DataFrame:
    """`(a, b, score, pattern, scale, ra, rb)` of class pairs `a < b` whose BM25 score reaches `share` of that of one part two records share."""
    least = F.col("scale") * share
    rest = lambda i: F.aggregate(F.slice("open", i + 1, F.size("open")), F.lit(0.0), lambda s, x: s + x["idf"])
    front = F.filter(F.transform("open", lambda x, i: F.struct(F.get("ids", i).alias("id"), x["classes"].alias("classes"), rest(i).alias("rest"))), lambda x: x["rest"] >= least)
    listed = index.withColumn("open", F.filter("parts", lambda x: x["open"])).withColumn("ids", F.transform("open", lambda x: F.xxhash64(x["part"])))
    keys = listed.select("c", *_ATTRIBUTES, "reps", "scale", "open", "ids", F.explode(front).alias("f"))
    tasks = F.greatest(F.lit(1), F.ceil(F.col("f.classes") / HOT)).cast("int")
    l = keys.select(F.struct(*keys.columns[:-1]).alias("l"), F.col("f.id").alias("id"), F.pmod(F.xxhash64("c"), tasks).cast("int").alias("salt"))
    r = keys.select(F.struct(*keys.columns[:-1]).alias("r"), F.col("f.id").alias("id"), F.explode(F.sequence(F.lit(0), tasks - 1)).alias("salt"))
    # the first part in common, by its hash, decides before anything dearer is worked out
    both = l.join(r, ["id", "salt"]).where((F.col("l.c") < F.col("r.c")) & (F.get(F.array_intersect("l.ids", "r.ids"), F.lit(0)) == F.col("id")))
    shared = F.array_intersect("l.open", "r.open")
    out = both.select(F.col("l.c").alias("a"), F.col("r.c").alias("b"), shared.alias("shared"), "l", "r").select("a", "b", "l", "r", "shared", _sum(F.col("shared")).alias("score"))
    out = out.where(F.col("score") >= F.col("l.scale") * share)
    return out.select("a", "b", "score", _pattern(F.col("shared"), F.col("l.scale") * share), F.col("l.scale").alias("scale"), F.col("l.reps").alias("ra"), F.col("r.reps").alias("rb"))


def pairs(index: DataFrame, share: float = SHARE) -> DataFrame:
    """`(lu, ls, ru, rs, score, pattern)` of record pairs of different sources, `lu < ru`, `score` relative to its scale:
    of classes that are candidates, and of records within a class."""
    side = F.struct(*_ATTRIBUTES, "scale")
    own = index.where(F.size("reps") > 1).select(side.alias("l"), side.alias("r"), "parts", "reps")
    within = own.select(_sum(F.col("parts")).alias("score"), _pattern(F.col("parts"), F.col("l.scale") * share), F.col("l.scale").alias("scale"), F.col("reps").alias("ra"), F.col("reps").alias("rb"), F.lit(True).alias("one"))
    every = candidates(index, share).drop("a", "b").withColumn("one", F.lit(False)).unionByName(within)
    relative = every.withColumn("score", F.col("score") / F.col("scale"))
    opened = relative.select("score", "pattern", "one", F.explode("ra").alias("x"), "rb").select("score", "pattern", "one", "x", F.explode("rb").alias("y"))
    ordered = F.col("x.u") < F.col("y.u")
    pick = lambda f, g: F.when(ordered, F.col(f)).otherwise(F.col(g))
    return opened.where((F.col("x.source") != F.col("y.source")) & (F.col("x.u") != F.col("y.u")) & (~F.col("one") | ordered)).select(
        pick("x.u", "y.u").alias("lu"), pick("x.source", "y.source").alias("ls"), pick("y.u", "x.u").alias("ru"), pick("y.source", "x.source").alias("rs"), "score", "pattern",
    )


def mutual(checked: DataFrame, k: int = K) -> DataFrame:
    """`(lu, ls, ru, rs, score, z, gap)` of pairs that are each other's nearest in the other's source.

    Of `(lu, ls, ru, rs, score, z)` the `k` best by score of each record in each other source are looked at (ties: the
    smaller id). Nearest is the best of them whose odds `z` aren't negative, `gap` its lead in score over the best of the
    others, which is negative if that one scores more and fails the check only.
    """
    to = lambda me, mine, you, there: F.struct(F.col(me).alias("me"), F.col(mine).alias("mine"), F.col(you).alias("you"), F.col(there).alias("there"), "score", "z")
    sides = checked.select(F.explode(F.array(to("lu", "ls", "ru", "rs"), to("ru", "rs", "lu", "ls"))).alias("e")).select("e.*")
    w = Window.partitionBy("me", "mine", "there").orderBy(F.desc("score"), "you")
    top = sides.withColumn("n", F.row_number().over(w)).where(F.col("n") <= k)
    seen = F.array_sort(F.collect_list(F.struct("n", "you", "score", "z"))).alias("seen")  # k at most
    lists = top.groupBy("me", "mine", "there").agg(seen).withColumn("b", F.get(F.filter("seen", lambda x: x["z"] >= 0), F.lit(0))).where("b is not null")
    rival = F.array_max(F.transform(F.filter("seen", lambda x: x["n"] != F.col("b.n")), lambda x: x["score"]))
    best = lists.select("me", "mine", "there", "b.you", "b.score", "b.z", (F.col("b.score") - F.coalesce(rival, F.lit(0.0))).alias("gap"))
    l = best.where("me < you").select(F.col("me").alias("lu"), F.col("mine").alias("ls"), F.col("you").alias("ru"), F.col("there").alias("rs"), "score", "z", F.col("gap").alias("g1"))
    r = best.where("me > you").select(F.col("you").alias("lu"), F.col("there").alias("ls"), F.col("me").alias("ru"), F.col("mine").alias("rs"), F.col("gap").alias("g2"))
    return l.join(r, ["lu", "ls", "ru", "rs"]).withColumn("gap", F.least("g1", "g2")).drop("g1", "g2")


def closed(links: DataFrame, attrs: DataFrame) -> DataFrame:
    """Links and what follows over one record between: partners in a source where neither side has one yet, unless their serials or addresses contradict."""
    to = lambda me, mine, you, there: F.struct(F.col(me).alias("me"), F.col(mine).alias("mine"), F.col(you).alias("you"), F.col(there).alias("there"), "strength")
    both = links.select(F.explode(F.array(to("lu", "ls", "ru", "rs"), to("ru", "rs", "lu", "ls"))).alias("e")).select("e.*")
    # a record has a link or none to each other source, so the list around it is as long as the sources are many
    around = both.groupBy("you").agg(F.collect_list(F.struct("me", "mine", "strength")).alias("x"))
    over = around.select(F.explode("x").alias("a"), "x").select("a", F.explode("x").alias("b")).where("a.me < b.me and a.mine <> b.mine")
    over = over.select(F.col("a.me").alias("lu"), F.col("a.mine").alias("ls"), F.col("b.me").alias("ru"), F.col("b.mine").alias("rs"), F.least("a.strength", "b.strength").alias("strength")).groupBy("lu", "ls", "ru", "rs").agg(F.max("strength").alias("strength"))
    taken = both.select("me", "there")  # once each: the nearest in a source is one record
    free = over.join(taken.select(F.col("me").alias("lu"), F.col("there").alias("rs")), ["lu", "rs"], "left_anti").join(taken.select(F.col("me").alias("ru"), F.col("there").alias("ls")), ["ru", "ls"], "left_anti")
    got = _levels("l", "r")
    checked = free.join(attrs.alias("l"), F.col("lu") == F.col("l.u")).join(attrs.alias("r"), F.col("ru") == F.col("r.u")).where((got["ser"] != DIFFERENT) & (got["mac"] != DIFFERENT)).select("lu", "ls", "ru", "rs", "strength")
    near = lambda me, there, you: F.row_number().over(Window.partitionBy(me, there).orderBy(F.desc("strength"), you))
    alone = checked.withColumn("n1", near("lu", "rs", "ru")).withColumn("n2", near("ru", "ls", "lu")).where("n1 = 1 and n2 = 1").drop("n1", "n2")
    return links.unionByName(alone)


@dataclass(frozen=True)
class Mixture:
    """Log odds: of a match among candidates, and what each level of each attribute adds."""

    prior: float
    weights: tuple[tuple[float, ...], ...]

    def odds(self) -> Column:
        z, code = F.lit(self.prior), F.col("pattern")
        for w in reversed(self.weights):
            digit = code % len(LEVELS)
            z = z + reduce(lambda c, i: c.when(digit == i, w[i]), range(1, len(LEVELS)), F.when(digit == 0, w[0]))
            code = F.floor(code / len(LEVELS))
        return z


#: Where the mixture starts: how matching pairs and how others reach the levels of serial and mac, and of name and address, which
#: pass from a machine to its successor. It counts like `PRIOR_PAIRS` pairs and a thousandth of all, so it decides only what
#: the data has no pairs for.
_STARTS = tuple(
    (0.0, *m) if side else (0.0, *u)
    for side in (1, 0)
    for m, u in [((0.05, 0.1, 0.05, 0.8), (0.94, 0.02, 0.02, 0.02))] * 2 + [((0.1, 0.1, 0.1, 0.7), (0.75, 0.05, 0.1, 0.1))] * 2
)
PRIOR_PAIRS, PRIOR_ODDS = 20, 0.1


def mixture(counts: list[tuple[int, int]], rounds: int = 100) -> Mixture:
    """From `(pattern, number of candidates)`; at most as many as there are patterns. A missing value says nothing."""
    import numpy as np

    n = len(LEVELS)
    codes = np.array([c for c, _ in counts], dtype=np.int64)
    times = np.array([k for _, k in counts], dtype=float)
    digits = np.stack([codes // n ** (len(_ATTRIBUTES) - 1 - i) % n for i in range(len(_ATTRIBUTES))], axis=1)
    hot = (digits[:, :, None] == np.arange(n)).astype(float)
    start = np.array(_STARTS).reshape(2, len(_ATTRIBUTES), n)
    m, u = start[0].copy(), start[1].copy()
    lam = PRIOR_ODDS
    for _ in range(rounds if len(counts) else 0):
        with np.errstate(divide="ignore"):
            ratio = np.where(np.arange(n) == MISSING, 0.0, np.log(np.maximum(m, 1e-9)) - np.log(np.maximum(u, 1e-9)))
        z = math.log(lam / (1 - lam)) + (hot * ratio).sum(axis=(1, 2))
        p = 1 / (1 + np.exp(-np.clip(z, -500, 500)))
        lam = float(((p * times).sum() + PRIOR_PAIRS * PRIOR_ODDS) / (times.sum() + PRIOR_PAIRS))
        for side, before, q in ((m, start[0], p * times), (u, start[1], (1 - p) * times)):
            got = np.einsum("k,kij->ij", q, hot)
            got[:, MISSING] = 0
            got = got + before * (PRIOR_PAIRS + 1e-3 * got.sum(axis=1, keepdims=True))
            side[:] = got / got.sum(axis=1, keepdims=True)
    ratio = np.log(np.maximum(m, 1e-9)) - np.log(np.maximum(u, 1e-9))
    ratio[:, MISSING] = 0
    return Mixture(math.log(lam / (1 - lam)), tuple(tuple(float(x) for x in r) for r in ratio))


def fitted(found: DataFrame) -> Mixture:
    """The mixture of all candidates; what reaches the driver is one count per pattern."""
    return mixture([(r[0], r[1]) for r in found.groupBy("pattern").count().collect()])


def calibrate(features, labels, rounds: int = 25) -> tuple[float, ...]:
    """Weights `(b0, b1, ...)` of a logistic curve by Newton steps; features are a matrix.

    A small ridge on the features in units of their spread keeps the weights finite where the labels can be told apart
    without error, and lets features of different units count alike there.
    """
    import numpy as np

    x, y = np.asarray(features, dtype=float), np.asarray(labels, dtype=float)
    spread = np.maximum(x.std(axis=0), 1e-9)
    x = np.column_stack([np.ones(len(y)), x / spread])
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + 1e-2 * np.eye(x.shape[1])
        w = w + np.linalg.solve(h, x.T @ (y - p) - 1e-2 * w)
    return float(w[0]), *(float(v) for v in w[1:] / spread)


#: Confidence where there are no resolved records to fit a curve on: the odds of the mixture as they are.
PLAIN = (0.0, 1.0, 0.0)


def fit(attrs: DataFrame, truth: DataFrame, most: int = 20_000, share: float = SHARE) -> tuple[float, ...]:
    """The curve `(intercept, odds, gap)` from resolved records: `attrs` of them and `truth` `(u, cluster)`.

    Examples are, for each record and other source, the best right candidate and the best wrong one as it would stand if
    the right ones weren't there. At most `most` of either kind are used, the first by hash.
    """
    t = truth.select("u", "cluster")
    index = staged(indexed(classes(attrs)), "p4-fit-index")
    known = staged(pairs(index, share), "p4-fit-pairs")
    odds = known.withColumn("z", fitted(known).odds())
    labelled = odds.join(t.select(F.col("u").alias("lu"), F.col("cluster").alias("lc")), "lu").join(t.select(F.col("u").alias("ru"), F.col("cluster").alias("rc")), "ru").withColumn("y", (F.col("lc") == F.col("rc")).cast("int"))
    side = lambda me, there, you: F.struct(F.col(me).alias("me"), F.col(there).alias("there"), F.col(you).alias("you"), "score", "z", "y")
    sides = labelled.select(F.explode(F.array(side("lu", "rs", "ru"), side("ru", "ls", "lu"))).alias("e")).select("e.*")
    w = Window.partitionBy("me", "there", "y").orderBy(F.desc("score"), "you")
    wrong = F.lead("score").over(w)
    best = sides.withColumn("n", F.row_number().over(w)).withColumn("after", wrong).where("n = 1")
    # a right candidate leads over the best wrong one, a wrong one over the next wrong one
    rival = F.max(F.when(F.col("y") == 0, F.col("score"))).over(Window.partitionBy("me", "there"))
    rows = best.withColumn("gap", F.col("score") - F.coalesce(F.when(F.col("y") == 1, rival).otherwise(F.col("after")), F.lit(0.0)))
    first = lambda y: rows.where(F.col("y") == y).orderBy(F.xxhash64("me", "there"), "me", "there").limit(most).select("z", "gap", "y").collect()
    examples = [*first(0), *first(1)]
    for df in (index, known):
        discard(df)
    if len({r["y"] for r in examples}) < 2:
        return PLAIN
    return calibrate([(r["z"], r["gap"]) for r in examples], [r["y"] for r in examples])


def matches(attrs: DataFrame, curve: tuple[float, ...] = PLAIN, share: float = SHARE, hops: int = 2, least: float = 0.5) -> DataFrame:
    """`(unique_id_l, unique_id_r, confidence)` of records of different sources that are the same thing, smaller id first.

    `attrs` as from `attributes`. Records without any telling value match nothing; of records of one source that agree
    in everything the smallest id is matched (`members` has the others); ties in score go to the smaller id. An empty
    table gives an empty table. What follows over one record between is added `hops` times.
    """
    attrs = staged(attrs, "p4-attributes")
    index = staged(indexed(classes(attrs)), "p4-index")
    found = staged(pairs(index, share), "p4-pairs")
    discard(index)
    best = mutual(found.select("lu", "ls", "ru", "rs", "score", fitted(found).odds().alias("z")))
    strength = 1 / (1 + F.exp(-(F.lit(curve[0]) + F.col("z") * curve[1] + F.col("gap") * curve[2])))
    links = staged(best.withColumn("strength", strength).where(F.col("strength") >= least).select("lu", "ls", "ru", "rs", "strength"), "p4-links")
    discard(found)
    for _ in range(hops):
        more = staged(closed(links, attrs), "p4-links")
        discard(links)
        links = more
    discard(attrs)
    return links.select(F.col("lu").alias("unique_id_l"), F.col("ru").alias("unique_id_r"), F.col("strength").alias("confidence"))
