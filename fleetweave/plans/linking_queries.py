"""Queries of linkage: blocking, levels, weights, clusters, labels, validation (J-08, J-12 to J-14, ER rows)."""

from __future__ import annotations

from pyspark.sql import functions as F

from fleetweave.operators import linking as L
from fleetweave.plans.registry import query
from fleetweave.sources.tables import table

_COLS = ["serial_number", "mac_clean", "name_clean", "name_fallback", "ip_address", "manufacturer", "assigned_user", "os_family"]
#: Fixed parameters, for results that SQL can state too; `em_train` estimates them.
LAMBDA = 0.001
M = {"serial_number": [0.02, 0.03, 0.05, 0.9], "mac_clean": [0.02, 0.03, 0.05, 0.9], "name_clean": [0.1, 0.9], "ip_address": [0.3, 0.7], "manufacturer": [0.1, 0.9], "assigned_user": [0.2, 0.8], "os_family": [0.2, 0.8]}
U = {"serial_number": [0.989, 0.005, 0.003, 0.003], "mac_clean": [0.99, 0.004, 0.003, 0.003], "name_clean": [0.995, 0.005], "ip_address": [0.99, 0.01], "manufacturer": [0.9, 0.1], "assigned_user": [0.99, 0.01], "os_family": [0.8, 0.2]}
#: Values that stand for "unknown" would block everything with everything.
_JUNK = ("n/a", "none", "null", "unknown", "-", "--", "?", "not set", "tbd", "default string", "to be filled by o.e.m.", "system serial number", "0", "0000000", "xxxxxxxx", "not specified", "123456789", "0123456789", "localhost", "laptop", "desktop", "android", "iphone", "ipad", "new-device")


def rows(s, d, resolved: bool = False):
    """The records to link, whatever cluster they have; with `resolved`, those of resolved clusters, as the SQL below states."""
    records = table(s, d, "source_records")
    return L.prepared(records.where("cluster_id like 'c-%'") if resolved else records, _COLS)


def keyed(s, d, resolved: bool = False):
    """`rows` whose blocking columns are null where they hold a placeholder."""
    r = rows(s, d, resolved)
    for c in L.DEVICE_BLOCKING:
        r = r.withColumn(c, F.when(~F.lower(c).isin(*_JUNK), F.col(c)))
    return r


_ROWS = """(select source || '::' || source_id as uid, source, arg_max({%s}, fetched_at) as r from source_records where cluster_id like 'c-%%' group by 1, 2)""" % ", ".join(f"'{c}': nullif(trim({c}), '')" for c in _COLS)
_LIST = ", ".join(f"'{j}'" for j in _JUNK)
_KEYED = "(select uid, source, " + ", ".join(f"case when lower(r.{c}) not in ({_LIST}) then r.{c} end as {c}" if c in L.DEVICE_BLOCKING else f"r.{c} as {c}" for c in _COLS) + f" from {_ROWS})"


# The same over the records of any cluster.
_ALL = lambda sql: sql.replace(" where cluster_id like 'c-%' group by 1, 2", " group by 1, 2")


def _blocking_sql() -> str:
    parts = []
    for i, c in enumerate(L.DEVICE_BLOCKING):
        fresh = "".join(f" and not coalesce(l.{p} = r.{p}, false)" for p in L.DEVICE_BLOCKING[:i])
        parts.append(f"select l.uid as uid_l, r.uid as uid_r, '{c}' as match_key from k l join k r on l.{c} = r.{c} and l.uid < r.uid{fresh}")
    return f"with k as {_KEYED} " + " union all ".join(parts)


# These cover the records of resolved clusters; each has a twin named `..._all` over all records.
query("blocking_pairs", _blocking_sql())(lambda s, d: L.blocked(keyed(s, d, True), L.DEVICE_BLOCKING))
query("blocking_pairs_all", _ALL(_blocking_sql()))(lambda s, d: L.blocked(keyed(s, d), L.DEVICE_BLOCKING))


def _level_sql(c: L.Comparison) -> str:
    a, b = f"l.{c.column}", f"r.{c.column}"
    arms = "".join(f" when levenshtein({a}, {b}) <= {int(t)} then {c.levels - 2 - i}" for i, t in enumerate(c.thresholds))
    return f"case when {a} is null or {b} is null then -1 when {a} = {b} then {c.levels - 1}{arms} else 0 end"


_LEVELS = f"with p as ({_blocking_sql()}), k as {_KEYED} select uid_l, uid_r, match_key, " + ", ".join(f"{_level_sql(c)} as g_{c.column}" for c in L.DEVICE_COMPARISONS) + " from p join k l on l.uid = uid_l join k r on r.uid = uid_r"


def leveled(s, d, resolved: bool = False):
    k = keyed(s, d, resolved)
    return L.levels(L.blocked(k, L.DEVICE_BLOCKING), k, L.DEVICE_COMPARISONS)


def _shown(df):
    return df.drop(*(f"v_{c.column}" for c in L.DEVICE_COMPARISONS))


def _patterns(df):
    return df.groupBy(*(f"g_{c.column}" for c in L.DEVICE_COMPARISONS)).agg(F.count(F.lit(1)).alias("n"))


def _fixed_score(df):
    return L.weights(df, L.DEVICE_COMPARISONS, LAMBDA, M, U).withColumn("match_weight", F.round("match_weight", 6))


query("gamma_levels", _LEVELS)(lambda s, d: _shown(leveled(s, d, True)))
query("gamma_levels_all", _ALL(_LEVELS))(lambda s, d: _shown(leveled(s, d)))
query("gamma_patterns", f"select {', '.join(f'g_{c.column}' for c in L.DEVICE_COMPARISONS)}, count(*) as n from ({_LEVELS}) group by all")(lambda s, d: _patterns(leveled(s, d, True)))
query("gamma_patterns_all", f"select {', '.join(f'g_{c.column}' for c in L.DEVICE_COMPARISONS)}, count(*) as n from ({_ALL(_LEVELS)}) group by all")(lambda s, d: _patterns(leveled(s, d)))
_WEIGHT = f"log2({LAMBDA} / (1 - {LAMBDA})) + " + " + ".join("case g_%s %s else 0 end" % (c.column, " ".join(f"when {k} then log2({M[c.column][k]} / {U[c.column][k]})" for k in range(c.levels))) for c in L.DEVICE_COMPARISONS)
query("pair_score_fixed", f"select uid_l, uid_r, match_key, round(match_weight, 6) as match_weight from (select *, {_WEIGHT} as match_weight from ({_LEVELS})) where match_weight >= -10")(lambda s, d: _fixed_score(leveled(s, d, True)))
query("pair_score_all", f"select uid_l, uid_r, match_key, round(match_weight, 6) as match_weight from (select *, {_WEIGHT} as match_weight from ({_ALL(_LEVELS)})) where match_weight >= -10")(lambda s, d: _fixed_score(leveled(s, d)))


def _frequency_sql() -> str:
    """Weights in which agreement on a value counts by how rare the value is."""
    by = [c for c in L.DEVICE_COMPARISONS if c.by_frequency]
    shares = ", ".join(f"tf_{c.column} as (select {c.column} as v, count(*)::double / (select count(*) from k where {c.column} is not null) as tf from k where {c.column} is not null group by 1)" for c in by)
    more = " + ".join(f"case when g_{c.column} = {c.levels - 1} then log2({U[c.column][-1]} / tf_{c.column}.tf) else 0 end" for c in by)
    joins = " ".join(f"left join tf_{c.column} on tf_{c.column}.v = l.{c.column}" for c in by)
    return f"""with k as {_ALL(_KEYED)}, g as ({_ALL(_LEVELS)}), {shares}
      select uid_l, uid_r, match_key, round(w, 6) as match_weight from (select g.uid_l, g.uid_r, g.match_key, {_WEIGHT} + {more} as w from g join k l on l.uid = g.uid_l {joins}) where w >= -10"""


query("weights_by_frequency", _frequency_sql())(lambda s, d: L.weights(leveled(s, d), L.DEVICE_COMPARISONS, LAMBDA, M, U, rows=keyed(s, d)).withColumn("match_weight", F.round("match_weight", 6)))
_EDGES = "select unique_id_l as a, unique_id_r as b from match_pairs where match_weight >= -5 and unique_id_l <> unique_id_r"


@query("connected_components", f"""with recursive e as ({_EDGES} union select b, a from ({_EDGES})), reach as (select a as uid, a as other from e union select uid, e.b from reach join e on e.a = other)
  select uid, min(other) as cluster_id from reach group by 1""")  # fmt: skip
def connected_components(s, d):
    return L.clusters(table(s, d, "match_pairs").where("match_weight >= -5 and unique_id_l <> unique_id_r"), "unique_id_l", "unique_id_r")


def _sweep_sql() -> str:
    one = """select cast({t} as double) as threshold, count(*) as clusters, count_if(s > 1) as multi_source, count_if(s > 2) as three_plus from (
      select cluster, count(distinct source) as s from (select v.uid, v.source, coalesce((select min(other) from (with recursive e as (
        select unique_id_l as a, unique_id_r as b from match_pairs where match_weight >= {t} union select unique_id_r, unique_id_l from match_pairs where match_weight >= {t}),
        reach as (select a as uid, a as other from e union select uid, e.b from reach join e on e.a = other) select * from reach) q where q.uid = v.uid), v.uid) as cluster
        from (select distinct source || '::' || source_id as uid, source from source_records where cluster_id = '') v) group by 1)"""
    return " union all ".join(one.format(t=t) for t in L.SWEEP)


@query("threshold_sweep", _sweep_sql())
def threshold_sweep(s, d):
    r = table(s, d, "source_records").where("cluster_id = ''").select(F.concat_ws("::", "source", "source_id").alias("uid"), "source").distinct()
    return L.sweep(r, table(s, d, "match_pairs").select(F.col("unique_id_l").alias("uid_l"), F.col("unique_id_r").alias("uid_r"), "match_weight"))


@query("pair_diagnostics", """select count(*) as pairs, count_if(source_l <> source_r) as cross_source, min(match_weight) as least, max(match_weight) as most, count_if(match_weight is null) as unweighed from match_pairs""")
def pair_diagnostics(s, d):
    return table(s, d, "match_pairs").agg(F.count(F.lit(1)).alias("pairs"), F.count_if(F.col("source_l") != F.col("source_r")).alias("cross_source"), F.min("match_weight").alias("least"), F.max("match_weight").alias("most"), F.count_if(F.col("match_weight").isNull()).alias("unweighed"))


@query("pair_sources", "select least(source_l, source_r) as a, greatest(source_l, source_r) as b, count(*) as n from match_pairs group by 1, 2 order by n desc, a, b limit 12")
def pair_sources(s, d):
    return table(s, d, "match_pairs").groupBy(F.least("source_l", "source_r").alias("a"), F.greatest("source_l", "source_r").alias("b")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "a", "b").limit(12)


_TRAIN = " union ".join(f"""select l.uid as uid_l, r.uid as uid_r, l.source as source_l, r.source as source_r from (select {k} as k, source, min(uid) as uid from t where {k} is not null group by 1, 2) l
  join (select {k} as k, source, min(uid) as uid from t where {k} is not null group by 1, 2) r using (k) where l.source < r.source""" for k in ("serial_number", "mac_clean", "name_clean"))


def positives(s, d, resolved: bool = False):
    return L.training_pairs(keyed(s, d, resolved), {k: F.coalesce(k, F.lit("")) for k in ("serial_number", "mac_clean", "name_clean")})


query("training_pairs", f"with t as {_KEYED} {_TRAIN}")(lambda s, d: positives(s, d, True))
query("training_pairs_all", _ALL(f"with t as {_KEYED} {_TRAIN}"))(positives)
query("negative_pairs")(lambda s, d: L.negative_pairs(keyed(s, d), positives(s, d)))
query("linkage_prior", f"select round(2.0 * (select count(*) from ({_ALL(_blocking_sql())})) / (n * (n - 1) / 2.0), 9) as lambda from (select count(*)::double as n from {_ALL(_ROWS)})")(lambda s, d: s.createDataFrame([(round(L.prior(keyed(s, d), L.DEVICE_BLOCKING), 9),)], "lambda double"))


def estimated(k, comparisons=L.DEVICE_COMPARISONS, rules=L.DEVICE_BLOCKING):
    """`(lambda, m, u)` of the records `k`: prior from all rules, u from random pairs, m by one EM pass per rule."""
    lam, u = L.prior(k, rules), L.chance_agreement(k, comparisons)
    return lam, L.trained(L.levels(L.blocked(k, rules), k, comparisons, rules), comparisons, rules, lam, u), u


@query("em_train")
def em_train(s, d):
    """`(column, level, m, u)` estimated from all records."""
    _, m, u = estimated(keyed(s, d))
    return s.createDataFrame([(c.column, g, float(m[c.column][g]), float(u[c.column][g])) for c in L.DEVICE_COMPARISONS for g in range(c.levels)], "column string, level int, m double, u double")


@query("incremental_assign", """with known as (select source, source_id, arg_min(cluster_id, (starts_with(cluster_id, 'new-'), cluster_id)) as known from source_records where cluster_id <> '' group by 1, 2)
  select distinct r.source, r.source_id, coalesce(known, 'new-' || split_part(r.source, '_', 1) || '-' || left(sha256(r.source || '::' || r.source_id), 8)) as cluster_id
  from raw_store r left join known using (source, source_id)""")  # fmt: skip
def incremental_assign(s, d):
    return L.assigned(table(s, d, "raw_store").select("source", "source_id"), table(s, d, "source_records").select("source", "source_id", "cluster_id")).select("source", "source_id", "cluster_id")
