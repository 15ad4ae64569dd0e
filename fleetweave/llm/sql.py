"""SQL that states the same as queries of this subpackage, for those that SQL can state on whole tables."""

from __future__ import annotations

from fleetweave.llm.golden import NO_VALUE

_PLACEHOLDERS = ", ".join("'" + x.replace("'", "''") + "'" for x in NO_VALUE)


def _best(field: str) -> str:
    return f"""(select cluster_id, arg_min(v, (r, -epoch_us(fetched_at), v)) as v from (
      select cluster_id, trim({field}) as v, rank_{field} as r, fetched_at
      from source_records join source_systems using (source)
      where cluster_id like 'c-%' and {field} is not null and lower(trim({field})) not in ({_PLACEHOLDERS})
        and not regexp_full_match(lower(trim({field})), '0+|x{{3,}}|-+|\\?+|\\.+|_+')) t
    group by cluster_id)"""


_FIELDS = ("serial_number", "os", "assigned_user")

P1_FOUND = " union all ".join(
    f"""select d.cluster_id, '{f}' as field from devices d left join {_best(f)} b using (cluster_id)
    where lower(trim(coalesce(d.{f}, ''))) <> lower(coalesce(b.v, ''))"""
    for f in _FIELDS
)

P1_SURVIVORS = (
    "select c.cluster_id, "
    + ", ".join(f"b{i}.v as {f}" for i, f in enumerate(_FIELDS))
    + " from (select distinct cluster_id from ("
    + " union all ".join(f"select cluster_id from {_best(f)} x{i}" for i, f in enumerate(_FIELDS))
    + ") u) c "
    + " ".join(f"left join {_best(f)} b{i} on b{i}.cluster_id = c.cluster_id" for i, f in enumerate(_FIELDS))
)

P2_FOUND = """
with recursive rec as (select distinct source || '::' || source_id as id from source_records where cluster_id = ''),
edge as (
  select unique_id_l as a, unique_id_r as b from match_pairs where match_weight >= -5 and unique_id_l <> unique_id_r
  union select unique_id_r, unique_id_l from match_pairs where match_weight >= -5 and unique_id_l <> unique_id_r
),
reach as (
  select id, id as other from rec
  union
  select r.id, e.b from reach r join edge e on e.a = r.other
)
select id as unique_id, min(other) as group_id from reach where other in (select id from rec) group by id
"""


def oracle_sql() -> dict[str, str]:
    return {"p1_found": P1_FOUND, "p1_survivors": P1_SURVIVORS, "p2_found": P2_FOUND}
