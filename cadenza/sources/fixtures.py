"""Catalogue views derived from the supplied TPC-H-like tables (see FIXTURES.md).

Each view is one SQL text that runs unchanged on Spark and DuckDB.  Table
references are written as ``{name}`` placeholders so that Spark can bind them
to DataFrames (``spark.sql(text, **frames)``) while the oracle renders them as
plain names inside a ``WITH`` clause.  Views are listed in dependency order.
"""

from __future__ import annotations

import re

BASE_TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem",
    "events", "documents", "embeddings", "pages", "benchmark", "labels",
    "conversations",
)

# Ordered: later views may refer to earlier ones.
VIEWS: dict[str, str] = {
    "artist": """select cast(c_custkey as bigint) id, concat('gid-', cast(c_custkey as string)) gid, case when c_custkey % 97 = 5 then 'Various Artists' when c_custkey % 89 = 7 then null else c_name end name, case when c_custkey % 13 = 3 then null else case c_mktsegment when 'HOUSEHOLD' then 1 when 'BUILDING' then 2 when 'MACHINERY' then 3 when 'FURNITURE' then 4 else 5 end end type, c_nationkey area, case when c_acctbal < 0 then 'in debt' else '' end comment from {customer}""",
    "artist_type": """select * from (values (1,'Person'),(2,'Group'),(3,'Orchestra'),(4,'Choir'),(5,'Other')) as t(id,name)""",
    "area": """select n_nationkey id, n_name name from {nation}""",
    "artist_credit": """select cast(c_custkey as bigint) id from {customer}""",
    "artist_credit_name": """select cast(c_custkey as bigint) artist_credit, cast(c_custkey as bigint) artist from {customer} union all select cast(c_custkey as bigint) artist_credit, cast(c_custkey as bigint) + 1 artist from {customer} where c_custkey % 7 = 0 and c_custkey + 1 in (select c_custkey from {customer})""",
    "genre": """select cast(row_number() over (order by p_name) as int) id, case when length(p_name) % 3 = 0 then upper(p_name) else p_name end name from (select distinct p_name from {part}) x""",
    "tag": """select cast(row_number() over (order by name) as int) id, name from (select distinct p_name name from {part} union select distinct p_type name from {part} union select distinct p_brand name from {part}) x""",
    "release_group": """select distinct o_custkey * 5 + cast(substr(o_orderpriority,1,1) as int) - 1 id, concat('rg-', cast(o_custkey * 5 + cast(substr(o_orderpriority,1,1) as int) - 1 as string)) gid, concat(substr(o_orderpriority,3), ' of ', cast(o_custkey as string)) name, o_custkey artist_credit, case when o_custkey % 4 = 1 then null else cast(substr(o_orderpriority,1,1) as int) end type, '' comment from {orders}""",
    "release": """select o_orderkey id, concat('rel-', cast(o_orderkey as string)) gid, o_custkey * 5 + cast(substr(o_orderpriority,1,1) as int) - 1 release_group, o_custkey artist_credit, case when o_orderkey % 6 = 0 then concat('Order ', cast(o_orderkey as string), ' (Deluxe)') when o_orderkey % 11 = 0 then concat('Order ', cast(o_orderkey as string), ' Bonus') else concat('Order ', cast(o_orderkey as string)) end name, case o_orderstatus when 'F' then 1 when 'O' then 2 else null end status, case when o_orderkey % 5 = 0 then null when o_orderkey % 5 = 1 then 145 when o_orderkey % 5 = 2 then 120 when o_orderkey % 5 = 3 then 134 else 9999 end language, case when o_orderkey % 7 = 0 then null else 28 end script, o_orderdate from {orders}""",
    "release_country": """select id release, extract(year from o_orderdate) date_year, extract(month from o_orderdate) date_month, extract(day from o_orderdate) date_day from {release} where id % 3 <> 0""",
    "release_unknown_country": """select id release, extract(year from o_orderdate) date_year, case when id % 2 = 0 then null else extract(month from o_orderdate) end date_month, case when id % 2 = 0 then null else extract(day from o_orderdate) end date_day from {release} where id % 3 = 0 and id % 9 <> 0""",
    "medium": """select distinct l_orderkey * 10 + case l_returnflag when 'A' then 0 when 'N' then 1 else 2 end id, l_orderkey release from {lineitem}""",
    "track": """select l_orderkey * 10 + l_linenumber id, l_orderkey * 10 + case l_returnflag when 'A' then 0 when 'N' then 1 else 2 end medium, case when l_partkey % 17 = 0 then null else cast(floor(l_extendedprice * 10) as bigint) end length, p_name name from {lineitem} join {part} on p_partkey = l_partkey""",
    "recording": """select distinct l_orderkey * 10 + l_linenumber id, o_custkey artist_credit from {lineitem} join {orders} on o_orderkey = l_orderkey""",
    "lt": """select l_orderkey, l_linenumber, o_custkey, o_custkey * 5 + cast(substr(o_orderpriority,1,1) as int) - 1 rg, l_returnflag, cast(l_quantity as int) - 3 cnt, t.id tag, case when l_partkey % 3 = 0 then p_name when l_partkey % 3 = 1 then p_type else p_brand end tname from {lineitem} join {orders} on o_orderkey=l_orderkey join {part} on p_partkey=l_partkey join {tag} t on t.name = case when l_partkey % 3 = 0 then p_name when l_partkey % 3 = 1 then p_type else p_brand end""",
    "artist_tag": """select o_custkey artist, tag, cast(max(cnt) as int) count from {lt} where l_linenumber = 1 and o_custkey % 3 = 0 group by o_custkey, tag""",
    "release_group_tag": """select rg release_group, tag, cast(max(cnt) as int) count from {lt} where l_linenumber = 2 and o_custkey % 5 <> 2 group by rg, tag""",
    "release_tag": """select l_orderkey release, tag, cast(max(cnt) as int) count from {lt} where l_linenumber >= 3 and o_custkey % 5 <> 2 group by l_orderkey, tag""",
    "recording_tag": """select l_orderkey * 10 + l_linenumber recording, tag, cnt count from {lt}""",
    "l_artist_genre": """select c_custkey entity0, cast(c_custkey % 64 + 1 as int) entity1 from {customer} where c_custkey % 10 = 4""",
    "l_artist_release_group": """select s_suppkey entity0, min(rg) entity1 from {lt} join {lineitem} l on l.l_orderkey = lt.l_orderkey and l.l_linenumber = lt.l_linenumber join {supplier} on s_suppkey = l.l_suppkey group by s_suppkey""",
    "l_artist_release": """select l_suppkey entity0, min(l_orderkey) entity1 from {lineitem} group by l_suppkey""",
    "l_artist_recording": """select l_suppkey entity0, max(l_orderkey * 10 + l_linenumber) entity1 from {lineitem} group by l_suppkey""",
    "release_group_meta": """select release_group id, cast(min(extract(year from o_orderdate)) as int) first_release_date_year from {release} where id % 8 <> 0 group by release_group""",
    "release_group_secondary_type_join": """select distinct l.rg release_group, length(l.tname) % 5 + 1 secondary_type from {lt} l where l_linenumber = 4""",
    "url": """select cast(page_id as bigint) id, url from {pages}""",
    "l_artist_url": """select c_custkey entity0, cast(c_custkey % 25 as bigint) entity1, c_custkey % 3 link from {customer} where c_custkey % 2 = 0 union all select c_custkey, cast(c_custkey % 23 as bigint), (c_custkey + 1) % 3 from {customer} where c_custkey % 4 = 0""",
    "link": """select * from (values (0, 183),(1, 179),(2, 352)) as t(id,link_type)""",
    "listens": """select user_id, ts, event_type, cast(regexp_extract(props, '([0-9]+)', 1) as bigint) artist from {events} where event_type in ('click','view','purchase')""",
    "release_listens": """select l.user_id, l.ts, l.event_type, r.gid release_gid from {listens} l join {release} r on r.artist_credit = l.artist""",
}

# The ``lt`` view lists ``{lt}`` without alias in one view; Spark binds the
# placeholder to a generated name, so qualify columns through an alias there.
VIEWS["l_artist_release_group"] = VIEWS["l_artist_release_group"].replace(
    "from {lt} join", "from {lt} lt join")

# Views whose ids number names in order: (the names, the view over ``{names}``).  Spark numbers them
# in range partitions; the texts above are their definition.
NUMBERED = {
    "genre": ("select distinct p_name name from {part}",
              "select cast(id as int) id, case when length(name) % 3 = 0 then upper(name) else name end name from {names}"),
    "tag": ("select distinct p_name name from {part} union select distinct p_type name from {part} union select distinct p_brand name from {part}",
            "select cast(id as int) id, name from {names}"),
}

# Views that Spark takes from another text with the same rows: the columns that fix a row meet before
# the others are made from them.
PLANNED = {
    "release_group": """select c * 5 + p - 1 id, concat('rg-', cast(c * 5 + p - 1 as string)) gid, concat(s, ' of ', cast(c as string)) name, c artist_credit, case when c % 4 = 1 then null else p end type, '' comment from (select distinct o_custkey c, cast(substr(o_orderpriority,1,1) as int) p, case when o_custkey is not null then substr(o_orderpriority,3) end s from {orders}) x""",
}

# ``lt`` with its suppliers and with the lines whose part has no tag (``tag`` null), written once
LINES = VIEWS["lt"].replace("l_linenumber, o_custkey,", "l_linenumber, l_suppkey, o_custkey,", 1).replace(
    "join {part}", "left join {part}").replace("join {tag}", "left join {tag}")

# A supplier's line and the lines of ``lt`` with its key have one order, so a line of ``lt`` needs no other;
# ``{untagged}`` are those that do.
LINKED_GROUPS = """select s_suppkey entity0, min(rg) entity1 from (select l_suppkey, rg from {lines} where tag is not null and l_linenumber is not null union all select u.l_suppkey, l.rg from {untagged} u join {lines} l on l.l_orderkey = u.l_orderkey and l.l_linenumber = u.l_linenumber where l.tag is not null) x join {supplier} on s_suppkey = l_suppkey group by s_suppkey"""

CATALOG_TABLES = tuple(v for v in VIEWS if v != "lt")

_PLACEHOLDER = re.compile(r"\{(\w+)\}")


def view_deps(name: str) -> list[str]:
    return _PLACEHOLDER.findall(VIEWS[name])


def render_plain(text: str) -> str:
    """Replace ``{name}`` placeholders with bare table names (oracle side)."""
    return _PLACEHOLDER.sub(lambda m: m.group(1), text)


def closure(names) -> list[str]:
    """Catalogue views needed (transitively) by ``names``, in dependency order."""
    need: set[str] = set()
    stack = [n for n in names if n in VIEWS]
    while stack:
        n = stack.pop()
        if n in need:
            continue
        need.add(n)
        stack.extend(d for d in view_deps(n) if d in VIEWS)
    return [v for v in VIEWS if v in need]


_WORD = re.compile(r"[A-Za-z_][A-Za-z0-9_]*")


def with_views(sql: str) -> str:
    """Prefix an oracle query with the catalogue views it references.

    ``sql`` may itself start with ``WITH``; its CTEs are appended after the
    catalogue views.
    """
    words = set(_WORD.findall(sql))
    views = closure(words & set(VIEWS))
    if not views:
        return sql
    ctes = ",\n".join(f"{v} AS ({render_plain(VIEWS[v])})" for v in views)
    body = sql.lstrip()
    if body[:4].lower() == "with" and body[4:5].isspace():
        return f"WITH {ctes},\n{body[5:]}"
    return f"WITH {ctes}\n{body}"
