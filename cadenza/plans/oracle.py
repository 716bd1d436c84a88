"""Independent DuckDB SQL for the registered queries (the correctness oracle).

Each text is plain ANSI-ish SQL over the catalogue view names; ``with_views``
prefixes the FIXTURES.md view definitions it needs.  Fragments below are CTE
bodies shared by several oracle queries.
"""

from __future__ import annotations

from cadenza.sources.fixtures import with_views

# genre token (X1) written for DuckDB's RE2
TOKEN = r"regexp_replace(regexp_replace(lower(trim({x})), '[^\p{{L}}\p{{N}}_]+', '_', 'g'), '^_+|_+$', '', 'g')"


def token_sql(x: str) -> str:
    return TOKEN.format(x=x)


ELIGIBLE_A = "a.name is not null and lower(a.name) <> 'various artists'"

CTE_TG = "tg AS (select t.id tag, g.name genre from tag t join genre g on lower(g.name) = lower(t.name))"

CTE_CRG = """crg AS (
  select acn.artist id, rg.id release_group_id from artist_credit_name acn join release_group rg on rg.artist_credit = acn.artist_credit
  union select acn.artist, r.release_group from artist_credit_name acn join release r on r.artist_credit = acn.artist_credit
  union select entity0, entity1 from l_artist_release_group
  union select l.entity0, r.release_group from l_artist_release l join release r on r.id = l.entity1)"""

CTE_CREL = """crel AS (
  select acn.artist id, r.id release_id from artist_credit_name acn join release r on r.artist_credit = acn.artist_credit
  union select crg.id, r.id from crg join release r on r.release_group = crg.release_group_id
  union select entity0, entity1 from l_artist_release)"""

CTE_CREC_ALL = """crec AS (
  select acn.artist id, rec.id recording_id from artist_credit_name acn join recording rec on rec.artist_credit = acn.artist_credit
  union select entity0, entity1 from l_artist_recording)"""


def cte_prim(n: int = 1) -> str:
    return f"""prim AS (
  select atg.artist id, tg.genre from artist_tag atg join tg on tg.tag = atg.tag where atg.count >= {n}
  union select l.entity0, g.name from l_artist_genre l join genre g on g.id = l.entity1
  union select crg.id, tg.genre from crg join release_group_tag t on t.release_group = crg.release_group_id and t.count >= {n} join tg on tg.tag = t.tag
  union select crel.id, tg.genre from crel join release_tag t on t.release = crel.release_id and t.count >= {n} join tg on tg.tag = t.tag)"""


def cte_train(n: int = 1) -> str:
    return f"""nop AS (select a.id from artist a where {ELIGIBLE_A} and not exists (select 1 from prim p where p.id = a.id)),
crec_np AS (
  select acn.artist id, rec.id recording_id from artist_credit_name acn join nop on nop.id = acn.artist join recording rec on rec.artist_credit = acn.artist_credit
  union select l.entity0, l.entity1 from l_artist_recording l join nop on nop.id = l.entity0),
train AS (
  select id, genre from prim
  union select c.id, tg.genre from crec_np c join recording_tag t on t.recording = c.recording_id and t.count >= {n} join tg on tg.tag = t.tag)"""


def cte_tokens(src: str, name: str, key: str = "id", val: str = "genre") -> str:
    """X2+X1+X3: per entity, first spelling per lower(trim) key, tokens sorted by spelling."""
    return f"""{name}_kept AS (select {key} id, min(trim({val})) spell from {src} where {val} is not null and trim({val}) <> '' group by {key}, lower(trim({val}))),
{name} AS (select id, list(tok order by spell) tokens from (select id, spell, {token_sql('spell')} tok from {name}_kept) x where tok <> '' group by id)"""


def cte_q1(n: int = 1) -> str:
    return ",\n".join([
        CTE_TG, CTE_CRG, CTE_CREL, cte_prim(n), cte_train(n), cte_tokens("train", "toks"),
        f"""feats AS (select a.id artist_id, a.gid artist_gid, a.name artist_name, aty.name artist_type, ar.name area_name,
  '' tags, array_to_string(toks.tokens, ' ') genres, cast(0 as bigint) tag_count_sum, toks.tokens
  from toks join artist a on a.id = toks.id left join artist_type aty on aty.id = a.type left join area ar on ar.id = a.area
  where {ELIGIBLE_A} and len(toks.tokens) > 0)"""])


CTE_TFIDF = """tf AS (select artist_id, token, cast(count(*) as double) tf from (select artist_id, unnest(tokens) token from feats) x group by artist_id, token),
nd AS (select count(*) n from feats),
voc AS (select token, count(*) df, ln((1.0 + max(nd.n)) / (1.0 + count(*))) + 1 idf from tf, nd group by token),
rawv AS (select tf.artist_id, tf.token, tf.tf * voc.idf raw from tf join voc using (token)),
vec AS (select artist_id, token, raw / sqrt(sum(raw * raw) over (partition by artist_id)) w from rawv)"""

# K3/K4 oracle: brute force over every candidate (zero dot -> distance 1)
CTE_RECOMMENDABLE = """recable AS (
  select a.id from artist a join artist_type aty on aty.id = a.type and aty.name in ('Person', 'Group')
  where a.id in (select acn.artist from artist_credit_name acn
                 where acn.artist_credit in (select artist_credit from release_group union select artist_credit from release)))"""


def q(sql: str) -> str:
    return with_views(sql)


ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None):
    if sql is not None:
        ORACLE[name] = q(sql)


# ----------------------------------------------------------------- artists
register("q1_artist_features", "WITH " + cte_q1() + """
select artist_id, artist_gid, artist_name, artist_type, area_name, tags, genres, tag_count_sum from feats""")

register("q1_artist_features_min2", "WITH " + cte_q1(2) + """
select artist_id, artist_gid, artist_name, artist_type, area_name, tags, genres, tag_count_sum from feats""")

register("u1_credited_release_groups", "WITH " + CTE_CRG + " select id, release_group_id from crg")
register("u2_credited_releases", "WITH " + CTE_CRG + ",\n" + CTE_CREL + " select id, release_id from crel")
register("u3_credited_recordings", "WITH " + CTE_CREC_ALL + " select id, recording_id from crec")
register("u4_primary_genres", "WITH " + ",\n".join([CTE_TG, CTE_CRG, CTE_CREL, cte_prim(1)]) +
         " select id, genre from prim")
register("u5_training_genres", "WITH " + ",\n".join([CTE_TG, CTE_CRG, CTE_CREL, cte_prim(1), cte_train(1)]) +
         " select id, genre from train")
register("u6_extended_genres", "WITH " + ",\n".join([CTE_TG, CTE_CRG, CTE_CREL, CTE_CREC_ALL]) + """
select distinct id, genre from (
  select crg.id, tg.genre from crg join release_group_tag t on t.release_group = crg.release_group_id and t.count >= 1 join tg on tg.tag = t.tag
  union all select crel.id, tg.genre from crel join release_tag t on t.release = crel.release_id and t.count >= 1 join tg on tg.tag = t.tag
  union all select crec.id, tg.genre from crec join recording_tag t on t.recording = crec.recording_id and t.count >= 1 join tg on tg.tag = t.tag) x""")
register("u8_primary_artists", """select distinct acn.artist id from artist_credit_name acn
  where acn.artist_credit in (select artist_credit from release_group union select artist_credit from release)""")
register("q6_recommendable_artists", "WITH " + CTE_RECOMMENDABLE + " select id from recable")
register("j7_without_primary", "WITH " + ",\n".join([CTE_TG, CTE_CRG, CTE_CREL, cte_prim(1)]) +
         f" select a.id from artist a where {ELIGIBLE_A} and a.id not in (select id from prim)")

register("k1_artist_vocab", "WITH " + cte_q1() + ",\n" + CTE_TFIDF +
         " select token, df, round(idf, 9) idf from voc")
register("k1_artist_vectors", "WITH " + cte_q1() + ",\n" + CTE_TFIDF +
         " select artist_id, token, round(w, 9) w from vec")

# ----------------------------------------------------------------- artist kNN
SEEDS_SQL, BL_SQL = "1, 2, 4", "33"


def cte_single(seeds: str, excl: str, cand_filter: str = "") -> str:
    return f"""seedv AS (select * from vec where artist_id in ({seeds})),
cen AS (select token, sum(w) / (select count(distinct artist_id) from seedv) w from seedv group by token),
cnorm AS (select sqrt(sum(w * w)) n from cen),
dots AS (select v.artist_id, sum(v.w * coalesce(cen.w, 0)) dot from vec v left join cen using (token)
         where v.artist_id not in ({excl}) {cand_filter} group by v.artist_id),
ranked AS (select artist_id, 1 - dot / (select n from cnorm) distance,
           row_number() over (order by round(1 - dot / (select n from cnorm), 9), artist_id) rank from dots)"""


register("k3_artist_knn_single", "WITH " + cte_q1() + ",\n" + CTE_TFIDF + ",\n" +
         cte_single(SEEDS_SQL, SEEDS_SQL + ", " + BL_SQL) + """
select rank, artist_id, round(distance, 6) distance, 'ok' status from ranked where rank <= 5""")

register("k4_artist_knn_all", "WITH " + cte_q1() + ",\n" + CTE_TFIDF + """,
ids AS (select distinct artist_id from vec),
dots AS (select a.artist_id q, b.artist_id c, sum(a.w * b.w) dot from vec a join vec b using (token)
         where a.artist_id <> b.artist_id group by a.artist_id, b.artist_id),
pairs AS (select q.artist_id q, c.artist_id c, 1 - coalesce(d.dot, 0) distance
          from ids q join ids c on q.artist_id <> c.artist_id left join dots d on d.q = q.artist_id and d.c = c.artist_id),
ranked AS (select q, c, distance, row_number() over (partition by q order by round(distance, 9), c) rank from pairs)
select q request_id, rank, c artist_id, round(distance, 6) distance from ranked where rank <= 5""")


def cte_enrich_artists(src: str) -> str:
    return f"""eg AS (select atg.artist id, list_sort(list(distinct upper(left(t.name, 1)) || lower(substr(t.name, 2)))) genres
        from artist_tag atg join tag t on t.id = atg.tag join genre g on g.name = t.name
        where atg.count >= 1 and atg.artist in (select artist_id from {src}) group by atg.artist),
eu AS (select l.entity0 id, list(u.url order by u.url, lk.link_type) urls,
        min(case when lk.link_type = 183 then u.url end) official_site
        from (select distinct l.entity0, l.entity1, l.link from l_artist_url l where l.entity0 in (select artist_id from {src})) l
        join url u on u.id = l.entity1 join link lk on lk.id = l.link group by l.entity0)"""


register("q7_artist_recommendations", "WITH " + cte_q1() + ",\n" + CTE_TFIDF + ",\n" + CTE_RECOMMENDABLE + ",\n" +
         cte_single(SEEDS_SQL, SEEDS_SQL + ", " + BL_SQL, "and v.artist_id in (select id from recable)") + """,
top AS (select * from ranked where rank <= 5),
""" + cte_enrich_artists("top") + """
select top.rank, top.artist_id, a.gid, a.name, coalesce(eg.genres, []) genres, coalesce(eu.urls, []) urls,
       eu.official_site, round(top.distance, 6) distance, 'ok' status
from top join artist a on a.id = top.artist_id left join eg on eg.id = top.artist_id left join eu on eu.id = top.artist_id""")

# ----------------------------------------------------------------- albums


def mode_sql(col: str, src: str = "release", key: str = "release_group") -> str:
    """A4 in plain SQL: most frequent non-null value, ties -> lowest."""
    return f"""m_{col} AS (select {key}, {col} from (select {key}, {col}, row_number() over (partition by {key} order by count(*) desc, {col}) rn
        from {src} where {col} is not null group by {key}, {col}) x where rn = 1)"""


CTE_Q3 = ",\n".join([
    """atl AS (select r.release_group, rt.tag tag_id from release r join release_tag rt on rt.release = r.id
  union all select rgt.release_group, rgt.tag from release_group_tag rgt)""",
    "tcl AS (select atl.release_group, atl.tag_id, g.id genre_id from atl join tag t on t.id = atl.tag_id left join genre g on g.name = t.name)",
    """tb AS (select release_group, list_sort(array_agg(distinct cast(tag_id as int))) tag_ids from
  (select release_group, tag_id, count(*) n from tcl where genre_id is null group by release_group, tag_id) x where n > 1 group by release_group)""",
    """gb AS (select release_group, list_sort(array_agg(distinct cast(genre_id as int))) genre_ids from
  (select release_group, genre_id, count(*) n from tcl where genre_id is not null group by release_group, genre_id) x where n > 0 group by release_group)""",
    mode_sql("status"), mode_sql("language"), mode_sql("script"),
    """st AS (select release_group, list_sort(array_agg(distinct cast(secondary_type as int))) secondary_type_ids
  from release_group_secondary_type_join group by release_group)""",
    """q3 AS (select rg.id, cast(rg.type as int) type, cast(rgm.first_release_date_year as int) AS year,
  coalesce(tb.tag_ids, cast([] as int[])) tag_ids, coalesce(gb.genre_ids, cast([] as int[])) genre_ids,
  cast(ms.status as int) status, cast(ml.language as int) language, cast(mc.script as int) script,
  coalesce(st.secondary_type_ids, cast([] as int[])) secondary_type_ids
  from release_group rg left join release_group_meta rgm on rgm.id = rg.id
  left join tb on tb.release_group = rg.id left join gb on gb.release_group = rg.id
  left join m_status ms on ms.release_group = rg.id left join m_language ml on ml.release_group = rg.id
  left join m_script mc on mc.release_group = rg.id left join st on st.release_group = rg.id)"""])

register("q3_rg_features", "WITH " + CTE_Q3 + " select * from q3")
register("a4_release_modes", "WITH " + ",\n".join([mode_sql("status"), mode_sql("language"), mode_sql("script")]) + """,
rgs AS (select distinct release_group from release)
select rgs.release_group, ms.status, ml.language, mc.script from rgs left join m_status ms using (release_group)
  left join m_language ml using (release_group) left join m_script mc using (release_group)""")
register("a5_secondary_types", """select release_group, list_sort(array_agg(distinct cast(secondary_type as int))) secondary_type_ids
  from release_group_secondary_type_join group by release_group""")

EDITION_CASE = """case when lower(r.name) like '%super deluxe%' then 1 when lower(r.name) like '%deluxe%' then 1
  when lower(r.name) like '%expanded%' then 1 when lower(r.name) like '%anniversary%' then 1
  when lower(r.name) like '%bonus%' then 1 when lower(r.name) like '%collector%' then 1 else 0 end"""

CTE_FIRST = f"""fr AS (select release_group, release_id from (select r.release_group, r.id release_id,
  row_number() over (partition by r.release_group order by {EDITION_CASE},
    coalesce(rc.date_year, ruc.date_year) nulls last, coalesce(rc.date_month, ruc.date_month) nulls last,
    coalesce(rc.date_day, ruc.date_day) nulls last, r.id) rn
  from release r left join release_country rc on rc.release = r.id
  left join release_unknown_country ruc on ruc.release = r.id and rc.release is null) x where rn = 1)"""

CTE_RS = """rs AS (select r.release_group, r.id release_id, count(t.id) tracks, cast(sum(t.length) as bigint) length
  from release r join medium m on m.release = r.id join track t on t.medium = m.id group by r.release_group, r.id)"""

CTE_LEN_AFTER_FIRST = CTE_RS + """,
ors AS (select fr.release_group, rs.tracks original_tracks from fr join rs on rs.release_id = fr.release_id),
rts AS (select ors.release_group, ors.original_tracks tracks,
  (list(rs.length order by rs.release_id) filter (where rs.length is not null))[1] length
  from ors join rs on rs.release_group = ors.release_group and rs.tracks = ors.original_tracks
  group by ors.release_group, ors.original_tracks)"""
CTE_LEN = CTE_FIRST + ",\n" + CTE_LEN_AFTER_FIRST

register("w1_original_edition", "WITH " + CTE_FIRST + " select release_group, release_id from fr")
register("a7_release_stats", "WITH " + CTE_RS + " select * from rs")
register("a8_rg_length", "WITH " + CTE_LEN + " select release_group, tracks, length from rts")

CTE_RGART = """rgart AS (select distinct r.release_group, a.id artist, a.name from release r
  join artist_credit ac on ac.id = r.artist_credit join artist_credit_name acn on acn.artist_credit = ac.id
  join artist a on a.id = acn.artist)"""
register("a9_rg_artists", "WITH " + CTE_RGART + """
select release_group, array_to_string(list_sort(array_agg(distinct name) filter (where name is not null)), ', ') artist from rgart group by release_group""")

CTE_BACKFILL = """empty AS (select id from q3 where len(genre_ids) = 0),
bl AS (select r.release_group id, atg.tag tag_id from empty e join release r on r.release_group = e.id
  join artist_credit ac on ac.id = r.artist_credit join artist_credit_name acn on acn.artist_credit = ac.id
  join artist_tag atg on atg.artist = acn.artist),
btb AS (select id, list_sort(array_agg(distinct cast(tag_id as int))) tag_ids from (select id, tag_id, count(*) n from bl group by id, tag_id) x where n > 1 group by id),
bgb AS (select bl.id, list_sort(array_agg(distinct cast(g.id as int))) genre_ids from bl join tag t on t.id = bl.tag_id join genre g on g.name = t.name group by bl.id),
bf AS (select e.id, coalesce(btb.tag_ids, cast([] as int[])) tag_ids, coalesce(bgb.genre_ids, cast([] as int[])) genre_ids
  from empty e left join btb on btb.id = e.id left join bgb on bgb.id = e.id),
q3b AS (select q3.id, q3.type, q3.year,
  case when len(q3.tag_ids) = 0 and bf.id is not null then bf.tag_ids else q3.tag_ids end tag_ids,
  case when len(q3.genre_ids) = 0 and bf.id is not null then bf.genre_ids else q3.genre_ids end genre_ids,
  q3.status, q3.language, q3.script, q3.secondary_type_ids from q3 left join bf on bf.id = q3.id)"""

register("k7_backfill_genres", "WITH " + CTE_Q3 + ",\n" + CTE_BACKFILL + " select id, tag_ids, genre_ids from q3b")


def cte_types(src: str, out: str) -> str:
    return CTE_FIRST + f""",
tmeta AS (select fr.release_group id, count(t.id) tn, sum(t.length) lm from fr join medium m on m.release = fr.release_id
  join track t on t.medium = m.id where fr.release_group in (select id from {src} where type is null) group by fr.release_group),
tcls AS (select id, case when tn is null or lm is null then null when tn > 8 or lm > 1800000 then 1
  when tn = 1 and lm < 420000 then 2 else 3 end t from tmeta),
{out} AS (select s.* replace (cast(coalesce(s.type, tcls.t) as int) as type) from {src} s left join tcls on tcls.id = s.id)"""


register("k10_infer_types", "WITH " + CTE_Q3 + ",\n" + cte_types("q3", "q3t") + " select id, type from q3t")


CTE_STATS = """stats AS (select
  (select type from (select type, count(*) c from {d} where type is not null group by type order by c desc, type limit 1)) type,
  (select status from (select status, count(*) c from {d} where status is not null group by status order by c desc, status limit 1)) status,
  (select language from (select language, count(*) c from {d} where language is not null group by language order by c desc, language limit 1)) language,
  (select script from (select script, count(*) c from {d} where script is not null group by script order by c desc, script limit 1)) script,
  (select cast(cast(avg(year) as float) as double) from {d}) AS year)"""

register("k11_imputer_stats", "WITH " + CTE_Q3 + ",\n" + CTE_STATS.format(d="q3") + """
select cast(type as double) type, cast(status as double) status, cast(language as double) language,
       cast(script as double) script, year from stats""")


def cte_album_knn(seeds: str, excl: str, genre_filter: str | None) -> str:
    """K5 over the full model (``q5``): exclusions and genre filter, then the exact ranking."""
    gf = f"and len(list_intersect(c.genre_ids, [{genre_filter}])) > 0" if genre_filter else ""
    return CTE_STATS.format(d="q5") + f""",
imp AS (select q5.id, cast(coalesce(cast(cast(q5.type as float) as double), stats.type) as double) s0,
  coalesce(cast(cast(q5.status as float) as double), stats.status) s1, coalesce(cast(cast(q5.language as float) as double), stats.language) s2,
  coalesce(cast(cast(q5.script as float) as double), stats.script) s3, coalesce(cast(cast(q5.year as float) as double), stats.year) s4,
  q5.tag_ids, q5.genre_ids, q5.secondary_type_ids from q5, stats),
sd AS (select * from q5 where id in ({seeds})),
prof AS (select
  (select type from (select type, count(*) c from sd where type is not null group by type order by c desc, type limit 1)) type,
  (select status from (select status, count(*) c from sd where status is not null group by status order by c desc, status limit 1)) status,
  (select language from (select language, count(*) c from sd where language is not null group by language order by c desc, language limit 1)) language,
  (select script from (select script, count(*) c from sd where script is not null group by script order by c desc, script limit 1)) script,
  (select cast(round_even(avg(year), 0) as int) from sd) AS year,
  (select list_sort(list_distinct(flatten(list(tag_ids)))) from sd) tag_ids,
  (select list_sort(list_distinct(flatten(list(genre_ids)))) from sd) genre_ids,
  (select list_sort(list_distinct(flatten(list(secondary_type_ids)))) from sd) secondary_type_ids),
p AS (select coalesce(cast(cast(prof.type as float) as double), stats.type) s0, coalesce(cast(cast(prof.status as float) as double), stats.status) s1,
  coalesce(cast(cast(prof.language as float) as double), stats.language) s2, coalesce(cast(cast(prof.script as float) as double), stats.script) s3,
  coalesce(cast(cast(prof.year as float) as double), stats.year) s4, prof.tag_ids, prof.genre_ids, prof.secondary_type_ids from prof, stats),
sc AS (select c.id, c.genre_ids,
  c.s0 * p.s0 + c.s1 * p.s1 + c.s2 * p.s2 + c.s3 * p.s3 + c.s4 * p.s4 + len(list_intersect(c.tag_ids, p.tag_ids))
    + len(list_intersect(c.genre_ids, p.genre_ids)) + len(list_intersect(c.secondary_type_ids, p.secondary_type_ids)) dot,
  c.s0 * c.s0 + c.s1 * c.s1 + c.s2 * c.s2 + c.s3 * c.s3 + c.s4 * c.s4 + len(c.tag_ids) + len(c.genre_ids) + len(c.secondary_type_ids) nc,
  p.s0 * p.s0 + p.s1 * p.s1 + p.s2 * p.s2 + p.s3 * p.s3 + p.s4 * p.s4 + len(p.tag_ids) + len(p.genre_ids) + len(p.secondary_type_ids) np
  from imp c, p),
dist AS (select id, genre_ids, case when nc > 0 and np > 0 then 1 - dot / (sqrt(np) * sqrt(nc)) else 1 end distance from sc),
kept AS (select c.id, c.distance from dist c where c.id not in ({excl}) {gf}),
ranked AS (select id, distance, row_number() over (order by round(distance, 12), id) rank from kept)"""


# ----------------------------------------------------------------- search, profiles, report, display
register("p7_search_artists", "select id, name, comment disambiguation from artist where name ilike '%00001%' order by id limit 20")
register("p8_search_genres", "select id, name from genre where name ilike '%blue%' order by id limit 20")
register("j1_search_albums", """select rg.id release_group_id, rg.name title, a.name artist, rg.comment disambiguation
  from release_group rg join artist_credit ac on rg.artist_credit = ac.id join artist_credit_name acn on ac.id = acn.artist_credit
  join artist a on acn.artist = a.id where rg.name ilike '%urgent%' order by rg.id, a.id limit 20""")
register("p9_listened_artist_gids", """select a.gid, a.id from artist a
  where a.gid in (select distinct 'gid-' || cast(artist as varchar) from listens)""")

RANGE_SQL = {
    "this_week": "ts >= date_trunc('week', b.n) and ts <= b.n",
    "this_month": "ts >= date_trunc('month', b.n) and ts <= b.n",
    "this_year": "ts >= date_trunc('year', b.n) and ts <= b.n",
    "week": "ts >= date_trunc('week', b.n) - interval 7 day and ts < date_trunc('week', b.n)",
    "month": "ts >= date_trunc('month', b.n) - interval 1 month and ts < date_trunc('month', b.n)",
    "year": "ts >= date_trunc('year', b.n) - interval 1 year and ts < date_trunc('year', b.n)",
    "all_time": "ts <= b.n",
}


def top_sql(rng: str, mn: int) -> str:
    return f"""select user_id, artist, count(*) listen_count from listens, (select max(ts) n from listens) b
  where {RANGE_SQL[rng]} and artist is not null group by user_id, artist having count(*) > {mn}"""


register("q12_top_listened", f"""WITH t AS ({top_sql('this_month', 1)})
select t.user_id, t.artist, a.gid artist_mbid, t.listen_count from t left join artist a on a.id = t.artist""")
register("q12_top_listened_all_ranges", " union all ".join(
    f"select user_id, artist, listen_count, '{r}' AS range from ({top_sql(r, 0)}) x{i}"
    for i, r in enumerate(RANGE_SQL)))

def outcome_sql(seeds: str, found: str) -> str:
    """One status per user with seeds (P11, P12); ten rows are asked for."""
    return f""", outcome AS (select user_id, case when user_id not in (select user_id from okusers) then 'unknown_seeds'
    when (select count(*) from {found} x where x.user_id = s.user_id) < 10 then 'short' else 'ok' end status
  from (select distinct user_id from {seeds}) s)"""


register("q9_profile_artist_recs", "WITH " + cte_q1() + ",\n" + CTE_TFIDF + ",\n" + CTE_RECOMMENDABLE + f""",
sl AS ({top_sql('this_month', 1)}),
seedsx AS (select distinct sl.user_id, a.id aid from sl join artist a on a.id = sl.artist),
bll AS ({top_sql('week', 2)}),
blx AS (select distinct bll.user_id, a.id aid from bll join artist a on a.id = bll.artist),
okusers AS (select distinct user_id from seedsx where user_id not in
  (select user_id from seedsx where aid not in (select artist_id from vec))),
nseed AS (select user_id, count(*) n from seedsx where user_id in (select user_id from okusers) group by user_id),
cen AS (select s.user_id, v.token, sum(v.w) / max(ns.n) w from seedsx s join nseed ns using (user_id)
  join vec v on v.artist_id = s.aid group by s.user_id, v.token),
cn AS (select user_id, sqrt(sum(w * w)) n from cen group by user_id),
cand AS (select distinct artist_id from vec where artist_id in (select id from recable)),
excl AS (select user_id, aid from seedsx union select user_id, aid from blx),
pairs AS (select u.user_id, c.artist_id from okusers u cross join cand c
  left join excl e on e.user_id = u.user_id and e.aid = c.artist_id where e.aid is null),
dots AS (select p.user_id, p.artist_id, sum(coalesce(v.w * cen.w, 0)) dot from pairs p join vec v on v.artist_id = p.artist_id
  left join cen on cen.user_id = p.user_id and cen.token = v.token group by p.user_id, p.artist_id),
ranked AS (select d.user_id, d.artist_id, 1 - d.dot / cn.n distance,
  row_number() over (partition by d.user_id order by round(1 - d.dot / cn.n, 9), d.artist_id) rank
  from dots d join cn using (user_id)),
top AS (select * from ranked where rank <= 10),
""" + cte_enrich_artists("top") + """
, found AS (select top.user_id, top.rank, top.artist_id, a.gid, a.name, coalesce(eg.genres, []) genres, round(top.distance, 6) distance
  from top join artist a on a.id = top.artist_id left join eg on eg.id = top.artist_id)
""" + outcome_sql("seedsx", "found") + """
select u.user_id, u.status, f.rank, f.artist_id, f.gid, f.name, f.genres, f.distance
from outcome u left join found f using (user_id)""")

register("s9_profile_artist_digests", "WITH " + cte_q1() + ",\n" + CTE_TFIDF + ",\n" + CTE_RECOMMENDABLE + f""",
sl AS ({top_sql('this_month', 1)}),
seedsx AS (select distinct sl.user_id, a.id aid from sl join artist a on a.id = sl.artist),
bll AS ({top_sql('week', 2)}),
blx AS (select distinct bll.user_id, a.id aid from bll join artist a on a.id = bll.artist),
okusers AS (select distinct user_id from seedsx where user_id not in
  (select user_id from seedsx where aid not in (select artist_id from vec))),
nseed AS (select user_id, count(*) n from seedsx where user_id in (select user_id from okusers) group by user_id),
cen AS (select s.user_id, v.token, sum(v.w) / max(ns.n) w from seedsx s join nseed ns using (user_id)
  join vec v on v.artist_id = s.aid group by s.user_id, v.token),
cn AS (select user_id, sqrt(sum(w * w)) n from cen group by user_id),
cand AS (select distinct artist_id from vec where artist_id in (select id from recable)),
excl AS (select user_id, aid from seedsx union select user_id, aid from blx),
pairs AS (select u.user_id, c.artist_id from okusers u cross join cand c
  left join excl e on e.user_id = u.user_id and e.aid = c.artist_id where e.aid is null),
dots AS (select p.user_id, p.artist_id, sum(coalesce(v.w * cen.w, 0)) dot from pairs p join vec v on v.artist_id = p.artist_id
  left join cen on cen.user_id = p.user_id and cen.token = v.token group by p.user_id, p.artist_id),
ranked AS (select d.user_id, d.artist_id, 1 - d.dot / cn.n distance,
  row_number() over (partition by d.user_id order by round(1 - d.dot / cn.n, 9), d.artist_id) rank
  from dots d join cn using (user_id)),
top AS (select * from ranked where rank <= 10),
""" + cte_enrich_artists("top") + """
, lines AS (select top.user_id, top.rank, concat_ws(chr(10), '- **' || coalesce(a.name, '') || '**',
    case when len(eg.genres) > 0 then '  Genres: ' || array_to_string(eg.genres, ', ') end,
    '  [ListenBrainz](https://listenbrainz.org/artist/' || a.gid || ')' || coalesce(' | [Official site](' || eu.official_site || ')', '')) l
  from top join artist a on a.id = top.artist_id left join eg on eg.id = top.artist_id left join eu on eu.id = top.artist_id)
select user_id, '# Recommended artists' || chr(10) || chr(10) || string_agg(l, chr(10) order by rank) digest from lines group by user_id""")

register("q11_evaluation_report", "WITH " + cte_q1() + ",\n" + CTE_TFIDF + """,
ids AS (select distinct artist_id from vec),
dots AS (select a.artist_id q, b.artist_id c, sum(a.w * b.w) dot from vec a join vec b using (token)
         where a.artist_id <> b.artist_id group by a.artist_id, b.artist_id),
pairs AS (select q.artist_id q, c.artist_id c, 1 - coalesce(d.dot, 0) distance
          from ids q join ids c on q.artist_id <> c.artist_id left join dots d on d.q = q.artist_id and d.c = c.artist_id),
recs AS (select q, c from (select q, c, row_number() over (partition by q order by round(distance, 9), c) rank from pairs) x where rank <= 5),
gs AS (select artist_id, list_distinct(tokens) g from feats),
rp AS (select recs.q, recs.c, s.g sg, r.g rg from recs join gs s on s.artist_id = recs.q join gs r on r.artist_id = recs.c),
dm AS (select count(*) data_rows, count(*) - count(distinct artist_id) duplicate_artist_ids,
  count_if(trim(coalesce(genres, '')) = '') empty_genres,
  sum(cast(artist_id is null as bigint) + cast(artist_gid is null as bigint) + cast(artist_name is null as bigint)
      + cast(artist_type is null as bigint) + cast(area_name is null as bigint) + cast(tags is null as bigint)
      + cast(genres is null as bigint) + cast(tag_count_sum is null as bigint)) nan_total,
  count_if(coalesce(tag_count_sum, 0) <= 0) tag_count_sum_zero_or_less,
  (select count(*) from voc) vocab_size from feats),
td AS (select round(avg(n), 3) genre_tokens_mean, round(quantile_cont(n, 0.5), 3) genre_tokens_median,
  round(quantile_cont(n, 0.95), 3) genre_tokens_p95, cast(max(n) as bigint) genre_tokens_max from (select len(tokens) n from feats) x),
pc AS (select round(avg(coalesce(k.n, 0)), 3) recommended_count_mean, (select count(*) from recs where q = c) seed_leak_count,
  (select count(*) - count(distinct (q, c)) from recs) recommendation_duplicate_count, count(*) prediction_seed_count, 5 prediction_top_n
  from (select distinct artist_id from feats) s left join (select q, count(*) n from recs group by q) k on k.q = s.artist_id),
jq AS (select round(avg(len(list_intersect(sg, rg)) / len(list_distinct(list_concat(sg, rg)))), 4) genre_jaccard_mean from rp),
ug AS (select count(distinct t) recommended_unique_genres from (select unnest(rg) t from rp) x)
select * from dm, td, pc, jq, ug""")

UI_SECS = "cast(case when length >= 10000 then round(length / 1000.0) else round(length) end as bigint)"
register("x_rg_display", "WITH " + CTE_LEN + f""",
d AS (select release_group, tracks, length, {UI_SECS} secs from rts)
select release_group, tracks, length,
  case when tracks is null then '' when tracks = 1 then '1 track' else cast(tracks as varchar) || ' tracks' end tracks_text,
  case when length is null then '' when (length // 60000) // 60 >= 1 then
      case when (length // 60000) % 60 > 0 then cast((length // 60000) // 60 as varchar) || 'h ' || cast((length // 60000) % 60 as varchar) || ' min'
      else cast((length // 60000) // 60 as varchar) || 'h' end
    else cast(length // 60000 as varchar) || ' min' end duration_text,
  case when length is null or length < 0 then null when secs // 3600 > 0 then cast(secs // 3600 as varchar) || 'h ' || cast((secs % 3600) // 60 as varchar) || ' min'
    when (secs % 3600) // 60 > 0 then cast((secs % 3600) // 60 as varchar) || ' min' else cast(secs % 60 as varchar) || ' sec' end ui_duration,
  case when tracks is null or length is null then null when tracks > 8 or length > 1800000 then 1
    when tracks = 1 and length < 420000 then 2 else 3 end type_class,
  nullif(concat_ws(' • ',
    case when length is null or length < 0 then null when secs // 3600 > 0 then cast(secs // 3600 as varchar) || 'h ' || cast((secs % 3600) // 60 as varchar) || ' min'
      when (secs % 3600) // 60 > 0 then cast((secs % 3600) // 60 as varchar) || ' min' else cast(secs % 60 as varchar) || ' sec' end,
    case when tracks is null then null when tracks = 1 then '1 track' else cast(tracks as varchar) || ' tracks' end), '') details
from d""")

register("x_artist_labels", f"""select id,
  case when comment is not null and comment <> '' then coalesce(name, 'Unknown artist') || ' (' || comment || ')' else coalesce(name, 'Unknown artist') end label,
  upper(left(name, 1)) || lower(substr(name, 2)) capitalized,
  {token_sql('name')} token,
  case when lower(name) like '%super deluxe%' or lower(name) like '%deluxe%' or lower(name) like '%expanded%'
    or lower(name) like '%anniversary%' or lower(name) like '%bonus%' or lower(name) like '%collector%' then 1 else 0 end edition_flag
from artist""")
register("x_album_labels", "WITH " + CTE_RGART + """,
names AS (select release_group, array_to_string(list_sort(array_agg(distinct name) filter (where name is not null)), ', ') artist
  from rgart group by release_group)
select id, case when names.artist is not null and names.artist <> '' then coalesce(name, 'Unknown album') || ' - ' || names.artist
    else coalesce(name, 'Unknown album') end label,
  least(greatest(cast(trunc(id / 1000.0) as int), 1), 50) clamped
from release_group left join names on names.release_group = release_group.id""")

# ----------------------------------------------------------------- Q2, K12, K14
register("q2_artist_features_with_tags", "WITH " + ",\n".join([CTE_TG, CTE_CRG, CTE_CREL, cte_prim(1), cte_train(1)]) + f""",
rowsx AS (select a.id artist_id, a.gid artist_gid, a.name artist_name, aty.name artist_type, ar.name area_name,
  t.name tag, atg.count tag_count, g.name genre
  from artist a left join artist_type aty on aty.id = a.type left join area ar on ar.id = a.area
  left join artist_tag atg on atg.artist = a.id and atg.count >= 1 left join tag t on t.id = atg.tag
  left join genre g on lower(g.name) = lower(t.name) where {ELIGIBLE_A}),
sums AS (select artist_id, artist_gid, artist_name, artist_type, area_name,
  cast(sum(greatest(coalesce(tag_count, 0), 0)) as bigint) tag_count_sum from rowsx
  group by artist_id, artist_gid, artist_name, artist_type, area_name),
tagk AS (select artist_id, min(trim(tag)) s from rowsx where tag is not null and trim(tag) <> '' group by artist_id, lower(trim(tag))),
tagstr AS (select artist_id, array_to_string(list_sort(list(s)), ' ') tags from tagk group by artist_id),
""" + cte_tokens("rowsx", "tgen", key="artist_id") + ",\n" + cte_tokens("train", "ext") + """
select s.artist_id, s.artist_gid, s.artist_name, s.artist_type, s.area_name, coalesce(tagstr.tags, '') tags,
  array_to_string(list_concat(coalesce(tgen.tokens, []), coalesce(ext.tokens, [])), ' ') genres, s.tag_count_sum
from sums s left join tagstr using (artist_id) left join tgen on tgen.id = s.artist_id left join ext on ext.id = s.artist_id
where len(list_concat(coalesce(tgen.tokens, []), coalesce(ext.tokens, []))) > 0""")

register("q2_scoped_every_artist", "WITH " + ",\n".join([CTE_TG, CTE_CRG, CTE_CREL, CTE_CREC_ALL]) + f""",
extg AS (select distinct id, genre from (
  select crg.id, tg.genre from crg join release_group_tag t on t.release_group = crg.release_group_id and t.count >= 1 join tg on tg.tag = t.tag
  union all select crel.id, tg.genre from crel join release_tag t on t.release = crel.release_id and t.count >= 1 join tg on tg.tag = t.tag
  union all select crec.id, tg.genre from crec join recording_tag t on t.recording = crec.recording_id and t.count >= 1 join tg on tg.tag = t.tag) x),
rowsx AS (select a.id artist_id, a.gid artist_gid, a.name artist_name, aty.name artist_type, ar.name area_name,
  t.name tag, atg.count tag_count, g.name genre
  from artist a left join artist_type aty on aty.id = a.type left join area ar on ar.id = a.area
  left join artist_tag atg on atg.artist = a.id and atg.count >= 1 left join tag t on t.id = atg.tag
  left join genre g on lower(g.name) = lower(t.name) where {ELIGIBLE_A}),
sums AS (select artist_id, artist_gid, artist_name, artist_type, area_name,
  cast(sum(greatest(coalesce(tag_count, 0), 0)) as bigint) tag_count_sum from rowsx
  group by artist_id, artist_gid, artist_name, artist_type, area_name),
tagk AS (select artist_id, min(trim(tag)) s from rowsx where tag is not null and trim(tag) <> '' group by artist_id, lower(trim(tag))),
tagstr AS (select artist_id, array_to_string(list_sort(list(s)), ' ') tags from tagk group by artist_id),
""" + cte_tokens("rowsx", "tgen", key="artist_id") + ",\n" + cte_tokens("extg", "ext") + """
select s.artist_id, s.artist_gid, s.artist_name, s.artist_type, s.area_name, coalesce(tagstr.tags, '') tags,
  array_to_string(list_concat(coalesce(tgen.tokens, []), coalesce(ext.tokens, [])), ' ') genres, s.tag_count_sum
from sums s left join tagstr using (artist_id) left join tgen on tgen.id = s.artist_id left join ext on ext.id = s.artist_id
where len(list_concat(coalesce(tgen.tokens, []), coalesce(ext.tokens, []))) > 0""")
ORACLE["q2_first_artists"] = ORACLE["q2_scoped_every_artist"]

register("k12_label_vocabulary", "WITH " + CTE_Q3 + """,
lab AS (select distinct 'tag_ids' AS "column", unnest(tag_ids) label from q3
  union select distinct 'genre_ids', unnest(genre_ids) from q3
  union select distinct 'secondary_type_ids', unnest(secondary_type_ids) from q3)
select "column", label, row_number() over (partition by "column" order by label) - 1 AS "index" from lab""")

register("k14_weighted_tokens", "WITH " + ",\n".join([CTE_TG, CTE_CRG, CTE_CREL, CTE_CREC_ALL]) + f""",
parts AS (
  select distinct atg.artist id, tg.genre, 4 w from artist_tag atg join tg on tg.tag = atg.tag where atg.count >= 1
  union all select distinct crg.id, tg.genre, 3 from crg join release_group_tag t on t.release_group = crg.release_group_id and t.count >= 1 join tg on tg.tag = t.tag
  union all select distinct crel.id, tg.genre, 2 from crel join release_tag t on t.release = crel.release_id and t.count >= 1 join tg on tg.tag = t.tag
  union all select distinct crec.id, tg.genre, 1 from crec join recording_tag t on t.recording = crec.recording_id and t.count >= 1 join tg on tg.tag = t.tag),
tf AS (select p.id, {token_sql('p.genre')} token, cast(sum(p.w) as double) tf from parts p
  where p.id in (select a.id from artist a where {ELIGIBLE_A}) and {token_sql('p.genre')} <> '' group by all)
select id, token, tf from tf""")


# ----------------------------------------------------------------- K9, K8 (language identification)
from cadenza.operators.langid import LANGUAGE_IDS as _LID, SCRIPT_IDS as _SID  # noqa: E402

_MARGIN = 0.02      # nats per n-gram between the two best languages


def cte_clean(src: str, key: str, text: str, name: str) -> str:
    return rf"""{name}_c AS (select {key} k, ' ' || lower(regexp_replace(trim({text}), '\s+', ' ', 'g')) || ' ' t
  from {src} where {text} is not null and trim({text}) <> ''),
{name}_ch AS (select k, string_split(t, '') ch from {name}_c),
{name}_g AS (select k, gram, count(*) c from (select k, ch[i] || ch[i + 1] || ch[i + 2] gram
  from (select k, ch, unnest(generate_series(1, greatest(len(ch) - 2, 1))) i from {name}_ch) y) x
  where length(gram) = 3 group by k, gram)"""


CTE_LANGMODEL = cte_clean("documents", "lang", "text", "tr") + """,
tr_v AS (select count(distinct gram) v from tr_g),
tr_t AS (select k lang, sum(c) tot from tr_g group by k),
lm AS (select g.k lang, g.gram, ln((g.c + 1.0) / (t.tot + v.v)) logp, ln(1.0 / (t.tot + v.v)) unseen
  from tr_g g join tr_t t on t.lang = g.k, tr_v v),
lm_u AS (select distinct lang, unseen from lm)"""


def cte_detect(src: str, key: str, text: str, out: str, ids: str | None = None) -> str:
    return cte_clean(src, key, text, "dt") + f""",
dt_n AS (select k, sum(c) ng from dt_g group by k),
dt_s AS (select g.k, lm.lang, sum(g.c * (lm.logp - u.unseen)) gain from dt_g g join lm on lm.gram = g.gram
  join lm_u u on u.lang = lm.lang group by g.k, lm.lang),
dt_p AS (select n.k, n.ng, u.lang, coalesce(s.gain, 0) + n.ng * u.unseen score from dt_n n cross join lm_u u
  left join dt_s s on s.k = n.k and s.lang = u.lang),
dt_r AS (select k, ng, lang, score, row_number() over (partition by k order by score desc, lang desc) r from dt_p),
dt_b AS (select b.k, case when s.score is null or (b.score - s.score) / b.ng >= {_MARGIN} then b.lang end lang
  from dt_r b left join dt_r s on s.k = b.k and s.r = 2 where b.r = 1),
{out} AS (select x.{key if ids is None else 'id'} id, dt_b.lang from {ids or src} x
  left join dt_b on dt_b.k = x.{key if ids is None else 'id'})"""


register("k9_detect_documents", "WITH " + CTE_LANGMODEL + ",\n" + cte_detect("documents", "doc_id", "text", "det") +
         " select id doc_id, lang from det")


register("k9_langid_accuracy", "WITH " + cte_clean("documents", "doc_id", "text", "dt") + f""",
folds AS (select unnest(range(5)) f),
per AS (select d.lang, d.doc_id % 5 f, g.gram, sum(g.c) c from dt_g g join documents d on d.doc_id = g.k group by all),
tot AS (select lang, gram, sum(c) c from per group by all),
m AS (select t.lang, folds.f, t.gram, t.c - coalesce(per.c, 0) c from tot t cross join folds
  left join per on per.lang = t.lang and per.f = folds.f and per.gram = t.gram where t.c - coalesce(per.c, 0) > 0),
mv AS (select f, count(distinct gram) v from m group by f),
mt AS (select lang, f, sum(c) t from m group by all),
mu AS (select mt.lang, mt.f, ln(1.0 / (mt.t + mv.v)) unseen from mt join mv using (f)),
n AS (select k, sum(c) ng from dt_g group by k),
s AS (select g.k, m.lang, sum(g.c * ln(m.c + 1.0)) gain from dt_g g join m on m.gram = g.gram and m.f = g.k % 5 group by all),
p AS (select n.k, n.ng, mu.lang, coalesce(s.gain, 0) + n.ng * mu.unseen score from n join mu on mu.f = n.k % 5
  left join s on s.k = n.k and s.lang = mu.lang),
r AS (select k, ng, lang, score, row_number() over (partition by k order by score desc, lang desc) r from p),
b AS (select a.k, case when c.score is null or (a.score - c.score) / a.ng >= {_MARGIN} then a.lang end pred
  from r a left join r c on c.k = a.k and c.r = 2 where a.r = 1)
select d.lang, count(*) n, count_if(b.pred = d.lang) correct from documents d left join b on b.k = d.doc_id group by d.lang""")


def cte_language(src: str, out: str) -> str:
    """K8 in SQL over a feature CTE ``src`` (needs CTE_LANGMODEL)."""
    return ("""todo AS (select id from q3 where language is null or script is null),
pieces AS (select rg.id, coalesce(rg.name, cast(rg.id as varchar)) text from release_group rg where rg.id in (select id from todo)
  union all select r.release_group, t.name from release r join medium m on m.release = r.id
  join track t on t.medium = m.id where r.release_group in (select id from todo)),
rgt AS (select id, trim(text) text from pieces where text is not null and trim(text) <> ''),
fl AS (select id, bool_or(regexp_matches(text, '[A-Za-z]')) has_ascii,
  bool_or(regexp_matches(text, '[^\\x00-\\x7F]')) has_non_ascii from rgt group by id),
""" + cte_detect("rgt", "id", "text", "det", ids="todo") + """,
norm AS (select det.id, case when l in ('bg', 'el', 'hi', 'ja', 'ru', 'zh') and fl.has_ascii
    and not fl.has_non_ascii then l || '-Latn' else l end code
  from det left join fl on fl.id = det.id, lateral (select case det.lang when 'iw' then 'he' when 'tl' then 'fil' else det.lang end l) z),
pred AS (select id, case code when 'af' then 9 when 'am' then 15 when 'ar' then 18 when 'bg' then 62 when 'bg-Latn' then 62 when 'bn' then 47 when 'bs' then 56 when 'ca' then 68 when 'ceb' then 68 when 'co' then 89 when 'cs' then 98 when 'cy' then 455 when 'da' then 100 when 'de' then 145 when 'el' then 159 when 'el-Latn' then 159 when 'en' then 120 when 'eo' then 122 when 'es' then 393 when 'et' then 123 when 'eu' then 41 when 'fa' then 334 when 'fi' then 131 when 'fil' then 189 when 'fr' then 134 when 'fy' then 137 when 'ga' then 149 when 'gd' then 148 when 'gl' then 150 when 'gu' then 161 when 'ha' then 165 when 'haw' then 165 when 'he' then 167 when 'hi' then 171 when 'hi-Latn' then 171 when 'hmn' then 179 when 'hr' then 366 when 'ht' then 164 when 'hu' then 176 when 'hy' then 21 when 'id' then 189 when 'ig' then 179 when 'is' then 180 when 'it' then 195 when 'iw' then 167 when 'ja' then 198 when 'ja-Latn' then 198 when 'jv' then 196 when 'ka' then 144 when 'kk' then 211 when 'km' then 215 when 'kn' then 206 when 'ko' then 224 when 'ku' then 232 when 'ky' then 219 when 'la' then 238 when 'lb' then 246 when 'lo' then 237 when 'lt' then 243 when 'lv' then 239 when 'mg' then 275 when 'mi' then 262 when 'mk' then 254 when 'ml' then 260 when 'mn' then 282 when 'mr' then 264 when 'ms' then 266 when 'mt' then 276 when 'my' then 63 when 'ne' then 300 when 'nl' then 113 when 'no' then 309 when 'ny' then 313 when 'pa' then 330 when 'pl' then 338 when 'ps' then 343 when 'pt' then 340 when 'ro' then 351 when 'ru' then 353 when 'ru-Latn' then 353 when 'sd' then 387 when 'si' then 373 when 'sk' then 377 when 'sl' then 378 when 'sm' then 384 when 'sn' then 386 when 'so' then 390 when 'sq' then 12 when 'sr' then 363 when 'st' then 392 when 'su' then 399 when 'sv' then 403 when 'sw' then 402 when 'ta' then 407 when 'te' then 409 when 'tg' then 413 when 'th' then 415 when 'tr' then 433 when 'uk' then 441 when 'ur' then 444 when 'uz' then 445 when 'vi' then 448 when 'xh' then 460 when 'yi' then 463 when 'yo' then 464 when 'zh' then 76 when 'zh-Latn' then 76 when 'zu' then 470 end pl, case code when 'af' then 28 when 'am' then 86 when 'ar' then 18 when 'bg' then 31 when 'bg-Latn' then 28 when 'bn' then 53 when 'bs' then 28 when 'ca' then 28 when 'ceb' then 28 when 'co' then 28 when 'cs' then 28 when 'cy' then 28 when 'da' then 28 when 'de' then 28 when 'el' then 22 when 'el-Latn' then 28 when 'en' then 28 when 'eo' then 28 when 'es' then 28 when 'et' then 28 when 'eu' then 28 when 'fa' then 18 when 'fi' then 28 when 'fil' then 28 when 'fr' then 28 when 'fy' then 28 when 'ga' then 28 when 'gd' then 28 when 'gl' then 28 when 'gu' then 52 when 'ha' then 28 when 'haw' then 28 when 'he' then 11 when 'hi' then 50 when 'hi-Latn' then 28 when 'hmn' then 28 when 'hr' then 28 when 'ht' then 28 when 'hu' then 28 when 'hy' then 35 when 'id' then 28 when 'ig' then 28 when 'is' then 28 when 'it' then 28 when 'iw' then 11 when 'ja' then 85 when 'ja-Latn' then 28 when 'jv' then 28 when 'ka' then 36 when 'kk' then 31 when 'km' then 68 when 'kn' then 60 when 'ko' then 43 when 'ku' then 28 when 'ky' then 31 when 'la' then 28 when 'lb' then 28 when 'lo' then 69 when 'lt' then 28 when 'lv' then 28 when 'mg' then 28 when 'mi' then 28 when 'mk' then 31 when 'ml' then 62 when 'mn' then 31 when 'mr' then 50 when 'ms' then 28 when 'mt' then 28 when 'my' then 64 when 'ne' then 50 when 'nl' then 28 when 'no' then 28 when 'ny' then 28 when 'pa' then 49 when 'pl' then 28 when 'ps' then 18 when 'pt' then 28 when 'ro' then 28 when 'ru' then 31 when 'ru-Latn' then 28 when 'sd' then 18 when 'si' then 63 when 'sk' then 28 when 'sl' then 28 when 'sm' then 28 when 'sn' then 28 when 'so' then 28 when 'sq' then 28 when 'sr' then 31 when 'st' then 28 when 'su' then 107 when 'sv' then 28 when 'sw' then 28 when 'ta' then 61 when 'te' then 59 when 'tg' then 31 when 'th' then 65 when 'tr' then 28 when 'uk' then 31 when 'ur' then 18 when 'uz' then 28 when 'vi' then 28 when 'xh' then 28 when 'yi' then 11 when 'yo' then 28 when 'zh' then 92 when 'zh-Latn' then 28 when 'zu' then 28 end ps from norm),
{out} AS (select q3.* replace (
  cast(case when q3.language is null or q3.script is null then pred.pl when q3.language in (9, 12, 15, 18, 21, 41, 47, 56, 62, 63, 68, 76, 89, 98, 100, 113, 120, 122, 123, 131, 134, 137, 144, 145, 148, 149, 150, 159, 161, 164, 165, 167, 171, 176, 179, 180, 189, 195, 196, 198, 206, 211, 215, 219, 224, 232, 237, 238, 239, 243, 246, 254, 260, 262, 264, 266, 275, 276, 282, 300, 309, 313, 330, 334, 338, 340, 343, 351, 353, 363, 366, 373, 377, 378, 384, 386, 387, 390, 392, 393, 399, 402, 403, 407, 409, 413, 415, 433, 441, 444, 445, 448, 455, 460, 463, 464, 470) then q3.language end as int) AS language,
  cast(case when q3.language is null or q3.script is null then pred.ps when q3.script in (11, 18, 22, 28, 31, 35, 36, 43, 49, 50, 52, 53, 59, 60, 61, 62, 63, 64, 65, 68, 69, 85, 86, 92, 107) then q3.script end as int) AS script)
from q3 left join pred on pred.id = q3.id)""").replace("q3", src).replace("{out}", out)


register("k8_infer_language", "WITH " + CTE_Q3 + ",\n" + CTE_LANGMODEL + ",\n" + cte_language("q3", "q3l") +
         " select id, language, script from q3l")

FULL_MODEL = ("WITH " + CTE_Q3 + ",\n" + CTE_BACKFILL + ",\n" + CTE_LANGMODEL + ",\n" +
              cte_language("q3b", "q3l") + ",\n" + cte_types("q3l", "q5"))   # holds CTE_FIRST

register("q5_album_model_data", FULL_MODEL + " select * from q5")


def album_knn_sql(genres: str | None) -> str:
    return FULL_MODEL + ",\n" + cte_album_knn("0, 6, 11", "0, 6, 11, 1", genres)


register("k6_album_neighbours_all", FULL_MODEL + ",\n" + CTE_STATS.format(d="q5") + """,
imp AS (select q5.id, cast(coalesce(cast(cast(q5.type as float) as double), stats.type) as double) s0,
  coalesce(cast(cast(q5.status as float) as double), stats.status) s1, coalesce(cast(cast(q5.language as float) as double), stats.language) s2,
  coalesce(cast(cast(q5.script as float) as double), stats.script) s3, coalesce(cast(cast(q5.year as float) as double), stats.year) s4,
  list_distinct(q5.tag_ids) tg, list_distinct(q5.genre_ids) gn, list_distinct(q5.secondary_type_ids) st from q5, stats),
v AS (select *, sqrt(s0 * s0 + s1 * s1 + s2 * s2 + s3 * s3 + s4 * s4 + len(tg) + len(gn) + len(st)) n from imp),
lab AS (select id, 't' || unnest(tg) l from imp union all select id, 'g' || unnest(gn) from imp
  union all select id, 's' || unnest(st) from imp),
shared AS (select a.id q, b.id c, count(*) n from lab a join lab b using (l) group by a.id, b.id),
dist AS (select q.id q, c.id c, case when q.n > 0 and c.n > 0 then
    1 - (q.s0 * c.s0 + q.s1 * c.s1 + q.s2 * c.s2 + q.s3 * c.s3 + q.s4 * c.s4 + coalesce(x.n, 0)) / (q.n * c.n) else 1 end distance
  from v q cross join v c left join shared x on x.q = q.id and x.c = c.id),
ranked AS (select q, c, distance, row_number() over (partition by q order by round(distance, 12), c) rank from dist qualify rank <= 5)
select q query_id, rank, c id, round(distance, 12) + 0.0 distance from ranked where q <> c""")


TOP_ALBUMS = " select rank, id, round(distance, 12) distance from ranked where rank <= 10"
register("k5_album_knn", album_knn_sql(None) + TOP_ALBUMS)
register("k5_album_knn_genre_filter", album_knn_sql(", ".join(str(i) for i in range(1, 21))) + TOP_ALBUMS)
register("k5_album_knn_one_genre", album_knn_sql("5") + TOP_ALBUMS)
register("q8_album_recommendations", album_knn_sql(None) + """,
top AS (select * from ranked where rank <= 10),
""" + CTE_LEN_AFTER_FIRST + ",\n" + CTE_RGART + """,
names AS (select release_group, array_to_string(list_sort(array_agg(distinct name) filter (where name is not null)), ', ') artist from rgart group by release_group),
gen AS (select x.release_group, list_sort(array_agg(distinct g.name)) genres from (select distinct release_group, artist from rgart) x
  join artist_tag atg on atg.artist = x.artist join tag t on t.id = atg.tag join genre g on g.name = t.name group by x.release_group)
select top.rank, top.id, rg.gid, rg.name title, names.artist, coalesce(gen.genres, cast([] as varchar[])) genres,
  rts.tracks, rts.length, round(top.distance, 12) distance
from top join fr on fr.release_group = top.id join release_group rg on rg.id = top.id
left join rts on rts.release_group = top.id left join gen on gen.release_group = top.id
join names on names.release_group = top.id""")
register("s10_album_digest", album_knn_sql(None) + """,
top AS (select * from ranked where rank <= 10),
""" + CTE_LEN_AFTER_FIRST + ",\n" + CTE_RGART + """,
names AS (select release_group, array_to_string(list_sort(array_agg(distinct name) filter (where name is not null)), ', ') artist from rgart group by release_group),
gen AS (select x.release_group, list_sort(array_agg(distinct g.name)) genres from (select distinct release_group, artist from rgart) x
  join artist_tag atg on atg.artist = x.artist join tag t on t.id = atg.tag join genre g on g.name = t.name group by x.release_group),
rows8 AS (select top.rank, rg.gid, rg.name title, names.artist, coalesce(gen.genres, cast([] as varchar[])) genres, rts.tracks, rts.length
  from top join fr on fr.release_group = top.id join release_group rg on rg.id = top.id
  left join rts on rts.release_group = top.id left join gen on gen.release_group = top.id
  join names on names.release_group = top.id),
pick AS (select rank, array_to_string(list(g order by md5('42:' || g))[1:5], ', ') p from (select rank, unnest(genres) g from rows8) x group by rank),
txt AS (select r.*, case when tracks is null then null when tracks = 1 then '1 track' else cast(tracks as varchar) || ' tracks' end tt,
  case when length is null then null when (length // 60000) // 60 >= 1 then
      case when (length // 60000) % 60 > 0 then cast((length // 60000) // 60 as varchar) || 'h ' || cast((length // 60000) % 60 as varchar) || ' min'
      else cast((length // 60000) // 60 as varchar) || 'h' end
    else cast(length // 60000 as varchar) || ' min' end dd from rows8 r),
blocks AS (select txt.rank, concat_ws(chr(10), '**' || title || '** - ' || coalesce(artist, ''), pick.p,
  nullif(concat_ws(' - ', tt, dd), ''), '[ListenBrainz](https://listenbrainz.org/release-group/' || gid || ')') b
  from txt left join pick using (rank))
select 0 request_id, '# Recommended release groups' || chr(10) || chr(10) || string_agg(b, chr(10) || chr(10) order by rank) digest from blocks""")


register("p10_slim_artist_data", "WITH " + cte_q1() + " select artist_id, artist_name, genres from feats")
register("p9_release_gids_to_release_groups", "select r.gid, r.release_group id from release r join (select gid from release) g on g.gid = r.gid")


def mode_by(col: str, src: str, key: str, name: str) -> str:
    return f"""{name} AS (select {key}, {col} from (select {key}, {col}, row_number() over (partition by {key} order by count(*) desc, {col}) rn
        from {src} where {col} is not null group by {key}, {col}) x where rn = 1)"""


register("q10_profile_album_recs", FULL_MODEL + ",\n" + CTE_CRG + ",\n" + CTE_STATS.format(d="q5") + f""",
imp AS (select q5.id, cast(coalesce(cast(cast(q5.type as float) as double), stats.type) as double) s0,
  coalesce(cast(cast(q5.status as float) as double), stats.status) s1, coalesce(cast(cast(q5.language as float) as double), stats.language) s2,
  coalesce(cast(cast(q5.script as float) as double), stats.script) s3, coalesce(cast(cast(q5.year as float) as double), stats.year) s4,
  q5.tag_ids, q5.genre_ids, q5.secondary_type_ids from q5, stats),
ltop AS ({top_sql('this_month', 1)}),
seeds AS (select distinct ltop.user_id, crg.release_group_id rg from ltop join crg on crg.id = ltop.artist),
btop AS ({top_sql('week', 2)}),
bls AS (select distinct btop.user_id, crg.release_group_id rg from btop join crg on crg.id = btop.artist),
okusers AS (select distinct user_id from seeds where user_id not in
  (select user_id from seeds where rg not in (select id from q5))),
sd AS (select s.user_id, q5.* from seeds s join q5 on q5.id = s.rg where s.user_id in (select user_id from okusers)),
""" + ",\n".join(mode_by(c, "sd", "user_id", f"pm_{c}") for c in ["type", "status", "language", "script"]) + """,
pl AS (select user_id, cast(round_even(avg(year), 0) as int) AS year,
  list_sort(list_distinct(flatten(list(tag_ids)))) tag_ids, list_sort(list_distinct(flatten(list(genre_ids)))) genre_ids,
  list_sort(list_distinct(flatten(list(secondary_type_ids)))) secondary_type_ids from sd group by user_id),
p AS (select pl.user_id,
  coalesce(cast(cast(a.type as float) as double), stats.type) s0, coalesce(cast(cast(b.status as float) as double), stats.status) s1,
  coalesce(cast(cast(c.language as float) as double), stats.language) s2, coalesce(cast(cast(d.script as float) as double), stats.script) s3,
  coalesce(cast(cast(pl.year as float) as double), stats.year) s4, pl.tag_ids, pl.genre_ids, pl.secondary_type_ids
  from pl left join pm_type a using (user_id) left join pm_status b using (user_id)
  left join pm_language c using (user_id) left join pm_script d using (user_id), stats),
excl AS (select user_id, rg from seeds union select user_id, rg from bls),
sc AS (select p.user_id, c.id,
  c.s0 * p.s0 + c.s1 * p.s1 + c.s2 * p.s2 + c.s3 * p.s3 + c.s4 * p.s4 + len(list_intersect(c.tag_ids, p.tag_ids))
    + len(list_intersect(c.genre_ids, p.genre_ids)) + len(list_intersect(c.secondary_type_ids, p.secondary_type_ids)) dot,
  c.s0 * c.s0 + c.s1 * c.s1 + c.s2 * c.s2 + c.s3 * c.s3 + c.s4 * c.s4 + len(c.tag_ids) + len(c.genre_ids) + len(c.secondary_type_ids) nc,
  p.s0 * p.s0 + p.s1 * p.s1 + p.s2 * p.s2 + p.s3 * p.s3 + p.s4 * p.s4 + len(p.tag_ids) + len(p.genre_ids) + len(p.secondary_type_ids) np
  from p cross join imp c left join excl e on e.user_id = p.user_id and e.rg = c.id where e.rg is null),
dist AS (select user_id, id, case when nc > 0 and np > 0 then 1 - dot / (sqrt(np) * sqrt(nc)) else 1 end distance from sc),
ranked AS (select user_id, id, distance, row_number() over (partition by user_id order by round(distance, 12), id) rank from dist),
top AS (select * from ranked where rank <= 10),
""" + CTE_RGART + """,
names AS (select release_group, array_to_string(list_sort(array_agg(distinct name) filter (where name is not null)), ', ') artist
  from rgart group by release_group)
, found AS (select top.user_id, top.rank, top.id, rg.gid, rg.name title, names.artist, round(top.distance, 12) distance
  from top join fr on fr.release_group = top.id join release_group rg on rg.id = top.id
  join names on names.release_group = top.id)
""" + outcome_sql("seeds", "found") + """
select u.user_id, u.status, f.rank, f.id, f.gid, f.title, f.artist, f.distance
from outcome u left join found f using (user_id)""")

register("q10_release_album_recs", FULL_MODEL + ",\n" + CTE_CRG + ",\n" + CTE_STATS.format(d="q5") + f""",
imp AS (select q5.id, cast(coalesce(cast(cast(q5.type as float) as double), stats.type) as double) s0,
  coalesce(cast(cast(q5.status as float) as double), stats.status) s1, coalesce(cast(cast(q5.language as float) as double), stats.language) s2,
  coalesce(cast(cast(q5.script as float) as double), stats.script) s3, coalesce(cast(cast(q5.year as float) as double), stats.year) s4,
  q5.tag_ids, q5.genre_ids, q5.secondary_type_ids from q5, stats),
seeds AS (select distinct l.user_id, r.release_group rg from release_listens l join release r on r.gid = l.release_gid),
bls AS (select distinct l.user_id, r.release_group rg from release_listens l join release r on r.gid = l.release_gid, (select max(ts) n from release_listens) b
  where l.ts >= date_trunc('week', b.n) and l.ts <= b.n),
okusers AS (select distinct user_id from seeds where user_id not in
  (select user_id from seeds where rg not in (select id from q5))),
sd AS (select s.user_id, q5.* from seeds s join q5 on q5.id = s.rg where s.user_id in (select user_id from okusers)),
""" + ",\n".join(mode_by(c, "sd", "user_id", f"pm_{c}") for c in ["type", "status", "language", "script"]) + """,
pl AS (select user_id, cast(round_even(avg(year), 0) as int) AS year,
  list_sort(list_distinct(flatten(list(tag_ids)))) tag_ids, list_sort(list_distinct(flatten(list(genre_ids)))) genre_ids,
  list_sort(list_distinct(flatten(list(secondary_type_ids)))) secondary_type_ids from sd group by user_id),
p AS (select pl.user_id,
  coalesce(cast(cast(a.type as float) as double), stats.type) s0, coalesce(cast(cast(b.status as float) as double), stats.status) s1,
  coalesce(cast(cast(c.language as float) as double), stats.language) s2, coalesce(cast(cast(d.script as float) as double), stats.script) s3,
  coalesce(cast(cast(pl.year as float) as double), stats.year) s4, pl.tag_ids, pl.genre_ids, pl.secondary_type_ids
  from pl left join pm_type a using (user_id) left join pm_status b using (user_id)
  left join pm_language c using (user_id) left join pm_script d using (user_id), stats),
excl AS (select user_id, rg from seeds union select user_id, rg from bls),
sc AS (select p.user_id, c.id,
  c.s0 * p.s0 + c.s1 * p.s1 + c.s2 * p.s2 + c.s3 * p.s3 + c.s4 * p.s4 + len(list_intersect(c.tag_ids, p.tag_ids))
    + len(list_intersect(c.genre_ids, p.genre_ids)) + len(list_intersect(c.secondary_type_ids, p.secondary_type_ids)) dot,
  c.s0 * c.s0 + c.s1 * c.s1 + c.s2 * c.s2 + c.s3 * c.s3 + c.s4 * c.s4 + len(c.tag_ids) + len(c.genre_ids) + len(c.secondary_type_ids) nc,
  p.s0 * p.s0 + p.s1 * p.s1 + p.s2 * p.s2 + p.s3 * p.s3 + p.s4 * p.s4 + len(p.tag_ids) + len(p.genre_ids) + len(p.secondary_type_ids) np
  from p cross join imp c left join excl e on e.user_id = p.user_id and e.rg = c.id where e.rg is null),
dist AS (select user_id, id, case when nc > 0 and np > 0 then 1 - dot / (sqrt(np) * sqrt(nc)) else 1 end distance from sc),
ranked AS (select user_id, id, distance, row_number() over (partition by user_id order by round(distance, 12), id) rank from dist),
top AS (select * from ranked where rank <= 10)
""" + outcome_sql("seeds", "top") + """
select u.user_id, u.status, t.rank, t.id, round(t.distance, 12) distance from outcome u left join top t using (user_id)""")

register("s8_listen_stats_seeds", f"""with t as ({top_sql('this_month', 1)})
select t.user_id, list_sort(list(distinct a.id)) seeds, 10 top_n from t join artist a on a.id = t.artist group by t.user_id""")
register("s4_cached_features", "WITH " + cte_q1() + """
select artist_id, artist_gid, artist_name, artist_type, area_name, tags, genres, tag_count_sum from feats""")
register("s6_loaded_artist_model", "WITH " + cte_q1() + ",\n" + CTE_TFIDF + ",\n" +
         cte_single(SEEDS_SQL, SEEDS_SQL + ", " + BL_SQL) + """
select rank, artist_id, round(distance, 6) distance, 'ok' status from ranked where rank <= 5""")
register("s6_loaded_album_model", album_knn_sql(None) + TOP_ALBUMS)
register("s7_metrics_table", "WITH " + cte_q1() + ",\n" + CTE_TFIDF + """
select run_id, (select count(*) from feats) data_rows, (select count(*) from voc) vocab_size
from (values ('a'), ('b')) r(run_id)""")
register("x_artist_text", """select id, trim(regexp_replace('  ' || name || ' ' || chr(9) || ' x ', '\\s+', ' ', 'g')) spaced,
  case when name is not null then regexp_extract_all(name, '[\\p{L}\\p{N}_]+') end words, 'https://listenbrainz.org/artist/' || gid link from artist""")
register("w5_seeded_shuffle", "select id, name, md5('42:' || cast(id as varchar)) AS \"key\" from genre")
register("j10_ordered_ids", "WITH " + CTE_RECOMMENDABLE + """,
n AS (select artist id, count(*) n from listens where artist is not null group by artist),
rk AS (select id, row_number() over (order by n desc, id) rank from n)
select rank, id from rk where id in (select id from recable)""")

register("x_user_settings", """WITH g AS (select x.user_id, list_sort(list(distinct t.name)) genres
  from (select distinct user_id, artist from listens) x join artist_tag a on a.artist = x.artist join tag t on t.id = a.tag group by x.user_id),
per AS (select user_id, count(*) n, count(distinct artist) artists from listens group by user_id)
select per.user_id, cast(least(greatest(artists, 1), 50) as int) max_results,
  least(n, least(greatest(artists, 1), 50)) min_listen, array_to_string(genres[1:10], ', ') genres,
  array_to_string(genres, ', ') all_genres from per left join g on g.user_id is not distinct from per.user_id""")
