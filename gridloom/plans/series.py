"""Registered queries of the one-dimensional operators, over event times and hourly profiles, with their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import positions as ps
from .fixtures import table

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def positions(spark: SparkSession, d: str) -> DataFrame:
    """series_id, pos: minutes since the first of 2024 at which each user had events."""
    minute = F.floor((F.unix_timestamp("ts") - F.unix_timestamp(F.lit("2024-01-01 00:00:00").cast("timestamp"))) / 60)
    return table(spark, d, "events").select(F.col("user_id").cast("long").alias("series_id"), minute.cast("long").alias("pos")).distinct()


def profile(spark: SparkSession, d: str) -> DataFrame:
    """series_id, pos, strength: events of each type (numbered by its first letter) in each hour; absent hours are 0."""
    hour = F.floor((F.unix_timestamp("ts") - F.unix_timestamp(F.lit("2024-01-01 00:00:00").cast("timestamp"))) / 3600).cast("long")
    return table(spark, d, "events").groupBy(F.ascii("event_type").cast("long").alias("series_id"), hour.alias("pos")).agg(F.count("*").alias("strength"))


POSITIONS = "positions as (select distinct user_id::bigint as series_id, floor((epoch(ts) - epoch(timestamp '2024-01-01')) / 60)::bigint as pos from events)"
PROFILE = "profile as (select ascii(event_type)::bigint as series_id, floor((epoch(ts) - epoch(timestamp '2024-01-01')) / 3600)::bigint as pos, count(*) as strength from events group by 1, 2)"


def islands(gap: int, source: str = "positions") -> str:
    return f"""isl as (select *, sum(new) over (partition by series_id order by pos) as island from (
      select *, case when pos - lag(pos) over (partition by series_id order by pos) > {gap} then 1 else 0 end as new from {source}))"""


@query(f"with {POSITIONS}, {islands(600)} select series_id, round_even(avg(pos), 0)::bigint as pos from isl group by series_id, island")
def c1_cluster_positions(spark, d):
    return ps.cluster_positions(positions(spark, d), 600)


@query(f"""with {PROFILE}, high as (select * from (select *, max(strength) over (partition by series_id) as top from profile) where strength >= greatest(0.7, top * 0.45)), {islands(1, 'high')}
select series_id, round_even(avg(pos), 0)::bigint as pos from isl group by series_id, island""")
def c2_profile_peaks(spark, d):
    return ps.profile_peaks(profile(spark, d), 2)


@query(f"with {POSITIONS}, {islands(900)} select series_id, min(pos)::bigint as first, max(pos)::bigint as last from isl group by series_id, island")
def c3_bands(spark, d):
    return ps.bands(positions(spark, d), 900)


@query(f"""with {POSITIONS}, {islands(1500)}, runs as (select series_id, min(pos)::bigint as first, max(pos)::bigint as last, count(*) as n from isl group by series_id, island)
select series_id, first, last from runs qualify row_number() over (partition by series_id order by last - first desc, n desc, first) = 1 and sum(n) over (partition by series_id) >= 2""")
def c4_dominant_span(spark, d):
    return ps.dominant_span(positions(spark, d), 1500)


LINES = """
samples as (
  select series_id, line, pos, case pos % 17 when 0 then 60 + k % 11 when 1 then 55 + k % 30 when 5 then 33 + k % 5 when 9 then case when line % 3 = 0 then 90 else 5 end else k % 13 end::double as strength
  from (select event_id as k, event_id // 2000 as series_id, event_id % 10 as line, event_id // 10 % 200 as pos from events)),
scored as (
  select series_id, pos, quantile_cont(strength, 0.5) as median, quantile_cont(strength, 0.5) / (quantile_cont(strength, 0.75) + 1) as consistency, avg((strength > 12)::int::double) as coverage
  from samples group by all)"""


def kept_apart(peaks: str) -> str:
    """SQL for what is kept of ``peaks`` (series_id, pos, strength, apart), from the strongest down."""
    return f"""
ranked as (select *, row_number() over (partition by series_id order by strength desc, pos) as k from {peaks}),
walk as (
  select distinct series_id, 0::bigint as k, []::bigint[] as kept from ranked
  union all
  select r.series_id, r.k, case when len(list_filter(kept, lambda q: abs(q - r.pos) < apart)) = 0 then list_append(kept, r.pos::bigint) else kept end
  from walk join ranked r on r.series_id = walk.series_id and r.k = walk.k + 1)
select series_id::bigint as series_id, unnest(kept) as pos from walk qualify k = max(k) over (partition by series_id)"""


def _maxima(score: str, valid: str) -> str:
    return f"""with recursive {LINES}, tops as (
  select *, {score} as strength, max({score}) over (partition by series_id order by pos range between 5 preceding and 5 following) as top from scored),
peaks as (select series_id, pos, strength, 12 as apart from tops where strength >= top and {valid} and pos >= 5 and pos < 195), {kept_apart('peaks')}"""


def _lines(spark, d):
    k = F.col("event_id")
    e = table(spark, d, "events").select(k, F.floor(k / 2000).alias("series_id"), (k % 10).alias("line"), (F.floor(k / 10) % 200).alias("pos"))
    kind = F.col("pos") % 17
    value = F.when(kind == 0, 60 + k % 11).when(kind == 1, 55 + k % 30).when(kind == 5, 33 + k % 5).when(kind == 9, F.when(F.col("line") % 3 == 0, 90).otherwise(5)).otherwise(k % 13)
    samples = e.select("series_id", "line", "pos", value.cast("double").alias("strength"))
    return samples, samples.select("series_id").distinct().withColumn("width", F.lit(200))


@query(_maxima("median * consistency * coverage", "median >= 40 and consistency >= 0.35 and coverage >= 0.5"))
def c5_robust_maxima(spark, d):
    return ps.robust_maxima(*_lines(spark, d))


@query(_maxima("median * coverage", "median >= 30 and coverage >= 0.75"))
def c5_faint_maxima(spark, d):
    return ps.robust_maxima(*_lines(spark, d), faint=True)


@query(f"""with recursive {PROFILE}, tops as (select *, max(strength) over (partition by series_id order by pos range between 5 preceding and 5 following) as top from profile),
peaks as (select series_id, pos, strength, 12 as apart from tops where strength = top and strength > 0), {kept_apart('peaks')}""")
def c5_local_maxima(spark, d):
    return ps.local_maxima(profile(spark, d))


@query(f"""with samples as (select event_id // 10000 as series_id, event_id % 40 as line, event_id // 40 % 250 as pos, (event_id // 40 % 250 // 10 * 37 % 200 + event_id % 3) as value from events),
c as (select *, abs(lead(value) over w - lag(value) over w) as change from samples window w as (partition by series_id, line order by pos)),
l as (select series_id, count(distinct line) as lines, max(pos) - 1 as extent from samples group by series_id),
strong as (select distinct series_id, pos from (select series_id, pos, change, count(*) as n from c where change >= 3 group by all) join l using (series_id) where n >= lines * 0.2), {islands(6, 'strong')},
found as (select series_id, round_even(avg(pos), 0)::bigint as pos from isl group by series_id, island)
select series_id, pos from (select *, min(pos) over w as first, count(*) over w as n from found join l using (series_id) window w as (partition by series_id))
where not (pos = first and n > 1 and pos <= greatest(4, floor(extent * 0.005)))""")
def c6_repeated_changes(spark, d):
    e = table(spark, d, "events")
    pos = F.floor(F.col("event_id") / 40) % 250
    samples = e.select((F.floor(F.col("event_id") / 10000)).alias("series_id"), (F.col("event_id") % 40).alias("line"), pos.alias("pos"), (F.floor(pos / 10) * 37 % 200 + F.col("event_id") % 3).alias("value"))
    return ps.repeated_changes(samples)


SAMPLES = "samples as (select event_type, floor(value)::bigint % 256 as value from events)"


@query(f"with {SAMPLES} select event_type, quantile_cont(value, 0.5) as median, quantile_cont(value, 0.75) as upper from samples group by event_type")
def c7_quantiles(spark, d):
    return ps.quantiles(_samples(spark, d), ["event_type"])


@query(f"with {SAMPLES} select event_type, quantile_cont(value, 0.5) as median from samples group by event_type")
def c8_median_by_counts(spark, d):
    return ps.median_by_counts(_samples(spark, d), ["event_type"])


def _samples(spark, d):
    return table(spark, d, "events").select("event_type", (F.floor("value") % 256).alias("value"))


GAPS = "gaps as (select *, next - pos as gap from (select series_id, pos, lead(pos) over (partition by series_id order by pos) as next from positions) where next is not null)"


@query(f"""with {POSITIONS}, {GAPS}, r as (select *, row_number() over (partition by series_id order by gap desc, pos) as k, count(*) over (partition by series_id) as n from gaps),
t as (select series_id, quantile_cont(gap, 0.5) as typical from r where k > 1 group by series_id)
select series_id, pos::bigint as pos from positions union all select series_id, round_even((pos + next) / 2, 0)::bigint from r join t using (series_id) where k = 1 and n >= 4 and gap > typical * 1.7 and gap < typical * 2.4""")
def c9_recover_single_missing(spark, d):
    return ps.recover_single_missing(positions(spark, d))


# Shared parts of the SQL below: the places asked about, their gaps, the typical gap, the profile's peaks.

PEAKS = "peaks as (select series_id, pos from profile where (pos % 12 = 0 and pos % 156 <> 60) or pos in (5, 715))"
WHOLE = "whole as (select series_id, max(strength) as peak from profile group by series_id)"


def gaps(source: str) -> str:
    return f"""gaps as (
  select *, next - pos as gap from (select series_id, pos, lead(pos) over (partition by series_id order by pos) as next from (select distinct series_id, pos from {source})) where next is not null)"""


TYPICAL = """typical as (
  select series_id, n_gaps, quantile_cont(gap, 0.5) filter (gap <= top) as typical
  from gaps join (select series_id, quantile_cont(gap, 0.7) as top, count(*) as n_gaps from gaps group by series_id) using (series_id) group by series_id, n_gaps)"""


def peaks_near(radius: int, floor: float, share: float) -> str:
    """``fresh``: of ``asked`` (series_id, spot) the profile's peak within ``radius``, the first of equals."""
    return f"""fresh as (
  select series_id, pos from (
    select a.series_id, a.spot, p.pos, p.strength from (select distinct series_id, spot from asked) a
    join profile p on p.series_id = a.series_id and p.pos between a.spot - {radius} and a.spot + {radius}
    qualify row_number() over (partition by a.series_id, a.spot order by p.strength desc, p.pos) = 1)
  join whole using (series_id) where strength >= {floor} and strength >= peak * {share} and peak > 0)"""


INSERTED = f"""together as (select series_id, pos from peaks union all select series_id, pos from fresh), {islands(5, 'together')}
select series_id, round_even(avg(pos), 0)::bigint as pos from isl group by series_id, island"""


@query(f"""with {PROFILE}, {PEAKS}, {WHOLE}, {gaps('peaks')}, r as (select *, row_number() over (partition by series_id order by gap desc, pos) as k, count(*) over (partition by series_id) as n from gaps),
t as (select series_id, quantile_cont(gap, 0.5) as typical from r where k > 1 group by series_id),
wide as (select series_id, pos as a, next as b from r join t using (series_id) where k = 1 and n >= 4 and gap > typical * 1.7 and gap < typical * 2.4),
best as (select p.series_id, p.pos, p.strength from wide w join profile p on p.series_id = w.series_id and p.pos >= a + 12 and p.pos < b - 11
  qualify row_number() over (partition by p.series_id order by p.strength desc, p.pos) = 1)
select series_id, pos from peaks union all select series_id, pos from best join whole using (series_id) where strength >= peak * 0.45 and peak > 0""")
def c9_recover_with_profile(spark, d):
    return ps.recover_single_missing(_peaks(spark, d), profile(spark, d))


def _peaks(spark, d):
    """Every twelfth hour with events, of each type, but for some gaps, and a place near each end."""
    return profile(spark, d).where("(pos % 12 = 0 and pos % 156 <> 60) or pos in (5, 715)").select("series_id", "pos")


@query(f"""with {PROFILE}, {PEAKS}, {WHOLE}, {gaps('peaks')}, {TYPICAL},
wide as (select *, round_even(gap / typical, 0)::int as times from gaps join typical using (series_id) where n_gaps >= 4 and typical >= 6),
asked as (select series_id, round_even(pos + gap * part / times, 0)::bigint as spot from (
  select *, unnest(range(1, times)) as part from wide where times between 2 and 4 and abs(gap / times - typical) <= typical * 0.22)),
{peaks_near(4, 0.56, 0.15)}, {INSERTED}""")
def c10_recover_regular_missing(spark, d):
    return ps.recover_regular_missing(_peaks(spark, d), profile(spark, d), 4)


@query(f"""with {PROFILE}, {PEAKS}, {WHOLE}, {gaps('peaks')}, {TYPICAL},
wide as (select *, greatest(10, round_even(typical * 0.12, 0)) as margin from gaps join typical using (series_id) where n_gaps >= 3 and typical >= 8 and gap >= typical * 1.1),
inside as (select distinct p.series_id, p.pos as spot, gap, typical from profile p join wide w on w.series_id = p.series_id and p.pos > w.pos + margin and p.pos < next - margin),
near as (select i.series_id, spot, gap, typical, max(strength) as local from inside i join profile p on p.series_id = i.series_id and p.pos between spot - 3 and spot + 3 group by all),
fresh as (select series_id, spot as pos from near join whole using (series_id) where peak > 0
  and ((gap >= typical * 1.75 and local >= 0.8 and local >= peak * 0.35) or (local >= 1.12 and local >= peak * 0.55))), {INSERTED}""")
def c11_recover_irregular(spark, d):
    return ps.recover_irregular(_peaks(spark, d), profile(spark, d).select("series_id", "pos"), profile(spark, d), 4)


@query(f"""with {PROFILE}, {PEAKS}, {WHOLE}, {gaps('peaks')}, {TYPICAL},
wide as (select *, greatest(10, round_even(typical * 0.12, 0)) as margin from gaps join typical using (series_id) where n_gaps >= 3 and typical >= 8 and gap >= typical * 1.1),
bands as (select series_id, pos, band, (pos * 7 + band * 13) % 40 / 40.0 + 0.5 as coverage from profile, (select unnest(range(2, 8)) as band) where band < 3 + pos % 4),
inside as (select distinct p.series_id, p.pos as spot, gap, typical from profile p join wide w on w.series_id = p.series_id and p.pos > w.pos + margin and p.pos < next - margin),
near as (select i.series_id, spot, gap, typical, max(strength) as local from inside i join profile p on p.series_id = i.series_id and p.pos between spot - 3 and spot + 3 group by all),
follow as (select series_id, pos as spot from bands group by all having count(*) >= 3 and count(*) filter (coverage >= 0.72) >= ceil(count(*) * 0.7)),
fresh as (select distinct series_id, spot as pos from near join whole using (series_id) where peak > 0
  and ((series_id, spot) in (select (series_id, spot) from follow) or (gap >= typical * 1.75 and local >= 0.8 and local >= peak * 0.35) or (local >= 1.12 and local >= peak * 0.55))), {INSERTED}""")
def c11_recover_by_rows(spark, d):
    band = F.explode(F.sequence(F.lit(2), F.lit(7))).alias("band")
    bands = profile(spark, d).select("series_id", "pos", band).where("band < 3 + pos % 4")
    bands = bands.withColumn("coverage", (F.col("pos") * 7 + F.col("band") * 13) % 40 / 40.0 + 0.5)
    return ps.recover_irregular(_peaks(spark, d), profile(spark, d).select("series_id", "pos"), profile(spark, d), 4, bands)


@query()
def c12_extend_sequence(spark, d):
    return ps.extend_sequence(_peaks(spark, d).where("pos between 100 and 600"), profile(spark, d), 2)


@query(f"""with {POSITIONS}, {islands(200)}, m as (select series_id, round_even(avg(pos), 0)::bigint as pos from isl group by series_id, island), ok as (select series_id from m group by series_id having count(*) >= 3)
select series_id, pos from m where series_id in (select series_id from ok) union all select series_id, pos::bigint from positions where series_id not in (select series_id from ok)""")
def c13_collapse_close(spark, d):
    return ps.collapse_close(positions(spark, d), 96_000)


@query(f"""with {PROFILE}, {PEAKS}, {gaps('peaks')}, {TYPICAL},
regular as (select series_id, typical from gaps join typical using (series_id) group by series_id, typical, n_gaps
  having n_gaps >= 4 and count(*) filter (abs(gap - typical) <= typical * 0.25) >= n_gaps * 0.6),
ends as (select series_id, min(pos) as a, max(pos) as b from peaks group by series_id)
select series_id, pos from peaks join ends using (series_id) left join regular using (series_id)
where not coalesce(pos > a and pos < b and least(pos - a, b - pos) < typical * 0.6, false)""")
def c14_collapse_edge_fragments(spark, d):
    return ps.collapse_edge_fragments(_peaks(spark, d))


@query(f"""with {PROFILE}, own as (select series_id, pos from profile where pos % 24 = 0 and pos < 480), {gaps('own')},
slots as (select series_id, min(pos) as a, max(next) as b, round_even((max(next) - min(pos)) / quantile_cont(gap, 0.5), 0)::int as slots from gaps group by series_id),
places as (select *, round_even(a + (b - a) * k / slots, 0)::bigint as spot from (select *, unnest(range(slots + 1)) as k from slots where slots between 12 and 32)),
near as (select p.series_id, spot, a, b, min(abs(pos - spot)) as off from places p join own o on o.series_id = p.series_id group by all),
good as (select series_id, spot as pos from near qualify count(*) filter (off <= (b - a) * 0.025) over (partition by series_id) >= 0.9 * count(*) over (partition by series_id))
select * from good union all select * from own where series_id not in (select series_id from good)""")
def c15_fit_even_spacing(spark, d):
    return ps.fit_even_spacing(profile(spark, d).where("pos % 24 = 0 and pos < 480").select("series_id", "pos"))


ENDS = "base as (select series_id, pos from profile where pos % 12 = 0), other as (select series_id, pos + pos % 3 as pos from profile where pos % 6 = 0)"


@query(f"""with {PROFILE}, {ENDS}, n as (select series_id, (select count(*) from base b where b.series_id = s.series_id) as n, (select count(*) from other o where o.series_id = s.series_id) as m,
  (select count(*) from base b where b.series_id = s.series_id and exists (select 1 from other o where o.series_id = b.series_id and abs(o.pos - b.pos) <= 7)) as hit from (select distinct series_id from profile) s),
win as (select series_id from n where n > 0 and m >= n + 2 and hit >= greatest(2, n - 2))
select series_id, pos from other where series_id in (select series_id from win) union all select series_id, pos from base where series_id not in (select series_id from win)""")
def c16_prefer_consensus(spark, d):
    p = profile(spark, d)
    return ps.prefer_consensus(p.where("pos % 12 = 0").select("series_id", "pos"), p.where("pos % 6 = 0").select("series_id", (F.col("pos") + F.col("pos") % 3).alias("pos")))


@query(f"""with {PROFILE}, base as (select series_id, pos from profile where pos % 12 = 0), dense as (select series_id, pos from profile where pos % 24 = 0), {gaps('dense')},
g as (select series_id, min(gap) as low, max(gap) as high, quantile_cont(gap, 0.5) as typical from gaps group by series_id),
n as (select series_id, (select count(*) from base b where b.series_id = s.series_id) as n, (select count(*) from dense o where o.series_id = s.series_id) as m,
  (select count(*) from dense o where o.series_id = s.series_id and exists (select 1 from base b where b.series_id = o.series_id and abs(o.pos - b.pos) <= 8)) as hit from (select distinct series_id from profile) s),
win as (select series_id from n left join g using (series_id) where (m >= 8 and n >= m * 1.55) or (m >= 4 and n > m and hit >= greatest(3, ceil(m * 0.8)) and low >= 12 and high <= typical * 1.65))
select * from dense where series_id in (select series_id from win) union all select * from base where series_id not in (select series_id from win)""")
def c17_select_dense(spark, d):
    p = profile(spark, d)
    return ps.select_dense(p.where("pos % 12 = 0").select("series_id", "pos"), p.where("pos % 24 = 0").select("series_id", "pos"), 1000)


@query(f"""with {PROFILE}, p as (select series_id, pos from profile where pos % 10 = 0), l as (select p.series_id, p.pos, coalesce(max(strength), 0) as local from p left join profile q on q.series_id = p.series_id and q.pos between p.pos - 3 and p.pos + 3 group by 1, 2),
k as (select *, (pos = min(pos) over w and pos <= 28) or (pos = max(pos) over w and pos >= 672) or local >= 2 * 0.55 as keep from l window w as (partition by series_id)),
j as (select *, count(*) filter (keep) over w as kept, count(*) over w as n from k window w as (partition by series_id)) select series_id, pos from j where keep or kept < greatest(3, ceil(n * 0.6))""")
def c18_filter_by_support(spark, d):
    p = profile(spark, d)
    return ps.filter_by_support(p.where("pos % 10 = 0").select("series_id", "pos"), p, 2, 700)


@query(f"""with {PROFILE}, a as (select series_id, pos from profile where pos % 12 = 0), b as (select series_id, pos from profile where pos % 6 = 0), {gaps('b')},
even as (select series_id, avg((abs(gap - typical) <= typical * 0.3)::int) as even from (select *, quantile_cont(gap, 0.5) over (partition by series_id) as typical from gaps) group by series_id),
ea as (select series_id, count(*) as n, min(pos) as low, max(pos) as high from a group by series_id), eb as (select series_id, count(*) as n, min(pos) as low, max(pos) as high from b group by series_id)
select ea.series_id, coalesce(eb.n > ea.n and even >= 0.7 and eb.low <= ea.low and eb.high >= ea.high, false) as take_b from ea left join eb using (series_id) left join even using (series_id)""")
def c19_grid_choice(spark, d):
    p = profile(spark, d)
    return ps.grid_choice(p.where("pos % 12 = 0").select("series_id", "pos"), p.where("pos % 6 = 0").select("series_id", "pos"))


@query("select event_id, case when area <= 0 or aspect < 1 or across <= 0 or down <= 0 or (aspect < 1.15 and (across < 0.055 or down < 0.025)) then 0.0::double else area * across * down * least(greatest(aspect, 1.15::double), 4.0::double) end as score from (select event_id, (user_id % 50)::double as area, (event_id % 60 / 10)::double as aspect, (event_id % 11 / 100)::double as across, (event_id % 7 / 100)::double as down from events)")
def c20_candidate_score(spark, d):
    e = table(spark, d, "events")
    k, u = F.col("event_id"), F.col("user_id")
    return e.select("event_id", ps.candidate_score((u % 50).cast("double"), k % 60 / 10, k % 11 / 100, k % 7 / 100).alias("score"))


@query("""with m as (select event_id, (event_id % 250)::double as median, (event_id % 200 + 60)::double as p90, (event_id % 97)::double as p10, (event_id % 90)::double as sharpness, (event_id % 140)::double as tile_span, event_id % 50 / 100 as dark_ratio, event_id % 30 / 100 as highlight_ratio from events),
i as (select event_id, list_filter([case when median < 82 or p90 < 118 or dark_ratio > 0.32 then 'dark' end, case when p90 - p10 < 48 then 'low_contrast' end, case when sharpness < 42 then 'blur' end, case when tile_span > 105 then 'uneven_lighting' end, case when highlight_ratio > 0.12 and median < 230 then 'clipped_highlights' end], lambda x: x is not null) as issues from m)
select event_id, issues, list_contains(issues, 'blur') or len(issues) >= 3 as needs_recapture from i""")
def c21_capture_issues(spark, d):
    k = F.col("event_id")
    real = lambda c: c.cast("double")
    m = table(spark, d, "events").select("event_id", real(k % 250).alias("median"), real(k % 200 + 60).alias("p90"), real(k % 97).alias("p10"), real(k % 90).alias("sharpness"), real(k % 140).alias("tile_span"), (k % 50 / 100).alias("dark_ratio"), (k % 30 / 100).alias("highlight_ratio"))
    return ps.capture_issues(m).select("event_id", "issues", "needs_recapture")


@query("""with s as (select (user_id % 5)::bigint as series_id, event_id % 64 as y, event_id // 64 % 48 as x, floor(value)::bigint % 256 as value from events),
t as (select series_id, y * 4 // 64 as ty, x * 4 // 48 as tx, quantile_cont(value, 0.5) as m from s group by all), sp as (select series_id, max(m) - min(m) as tile_span from t group by 1)
select series_id, quantile_cont(value, 0.05) as p5, quantile_cont(value, 0.1) as p10, quantile_cont(value, 0.5) as median, quantile_cont(value, 0.9) as p90, quantile_cont(value, 0.95) as p95, avg((value < 55)::int) as dark_ratio, avg((value >= 248)::int) as highlight_ratio, any_value(tile_span) as tile_span from s join sp using (series_id) group by 1""")
def c22_tile_stats(spark, d):
    e = table(spark, d, "events")
    samples = e.select((F.col("user_id") % 5).cast("long").alias("series_id"), (F.col("event_id") % 64).alias("y"), (F.floor(F.col("event_id") / 64) % 48).alias("x"), (F.floor("value") % 256).alias("value"))
    return ps.tile_stats(samples, 64, 48)


@query()
def c23_remove_weak_splits(spark, d):
    return ps.remove_weak_splits(_peaks(spark, d), profile(spark, d))


@query(f"""with body as (select distinct (user_id % 7)::bigint as series_id, event_id % 12 as band, event_id // 12 % 15 * 20 as pos, case when event_id // 12 % 15 % 3 = 0 then 0.4 else 0.9 end as coverage from events where event_id % 12 >= 3),
n as (select series_id, count(distinct band) as n from body group by series_id having count(distinct band) >= 6),
votes as (select series_id, pos, count(*) filter (coverage >= 0.72) as votes from body group by all), strong as (select votes.* from votes join n using (series_id) where votes >= n * 0.65), {islands(1, 'strong')},
best as (select series_id, pos from isl qualify row_number() over (partition by series_id, island order by votes desc, pos) = 1),
runs as (select *, sum(start) over (partition by series_id order by pos) as run from (select *, case when pos - lag(pos) over (partition by series_id order by pos) > 7 then 1 else 0 end as start from best)),
found as (select series_id, round_even(avg(pos), 0)::bigint as pos from runs group by series_id, run)
select series_id, pos from found qualify count(*) over (partition by series_id) between 4 and 32""")
def c24_band_consensus(spark, d):
    e = table(spark, d, "events")
    segments = e.select((F.col("user_id") % 7).cast("long").alias("series_id"), (F.col("event_id") % 12).alias("band"), (F.floor(F.col("event_id") / 12) % 15 * 20).alias("pos"), F.when(F.floor(F.col("event_id") / 12) % 15 % 3 == 0, 0.4).otherwise(0.9).alias("coverage"))
    return ps.band_consensus(segments.distinct())


RULES = """
marks as (select distinct (user_id % 7)::bigint as series_id, event_id % 6 as line, event_id // 6 % 40 * 8 + user_id % 7 as pos from events where event_id % 53 <> 0),
jumps as (select *, case when pos - lag(pos) over (partition by series_id, line order by pos) > 12 then 1 else 0 end as jump from marks),
pieces as (select *, sum(jump) over (partition by series_id, line order by pos) as piece from jumps),
spans_ as (select series_id, line, min(pos) as first, max(pos) as last, count(*) as n from pieces group by series_id, line, piece),
dominant as (select * from spans_ qualify row_number() over (partition by series_id, line order by last - first desc, n desc, first) = 1 and sum(n) over (partition by series_id, line) >= 2),
frame as (select series_id, round_even(quantile_cont(first, 0.5), 0)::bigint as a, round_even(quantile_cont(last, 0.5), 0)::bigint as b from dominant where last - first >= 320 * 0.35 group by series_id having count(*) >= 5)"""


@query(f"""with {RULES}, body as (select distinct (user_id % 7)::bigint as series_id, event_id % 12 as band, event_id // 12 % 15 * 20 as pos, case when event_id // 12 % 15 % 3 = 0 then 0.4 else 0.9 end as coverage from events where event_id % 12 >= 3),
n as (select series_id, count(distinct band) as n from body group by series_id having count(distinct band) >= 6),
votes as (select series_id, pos, count(*) filter (coverage >= 0.72) as votes from body group by all), strong as (select votes.* from votes join n using (series_id) where votes >= n * 0.65), {islands(1, 'strong')},
best as (select series_id, pos from isl qualify row_number() over (partition by series_id, island order by votes desc, pos) = 1),
runs as (select *, sum(start) over (partition by series_id order by pos) as run from (select *, case when pos - lag(pos) over (partition by series_id order by pos) > 7 then 1 else 0 end as start from best)),
found as (select series_id, round_even(avg(pos), 0)::bigint as pos from runs group by series_id, run),
framed as (select f.series_id, f.pos from found f join frame using (series_id) where f.pos between a - 8 and b + 8 union all select series_id, unnest([a, b]) from frame),
again as (select *, sum(start) over (partition by series_id order by pos) as run from (select *, case when pos - lag(pos) over (partition by series_id order by pos) > 7 then 1 else 0 end as start from framed)),
merged as (select series_id, round_even(avg(pos), 0)::bigint as pos from again group by series_id, run),
gapped as (select *, lead(pos) over (partition by series_id order by pos) - pos as gap from merged)
select series_id, pos from gapped qualify count(*) over (partition by series_id) between 4 and 32 and min(gap) over (partition by series_id) >= 8""")
def c24_framed_consensus(spark, d):
    e = table(spark, d, "events")
    series = (F.col("user_id") % 7).cast("long").alias("series_id")
    part = F.floor(F.col("event_id") / 12) % 15
    segments = e.select(series, (F.col("event_id") % 12).alias("band"), (part * 20).alias("pos"), F.when(part % 3 == 0, 0.4).otherwise(0.9).alias("coverage"))
    marks = e.where("event_id % 53 <> 0").select(series, (F.col("event_id") % 6).alias("line"), (F.floor(F.col("event_id") / 6) % 40 * 8 + F.col("user_id") % 7).alias("pos"))
    return ps.framed_consensus(segments.distinct(), marks.distinct(), 320)


@query(f"""with {POSITIONS}, {GAPS}, t as (select series_id, quantile_cont(gap, 0.5) as typical from gaps where gap >= 8 group by 1 having count(*) >= 3), e as (select series_id, min(pos) as a, max(pos) as b, any_value(typical) as typical from positions join t using (series_id) group by 1)
select series_id, pos::bigint as pos from positions union select series_id, 0 from e where a >= typical * 0.65 - 131.4 and a <= typical * 1.35 + 131.4
union select series_id, 43799 from e where 43799 - b >= typical * 0.65 - 131.4 and 43799 - b <= typical * 1.35 + 131.4""")
def c25_add_edges(spark, d):
    return ps.add_edges(positions(spark, d), 43_800)


@query()
def c26_collapse_double(spark, d):
    return ps.collapse_double(_peaks(spark, d), profile(spark, d))


@query(f"""with {PROFILE}, {PEAKS}, {WHOLE}, {gaps('peaks')}, {TYPICAL},
high as (select series_id, pos from profile join whole using (series_id) where peak > 0 and strength >= greatest(0.4, peak * 0.2)), {islands(2, 'high')},
weak as (select distinct series_id, round_even(avg(pos), 0)::bigint as pos from isl group by series_id, island),
new as (select * from weak w where not exists (select 1 from peaks p where p.series_id = w.series_id and abs(p.pos - w.pos) <= 5)),
n as (select series_id, count(*) as n, count(*) filter (exists (select 1 from weak w where w.series_id = p.series_id and abs(w.pos - p.pos) <= 5)) as hit, min(pos) as first from peaks p group by series_id),
fills as (select distinct x.series_id from new x join gaps g on g.series_id = x.series_id and x.pos > g.pos and x.pos < g.next join typical t on t.series_id = x.series_id where gap >= typical * 2.5
  union select x.series_id from new x join n using (series_id) where x.pos < first),
good as (select series_id from n join (select series_id, count(*) as fresh from new group by series_id) using (series_id) join fills using (series_id) where hit >= n * 0.9 and fresh >= 2)
select * from peaks union all select * from new where series_id in (select series_id from good)""")
def c27_recover_weak(spark, d):
    return ps.recover_weak(_peaks(spark, d), profile(spark, d), 2)


@query(f"""with {PROFILE}, {PEAKS}, {WHOLE}, {gaps('peaks')},
asked as (select series_id, round_even((pos + next) / 2, 0)::bigint as spot from (select *, quantile_cont(gap, 0.5) over (partition by series_id) as typical from gaps) where gap >= typical * 1.65 and gap <= typical * 2.35),
{peaks_near(3, 0.0, 0.30)} select series_id, pos from peaks union select series_id, pos from fresh""")
def c28_recover_midpoint(spark, d):
    return ps.recover_midpoint(_peaks(spark, d), profile(spark, d))
