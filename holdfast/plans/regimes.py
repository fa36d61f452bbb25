"""Queries over partitions of time."""

from __future__ import annotations

from pyspark.sql import functions as F

from holdfast.functions.tables import broadcast_if_small
from holdfast.operators import partitions as prt
from holdfast.plans.fixtures import DAY, START, oracle, sql, view

Q: dict = {}
SQL: dict = {}
HOUR = 3600
SPECS = 5  # event types of the given tables


def query(name: str, oracle_text: str | None = None):
    def keep(fn):
        Q[name] = fn
        if oracle_text:
            SQL[name] = oracle(oracle_text)
        return fn

    return keep


_GRID = f"(select unnest(generate_series({START}::bigint, {START + 30 * DAY - HOUR}::bigint, {HOUR}::bigint)) as t)"


def _grid(spark):
    return prt.bar_grid(spark, START, START + 30 * DAY - HOUR, HOUR)


@query("bar_grid", f"select spec_ref, t from (select distinct spec_ref from {{series}}), {_GRID}")
def _(spark, d):
    return view(spark, d, "series").select("spec_ref").distinct().join(broadcast_if_small(_grid(spark)))


_ONGRID = f"(select s.spec_ref, g.t, b.value from (select distinct spec_ref from {{series}}) s cross join {_GRID} g left join {{bars}} b on b.spec_ref = s.spec_ref and b.t = g.t)"


@query("series_on_grid", f"select * from {_ONGRID}")
def _(spark, d):
    return prt.series_on_grid(view(spark, d, "series"), _grid(spark), HOUR)


@query("latest_on_grid", f"select spec_ref, t, (select s.value from {{series}} s where s.spec_ref = x.spec_ref and s.t <= x.t order by s.t desc, s.value desc limit 1) as value from (select distinct spec_ref, g.t from {{series}} cross join {_GRID} g) x")
def _(spark, d):
    return prt.latest_on_grid(view(spark, d, "series"), _grid(spark))


def _trail(source: str, n: int = 5) -> str:
    w = f"over (partition by spec_ref order by t rows between {n - 1} preceding and current row)"
    return f"(select spec_ref, t, avg(value) {w} as mean, stddev_pop(value) {w} as std, min(value) {w} as min, max(value) {w} as max, value as last, value - first_value(value) {w} as delta from {source})"


@query("trailing_summaries", f"select spec_ref, t, {', '.join(f'round({s}, 7) as {s}' for s in prt.STATS)} from {_trail('{bars}')}")
def _(spark, d):
    out = prt.trailing_summaries(view(spark, d, "bars"), 5)
    return out.withColumns({s: F.round(s, 7) for s in prt.STATS})


def _refs(spark, d):
    """All event types, in order."""
    return [r[0] for r in view(spark, d, "events").select("event_type").distinct().orderBy("event_type").collect()]


# bars of six hours, in which all specs have values
_COARSE = "(select spec_ref, cast(floor(t / 21600) as bigint) * 21600 as t, avg(value) as value from {series} group by 1, 2)"
_R = "(select spec_ref, row_number() over (order by spec_ref) as i from (select distinct spec_ref from {series}))"
XS = [f"x{i}" for i in range(2 * SPECS)]
_CELLS = ", ".join(f"max(case when i = {i + 1} then {s} end) as x{2 * i + j}" for i in range(SPECS) for j, s in enumerate(("mean", "last")))
_MATRIX = f"""(select t, {_CELLS} from {_trail(_COARSE)} s join {_R} r on r.spec_ref = s.spec_ref group by t)"""
_FULL = f"(select * from {_MATRIX} where {' and '.join(f'{x} is not null' for x in XS)})"


def _matrix(spark, d):
    return prt.state_matrix(prt.trailing_summaries(sql(spark, d, f"select * from {_COARSE}"), 5), _refs(spark, d), ["mean", "last"])


def _rounded(df, places=6):
    return df.withColumns({c: F.round(c, places) for c, k in df.dtypes if k == "double"})


@query("state_matrix", f"select t, {', '.join(f'round({x}, 6) as {x}' for x in XS)} from {_FULL}")
def _(spark, d):
    return _rounded(_matrix(spark, d))


_STD = f"(select t, {', '.join(f'({x} - m{x}) / case when s{x} < 1e-12 then 1 else s{x} end as {x}' for x in XS)} from {_FULL} cross join (select {', '.join(f'avg({x}) as m{x}, stddev_pop({x}) as s{x}' for x in XS)} from {_FULL}))"


@query("standardize", f"select t, {', '.join(f'round({x}, 6) as {x}' for x in XS)} from {_STD}")
def _(spark, d):
    return _rounded(prt.standardize(_matrix(spark, d)))


@query("effective_k", f"select count(*) as n, count(distinct ({', '.join(XS)})) as different, least(3, count(*), count(distinct ({', '.join(XS)}))) as k from {_FULL}")
def _(spark, d):
    return prt.effective_k(_matrix(spark, d), 3)


_RANKED = f"(select *, row_number() over (order by {', '.join(XS)}, t) - 1 as r, count(*) over () as n from {_STD})"
_PICK = "cast(round_even(cast({i} as double) * (n - 1) / 2, 0) as bigint)"


@query("initial_centers", f"select {{i}} from {_RANKED}".replace("{i}", "cast(i as int) as label, " + ", ".join(f"round({x}, 6) as {x}" for x in XS)) + " cross join (values (0), (1), (2)) as v(i) where r = " + _PICK.replace("{i}", "i"))
def _(spark, d):
    return _rounded(prt.initial_centers(prt.standardize(_matrix(spark, d)), 3))


def _steps(count: int) -> str:
    """Lloyd steps on ``s`` as common tables c0, l0, c1, ...; labels of the last step before its update."""
    parts = [f"s as materialized {_STD}", f"c0 as materialized (select i, {', '.join(XS)} from {_RANKED} cross join (values (0), (1), (2)) as v(i) where r = {_PICK.replace('{i}', 'i')})"]
    for k in range(count):
        near = " + ".join(f"(s.{x} - c.{x}) * (s.{x} - c.{x})" for x in XS)
        parts.append(f"l{k} as materialized (select s.t, {', '.join(f'any_value(s.{x}) as {x}' for x in XS)}, arg_min(c.i, ({near}, c.i)) as i from s cross join c{k} c group by s.t)")
        parts.append(f"c{k + 1} as materialized (select i, {', '.join(f'avg({x}) as {x}' for x in XS)} from l{k} group by i)")
    return f"with {', '.join(parts)}, names as (select i, row_number() over (order by {', '.join(XS)}) - 1 as label from c{count})"


_LABELS = f"{_steps(4)} select t, 'partition_' || cast(label as string) as partition_id from l3 join names on names.i = l3.i"


@query("assign_update", _LABELS)
def _(spark, d):
    return prt.partition_assignment(prt.cluster(prt.standardize(_matrix(spark, d)), 3, iterations=4)[0])


@query("canonical_labels", f"{_steps(4)} select cast(label as int) as label, {', '.join(f'round(c4.{x}, 6) as {x}' for x in XS)} from c4 join names on names.i = c4.i")
def _(spark, d):
    _, centers = prt.cluster(prt.standardize(_matrix(spark, d)), 3, iterations=4)
    rows = [F.struct(F.lit(i).alias("label"), *[F.lit(round(v, 6)).alias(x) for x, v in zip(XS, c, strict=True)]) for i, c in enumerate(centers)]
    one = prt.standardize(_matrix(spark, d)).agg(F.count("*").alias("n"))
    return one.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


_FAR = "(select t, case when d0 <= d1 then 0 else 1 end as label, least(d0, d1) as distance from (select t, __D0__ as d0, __D1__ as d1 from __STD__))".replace("__STD__", _STD).replace("__D0__", " + ".join(f"{x} * {x}" for x in XS)).replace("__D1__", " + ".join(f"({x} - 1) * ({x} - 1)" for x in XS))


@query("repair_empty", f"""select t, cast(case when label = (select label from {_FAR} group by 1 order by count(*) desc, label limit 1) and row_number() over (partition by label order by distance desc, t) = 1 then 2 else label end as int) as label from {_FAR}""")
def _(spark, d):
    labelled = prt.assign(prt.standardize(_matrix(spark, d)), [(0.0,) * len(XS), (1.0,) * len(XS), (1e6,) * len(XS)])
    return prt.override(labelled, prt.repair_empty(labelled, 3)).select("t", "label")


@query("partition_assignment")
def _(spark, d):
    return prt.partition_assignment(prt.cluster(prt.standardize(_matrix(spark, d)), 3)[0])


_TAGGED = "(select distinct t, 'partition_' || cast(cast(floor(t / 25200) as bigint) % 3 as string) as partition_id from {bars})"


def _tags(spark, d):
    return sql(spark, d, f"select * from {_TAGGED}")


@query("partition_fingerprints", f"""select partition_id, cast(dim as int) as dim, count(*) as count, round(count(*) / sum(count(*)) over (partition by dim) + 3.7e-8, 6) as weight, round(avg(value) + 3.7e-8, 6) as centroid, round(stddev_pop(value) + 3.7e-8, 6) as std,
    round(min(value) + 3.7e-8, 6) as min, round(max(value) + 3.7e-8, 6) as max, round(quantile_cont(value, 0.1) + 3.7e-8, 6) as q0, round(quantile_cont(value, 0.5) + 3.7e-8, 6) as q1, round(quantile_cont(value, 0.9) + 3.7e-8, 6) as q2
    from (select partition_id, {{unpivot}} from {_FULL} m join {_TAGGED} a on a.t = m.t) group by partition_id, dim""".replace("{unpivot}", f"unnest({list(range(len(XS)))}) as dim, unnest([{', '.join(XS)}]) as value"))
def _(spark, d):
    out = prt.partition_fingerprints(_matrix(spark, d), _tags(spark, d))
    return out.withColumns({c: F.round(F.col(c) + 3.7e-8, 6) for c, k in out.dtypes if k == "double"})  # off exact ties


_W = f"(select distinct pattern_id, stage, {START} + cast((t0 / 86400) as bigint) % 29 * {DAY} as t0, {START} + cast((t0 / 86400) as bigint) % 29 * {DAY} + 30000 as t1 from {{reservations}})"
_FOR = f"""(select pattern_id, stage, t0, partition_id from (select w.pattern_id, w.stage, w.t0, a.partition_id, row_number() over (partition by w.pattern_id, w.stage, w.t0 order by count(*) desc, a.partition_id) as turn
    from {_W} w join {_TAGGED} a on a.t between w.t0 and w.t1 group by 1, 2, 3, 4) where turn = 1)"""


def _windows(spark, d):
    return sql(spark, d, f"select * from {_W}")


@query("partition_for_window", f"select * from {_FOR}")
def _(spark, d):
    return prt.partition_for_window(_tags(spark, d), _windows(spark, d), ["pattern_id", "stage", "t0"])


@query("assignment_profile", f"select a.partition_id, count, windows from (select partition_id, count(*) as windows from {_FOR} group by 1) a join (select partition_id, count(*) as count from {_FULL} m join {_TAGGED} g on g.t = m.t group by 1) f on f.partition_id = a.partition_id")
def _(spark, d):
    prints = prt.partition_fingerprints(_matrix(spark, d), _tags(spark, d)).where("dim = 0")
    tags = prt.partition_for_window(_tags(spark, d), _windows(spark, d), ["pattern_id", "stage", "t0"])
    return prt.assignment_profile(tags, prints).select("partition_id", "count", "windows")


@query("fallback_profile", f"select 'partition_0' as partition_id, 1.0e0 as weight, count(*) as windows from {_W}")
def _(spark, d):
    return prt.fallback_profile(_windows(spark, d))
