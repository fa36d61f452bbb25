"""Queries over assertions, scopes and replication tests."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from holdfast.functions.tables import written
from holdfast.operators import patterns as pat
from holdfast.operators import replication as rep
from holdfast.plans.fixtures import DAY, START, oracle, sql, view

Q: dict = {}
SQL: dict = {}


def query(name: str, oracle_text: str | None = None):
    def keep(fn):
        Q[name] = fn
        if oracle_text:
            SQL[name] = oracle(oracle_text)
        return fn

    return keep


_DAILY = "select spec_ref, entity, cast(floor(t / 86400) as bigint) as day, value from {series}"
_GROUPS = "select spec_ref, day, entity, case when day % 7 = 0 and entity = '3' then cast('NaN' as double) else value end as value from (" + _DAILY + ")"


@query("assert_in_range", f"select spec_ref, day, bool_and(not isnan(value) and value between 0 and 200) as holds from ({_GROUPS}) group by 1, 2")
def _(spark, d):
    g = sql(spark, d, _GROUPS)
    return g.groupBy("spec_ref", "day").agg((pat.usable(F.col("value")) & pat.in_range(F.col("value"), F.lit(0), F.lit(200))).alias("holds"))


@query("assert_quantile_ge", f"select spec_ref, day, bool_and(not isnan(value)) and quantile_cont(value, 0.4) >= 40 as holds from ({_GROUPS}) group by 1, 2")
def _(spark, d):
    return pat.quantiles_reach(sql(spark, d, _GROUPS), ["spec_ref", "day"], 0.4, 40)


@query("assert_sign", f"select spec_ref, day, bool_and(not isnan(value)) and bool_and(sign(value) = 1) as holds from ({_GROUPS}) group by 1, 2")
def _(spark, d):
    g = sql(spark, d, _GROUPS)
    return g.groupBy("spec_ref", "day").agg((pat.usable(F.col("value")) & pat.sign(F.col("value"), F.lit(pat.SIGNS["positive"]))).alias("holds"))


@query("scope_all", "select event_id, value from {series}")
def _(spark, d):
    return pat.SCOPES["all"](view(spark, d, "series")).select("event_id", "value")


@query("scope_time_range", f"select event_id, value from {{series}} where t between {START + 2 * DAY} and {START + 5 * DAY}")
def _(spark, d):
    return pat.SCOPES["time_range"](view(spark, d, "series"), START + 2 * DAY, START + 5 * DAY).select("event_id", "value")


@query("scope_entity_set", "select event_id, value from {series} where entity in (select cast(c_custkey as string) from {customer} where c_custkey % 4 = 1)")
def _(spark, d):
    return pat.SCOPES["entity_set"](view(spark, d, "series"), sql(spark, d, "select cast(c_custkey as string) as entity from {customer} where c_custkey % 4 = 1")).select("event_id", "value")


@query("scope_partition", "select spec_ref, t, value from {bars} where (t / 3600) % 3 = 1")
def _(spark, d):
    tags = sql(spark, d, "select distinct t, 'partition_' || cast(cast(t / 3600 as bigint) % 3 as string) as partition_id from {bars}")
    return pat.SCOPES["partition"](view(spark, d, "bars"), tags, "partition_1").select("spec_ref", "t", "value")


_SCOPED = f"select *, case when kind = 'sign' then null else cast({START + DAY} as bigint) end as scope_t0, case when kind = 'in_range' then cast({START + 9 * DAY} as bigint) end as scope_t1 from {{patterns}}"


@query("evaluate_patterns", f"""select p.pattern_id, b.t, coalesce(b.t >= scope_t0, true) and coalesce(b.t <= scope_t1, true) and
    case kind when 'in_range' then value between lo and hi when 'sign' then sign(value) = expected_sign else value >= threshold end as holds
    from ({_SCOPED}) p join {{bars}} b on p.spec_ref = b.spec_ref""")
def _(spark, d):
    return pat.evaluate(sql(spark, d, _SCOPED), view(spark, d, "bars"))


_LISTED = f"select pattern_id, case when kind = 'sign' then '[{{\"window_id\":\"w\",\"t0\":{START + 5 * DAY},\"t1\":{START + 6 * DAY}}}]' else '[{{\"t0\":{START + 3 * DAY},\"t1\":{START + 4 * DAY}}},{{\"window_id\":\"x\",\"t0\":{START + 6 * DAY},\"t1\":{START + 7 * DAY}}}]' end as windows from __patterns__"
_LISTED = _LISTED.replace("__patterns__", "{patterns}")


@query("fixed_windows", f"""select pattern_id, 'w' as window_id, cast({START + 5 * DAY} as bigint) as t0, cast({START + 6 * DAY} as bigint) as t1 from {{patterns}} where kind = 'sign'
    union all select pattern_id, 'heldout_0', {START + 3 * DAY}, {START + 4 * DAY} from {{patterns}} where kind <> 'sign' union all select pattern_id, 'x', {START + 6 * DAY}, {START + 7 * DAY} from {{patterns}} where kind <> 'sign'""")
def _(spark, d):
    text = F.when(F.col("kind") == "sign", F.lit(f'[{{"window_id":"w","t0":{START + 5 * DAY},"t1":{START + 6 * DAY}}}]')).otherwise(F.lit(f'[{{"t0":{START + 3 * DAY},"t1":{START + 4 * DAY}}},{{"window_id":"x","t0":{START + 6 * DAY},"t1":{START + 7 * DAY}}}]'))
    return rep.fixed_windows(view(spark, d, "patterns").select("pattern_id", text.alias("windows")))


_GRID = "select pattern_id, t0, t0 + window_seconds as t1 from (select *, unnest(generate_series(greatest(search_t0, obs_t1 + gap_seconds), search_t1 - window_seconds, step_seconds)) as t0 from {patterns})"
_HELD = f"""select pattern_id, 'heldout_' || cast(row_number() over (partition by pattern_id order by t0, t1) - 1 as string) as window_id, t0, t1 from (
    select g.*, row_number() over (partition by g.pattern_id order by sha256('{{{{"pattern_id":"' || g.pattern_id || '","window":{{{{"t0":' || cast(t0 as string) || ',"t1":' || cast(t1 as string) || '}}}}}}}}')) as turn, window_count
    from ({_GRID}) g join {{patterns}} p on p.pattern_id = g.pattern_id) where turn <= window_count""".replace("{{", "{").replace("}}", "}")
_OBS = "select pattern_id, 'observation' as window_id, obs_t0 as t0, obs_t1 as t1 from {patterns}"
_WINDOWS = f"({_HELD} union all {_OBS})"
_VALUES = f"(select p.pattern_id, w.window_id, s.t, s.value, s.source_hash from {{patterns}} p join {_WINDOWS} w on w.pattern_id = p.pattern_id join {{series}} s on s.spec_ref = p.spec_ref and s.t between w.t0 and w.t1)"
_PASS = "bool_and(not isnan(value)) and case any_value(kind) when 'in_range' then bool_and(value between lo and hi) when 'sign' then bool_and(sign(value) = expected_sign) else quantile_cont(value, 0.5) >= any_value(threshold) end"


def _verdicts(values: str, patterns: str = "{patterns}", windows: str = _WINDOWS) -> str:
    return f"""(select w.pattern_id, w.window_id, coalesce(n, 0) as n, coalesce(passed, false) as passed from {windows} w left join (
        select v.pattern_id, v.window_id, count(*) as n, {_PASS} as passed from {values} v join {patterns} p on p.pattern_id = v.pattern_id group by 1, 2) r on r.pattern_id = w.pattern_id and r.window_id = w.window_id)"""


@query("grid_windows", _GRID)
def _(spark, d):
    return rep.grid_windows(view(spark, d, "patterns"))


def _heldout(spark, d):
    p = view(spark, d, "patterns")
    return rep.select_heldout(rep.grid_windows(p), p)


@query("select_heldout", _HELD)
def _(spark, d):
    return _heldout(spark, d)


@query("gap_failures", f"select g.pattern_id, cast(g.t0 as string) as window_id from ({_GRID}) g join {{patterns}} p on p.pattern_id = g.pattern_id where g.t0 < obs_t1 + 4 * {DAY}")
def _(spark, d):
    p = view(spark, d, "patterns")
    windows = rep.grid_windows(p).withColumn("window_id", F.col("t0").cast("string"))
    return rep.gap_failures(windows, p.withColumn("gap_seconds", F.lit(None).cast("long")).withColumn("min_gap_seconds", F.lit(4 * DAY)))


def _tables(spark, d):
    p = view(spark, d, "patterns")
    held = _heldout(spark, d)
    windows = held.unionByName(rep.observation_windows(p))
    return p, held, windows, rep.window_values(view(spark, d, "series"), windows, p)


@query("window_values", f"select pattern_id, window_id, t, value from {_VALUES}")
def _(spark, d):
    return _tables(spark, d)[3].select("pattern_id", "window_id", "t", "value")


_SCOPES = """select *, case kind when 'in_range' then 'entity_set' when 'quantile_ge' then 'time_range' when 'sign' then 'partition' end as scope_kind, case kind when 'quantile_ge' then __FROM__ end as scope_t0, cast(null as bigint) as scope_t1,
    'partition_1' as scope_partition from {patterns}""".replace("__FROM__", f"cast({START + 7 * DAY + 3600} as bigint)")
_HOURS = "(select distinct t, 'partition_' || cast(cast(floor(t / 3600) as bigint) % 3 as string) as partition_id from {series})"


_SCOPED_VALUES = f"""(select v.*, p.scope_kind from (select p.pattern_id, w.window_id, s.t, s.value, s.entity from {{patterns}} p join {_WINDOWS} w on w.pattern_id = p.pattern_id join {{series}} s on s.spec_ref = p.spec_ref and s.t between w.t0 and w.t1) v
    join ({_SCOPES}) p on p.pattern_id = v.pattern_id where case scope_kind when 'entity_set' then entity in ('1', '2', '3') when 'time_range' then t >= scope_t0 else cast(floor(t / 3600) as bigint) % 3 = 1 end)"""


@query("scoped_window_verdicts", f"""select * from {_verdicts(_SCOPED_VALUES)}""")
def _(spark, d):
    p = written(sql(spark, d, _SCOPES).withColumn("scope_entities", F.array(F.lit("1"), F.lit("2"), F.lit("3"))))
    windows = written(_heldout(spark, d).unionByName(rep.observation_windows(p)))
    values = rep.window_values(view(spark, d, "series"), windows, p, assignment=sql(spark, d, f"select * from {_HOURS}"))
    return rep.window_verdicts(values, windows, p)


@query("heldout_windows", f"""select * from ({_HELD}) where pattern_id in (select pattern_id from {{patterns}} where kind <> 'sign')
    union all select pattern_id, 'w', cast({START + 5 * DAY} as bigint), cast({START + 6 * DAY} as bigint) from {{patterns}} where kind = 'sign' union all select pattern_id, 'heldout_1', {START + 8 * DAY}, {START + 9 * DAY} from {{patterns}} where kind = 'sign'""")
def _(spark, d):
    p, sign = view(spark, d, "patterns"), F.col("kind") == "sign"
    text = F.lit(f'[{{"window_id":"w","t0":{START + 5 * DAY},"t1":{START + 6 * DAY}}},{{"t0":{START + 8 * DAY},"t1":{START + 9 * DAY}}}]')
    return rep.heldout_windows(written(p.withColumns({"windows": F.when(sign, text), "window_count": F.when(~sign, F.col("window_count"))})))


_POINTS = f"""(select x.pattern_id, x.window_id, x.t, s.value from (select w.pattern_id, w.window_id, p.spec_ref, unnest(generate_series(w.t0, w.t1, 21600)) as t from {_WINDOWS} w join {{patterns}} p on p.pattern_id = w.pattern_id) x
    asof left join (select spec_ref, t, max(value) as value from {{series}} where value is not null group by 1, 2) s on s.spec_ref = x.spec_ref and x.t >= s.t)"""


@query("point_window_values", f"select * from {_POINTS}")
def _(spark, d):
    p = view(spark, d, "patterns")
    windows = _heldout(spark, d).unionByName(rep.observation_windows(p))
    return rep.point_values(view(spark, d, "series"), windows, p.withColumn("step_seconds", F.lit(21600)))


@query("window_verdicts", f"select * from {_verdicts(_VALUES)}")
def _(spark, d):
    p, _, windows, values = _tables(spark, d)
    return rep.window_verdicts(values, windows, p)


@query("window_summary", f"select pattern_id, window_id, count(*) as size, count(value) as finite, round(min(value), 6) as min, round(max(value), 6) as max, round(avg(value), 6) as mean, round(quantile_cont(value, 0.5), 6) as median from {_VALUES} group by 1, 2")
def _(spark, d):
    out = rep.window_summary(_tables(spark, d)[3])
    return out.withColumns({c: F.round(c, 6) for c in ("min", "max", "mean", "median")})


_LINEAGE = f"(select distinct pattern_id, window_id, source_hash as hash from {_VALUES})"


@query("window_lineage", f"select * from {_LINEAGE}")
def _(spark, d):
    return rep.window_lineage(_tables(spark, d)[3])


@query("declared_lineage", f"""select * from {_LINEAGE} where window_id <> 'heldout_0' union all select w.pattern_id, w.window_id, SHA(p.spec_ref || ':dep') from {_WINDOWS} w join {{patterns}} p on p.pattern_id = w.pattern_id
    where w.window_id = 'heldout_0' or not exists (select 1 from {_VALUES} v where v.pattern_id = w.pattern_id and v.window_id = w.window_id)""")
def _(spark, d):
    p, _, windows, values = _tables(spark, d)
    some = values.withColumn("source_hash", F.when(F.col("window_id") != "heldout_0", F.col("source_hash")))
    return rep.window_lineage(some, windows, p, sql(spark, d, "select distinct spec_ref, SHA(spec_ref || ':dep') as hash from {series}"))


@query("window_digests")
def _(spark, d):
    p, _, windows, values = _tables(spark, d)
    windows, values = written(windows), written(values)
    return rep.window_fingerprints(values, rep.window_verdicts(values, windows, p), rep.window_lineage(values), windows, p)


_SHARED = f"(select pattern_id, count(*) as shared from {_LINEAGE} h where window_id <> 'observation' and exists (select 1 from {_LINEAGE} o where o.window_id = 'observation' and o.pattern_id = h.pattern_id and o.hash = h.hash) group by 1)"
_RESERVED = f"select pattern_id, 'Discover' as stage, cast({START + 10 * DAY} as bigint) as t0, cast({START + 11 * DAY} as bigint) as t1, 'c1' as cycle_id from {{patterns}} where kind = 'sign' union all select pattern_id, 'EmpiricalTest', t0, t1, 'c2' from ({_HELD}) where window_id = 'heldout_2'"
_REFUSED = f"(select pattern_id, window_id from ({_HELD}) h where exists (select 1 from ({_RESERVED}) r where r.stage = 'Discover' and r.pattern_id = h.pattern_id and r.t0 <= h.t1 and r.t1 >= h.t0))"


def _reservations(p, held):
    first = p.where("kind = 'sign'").select("pattern_id", F.lit("Discover").alias("stage"), F.lit(START + 10 * DAY).cast("long").alias("t0"), F.lit(START + 11 * DAY).cast("long").alias("t1"), F.lit("c1").alias("cycle_id"))
    return first.unionByName(held.where("window_id = 'heldout_2'").select("pattern_id", F.lit("EmpiricalTest").alias("stage"), "t0", "t1", F.lit("c2").alias("cycle_id")))


_CLEAN = f"""(select p.pattern_id, coalesce(shared, 0) as shared, cast(0 as bigint) as gap_failures, coalesce(refused, 0) as refused, coalesce(shared, 0) = 0 and coalesce(refused, 0) = 0 as disjoint
    from {{patterns}} p left join {_SHARED} s on s.pattern_id = p.pattern_id left join (select pattern_id, count(*) as refused from {_REFUSED} group by 1) f on f.pattern_id = p.pattern_id)"""


@query("disjointness", f"select * from {_CLEAN}")
def _(spark, d):
    p, held, _, values = _tables(spark, d)
    refused = rep.heldout_reservations(held, _reservations(p, held), "test").where("outcome = 'refused'")
    return rep.disjointness(p, rep.window_lineage(values), rep.gap_failures(held, p), refused)


_NEED = "cast(case when {n} = 0 then 1 else greatest(1, ceil({n} * {t}), floor({n} / 2) + 1) end as bigint)"


@query("required_passes", "select o_orderkey % 23 as n, o_custkey % 11 / 10.0e0 as threshold, " + _NEED.replace("{n}", "(o_orderkey % 23)").replace("{t}", "(o_custkey % 11 / 10.0e0)") + " as required from {orders}")
def _(spark, d):
    n, t = F.col("o_orderkey") % 23, F.col("o_custkey") % 11 / F.lit(10.0)
    return view(spark, d, "orders").select(n.alias("n"), t.alias("threshold"), rep.required_passes(n, t).alias("required"))


_REPLICATED = f"""(select pattern_id, windows, passes, required, passes >= required as replicated from (select v.pattern_id, count(*) as windows, count_if(passed) as passes,
    {_NEED.replace("{n}", "count(*)").replace("{t}", "any_value(pass_threshold)")} as required from {_verdicts(_VALUES)} v join {{patterns}} p on p.pattern_id = v.pattern_id where window_id <> 'observation' group by 1))"""


@query("replication_verdict", f"select pattern_id, windows, cast(passes as bigint) as passes, required, replicated from {_REPLICATED}")
def _(spark, d):
    p, _, windows, values = _tables(spark, d)
    return rep.replication_verdict(rep.window_verdicts(values, windows, p), p)


_TAG = f"(select pattern_id, window_id, 'partition_' || cast((row_number() over (partition by pattern_id order by t0) % 3) as string) as partition_id from ({_HELD}))"
_PARTS = f"""(select pattern_id, partition_id, windows, cast(passes as bigint) as passes, required, passes >= required as passed from (select v.pattern_id, partition_id, count(*) as windows, count_if(passed) as passes,
    {_NEED.replace("{n}", "count(*)").replace("{t}", "any_value(partition_pass_threshold)")} as required from {_verdicts(_VALUES)} v join {_TAG} t on t.pattern_id = v.pattern_id and t.window_id = v.window_id join {{patterns}} p on p.pattern_id = v.pattern_id group by 1, 2))"""


def _tags(held):
    turn = F.row_number().over(Window.partitionBy("pattern_id").orderBy("t0")) % 3
    return held.select("pattern_id", "window_id", F.concat(F.lit("partition_"), turn.cast("string")).alias("partition_id"))


@query("partition_results", f"select * from {_PARTS}")
def _(spark, d):
    p, held, windows, values = _tables(spark, d)
    return rep.partition_results(rep.window_verdicts(values, windows, p), _tags(held), p)


_NUMBERED = f"(select *, row_number() over (partition by pattern_id, window_id order by t, value) - 1 as i, count(*) over (partition by pattern_id, window_id) as n from {_VALUES} where window_id <> 'observation')"


def _drawn(seed: str) -> str:
    return f"sha256('{seed}:' || pattern_id || ':' || window_id || ':' || cast(i as string))"


_SHUFFLED = f"""(select a.pattern_id, a.window_id, a.t, b.value from {_NUMBERED} a join (select *, row_number() over (partition by pattern_id, window_id order by {_drawn("time_shuffled")}) - 1 as j from {_NUMBERED}) b
    on a.pattern_id = b.pattern_id and a.window_id = b.window_id and a.i = b.j)"""
_RESAMPLED = f"(select a.pattern_id, a.window_id, a.t, b.value from {_NUMBERED} a join {_NUMBERED} b on a.pattern_id = b.pattern_id and a.window_id = b.window_id and b.i = cast('0x' || substr({_drawn('scope_randomized').replace('pattern_id', 'a.pattern_id').replace('window_id', 'a.window_id').replace('(i as', '(a.i as')}, 1, 8) as bigint) % a.n)"
_TIGHT = """(select pattern_id, spec_ref, kind, p, expected_sign, case when lo + s > hi - s then (lo + hi) / 2 else lo + s end as lo, case when lo + s > hi - s then (lo + hi) / 2 else hi - s end as hi,
    threshold + greatest(abs(threshold), 1) * band as threshold from (select *, greatest(hi - lo, abs(hi), abs(lo), 1) * band as s from {patterns}))"""


def _held_values(spark, d):
    p, held, _, values = _tables(spark, d)
    return p, held, values.where("window_id <> 'observation'")


@query("control_time_shuffled", f"select pattern_id, window_id, t, value from {_SHUFFLED}")
def _(spark, d):
    return rep.time_shuffled(_held_values(spark, d)[2])


@query("control_scope_randomized", f"select pattern_id, window_id, t, value from {_RESAMPLED}")
def _(spark, d):
    return rep.scope_resampled(_held_values(spark, d)[2])


@query("control_threshold", f"select pattern_id, lo, hi, threshold from {_TIGHT}")
def _(spark, d):
    return rep.tightened(view(spark, d, "patterns")).select("pattern_id", "lo", "hi", "threshold")


_HV = f"(select * from {_VALUES} where window_id <> 'observation')"
_HW = f"({_HELD})"
_CONTROLS = f"""(select pattern_id, window_id, 'time_shuffled' as control, not passed as passed from {_verdicts(_SHUFFLED, windows=_HW)}
    union all select pattern_id, window_id, 'scope_randomized', not passed from {_verdicts(_RESAMPLED, windows=_HW)}
    union all select a.pattern_id, a.window_id, 'threshold_perturbed', a.passed = b.passed from {_verdicts(_HV, windows=_HW)} a join {_verdicts(_HV, _TIGHT, _HW)} b on a.pattern_id = b.pattern_id and a.window_id = b.window_id)"""
_PERTURBED = f"""(select pattern_id, coalesce(bool_and(passed) filter (control = 'time_shuffled'), false) as time_shuffled, coalesce(bool_and(passed) filter (control = 'scope_randomized'), false) as scope_randomized,
    coalesce(bool_and(passed) filter (control = 'threshold_perturbed'), false) as threshold_perturbed from {_CONTROLS} group by 1)"""


@query("perturbation_verdict", f"select *, time_shuffled and scope_randomized and threshold_perturbed as perturbed from {_PERTURBED}")
def _(spark, d):
    p, held, values = _held_values(spark, d)
    return rep.perturbation_verdict(rep.control_results(values, held, p))


@query("heldout_reservations", f"""select h.pattern_id, h.window_id, h.t0, h.t1, case when f.window_id is null then 'available' else 'refused' end as outcome, f.window_id is null and h.window_id <> 'heldout_2' as created_now
    from ({_HELD}) h left join {_REFUSED} f on f.pattern_id = h.pattern_id and f.window_id = h.window_id""")
def _(spark, d):
    p = view(spark, d, "patterns")
    held = rep.select_heldout(rep.grid_windows(p), p)
    return rep.heldout_reservations(held, _reservations(p, held), "test")


@query("window_fingerprint", f"select pattern_id, window_id, cast(cast('0x' || substr(sha256(pattern_id || ':time_shuffled:' || window_id), 1, 16) as ubigint) as string) as seed from ({_HELD})")
def _(spark, d):
    return _heldout(spark, d).select("pattern_id", "window_id", rep.control_seed(F.col("pattern_id"), "time_shuffled", F.col("window_id")).alias("seed"))


_REPORT = f"""select r.pattern_id, r.windows, cast(r.passes as bigint) as passes, r.required, r.replicated, o.passed as observed, cast(g.partitions as bigint) as partitions, cast(g.partition_passes as bigint) as partition_passes, g.partitions_hold,
    c.time_shuffled, c.scope_randomized, c.threshold_perturbed, c.time_shuffled and c.scope_randomized and c.threshold_perturbed as perturbed, k.shared, k.gap_failures, k.refused, k.disjoint,
    cast(r.replicated as int) + cast(g.partitions_hold as int) + cast(c.time_shuffled and c.scope_randomized and c.threshold_perturbed as int) + cast(k.disjoint as int) as gates_passed,
    r.replicated and g.partitions_hold and c.time_shuffled and c.scope_randomized and c.threshold_perturbed and k.disjoint as verdict
    from {_REPLICATED} r join (select pattern_id, passed from {_verdicts(_VALUES)} where window_id = 'observation') o on o.pattern_id = r.pattern_id
    join (select pattern_id, count(*) as partitions, count_if(passed) as partition_passes, count_if(passed) * 2 > count(*) as partitions_hold from {_PARTS} group by 1) g on g.pattern_id = r.pattern_id
    join {_PERTURBED} c on c.pattern_id = r.pattern_id join {_CLEAN} k on k.pattern_id = r.pattern_id"""


@query("replication_report", _REPORT)
def _(spark, d):
    p = written(view(spark, d, "patterns"))  # derived from all events; a few rows
    held = written(rep.select_heldout(rep.grid_windows(p), p))
    return rep.replication_report(p, view(spark, d, "series"), _reservations(p, held), _tags(held))


# The whole report: in_range patterns read a set of entities, quantile_ge ones the latest value at points of time from some
# day on, sign ones list their windows; a protocol stands in the digest that chooses windows, and specs declare their deps.
_PROTOCOL = '\'{"kind":"\' || kind || \'","windows":7}\''
_ASKED = f"""select *, case kind when 'in_range' then 'entity_set' when 'quantile_ge' then 'time_range' else 'all' end as scope_kind, case kind when 'quantile_ge' then cast({START + 7 * DAY} as bigint) end as scope_t0, cast(null as bigint) as scope_t1,
    case kind when 'quantile_ge' then 'point' when 'in_range' then 'range' end as value_mode from {{patterns}}"""
_DEPS = "select distinct spec_ref, SHA(spec_ref || ':dep') as hash from {series}"
_FH = f"""select * from ({_HELD}) where pattern_id in (select pattern_id from {{patterns}} where kind <> 'sign')
    union all select pattern_id, 'w', cast({START + 5 * DAY} as bigint), cast({START + 6 * DAY} as bigint) from {{patterns}} where kind = 'sign' union all select pattern_id, 'heldout_1', {START + 8 * DAY}, {START + 9 * DAY} from {{patterns}} where kind = 'sign'""".replace("""'","window":""", """'","replication_protocol":' || protocol_json || ',"window":""")
_FV = f"""select w.pattern_id, w.window_id, s.t, s.value, s.source_hash from {{patterns}} p join {_WINDOWS} w on w.pattern_id = p.pattern_id join {{series}} s on s.spec_ref = p.spec_ref and s.t between w.t0 and w.t1 where p.kind = 'sign' or p.kind = 'in_range' and s.entity in ('1', '2', '3')
    union all select x.pattern_id, x.window_id, x.t, coalesce(s.value, cast('nan' as double)), null from (select * from (select w.pattern_id, w.window_id, p.spec_ref, unnest(generate_series(w.t0, w.t1, p.step_seconds)) as t from {_WINDOWS} w join {{patterns}} p on p.pattern_id = w.pattern_id and p.kind = 'quantile_ge') where t >= {START + 7 * DAY}) x
    asof left join (select spec_ref, t, max(value) as value from {{series}} where value is not null group by 1, 2) s on s.spec_ref = x.spec_ref and x.t >= s.t"""
_FL = f"""select distinct pattern_id, window_id, source_hash as hash from {_VALUES} where source_hash is not null
    union all select w.pattern_id, w.window_id, SHA(p.spec_ref || ':dep') from {_WINDOWS} w join {{patterns}} p on p.pattern_id = w.pattern_id where not exists (select 1 from {_VALUES} v where v.pattern_id = w.pattern_id and v.window_id = w.window_id and v.source_hash is not null)"""


def _named(text: str) -> str:
    """``text`` over the tables of the whole report instead of those of the plain one."""
    for old, new in ((_LINEAGE, "fl"), (_VALUES, "fv"), (_WINDOWS, "fw"), (f"({_HELD})", "fh"), (_HELD, "select * from fh"), ("{patterns}", "fp")):
        text = text.replace(old, new)
    return text


_FULL = f"""with fp as materialized (select *, {_PROTOCOL} as protocol_json from ({_ASKED})), fh as materialized ({_FH.replace("{patterns}", "fp")}), fw as materialized (select * from fh union all {_OBS.replace("{patterns}", "fp")}), fv as materialized ({_named(_FV)}), fl as materialized ({_named(_FL)}),
    ver as materialized (select * from {_named(_verdicts(_VALUES))}), ctl as materialized (select * from {_named(_CONTROLS)}), par as materialized (select * from {_named(_PARTS)}), rep as materialized ({_named(_REPORT)})
    select rep.*, (select string_agg(concat_ws(':', h.window_id, h.t0, h.t1, v.n, v.passed, t.partition_id), ',' order by h.t0, h.t1, h.window_id) from fh h join ver v on v.pattern_id = h.pattern_id and v.window_id = h.window_id join {_named(_TAG)} t on t.pattern_id = h.pattern_id and t.window_id = h.window_id where h.pattern_id = rep.pattern_id) as window_results,
    (select string_agg(concat_ws(':', partition_id, windows, passes, required, passed), ',' order by partition_id) from par where par.pattern_id = rep.pattern_id) as partition_results,
    (select string_agg(concat_ws(':', control, window_id, passed), ',' order by control, window_id) from ctl where ctl.pattern_id = rep.pattern_id) as perturbation_results,
    SHA('{{"pattern_id":"' || fp.pattern_id || '","replication_protocol":' || fp.protocol_json || '}}') as selection_seed, round((1 + rep.windows) * 1e-5 + 3 * rep.windows * 5e-6, 9) as compute_usd, 1 + rep.windows as window_evaluations, 3 * rep.windows as perturbation_evaluations
    from rep join fp on fp.pattern_id = rep.pattern_id"""


@query("full_report", _FULL)
def _(spark, d):
    sign = F.col("kind") == "sign"
    text = F.lit(f'[{{"window_id":"w","t0":{START + 5 * DAY},"t1":{START + 6 * DAY}}},{{"t0":{START + 8 * DAY},"t1":{START + 9 * DAY}}}]')
    asked = sql(spark, d, _ASKED).withColumns({"windows": F.when(sign, text), "window_count": F.when(~sign, F.col("window_count")), "scope_entities": F.array(F.lit("1"), F.lit("2"), F.lit("3")), "protocol_json": F.concat(F.lit('{"kind":"'), "kind", F.lit('","windows":7}'))})
    p = written(asked)
    held = written(rep.heldout_windows(p))
    report = rep.replication_report(p, view(spark, d, "series"), _reservations(p, held), _tags(held), deps=sql(spark, d, _DEPS), nested=True)
    text_of = lambda name, *parts: F.array_join(F.transform(name, lambda w: F.concat_ws(":", *[w[x].cast("string") for x in parts])), ",").alias(name)
    plain = [c for c in report.columns if c not in ("window_results", "partition_results", "perturbation_results", "compute_cost")]
    return report.select(*plain, text_of("window_results", "window_id", "t0", "t1", "n", "passed", "partition_id"), text_of("partition_results", "partition_id", "windows", "passes", "required", "passed"), text_of("perturbation_results", "control", "window_id", "passed"),
        F.round("compute_cost.compute_usd", 9).alias("compute_usd"), "compute_cost.window_evaluations", "compute_cost.perturbation_evaluations")
