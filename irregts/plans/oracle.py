"""ANSI SQL for every query that SQL can express, on the same parquet tables."""

from __future__ import annotations

_VIEWS = """
fx_events as (
  select user_id as hadm_id, user_id as stay_id, user_id as subject_id, ts as charttime,
         event_type as itemid, value
  from events),
fx_raw as (
  select hadm_id, stay_id, subject_id, strftime(charttime, '%Y-%m-%d %H:%M:%S') as charttime, itemid, value
  from fx_events where value >= 5),
fx_orders as (
  select o_orderkey as hadm_id, o_orderkey as stay_id, o_custkey as subject_id,
         strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') as charttime, l_returnflag as itemid,
         l_quantity, l_extendedprice
  from lineitem join orders on l_orderkey = o_orderkey),
fx_dates as (
  select o_custkey as hadm_id, o_orderkey as stay_id, o_custkey as subject_id, o_orderdate as charttime,
         l_returnflag as itemid, l_shipdate as value
  from lineitem join orders on l_orderkey = o_orderkey),
fx_admissions as (
  select c_custkey as hadm_id, timestamp '2024-01-01 00:00:00' + to_hours(c_custkey % 48) as admittime,
         c_mktsegment as admission_location
  from customer),
fx_patients as (
  select c_custkey as subject_id, case c_nationkey % 3 when 0 then 'M' when 1 then 'F' end as gender,
         cast(20 + 3 * c_nationkey as integer) as anchor_age
  from customer),
fx_catalogue as (
  select * from (values ('purchase', 0), ('click', 1), ('view', 2), ('error', 3), ('signup', 4)) t(label, position)),
fx_vitals_wide as (
  select l_suppkey, l_orderkey, date_sub('minute', timestamp '1995-01-01', l_shipdate) as time,
         l_quantity, l_extendedprice, nullif(l_discount, 0) as l_discount, nullif(l_tax, 0) as l_tax
  from lineitem),
fx_vitals_all as (
  select l_suppkey, l_orderkey, time, 'l_quantity' as variable, 0 as position, l_quantity as value from fx_vitals_wide
  union all
  select l_suppkey, l_orderkey, time, 'l_extendedprice', 1, l_extendedprice from fx_vitals_wide
  union all
  select l_suppkey, l_orderkey, time, 'l_discount', 2, l_discount from fx_vitals_wide
  union all
  select l_suppkey, l_orderkey, time, 'l_tax', 3, l_tax from fx_vitals_wide),
fx_vitals as (select * from fx_vitals_all where value is not null),
fx_labs as (
  select l_suppkey, l_orderkey, date_sub('minute', timestamp '1995-01-01', l_shipdate) as time,
         l_returnflag as variable, l_quantity * l_extendedprice * l_discount * l_tax as value
  from lineitem),
fx_offsets as (
  select l_suppkey, l_orderkey, time, variable, value from fx_vitals
  union all
  select l_suppkey, l_orderkey, time, variable, value from fx_labs),
fx_demog as (
  select s_suppkey as patientunitstayid,
         case s_nationkey % 3 when 0 then 'Male' when 1 then 'Female' else '' end as gender,
         case when s_nationkey > 20 then 95 when s_nationkey = 0 then 50 else cast(20 + 3 * s_nationkey as integer) end as age
  from supplier),
fx_measures as (
  select e.stay_id as ind, cast(c.position as bigint) as itemid,
         date_sub('minute', a.admittime, e.charttime) as time, e.value, p.gender, cast(p.anchor_age as double) as age
  from fx_events e
  join fx_admissions a on a.hadm_id = e.hadm_id
  join fx_patients p on p.subject_id = e.subject_id
  join fx_catalogue c on c.label = e.itemid),
fx_lines as (
  select l_orderkey as ind, cast(l_linenumber as bigint) as itemid,
         date_sub('minute', timestamp '1995-01-01', l_shipdate) as time, l_quantity as value
  from lineitem),
fx_predictions as (
  select l_orderkey * 8 + l_linenumber as ind, case when l_linestatus = 'O' then 'test' else 'train' end as "set",
         l_linenumber % 5 as fold, l_quantity / 10 as y_true,
         l_extendedprice / 20000 - case when l_linenumber % 5 = 0 then 0.5 else 0.0 end as y_pred
  from lineitem),
fx_classes as (
  select *, case when y_true < 1.35 then 0 when y_true < 2.68 then 1 when y_true < 4.16 then 2 else 3 end as t,
         case when y_pred < 1.35 then 0 when y_pred < 2.68 then 1 when y_pred < 4.16 then 2 else 3 end as p
  from fx_predictions)
"""


def _sql(body: str, extra: str = "") -> str:
    views = _VIEWS.strip() + (",\n" + extra.strip() if extra else "")
    return f"with {views}\n{body.strip()}"


def _stage(x: str) -> str:
    return f"case when {x} < 20 then 0 when {x} < 45 then 1 when {x} < 80 then 2 else 3 end"


def _profile(name: str, hours: int | None = None, target: int = 0, include: str = "true", exclude: str = "true") -> str:
    """Profile of each stay and its last target time."""
    return f"""
{name}_cap as (select * from fx_measures where {"true" if hours is None else f"time <= {hours} * 60"}),
{name} as (
  select ind, count(*) filter (where itemid = {target}) as n_tgt, min(time) as t_first,
         max(time) filter (where itemid = {target}) as t_last,
         (min({{'t': time, 'v': value}}) filter (where itemid = {target})).v as entry_value,
         (max({{'t': time, 'v': value}}) filter (where itemid = {target})).v as exit_value,
         count(*) filter (where itemid <> {target}) as n_non_skipped,
         {include} as ok_included, {exclude} as ok_excluded
  from {name}_cap group by ind)"""


def _kept(name: str, horizon: int = 0, history: int = 0, more: str = "true") -> str:
    return f"""coalesce(n_tgt > 0 and n_non_skipped > 0 and t_first < t_last - {horizon} * 60
      and t_last > {history} * 60 and ok_included and ok_excluded and {more}, false)"""


def _cohort(name: str, hours: int | None = None, target: int = 0, include: str = "true", exclude: str = "true", **rules) -> str:
    prof = f"{name}_prof"
    return (
        _profile(prof, hours, target, include, exclude)
        + f""",
{name} as (
  select m.* from {prof}_cap m join {prof} p on p.ind = m.ind
  where {_kept(prof, **rules)} and m.time <= p.t_last)"""
    )


_LISTED = dict(target=1, include="bool_or(itemid in (2, 3))", exclude="not bool_or(itemid = 5)")
_ENTRY, _EXIT = _stage("entry_value"), _stage("exit_value")
_STAGED = f"({_ENTRY}) in (1, 2, 3) and ({_EXIT}) in (0, 1, 2) and ({_ENTRY}) > ({_EXIT})"

_TARGETS = """
tgt as (
  select ind, max(time) as tgt_time, (max({'t': time, 'v': value})).v as tgt_value
  from fx_measures where itemid = 0 group by ind)"""


def _rows(where: str = "true") -> str:
    return _TARGETS + f""",
inp as (
  select m.*, t.tgt_time from fx_measures m join tgt t on t.ind = m.ind where m.time < t.tgt_time and {where})"""


_OUT = "select ind, itemid, time, value"
_SPARSE = (
    "m.itemid = 4 and m.time <= t.tgt_time - 650 * 60 and m.time <= "
    "case when 200 * 60 < t.tgt_time then 200 * 60 when 12 * 60 < t.tgt_time then 12 * 60 end"
)
_LATEST = "row_number() over (partition by ind order by time desc, itemid desc, value desc)"


def _folds(source: str, k: int = 5) -> str:
    return f"""
fold_of as (
  select ind, ntile({k}) over (order by md5(concat(ind, ':1')), ind) - 1 as fold
  from (select distinct ind from {source}))"""


def _holdout(source: str) -> str:
    return f"""
side as (
  select ind, case when row_number() over (order by md5(concat(ind, ':1')), ind) <= ceil(0.2 * count(*) over ())
                   then 'test' else 'train' end as split
  from (select distinct ind from {source}))"""


_FOLD_ROWS = _folds("fx_measures") + """,
fold_rows as (
  select m.*, r.fold as of_fold, case when r.fold = f.fold then 'test' else 'train' end as split
  from fx_measures m join fold_of f on f.ind = m.ind cross join (select unnest(range(5)) as fold) r)"""


def _normal(mode: str, by: str) -> str:
    """Normalised value, time and age with the statistics of the rows' own group."""

    def f(c: str, over: str) -> str:
        w = f"over (partition by {over})" if over else "over ()"
        if mode == "standard":
            mean, std = f"avg({c}) {w}", f"stddev_pop({c}) {w}"
            return f"case when {std} <> 0 then ({c} - {mean}) / {std} else {c} - {mean} end"
        low, high = f"min({c}) {w}", f"max({c}) {w}"
        return f"case when {low} <> {high} then ({c} - {low}) / ({high} - {low}) else {c} - {low} end"

    return f"""select ind, itemid, round({f('time', by)}, 6) as time,
       round({f('value', by + ', itemid')}, 6) as value, gender, round({f('age', by)}, 6) as age, {by}
from split_rows"""


_SPLIT_ROWS = _holdout("fx_measures") + """,
split_rows as (select m.*, s.split from fx_measures m join side s on s.ind = m.ind)"""

_NEAREST = """
ranked as (
  select {by} as variable, value, row_number() over (partition by {by} order by value) - 1 as rn,
         count(*) over (partition by {by}) as n
  from {source}),
quart as (
  select variable, max(value) filter (where rn = floor((n - 1) * 0.25 + 0.5)) as q1,
         max(value) filter (where rn = floor((n - 1) * 0.75 + 0.5)) as q3
  from ranked group by 1)"""

_SAMPLES = _rows() + """,
items as (
  select ind, row_number() over (partition by ind order by time, itemid, value) - 1 as pos, value as "values",
         cast(time as double) as times, itemid as variables
  from inp),
tokens as (
  select t.ind, (select count(*) from items i where i.ind = t.ind) as pos, 0.0::double as "values",
         cast(t.tgt_time as double) as times, 5::bigint as variables
  from tgt t),
samples as (select * from items union all select * from tokens)"""

_BATCHES = """,
batch_of as (
  select ind, (row_number() over (order by ind) - 1) // 10 as batch_id, (row_number() over (order by ind) - 1) % 10 as row_in_batch
  from tgt),
widths as (
  select batch_id, max(n) as width from (select ind, count(*) as n from samples group by ind) join batch_of using (ind)
  group by batch_id),
places as (select ind, batch_id, row_in_batch, unnest(range(width)) as pos from batch_of join widths using (batch_id))"""

_R2 = """case when count(*) < 2 then 'nan'::double
     when var_pop(y_true) > 0 then 1 - sum((y_true - y_pred) * (y_true - y_pred)) / (var_pop(y_true) * count(*))
     when sum((y_true - y_pred) * (y_true - y_pred)) = 0 then 1 else 0 end"""
_GAMMA_SQL = """
gamma_mean as (select {by}, avg(y_true) as m, min(y_true) as ty, min(y_pred) as tp from fx_predictions group by {by}),
gamma_dev as (
  select {by}, case when min(ty) <= 0 or min(tp) <= 0 then 0.0 else 1 -
    sum(2 * (ln(case when y_pred > 0 then y_pred else 1 end / y_true) + y_true / nullif(y_pred, 0) - 1)) /
    sum(2 * (ln(m / y_true) + y_true / m - 1)) end as d2
  from fx_predictions join gamma_mean using ({by}) group by {by})"""
_CLASS_SQL = """
cls as (
  select {by}, c, sum(case when t = c then n else 0 end) as support, sum(case when p = c then n else 0 end) as said,
         sum(case when t = c and p = c then n else 0 end) as tp
  from (select {by}, t, p, count(*) as n from fx_classes group by {by}, t, p), (select unnest(range(4)) as c)
  group by {by}, c),
cls_scores as (
  select {by}, sum(tp)::double / sum(support) as acc,
         sum(case when support + said > 0 then 2.0 * tp / (support + said) else 0 end * support)::double / sum(support) as f1
  from cls group by {by})"""
_SCORES_SQL = _GAMMA_SQL + "," + _CLASS_SQL + """,
wide as (
  select {by}, avg(abs(y_true - y_pred)) as mae, median(abs(y_true - y_pred)) as medae, """ + _R2 + """ as r2
  from fx_predictions group by {by}),
scores as (
  select {by}, metric, value from (
    unpivot (select {by}, mae, medae, r2, d2::double as d2, acc, f1
             from wide join gamma_dev using ({by}) join cls_scores using ({by}))
    on mae, medae, r2, d2, acc, f1 into name metric value value))"""
_GROUP = '"set", fold'


def _scores(text: str, by: str = _GROUP) -> str:
    return text.replace("{by}", by)


def _forecast_rows(name: str, source: str, items: tuple[int, ...] = (2, 4)) -> str:
    """Per stay of ``source`` the target observation and the latest values of some variables."""
    latest = ", ".join(f"(max({{'t': m.time, 'v': m.value}}) filter (where m.itemid = {i})).v as v{i}" for i in items)
    return f"""
{name}_tgt as (
  select ind, max(time) as tgt_time, (max({{'t': time, 'v': value}})).v as y_true, min(gender) as gender, min(age) as age
  from {source} where itemid = 0 group by ind),
{name}_seen as (
  select m.ind, {latest} from {source} m join {name}_tgt t on t.ind = m.ind
  where m.time < t.tgt_time and m.itemid <> 1 group by m.ind),
{name} as (select t.*, s.* exclude (ind) from {name}_tgt t left join {name}_seen s on s.ind = t.ind)"""


def _stats(by: str, items: tuple[int, ...] = (2, 4)) -> str:
    """Means and deviations that scale the features, as columns."""
    parts = [
        f"{f}(value) filter (where itemid = {i}) as {n}_{s}"
        for n, i in (("y", 0), *((f"v{i}", i) for i in items)) for f, s in (("avg", "m"), ("stddev_pop", "s"))
    ]
    parts += [f"{f}({c}) as {c}_{s}" for c in ("time", "age") for f, s in (("avg", "m"), ("stddev_pop", "s"))]
    return ", ".join([*([by] if by else []), *parts])


def _x(name: str, column: str | None = None) -> str:
    return f"case when {name}_s <> 0 then ({column or name} - {name}_m) / {name}_s else {column or name} - {name}_m end"


def _cv_features(side: str) -> str:
    return _sql(
        f"""
select f.ind, r.fold::integer as fold, case when r.fold = o.fold then 'test' else 'train' end as "set", y_true,
       round(coalesce({_x('v2')}, 0), 6) as x_v2, round(coalesce({_x('v4')}, 0), 6) as x_v4,
       case gender when 'M' then -1.0 when 'F' then 1.0 else 0.0 end::double as x_gender,
       round({_x('age', 'f.age')}, 6) as x_age, round({_x('time', 'tgt_time')}, 6) as x_time,
       round({_x('y', 'y_true')}, 6) as y
from feat f join fold_of o on o.ind = f.ind cross join (select unnest(range(5)) as fold) r
join side_stats s on s.of_fold = r.fold and s.split = {side}""",
        _FOLD_ROWS
        + f""",
side_stats as (select {_stats('of_fold, split')} from fold_rows group by of_fold, split),"""
        + _forecast_rows("feat", "fx_measures"),
    )


_FITTED = f"""
train_x as (
  select r.fold, coalesce({_x('v2')}, 0) as x, {_x('y', 'y_true')} as y
  from feat f join fold_of o on o.ind = f.ind cross join (select unnest(range(5)) as fold) r
  join side_stats s on s.of_fold = r.fold and s.split = 'train' where r.fold <> o.fold),
fitted as (select fold, regr_slope(y, x) as slope, regr_intercept(y, x) as icept from train_x group by fold)"""


_ITEMS = (0, 1, 2, 3, 4)
_ALL_X = [
    "1.0::double",
    *(f"coalesce({_x(f'v{i}')}, 0)" for i in _ITEMS),
    "case gender when 'M' then -1.0 when 'F' then 1.0 else 0.0 end::double",
    f"coalesce({_x('age', 'f.age')}, 0)",
    f"coalesce({_x('time', 'tgt_time')}, 0)",
]


def _reweighted(weights: list[tuple[str, str]], levels: str, reg: float) -> str:
    """Least squares of every fold and level, solved once per entry of ``weights``: the weight of
    a row and its weighted truth, given its residual r to the coefficients before. Ends in the
    table ``fitted`` of fold, q, beta."""
    p = len(_ALL_X)
    row = "[" + ", ".join(_ALL_X) + "]"
    tables = [f"""
side_stats as (select {_stats('of_fold, split', _ITEMS)} from fold_rows group by of_fold, split),""" + _forecast_rows("feat", "fx_measures", _ITEMS) + f""",
every_x as materialized (
  select f.ind, r.fold, o.fold as own, y_true, y_m, y_s, {row} as x, {_x('y', 'y_true')} as y
  from feat f join fold_of o on o.ind = f.ind cross join (select unnest(range(5)) as fold) r
  join side_stats s on s.of_fold = r.fold and s.split = 'train'),
levels as (select unnest({levels})::double as q),
train_x as materialized (select fold, q, x, y from every_x, levels where fold <> own),
beta_0 as (select distinct fold, q, list_transform(range({p}), lambda i: 0.0::double) as beta from train_x)"""]
    cells = ", ".join("[" + ", ".join([f"sum(w * x[{i}] * x[{j}])" for j in range(1, p + 1)] + [f"sum(x[{i}] * t)"]) + "]" for i in range(1, p + 1))
    for step, (weight, truth) in enumerate(weights, 1):
        tables.append(f"""
gram_{step} as (
  select fold, q, list_transform([{cells}], lambda row, i: list_transform(row, lambda v, c:
    v / count(*) + case when i = c and i > 1 then {reg} else 0 end)) as m
  from (select *, {truth} as t from (select *, {weight} as w from (
    select fold, q, x, y, y - list_dot_product(x, beta) as r from train_x join beta_{step - 1} using (fold, q))))
  group by fold, q)""")
        before = f"gram_{step}"
        for j in range(1, p + 1):
            tables.append(f"""
sweep_{step}_{j} as (
  select fold, q, list_transform(m, lambda row, i: case when i = {j} then list_transform(row, lambda v: v / m[{j}][{j}])
    else list_transform(row, lambda v, c: v - row[{j}] / m[{j}][{j}] * m[{j}][c]) end) as m from {before})""")
            before = f"sweep_{step}_{j}"
        tables.append(f"""
beta_{step} as materialized (select fold, q, list_transform(m, lambda row: row[{p + 1}]) as beta from {before})""")
    tables.append(f"""
fitted as (select * from beta_{len(weights)}),
outputs as (
  select ind, fold, y_true, q, list_dot_product(x, beta) * y_s + y_m as pred from every_x join fitted using (fold) where fold = own)""")
    return _FOLD_ROWS + "," + ",".join(tables)


_HUBER_FIT = _reweighted(
    [("1.0", "y"), *[("case when abs(r) <= 1 then 1.0 else 1 / abs(r) end", "w * y")] * 6], "[0.0]", 0.01
)
_QUANTILE_FIT = _reweighted(
    [("1.0", "y"), *((f"0.5 / (abs(r) + {0.5 ** step})", "w * y + q - 0.5") for step in range(1, 7))], "[0.1, 0.5, 0.9]", 0.01
)


def _scored(name: str, stats: str) -> str:
    """Forecasts of the other cohort with given statistics."""
    return f"""
{name} as (
  select y_true, (slope * coalesce({_x('v2')}, 0) + icept) * y_s + y_m as y_pred from b_feat, model, {stats})"""


ORACLE: dict[str, str] = {
    "src_measurements": _sql("select * replace (ascii(itemid)::bigint as itemid) from fx_raw"),
    "src_datetime_values": _sql("""
select hadm_id, stay_id, subject_id, strftime(charttime, '%Y-%m-%d %H:%M:%S') as charttime,
       ascii(itemid)::bigint as itemid, date_sub('minute', min(charttime) over (partition by hadm_id), value) as value
from fx_dates"""),
    "src_renamed_events": _sql(
        "select hadm_id, stay_id, subject_id, charttime, ascii(itemid)::bigint as itemid, l_quantity as value from fx_orders"
    ),
    "src_output_events": _sql("select * replace (ascii(itemid)::bigint as itemid) from fx_raw"),
    "src_procedure_events": _sql(
        "select hadm_id, stay_id, subject_id, charttime, ascii(itemid)::bigint as itemid, l_extendedprice as value from fx_orders"
    ),
    "src_lab_events": _sql("select subject_id, hadm_id, charttime, ascii(itemid)::bigint as itemid, value from fx_raw"),
    "src_admissions": _sql("""
select hadm_id, strftime(admittime, '%Y-%m-%d %H:%M:%S') as admittime, admission_location from fx_admissions"""),
    "src_patients": _sql("select subject_id, gender, anchor_age, anchor_age as age from fx_patients"),
    "src_lab_offsets": _sql("select l_suppkey as patientunitstayid, time, variable, value from fx_labs"),
    "unpivot_vitals": _sql("select l_suppkey as patientunitstayid, time, variable, value from fx_vitals"),
    "recode_age": _sql("select * from fx_demog"),
    "resolve_labels": _sql("""
select label, row_number() over (order by position) - 1 as key from fx_catalogue
where label in (select itemid from fx_events)
qualify label in ('signup', 'purchase')"""),
    "select_variables": _sql("""
select stay_id, itemid, value from fx_events where itemid in ('purchase', 'view', 'signup')"""),
    "range_filter": _sql("select * from fx_measures where value >= 10 and value <= 50.5"),
    "join_admissions": _sql("""
select e.hadm_id, stay_id, subject_id, strftime(charttime, '%Y-%m-%d %H:%M:%S') as charttime, itemid, value,
       strftime(admittime, '%Y-%m-%d %H:%M:%S') as admittime, admission_location
from fx_events e join fx_admissions a on a.hadm_id = e.hadm_id"""),
    "origin_filter": _sql("""
select stay_id, itemid, value, admission_location from fx_events e join fx_admissions a on a.hadm_id = e.hadm_id
where admission_location in ('BUILDING', 'MACHINERY')"""),
    "join_patients": _sql("""
select e.subject_id, hadm_id, stay_id, itemid, value, gender, anchor_age, anchor_age as age
from fx_events e join fx_patients p on p.subject_id = e.subject_id"""),
    "join_stay_demog": _sql("""
select patientunitstayid, time, variable, value, gender, age
from fx_labs join fx_demog on patientunitstayid = l_suppkey"""),
    "relative_time": _sql("""
select stay_id, itemid, date_sub('minute', admittime, charttime) as time, value
from fx_events e join fx_admissions a on a.hadm_id = e.hadm_id"""),
    "stage_values": _sql(f"""
select ind, value, {_stage('value')} as own_stage,
       case when value / 20 < 1.35 then 0 when value / 20 < 2.68 then 1 when value / 20 < 4.16 then 2 else 3 end as named_stage,
       cast(floor(value / 50) as integer) as custom_stage
from fx_measures"""),
    "union_sources": _sql("""
select * from fx_raw union all
select hadm_id, stay_id, subject_id, charttime, itemid, l_quantity from fx_orders"""),
    "union_relaxed": _sql("select l_suppkey as patientunitstayid, time, variable, value from fx_offsets"),
    "variable_quantiles": _sql(
        "select * from quart", _NEAREST.replace("{by}", "variable").replace("{source}", "fx_vitals")
    ),
    "remove_outliers": _sql(
        """
select l_suppkey as patientunitstayid, time, variable, value from fx_labs join quart using (variable)
where value between q1 - (q3 - q1) and q3 + (q3 - q1)""",
        _NEAREST.replace("{by}", "variable").replace("{source}", "fx_labs"),
    ),
    "top_variables": _sql("""
select variable, count(*) as n from fx_offsets group by 1 having count(*) >= 1000 order by n desc, variable limit 3"""),
    "variable_key": _sql("select variable as label, key from keyed", """
named as (select * from (values ('l_quantity', 0), ('l_extendedprice', 1), ('l_discount', 2), ('l_tax', 3),
                                ('A', 4), ('never', 5), ('N', 6), ('R', 7)) t(variable, position)),
keyed as (select variable, row_number() over (order by position) - 1 as key from named
          where variable in (select variable from fx_offsets))"""),
    "variable_index": _sql(
        """
select l_suppkey as patientunitstayid, time, variable, value, dense_rank() over (order by position) - 1 as itemid
from fx_offsets join named using (variable)""",
        """
named as (select * from (values ('l_quantity', 0), ('l_extendedprice', 1), ('l_discount', 2), ('l_tax', 3),
                                ('A', 4), ('never', 5), ('N', 6), ('R', 7)) t(variable, position))""",
    ),
    "first_seen_index": """
with first as (
  select user_id, row_number() over (order by min({'at': ts, 'id': event_id})) - 1 as ind from events group by user_id)
select event_id, user_id as stay_id, ind from events join first using (user_id)""",
    "stay_index": _sql("""
select l_orderkey as patientunitstayid, time, variable, value, dense_rank() over (order by l_orderkey) - 1 as ind
from fx_labs"""),
    "stay_ordinals": _sql("""
select ind, time, itemid, value, row_number() over (partition by ind order by time, itemid, value) - 1 as pos
from fx_measures"""),
    "decimate": _sql("""
select patientunitstayid, time, variable, value from (
  select l_suppkey as patientunitstayid, time, variable, value,
         row_number() over (order by position, l_suppkey, time, value) - 1 as i
  from fx_vitals) where i % 3 = 0"""),
    "min_duration_filter": _sql("""
select * from fx_measures
where ind in (select ind from fx_measures group by ind having max(time) - min(time) > 700 * 60)"""),
    "stay_count_filter": _sql("""
select * from fx_measures
where ind in (select ind from fx_measures group by ind having count(*) between 55 and 75)"""),
    "stay_count_filter_offsets": _sql("""
select l_orderkey as patientunitstayid, time, variable, value from fx_offsets
where l_orderkey in (select l_orderkey from fx_offsets group by 1 having count(*) > 9 and count(*) <= 20000)"""),
    "dataset_report": _sql("""
select count(*) as n_rows, count(distinct ind) as n_stays, count(distinct itemid) as n_variables from fx_measures"""),
    "stay_profile": _sql(
        f"select *, {_ENTRY} as entry_stage, {_EXIT} as exit_stage from prof where n_tgt > 0 union all "
        "select *, null, null from prof where n_tgt = 0",
        _profile("prof", **_LISTED).replace("fx_measures", "fx_lines"),
    ),
    "cull_stays": _sql(f"select ind, {_kept('prof', 12, 24)} as kept from prof", _profile("prof")),
    "cull_cohort": _sql("select * from coh", _cohort("coh", hours=168, horizon=12, history=24)),
    "cull_by_stage": _sql("select * from coh", _cohort("coh", more=_STAGED)),
    "cull_include_exclude": _sql("select * from coh", _cohort("coh", **_LISTED).replace("fx_measures", "fx_lines")),
    "cull_labels": _sql(f"select ind, {_EXIT} as label from prof where {_kept('prof')}", _profile("prof")),
    "usable_stays": _sql(
        f"select ind, {_EXIT} as label from prof where {_kept('prof')}",
        _NEAREST.replace("{by}", "itemid").replace("{source}", "fx_events")
        + """,
clean as (
  select e.stay_id as ind, c.position as itemid, date_sub('minute', a.admittime, e.charttime) as time, e.value
  from fx_events e join quart q on q.variable = e.itemid join fx_admissions a on a.hadm_id = e.hadm_id
  join fx_catalogue c on c.label = e.itemid
  where e.value between q1 - 3 * (q3 - q1) and q3 + 3 * (q3 - q1)),
sized as (select * from clean where ind in (select ind from clean group by ind having count(*) between 10 and 30000)),"""
        + _profile("prof").replace("fx_measures", "sized"),
    ),
    "preprocess_events": _sql(
        """
select itemid, value, time, dense_rank() over (order by stay_id) - 1 as ind, gender, age from (
  select s.*, p.gender, p.anchor_age as age from timed s join fx_patients p on p.subject_id = s.subject_id)
qualify stay_id in (select stay_id from timed group by stay_id
                    having count(*) between 50 and 90 and max(time) - min(time) > 600 * 60)""",
        _NEAREST.replace("{by}", "itemid").replace("{source}", "fx_events")
        + """,
timed as (
  select e.stay_id, e.subject_id, cast(c.position as bigint) as itemid,
         date_sub('minute', a.admittime, e.charttime) as time, e.value
  from fx_events e join quart q on q.variable = e.itemid join fx_admissions a on a.hadm_id = e.hadm_id
  join fx_catalogue c on c.label = e.itemid
  where e.value between q1 - 3 * (q3 - q1) and q3 + 3 * (q3 - q1))""",
    ),
    "preprocess_offsets": _sql(
        """
select itemid, value, time, ind, gender, age from (
  select *, dense_rank() over (order by stay) - 1 as ind, count(*) over (partition by stay) as n from both_sources)
join fx_demog on patientunitstayid = stay where n between 10 and 20000""",
        _NEAREST.replace("{by}", "variable").replace("{source}", "fx_labs")
        + """,
both_sources as (
  select stay, time, value, cast(position as bigint) as itemid from (
    select l_suppkey as stay, time, value, position,
           row_number() over (order by position, l_suppkey, time, value) - 1 as i
    from fx_vitals) where i % 3 = 0
  union all
  select l_suppkey, time, value, case variable when 'A' then 4 when 'N' then 5 else 6 end
  from fx_labs join quart using (variable) where value between q1 - (q3 - q1) and q3 + (q3 - q1))""",
    ),
    "split_kfold": _sql(
        """
select ind, r.fold::integer as fold, case when r.fold = f.fold then 'test' else 'train' end as split
from fold_of f cross join (select unnest(range(5)) as fold) r""",
        _folds("(select c_custkey as ind from customer)"),
    ),
    "split_holdout": _sql(
        "select ind, 0 as fold, split from side", _holdout("(select c_custkey as ind from customer)")
    ),
    "split_stratified": _sql(
        "select l.ind, 0 as fold, label, case when rn <= quota then 'test' else 'train' end as split from ranks l join quotas using (label)",
        _profile("prof")
        + f""",
labels as (
  select ind, case when exit_value < 20 then 0 when exit_value < 45 then 1 else 2 end as label
  from prof where {_kept('prof')}),
sizes as (select label, count(*) as c, sum(count(*)) over () as n from labels group by label),
parts as (select label, c, n, cast(ceil(0.2 * n) as bigint) as n_test from sizes),
quotas as (
  select label, n_test * c // n + case when row_number() over (order by n_test * c % n desc, label)
                                            <= n_test - sum(n_test * c // n) over () then 1 else 0 end as quota
  from parts),
ranks as (select ind, label, row_number() over (partition by label order by md5(concat(ind, ':1')), ind) as rn from labels)""",
    ),
    "restrict_to_split": _sql(
        "select * from fx_measures where ind in (select ind from side where split = 'test')", _holdout("fx_measures")
    ),
    "stay_intersection": _sql(
        "select ind from a intersect select ind from b",
        _cohort("a", more=_STAGED) + "," + _cohort("b", target=3, history=48),
    ),
    "decoupled_eval": _sql(
        f"""
select 0 as fold, 'test' as "set", fit_on, metric, round(value, 6) as value from (
  select fit_on, metric, value from (
    select 'train' as fit_on, avg(abs(y_true - y_pred)) as mae, {_R2} as r2 from by_train union all
    select 'own', avg(abs(y_true - y_pred)), {_R2} from by_own)
  unpivot (value for metric in (mae, r2)))""",
        _cohort("a")
        + ","
        + _cohort("b", target=3, history=48)
        + ","
        + _holdout("a")
        + ","
        + _forecast_rows("a_feat", "a")
        + f""",
a_train as (select a.* from a join side on side.ind = a.ind where split = 'train'),
a_stats as (select {_stats('')} from a_train),
model as (
  select regr_slope(y, x) as slope, regr_intercept(y, x) as icept from (
    select coalesce({_x('v2')}, 0) as x, {_x('y', 'y_true')} as y from a_feat, a_stats
    where ind in (select ind from side where split = 'train'))),
b_test as (select * from b where ind in (select ind from side where split = 'test')),
b_stats as (select {_stats('')} from b_test),"""
        + _forecast_rows("b_feat", "b_test")
        + ","
        + _scored("by_train", "a_stats")
        + ","
        + _scored("by_own", "b_stats"),
    ),
    "cv_features": _cv_features("'train'"),
    "cv_features_own": _cv_features("case when r.fold = o.fold then 'test' else 'train' end"),
    "cv_fit_predict": _sql(
        f"""
select f.ind, o.fold::integer as fold, 'test' as "set", y_true,
       round((slope * coalesce({_x('v2')}, 0) + icept) * y_s + y_m, 6) as y_pred
from feat f join fold_of o on o.ind = f.ind join fitted on fitted.fold = o.fold
join side_stats s on s.of_fold = o.fold and s.split = 'train'""",
        _FOLD_ROWS
        + f""",
side_stats as (select {_stats('of_fold, split')} from fold_rows group by of_fold, split),"""
        + _forecast_rows("feat", "fx_measures")
        + ","
        + _FITTED,
    ),
    "cv_fit_huber": _sql(
        """
select ind, fold::integer as fold, 'test' as "set", y_true, round(pred, 5) as y_pred from outputs""",
        _HUBER_FIT,
    ),
    "cv_fit_quantiles": _sql(
        """
select ind, fold::integer as fold, 'test' as "set", y_true, round(max(pred) filter (where q = 0.1), 5) as low,
       round(max(pred) filter (where q = 0.5), 5) as y_pred, round(max(pred) filter (where q = 0.9), 5) as high
from outputs group by ind, fold, y_true""",
        _QUANTILE_FIT,
    ),
    "cv_quantile_loss": _sql(
        """
select 'test' as "set", fold::integer as fold, q, round(avg(loss), 5) as mean_loss, round(sum(loss), 3) as sum_loss
from (select fold, q, q * greatest(y_true - pred, 0) + (1 - q) * greatest(pred - y_true, 0) as loss from outputs)
group by fold, q""",
        _QUANTILE_FIT,
    ),
    "norm_stats_standard": _sql(
        """
select of_fold::integer as fold, split, itemid, round(avg(value), 9) as value_mean,
       round(stddev_pop(value), 9) as value_std
from fold_rows group by 1, 2, 3""",
        _FOLD_ROWS,
    ),
    "norm_stats_minmax": _sql(
        """
select of_fold::integer as fold, split, itemid, min(value) as value_min, max(value) as value_max
from fold_rows group by 1, 2, 3""",
        _FOLD_ROWS,
    ),
    "norm_stats_global": _sql(
        """
select of_fold::integer as fold, split, round(avg(age), 5) as age_mean, round(stddev_pop(age), 5) as age_std,
       round(avg(time), 5) as time_mean, round(stddev_pop(time), 5) as time_std
from fold_rows group by 1, 2""",
        _FOLD_ROWS,
    ),
    "normalize_standard": _sql(_normal("standard", "split"), _SPLIT_ROWS),
    "normalize_minmax": _sql(_normal("minmax", "split"), _SPLIT_ROWS),
    "normalize_apply": _sql(
        """
select m.ind, m.itemid, round((time - tm) / ts, 6) as time, round((value - vm) / vs, 6) as value, gender,
       round((age - am) / "as", 6) as age
from fx_measures m
join (select itemid, avg(value) as vm, stddev_pop(value) as vs from split_rows where split = 'train' group by 1) v
  on v.itemid = m.itemid
cross join (select avg(time) as tm, stddev_pop(time) as ts, avg(age) as am, stddev_pop(age) as "as"
            from split_rows where split = 'train') g""",
        _SPLIT_ROWS,
    ),
    "normalize_time_only": _sql("""
select ind, itemid, round((time - avg(time) over ()) / stddev_pop(time) over (), 6) as time, value, gender, age
from fx_measures"""),
    "denormalize_predictions": _sql(
        f"""
select p.ind, f.fold::integer as fold, 'test' as split, round(exit_value / 100 * s + m, 6) as y_true,
       round(entry_value / 100 * s + m, 6) as y_pred
from prof p join fold_of f on f.ind = p.ind
join (select of_fold, avg(value) as m, stddev_pop(value) as s from fold_rows
      where split = 'test' and itemid = 0 group by 1) t on t.of_fold = f.fold
where {_kept('prof')}""",
        _FOLD_ROWS + "," + _profile("prof"),
    ),
    "target_obs": _sql("select ind, tgt_time, tgt_value from tgt", _TARGETS),
    "input_rows": _sql(f"{_OUT} from inp", _rows()),
    "masked_inputs": _sql(f"{_OUT} from inp", _rows("m.itemid not in (0, 3)")),
    "window_lookback": _sql(
        f"""
{_OUT} from (select *, max(time) over (partition by ind) as newest from inp)
where time >= tgt_time - 300 * greatest(1, ceil((tgt_time - newest) / 300.0))""",
        _rows("m.itemid <> 0"),
    ),
    "window_horizon": _sql(f"{_OUT} from inp", _rows("m.time <= t.tgt_time - 48 * 60")),
    "window_history": _sql(
        f"{_OUT} from inp where time <= (select max(h) * 60 from (select unnest([24, 96, 500, 690, 720]) as h) where h * 60 < tgt_time)",
        _rows(),
    ),
    "window_last_n": _sql(f"{_OUT} from (select *, {_LATEST} as back from inp) where back <= 15", _rows()),
    "forecast_inputs": _sql(
        f"""
{_OUT} from (
  select *, {_LATEST} as back from inp
  where time <= (select max(h) * 60 from (select unnest([48, 300, 600]) as h) where h * 60 < tgt_time))
where back <= 20""",
        _rows("m.itemid <> 1 and m.time <= t.tgt_time - 24 * 60"),
    ),
    "empty_inputs": _sql("select ind from tgt except select ind from inp", _rows(_SPARSE)),
    "demog_vector": _sql("""
select ind, pos::integer as pos, case pos when 0 then g else age end as x from (
  select ind, max(case gender when 'M' then -1.0 when 'F' then 1.0 else 0.0 end)::double as g, max(age) as age
  from fx_measures group by ind) cross join (select unnest(range(2)) as pos)"""),
    "forecast_task": _sql(
        f"{_OUT}, 0::bigint as target, 5::bigint as token from inp",
        _rows("m.itemid <> 1 and m.time <= t.tgt_time - 24 * 60"),
    ),
    "sequence_tokens": _sql(
        """
select ind, row_number() over (partition by ind order by time, itemid, value) - 1 as pos, value,
       cast(time as double) as time, itemid as variable
from inp
union all
select t.ind, (select count(*) from inp i where i.ind = t.ind), 0.0, cast(t.tgt_time as double), 5 from tgt t""",
        _rows(),
    ),
    "sequences": _sql(
        """
select s.ind, tgt_value, cast(tgt_time as double) as tgt_time, cast(pos as integer) as pos, "values", times, variables
from samples s join tgt t on t.ind = s.ind""",
        _SAMPLES,
    ),
    "batch_assignment": _sql("""
select ind, i // 64 as batch_id, i % 64 as row_in_batch from (
  select c_custkey as ind, row_number() over (order by md5(concat(c_custkey, ':7:2')), c_custkey) - 1 as i,
         count(*) over () as n
  from customer) where i // 64 < n // 64"""),
    "padded_batches": _sql(
        """
select p.ind, p.batch_id, p.row_in_batch, cast(p.pos as integer) as pos, coalesce(s."values", -10000.0) as "values",
       coalesce(s.times, -10000.0) as times, coalesce(s.variables, 0) as variables,
       case when s.ind is null then 0 else 1 end as mask
from places p left join samples s on s.ind = p.ind and s.pos = p.pos""",
        _SAMPLES + _BATCHES,
    ),
    "long_batches": _sql(
        """
select p.ind, p.batch_id, p.row_in_batch, p.pos, coalesce(s."values", -10000.0) as value,
       coalesce(s.times, -10000.0) as time, coalesce(s.variables, 0) as variable,
       case when s.ind is null then 0 else 1 end as mask
from places p left join samples s on s.ind = p.ind and s.pos = p.pos""",
        _SAMPLES + _BATCHES,
    ),
    "metric_mae": _sql(f"select {_GROUP}, round(avg(abs(y_true - y_pred)), 10) as mae from fx_predictions group by {_GROUP}"),
    "metric_medae": _sql(
        f"select {_GROUP}, round(median(abs(y_true - y_pred)), 9) as medae from fx_predictions group by {_GROUP}"
    ),
    "metric_r2": _sql(f"select {_GROUP}, round({_R2}, 8) as r2 from fx_predictions group by {_GROUP}"),
    "metric_d2_gamma": _sql(f"select {_GROUP}, round(d2, 8) as d2 from gamma_dev", _scores(_GAMMA_SQL)),
    "metric_accuracy": _sql(
        f"select {_GROUP}, round(avg(case when t = p then 1.0 else 0.0 end), 8) as acc from fx_classes group by {_GROUP}"
    ),
    "metric_f1_weighted": _sql(f"select {_GROUP}, round(f1, 8) as f1 from cls_scores", _scores(_CLASS_SQL)),
    "confusion_matrix": _sql(f"""
select {_GROUP}, t as target_class, p as prediction_class, round(coalesce(n, 0)::double / total, 9) as share
from (select {_GROUP}, count(*) as total from fx_classes group by {_GROUP})
join (select distinct {_GROUP}, c as t from (select {_GROUP}, t as c from fx_classes union all select {_GROUP}, p from fx_classes)) using ({_GROUP})
join (select distinct {_GROUP}, c as p from (select {_GROUP}, t as c from fx_classes union all select {_GROUP}, p from fx_classes)) using ({_GROUP})
left join (select {_GROUP}, t, p, count(*) as n from fx_classes group by {_GROUP}, t, p) using ({_GROUP}, t, p)"""),
    "metrics_by_fold": _sql(
        """
select "set", metric, round(max(value) filter (where fold = 0), 10) as fold_0,
       round(max(value) filter (where fold = 1), 10) as fold_1, round(max(value) filter (where fold = 2), 10) as fold_2,
       round(max(value) filter (where fold = 3), 10) as fold_3, round(max(value) filter (where fold = 4), 10) as fold_4,
       round(avg(value), 10) as mean, round(stddev_pop(value), 10) as std,
       round(sqrt(var_pop(value) * 5 / 6), 10) as std_with_mean
from scores group by 1, 2""",
        _scores(_SCORES_SQL),
    ),
    "metrics_by_set": _sql('select "set", metric, round(value, 8) as value from scores', _scores(_SCORES_SQL, '"set"')),
    "point_from_quantiles": _sql("""
select ind, "set", round(y_pred, 8) as y_pred from fx_predictions
union all select ind, 'single', round(y_pred * 0.8, 8) from fx_predictions"""),
    "prediction_sheet": _sql(f"""
select {_GROUP}, ind as stay_id, round(y_true, 8) as target, round(y_pred, 8) as prediction, t as target_class,
       p as prediction_class
from fx_classes"""),
    "loss_huber": _sql(f"""
select {_GROUP}, round(avg(case when abs(e) <= 0.8 then 0.5 * e * e else 0.8 * (abs(e) - 0.4) end), 10) as huber
from (select *, y_true - y_pred as e from fx_predictions) group by {_GROUP}"""),
    "loss_pinball": _sql(f"""
select {_GROUP}, q::double as q, round(avg(l), 10) as mean_loss, round(sum(l), 5) as sum_loss from (
  select {_GROUP}, q, q * greatest(y_true - y_pred * f, 0) + (1 - q) * greatest(y_pred * f - y_true, 0) as l
  from fx_predictions cross join (values (0.1::double, 0.8::double), (0.5, 1.0), (0.9, 1.2)) t(q, f))
group by {_GROUP}, q"""),
    "score_batches": _sql(
        """
select s.ind, max(t.tgt_value) as y_true, round(sum("values") / count(*), 10) as mean_pred, min("values") as low_pred,
       max("values") as high_pred
from samples s join tgt t on t.ind = s.ind group by s.ind""",
        _SAMPLES,
    ),
    "sink_roundtrip": _sql(
        f"""
select c.ind, itemid, value, cast(time as double) as time, gender, age, {_EXIT} as label
from coh c join coh_prof p on p.ind = c.ind""",
        _cohort("coh", horizon=12, history=24),
    ),
    "stay_lookup": _sql("select itemid, value, time, ind, gender, age from fx_measures where ind in (2, 7, 11)"),
}
