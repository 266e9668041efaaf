"""DuckDB SQL twins of the registered queries (the correctness oracle).

Each string runs on the driver's parquet tables registered as views. The case
CTEs restate FIXTURES.md §2; every computed column carries the Spark name.
"""

from __future__ import annotations

from episcope import schema as _S

ORACLE: dict[str, str] = {}

RAW_CASES = """
raw as (
  select
    case when l_orderkey % 97 = 0 then 'invalid'
         when l_orderkey % 89 = 0 then null
         when strftime(l_shipdate, '%Y-%m') = '2000-07' then null
         else strftime(l_shipdate, '%Y-%m-%d') end                     as DT_NOTIFIC,
    strftime(o_orderdate, '%Y-%m-%d')                                  as DT_SIN_PRI,
    n_name                                                             as SG_UF,
    cast(o_custkey as varchar)                                         as CO_MUN_RES,
    cast(cast(l_linenumber % 2 + 1 as int) as varchar)                 as CS_SEXO,
    cast(cast(l_quantity as int) as varchar)                           as NU_IDADE_N,
    cast(case when l_suppkey % 11 = 0 then null
              else cast(l_partkey % 6 as int) end as varchar)          as TP_IDADE,
    cast(case when l_returnflag = 'R' then 2 when l_returnflag = 'A' then 1
              when l_suppkey % 2 = 0 then 3 else null end as varchar)  as EVOLUCAO,
    cast(case when l_linestatus = 'O' and l_partkey % 3 = 0 then 1
              when l_suppkey % 7 = 0 then null else 2 end as varchar)  as UTI,
    cast(case o_orderpriority when '1-URGENT' then 1 when '2-HIGH' then 2
              else null end as varchar)                                as VACINA,
    cast(case when c_mktsegment in ('BUILDING', 'MACHINERY') then 1
              when c_mktsegment = 'HOUSEHOLD' then 9 else 2 end as varchar) as VACINA_COV,
    cast(case when l_discount >= 0.05 then 1 else 2 end as varchar)    as HOSPITAL
  from lineitem
  join orders on l_orderkey = o_orderkey
  join customer on o_custkey = c_custkey
  join nation on c_nationkey = n_nationkey
)"""

TYPED_CASES = """
typed as (
  select
    cast(try_strptime(DT_NOTIFIC, '%Y-%m-%d') as date) as dt_notific,
    cast(try_strptime(DT_SIN_PRI, '%Y-%m-%d') as date) as dt_sin_pri,
    SG_UF as sg_uf,
    CO_MUN_RES as co_mun_res,
    try_cast(CS_SEXO as integer) as cs_sexo,
    case try_cast(TP_IDADE as integer)
         when 4 then try_cast(NU_IDADE_N as double)
         when 3 then try_cast(NU_IDADE_N as double) / 12
         when 2 then try_cast(NU_IDADE_N as double) / 365
         when 1 then try_cast(NU_IDADE_N as double) / 8760 end as idade_anos,
    try_cast(EVOLUCAO as integer) as evolucao,
    cast(try_cast(EVOLUCAO as integer) is not distinct from 2 as integer) as obito,
    try_cast(UTI as integer) as uti,
    cast(try_cast(UTI as integer) is not distinct from 1 as integer) as internou_uti,
    cast(null as date) as dt_entuti,
    cast(null as date) as dt_saiduti,
    try_cast(VACINA as integer) as vacina,
    try_cast(VACINA_COV as integer) as vacina_cov,
    cast((try_cast(VACINA as integer) is not distinct from 1)
         or (try_cast(VACINA_COV as integer) is not distinct from 1) as integer) as vacinado,
    cast(null as date) as dt_evoluca,
    cast(null as date) as dt_interna,
    cast(try_cast(HOSPITAL as integer) is not distinct from 1 as integer) as hospitalizado,
    cast(null as integer) as febre,
    cast(null as integer) as tosse,
    cast(null as integer) as dispneia,
    cast(null as integer) as saturacao
  from raw
),
cases as (
  select * from typed
  where dt_notific is not null
    and dt_notific >= date '2000-01-01' and dt_notific < date '2001-01-01'
)"""

CASES_CTE = "with " + RAW_CASES + "," + TYPED_CASES


def _fact(keys: str = "") -> str:
    k = f", {keys}" if keys else ""
    return f""",
fact as (
  select dt_notific as day{k}, count(*) as cases,
         cast(sum(obito) as bigint) as deaths, cast(sum(internou_uti) as bigint) as icu,
         cast(sum(vacinado) as bigint) as vaccinated
  from cases group by dt_notific{k}
),
anchor as (select max(day) as a from fact)"""


def _metric_sums(period: int) -> str:
    return f"""
    cast(sum(cases) as bigint) as _total,
    cast(sum(deaths) as bigint) as _deaths,
    cast(sum(icu) as bigint) as _icu,
    cast(sum(vaccinated) as bigint) as _vacc,
    cast(sum(case when day >= (select a from anchor) - interval {period} day
                  then cases else 0 end) as bigint) as _cur,
    cast(sum(case when day >= (select a from anchor) - interval {2 * period} day
                   and day < (select a from anchor) - interval {period} day
                  then cases else 0 end) as bigint) as _prev"""


def _metric_finish(keys: str = "") -> str:
    k = f"{keys}, " if keys else ""
    return f"""
  select {k}
    case when _prev > 0 then cast(_cur - _prev as double) / _prev * 100 else 0.0 end as taxa_aumento_casos,
    coalesce(cast(coalesce(_deaths, 0) as double) / nullif(_total, 0) * 100, 0.0) as taxa_mortalidade,
    coalesce(cast(coalesce(_icu, 0) as double) / nullif(_total, 0) * 100, 0.0) as taxa_ocupacao_uti,
    coalesce(cast(coalesce(_vacc, 0) as double) / nullif(_total, 0) * 100, 0.0) as taxa_vacinacao,
    cast(coalesce(_total, 0) as bigint) as total_casos"""


def metrics_by_uf_cte(period: int = 30) -> str:
    """CTE chain ending in ``m(sg_uf, taxa_*, total_casos)``."""
    return CASES_CTE + _fact("sg_uf") + f""",
sums as (select sg_uf, {_metric_sums(period)} from fact group by sg_uf),
m as ({_metric_finish("sg_uf")} from sums)"""


ORACLE["clean_cases"] = CASES_CTE + """
select dt_notific::varchar as dt_notific, dt_sin_pri::varchar as dt_sin_pri, sg_uf, co_mun_res,
       cs_sexo::varchar as cs_sexo, idade_anos, evolucao::varchar as evolucao, obito,
       uti::varchar as uti, internou_uti,
       dt_entuti::varchar as dt_entuti, dt_saiduti::varchar as dt_saiduti,
       vacina::varchar as vacina, vacina_cov::varchar as vacina_cov,
       vacinado, dt_evoluca::varchar as dt_evoluca, dt_interna::varchar as dt_interna,
       hospitalizado, febre::varchar as febre, tosse::varchar as tosse,
       dispneia::varchar as dispneia, saturacao::varchar as saturacao
from cases"""

ORACLE["total_cases"] = CASES_CTE + _fact() + """
select cast(coalesce(sum(cases), 0) as bigint) as total_casos from fact"""

ORACLE["mortality_rate"] = CASES_CTE + _fact() + """
select coalesce(cast(coalesce(sum(deaths), 0) as double) / nullif(sum(cases), 0) * 100, 0.0)
       as taxa_mortalidade from fact"""

ORACLE["icu_rate"] = CASES_CTE + _fact() + """
select coalesce(cast(coalesce(sum(icu), 0) as double) / nullif(sum(cases), 0) * 100, 0.0)
       as taxa_ocupacao_uti from fact"""

ORACLE["vaccination_rate"] = CASES_CTE + _fact() + """
select coalesce(cast(coalesce(sum(vaccinated), 0) as double) / nullif(sum(cases), 0) * 100, 0.0)
       as taxa_vacinacao from fact"""

for _name, _p in (("growth_rate", 30), ("growth_rate_7d", 7)):
    ORACLE[_name] = CASES_CTE + _fact() + f""",
sums as (select {_metric_sums(_p)} from fact)
select case when _prev > 0 then cast(_cur - _prev as double) / _prev * 100 else 0.0 end
       as taxa_aumento_casos from sums"""

ORACLE["all_metrics"] = CASES_CTE + _fact() + f""",
sums as (select {_metric_sums(30)} from fact)
{_metric_finish()} from sums"""

ORACLE["describe_cases"] = CASES_CTE + """
select cast(count(*) as bigint) as total_casos,
       cast(coalesce(sum(obito), 0) as bigint) as total_obitos,
       cast(coalesce(sum(internou_uti), 0) as bigint) as total_uti,
       cast(coalesce(sum(vacinado), 0) as bigint) as total_vacinados,
       coalesce(cast(coalesce(sum(obito), 0) as double) / nullif(count(*), 0) * 100, 0.0) as taxa_mortalidade,
       coalesce(cast(coalesce(sum(internou_uti), 0) as double) / nullif(count(*), 0) * 100, 0.0) as taxa_uti,
       coalesce(cast(coalesce(sum(vacinado), 0) as double) / nullif(count(*), 0) * 100, 0.0) as taxa_vacinacao,
       round(avg(idade_anos), 6) as idade_media,
       round(median(idade_anos), 6) as idade_mediana,
       strftime(min(dt_notific), '%Y-%m-%d') as data_inicio,
       strftime(max(dt_notific), '%Y-%m-%d') as data_fim
from cases"""

ORACLE["metrics_by_uf"] = metrics_by_uf_cte() + "\nselect * from m"

ORACLE["metrics_rollup"] = CASES_CTE + _fact("sg_uf") + f""",
sums as (select sg_uf, grouping(sg_uf) = 1 as is_total, {_metric_sums(30)} from fact group by rollup (sg_uf))
{_metric_finish("sg_uf, is_total")} from sums"""

ORACLE["metrics_rollup_unknown_region"] = ORACLE["metrics_rollup"].replace(
    "fact as (\n  select dt_notific as day, sg_uf,", "fact as (\n  select dt_notific as day, nullif(sg_uf, 'CANADA') as sg_uf,").replace(
    "from cases group by dt_notific, sg_uf", "from cases group by dt_notific, nullif(sg_uf, 'CANADA')")

# Cases of all years, and the same after the year 2000 was reloaded without men.
_ALL_YEARS = CASES_CTE.replace("""
    and dt_notific >= date '2000-01-01' and dt_notific < date '2001-01-01'""", "")
_RELOADED = CASES_CTE.replace("""
    and dt_notific >= date '2000-01-01' and dt_notific < date '2001-01-01'""", """
    and (year(dt_notific) <> 2000 or cs_sexo = 1)""")
_PER_YEAR = """
select cast(year(dt_notific) as integer) as year, sg_uf, cast(count(*) as bigint) as cases, cast(sum(obito) as bigint) as deaths
from cases group by year(dt_notific), sg_uf"""
ORACLE["curated_append"] = _ALL_YEARS + _PER_YEAR
ORACLE["curated_partial_reload"] = _RELOADED + _PER_YEAR.replace("from cases", "from cases where year(dt_notific) <> 1997")
ORACLE["maintained_fact_metrics"] = _RELOADED + _fact("sg_uf") + f""",
sums as (select sg_uf, {_metric_sums(30)} from fact group by sg_uf)
{_metric_finish("sg_uf")} from sums"""
ORACLE["describe_by_uf"] = CASES_CTE + ORACLE["describe_cases"].removeprefix(CASES_CTE).replace(
    "select cast(count(*)", "select sg_uf, true as sketch_in_error, true as same_mean, cast(count(*)").replace(
    "from cases", "from cases where cs_sexo = 1 group by sg_uf")
ORACLE["processed_roundtrip"] = ORACLE["clean_cases"]
ORACLE["sample_rows"] = "with " + RAW_CASES + "\nselect " + ", ".join(
    c if c in RAW_CASES else f"cast(null as varchar) as {c}" for c in _S.RAW_COLUMNS) + "\nfrom raw order by " + ", ".join(
    f"{c} nulls first" for c in _S.RAW_COLUMNS if c in RAW_CASES) + " limit 100"

ORACLE["daily_cases"] = CASES_CTE + _fact() + """
select strftime(day, '%Y-%m-%d') as date, cast(sum(cases) as bigint) as cases
from fact where day >= (select a from anchor) - interval 30 day
group by day order by day"""

ORACLE["daily_cases_by_uf"] = CASES_CTE + _fact("sg_uf") + """
select sg_uf, strftime(day, '%Y-%m-%d') as date, cast(sum(cases) as bigint) as cases
from fact where day >= (select a from anchor) - interval 30 day
group by sg_uf, day order by sg_uf, day"""

ORACLE["monthly_cases"] = CASES_CTE + _fact() + """
select * from (
  select strftime(day, '%Y-%m') as month, cast(sum(cases) as bigint) as cases
  from fact group by 1 order by 1 desc limit 6
) order by month"""

ORACLE["monthly_cases_calendar"] = CASES_CTE + _fact() + """
select strftime(day, '%Y-%m') as month, cast(sum(cases) as bigint) as cases
from fact
where date_trunc('month', day) > date_trunc('month', (select a from anchor)) - interval 6 month
group by 1 order by 1"""

ORACLE["chart_series_by_uf"] = CASES_CTE + _fact("sg_uf") + """,
d as (
  select sg_uf, day, cast(sum(cases) as bigint) as cases from fact
  where day >= (select a from anchor) - interval 30 day group by sg_uf, day
),
dj as (
  select sg_uf, to_json(list(struct_pack(date := strftime(day, '%Y-%m-%d'), cases := cases)
                        order by day)) as daily_json
  from d group by sg_uf
),
mo as (
  select sg_uf, strftime(day, '%Y-%m') as month, cast(sum(cases) as bigint) as cases
  from fact group by 1, 2
),
mr as (
  select *, row_number() over (partition by sg_uf order by month desc) as rn from mo
),
mj as (
  select sg_uf, to_json(list(struct_pack(month := month, cases := cases) order by month)) as monthly_json
  from mr where rn <= 12 group by sg_uf
)
select mj.sg_uf, coalesce(daily_json::varchar, '[]') as daily_json, monthly_json::varchar as monthly_json
from mj left join dj on dj.sg_uf is not distinct from mj.sg_uf"""


# ------------------------------------------------------ risk, reports, checks

from episcope.functions.pii import PII_RULES  # noqa: E402
from episcope.operators import news as _N  # noqa: E402
from episcope.plans import fixtures as _FX  # noqa: E402
from episcope.operators import checks as _CH  # noqa: E402
from episcope.operators import report as _REP  # noqa: E402
from episcope.operators import risk as _R  # noqa: E402


def q(s: str) -> str:
    """SQL string literal."""
    return "'" + s.replace("'", "''") + "'"


def sql_fill(template: str, *values: str) -> str:
    """SQL twin of ``functions.text.fill``: literal pieces and value expressions joined."""
    pieces = template.split("{}")
    out = [q(pieces[0])]
    for value, piece in zip(values, pieces[1:]):
        out += [f"({value})", q(piece)]
    return "(" + " || ".join(out) + ")"


def _cap(x: str) -> str:
    return f"(upper(substr({x}, 1, 1)) || lower(substr({x}, 2)))"


_G, _MO, _U, _V = ("coalesce(taxa_aumento_casos, 0.0)", "coalesce(taxa_mortalidade, 0.0)",
                   "coalesce(taxa_ocupacao_uti, 0.0)", "coalesce(taxa_vacinacao, 0.0)")

_FINDINGS = f""",
f as (
  select sg_uf,
    case when {_G} > 10 then 'high' when {_G} < -10 then 'low' else 'moderate' end as s1,
    case when {_G} > 10 then {q(_R.GROWTH_HIGH)} when {_G} < -10 then {q(_R.GROWTH_LOW)}
         else {q(_R.GROWTH_STABLE)} end as m1,
    case when {_MO} > 10 then 'high' when {_MO} >= 5 then 'moderate' else 'low' end as s2,
    {sql_fill(_R.MORTALITY_MSG, f"printf('%.2f', {_MO})")} as m2,
    case when {_U} > 30 then 'high' when {_U} >= 20 then 'moderate' else 'low' end as s3,
    {sql_fill(_R.ICU_MSG, f"printf('%.2f', {_U})")} as m3,
    case when {_V} < 50 then 'high' when {_V} < 70 then 'moderate' else 'low' end as s4,
    {sql_fill(_R.VACCINATION_MSG, f"printf('%.2f', {_V})")} as m4,
    cast(({_G} > 10)::int * 2 + ({_MO} > 10)::int * 2 + ({_U} > 30)::int + ({_V} < 50)::int as integer)
      as risk_score
  from m
)"""

ORACLE["findings_by_uf"] = metrics_by_uf_cte() + _FINDINGS + """
select sg_uf, 1 as pos, 'growth' as kind, s1 as severity, m1 as message from f
union all select sg_uf, 2, 'mortality', s2, m2 from f
union all select sg_uf, 3, 'uti', s3, m3 from f
union all select sg_uf, 4, 'vaccination', s4, m4 from f"""

_LEVEL = "case when risk_score >= 4 then 'alto' when risk_score >= 2 then 'moderado' else 'baixo' end"

ORACLE["risk_by_uf"] = metrics_by_uf_cte() + _FINDINGS + f"""
select sg_uf, risk_score, {_LEVEL} as risk_level from f"""

_GROWTH_TEXT = f"""case when {_G} > 0 then {sql_fill(_REP.GROWTH_UP, f"printf('%.2f', {_G})")}
     when {_G} < 0 then {sql_fill(_REP.GROWTH_DOWN, f"printf('%.2f', abs({_G}))")}
     else {q(_REP.GROWTH_FLAT)} end"""
_RECS = f"""(case when {_MO} > 10 then {q(_REP.MORT_HIGH)} when {_MO} < 5 then {q(_REP.MORT_LOW)}
      else {q(_REP.MORT_MID)} end || chr(10) ||
 case when {_U} > 30 then {q(_REP.ICU_HIGH)} else {q(_REP.ICU_OK)} end || chr(10) ||
 case when {_V} < 60 then {q(_REP.VACC_LOW)} else {q(_REP.VACC_OK)} end || chr(10))"""

ORACLE["recommendations_by_uf"] = metrics_by_uf_cte() + f"""
select sg_uf, {_GROWTH_TEXT} as growth_text, {_RECS} as recommendations from m"""


def _report_sql(layout: str, news_sql: str = q(_REP.NO_NEWS), execution: str = "'exec-' || sg_uf",
                key: str = "sg_uf") -> str:
    parts = [sql_fill(_REP.HEADER, q(_REP_TIME.strftime(_REP.HEADER_STAMP)), execution)]
    if layout == "current":
        parts.append(sql_fill(_REP.RISK_LINE, f"upper({_LEVEL})"))
    parts += [q(_REP.METRICS_INTRO),
              sql_fill(_REP.GROWTH_LINE, f"printf('%.2f', {_G})"),
              sql_fill(_REP.MORTALITY_LINE, f"printf('%.2f', {_MO})"),
              sql_fill(_REP.ICU_LINE, f"printf('%.2f', {_U})"),
              sql_fill(_REP.VACC_LINE, f"printf('%.2f', {_V})"),
              sql_fill(_REP.CONTEXT if layout == "current" else _REP.CONTEXT_LEGACY,
                       "format('{:,}', total_casos)"),
              _GROWTH_TEXT]
    if layout == "current":
        parts.append(q(_REP.FINDINGS_TITLE))
        parts += [sql_fill(_REP.FINDING_LINE, _cap(f"s{i}"), f"m{i}") for i in range(1, 5)]
        parts.append(q(_REP.NEWS_TITLE))
    else:
        parts.append(q(_REP.NEWS_TITLE_LEGACY))
    parts += [news_sql, q(_REP.CHARTS_TITLE + _REP.CONCLUSIONS_TITLE), _RECS]
    if layout == "current":
        parts.append(q(_REP.SOURCE.format(_REP.DEFAULT_PROVIDER, _REP.DEFAULT_SOURCE_TYPE,
                                          _REP.DEFAULT_UPDATED, _REP.DETERMINISTIC)))
    parts.append(sql_fill(_REP.FOOTER, q(_REP_TIME.strftime(_REP.FOOTER_STAMP))))
    return f"select {key + ', ' if key else ''}(" + " || ".join(f"({p})" for p in parts) + ") as report"


import datetime as _dt  # noqa: E402

_REP_TIME = _dt.datetime(2026, 1, 1, 12, 0)
_MF = metrics_by_uf_cte() + _FINDINGS + ",\nmf as (select * from m join f using (sg_uf))"

ORACLE["report_by_uf"] = _MF + "\n" + _report_sql("current") + " from mf"
ORACLE["report_legacy_by_uf"] = _MF + "\n" + _report_sql("legacy") + " from mf"

_REPORT_MSG = "case when report is null or length(report) < 100 then " + q(_CH.SHORT_REPORT)
for _s in _CH.REQUIRED_SECTIONS:
    _REPORT_MSG += f" when not contains(report, {q(_s)}) then {q(_CH.MISSING_SECTION + _s)}"
_REPORT_MSG += " else 'OK' end"
ORACLE["report_checks"] = _MF + ",\nr as (" + _report_sql("current") + f""" from mf)
select sg_uf, ({_REPORT_MSG}) = 'OK' as valid, {_REPORT_MSG} as message from r"""

_METRIC_MSG = "case"
for _name in _CH.REQUIRED_METRICS:
    _METRIC_MSG += f" when {_name} is null then {q(_CH.MISSING_METRIC + _name)}"
for _name, _lo, _hi, _msg in _CH.RANGE_RULES:
    _METRIC_MSG += f" when not ({_name} >= {_lo} and {_name} <= {_hi}) or isnan({_name}) then {q(_msg)}"
_METRIC_MSG += " else 'OK' end"
ORACLE["metric_checks"] = metrics_by_uf_cte() + f"""
select sg_uf, ({_METRIC_MSG}) = 'OK' as valid, {_METRIC_MSG} as message from m"""

_SPOILT_METRICS = ", ".join(
    f"case when c = {k + 1} then null when c = {k + 5} then ({n} + 1000000) * {(-1) ** k} else {n} end as {n}" for k, n in enumerate(_CH.REQUIRED_METRICS))
ORACLE["metric_checks_failing"] = metrics_by_uf_cte() + f""",
s as (select sg_uf, cast(c as integer) as "case", {_SPOILT_METRICS} from m, range(9) as t(c))
select sg_uf, "case", ({_METRIC_MSG}) = 'OK' as valid, {_METRIC_MSG} as message from s"""
_SPOILT_REPORT = " ".join(f"when {k + 3} then replace(report, {q(x)}, '-')" for k, x in enumerate(_CH.REQUIRED_SECTIONS))
ORACLE["report_checks_failing"] = _MF + ",\nr as (" + _report_sql("current") + f""" from mf),
s as (select sg_uf, cast(c as integer) as "case", case c when 0 then report when 1 then substr(report, 1, 99) {_SPOILT_REPORT} end as report
      from r, range(7) as t(c))
select sg_uf, "case", ({_REPORT_MSG}) = 'OK' as valid, {_REPORT_MSG} as message from s"""


# ------------------------------------------------------------ text and privacy

def _lp(expr: str, n: int) -> str:
    return f"lpad(cast({expr} as varchar), {n}, '0')"


_K = "c_custkey"
_CPF = (f"{_lp(_K + ' % 1000', 3)} || '.' || {_lp('(' + _K + ' * 7) % 1000', 3)} || '.' || "
        f"{_lp('(' + _K + ' * 13) % 1000', 3)} || '-' || {_lp(_K + ' % 100', 2)}")
_RG = (f"{_lp(_K + ' % 100', 2)} || '.' || {_lp('(' + _K + ' * 3) % 1000', 3)} || '.' || "
       f"{_lp('(' + _K + ' * 11) % 1000', 3)} || '-' || cast({_K} % 10 as varchar)")
_PHONE = (f"'(' || {_lp(_K + ' % 90 + 10', 2)} || ') 9' || {_lp(_K + ' % 10000', 4)} || '-' || "
          f"{_lp('(' + _K + ' * 17) % 10000', 4)}")
_EMAIL = "lower(regexp_replace(c_name, '[^A-Za-z0-9]', '', 'g')) || '@example.com'"

PII_TEXTS = f"""
with t as (
  select doc_id, text from documents
  union all
  select -{_K} as doc_id,
    case when {_K} % 4 = 0 then 'Paciente ' || c_name || ', CPF ' || {_CPF} || ', telefone ' || {_PHONE}
         when {_K} % 4 = 1 then 'Documento RG ' || {_RG} || ' do paciente ' || c_name
         when {_K} % 4 = 2 then 'Contato: ' || {_EMAIL} || ' ou ' || {_PHONE}
         else 'Registro sem dados pessoais de ' || c_name end as text
  from customer
)"""

_TYPES = "concat_ws(',', " + ", ".join(
    f"case when regexp_matches(text, {q(p)}) then {q(label)} end" for label, p, _ in PII_RULES) + ")"
_ANY = " or ".join(f"regexp_matches(text, {q(p)})" for _, p, _ in PII_RULES)
_MASKED = "text"
for _label, _p, _mask in PII_RULES:
    _MASKED = f"regexp_replace({_MASKED}, {q(_p)}, {q(_mask)}, 'g')"

ORACLE["detect_pii"] = PII_TEXTS + f"""
select doc_id, ({_ANY}) as has_pii, {_TYPES} as pii_types from t"""

ORACLE["anonymize_documents"] = PII_TEXTS + f"""
select doc_id, ({_ANY}) as pii_detected, {_TYPES} as pii_types,
       case when {_ANY} then {_MASKED} else text end as scrubbed from t"""

ORACLE["sanitize_text"] = """
select doc_id, substring(regexp_replace(text, '[<>"''%;()&+]', '', 'g'), 1, 200) as sanitized
from documents"""

# Entity decoding restricted to the entities present in the test pages.
_ENTITIES = (("&quot;", '"'), ("&middot;", "·"), ("&copy;", "©"), ("&amp;", "&"))


def _unescape_sql(x: str) -> str:
    for ent, ch in _ENTITIES:
        x = f"replace({x}, {q(ent)}, {q(ch)})"
    return x


def _visible_text_sql(x: str) -> str:
    hidden = "|".join(rf"<{name}\b[^>]*>.*?(?:</{name}\s*>|\z)" for name in ("script", "style", "template"))
    markup = rf"""(?is){hidden}|<!--.*?(?:-->|\z)|<[/!?a-z](?:[^"'>]|"[^"]*"|'[^']*')*>"""
    x = f"regexp_replace({x}, {q(markup)}, ' ', 'g')"
    return _unescape_sql(x)


def _collapse_sql(x: str) -> str:
    return f"trim(regexp_replace({x}, '\\s+', ' ', 'g'))"


def _summary_sql(x: str) -> str:
    t = _collapse_sql(_visible_text_sql(x))
    return (f"case when {x} is null or {x} = '' then '' when length({t}) > 320 "
            f"then rtrim(substring({t}, 1, 320), ' ') || '…' else {t} end")


ORACLE["clean_html"] = f"""
select page_id, {_summary_sql('html')} as summary,
       cast(length({_collapse_sql(_visible_text_sql('html'))}) as integer) as text_chars
from pages"""


# ------------------------------------------------------------------------ news

_PAGE_TERMS = ("the", "und", "les", "que", "tion", "ein", "ou", "uti", "gripe")

NEWS_CTE = f"""
with raw_items as (
  select cast(page_id % 3 as integer) as feed_pos, page_id as item_pos,
         'feed-' || cast(page_id % 3 as varchar) as source,
         trim({_unescape_sql("regexp_extract(html, '(?is)<title[^>]*>(.*?)</title', 1)")}) as title,
         html as description, url,
         case when page_id % 11 = 0 then null
              else timestamp '2026-01-01 00:00:00' + to_days(cast(page_id % 40 as integer)) end as instant
  from pages
),
items as (
  select feed_pos, item_pos, source, title, {_summary_sql('description')} as summary,
         coalesce(strftime(instant, '%Y-%m-%d'), '') as date, coalesce(url, '') as url, instant
  from raw_items
  where not (title is null or title = '' or starts_with(lower(title), 'nav.')
             or starts_with(lower(title), 'navegação') or starts_with(lower(title), 'menu'))
),
keyed as (
  select *, trim(regexp_replace(lower(title), '\\s+', ' ', 'g')) as k,
         row_number() over (partition by trim(regexp_replace(lower(title), '\\s+', ' ', 'g'))
                            order by feed_pos, item_pos) as rn
  from items
),
dedup as (select * exclude (k, rn) from keyed where rn = 1),
scored as (
  select *, cast(""" + " + ".join(
    f"cast(contains(lower(coalesce(title, '') || ' ' || coalesce(summary, '')), {q(t)}) as integer)"
    for t in _PAGE_TERMS) + """ as integer) as score
  from dedup
)"""

ORACLE["relevance_scores"] = NEWS_CTE.replace("dedup as (select * exclude (k, rn) from keyed where rn = 1)",
                                              "dedup as (select * from items)") + """
select item_pos, score from scored"""

ORACLE["dedupe_titles"] = NEWS_CTE + """
select feed_pos, item_pos, source, title, date from dedup"""

_RANKED = NEWS_CTE + """,
ranked as (
  select cast(row_number() over (order by score desc, instant desc nulls last, feed_pos, item_pos)
              as integer) as rank, *
  from scored
  qualify rank <= 5
)"""

ORACLE["rank_news"] = _RANKED + """
select rank, title, source, date, url, score, summary from ranked"""

_NEWS_TEXT = ("coalesce((select string_agg("
              + sql_fill(_REP.NEWS_ENTRY, "cast(rank as varchar)", "title", "source", "date", "summary")
              + ", '' order by rank) from ranked), " + q(_REP.NO_NEWS) + ")")

ORACLE["report_with_news"] = (_RANKED + ",\n" + (CASES_CTE + _fact()).removeprefix("with ")
                              + f""",
sums as (select {_metric_sums(30)} from fact),
m as ({_metric_finish()} from sums),
f as (
  select *,
    case when {_G} > 10 then 'high' when {_G} < -10 then 'low' else 'moderate' end as s1,
    case when {_G} > 10 then {q(_R.GROWTH_HIGH)} when {_G} < -10 then {q(_R.GROWTH_LOW)}
         else {q(_R.GROWTH_STABLE)} end as m1,
    case when {_MO} > 10 then 'high' when {_MO} >= 5 then 'moderate' else 'low' end as s2,
    {sql_fill(_R.MORTALITY_MSG, f"printf('%.2f', {_MO})")} as m2,
    case when {_U} > 30 then 'high' when {_U} >= 20 then 'moderate' else 'low' end as s3,
    {sql_fill(_R.ICU_MSG, f"printf('%.2f', {_U})")} as m3,
    case when {_V} < 50 then 'high' when {_V} < 70 then 'moderate' else 'low' end as s4,
    {sql_fill(_R.VACCINATION_MSG, f"printf('%.2f', {_V})")} as m4,
    cast(({_G} > 10)::int * 2 + ({_MO} > 10)::int * 2 + ({_U} > 30)::int + ({_V} < 50)::int as integer)
      as risk_score
  from m
)
""" + _report_sql("current", news_sql=_NEWS_TEXT, execution="'exec-national'", key="") + " from f")


# -------------------------------------------------------- job ledger and audit

JOBS_CTE = """
with ch as (
  select 'job-' || cast(user_id as varchar) as job_id, event_id, ts,
    case event_type when 'click' then 'queued' when 'view' then 'running'
                    when 'purchase' then 'succeeded' when 'error' then 'failed' end as status,
    case when event_type = 'signup' then 'exec-' || cast(event_id as varchar) end as execution_id,
    case when event_type = 'purchase' then 'reports/' || cast(event_id as varchar) || '.md' end as report_path,
    case when event_type = 'purchase' then value * 100 end as duration_ms,
    case when event_type = 'error' then 'error at event ' || cast(event_id as varchar) end as error,
    props as payload
  from events
),
jobs as (
  select job_id, min(ts) as created_at, max(ts) as updated_at,
    arg_max(status, (ts, event_id)) filter (where status is not null) as status,
    arg_max(execution_id, (ts, event_id)) filter (where execution_id is not null) as execution_id,
    arg_max(report_path, (ts, event_id)) filter (where report_path is not null) as report_path,
    arg_max(duration_ms, (ts, event_id)) filter (where duration_ms is not null) as duration_ms,
    arg_max_null(error, (ts, event_id)) filter (where status in ('failed', 'succeeded')) as error,
    arg_min(payload, (ts, event_id)) as payload
  from ch group by job_id
)"""


def _ts(c: str) -> str:
    return f"strftime({c}, '%Y-%m-%d %H:%M:%S.%f')"


ORACLE["latest_job_state"] = JOBS_CTE + f"""
select job_id, {_ts('created_at')} as created_at, {_ts('updated_at')} as updated_at, status,
       execution_id, report_path, duration_ms, error, payload from jobs"""

ORACLE["job_results"] = """
with last as (select user_id, arg_max(event_id, (ts, event_id)) filter (where event_type = 'purchase') as e
              from events group by user_id)
select 'job-' || cast(user_id as varchar) as job_id,
       case when e is null then '' when e % 3 = 0 then '1' else '0' end as pii_detected,
       case when e % 3 = 0 then 'CPF,E-mail' else '' end as pii_types,
       coalesce(cast(e as varchar), '') as summary_event from last"""

ORACLE["status_counts"] = JOBS_CTE + """,
counts as (select status, count(*) as n from jobs group by status),
dim as (select * from (values (0, 'queued'), (1, 'running'), (2, 'succeeded'), (3, 'failed')) t(pos, status))
select dim.status, cast(coalesce(n, 0) as bigint) as jobs,
       cast(sum(coalesce(n, 0)) over () as bigint) as total_jobs
from dim left join counts using (status)"""

ORACLE["recent_jobs"] = JOBS_CTE + f"""
select job_id, status, {_ts('created_at')} as created_at, execution_id from jobs
order by jobs.created_at desc, job_id desc limit 20"""

ORACLE["recent_failures"] = JOBS_CTE + f"""
select job_id, status, {_ts('created_at')} as created_at, error from jobs where status = 'failed'
order by jobs.created_at desc, job_id desc limit 5"""

ORACLE["backlog_head"] = JOBS_CTE + f"""
select job_id, {_ts('created_at')} as created_at, payload from jobs where status = 'queued'
order by jobs.created_at, job_id limit 1"""

ORACLE["retry_plan"] = JOBS_CTE + """
select job_id,
  case when execution_id is null
       then json_object('k', cast(json_extract(payload, '$.k') as integer))
       else json_object('k', cast(json_extract(payload, '$.k') as integer), 'execution_id', execution_id)
  end::varchar as retry_payload
from jobs where status = 'failed'"""

AUDIT_CTE = """
with a as (
  select cast(event_id as varchar) as event_id, ts,
    case event_type when 'click' then 'tool_call' when 'view' then 'validation'
                    when 'error' then 'error' else 'agent_decision' end as event_type,
    'exec-' || cast(user_id as varchar) as execution_id,
    case when event_type not in ('click', 'view', 'error') then event_type end as decision,
    case when event_type = 'click' then 'database_query' end as tool_name,
    case when event_type = 'click' then value end as duration_ms,
    case when event_type = 'view' then 'metrics' end as validation_type,
    case when event_type = 'view' then value < 50 end as valid,
    case when event_type = 'view' then (case when value < 50 then 'OK' else 'out of range' end) end as message,
    case when event_type = 'error' then 'RuntimeError' end as error_type,
    case when event_type = 'error' then 'failure ' || cast(event_id as varchar) end as error_message
  from events
)"""

ORACLE["flatten_events"] = AUDIT_CTE + f"""
select event_id, event_type, execution_id, {_ts('ts')} as ts, decision, tool_name, duration_ms,
       validation_type, valid::varchar as valid, message, error_type, error_message from a"""

ORACLE["execution_summary"] = AUDIT_CTE + """
select execution_id,
  (epoch_us(max(ts)) - epoch_us(min(ts))) / 1000.0 as duration_ms,
  cast(count_if(event_type = 'tool_call') as bigint) as total_tool_calls,
  cast(count_if(event_type = 'validation') as bigint) as total_validations,
  cast(count_if(event_type = 'validation' and not coalesce(valid, false)) as bigint) as failed_validations,
  cast(count_if(event_type = 'error') as bigint) as total_errors,
  count_if(event_type = 'error') = 0 as success
from a group by execution_id"""

# Recursive fold per user: (a1, a2) are the two latest admitted instants (K = 2).
RATE_CTE = """
with recursive c as (
  select event_id, user_id, epoch_us(ts) as t,
         row_number() over (partition by user_id order by ts, event_id) as rn
  from events
),
r as (
  select user_id, rn, event_id, true as admitted, cast(null as bigint) as a1, t as a2
  from c where rn = 1
  union all
  select c.user_id, c.rn, c.event_id,
         (r.a1 is null or c.t - r.a1 >= 21600000000) as admitted,
         case when r.a1 is null or c.t - r.a1 >= 21600000000 then r.a2 else r.a1 end as a1,
         case when r.a1 is null or c.t - r.a1 >= 21600000000 then c.t else r.a2 end as a2
  from r join c on c.user_id = r.user_id and c.rn = r.rn + 1
)"""

ORACLE["rate_limit"] = RATE_CTE + "\nselect event_id, user_id, admitted from r"
ORACLE["rate_limit_summary"] = RATE_CTE + """
select admitted, cast(count(*) as bigint) as calls from r group by admitted"""


# The oracle states the expected parse from the generating rule, not by parsing.
ORACLE["parse_feed_dates"] = """
with s as (select event_id, ts, event_id % 5 as shape from events)
select event_id,
  case shape when 0 then strftime(ts, '%a, %d %b %Y %H:%M:%S') || ' -0300'
             when 1 then strftime(ts, '%-d %b %Y %H:%M:%S') || ' GMT'
             when 2 then strftime(ts, '%Y-%m-%dT%H:%M:%S') || 'Z'
             when 3 then strftime(ts, '%Y-%m-%dT%H:%M:%S') || '+02:00'
             else 'sem data' end as raw_date,
  case when shape < 4 then strftime(ts, '%Y-%m-%d') else '' end as date,
  case shape when 0 then strftime(date_trunc('second', ts) + interval 3 hour, '%Y-%m-%d %H:%M:%S')
             when 1 then strftime(date_trunc('second', ts), '%Y-%m-%d %H:%M:%S') end as instant
from s"""


# ------------------------------------------------- sources and sinks, round trips

ORACLE["ingest_csv_cases"] = ORACLE["clean_cases"]
ORACLE["curated_reload_metrics"] = ORACLE["all_metrics"]
ORACLE["audit_log_roundtrip"] = ORACLE["execution_summary"]
ORACLE["report_files"] = (_MF + "\nselect 'exec-' || sg_uf as execution_id, report from ("
                          + _report_sql("current") + " from mf)")
ORACLE["feed_items"] = f"""
select page_id, 1 as item_pos,
       trim({_unescape_sql("regexp_extract(html, '(?is)<title[^>]*>(.*?)</title', 1)")}) as title,
       url,
       strftime(timestamp '2026-01-01' + to_days(cast(page_id % 40 as integer)), '%Y-%m-%d') as date
from pages
where page_id % 50 <> 7
  and trim({_unescape_sql("regexp_extract(html, '(?is)<title[^>]*>(.*?)</title', 1)")}) <> ''"""

ORACLE["feed_files"] = f"""
select trim({_unescape_sql("regexp_extract(html, '(?is)<title[^>]*>(.*?)</title', 1)")}) as title, url,
       'page ' || cast(page_id as varchar) || ' <b>at</b> ' || url as description,
       strftime(timestamp '2026-01-01' + to_days(cast(page_id % 40 as integer)), '%Y-%m-%d') as date
from pages
where trim({_unescape_sql("regexp_extract(html, '(?is)<title[^>]*>(.*?)</title', 1)")}) <> ''"""


# ------------------------------------------------------------------ streaming

ORACLE["stream_ingest_cases"] = ORACLE["clean_cases"]
ORACLE["stream_daily_cases"] = CASES_CTE + """
select strftime(dt_notific, '%Y-%m-%d') as date, cast(count(*) as bigint) as cases
from cases group by dt_notific"""
ORACLE["stream_execution_summary"] = ORACLE["execution_summary"]
ORACLE["stream_rate_limit"] = ORACLE["rate_limit"]

ORACLE["load_history_latest"] = CASES_CTE + """
select 'DATASUS/SIVEP-Gripe' as provider, 'parquet_table' as source_type, 'table#0' as db_path, true as updated,
       'https://example.org/srag-2000.csv' as source_url, cast(count(*) as bigint) as rows_processed from cases"""

_DEFAULT_SOURCE = q(_REP.SOURCE.format(_REP.DEFAULT_PROVIDER, _REP.DEFAULT_SOURCE_TYPE, _REP.DEFAULT_UPDATED, _REP.DETERMINISTIC))
ORACLE["report_with_source"] = ORACLE["report_with_news"].replace(_NEWS_TEXT, q(_REP.NO_NEWS)).replace(
    _DEFAULT_SOURCE, q(_REP.SOURCE.format("DATASUS/SIVEP-Gripe", "parquet_table", "load time", _REP.DETERMINISTIC)))

_FEED_RANKED = f"""with items as (
  select doc_id as item_pos, doc_id % 3 as feed_pos, case when doc_id % 3 = 0 then 'Agência Sul' else 'Boletim Norte' end as source,
         ([{', '.join(q(t) for t in _FX.FEED_TOPICS)}])[doc_id % {len(_FX.FEED_TOPICS)} + 1] || ' ' || doc_id as title,
         'Nota ' || doc_id || ' & mais' as summary, timestamp '2026-01-01' + to_minutes(doc_id) as instant
  from documents where doc_id % 3 <> 2),
scored as (
  select *, strftime(instant, '%Y-%m-%d') as date,
         {' + '.join(f"contains(lower(title || ' ' || summary), {q(t)})::int" for t in _N.RELEVANCE_TERMS)} as score
  from items where not ({' or '.join(f"starts_with(lower(title), {q(x)})" for x in _N.JUNK_TITLE_PREFIXES)})),
ranked as (
  select cast(row_number() over (order by score desc, instant desc nulls last, feed_pos, item_pos) as integer) as rank, *
  from scored qualify rank <= 5)"""
ORACLE["feed_report"] = ORACLE["report_with_news"].replace(_RANKED, _FEED_RANKED, 1)

ORACLE["cases_half_open_range"] = CASES_CTE + """
select sg_uf, cast(count(*) as bigint) as cases from cases
where dt_notific >= date '2000-03-01' and dt_notific < date '2000-04-01' group by sg_uf"""

ORACLE["cases_last_30_days"] = CASES_CTE + """
select sg_uf, cast(count(*) as bigint) as cases, cast(sum(obito) as bigint) as deaths from cases
where dt_notific >= (select max(dt_notific) from cases) - interval 30 day group by sg_uf"""

ORACLE["decode_job_columns"] = JOBS_CTE + """
select job_id, cast(json_extract(payload, '$.k') as integer) as k,
       case when (length(job_id) + length(payload)) % 3 = 0 then 'CPF,E-mail' else '' end as pii_types,
       case when status = 'failed' then 'failed' else '' end as summary_status from jobs"""

ORACLE["job_snapshots_merged"] = JOBS_CTE + """
select job_id, status, case when status = 'failed' then '{}' else payload end as payload from jobs"""
