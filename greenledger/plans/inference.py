"""Tests between the two largest sectors."""

from __future__ import annotations

from ..operators import inference, profile
from .domain import Domain
from .registry import query
from .relational import MEAN
from .statistics import rounded

PAIR = """top2 as (select industry, row_number() over (order by count(*) desc, industry) place from dashboard_base
where industry is not null group by industry order by place limit 2),
pair as (select case place when 1 then 'a' else 'b' end side, measured_value v, measured_value
from dashboard_base join top2 using (industry))"""
SPREAD = PAIR + """,
s as (select side, count(*) n, avg(v) m, var_samp(v) s2 from pair group by side),
w as (select a.n na, a.m ma, a.s2/a.n va, b.n nb, b.m mb, b.s2/b.n vb from s a, s b where a.side='a' and b.side='b')"""
LEVENE = PAIR + """,
centre as (select side, median(v) c from pair group by side),
z as (select side, abs(v-c) z from pair join centre using (side)),
zs as (select side, count(*) n, avg(z) m, var_samp(z)*(count(*)-1) ss from z group by side),
zg as (select sum(n) n, sum(n*m)/sum(n) g, sum(ss) ss from zs)"""

# Tails by Simpson's rule: the t tail over the angle whose tangent is t / sqrt(df), the normal tail over twelve units.
STEPS = """,
steps as (select i/20000.0::double x, case when i in (0,20000) then 1 when i%2=1 then 4 else 2 end k from range(20001) r(i))"""


def t_tail(name: str, source: str) -> str:
    """A CTE with t, df and the two-sided p of t from ``source``."""
    part = "sum(k*exp((df-1)*ln(greatest(cos({0}+(pi()/2-{0})*x),1e-300))))*(pi()/2-{0})"
    return f""",
{name} as (select t, df, {part.format("a")}/({part.format("0.0::double")}) p
from (select t, df, atan(abs(t)/sqrt(df)) a from {source}), steps group by t, df, a)"""


LEVENE_P = LEVENE + """,
levene as (select (zg.n-2)*sum(zs.n*(m-g)*(m-g))/max(zg.ss) w, zg.n-2 df from zs, zg group by zg.n)""" + STEPS + t_tail(
    "levene_tail", "(select sqrt(w) t, df from levene)")
WELCH_TEXT = """,
welch as (select (ma-mb)/sqrt(va+vb) t, (va+vb)*(va+vb)/(va*va/(na-1)+vb*vb/(nb-1)) df from w)"""
WELCH_P = SPREAD + WELCH_TEXT + STEPS + t_tail("welch_tail", "welch")
RANK_TEXT = """,
tied as (select v, count(*) filter (side='a') a, count(*) filter (side='b') b from pair group by v),
ranked as (select *, coalesce(sum(b) over (order by v rows between unbounded preceding and 1 preceding),0) below from tied),
sums as (select sum(a)::double n_a, sum(b)::double n_b, sum(a*(below+b/2.0::double))::double u_a,
sum((a+b)::double*(a+b)*(a+b)-(a+b)) tie_term from ranked),
scored as (select *, n_a*n_b-u_a u_b, (greatest(u_a,n_a*n_b-u_a)-n_a*n_b/2-0.5)
/sqrt(n_a*n_b/12*(n_a+n_b+1-tie_term/((n_a+n_b)*(n_a+n_b-1)))) z from sums),
rank_tail as (select n_a, n_b, u_a, u_b, tie_term,
least(1.0::double,2*sum(k*exp(-(z+12*x)*(z+12*x)/2))*12/60000/sqrt(2*pi())) p from scored, steps group by all)"""
RANK_P = PAIR + STEPS + RANK_TEXT


def sectors(d: Domain) -> tuple[str, str]:
    """The two largest sectors, two rows."""
    a, b = (r["industry"] for r in profile.eligible_sectors(d.base).limit(2).collect())
    return a, b


def pair(d: Domain):
    return inference.two_groups(d.base, *sectors(d))


@query("h1_levene", "select round((zg.n-2)*sum(zs.n*(m-g)*(m-g))/max(zg.ss),6) w from zs, zg group by zg.n", LEVENE)
def _(d: Domain):
    return rounded(inference.sector_levene(d.base, *sectors(d)).select("w"), 6, "w")


@query("h1_levene_p", "select round(w,6) w, round(p,6) p from levene, levene_tail", LEVENE_P)
def _(d: Domain):
    return rounded(inference.sector_levene(d.base, *sectors(d)), 6, "w", "p")


@query("h2_welch", "select round((ma-mb)/sqrt(va+vb),6) t, round((va+vb)*(va+vb)/(va*va/(na-1)+vb*vb/(nb-1)),4) df from w", SPREAD)
def _(d: Domain):
    return rounded(rounded(inference.welch(pair(d)).select("t", "df"), 6, "t"), 4, "df")


DECISION = "case when p<0.05 then 'reject' else 'keep' end decision"


@query("h2_h4_welch_p_and_decision", f"select round(t,6) t, round(df,4) df, round(p,6) p, {DECISION} from welch_tail", WELCH_P)
def _(d: Domain):
    return rounded(rounded(inference.welch(pair(d)), 6, "t", "p"), 4, "df")


@query(
    "h3_mann_whitney",
    """select na::double n_a, nb::double n_b, ra-na*(na+1)/2.0::double u_a, na*nb-(ra-na*(na+1)/2.0::double) u_b from (
select count(*) filter (side='a') na, count(*) filter (side='b') nb, sum(rk) filter (side='a') ra from (
select side, rank() over (order by v)+(count(*) over (partition by v)-1)/2.0::double rk from pair))""",
    PAIR,
)
def _(d: Domain):
    return inference.mann_whitney(pair(d)).select("n_a", "n_b", "u_a", "u_b")


@query("h3_mann_whitney_p", "select n_a, n_b, u_a, u_b, tie_term, round(p,6) p from rank_tail", RANK_P)
def _(d: Domain):
    return rounded(inference.mann_whitney(pair(d)), 6, "p")


@query("h5_group_means", f"select side, count(*) n, {MEAN} mean_value from pair group by side", PAIR)
def _(d: Domain):
    return inference.group_means(pair(d))


ALL_TESTS = LEVENE_P + SPREAD[len(PAIR):] + WELCH_TEXT + t_tail("welch_tail", "welch") + RANK_TEXT + f""",
means as (select side, count(*) n, {MEAN} mean_value from pair group by side)"""


@query(
    "sector_comparison",
    f"""select one.industry sector_a, two.industry sector_b, ma.n n_a, ma.mean_value mean_a, mb.n n_b, mb.mean_value mean_b,
round(levene.w,6) levene_w, round(levene_tail.p,6) levene_p, round(welch_tail.t,6) welch_t, round(welch_tail.df,4) welch_df,
round(welch_tail.p,6) welch_p, {DECISION.replace("p<", "welch_tail.p<")}, u_a u, round(rank_tail.p,6) u_p
from top2 one, top2 two, means ma, means mb, levene, levene_tail, welch_tail, rank_tail
where one.place=1 and two.place=2 and ma.side='a' and mb.side='b'""",
    ALL_TESTS,
)
def _(d: Domain):
    row = inference.compare_sectors(d.base, *sectors(d))
    return rounded(rounded(row, 6, "levene_w", "levene_p", "welch_t", "welch_p", "u_p"), 4, "welch_df")
