"""The balanced forest in SQL: draws, bins, growth by level, and scores."""

from __future__ import annotations

from lossledger.operators.features import CATEGORICAL, LABEL, NUMERIC
from lossledger.operators.forest import BINS, CUT_SAMPLE, GRID, POISSON
from lossledger.operators.model import MAX_DEPTH, MIN_LEAF, TREES
from lossledger.settings import SEED


def _number(text: str) -> str:
    return f"cast('0x' || left(md5({text}), 8) as bigint)"


def _purity(zeros: str, ones: str) -> str:
    a, b = f"(({zeros})::double / all_zeros::double)", f"(({ones})::double / all_ones::double)"
    return f"(({a} * {a} + {b} * {b}) / ({a} + {b}))"


def prepared_features_sql(learn: str) -> str:
    """``prepared``: features as one list, categories as bits by falling frequency among the rows of ``learn``."""
    ranks, bits, joins = [], [], []
    for c in CATEGORICAL:
        ranks.append(f"{c}_rank as (select {c}, row_number() over (order by count(*) desc, {c}) - 1 as {c}_i, "
                     f"count(*) over () as {c}_n from learned where {c} is not null group by {c})")
        bits.append(f"list_transform(range((select max({c}_n) from {c}_rank)), "
                    f"lambda i: (coalesce({c}_i, case when f.{c} is null then 0 else -1 end) = i)::integer::double)")
        joins.append(f"left join {c}_rank on {c}_rank.{c} = f.{c}")
    numbers = ", ".join(f"f.{c}::double" for c in NUMERIC)
    return f"""
    learned as (select * from features where {learn}), {', '.join(ranks)},
    prepared as materialized (
        select f.*, account_id in (select account_id from learned) as learn, list_concat({', '.join(bits)}, [{numbers}]) as x
        from features f {' '.join(joins)})"""


def forest_sql(learn: str, trees: int = TREES, depth: int = MAX_DEPTH) -> str:
    """CTEs up to ``scored`` (``account_id, churn_probability`` of all accounts); ``learn`` picks the rows fitted on."""
    copies = " + ".join(f"(u >= {p})::integer" for p in POISSON)
    levels = []
    for d in range(depth):
        levels.append(f"""
    size_{d} as materialized (
        select tree, node, sum(copies * (label = 0)::integer)::bigint as zeros, sum(copies * (label = 1)::integer)::bigint as ones,
               count(*) as n from at_{d} where inside and copies > 0 group by tree, node),
    best_{d} as materialized (
        select tree, node, feature, bin from (
            select *, row_number() over (partition by tree, node order by score desc, feature, bin) as place from (
                select *, {_purity('l_zeros', 'l_ones')} + {_purity('zeros - l_zeros', 'ones - l_ones')} as score from (
                    select tree, node, feature, bin, all_zeros, all_ones,
                           sum(z) over upto as l_zeros, sum(o) over upto as l_ones, sum(r) over upto as l_rows,
                           sum(z) over whole as zeros, sum(o) over whole as ones, sum(r) over whole as n
                    from (
                        select a.tree, a.node, c.feature, b.bin, sum(a.copies * (label = 0)::integer) as z,
                               sum(a.copies * (label = 1)::integer) as o, count(*) as r
                        from at_{d} a
                        join (select distinct tree, node, {_number(f"'{SEED}:' || tree || ':' || node || ':' || i")} % width as feature
                              from (select *, unnest(generate_series(1, floor(sqrt(width))::bigint)) as i
                                    from size_{d}, (select max(len(x)) as width from prepared)
                                    where n >= {2 * MIN_LEAF} and zeros > 0 and ones > 0)) c using (tree, node)
                        join bins b on b.account_id = a.account_id and b.feature = c.feature
                        where inside and a.copies > 0 group by a.tree, a.node, c.feature, b.bin)
                    join totals using (tree)
                    window whole as (partition by tree, node, feature),
                           upto as (partition by tree, node, feature order by bin rows unbounded preceding))
                where l_rows >= {MIN_LEAF} and n - l_rows >= {MIN_LEAF})
            where score > {_purity('zeros', 'ones')})
        where place = 1),
    at_{d + 1} as materialized (
        select a.tree, a.account_id, label, copies, inside and s.node is not null as inside,
               case when inside and s.node is not null then 2 * a.node + (b.bin > s.bin)::integer else a.node end as node
        from at_{d} a left join best_{d} s on s.tree = a.tree and s.node = a.node
        left join bins b on b.account_id = a.account_id and b.feature = s.feature)""")
    ends = f"""
    leaves as (
        select tree, node, sum(copies * (label = 0)::integer) as zeros, sum(copies * (label = 1)::integer) as ones
        from at_{depth} where copies > 0 group by tree, node),
    valued as (
        select tree, node, case when a + b > 0 then floor(b / (a + b) * {GRID:.0f}.0::double) / {GRID:.0f}.0::double else 0 end as p
        from (select tree, node, case when all_zeros > 0 then zeros::double / all_zeros::double else 0.0::double end as a,
                     case when all_ones > 0 then ones::double / all_ones::double else 0.0::double end as b
              from leaves join totals using (tree))),
    scored as (
        select account_id, sum(coalesce(p, 0.0::double)) / {trees}.0::double as churn_probability
        from at_{depth} left join valued using (tree, node) group by account_id)"""
    return f"""{prepared_features_sql(learn)},
    long as materialized (
        select account_id, learn, unnest(x) as v, generate_subscripts(x, 1) - 1 as feature from prepared),
    sampled as (
        select account_id from prepared where learn
        order by md5('{SEED}:' || account_id), account_id limit {CUT_SAMPLE}),
    ranked as (
        select feature, v, row_number() over (partition by feature order by v) - 1 as r, count(*) over (partition by feature) as n,
               max(v) over (partition by feature) as top from long join sampled using (account_id)),
    kinds as (select feature, count(distinct v) as d from ranked group by feature),
    cuts as (
        select feature, list(distinct v) filter (where v < top and (d <= {BINS} or r in (
            select unnest([k * n // {BINS} for k in range(1, {BINS})])))) as cut
        from ranked join kinds using (feature) group by feature),
    bins as materialized (
        select account_id, feature, len(list_filter(coalesce(cut, []), lambda q: q < v)) as bin from long join cuts using (feature)),
    at_0 as materialized (
        select tree, account_id, label, case when learn then {copies} else 0 end as copies, true as inside, 1::bigint as node
        from (select account_id, {LABEL} as label, learn, t as tree,
                     cast('0x' || substr(md5('{SEED}:' || (t - 1) // 4 || ':' || account_id), 8 * ((t - 1) % 4) + 1, 8) as bigint) as u
              from prepared, (select unnest(generate_series(1, {trees})) as t))),
    totals as materialized (
        select tree, sum(copies * (label = 0)::integer)::bigint as all_zeros, sum(copies * (label = 1)::integer)::bigint as all_ones
        from at_0 group by tree),{','.join([*levels, ends])}"""
