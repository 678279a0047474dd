"""SQL for DuckDB that answers each query independently of the operators.

Shared relations are written once and put in front of each statement. ``r(x, n)`` in the texts
below stands for the rounding that both sides use: over a decimal, halves away from zero.
"""

from __future__ import annotations

import re

from periodica.plans.presets import ORDERS as P

_RELATIONS: dict[str, str] = {
    "base": """
        select c.c_name as Player, cast(year(o.o_orderdate) as integer) as Season, o.o_orderpriority as Tm,
               c.c_custkey as ck, c.c_mktsegment as seg, n.n_name as nn, l.l_quantity as q,
               l.l_linenumber as ln, l.l_returnflag as rf, l.l_linestatus as ls
        from lineitem l
        join orders o on l.l_orderkey = o.o_orderkey
        join customer c on o.o_custkey = c.c_custkey
        join nation n on c.c_nationkey = n.n_nationkey""",
    "stint": """
        select Player, Season, Tm,
               max(case when ck % 3 = 0 then concat(seg, '-', nn) else seg end) as Pos,
               cast(max(19 + (ck + Season) % 25) as integer) as Age,
               count(*) as G, cast(sum(q) as bigint) as PTS, cast(sum(ln) as bigint) as AST,
               cast(sum(case when rf = 'R' then q else 0 end) as bigint) as TRB,
               cast(sum(case when rf = 'A' then 1 else 0 end) as bigint) as STL,
               cast(sum(case when ls = 'F' then 1 else 0 end) as bigint) as BLK,
               cast(sum(case when rf = 'N' then 1 else 0 end) as bigint) as TOV
        from base group by all""",
    "player_stats": """
        select * from stint
        union all
        select Player, Season, 'TOT', max(Pos), max(Age), cast(sum(G) as bigint),
               cast(sum(PTS) as bigint), cast(sum(AST) as bigint), cast(sum(TRB) as bigint),
               cast(sum(STL) as bigint), cast(sum(BLK) as bigint), cast(sum(TOV) as bigint)
        from stint group by Player, Season having count(*) > 1""",
    "kept": """
        select * from player_stats
        qualify Tm = 'TOT' or count(*) filter (Tm = 'TOT') over (partition by Player, Season) = 0""",
    "paid_raw": """
        select c.c_name as playerName, cast(year(o.o_orderdate) as integer) as seasonStartYear,
               cast(floor(max(o.o_totalprice)) as bigint) as s
        from orders o join customer c on o.o_custkey = c.c_custkey group by all""",
    "salaries": """
        with once as (
            select playerName, seasonStartYear, concat('$', format('{:,}', s)) as salary,
                   concat('$', format('{:,}', s * (100 + 3 * (2001 - seasonStartYear)) // 100))
                       as inflationAdjSalary
            from paid_raw)
        select * from once union all select * from once where playerName like '%7'""",
    "money": """
        select playerName, seasonStartYear, amount from (
            select playerName, seasonStartYear,
                   try_cast(regexp_replace(salary, '[$,]', '', 'g') as bigint) as amount
            from salaries) group by all""",
    "money_adjusted": """
        select playerName, seasonStartYear, amount from (
            select playerName, seasonStartYear,
                   try_cast(regexp_replace(inflationAdjSalary, '[$,]', '', 'g') as bigint) as amount
            from salaries) group by all""",
    "payroll": """
        select o_orderpriority as team, cast(year(o_orderdate) as integer) as seasonStartYear,
               concat('$', format('{:,}', cast(sum(cast(floor(o_totalprice) as bigint)) as bigint)))
                   as payroll
        from orders group by 1, 2""",
    "scored": """
        select *, cast(PTS + TRB + AST + STL + BLK - TOV as double) / nullif(G, 0) as prod
        from kept""",
    "part_names": "select distinct p_name as name, lower(p_name) as norm_key from part",
}
_USES = {
    "stint": ["base"],
    "player_stats": ["stint"],
    "kept": ["player_stats"],
    "scored": ["kept"],
    "salaries": ["paid_raw"],
    "money": ["salaries"],
    "money_adjusted": ["salaries"],
}


def _round(sql: str) -> str:
    """Spell out ``r(x, n)``; calls may be nested."""
    pattern = re.compile(r"\br\(((?:[^()]|\((?:[^()]|\((?:[^()]|\([^()]*\))*\))*\))*), (\d)\)")
    while True:
        sql, n = pattern.subn(r"cast(round(cast(\1 as decimal(28,10)), \2) as double)", sql)
        if n == 0:
            return sql


def _sql(body: str, *relations: str, **extra: str) -> str:
    order: list[str] = []

    def need(name: str) -> None:
        for used in _USES.get(name, []):
            need(used)
        if name not in order:
            order.append(name)

    for name in relations:
        need(name)
    parts = [f"{n} as ({_RELATIONS[n]})" for n in order] + [f"{n} as ({t})" for n, t in extra.items()]
    return _round((f"with {', '.join(parts)} " if parts else "") + body)


def _case_tiers() -> str:
    whens = " ".join(f"when x >= {floor} then '{label}'" for floor, label in P.tiers)
    return f"case {whens} else '{P.lowest_tier}' end"


_UNIT = P.money.unit
_STAT_COLUMNS = "Player, Season, Tm, Pos, Age, G, PTS, AST, TRB, STL, BLK, TOV"

_TOP_TOTALS = (
    "select Player, Season, Tm, PTS from player_stats "
    "order by PTS desc nulls last, Player, Season, Tm limit 10"
)

_TIERS = f"""
    select scoring_tier, count(*) as num_players from (
        select {_case_tiers()} as scoring_tier from (
            select PTS / cast(G as double) as x from kept
            where Season = {P.season} and G >= {P.any_sample}))
    group by scoring_tier"""

_RATES = f"""
    select Player, Tm, G, r(PTS / cast(G as double), 1) as PPG, r(AST / cast(G as double), 1) as APG,
           r(TRB / cast(G as double), 1) as RPG, r(STL / cast(G as double), 1) as SPG,
           r(BLK / cast(G as double), 1) as BPG
    from kept where Season = {P.season} and G >= {P.small_sample}"""
_PERCENTS = ", ".join(
    f"r(percent_rank() over (order by {rate} nulls first) * 100, 1) as {name}_percentile"
    for rate, name in [("PPG", "pts"), ("APG", "ast"), ("RPG", "reb"), ("SPG", "stl"), ("BPG", "blk")]
)
_PROFILE = f"select *, {_PERCENTS} from league"

_VALUE = f"""
    select Player, Tm, G, r(PTS / cast(G as double), 1) as PPG,
           r(amount / {_UNIT}, 2) as salary_millions,
           r(PTS / cast(G as double) / nullif(amount / {_UNIT}, 0), 2) as ppg_per_million
    from kept join money on Player = playerName and Season = seasonStartYear
    where Season = {P.money_season} and G >= {P.half_sample}"""
_VALUE_ORDER = "ppg_per_million desc nulls last, Player, Tm, salary_millions"

_PRICED = f"""
    select Player, Tm, G, prod_per_game, r(amount / {_UNIT}, 2) as salary_millions,
           r(amount / {_UNIT} / prod_per_game, 2) as cost_per_unit
    from (select *, r(prod, 2) as prod_per_game from scored
          where Season = {P.money_season} and G >= {P.half_sample})
    join money on Player = playerName and seasonStartYear = {P.money_season}
    where amount > {P.floor_amount} and prod_per_game > 0"""
_COST = """
    select *, rank() over (order by cost_per_unit nulls first) as underpaid_rank,
           rank() over (order by cost_per_unit desc nulls last) as overpaid_rank
    from priced"""

_CURVE = f"""
    select Age, count(*) as num_players, avg(prod) as p, avg(amount / {_UNIT}) as m
    from scored join money on Player = playerName and Season = seasonStartYear
    where G >= {P.small_sample} and amount > {P.floor_amount} and prod > 0
      and Age between {P.lowest_age} and {P.highest_age}
    group by Age"""
_CURVE_ROWS = """
    select Age, num_players, r(p, 2) as avg_prod, r(m, 2) as avg_salary_millions,
           r(p / (select max(p) from by_age) * 100, 1) as prod_index,
           r(m / (select max(m) from by_age) * 100, 1) as salary_index
    from by_age"""


def _idle(money: str, units: str) -> str:
    length = float(P.season_length)
    return f"""
        select Player, Season, {units}, r(G / {length}, 3) as availability_rate,
               r(amount / {_UNIT}, 2) as salary_millions,
               r(amount / {_UNIT} / nullif(G, 0), 3) as cost_per_game_m,
               r(amount / {_UNIT} * (1.0::double - G / {length}::double), 2) as salary_wasted_m
        from kept join {money} on Player = playerName and Season = seasonStartYear
        where amount > {P.high_amount} and G < {P.season_length}"""


_IDLE_ORDER = "salary_wasted_m desc nulls last, Player, Season, salary_millions"
_G = "r(G, 1) as G"
_GAMES = "cast(G as integer) as Games"


def _avail(money: str) -> str:
    return f"""
        select Season, count(*) as num_players,
               r(avg(G / {float(P.season_length)}::double), 3) as avg_availability
        from kept join (
            select *, percent_rank() over (
                partition by seasonStartYear order by amount nulls first) as standing
            from {money}) on Player = playerName and Season = seasonStartYear
        where standing >= 0.5 group by Season"""


_PLAIN_TYPO = "concat(substr(p_name, 1, 2), substr(p_name, 4))"
_BEST_EDIT = """
    select raw, name, norm_key, score from (
        select raw, name, norm_key,
               1.0::double - levenshtein(lower(raw), norm_key)
                   / greatest(length(raw), length(norm_key))::double as score
        from typed, part_names)
    where score >= 0.6
    qualify row_number() over (partition by raw order by score desc, norm_key desc, name desc) = 1"""


def _resolved(source: str, columns: str) -> str:
    return f"""
        select {columns}, coalesce(e.name, b.name) as match,
               r(case when e.name is not null then 1.0::double else b.score end, 6) as score,
               case when e.name is not null then 'exact' when b.name is not null then 'suggested'
                    else 'unmatched' end as status
        from {source} s
        left join part_names e on e.norm_key = lower(s.raw)
        left join best b on b.raw = s.raw"""


_ACCENTED = "translate(p_name, 'aeou', 'áèôü')"
_CUSTOMER_SLIP = """case c_custkey % 3 when 0 then upper(c_name) when 1 then concat(c_name, '~')
                    else 'zzzz' end"""


def _best_edit(typed: str, known: str) -> str:
    """The closest known name of each typed one, by edit distance, from 0.9 on."""
    return f"""
        select raw as typed, known as match, score from (
            select raw, known, 1.0::double - levenshtein(lower(raw), lower(known))
                       / greatest(length(raw), length(known))::double as score
            from {typed}, {known})
        where score >= 0.9
        qualify row_number() over (partition by raw order by score desc, lower(known) desc) = 1"""


_CAREER = f"""
    select Player, Season, G, r(PTS / cast(G as double), 1) as PPG,
           r(AST / cast(G as double), 1) as APG, r(TRB / cast(G as double), 1) as RPG,
           r(STL / cast(G as double), 1) as SPG, r(BLK / cast(G as double), 1) as BPG
    from kept where G >= {P.any_sample}"""


def _profiled(tables: dict[str, tuple[str, str]], checks: dict[str, str] | None = None) -> str:
    return " union all ".join(
        f"select '{name}' as table_name, count(*) as n_rows, {len(columns.split(','))} as n_columns, "
        f"'{', '.join(sorted(c.strip() for c in columns.split(',')))}' as columns"
        + (f", cast({checks[name]} as bigint) as checksum" if checks else "")
        + f" from {relation}"
        for name, (relation, columns) in tables.items()
    )


_LOGICAL = {
    "player_stats": ("player_stats", _STAT_COLUMNS),
    "player_boxscores": ("base", "PLAYER_NAME, Team, Season, PTS"),
    "salaries": ("salaries", "playerName, seasonStartYear, salary, inflationAdjSalary"),
    "payroll": ("payroll", "team, seasonStartYear, payroll"),
}

ORACLES: dict[str, str] = {
    "dedup_preferred": _sql(f"select {_STAT_COLUMNS} from kept", "kept"),
    "dedup_window": _sql(
        f"""select {_STAT_COLUMNS} from player_stats p where Tm = 'TOT' or (Player, Season) not in
            (select Player, Season from player_stats where Tm = 'TOT')""",
        "player_stats",
    ),
    "parse_money_distinct": _sql(
        "select playerName, seasonStartYear, amount as salary_int from money", "money"
    ),
    "composite_score": _sql(
        f"""select Player, Season, Tm, G, r(prod, 2) as prod_per_game from scored
            where G >= {P.any_sample}""",
        "scored",
    ),
    "primary_token": _sql(
        "select Player, Season, Tm, Pos, split_part(Pos, '-', 1) as position from player_stats",
        "player_stats",
    ),
    "q01_top_totals": _sql(_TOP_TOTALS, "player_stats"),
    "q01_labels": _sql(
        f"select *, concat(Player, ' (', Season, ')') as label from ({_TOP_TOTALS})", "player_stats"
    ),
    "q02_dual_threshold": _sql(
        f"""select *, concat(Player, chr(10), '(', Season, ')') as Label from (
                select Player, Season, Tm, r(PTS / cast(G as double), 1) as PPG,
                       r(AST / cast(G as double), 1) as APG
                from player_stats where G >= {P.half_sample})
            where PPG >= {P.dual_floors["PPG"][1]} and APG >= {P.dual_floors["APG"][1]}
            order by PPG desc nulls last, Player, Season, Tm limit 30""",
        "player_stats",
    ),
    "q02_dual_threshold_raw": _sql(
        f"""select Player, Season, Tm, r(x, 6) as PPG, r(y, 6) as APG from (
                select Player, Season, Tm, PTS / cast(G as double) as x, AST / cast(G as double) as y
                from player_stats where G >= {P.half_sample})
            where x >= {P.dual_floors["PPG"][1]} and y >= {P.dual_floors["APG"][1]}
            order by x desc nulls last, Player, Season, Tm limit 30""",
        "player_stats",
    ),
    "q03_period_trend": _sql(
        f"""select Season, r(avg(x), 6) as avg_PPG, count(*) as player_count, r(avg(G), 6) as avg_GP
            from (select Season, G, r(PTS / cast(G as double), 2) as x from kept
                  where G >= {P.any_sample})
            group by Season""",
        "kept",
    ),
    "q06_top_debut": _sql(
        f"""select Player, Season, Tm, G, PPG from (
                select k.Player, k.Season, k.Tm, k.G, r(k.PTS / cast(k.G as double), 2) as PPG
                from kept k where k.G >= {P.small_sample} and k.Season = (
                    select min(s.Season) from player_stats s where s.Player = k.Player))
            where Season >= {P.debut_from}
            qualify rank() over (partition by Season order by PPG desc nulls last) = 1""",
        "kept",
    ),
    "q05_tiers": _sql(_TIERS, "kept"),
    "q05_share": _sql(
        f"""select *, r(num_players * 100.0::double / (select sum(num_players) from tiers), 1)
                as share_pct from tiers""",
        "kept",
        tiers=_TIERS,
    ),
    "q07_percentiles": _sql(_PROFILE, "kept", league=_RATES),
    "percentile_long": _sql(
        """select Player, Tm, metric, percentile from (
               select Player, Tm, pts_percentile as PTS, ast_percentile as AST,
                      reb_percentile as REB, stl_percentile as STL, blk_percentile as BLK
               from profile)
           unpivot include nulls (percentile for metric in (PTS, AST, REB, STL, BLK))""",
        "kept",
        league=_RATES,
        profile=_PROFILE,
    ),
    "percentile_lookup": _sql(
        f"""select c_custkey, position, raw, match, r(score, 6) as score,
                   case when match is null then 'unmatched' when score = 1.0 then 'exact'
                        else 'suggested' end as status, profile.*
           from (select * from entries left join best on best.typed = entries.raw)
           left join (select * from profile qualify row_number() over (
               partition by Player order by pts_percentile desc nulls last, Tm) = 1) profile
             on profile.Player = match""",
        "kept",
        league=_RATES,
        profile=_PROFILE,
        entries=f"""select c_custkey, 0 as position, {_CUSTOMER_SLIP} as raw from customer
                    union all select c_custkey, 1, upper(c_name) from customer""",
        best=_best_edit("(select distinct raw from entries)", "(select distinct c_name as known from customer)"),
    ),
    "career_lookup": _sql(
        f"""select career.* from ({_CAREER}) career
            where Player in (select match from best)""",
        "kept",
        entries=f"select {_CUSTOMER_SLIP} as raw from customer",
        best=_best_edit("(select distinct raw from entries)", "(select distinct c_name as known from customer)"),
    ),
    "resolve_accented": _sql(
        f"""select p_partkey, upper({_ACCENTED}) as raw, name as match, 1.0::double as score,
                   'exact' as status
            from part join (
                select lower(strip_accents(name)) as norm_key, max(name) as name from (
                    select case when p_partkey % 2 = 0 then {_ACCENTED} else p_name end as name
                    from part) group by 1) on norm_key = lower(strip_accents(upper({_ACCENTED})))"""
    ),
    "resolve_ratio_slip": _sql(
        """select p_partkey, concat(p_name, '~') as raw, p_name as match,
                  r(2.0::double * length(p_name) / (2 * length(p_name) + 1), 6) as score,
                  'suggested' as status
           from part"""
    ),
    "bad_money": _sql(
        """select count(*) as rows, count(*) filter (playerName like '%3' or playerName like '%5')
                  as bad_rows,
                  cast(sum(case when playerName like '%5' then 0 else
                      cast(regexp_replace(salary, '[$,]', '', 'g') as bigint) end) as bigint)
                      as lenient_total
           from salaries""",
        "salaries",
    ),
    "q08_topn_per_group": _sql(
        """select Tm, cast(total as bigint) as team_total_pts, cast(place as integer) as team_ranking, Player, PTS, G
           from (select *, sum(PTS) over (partition by Tm) as total,
                        rank() over (partition by Tm order by PTS desc nulls last) as place
                 from stint where Season = %d and G >= %d) where place <= 3"""
        % (P.season, P.any_sample),
        "stint",
    ),
    "q09_most_improved": _sql(
        f"""select *, concat('+', improvement) as label from (
                select b.Player, b.Tm, a.x as PPG_{P.previous_season}, b.x as PPG_{P.season},
                       r(b.x - a.x, 1) as improvement
                from rated b join rated a on a.Player = b.Player
                 and a.Season = {P.previous_season} and b.Season = {P.season})
            order by improvement desc nulls last, Player, Tm limit 15""",
        "kept",
        rated=f"""select Player, Season, Tm, r(PTS / cast(G as double), 1) as x from kept
                  where G >= {P.small_sample}""",
    ),
    "q10_consistency": _sql(
        f"""select PLAYER_NAME, Team, games_played, avg_ppg, std_dev from (
                select b.Player as PLAYER_NAME, b.Tm as Team, s.G as games_played, s.m as avg_ppg,
                       r(sqrt(avg(power(b.q - s.m, 2))), 1) as std_dev
                from base b join (
                    select Player, Tm, G, r(PTS / cast(G as double), 1) as m from stint
                    where Season = {P.season} and G >= {P.consistency_sample}) s
                  on b.Player = s.Player and b.Tm = s.Tm and b.Season = {P.season}
                group by all)
            where avg_ppg >= {P.consistency_rate}
            order by std_dev nulls first, PLAYER_NAME, Team limit 15""",
        "stint",
    ),
    "q04_sustained": _sql(
        f"""select Player, count(Season) as seasons_above, r(avg(x), 1) as avg_ppg_in_those_seasons
            from (select Player, Season, r(PTS / cast(G as double), 2) as x from kept
                  where G >= {P.any_sample})
            where x >= {P.sustained_rate} group by Player
            having count(Season) >= {P.sustained_periods}""",
        "kept",
    ),
    "q11_value_per_cost": _sql(f"{_VALUE} order by {_VALUE_ORDER} limit 15", "kept", "money"),
    "q11_value_per_cost_all": _sql(_VALUE, "kept", "money"),
    "q12_cost_per_unit": _sql(_COST, "scored", "money", priced=_PRICED),
    "label_extremes": _sql(
        """(select * from cost where cost_per_unit is not null
            order by cost_per_unit, Player, Tm limit 10)
           union
           (select * from cost where cost_per_unit is not null
            order by cost_per_unit desc, Player, Tm limit 5)""",
        "scored",
        "money",
        priced=_PRICED,
        cost=_COST,
    ),
    "label_extremes_value": _sql(
        f"""(select * from worth order by {_VALUE_ORDER} limit 10)
            union
            (select * from worth where ppg_per_million is not null
             order by ppg_per_million, Player, Tm, salary_millions limit 5)""",
        "kept",
        "money",
        worth=_VALUE,
    ),
    "q13_share_premium": _sql(
        """select *, position_premium > 1.0 as overpaid,
                  printf('%.2f', position_premium) || chr(10) || '(n=' || num_players || ')' as label
           from (select position, num_players, r(p, 2) as avg_prod, r(m, 2) as avg_salary_millions,
                        r((m / (select sum(m) from means)) / (p / (select sum(p) from means)), 2)
                            as position_premium
                 from means)""",
        "scored",
        "money",
        means=f"""select split_part(Pos, '-', 1) as position, count(*) as num_players,
                         avg(prod) as p, avg(amount / {_UNIT}) as m
                  from scored join money on Player = playerName and Season = seasonStartYear
                  where Season = {P.money_season} and G >= {P.half_sample}
                    and amount > {P.floor_amount} and prod > 0
                  group by 1""",
    ),
    "q14_peak_index": _sql(_CURVE_ROWS, "scored", "money", by_age=_CURVE),
    "q14_peaks": _sql(
        """select a as peak_prod_age, b as peak_salary_age,
                  case when b > a then b - a end as salary_lag
           from (select
               (select Age from curve order by prod_index desc, Age limit 1) as a,
               (select Age from curve order by salary_index desc, Age limit 1) as b)""",
        "scored",
        "money",
        by_age=_CURVE,
        curve=_CURVE_ROWS,
    ),
    "q15_idle_cost": _sql(_idle("money", _G), "kept", "money"),
    "q15b_idle_cost": _sql(_idle("money_adjusted", _GAMES), "kept", "money_adjusted"),
    "q15_top": _sql(
        f"""select *, concat(Player, chr(10), '(', Season, ')') as label,
                   split_part(Player, ' ', -1) as last_name, salary_wasted_m * 20 as bubble,
                   printf('$%.1fM  (', salary_wasted_m) || G || 'Games)' as text
            from ({_idle("money", _G)}) order by {_IDLE_ORDER} limit 10""",
        "kept",
        "money",
    ),
    "q15b_top": _sql(
        f"""select *, printf('$%.1fM  (', salary_wasted_m) || Games || ' Games)' as text
            from ({_idle("money_adjusted", _GAMES)}) order by {_IDLE_ORDER} limit 10""",
        "kept",
        "money_adjusted",
    ),
    "q15_avail": _sql(_avail("money"), "kept", "money"),
    "q15b_avail": _sql(_avail("money_adjusted"), "kept", "money_adjusted"),
    "career": _sql(
        f"""select Player, Season, G, r(PTS / cast(G as double), 1) as PPG,
                   r(AST / cast(G as double), 1) as APG, r(TRB / cast(G as double), 1) as RPG,
                   r(STL / cast(G as double), 1) as SPG, r(BLK / cast(G as double), 1) as BPG
            from kept where G >= {P.any_sample}""",
        "kept",
    ),
    "name_dim": _sql(
        """select lower(strip_accents(Player)) as norm_key, max(Player) as name
           from base group by 1""",
        "base",
    ),
    "resolve_exact": _sql(
        """select p_partkey, upper(p_name) as raw, n.name as match,
                  case when n.name is not null then 1.0::double end as score,
                  case when n.name is not null then 'exact' else 'unmatched' end as status
           from part left join part_names n on lower(upper(p_name)) = n.norm_key""",
        "part_names",
    ),
    "resolve_fuzzy": _sql(
        _resolved("rows_typed", "s.p_partkey, s.raw"),
        "part_names",
        rows_typed=f"select p_partkey, {_PLAIN_TYPO} as raw from part",
        typed="select distinct raw from rows_typed",
        best=_BEST_EDIT,
    ),
    "resolve_list": _sql(
        _resolved("rows_typed", "s.p_partkey, s.position, s.raw"),
        "part_names",
        rows_typed=f"""select p_partkey, 0 as position, upper(p_name) as raw from part
                       union all select p_partkey, 1, {_PLAIN_TYPO} from part""",
        typed="select distinct raw from rows_typed",
        best=_BEST_EDIT,
    ),
    "table_profile": _sql(_profiled(_LOGICAL), "player_stats", "salaries", "payroll"),
    "load_tables": _sql(
        _profiled(
            _LOGICAL,
            {
                "player_stats": "sum(PTS)",
                "player_boxscores": "sum(q)",
                "salaries": "sum(length(salary) + length(inflationAdjSalary))",
                "payroll": "sum(length(payroll))",
            },
        ),
        "player_stats",
        "salaries",
        "payroll",
    ),
}
_AVAILABLE = f"""
    select split_part(Pos, '-', 1) as position, cast(Age // 5 * 5 as integer) as age_from,
           G / {float(P.season_length)}::double as share
    from kept join (
        select *, percent_rank() over (
            partition by seasonStartYear order by amount nulls first) as standing
        from money) on Player = playerName and Season = seasonStartYear
    where standing >= 0.5"""
ORACLES["availability_by_position_and_age"] = _sql(
    """select case when grouping(position) + grouping(age_from) = 0 then 'position and age'
                   when grouping(position) = 0 then 'position'
                   when grouping(age_from) = 0 then 'age' else 'all' end as grouped_by,
              position, age_from, count(*) as num_players, r(avg(share), 3) as avg_availability
       from available
       group by grouping sets ((position, age_from), (position), (age_from), ())
       having count(*) > 0""",
    "kept",
    "money",
    available=_AVAILABLE,
)

#: two predictors, solved by determinants
ORACLES["expected_amount"] = _sql(
    f"""select *, case when off_by >= {P.significant} then 'above'
                       when off_by <= -{P.significant} then 'below'
                       when off_by is not null then 'as expected' end as priced
        from (
            select Player, Season, Tm, age, prod_per_game, salary_millions,
                   r(e, 2) as expected_millions, r(salary_millions - e, 2) as residual_millions,
                   r((salary_millions - e) / nullif(spread, 0), 2) as off_by
            from (select *, base + bx * prod_per_game + ba * age as e
                  from listed left join model using (Season)))""",
    "scored",
    "money",
    listed=f"""
        select Player, Season, Tm, Age as age, r(prod, 2) as prod_per_game,
               r(amount / {_UNIT}, 2) as salary_millions
        from scored join money on Player = playerName and Season = seasonStartYear
        where G >= {P.small_sample} and amount > {P.floor_amount}""",
    steps="""
        select Season, cast(round(prod_per_game * 100) as bigint) as x,
               cast(age * 100 as bigint) as a, cast(round(salary_millions * 100) as bigint) as y
        from listed""",
    sums="""
        select Season, count(*)::double as n, sum(x)::double as sx, sum(a)::double as sa,
               sum(y)::double as sy, n * sum(x * x) - sx * sx as xx, n * sum(x * a) - sx * sa as xa,
               n * sum(a * a) - sa * sa as aa, n * sum(x * y) - sx * sy as xy,
               n * sum(a * y) - sa * sy as ay, n * sum(y * y) - sy * sy as yy
        from steps group by Season having count(*) > 3""",
    solved="""
        select *, (xy * aa - ay * xa) / (xx * aa - xa * xa) as bx,
               (ay * xx - xy * xa) / (xx * aa - xa * xa) as ba
        from sums""",
    model="""
        select Season, bx, ba, (sy - bx * sx - ba * sa) / n / 100 as base,
               sqrt((yy - bx * xy - ba * ay) / n / (n - 3)) / 100 as spread
        from solved""",
)

ORACLES["longest_streak"] = f"""
    with games as (
        select c_name as PLAYER_NAME, l_quantity >= {P.streak_floor} as reached,
               row_number() over (partition by c_name
                   order by o_orderdate, l_orderkey, l_linenumber, l_quantity) as place
        from lineitem
        join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey),
    islands as (
        select *, place - row_number() over (
            partition by PLAYER_NAME, reached order by place) as island
        from games),
    streaks as (
        select PLAYER_NAME, island, reached, count(*) as n, max(place) as ends
        from islands group by all)
    select PLAYER_NAME, cast(sum(n) as bigint) as events,
           coalesce(max(n) filter (reached), 0) as longest_run,
           case when arg_max(reached, ends) then arg_max(n, ends) else 0 end as current_run
    from streaks group by PLAYER_NAME"""

ORACLES["q04_sustained_top"] = (
    f"select * from ({ORACLES['q04_sustained']}) order by seasons_above desc, Player limit 20"
)
#: the same answers from the layout by season
ORACLES["layout_leaders"] = ORACLES["q08_topn_per_group"]
ORACLES["layout_consistency"] = ORACLES["q10_consistency"]
ORACLES["layout_career"] = ORACLES["career"]
