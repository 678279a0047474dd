"""Declared types: nothing is inferred from data."""

from __future__ import annotations

from pyspark.sql import types as T


def _struct(**columns: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind, True) for name, kind in columns.items()])


_S, _I, _L, _D = T.StringType(), T.IntegerType(), T.LongType(), T.DoubleType()
_TS = T.TimestampNTZType()

#: logical tables, with the columns that any operator reads
PLAYER_STATS = _struct(
    Player=_S, Season=_I, Tm=_S, Pos=_S, Age=_I,
    G=_D, PTS=_D, AST=_D, TRB=_D, STL=_D, BLK=_D, TOV=_D,
)
PLAYER_BOXSCORES = _struct(PLAYER_NAME=_S, Team=_S, Season=_I, PTS=_D)
SALARIES = _struct(playerName=_S, seasonStartYear=_I, salary=_S, inflationAdjSalary=_S)

LOGICAL = {
    "player_stats": PLAYER_STATS,
    "player_boxscores": PLAYER_BOXSCORES,
    "salaries": SALARIES,
    # loaded like the others but read by no operator, so its columns stay text
    "payroll": None,
}

#: star-schema tables that the logical tables can be derived from
STAR = {
    "nation": _struct(n_nationkey=_I, n_name=_S, n_regionkey=_I),
    "customer": _struct(
        c_custkey=_L, c_name=_S, c_nationkey=_I, c_acctbal=_D, c_mktsegment=_S
    ),
    "part": _struct(
        p_partkey=_L, p_name=_S, p_brand=_S, p_type=_S, p_size=_I, p_retailprice=_D
    ),
    "orders": _struct(
        o_orderkey=_L, o_custkey=_L, o_orderstatus=_S, o_totalprice=_D,
        o_orderdate=_TS, o_orderpriority=_S,
    ),
    "lineitem": _struct(
        l_orderkey=_L, l_partkey=_L, l_suppkey=_L, l_linenumber=_I, l_quantity=_D,
        l_extendedprice=_D, l_discount=_D, l_tax=_D, l_returnflag=_S, l_linestatus=_S,
        l_shipdate=_TS,
    ),
}
