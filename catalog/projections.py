"""Roles, projections, previews."""

from __future__ import annotations

from catalog.registry import GAPPY_ORDERS, LINE_KEYS, gappy_orders, query, table
from tabulyze.operators import roles

_ROLES = {
    "l_orderkey": "numerical", "l_partkey": "numerical", "l_suppkey": "numerical",
    "l_linenumber": "numerical", "l_quantity": "numerical", "l_extendedprice": "numerical",
    "l_discount": "numerical", "l_tax": "numerical", "l_returnflag": "categorical",
    "l_linestatus": "categorical", "l_shipdate": "datetime",
}


@query("column_roles", " union all ".join(
    f"""select '{c}' as "column", '{r}' as role, count({c}) as present from lineitem"""
    for c, r in _ROLES.items()
))
def column_roles(spark, sf_dir):
    return roles.role_counts(table(spark, sf_dir, "lineitem"))


@query("select_numeric", "select o_orderkey, o_custkey, o_totalprice from orders")
def select_numeric(spark, sf_dir):
    return roles.select_numeric(table(spark, sf_dir, "orders"))


@query("project_complete_rows", f"""
select o_custkey, o_totalprice from ({GAPPY_ORDERS})
where o_custkey is not null and o_totalprice is not null""")
def project_complete_rows(spark, sf_dir):
    return roles.project_complete_rows(gappy_orders(spark, sf_dir), ["o_custkey", "o_totalprice"])


@query("preview_head", f"select * from lineitem order by {', '.join(LINE_KEYS)} limit 100")
def preview_head(spark, sf_dir):
    return roles.preview_head(table(spark, sf_dir, "lineitem"), LINE_KEYS)


@query("distinct_choices", """
select distinct c_name from customer where c_name is not null order by c_name limit 50""")
def distinct_choices(spark, sf_dir):
    return roles.distinct_choices(table(spark, sf_dir, "customer"), "c_name")
