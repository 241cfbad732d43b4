"""TPC-H table schemas as DDL, in the column order of the delimited files."""

from __future__ import annotations

# The columns and types that TPC-H prescribes (money is decimal(15,2)).
TPCH = {
    "region": "r_regionkey INT NOT NULL, r_name STRING NOT NULL, r_comment STRING",
    "nation": "n_nationkey INT NOT NULL, n_name STRING NOT NULL, n_regionkey INT NOT NULL, n_comment STRING",
    "supplier": "s_suppkey INT NOT NULL, s_name STRING NOT NULL, s_address STRING NOT NULL, "
    "s_nationkey INT NOT NULL, s_phone STRING NOT NULL, s_acctbal DECIMAL(15,2) NOT NULL, s_comment STRING NOT NULL",
    "customer": "c_custkey INT NOT NULL, c_name STRING NOT NULL, c_address STRING NOT NULL, "
    "c_nationkey INT NOT NULL, c_phone STRING NOT NULL, c_acctbal DECIMAL(15,2) NOT NULL, "
    "c_mktsegment STRING NOT NULL, c_comment STRING NOT NULL",
    "orders": "o_orderkey BIGINT NOT NULL, o_custkey INT NOT NULL, o_orderstatus STRING NOT NULL, "
    "o_totalprice DECIMAL(15,2) NOT NULL, o_orderdate DATE NOT NULL, o_orderpriority STRING NOT NULL, "
    "o_clerk STRING NOT NULL, o_shippriority INT NOT NULL, o_comment STRING NOT NULL",
    "lineitem": "l_orderkey BIGINT NOT NULL, l_partkey INT NOT NULL, l_suppkey INT NOT NULL, "
    "l_linenumber INT NOT NULL, l_quantity DECIMAL(15,2) NOT NULL, l_extendedprice DECIMAL(15,2) NOT NULL, "
    "l_discount DECIMAL(15,2) NOT NULL, l_tax DECIMAL(15,2) NOT NULL, l_returnflag STRING NOT NULL, "
    "l_linestatus STRING NOT NULL, l_shipdate DATE NOT NULL, l_commitdate DATE NOT NULL, "
    "l_receiptdate DATE NOT NULL, l_shipinstruct STRING NOT NULL, l_shipmode STRING NOT NULL, "
    "l_comment STRING NOT NULL",
}
