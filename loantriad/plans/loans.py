"""Loan table derived from the order, customer and line-item tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from loantriad.functions.labels import label_from_good

GOOD_STATUS = ("settled", "active")


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def loans(spark: SparkSession, folder: str) -> DataFrame:
    """One row per loan; the line-item side is pre-aggregated on the join key.

    The rate is the mean tax in percent to two places, from whole percents: a mean of doubles depends on
    the order of addition, and its rounding would change with the partitioning.
    """
    o = table(spark, folder, "orders")
    c = table(spark, folder, "customer")
    per_order = (
        table(spark, folder, "lineitem")
        .groupBy(F.col("l_orderkey").alias("loan_id"))
        .agg(
            F.round(F.sum(F.round(F.col("l_tax") * 100).cast("bigint")) / F.count("l_tax"), 2).alias("rate"),
            F.count(F.lit(1)).alias("n"),
        )
    )
    key = F.col("o_orderkey")
    status = (
        F.when(key % 101 == 0, F.lit(None).cast("string"))
        .when((F.col("o_orderstatus") == "F") & (key % 3 == 0), "overdue")
        .when(F.col("o_orderstatus") == "F", " settled ")
        .when(F.col("o_orderstatus") == "O", "active")
        .otherwise("doubtful")
    )
    base = o.join(c, o.o_custkey == c.c_custkey).select(
        key.alias("loan_id"),
        F.col("o_custkey").alias("customer_id"),
        F.col("c_nationkey").alias("branch_code"),
        F.col("c_mktsegment").alias("loan_purpose"),
        F.col("o_orderpriority").alias("contract_type"),
        F.col("o_orderdate").alias("loan_date"),
        F.col("o_totalprice").alias("loan_amount"),
        (1 + key % 5).alias("duration_years"),
        F.when(key % 97 == 0, F.lit(None).cast("double")).otherwise(F.col("c_acctbal")).alias("monthly_income"),
        status.alias("status"),
        ((F.col("o_custkey") * 7919 + key * 104729) % 1000 / F.lit(1000.0)).alias("p_default"),
    )
    return (
        base.join(per_order, "loan_id", "left")
        .withColumn("loan_rate", F.coalesce("rate", F.lit(0.0)))
        .withColumn("installment_number", F.coalesce("n", F.lit(0)))
        .drop("rate", "n")
    )


def labelled_loans(spark: SparkSession, folder: str) -> DataFrame:
    return loans(spark, folder).withColumn("y", label_from_good(F.col("status"), GOOD_STATUS))


# The same table for the SQL engine that checks results.
LOANS_CTE = """loans as (
select o.o_orderkey as loan_id, o.o_custkey as customer_id, c.c_nationkey as branch_code,
       c.c_mktsegment as loan_purpose, o.o_orderpriority as contract_type, o.o_orderdate as loan_date,
       o.o_totalprice as loan_amount, coalesce(l.rate, 0.0) as loan_rate,
       1 + o.o_orderkey % 5 as duration_years, coalesce(l.n, 0) as installment_number,
       case when o.o_orderkey % 97 = 0 then null else c.c_acctbal end as monthly_income,
       case when o.o_orderkey % 101 = 0 then null
            when o.o_orderstatus = 'F' and o.o_orderkey % 3 = 0 then 'overdue'
            when o.o_orderstatus = 'F' then ' settled '
            when o.o_orderstatus = 'O' then 'active' else 'doubtful' end as status,
       (o.o_custkey * 7919 + o.o_orderkey * 104729) % 1000 / cast(1000.0 as double) as p_default
from orders o join customer c on o.o_custkey = c.c_custkey
left join (select l_orderkey, round(sum(round(l_tax * 100)::bigint)::double / count(l_tax), 2) as rate, count(*) as n
           from lineitem group by l_orderkey) l on l.l_orderkey = o.o_orderkey),
scored as (
select *, case when status is null then 1 when trim(status) in ('settled', 'active') then 0 else 1 end as y,
       loan_amount * (loan_rate / 100.0) * duration_years as lam_pn,
       loan_amount + loan_amount * (loan_rate / 100.0) * duration_years as lam_np
from loans)"""
