"""Queries for splits, folds, samples, neighbours and balancing."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from loantriad.catalog.registry import query
from loantriad.operators import neighbors as ne
from loantriad.operators import sampling as sa
from loantriad.plans.loans import labelled_loans, loans, table


def shuffled(key: str, seed: object = 42) -> str:
    return f"md5(concat(cast({key} as varchar), ':{seed}'))"


def uniform(key: str, seed: object) -> str:
    return f"('0x' || substr({shuffled(key, seed)}, 1, 8))::bigint / 4294967296.0::double"


@query(
    "smp1_train_test",
    f"""select loan_id, case when rn <= n - ceil(0.2::double * n) then 'train' else 'test' end as part
    from (select loan_id, row_number() over (order by {shuffled('loan_id')}) as rn, count(*) over () as n from loans)""",
    loans=True,
)
def smp1(spark, folder):
    train, test = sa.train_test_split(loans(spark, folder).select("loan_id"), "loan_id", 0.2)
    return train.withColumn("part", F.lit("train")).unionByName(test.withColumn("part", F.lit("test")))


@query(
    "smp1_ratio_split",
    f"""select l_key, case when rn <= floor(n * 0.7::double + 0.5) then 'train' else 'test' end as part
    from (select event_id as l_key, row_number() over (order by {shuffled('event_id', 7)}) as rn, count(*) over () as n from events)""",
)
def smp1_ratio(spark, folder):
    df = table(spark, folder, "events").select(F.col("event_id").alias("l_key"))
    train, test = sa.ratio_split(df, "l_key", 0.7, seed=7)
    return train.withColumn("part", F.lit("train")).unionByName(test.withColumn("part", F.lit("test")))


def fold_sql(source: str, part: str) -> str:
    """Fold of 1-based rank rn among n rows: larger folds first."""
    return f"""(select *, case when rn <= (n % 5) * (n // 5 + 1) then (rn - 1) // (n // 5 + 1)
        else n % 5 + (rn - 1 - (n % 5) * (n // 5 + 1)) // (n // 5) end as fold
      from (select *, row_number() over ({part} order by {shuffled('loan_id')}) as rn, count(*) over ({part}) as n from {source}))"""


@query("smp2_stratified_folds", f"select loan_id, y, fold::int as fold from {fold_sql('scored', 'partition by y')}", loans=True)
def smp2(spark, folder):
    return sa.stratified_k_fold(labelled_loans(spark, folder).select("loan_id", "y"), "loan_id", ["y"], 5)


@query("smp2_stratified_folds_status", f"select status, fold::int as fold, count(*) as n from {fold_sql('scored', 'partition by status')} group by 1, 2", loans=True)
def smp2_status(spark, folder):
    df = sa.stratified_k_fold(loans(spark, folder).select("loan_id", "status"), "loan_id", ["status"], 5)
    return df.groupBy("status", "fold").agg(F.count(F.lit(1)).alias("n"))


@query("smp3_folds", f"select loan_id, fold::int as fold from {fold_sql('scored', '')}", loans=True)
def smp3(spark, folder):
    return sa.k_fold(loans(spark, folder).select("loan_id"), "loan_id", 5)


QUOTA = """, q as (select status, count(*) as n, round_even(3000 * (count(*) / (sum(count(*)) over ())::double), 0)::bigint as quota from loans group by status),
    q2 as (select status, n, quota + case when row_number() over (order by n desc, status nulls first) = 1 then 3000 - sum(quota) over () else 0 end as quota from q)
"""


@query("smp4_quotas", QUOTA + "select status, n, quota::bigint as quota from q2", loans=True)
def smp4_quotas(spark, folder):
    counts = loans(spark, folder).groupBy("status").agg(F.count(F.lit(1)).alias("n"))
    return sa.proportional_quotas(counts, 3000)


@query(
    "smp4_proportional_sample",
    QUOTA
    + f"""select loan_id, status from (select loan_id, status, row_number() over (partition by status order by {shuffled('loan_id')}) as rn from loans)
    join q2 using (status) where rn <= quota""",
    loans=True,
)
def smp4(spark, folder):
    return sa.proportional_sample(loans(spark, folder).select("loan_id", "status"), "loan_id", "status", 3000)


@query(
    "smp5_systematic_marks",
    f""", r as (select loan_id, coalesce(status, '?') as s, loan_amount, row_number() over (partition by status order by {shuffled('loan_id')}) - 1 as pos,
        count(*) over (partition by status) as n from loans),
    g as (select s, n, ceil(n * 0.1::double)::bigint as m from r group by s, n),
    p as (select s, least(round_even(i * (n / m::double) + (n / m::double) / 2, 0)::bigint, n - 1) as pos
        from (select s, n, m, unnest(range(m)) as i from g))
    select loan_id, (p.pos is not null)::int as is_synthetic,
      case when p.pos is not null then round(1000 + 9000 * ({uniform('loan_id', '42:loan_amount')}), 4) else loan_amount end as loan_amount
    from r left join (select distinct * from p) p on p.s = r.s and p.pos = r.pos""",
    loans=True,
)
def smp5(spark, folder):
    df = loans(spark, folder).select("loan_id", "status", "loan_amount")
    out = sa.systematic_marks(df, "loan_id", "status", 0.1, replace={"loan_amount": (1000.0, 10000.0)})
    amount = F.when(F.col("is_synthetic") == 1, F.round("loan_amount", 4)).otherwise(F.col("loan_amount"))
    return out.select("loan_id", "is_synthetic", amount.alias("loan_amount"))


def vectors(spark, folder) -> DataFrame:
    return table(spark, folder, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("features"), "label")


@query(
    "smp6_smote",
    """, c as (select y, count(*) as n, min(loan_amount) as low, max(loan_amount) as high from scored group by y)
    select y, 0 as is_synthetic, n, true as inside from c
    union all select y, 1, (select max(n) from c) - n, true from c where n < (select max(n) from c)""",
    loans=True,
)
def smp6(spark, folder):
    """Class sizes after balancing, and whether every new row lies within its class's range."""
    names = ["loan_amount", "loan_rate", "installment_number"]
    df = labelled_loans(spark, folder).select("loan_id", "y", *names)
    out = ne.smote(df, "loan_id", "y", names, 5)
    shape = out.groupBy("y", "is_synthetic").agg(
        F.count(F.lit(1)).alias("n"), *[f(c).alias(f"{n}_{c}") for c in names for n, f in (("lo", F.min), ("hi", F.max))]
    )
    real = shape.where("is_synthetic = 0").select("y", *[F.col(f"{n}_{c}").alias(f"r{n}_{c}") for c in names for n in ("lo", "hi")])
    inside = F.lit(True)
    for c in names:
        inside = inside & (F.col(f"lo_{c}") >= F.col(f"rlo_{c}")) & (F.col(f"hi_{c}") <= F.col(f"rhi_{c}"))
    return shape.join(real, "y").select("y", "is_synthetic", "n", inside.alias("inside"))


@query(
    "smp6_smote_rows",
    f""", c as (select y, count(*) as n from scored group by y),
    w as (select y, n, (select max(n) from c) - n as missing from c where n < (select max(n) from c)),
    m as (select s.loan_id, s.y, s.loan_amount::double as a, s.loan_rate::double as r, s.installment_number::double as i,
        missing // n + (row_number() over (partition by s.y order by {shuffled('s.loan_id')}) <= missing % n)::int as draws
        from scored s join w using (y)),
    p as (select q.loan_id, min({{'d': (q.a - d.a) * (q.a - d.a) + (q.r - d.r) * (q.r - d.r) + (q.i - d.i) * (q.i - d.i), 'id': d.loan_id,
            'a': d.a, 'r': d.r, 'i': d.i}}, 5) as near
        from m q join m d on d.y = q.y and d.loan_id <> q.loan_id group by 1),
    t as (select m.*, near, unnest(range(1, draws + 1)) as draw from m join p using (loan_id)),
    g as (select *, {uniform("(loan_id || ':' || draw)", '42:gap')} as gap,
        near[(floor({uniform("(loan_id || ':' || draw)", '42:pick')} * 5) + 1)::int] as o from t)
    select y, round(a + gap * (o.a - a), 4) as loan_amount, round(r + gap * (o.r - r), 6) as loan_rate, round(i + gap * (o.i - i), 6) as installment_number from g""",
    loans=True,
)
def smp6_rows(spark, folder):
    """Every new row: which base, which of its five neighbours and how far between them all follow from the loan's id."""
    names = ["loan_amount", "loan_rate", "installment_number"]
    out = ne.smote(labelled_loans(spark, folder).select("loan_id", "y", *names), "loan_id", "y", names, 5)
    return out.where("is_synthetic = 1").select("y", F.round("loan_amount", 4).alias("loan_amount"), *[F.round(c, 6).alias(c) for c in names[1:]])


LIMITS = sa.poisson_limits(0.8)
COPIES = "(" + " + ".join(f"({uniform('loan_id', '42:bag3')} >= {x!r}::double)::int" for x in LIMITS) + ")"


@query(
    "smp7_bootstrap",
    f"select copies, count(*) as n, round(sum(loan_amount), 2) as total from (select loan_amount, {COPIES} as copies from loans) where copies > 0 group by 1",
    loans=True,
)
def smp7(spark, folder):
    out = sa.bootstrap(loans(spark, folder).select("loan_id", "loan_amount"), "loan_id", 3, 0.8)
    return out.groupBy("copies").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("loan_amount"), 2).alias("total"))


@query(
    "jn1_reattach",
    "select loan_id, p_default, round(lam_pn, 6) as lam_pn from scored",
    loans=True,
)
def jn1(spark, folder):
    """Losses join the scores by loan id."""
    from loantriad.operators.threeway import loss_columns

    df = labelled_loans(spark, folder)
    scores = df.select("loan_id", "p_default")
    return scores.join(loss_columns(df).select("loan_id", F.round("lam_pn", 6).alias("lam_pn")), "loan_id")


@query(
    "jn2_write_back",
    "select o_orderkey, coalesce(case when o_orderstatus = 'P' then o_custkey % 2 end, case when o_orderstatus = 'F' then 1 else 0 end)::int as decision from orders",
)
def jn2(spark, folder):
    o = table(spark, folder, "orders")
    first = o.select("o_orderkey", F.when(F.col("o_orderstatus") == "F", 1).otherwise(0).alias("a"))
    second = o.where("o_orderstatus = 'P'").select("o_orderkey", (F.col("o_custkey") % 2).cast("int").alias("b"))
    return first.join(second, "o_orderkey", "left").select("o_orderkey", F.coalesce("b", "a").alias("decision"))


@query(
    "jn3_semi_anti",
    """select o_orderkey, case when o_orderkey in (select l_orderkey from lineitem where l_quantity >= 50) then 'in' else 'rest' end as side from orders""",
)
def jn3(spark, folder):
    o = table(spark, folder, "orders").select("o_orderkey")
    keys = table(spark, folder, "lineitem").where("l_quantity >= 50").select(F.col("l_orderkey").alias("o_orderkey"))
    return o.join(keys, "o_orderkey", "left_semi").withColumn("side", F.lit("in")).unionByName(
        o.join(keys, "o_orderkey", "left_anti").withColumn("side", F.lit("rest"))
    )


@query(
    "jn4_candidates",
    """, cand as (select i / 4.0::double as u, j / 4.0::double as v from range(5) a(i), range(5) b(j) where i + j <= 4)
    select u, v, count(*) filter (where p_default >= coalesce((lam_pn - v * lam_pn) / nullif((lam_pn - v * lam_pn) + u * lam_np, 0), 1.0) and y = 0) as fp,
      count(*) as n from scored, cand group by u, v""",
    loans=True,
)
def jn4(spark, folder):
    """Every candidate sees every loan inside the scanning tasks; no row pairs are produced."""
    from loantriad.operators import search as sr
    from loantriad.operators.threeway import loss_columns

    return sr.objectives(loss_columns(labelled_loans(spark, folder)), sr.grid(4, 0.0)).select("u", "v", "fp", "n")


@query(
    "jn5_pair_lookup",
    "\nunion all ".join(
        f"select '{a}' as col1, '{b}' as col2, round(corr({a}, {b}), 2) + 0.0 as pearson from lineitem"
        for a in ("l_quantity", "l_extendedprice", "l_tax") for b in ("l_quantity", "l_extendedprice", "l_tax") if a != b
    ),
)
def jn5(spark, folder):
    """Ordered pairs looked up in the table of unordered ones."""
    from loantriad.operators.correlation import pearson_pairs

    names = ["l_quantity", "l_extendedprice", "l_tax"]
    half = pearson_pairs(table(spark, folder, "lineitem"), names)
    asked = spark.createDataFrame([(a, b) for a in names for b in names if a != b], "col1 string, col2 string")
    keyed = asked.withColumns({"lo": F.least("col1", "col2"), "hi": F.greatest("col1", "col2")})
    pairs = half.select(F.least("col1", "col2").alias("lo"), F.greatest("col1", "col2").alias("hi"), "pearson")
    return keyed.join(pairs, ["lo", "hi"]).select("col1", "col2", (F.round("pearson", 2) + F.lit(0.0)).alias("pearson"))


KNN = """with e as (select vec_id as id, embedding::double[] as v, label from embeddings),
    d as (select a.id as query_id, b.id as neighbour_id, b.label as label, list_distance(a.v, b.v) as distance from e a join e b on a.id <> b.id),
    k as (select *, row_number() over (partition by query_id order by round(distance, 9), neighbour_id) as place from d)
"""


@query("jn6_nearest_neighbours", KNN + "select query_id, neighbour_id, round(distance, 6) as distance, place::int as place from k where place <= 5")
def jn6(spark, folder):
    df = vectors(spark, folder)
    out = ne.knn_join(df, df, 5, exclude_self=True)
    return out.select("query_id", "neighbour_id", F.round("distance", 6).alias("distance"), "place")


@query(
    "ml8_knn_class",
    KNN
    + """, v as (select query_id, label, count(*) as n from k where place <= 5 group by 1, 2)
    select query_id, label as pred from (select *, row_number() over (partition by query_id order by n desc, label) as rn from v) where rn = 1""",
)
def ml8(spark, folder):
    """Leave-one-out class of every vector by its five nearest others."""
    df = vectors(spark, folder)
    return ne.knn_class(df, df, "label", 5, exclude_self=True)


@query(
    "srt1_top20",
    "select p_partkey, p_retailprice from part order by p_retailprice desc, p_partkey limit 20",
)
def srt1(spark, folder):
    return table(spark, folder, "part").orderBy(F.desc("p_retailprice"), "p_partkey").limit(20).select("p_partkey", "p_retailprice")


@query(
    "srt2_sorted_groups",
    "select loan_purpose, round(avg(p_default), 6) as mean, rank() over (order by avg(p_default) desc)::int as place from loans group by 1",
    loans=True,
)
def srt2(spark, folder):
    from pyspark.sql import Window

    out = loans(spark, folder).groupBy("loan_purpose").agg(F.avg("p_default").alias("m"))
    place = F.rank().over(Window.orderBy(F.desc("m")))  # over the few groups
    return out.select("loan_purpose", F.round("m", 6).alias("mean"), place.alias("place")).orderBy("place")


@query(
    "srt3_lexicographic",
    "select l_orderkey, l_linenumber, l_quantity, l_extendedprice from lineitem order by l_quantity, l_extendedprice, l_orderkey, l_linenumber limit 1",
)
def srt3(spark, folder):
    df = table(spark, folder, "lineitem")
    names = ("l_quantity", "l_extendedprice", "l_orderkey", "l_linenumber")
    return df.orderBy(*names).limit(1).select("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice")


@query(
    "set1_concat",
    """select 'loan' as kind, o_orderkey as id, o_totalprice as amount, null::double as value from orders
    union all select 'event', event_id, null, value from events""",
)
def set1(spark, folder):
    a = table(spark, folder, "orders").select(F.lit("loan").alias("kind"), F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("amount"))
    b = table(spark, folder, "events").select(F.lit("event").alias("kind"), F.col("event_id").alias("id"), "value")
    return a.unionByName(b, allowMissingColumns=True)
