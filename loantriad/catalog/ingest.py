"""Queries for sources, sinks, filters and scalar functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from loantriad.catalog.registry import query
from loantriad.functions import dates as dt
from loantriad.functions import labels as lb
from loantriad.functions import metrics as me
from loantriad.functions import parsing as ps
from loantriad.operators import filters as fl
from loantriad.plans.loans import loans, table
from loantriad.session import scratch_path
from loantriad.sources import batches as ba
from loantriad.sources import readers as rd
from loantriad.sources import writers as wr
from loantriad.sources.schemas import BANK, FEATURE_METADATA_SCHEMA, MARKETPLACE

# ---- sources -------------------------------------------------------------------------------------


def write_lines(df: DataFrame, cells: dict[str, object], layout, short, long) -> str:
    """Raw CSV text in the shared folder: some rows end early, some carry extra cells."""
    blank = F.lit("")
    row = F.array(*[F.coalesce(cells[name], blank) if name in cells else blank for name, _ in layout])
    row = F.when(short, F.slice(row, 1, 20)).when(long, F.array_append(F.array_append(row, F.lit("extra")), F.lit("9"))).otherwise(row)
    path = scratch_path(df.sparkSession, "lines")
    lines = df.select(F.array_join(row, ",").alias("value"))
    # one cell per line under an unused separator, so the commas stay as they are
    lines.write.option("header", True).option("sep", "\u0001").option("quote", "").option("emptyValue", "").csv(path)
    return path


def money(column):
    return F.col(column).cast("decimal(20,2)").cast("string")


@query(
    "src1_marketplace_csv",
    """select loan_id as id, customer_id::int as member_id, round(loan_amount, 2) as loan_amnt, '36 months' as term,
        case when loan_id % 7 = 0 then null else loan_rate::double end as int_rate,
        case when loan_id % 11 = 0 then 'two, lines' || chr(10) || 'of text' else 'clerk' end as emp_title,
        monthly_income as annual_inc, strftime(date_trunc('month', loan_date), '%Y-%m-%d') as issued, trim(status) as loan_status, 'y' as pymnt_plan,
        case when loan_id % 3 = 0 then null else branch_code end as settlement_term from loans""",
    loans=True,
)
def src1(spark: SparkSession, folder: str) -> DataFrame:
    df = loans(spark, folder)
    key = F.col("loan_id")
    cells = {
        "id": key.cast("string"),
        "member_id": F.concat(F.lit(" "), F.col("customer_id").cast("string"), F.lit(".9 ")),
        "loan_amnt": money("loan_amount"),
        "term": F.lit("  36 months "),
        "int_rate": F.when(key % 7 == 0, "n/a").otherwise(money("loan_rate")),
        "emp_title": F.when(key % 11 == 0, '"two, lines\nof text"').otherwise("clerk"),
        "annual_inc": F.coalesce(money("monthly_income"), F.lit("  ")),
        "issued": F.date_format("loan_date", "MMM-yyyy"),
        "loan_status": F.concat(F.lit('"'), F.col("status"), F.lit('"')),
        "pymnt_plan": F.lit(" yes "),
        "settlement_term": F.col("branch_code").cast("string"),
    }
    path = write_lines(df, cells, MARKETPLACE, key % 3 == 0, key % 5 == 1)
    out = rd.read_marketplace_csv(spark, path)
    return out.select(
        "id", "member_id", F.col("loan_amnt").cast("double").alias("loan_amnt"), "term", F.col("int_rate").cast("double").alias("int_rate"),
        "emp_title", F.col("annual_inc").cast("double").alias("annual_inc"), F.date_format("issued", "yyyy-MM-dd").alias("issued"),
        "loan_status", "pymnt_plan", "settlement_term",
    )


@query(
    "src2_bank_csv",
    """select strftime(loan_date, '%Y-%m-%d %H:%M:%S') as insert_sysdate, branch_code, loan_id as loan_file_numberr,
        case when loan_id % 7 = 0 then null else customer_id::int end as client_id, round(loan_rate::double, 2) as interest_rate,
        case when loan_id % 3 = 0 then null else 1.5::double end as sit_fast_receive_percent,
        case when loan_id % 3 = 0 then null else strftime(loan_date, '%Y-%m-%d') end as createdate,
        case when loan_id % 3 = 0 then null else trim(status) end as status,
        case when loan_id % 3 = 0 then null else round(loan_amount, 2) end as approval_amount from loans""",
    loans=True,
)
def src2(spark, folder):
    df = loans(spark, folder)
    key = F.col("loan_id")
    cells = {
        "insert_sysdate": F.date_format("loan_date", "yyyy-MM-dd HH:mm:ss"),
        "branch_code": F.col("branch_code").cast("string"),
        "loan_file_numberr": key.cast("string"),
        "client_id": F.when(key % 7 == 0, F.lit("12.5")).otherwise(F.col("customer_id").cast("string")),
        "interest_rate": money("loan_rate"),
        "sit_fast_receive_percent": F.lit("1.5"),
        "createdate": F.date_format("loan_date", "yyyy-MM-dd"),
        "status": F.col("status"),
        "approval_amount": money("loan_amount"),
    }
    path = write_lines(df, cells, BANK, key % 3 == 0, key % 5 == 1)
    out = rd.read_bank_csv(spark, path)
    return out.select(
        F.date_format("insert_sysdate", "yyyy-MM-dd HH:mm:ss").alias("insert_sysdate"), "branch_code", "loan_file_numberr", "client_id",
        F.col("interest_rate").cast("double").alias("interest_rate"), F.col("sit_fast_receive_percent").cast("double").alias("sit_fast_receive_percent"),
        F.date_format("createdate", "yyyy-MM-dd").alias("createdate"), "status", F.col("approval_amount").cast("double").alias("approval_amount"),
    )


@query("src3_fetch")
def src3(spark, folder):
    """Ten thousand rows in no order: which ones is open, so only the count is meaningful."""
    return rd.fetch(loans(spark, folder), 10_000, ("status",))


@query(
    "src4_fetch_latest",
    "select loan_id, customer_id, loan_amount, status from loans order by loan_id desc limit 500",
    loans=True,
)
def src4(spark, folder):
    return rd.fetch_latest(loans(spark, folder), "loan_id", 500).select("loan_id", "customer_id", "loan_amount", "status")


@query("src5_whole_table", "select o_orderkey, o_custkey, o_totalprice from orders")
def src5(spark, folder):
    return rd.fetch(table(spark, folder, "orders"), excluded=("o_orderstatus", "o_orderdate", "o_orderpriority"))


def metadata(spark: SparkSession) -> DataFrame:
    rows = [
        (1, "loan_amount", "loans", 4, "amount"), (2, "status", "loans", 4, "target"), (3, "loan_rate", "loans", 3, "rate"),
        (4, "loan_date", "loans", 4, "day"), (5, "branch_code", "loans", 2, "branch"), (6, "loan_amnt", "other", 4, "amount"),
        (7, "monthly_income", "loans", 3, "income"),
    ]
    return spark.createDataFrame(rows, FEATURE_METADATA_SCHEMA)


@query("src6_important_columns", "select loan_amount, loan_rate, monthly_income, status from loans", loans=True)
def src6(spark, folder):
    return rd.project_important(loans(spark, folder), metadata(spark), "loans", (4, 3), "status")


@query("src6_important_columns_top", "select loan_amount, status from loans", loans=True)
def src6_top(spark, folder):
    return rd.project_important(loans(spark, folder), metadata(spark), "loans", (4,), "status")


@query(
    "src7_class_file",
    """select l_quantity as feature1, l_extendedprice as feature2, l_discount + 0.0 as feature3, l_tax + 0.0 as feature4,
      case l_returnflag when 'A' then 0 when 'N' then 1 end as class_index from lineitem where l_linenumber <> 7""",
)
def src7(spark, folder):
    df = table(spark, folder, "lineitem")
    cells = [F.col(c).cast("string") for c in ("l_quantity", "l_extendedprice", "l_discount", "l_tax")]
    whole, broken = F.concat_ws(",", *cells, F.col("l_returnflag")), F.concat_ws(",", *cells)
    path = scratch_path(spark, "classes")
    df.select(F.when(F.col("l_linenumber") != 7, whole).otherwise(broken).alias("value")).write.text(path)
    out = rd.read_class_file(spark, path, ["A", "N"])
    return out.select("feature1", "feature2", (F.col("feature3") + F.lit(0.0)).alias("feature3"), (F.col("feature4") + F.lit(0.0)).alias("feature4"), "class_index")


@query("src8_any_tabular", "select loan_id, loan_amount, status from loans", loans=True)
def src8(spark, folder):
    from loantriad.operators.clean import drop_empty_columns

    path = scratch_path(spark, "sheet")
    loans(spark, folder).select("loan_id", "loan_amount", "status", F.lit(None).cast("string").alias("note")).write.option("header", True).option(
        "nullValue", "-"
    ).option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)
    read = spark.read.option("header", True).option("nullValue", "-").schema("loan_id bigint, loan_amount double, status string, note string").csv(path)
    return drop_empty_columns(read)


# ---- sinks ---------------------------------------------------------------------------------------


@query("snk1_csv", "select loan_purpose, count(*) as n, round(sum(loan_amount), 2) as total from loans group by 1", loans=True)
def snk1(spark, folder):
    out = loans(spark, folder).groupBy("loan_purpose").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("loan_amount"), 2).alias("total"))
    path = wr.save_table_csv(out, scratch_path(spark, "results"), "statistics", "by_purpose")
    return spark.read.schema("loan_purpose string, n bigint, total double").option("header", True).csv(path)


@query("snk2_append", "select loan_id, loan_amount from loans", loans=True)
def snk2(spark, folder):
    path = scratch_path(spark, "batches")
    df = loans(spark, folder).select("loan_id", "loan_amount")
    wr.append_batch(df.where("loan_id % 2 = 0"), path)
    wr.append_batch(df.where("loan_id % 2 = 1"), path)
    return spark.read.schema(df.schema).parquet(path)


@query("snk2_repeated_batch", "select loan_id, loan_amount from loans", loans=True)
def snk2_repeated(spark, folder):
    """The second batch is sent twice and appears once."""
    root = scratch_path(spark, "batches")
    df = loans(spark, folder).select("loan_id", "loan_amount")
    for name, rest in (("even", 0), ("odd", 1), ("odd", 1)):
        ba.commit_batch(df.where(F.col("loan_id") % 2 == rest), root, name)
    return ba.read_batches(spark, root, "loan_id bigint, loan_amount double")


@query("snk3_replaced_batch", "select loan_id, loan_amount from loans where loan_id % 3 <> 0", loans=True)
def snk3_replaced(spark, folder):
    """A whole table, replaced by a third of it, then a batch more."""
    root = scratch_path(spark, "batches")
    df = loans(spark, folder).select("loan_id", "loan_amount")
    ba.commit_batch(df, root, "all")
    ba.commit_batch(df.where("loan_id % 3 = 1"), root, "first", "replace")
    ba.commit_batch(df.where("loan_id % 3 = 2"), root, "second")
    return ba.read_batches(spark, root, "loan_id bigint, loan_amount double")


@query("snk3_replace", "select loan_id, status, 0 as is_synthetic from loans where loan_amount > 100000", loans=True)
def snk3(spark, folder):
    path = scratch_path(spark, "target")
    df = loans(spark, folder)
    wr.replace_table(wr.with_synthetic_flag(df.select("loan_id", "status")), path)
    new = wr.with_synthetic_flag(df.where("loan_amount > 100000").select("loan_id", "status"))
    wr.replace_table(new, path)
    return spark.read.schema(new.schema).parquet(path)


# ---- filters -------------------------------------------------------------------------------------


@query("flt1_column_where", "select monthly_income from loans where monthly_income is not null and loan_rate > 4 and status = 'active'", loans=True)
def flt1(spark, folder):
    return fl.column_where(loans(spark, folder), "monthly_income", "loan_rate > 4 and status = 'active'")


@query("flt2_two_columns", "select monthly_income, status from loans where monthly_income is not null and status is not null", loans=True)
def flt2(spark, folder):
    return fl.two_columns(loans(spark, folder), "monthly_income", "status")


@query("flt3_complete_rows", "select loan_id, monthly_income, status from loans where monthly_income is not null and status is not null", loans=True)
def flt3(spark, folder):
    return fl.complete_rows(loans(spark, folder), "loan_id", ["monthly_income", "status"])


@query(
    "flt4_lookups",
    """select 'branch' as by, loan_id from loans where branch_code = 7 union all select 'customer', loan_id from loans where customer_id = 10
    union all select 'status', loan_id from loans where status = 'overdue'""",
    loans=True,
)
def flt4(spark, folder):
    df = loans(spark, folder)
    parts = [("branch", "branch_code", 7), ("customer", "customer_id", 10), ("status", "status", "overdue")]
    picked = [fl.equal_to(df, c, v).select(F.lit(n).alias("by"), "loan_id") for n, c, v in parts]
    return picked[0].unionByName(picked[1]).unionByName(picked[2])


@query("flt5_range", "select loan_id, loan_rate::double as loan_rate from loans where loan_rate between 2.5::double and 4.0::double", loans=True)
def flt5(spark, folder):
    return fl.in_range(loans(spark, folder), "loan_rate", 2.5, 4.0).select("loan_id", "loan_rate")


@query(
    "flt6_active",
    """select o_orderkey, flag from (select o_orderkey, case when o_orderstatus = 'F' then 1 when o_orderstatus = 'O' then 0 end as flag from orders)
    where flag <> 1 or flag is null and o_orderkey < 1000""",
)
def flt6(spark, folder):
    flag = F.when(F.col("o_orderstatus") == "F", 1).when(F.col("o_orderstatus") == "O", 0).alias("flag")
    return table(spark, folder, "orders").select("o_orderkey", flag).where(fl.active("flag", "o_orderkey", 1000))


@query(
    "flt7_non_negative",
    "select loan_id from loans where loan_id % 13 <> 0 and monthly_income >= 0 and installment_number >= 0",
    loans=True,
)
def flt7(spark, folder):
    text = F.when(F.col("loan_id") % 13 == 0, "unknown").otherwise(F.col("monthly_income").cast("string"))
    df = loans(spark, folder).withColumn("income_text", text)
    return fl.non_negative(df, ["income_text", "installment_number"]).select("loan_id")


@query("flt8_distinct", "select distinct status from loans where loan_amount > 50000", loans=True)
def flt8(spark, folder):
    return fl.distinct_values(loans(spark, folder), "status", "loan_amount > 50000")


@query(
    "flt9_soft_delete",
    """select o_orderkey, case when o_orderkey in (select l_orderkey from lineitem where l_quantity >= 50) then 1 end as is_deleted from orders""",
)
def flt9(spark, folder):
    keys = table(spark, folder, "lineitem").where("l_quantity >= 50").select(F.col("l_orderkey").alias("o_orderkey"))
    return fl.soft_delete(table(spark, folder, "orders"), keys, "o_orderkey").select("o_orderkey", "is_deleted")


@query("flt10_columns", "select loan_id, loan_amount, status, loan_rate::double as loan_rate from loans", loans=True)
def flt10(spark, folder):
    df = loans(spark, folder).drop("branch_code")
    return fl.keep_features(df, ["loan_amount", "loan_rate"], ("loan_id", "status"))


# ---- scalar functions ----------------------------------------------------------------------------


@query(
    "fn1_parse_int",
    """select loan_id, case when loan_id % 4 in (0, 3) then loan_id::int end as strict,
        case loan_id % 4 when 0 then loan_id::int when 1 then loan_id::int when 2 then null else loan_id::int end as lenient,
        case when loan_id % 4 = 1 then -loan_id::int when loan_id % 4 in (0, 3) then loan_id::int end as negative from loans""",
    loans=True,
)
def fn1(spark, folder):
    key = F.col("loan_id").cast("string")
    case = F.col("loan_id") % 4
    text = F.when(case == 0, key).when(case == 1, F.concat(key, F.lit(".7"))).when(case == 2, "n/a").otherwise(F.concat(F.lit("\t "), key, F.lit(" ")))
    minus = F.when(case == 1, F.concat(F.lit("-"), key, F.lit(".7"))).when(case == 2, "").otherwise(key)
    return loans(spark, folder).select(
        "loan_id", ps.parse_int(text).alias("strict"), ps.parse_int(text, lenient=True).alias("lenient"), ps.parse_int(minus, True).alias("negative")
    )


@query(
    "fn2_parse_numbers",
    """select loan_id, case when loan_id % 3 = 0 then null else loan_id end as whole, case when loan_id % 3 = 0 then null else loan_amount end as amount,
      case when loan_id % 3 = 0 then null else (loan_id % 8)::double / 8 end as share from loans""",
    loans=True,
)
def fn2(spark, folder):
    bad = F.col("loan_id") % 3 == 0
    cells = {
        "whole": ps.parse_long(F.when(bad, "x1").otherwise(F.concat(F.col("loan_id").cast("string"), F.lit(" ")))),
        "amount": ps.parse_decimal(F.when(bad, "").otherwise(money("loan_amount"))).cast("double"),
        "share": ps.parse_float(F.when(bad, "1,5").otherwise((F.col("loan_id") % 8 / F.lit(8.0)).cast("string"))).cast("double"),
    }
    return loans(spark, folder).select("loan_id", *[c.alias(n) for n, c in cells.items()])


@query(
    "fn3_parse_month_year",
    "select loan_id, case when loan_id % 9 = 0 then null else strftime(date_trunc('month', loan_date), '%Y-%m-%d') end as month from loans",
    loans=True,
)
def fn3(spark, folder):
    text = F.when(F.col("loan_id") % 9 == 0, "2015-12").otherwise(F.date_format("loan_date", " MMM-yyyy "))
    return loans(spark, folder).select("loan_id", F.date_format(ps.parse_month_year(text), "yyyy-MM-dd").alias("month"))


@query(
    "fn4_parse_dates",
    """select loan_id, case when loan_id % 9 = 0 then null else strftime(loan_date, '%Y-%m-%d') end as day,
      case when loan_id % 9 = 1 then null else strftime(loan_date, '%Y-%m-%d %H:%M:%S') end as moment from loans""",
    loans=True,
)
def fn4(spark, folder):
    day = F.when(F.col("loan_id") % 9 == 0, "31/12/2015").otherwise(F.date_format("loan_date", "yyyy-MM-dd"))
    moment = F.when(F.col("loan_id") % 9 == 1, "").otherwise(F.date_format("loan_date", "yyyy-MM-dd HH:mm:ss"))
    return loans(spark, folder).select(
        "loan_id", F.date_format(ps.parse_date(day), "yyyy-MM-dd").alias("day"), F.date_format(ps.parse_timestamp(moment), "yyyy-MM-dd HH:mm:ss").alias("moment")
    )


@query("fn5_clean_text", "select loan_id, substr(trim(status), 1, 1) as flag, trim(status) as cleaned from loans", loans=True)
def fn5(spark, folder):
    quoted = F.concat(F.lit('"'), F.col("status"), F.lit('" '))
    return loans(spark, folder).select("loan_id", ps.parse_char(F.col("status")).alias("flag"), ps.clean_quotes(quoted).alias("cleaned"))


@query("fn6_label_good", "select loan_id, y from scored", loans=True)
def fn6(spark, folder):
    return loans(spark, folder).select("loan_id", lb.label_from_good(F.col("status"), ("settled", "active")).alias("y"))


GOOD_CODES = "'" + "', '".join(lb.GOOD_STATUSES) + "'"
DEFAULT_CODES = "'" + "', '".join(lb.DEFAULT_STATUSES) + "'"
SHORT_CODES = "'" + "', '".join(lb.DEFAULT_STATUSES_SHORT) + "'"
# Source-language status per loan, with spelling variants outside both sets.
WORDS = [*lb.GOOD_STATUSES, *lb.DEFAULT_STATUSES, "با طل شده", "درخواست رد شد", "اعطاء ناقص"]
WORD_SQL = "[" + ", ".join(f"'{w}'" for w in WORDS) + "]"


def worded(spark, folder):
    words = F.array(*[F.lit(w) for w in WORDS])
    pick = F.element_at(words, (F.col("o_orderkey") % len(WORDS) + 1).cast("int"))
    word = F.when(F.col("o_orderkey") % 101 == 0, None).when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit(" "), pick)).otherwise(pick)
    return table(spark, folder, "orders").select("o_orderkey", word.alias("word"))


WORDED = f"""with w as (select o_orderkey, case when o_orderkey % 101 = 0 then null when o_orderkey % 2 = 0 then ' ' || ({WORD_SQL})[o_orderkey % {len(WORDS)} + 1]
    else ({WORD_SQL})[o_orderkey % {len(WORDS)} + 1] end as word from orders)
"""


@query(
    "fn6_label_good_words",
    WORDED + f"select o_orderkey, case when word is null then 1 when trim(word) in ({GOOD_CODES}) then 0 else 1 end as y from w",
)
def fn6_words(spark, folder):
    return worded(spark, folder).select("o_orderkey", lb.label_from_good(F.col("word")).alias("y"))


@query(
    "fn6_label_whitespace",
    WORDED + f"""select o_orderkey, case when word is null then 1 when regexp_replace(word, '^\\s+|\\s+$', '', 'g') in ({GOOD_CODES}) then 0 else 1 end as y
    from (select o_orderkey, case o_orderkey % 3 when 0 then word || chr(9) when 1 then chr(10) || word || chr(13) else word end as word from w)""",
)
def fn6_whitespace(spark, folder):
    """Tabs and line breaks around a status don't make it another one."""
    around = F.when(F.col("o_orderkey") % 3 == 0, F.concat("word", F.lit("\t"))).when(
        F.col("o_orderkey") % 3 == 1, F.concat(F.lit("\n"), "word", F.lit("\r"))).otherwise(F.col("word"))
    return worded(spark, folder).select("o_orderkey", lb.label_from_good(around).alias("y"))


@query(
    "fn7_label_default",
    WORDED + f"""select o_orderkey, coalesce(word in ({DEFAULT_CODES}), false)::int as y8, coalesce(word in ({SHORT_CODES}), false)::int as y3 from w""",
)
def fn7(spark, folder):
    return worded(spark, folder).select(
        "o_orderkey", lb.label_from_default(F.col("word")).alias("y8"), lb.label_from_default(F.col("word"), lb.DEFAULT_STATUSES_SHORT).alias("y3")
    )


@query("fn8_label_count", "select loan_id, cast(installment_number > 0 as int) as y from loans", loans=True)
def fn8(spark, folder):
    return loans(spark, folder).select("loan_id", lb.label_from_count(F.col("installment_number")).alias("y"))


@query("fn9_interest", "select loan_id, round(lam_pn, 6) as interest from scored", loans=True)
def fn9(spark, folder):
    cash = me.yearly_interest(F.col("loan_amount"), F.col("loan_rate"), F.col("duration_years"))
    return loans(spark, folder).select("loan_id", F.round(cash, 6).alias("interest"))


@query(
    "fn10_dates_as_numbers",
    """, t as (select loan_id, loan_date, case when loan_id % 6 = 0 then null else epoch(loan_date)::bigint end as s from loans)
    select loan_id, (loan_date::date - date '2000-01-01')::int as days, coalesce(s::double, (select median(s) from t)) as seconds from t""",
    loans=True,
)
def fn10(spark, folder):
    from loantriad.operators.clean import fill_date_seconds

    df = loans(spark, folder).select(
        "loan_id", dt.days_since_origin(F.col("loan_date")).alias("days"), F.when(F.col("loan_id") % 6 != 0, F.col("loan_date")).alias("loan_date")
    )
    return fill_date_seconds(df, "loan_date", "seconds")


@query(
    "fn11_rounding",
    """select branch_code, round(avg(loan_amount), 2) as mean, round(avg(p_default), 4) as p, round(sum(loan_amount) / 1000, 0)::bigint as thousands
    from loans group by branch_code""",
    loans=True,
)
def fn11(spark, folder):
    return loans(spark, folder).groupBy("branch_code").agg(
        F.round(F.avg("loan_amount"), 2).alias("mean"), F.round(F.avg("p_default"), 4).alias("p"),
        F.round(F.sum("loan_amount") / 1000, 0).cast("bigint").alias("thousands"),
    )


@query(
    "fn12_f_beta_g_mean",
    """, c as (select branch_code, count(*) filter (where y = 1 and p_default >= 0.5) as tp, count(*) filter (where y = 0 and p_default < 0.5) as tn,
        count(*) filter (where y = 0 and p_default >= 0.5) as fp, count(*) filter (where y = 1 and p_default < 0.5) as fn from scored group by 1),
    r as (select *, coalesce(tp / nullif(tp + fp, 0)::double, 0) as p, coalesce(tp / nullif(tp + fn, 0)::double, 0) as r, coalesce(tn / nullif(tn + fp, 0)::double, 0) as s from c)
    select branch_code, round(coalesce(5 * p * r / nullif(4 * p + r, 0), 0), 6) as f2, round(sqrt(r * s), 6) as gm from r""",
    loans=True,
)
def fn12(spark, folder):
    from loantriad.operators.evaluate import confusion_aggs
    from loantriad.plans.loans import labelled_loans

    df = labelled_loans(spark, folder).withColumn("pred", (F.col("p_default") >= 0.5).cast("int"))
    c = df.groupBy("branch_code").agg(*confusion_aggs())
    precision, recall = me.ratio(F.col("tp"), F.col("tp") + F.col("fp")), me.ratio(F.col("tp"), F.col("tp") + F.col("fn"))
    specificity = me.ratio(F.col("tn"), F.col("tn") + F.col("fp"))
    return c.select(
        "branch_code", F.round(me.f_beta(precision, recall, 2.0), 6).alias("f2"), F.round(me.g_mean(recall, specificity), 6).alias("gm")
    )
