"""L: dataset builders and model suites over stand-in inputs derived from the tables.

Nations play the states, customers the countries and counties, order dates the calendar.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from panelspark.functions.scalars import clock_to_date, safe_div
from panelspark.models.spec import coefficients
from panelspark.models.wald import tests_table
from panelspark.operators.panel import DELAY_COLUMNS
from panelspark.operators.reshape import union_all
from panelspark.plans import cross_section as C
from panelspark.plans import ingest as I
from panelspark.plans import panels as P
from panelspark.plans import suites as S
from panelspark.session import materialize

from . import lasso_sql as Z
from . import suite_sql as Q
from .common import query, rounded, sig, sig_sql, table, values_of, week_sql, with_sql
from .sources import PRIORITY_CODE


# -- shared stand-ins -----------------------------------------------------------


def order_facts(spark, sf):
    """One row per order: state, customer, day, priority, status and its line sums."""
    lines = (
        table(spark, sf, "lineitem")
        .groupBy("l_orderkey")
        .agg(
            F.sum("l_quantity").alias("qty"),
            F.sum("l_extendedprice").alias("price"),
            F.count(F.lit(1)).alias("n"),
            F.sum("l_discount").alias("disc"),
            F.sum("l_tax").alias("tax"),
        )
    )
    orders = table(spark, sf, "orders")
    customers = table(spark, sf, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    nations = table(spark, sf, "nation").select("n_nationkey", F.col("n_name").alias("state"))
    return (
        orders.join(lines, orders.o_orderkey == lines.l_orderkey)
        .join(customers, F.col("o_custkey") == F.col("c_custkey"))
        .join(nations, F.col("c_nationkey") == F.col("n_nationkey"))
        .withColumn("date", clock_to_date("o_orderdate"))
    )


FACTS_SQL = (
    "facts AS (SELECT n_name AS state, o_custkey, CAST(o_orderdate AS DATE) AS date, o_orderpriority, o_orderstatus, o_totalprice, o_orderkey, c_mktsegment, q.* "
    "FROM orders JOIN (SELECT l_orderkey, sum(l_quantity) AS qty, sum(l_extendedprice) AS price, count(*) AS n, sum(l_discount) AS disc, sum(l_tax) AS tax FROM lineitem GROUP BY 1) q "
    "ON o_orderkey = l_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey)"
)


def facts_table(spark, sf):
    """The facts as a written table, for queries that cut several tables from them."""
    cols = ["state", "o_custkey", "date", "o_orderpriority", "o_orderstatus", "o_totalprice", "c_mktsegment"]
    return materialize(order_facts(spark, sf).select(*cols, "qty", "price", "n", "disc", "tax"), "facts")


def state_days(facts):
    """(state, date) sums, rounded to what the input can express."""
    return (
        facts.groupBy("state", "date")
        .agg(
            F.round(F.sum("qty"), 0).alias("qty"),
            F.round(F.sum("price"), 2).alias("price"),
            F.sum("n").alias("n"),
            F.round(F.sum("disc"), 2).alias("disc"),
            F.round(F.sum("tax"), 2).alias("tax"),
        )
    )


DAYS_SQL = "sday AS (SELECT state, date, round(sum(qty), 0) AS qty, round(sum(price), 2) AS price, sum(n)::BIGINT AS n, round(sum(disc), 2) AS disc, round(sum(tax), 2) AS tax FROM facts GROUP BY 1, 2)"


def stand_ins(spark, sf):
    """Inputs of the state panels. Facts and daily sums are written once: nine tables are cut
    from them."""
    facts = facts_table(spark, sf)
    day = materialize(state_days(facts), "days")
    weekly = P.with_week(day).groupBy("state", "year", "week").agg(
        F.min("date").alias("date"), F.sum("qty").alias("total_mortality"), F.sum("n").cast("double").alias("COVID_mortality")
    )
    national = weekly.groupBy("year", "week").agg(
        F.sum("total_mortality").alias("US_total_mortality"), F.sum("COVID_mortality").alias("US_COVID_mortality")
    )
    mortality = (
        weekly.join(national, ["year", "week"])
        .withColumns(
            {
                "COVID_mortality_frac": safe_div("COVID_mortality", "total_mortality"),
                "US_COVID_mortality_frac": safe_div("US_COVID_mortality", "US_total_mortality"),
            }
        )
        .drop("year", "week")
    )
    policy_cols = [(F.col("qty") > 40 * i).cast("int").alias(p) for i, p in enumerate(P.POLICIES, start=1)]
    return {
        "deaths": facts.select("state", "date", F.col("qty").alias("COVID_mortality")),
        "infections": facts.select("state", "date", F.col("n").alias("COVID_infections")),
        "population": facts.groupBy("state", "o_custkey").agg(F.max("o_custkey").alias("population")).select("state", "population"),
        "mortality": mortality,
        "mobility": day.select(
            "state",
            "date",
            F.col("n").alias("state_population"),
            (F.col("disc") / 7).alias("daily_distance_diff"),
            (F.col("tax") / 7).alias("daily_visitation_diff"),
        ),
        "twitter": day.filter(F.dayofyear("date") % 2 == 0).select("state", "date", (F.col("price") / 1e5).alias("twitter_social_distancing")),
        "index": day.select("state", "date", (F.col("price") / 1e4).alias("dl_mobility")),
        "rain": day.select("state", "date", F.col("qty").alias("avg_precip")),
        "policy": day.select("state", "date", *policy_cols),
    }


# -- L1–L9 ----------------------------------------------------------------------


@query(
    "L1_epidemic_rates",
    "SELECT n_name AS country, sum(CASE WHEN code IS NULL THEN 1 ELSE 0 END) / max(k) AS pop_thousands, "
    + sig_sql("sum(CASE WHEN code IN (20, 380) THEN 1 ELSE 0 END) / (sum(CASE WHEN code IS NULL THEN 1 ELSE 0 END) / max(k))")
    + f" AS infection_deaths FROM (SELECT n_name, {PRIORITY_CODE} AS code, (SELECT CAST(count(DISTINCT year(o_orderdate)) AS DOUBLE) FROM orders) AS k FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey "
    ") GROUP BY 1",
)
def l1(spark, sf):
    orders = table(spark, sf, "orders").join(table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    rows = orders.join(table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).select(
        F.year("o_orderdate").alias("yr"), F.expr(PRIORITY_CODE).cast("int").alias("code"), "n_name"
    )
    matrix = rows.groupBy("yr", "code").pivot("n_name").agg(F.count(F.lit(1)))
    names = [c for c in matrix.columns if c not in ("yr", "code")]
    # Written: each year's report is a filter of it.
    matrix = materialize(matrix.withColumn("row_id", F.coalesce(F.col("code"), F.lit(1))), "matrix")
    years = sorted(r["yr"] for r in matrix.select("yr").distinct().collect())
    reports = {y: matrix.filter(F.col("yr") == y).drop("yr") for y in years}
    return rounded(I.epidemic_rates(reports, names, 1, 399), ["infection_deaths"])


@query("L2_health_index", "SELECT p_name AS country, p_retailprice AS hqi FROM part WHERE p_type = 'PROMO' AND p_size = 30")
def l2(spark, sf):
    raw = table(spark, sf, "part").select(
        F.col("p_type").alias("indicator_name"), F.col("p_size").alias("year_id"), F.col("p_name").alias("location_name"), F.col("p_retailprice").alias("val")
    )
    return I.health_index(raw, "PROMO", 30)


@query("L3_safety_ratings", "SELECT s_name AS country, s_acctbal AS covid_safety FROM supplier UNION ALL SELECT c_name, c_acctbal FROM customer")
def l3(spark, sf):
    a = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("rank"), F.col("s_name").alias("country"), F.col("s_acctbal").alias("score"))
    b = table(spark, sf, "customer").select(F.col("c_custkey").alias("rank"), F.col("c_name").alias("country"), F.col("c_acctbal").alias("score"))
    return I.safety_ratings([a, b])


def wide_counts(spark, sf):
    """User rows with one count column per day of the data, headed M/D/YY."""
    rows = table(spark, sf, "events").select("user_id", F.date_format("ts", "M/d/yy").alias("day"))
    wide = rows.groupBy("user_id").pivot("day").agg(F.count(F.lit(1)))
    days = [d for d in wide.columns if d != "user_id"]
    return wide.select(
        F.when(F.col("user_id") % 3 == 0, F.lit("part")).alias("Province/State"),
        F.concat(F.lit("user"), F.col("user_id").cast("string")).alias("Country/Region"),
        *[F.col(f"`{d}`") for d in days],
    )


@query(
    "L4_country_counts_at_date",
    "SELECT 'user' || user_id AS country, nullif(count(*) FILTER (CAST(ts AS DATE) = DATE '2024-01-18'), 0)::BIGINT AS covid_infections FROM events WHERE user_id % 3 <> 0 GROUP BY user_id",
)
def l4(spark, sf):
    return I.country_counts(wide_counts(spark, sf), "1/18/24", "covid_infections")


@query(
    "L5_counts_long",
    "WITH c AS (SELECT user_id, CAST(ts AS DATE) AS date, count(*) AS n FROM events GROUP BY 1, 2), u AS (SELECT DISTINCT user_id FROM events), "
    "k AS (SELECT DISTINCT date FROM c) "
    "SELECT 'user' || u.user_id AS state, k.date, n AS \"COVID_infections\" FROM u CROSS JOIN k LEFT JOIN c ON c.user_id = u.user_id AND c.date = k.date",
)
def l5(spark, sf):
    return I.us_counts_long(wide_counts(spark, sf), 2, "COVID_infections", entity="Country/Region")


@query("L5_population", "SELECT c_mktsegment AS state, c_custkey AS population FROM customer")
def l5_population(spark, sf):
    raw = table(spark, sf, "customer").select(F.col("c_mktsegment").alias("Province_State"), F.col("c_custkey").alias("Population"))
    return I.us_population(raw)


@query(
    "L6_gdp_per_capita",
    "SELECT c_name AS country, CASE WHEN c_custkey % 7 <> 0 THEN c_acctbal END AS gdp_per_capita FROM customer",
)
def l6(spark, sf):
    text = F.when(F.col("c_custkey") % 7 == 0, "..").otherwise(F.col("c_acctbal").cast("string"))
    raw = table(spark, sf, "customer").select(F.concat(F.col("c_name"), F.lit("é")).alias("Country Name"), text.alias("2018"))
    return I.gdp_per_capita(raw, "2018", keep_ascii=True)


@query(
    "L7_weekly_mortality",
    with_sql(
        FACTS_SQL,
        DAYS_SQL,
        f"w AS (SELECT state, CAST(year(date) AS INTEGER) AS y, {week_sql('date')} AS k, min(date) AS d, sum(qty) AS t, sum(n)::DOUBLE AS c FROM sday GROUP BY 1, 2, 3)",
        "dd AS (SELECT y, k, min(d) AS date FROM w GROUP BY 1, 2)",
        "r AS (SELECT state, date, t, c FROM w JOIN dd USING (y, k) UNION ALL SELECT 'United States', date, sum(t), sum(c) FROM w JOIN dd USING (y, k) GROUP BY date)",
    )
    + f"SELECT a.state, a.date, a.t AS total_mortality, a.c AS \"COVID_mortality\", {sig_sql('a.c / a.t')} AS \"COVID_mortality_frac\", u.t AS \"US_total_mortality\", u.c AS \"US_COVID_mortality\", {sig_sql('u.c / u.t')} AS \"US_COVID_mortality_frac\" "
    "FROM r a JOIN (SELECT * FROM r WHERE state = 'United States') u USING (date) WHERE a.state <> 'NATION_9'",
)
def l7(spark, sf):
    w = P.with_week(materialize(state_days(order_facts(spark, sf)), "days")).groupBy("state", "year", "week").agg(
        F.min("date").alias("d"), F.sum("qty").alias("t"), F.sum("n").cast("double").alias("c")
    )
    ends = w.groupBy("year", "week").agg(F.min("d").alias("date"))
    rows = w.join(ends, ["year", "week"]).select("state", "date", "t", "c")
    us = rows.groupBy("date").agg(F.sum("t").alias("t"), F.sum("c").alias("c")).withColumn("state", F.lit("United States"))
    raw = rows.unionByName(us).select(
        F.col("date").alias("Week Ending Date"),
        F.col("state").alias("State"),
        F.col("t").alias("Observed Number"),
        F.col("c").alias("Excess"),
        F.lit(I.PREDICTED).alias("Type"),
        F.lit(I.ALL_CAUSES).alias("Outcome"),
        F.when(F.col("state") == "NATION_9", I.SUPPRESSED_COUNTS).alias("Suppress"),
    )
    other = raw.withColumn("Type", F.lit("Unweighted"))
    return rounded(I.weekly_mortality(raw.unionByName(other)), ["COVID_mortality_frac", "US_COVID_mortality_frac"])


@query(
    "L8_wide_mobility",
    "SELECT CAST(ts AS DATE) AS date, CASE event_type WHEN 'click' THEN 'Alaska' WHEN 'error' THEN 'Alabama' ELSE event_type END AS state, count(*) AS twitter_social_distancing FROM events GROUP BY 1, 2",
)
def l8_wide(spark, sf):
    rows = table(spark, sf, "events").select(clock_to_date("ts").alias("_c0"), "event_type")
    wide = rows.groupBy("_c0").pivot("event_type", values_of(rows, "event_type")).agg(F.count(F.lit(1)))
    wide = wide.withColumnsRenamed({"click": " AK", "error": "AL"})
    return I.wide_mobility(wide, "twitter_social_distancing")


@query(
    "L8_state_mobility",
    with_sql(FACTS_SQL, DAYS_SQL) + "SELECT state, n AS state_population, date, disc AS daily_distance_diff, tax AS daily_visitation_diff FROM sday",
)
def l8_state(spark, sf):
    raw = state_days(order_facts(spark, sf)).withColumnsRenamed(
        {"state": "state_name", "n": "state_population", "disc": "daily_distance_diff", "tax": "daily_visitation_diff"}
    )
    return I.state_mobility(raw)


@query(
    "L8_index_mobility",
    with_sql(FACTS_SQL, DAYS_SQL) + "SELECT date, state, qty AS dl_mobility, price / 100 AS dl_mobility_relative_to_normal FROM sday WHERE n > 2",
)
def l8_index(spark, sf):
    raw = state_days(order_facts(spark, sf)).select(
        F.date_format("date", "yyyy-MM-dd").alias("date"),
        F.when(F.col("n") > 2, 1).otherwise(2).alias("admin_level"),
        F.col("state").alias("admin1"),
        F.col("qty").alias("m50"),
        F.col("price").alias("m50_index"),
    )
    return I.index_mobility(raw)


@query("L8_rainfall", "SELECT CAST(ts AS DATE) AS date, event_type AS state, value AS avg_precip FROM events")
def l8_rain(spark, sf):
    raw = table(spark, sf, "events").select(
        F.date_format("ts", "M/d/yy").alias("Date"), F.col("value").alias("Avg_Precip"), F.col("event_type").alias("State")
    )
    return I.rainfall(raw)


def temperatures(facts):
    month = F.date_format("date", "yyyyMM")
    v = facts.groupBy(F.col("state").alias("Location"), month.alias("Date")).agg(
        F.count(F.lit(1)).alias("k"), F.round(F.sum("o_totalprice"), 2).alias("p")
    )
    return v.select("Location", "Date", F.when(F.col("k") < 4, -99.0).otherwise(F.col("p")).alias("Value"))


TEMP_SQL = "temp AS (SELECT state AS \"State\", CAST(date_trunc('month', date) AS DATE) AS \"Date\", CASE WHEN count(*) < 4 THEN NULL ELSE round(sum(o_totalprice), 2) END AS \"Tavg\" FROM facts GROUP BY 1, 2)"


@query("L9_monthly_temperature", with_sql(FACTS_SQL, TEMP_SQL) + 'SELECT "State", "Date", "Tavg" FROM temp')
def l9_temp(spark, sf):
    return I.monthly_temperature(temperatures(order_facts(spark, sf)))


def influenza_raw(facts):
    month = F.date_format("date", "yyyy/MM")
    m = facts.groupBy(F.col("state").alias("State"), month.alias("Month Code")).agg(F.count(F.lit(1)).alias("k"))
    return m.select("State", "`Month Code`", F.when(F.col("k") < 6, "Suppressed").otherwise(F.col("k").cast("string")).alias("Deaths"))


FLU_SQL = (
    "flu AS (SELECT state AS \"State\", y AS \"Year\", coalesce(sum(CASE WHEN k >= 6 THEN k END), 0)::DOUBLE AS \"Influenza_Deaths\" FROM "
    "(SELECT state, CAST(year(date) AS INTEGER) AS y, month(date) AS m, count(*) AS k FROM facts GROUP BY 1, 2, 3) GROUP BY 1, 2)"
)


@query("L9_influenza", with_sql(FACTS_SQL, FLU_SQL) + "SELECT * FROM flu")
def l9_flu(spark, sf):
    return I.influenza_deaths(influenza_raw(order_facts(spark, sf)))


def swine_raw(facts):
    s = facts.groupBy(F.col("state").alias("State")).agg(
        F.count(F.lit(1)).alias("c"), F.countDistinct("o_custkey").alias("d")
    )
    return s.select(
        "State", F.concat(F.format_number(F.col("c") * 1000, 0), F.lit("[12]")).alias("Cases"), F.concat(F.col("d").cast("string"), F.lit("[130]")).alias("Deaths")
    )


SWINE_SQL = "swine AS (SELECT state AS \"State\", count(*) * 1000 AS \"Swineflu_Cases\", count(DISTINCT o_custkey) AS \"Swineflu_Deaths\" FROM facts GROUP BY 1)"


@query("L9_swine_flu", with_sql(FACTS_SQL, SWINE_SQL) + "SELECT * FROM swine")
def l9_swine(spark, sf):
    return I.swine_flu(swine_raw(order_facts(spark, sf)))


def census(facts):
    return facts.groupBy(
        F.col("state").alias("State"),
        F.col("o_orderpriority").alias("Age Group Code"),
        F.col("c_mktsegment").alias("Gender Code"),
        F.col("o_orderstatus").alias("Race"),
        F.year("date").alias("Yearly July 1st Estimates Code"),
    ).agg(F.count(F.lit(1)).alias("Population"))


SHARES_SQL = (
    "cens AS (SELECT state AS \"State\", o_orderpriority AS \"AgeGroup\", c_mktsegment AS \"Gender\", o_orderstatus AS \"Race\", CAST(year(date) AS INTEGER) AS \"Year\", count(*) AS \"Population\" FROM facts GROUP BY 1, 2, 3, 4, 5), "
    "shares AS (SELECT *, sum(\"Population\") OVER (PARTITION BY \"State\", \"Year\")::BIGINT AS \"TotPop\" FROM cens)"
)


@query("L9_population_shares", with_sql(FACTS_SQL, SHARES_SQL) + f"SELECT *, {sig_sql('\"Population\" / \"TotPop\"')} AS \"PopShare\" FROM shares")
def l9_shares(spark, sf):
    cells = materialize(census(order_facts(spark, sf)), "census")
    return rounded(I.population_shares(cells), ["PopShare"])


# -- L10–L13: outbreak, delays, mobility, cross-section --------------------------


def outbreak_inputs(facts):
    county = facts.groupBy(F.col("state").alias("State"), F.col("date").alias("Date"), "c_mktsegment").agg(
        F.sum(F.when(F.col("n") > 5, F.col("n")).otherwise(0)).cast("long").alias("Deaths"),
        F.sum(F.when(F.col("n") > 2, F.col("n")).otherwise(0)).cast("long").alias("Cases"),
        F.count(F.lit(1)).alias("Population"),
    )
    return county.select("State", "Date", "Deaths", "Population"), county.select("State", "Date", "Cases")


OUTBREAK_SQL = (
    "so AS (SELECT state AS s, date AS d, sum(CASE WHEN n > 5 THEN n ELSE 0 END)::BIGINT AS deaths, sum(CASE WHEN n > 2 THEN n ELSE 0 END)::BIGINT AS cases, count(*) AS pop FROM facts GROUP BY 1, 2), "
    "ff AS (SELECT s, min(CASE WHEN cases > 0 THEN d END) AS fc, min(CASE WHEN deaths > 0 THEN d END) AS fd, max(pop) AS pop, arg_max(cases, d) AS tc, arg_max(deaths, d) AS td FROM so GROUP BY 1), "
    "ob AS (SELECT s AS \"State\", fc AS \"First_Case_Date\", fd AS \"First_Death_Date\", pop AS \"Population\", tc AS \"Corona_Cases\", td AS \"Corona_Deaths\", "
    "(SELECT max(deaths) FROM so WHERE so.s = ff.s AND d BETWEEN fd AND fd + 30) AS \"Early_Deaths\", (SELECT max(cases) FROM so WHERE so.s = ff.s AND d BETWEEN fc AND fc + 30) AS \"Early_Cases\" FROM ff)"
)
OUT_SHARES = ", ".join(f"{sig_sql(f'\"{c}\" / \"Population\"')} AS \"{c}_Share\"" for c in ("Early_Deaths", "Early_Cases", "Corona_Cases", "Corona_Deaths"))
SHARE_COLS = ["Early_Deaths_Share", "Early_Cases_Share", "Corona_Cases_Share", "Corona_Deaths_Share"]


@query("L10_outbreak_summary", with_sql(FACTS_SQL, OUTBREAK_SQL) + f"SELECT *, {OUT_SHARES} FROM ob")
def l10(spark, sf):
    return rounded(C.outbreak_summary(*outbreak_inputs(facts_table(spark, sf))), SHARE_COLS)


def policy_rows(facts):
    return facts.select(
        F.col("state").alias("State"),
        F.col("o_orderpriority").alias("StatePolicy"),
        (F.col("o_orderstatus") == "F").cast("int").alias("Mandate"),
        (F.col("o_custkey") % 2).cast("int").alias("StateWide"),
        F.col("date").alias("DateIssued"),
    )


US_CASE, US_DEATH = date(1994, 12, 1), date(1994, 12, 20)
POLICY_LIST = ["1-URGENT", "2-HIGH", "5-LOW"]
DELAY_SQL = (
    "pol AS (SELECT state AS s, o_orderpriority AS p, date AS d, rank() OVER (PARTITION BY state, o_orderpriority ORDER BY date) AS r FROM facts "
    "WHERE o_orderstatus = 'F' AND o_custkey % 2 = 1 AND o_orderpriority IN ('1-URGENT', '2-HIGH', '5-LOW')), "
    "dl AS (SELECT pol.s AS \"State\", avg(d - fc) AS ndays_first_case, avg(d - fd) AS ndays_first_death, avg(d - DATE '1994-12-01') AS ndays_first_uscase, avg(d - DATE '1994-12-20') AS ndays_first_usdeath "
    "FROM pol JOIN ff ON pol.s = ff.s WHERE r = 1 GROUP BY 1)"
)


def delay_table(facts, outbreak):
    return C.policy_delays(policy_rows(facts), outbreak, POLICY_LIST, US_CASE, US_DEATH)


@query(
    "L11_policy_delay_index",
    with_sql(FACTS_SQL, OUTBREAK_SQL, DELAY_SQL) + 'SELECT "State", ' + ", ".join(f"{sig_sql(c)} AS {c}" for c in DELAY_COLUMNS) + " FROM dl",
)
def l11(spark, sf):
    facts = facts_table(spark, sf)
    outbreak = materialize(C.outbreak_summary(*outbreak_inputs(facts)), "outbreak")
    return rounded(delay_table(facts, outbreak), DELAY_COLUMNS)


FIRST_COLS, SECOND_COLS = ["daily_distance_diff", "daily_visitation_diff", "encounters_rate"], ["m50_index"]


def mobility_sources(facts):
    d = state_days(facts)
    first = d.select(
        F.col("state").alias("State"), F.col("date").alias("Date"), F.col("disc").alias("daily_distance_diff"),
        F.col("tax").alias("daily_visitation_diff"), F.col("qty").alias("encounters_rate"),
    )
    second = d.filter(F.col("n") > 3).select(F.col("state").alias("State"), F.col("date").alias("Date"), F.col("price").alias("m50_index"))
    return first, second


MOB_SQL = (
    "fm AS (SELECT state AS \"State\", date AS \"Date\", " + ", ".join(f"({c} - avg({c}) OVER ()) / stddev_samp({c}) OVER () AS {n}" for c, n in (("disc", FIRST_COLS[0]), ("tax", FIRST_COLS[1]), ("qty", FIRST_COLS[2]))) + " FROM sday), "
    "sm AS (SELECT state AS \"State\", date AS \"Date\", (price - avg(price) OVER ()) / stddev_samp(price) OVER () AS m50_index FROM sday WHERE n > 3), "
    "mob AS (SELECT * FROM fm FULL JOIN sm USING (\"State\", \"Date\"))"
)


@query(
    "L12_merged_mobility",
    with_sql(FACTS_SQL, DAYS_SQL, MOB_SQL) + 'SELECT "State", "Date", ' + ", ".join(f"{sig_sql(c, 7, '1e-5')} AS {c}" for c in FIRST_COLS + SECOND_COLS) + " FROM mob",
)
def l12(spark, sf):
    a, b = mobility_sources(facts_table(spark, sf))
    return rounded(C.merged_mobility(a, b, FIRST_COLS, SECOND_COLS), FIRST_COLS + SECOND_COLS, 7, 1e-5)


BANDS = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
SENIOR = ["4-NOT SPECIFIED", "5-LOW"]


def cross_section(spark, sf):
    facts = facts_table(spark, sf)
    outbreak = materialize(C.outbreak_summary(*outbreak_inputs(facts)), "outbreak")
    a, b = mobility_sources(facts)
    return C.state_cross_section(
        materialize(I.population_shares(materialize(census(facts), "census")), "shares"),
        materialize(I.monthly_temperature(temperatures(facts)), "temperature"),
        I.swine_flu(swine_raw(facts)),
        I.influenza_deaths(influenza_raw(facts)),
        delay_table(facts, outbreak),
        C.merged_mobility(a, b, FIRST_COLS, SECOND_COLS),
        outbreak,
        BANDS,
        SENIOR,
        1996,
        1998,
        (date(1997, 4, 17), date(1997, 8, 11)),
        FIRST_COLS + SECOND_COLS,
    )


CROSS_REAL = [
    *BANDS, "65+", "Swineflu_Tavg", "Influenza_Tavg", "Swineflu_Case_Share", "Swineflu_Deaths_Share", "Influenza_Deaths_Share",
    *DELAY_COLUMNS, *FIRST_COLS, *SECOND_COLS, *SHARE_COLS,
]
CROSS_SQL = with_sql(
    FACTS_SQL, DAYS_SQL, SHARES_SQL, TEMP_SQL, FLU_SQL, SWINE_SQL, OUTBREAK_SQL, DELAY_SQL, MOB_SQL,
    "tot AS (SELECT \"State\", \"Year\", max(\"TotPop\") AS tp FROM shares GROUP BY 1, 2)",
    "ag AS (SELECT \"State\", " + ", ".join(f"sum(CASE WHEN \"AgeGroup\" = '{b}' THEN \"Population\" / \"TotPop\" END) AS \"{b}\"" for b in BANDS) + " FROM shares WHERE \"Year\" = 1996 GROUP BY 1)",
    "st AS (SELECT \"State\", avg(\"Tavg\") AS \"Swineflu_Tavg\" FROM temp WHERE \"Date\" BETWEEN DATE '1997-04-17' AND DATE '1997-08-11' GROUP BY 1)",
    "ft AS (SELECT \"State\", avg(\"Tavg\") AS \"Influenza_Tavg\" FROM temp WHERE year(\"Date\") = 1998 GROUP BY 1)",
    "sw AS (SELECT swine.*, \"Swineflu_Cases\" / tp AS \"Swineflu_Case_Share\", \"Swineflu_Deaths\" / tp AS \"Swineflu_Deaths_Share\" FROM swine JOIN tot USING (\"State\") WHERE \"Year\" = 1996)",
    "fs AS (SELECT \"State\", \"Influenza_Deaths\", \"Influenza_Deaths\" / tp AS \"Influenza_Deaths_Share\" FROM flu JOIN tot USING (\"State\", \"Year\") WHERE \"Year\" = 1998)",
    "nm AS (SELECT \"State\", " + ", ".join(f"avg({c}) AS {c}" for c in FIRST_COLS + SECOND_COLS) + " FROM mob JOIN ff ON s = \"State\" WHERE \"Date\" <= fc + 14 GROUP BY 1)",
    "x AS (SELECT *, \"4-NOT SPECIFIED\" + \"5-LOW\" AS \"65+\", " + ", ".join(f"\"{c}\" / \"Population\" AS \"{c}_Share\"" for c in ("Early_Deaths", "Early_Cases", "Corona_Cases", "Corona_Deaths"))
    + " FROM st JOIN ag USING (\"State\") JOIN ft USING (\"State\") JOIN sw USING (\"State\") JOIN fs USING (\"State\") JOIN dl USING (\"State\") JOIN nm USING (\"State\") JOIN ob USING (\"State\"))",
) + 'SELECT "State", "Swineflu_Cases", "Swineflu_Deaths", "Influenza_Deaths", "Population", "Corona_Cases", "Corona_Deaths", "Early_Deaths", "Early_Cases", ' + ", ".join(
    f"{sig_sql(f'\"{c}\"', 7, '1e-5')} AS \"{c}\"" for c in CROSS_REAL
) + " FROM x"


@query("L13_state_cross_section", CROSS_SQL)
def l13(spark, sf):
    out = cross_section(spark, sf)
    return out.withColumns({c: sig(F.col(f"`{c}`"), 7, 1e-5) for c in CROSS_REAL})


# -- L14–L18: panels --------------------------------------------------------------


@query(
    "L14_daily_policy_panel",
    with_sql(FACTS_SQL)[:-1]
    + ", f AS (SELECT state, " + ", ".join(f"min(CASE WHEN o_orderpriority = '{p}' AND o_orderstatus = 'F' THEN date END) AS \"m{i}\"" for i, p in enumerate(POLICY_LIST))
    + " FROM facts GROUP BY 1), c AS (SELECT CAST(unnest(generate_series(DATE '1995-01-01', DATE '1995-04-02', INTERVAL 1 DAY)) AS DATE) AS date) SELECT date, state, "
    + ", ".join(f"CAST(coalesce(date >= m{i}, false) AS INTEGER) AS \"{p}\"" for i, p in enumerate(POLICY_LIST)) + " FROM f CROSS JOIN c",
)
def l14(spark, sf):
    rows = policy_rows(order_facts(spark, sf)).withColumnsRenamed({"State": "StateName", "DateIssued": "DateEnacted"})
    return P.policy_panel(rows, POLICY_LIST, date(1995, 1, 1), date(1995, 4, 2))


def country_tables(spark, sf):
    c = table(spark, sf, "customer")
    per = order_facts(spark, sf).groupBy(F.col("o_custkey").alias("c_custkey")).agg(
        F.count(F.lit(1)).alias("k"), F.sum("n").alias("n"), F.round(F.sum("price"), 2).alias("p"), F.sum("qty").alias("q"),
        F.round(F.sum("disc"), 2).alias("disc"),
    )
    j = materialize(c.join(per, ["c_custkey"]).select(F.col("c_name").alias("country"), "c_acctbal", "c_custkey", "k", "n", "p", "q", "disc"), "countries")
    health = j.select("country", F.col("p").alias("hqi"))
    return (
        j.select("country", F.col("c_acctbal").alias("covid_safety")),
        j.select("country", F.col("n").cast("double").alias("pop_thousands"), safe_div("disc", "q").alias("infection_deaths")),
        union_all([health, health, health.filter(F.col("hqi") > 2e5).withColumn("hqi", F.col("hqi") + 1)]),
        j.select("country", F.col("q").alias("covid_infections")),
        j.filter(F.col("k") > 2).select("country", F.col("k").alias("covid_deaths")),
        j.select("country", (F.col("p") / F.col("n")).alias("gdp_per_capita")),
    )


COUNTRY_SQL = with_sql(
    FACTS_SQL,
    "j AS (SELECT c_name AS country, c_acctbal, count(*) AS k, sum(n) AS n, round(sum(price), 2) AS p, sum(qty) AS q, round(sum(disc), 2) AS dsc FROM facts JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2)",
    "m AS (SELECT country, c_acctbal AS covid_safety, n::DOUBLE AS pop_thousands, dsc / q AS infection_deaths, p AS hqi, q AS covid_infections, k AS covid_deaths, p / n AS gdp_per_capita FROM j WHERE k > 2)",
)


@query(
    "L15_country_cross_section",
    COUNTRY_SQL
    + "SELECT country, covid_safety, pop_thousands, hqi, covid_infections, covid_deaths, "
    + ", ".join(
        f"{sig_sql(e, 7, '1e-5')} AS {n}"
        for n, e in (
            ("infection_deaths", "infection_deaths"),
            ("gdp_per_capita", "gdp_per_capita"),
            ("normalized_safety", "(covid_safety - avg(covid_safety) OVER ()) / stddev_samp(covid_safety) OVER ()"),
            ("normalized_hqi", "(hqi - avg(hqi) OVER ()) / stddev_samp(hqi) OVER ()"),
            ("log_deaths", "CASE WHEN infection_deaths > 0 THEN ln(10000 * infection_deaths) END"),
            ("log_covid_deaths", "ln(10000.0 * covid_deaths / (pop_thousands * 1000))"),
            ("log_covid_infections", "ln(10000.0 * covid_infections / (pop_thousands * 1000))"),
        )
    )
    + " FROM m",
)
def l15(spark, sf):
    out = C.country_cross_section(*country_tables(spark, sf))
    real = ["infection_deaths", "gdp_per_capita", "normalized_safety", "normalized_hqi", "log_deaths", "log_covid_deaths", "log_covid_infections"]
    return rounded(out, real, 7, 1e-5)


WEEK_BASE = [
    FACTS_SQL,
    DAYS_SQL,
    f"wk AS (SELECT *, CAST(year(date) AS INTEGER) AS y, {week_sql('date')} AS w FROM sday)",
    "base AS (SELECT state, y, w, avg(qty) AS dth, avg(n) AS inf, min(date) AS date, sum(qty) AS tm, sum(n)::DOUBLE AS cm, avg(1 + disc / 7) AS ud, avg(1 + tax / 7) AS uv, "
    "avg(CASE WHEN dayofyear(date) % 2 = 0 THEN price / 1e5 END) AS tw, avg(price / 1e4) AS dl, avg(qty) AS rain, " + ", ".join(f"max(CASE WHEN qty > {40 * i} THEN 1 ELSE 0 END) AS p{i}" for i in range(1, 8)) + " FROM wk GROUP BY 1, 2, 3)",
    "us AS (SELECT y, w, sum(tm) AS us_t, sum(cm) AS us_c FROM base GROUP BY 1, 2)",
    "pop AS (SELECT state, sum(o_custkey)::BIGINT AS population FROM (SELECT DISTINCT state, o_custkey FROM facts) GROUP BY 1)",
]


def zs(c, by="state"):
    return f"({c} - avg({c}) OVER (PARTITION BY {by})) / stddev_samp({c}) OVER (PARTITION BY {by})"


PANEL_REAL = {
    "COVID_mortality": "dth",
    "COVID_infections": "inf",
    "COVID_mortality_frac": "cm / tm",
    "una_pct_distance": "ud / lag(ud) OVER o - 1",
    "una_log_distance": "ln(ud) - ln(lag(ud) OVER o)",
    "una_pct_visitation": "uv / lag(uv) OVER o - 1",
    "una_log_visitation": "ln(uv) - ln(lag(uv) OVER o)",
    "una_distance": zs("ud"),
    "una_visitation": zs("uv"),
    "twitter_social_distancing": zs("tw"),
    "dl_mobility": zs("dl"),
    "avg_precip": "rain",
}


@query(
    "L17_state_week_panel",
    with_sql(*WEEK_BASE)
    + "SELECT state, y AS year, w AS week, date, population, us_c AS \"US_COVID_mortality\", us_t AS \"US_total_mortality\", CAST(dense_rank() OVER (ORDER BY state) AS INTEGER) AS state_id, "
    + ", ".join(f"CAST(p{i} AS INTEGER) AS \"{p}\"" for i, p in enumerate(P.POLICIES, start=1)) + ", "
    + ", ".join(f"{sig_sql(e, 7, '1e-5')} AS \"{n}\"" for n, e in PANEL_REAL.items())
    + " FROM base JOIN us USING (y, w) JOIN pop USING (state) WINDOW o AS (PARTITION BY state ORDER BY y, w)",
)
def l17(spark, sf):
    return rounded(P.state_week_panel(**stand_ins(spark, sf)), list(PANEL_REAL), 7, 1e-5)


DAY_REAL = {
    "una_distance": zs("1 + disc / 7"),
    "una_visitation": zs("1 + tax / 7"),
    "dl_mobility": zs("price / 1e4"),
}


@query(
    "L18_state_day_panel",
    with_sql(
        FACTS_SQL,
        DAYS_SQL,
        WEEK_BASE[-1],
        "tz AS (SELECT state, date, " + zs("price / 1e5") + " AS z FROM sday WHERE dayofyear(date) % 2 = 0)",
    )
    + f"SELECT state, date, CAST(year(date) AS INTEGER) AS year, {week_sql('date')} AS week, qty AS \"COVID_mortality\", n AS \"COVID_infections\", population, n AS state_population, qty AS avg_precip, "
    "CAST(dense_rank() OVER (ORDER BY state) AS INTEGER) AS state_id, "
    + ", ".join(f"CAST(CASE WHEN qty > {40 * i} THEN 1 ELSE 0 END AS INTEGER) AS \"{p}\"" for i, p in enumerate(P.POLICIES, start=1)) + ", "
    + ", ".join(f"{sig_sql(e, 7, '1e-5')} AS {n}" for n, e in DAY_REAL.items())
    + ", " + sig_sql("last_value(z IGNORE NULLS) OVER (PARTITION BY state ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)", 7, "1e-5") + " AS twitter_social_distancing"
    + " FROM sday LEFT JOIN tz USING (state, date) JOIN pop USING (state)",
)
def l18(spark, sf):
    parts = stand_ins(spark, sf)
    parts.pop("mortality")
    return rounded(P.state_day_panel(**parts), [*DAY_REAL, "twitter_social_distancing"], 7, 1e-5)


YEAR_WEEK = (
    *WEEK_BASE[:-1],
    "g AS (SELECT state, y, w, date, n, disc / 7 AS a, tax / 7 AS b, row_number() OVER (PARTITION BY state, y, w ORDER BY date) AS rn FROM wk)",
    "ch AS (SELECT state, y, w, exp(sum(CASE WHEN rn = 1 THEN 0 ELSE ln(1 + a) END)) - 1 AS da, exp(sum(CASE WHEN rn = 1 THEN 0 ELSE ln(1 + b) END)) - 1 AS db, avg(n) AS sp FROM g GROUP BY 1, 2, 3)",
    "zc AS (SELECT state, y, w, sp, (da - avg(da) OVER ()) / stddev_samp(da) OVER () AS distance_diff, (db - avg(db) OVER ()) / stddev_samp(db) OVER () AS visitation_diff FROM ch)",
    "tw AS (SELECT state, y, w, (tw - avg(tw) OVER ()) / stddev_samp(tw) OVER () AS tz FROM base WHERE tw IS NOT NULL)",
    "m AS (SELECT state, y, w, cm, tm, cm / tm AS fr, us_c, us_t, us_c / us_t AS uf, distance_diff, visitation_diff, sp, tz FROM base JOIN us USING (y, w) JOIN zc USING (state, y, w) LEFT JOIN tw USING (state, y, w))",
    "bk AS (SELECT *, lag(fr) OVER o * (uf - lag(uf) OVER o) / lag(uf) OVER o + (1 - lag(fr) OVER o) * (lag(uf) OVER o - uf) / (1 - lag(uf) OVER o) AS bartik FROM m WINDOW o AS (PARTITION BY state ORDER BY y, w))",
)


@query(
    "L16_state_year_week",
    with_sql(*YEAR_WEEK)
    + "SELECT state, y AS year, w AS week, tm AS total_mortality, cm AS \"COVID_mortality\", us_t AS \"US_total_mortality\", us_c AS \"US_COVID_mortality\", 3 AS _merge, CAST(dense_rank() OVER (ORDER BY state) AS INTEGER) AS state_id, "
    + ", ".join(
        f"{sig_sql(e, 5, '1e-5')} AS \"{n}\""
        for n, e in {
            "COVID_mortality_frac": "fr",
            "US_COVID_mortality_frac": "uf",
            "state_population": "sp",
            "twitter_social_distancing": "tz",
            "distance_diff": "distance_diff",
            "visitation_diff": "visitation_diff",
            "bartik": "bartik",
            "COVID_per_capita": "cm / sp",
            "lagged_twitter": "lag(tz) OVER o",
            "lagged_dist": "lag(distance_diff) OVER o",
            "lagged_visit": "lag(visitation_diff) OVER o",
            "lagged_bartik": "lag(bartik) OVER o",
        }.items()
    )
    + " FROM bk WINDOW o AS (PARTITION BY state ORDER BY y, w)",
)
def l16(spark, sf):
    parts = stand_ins(spark, sf)
    out = P.state_year_week(parts["mortality"], parts["twitter"], parts["mobility"])
    real = [
        "COVID_mortality_frac", "US_COVID_mortality_frac", "state_population", "twitter_social_distancing", "distance_diff",
        "visitation_diff", "bartik", "COVID_per_capita", "lagged_twitter", "lagged_dist", "lagged_visit", "lagged_bartik",
    ]
    return rounded(out, real, 5, 1e-5)


def _ols_hc1(name, y, x, src="l"):
    """(sql, CTEs) of a slope and its HC1 variance."""
    rows = f"(SELECT {y} AS y, {x} AS x FROM {src} WHERE {y} IS NOT NULL AND {x} IS NOT NULL)"
    return (
        f"{name}_b AS (SELECT count(*) AS n, avg(x) AS xm, regr_sxx(y, x) AS sxx, regr_slope(y, x) AS b, regr_intercept(y, x) AS a FROM {rows})",
        f"{name} AS (SELECT max(b) AS b, max(n) / (max(n) - 2.0) * sum(pow((x - xm) * (y - a - b * x), 2)) / max(sxx * sxx) AS v FROM {rows}, {name}_b)",
    )


def _iv_hc0(name, y, x, zs_, src="l"):
    """CTEs of a two-stage slope and its HC0 variance; several instruments are made orthogonal in turn."""
    keep = " AND ".join(f"{c} IS NOT NULL" for c in (y, x, *zs_))
    cols = ", ".join(f"{c} - avg({c}) OVER () AS {n}" for c, n in ((y, "y"), (x, "x"), *((z, f"z{i}") for i, z in enumerate(zs_))))
    out = [f"{name}_0 AS (SELECT {cols} FROM {src} WHERE {keep})"]
    k = len(zs_)
    for i in range(1, k):
        less = " ".join(f"- (SELECT sum(z{i} * z{j}) / sum(z{j} * z{j}) FROM {name}_{i - 1}) * z{j}" for j in range(i))
        kept = ", ".join(["y", "x", *(f"z{j}" for j in range(k) if j != i)])
        out.append(f"{name}_{i} AS (SELECT {kept}, z{i} {less} AS z{i} FROM {name}_{i - 1})")
    hat = " + ".join(f"(SELECT sum(x * z{j}) / sum(z{j} * z{j}) FROM {name}_{k - 1}) * z{j}" for j in range(k))
    out.append(f"{name}_h AS (SELECT y, x, {hat} AS h FROM {name}_{k - 1})")
    out.append(f"{name}_b AS (SELECT sum(h * y) / sum(h * x) AS b, sum(h * x) AS hx FROM {name}_h)")
    out.append(f"{name} AS (SELECT max(b) AS b, sum(pow(h * (y - b * x), 2)) / max(hx * hx) AS v FROM {name}_h, {name}_b)")
    return tuple(out)


def _year_week_sql():
    lags = {"lt": "tz", "ld": "distance_diff", "lv": "visitation_diff", "lb": "bartik"}
    ctes = ["l AS (SELECT *, " + ", ".join(f"lag({c}) OVER o AS {n}" for n, c in lags.items()) + " FROM bk WINDOW o AS (PARTITION BY state ORDER BY y, w))"]
    named = {"twitter": ("lt", "lagged_twitter"), "dist": ("ld", "lagged_dist"), "visit": ("lv", "lagged_visit")}
    now = {"twitter": ("tz", "twitter_social_distancing"), "dist": ("distance_diff", "distance_diff"), "visit": ("visitation_diff", "visitation_diff")}
    rows = []

    def add(model, term, made):
        ctes.extend(made)
        rows.append(f"SELECT '{model}' AS model_id, '{term}' AS term, {sig_sql('b', 6)} AS estimate, {sig_sql('sqrt(v)', 6)} AS std_error FROM m_{model}")

    for k, (c, label) in named.items():
        add(f"endogenous_{k}", label, _ols_hc1(f"m_endogenous_{k}", "fr", c))
    add("reduced_form", "lagged_bartik", _ols_hc1("m_reduced_form", "fr", "lb"))
    for k, (c, _) in now.items():
        add(f"first_stage_{k}", "bartik", _ols_hc1(f"m_first_stage_{k}", c, "bartik"))
    add("iv_twitter", "lagged_twitter", _iv_hc0("m_iv_twitter", "fr", "lt", ["lb", "ld", "lv"]))
    for k in ("dist", "visit"):
        add(f"iv_{k}", named[k][1], _iv_hc0(f"m_iv_{k}", "fr", named[k][0], ["lb"]))
    return with_sql(*YEAR_WEEK, *ctes) + " UNION ALL ".join(rows)


@query("L16_state_year_week_suite", _year_week_sql())
def l16_suite(spark, sf):
    parts = stand_ins(spark, sf)
    panel = P.state_year_week(parts["mortality"], parts["twitter"], parts["mobility"])
    out = S.state_year_week_suite(materialize(panel, "year-week")).coefficients.filter("term <> '_cons'")
    return out.select("model_id", "term", sig("estimate", 6).alias("estimate"), sig("std_error", 6).alias("std_error"))


# -- L19–L25: model suites ----------------------------------------------------------


def week_panel(spark, sf):
    return materialize(P.state_week_panel(**stand_ins(spark, sf)), "week-panel")


def estimates(coefs, digits=6, zero=1e-9):
    """(model_id, term, estimate, std_error) as far as they agree between any two ways of summing."""
    return coefs.select("model_id", "term", sig("estimate", digits, zero).alias("estimate"), sig("std_error", digits, zero).alias("std_error"))


WEEK_PANEL_SQL = [
    *WEEK_BASE,
    "panel AS MATERIALIZED (SELECT state, y AS year, w AS week, date, population, us_c AS \"US_COVID_mortality\", us_t AS \"US_total_mortality\", "
    "CAST(dense_rank() OVER (ORDER BY state) AS INTEGER) AS state_id, dth / population AS \"COVID_mortality_pc\", inf / population AS \"COVID_infections_pc\", "
    + zs("tw") + " AS twitter_sd, " + ", ".join(f"p{i} AS \"{p}\"" for i, p in enumerate(P.POLICIES, start=1)) + ", "
    + ", ".join(f"{e} AS \"{n}\"" for n, e in PANEL_REAL.items())
    + " FROM base JOIN us USING (y, w) JOIN pop USING (state) WINDOW o AS (PARTITION BY state ORDER BY y, w))",
]
WEEKLY_SQL = [*WEEK_PANEL_SQL, Q.features("f", "panel", Q.panel_features(S.WEEKLY_VARS, 5), "state", "date")]
WEEKLY_PARTS = S.weekly_specs()
EQUAL = ("d_COVID_mortality_pc", ("d_dl_mobility_m3", "d_una_distance_m3"), "d_avg_precip_m3", S.weekly_controls(), "state_id")


def _weekly_suite_sql():
    more, tag, spec = Q.equality_ctes("f", *EQUAL)
    test = Q.alone(more, [f"SELECT 'equality', 'number=1:both = number=2:both', {Q.sig(Q.equality_statistic(tag, spec), 5)}, NULL"])
    return Q.union(WEEKLY_SQL, [*Q.model_rows("f", [s for part in WEEKLY_PARTS.values() for s in part], digits=5), test])


@query("L19_weekly_model_suite", _weekly_suite_sql())
def l19(spark, sf):
    """Every model's estimates and errors; the row ``equality`` has the statistic of the test that two measures act alike."""
    suite = S.weekly_suite(S.weekly_features(week_panel(spark, sf)))
    parts = [suite.first_stage, suite.second_stage, suite.two_lag, suite.attenuation]
    out = coefficients(spark, [f for p in parts for f in p.fits])
    test = tests_table(spark, [suite.equality]).select(F.lit("equality").alias("model_id"), F.col("test").alias("term"), F.col("statistic").alias("estimate"))
    return estimates(out.unionByName(test, allowMissingColumns=True), 5)


def _long(tables):
    """The cells of coefficient tables, one per row."""
    parts = []
    for name, t in tables.items():
        ids = [c for c in t.columns if c not in ("row", "label")]
        parts.append(t.unpivot(["row", "label"], ids, "model_id", "cell").where("cell IS NOT NULL").select(F.lit(name).alias("tab"), "row", "label", "model_id", "cell"))
    return union_all(parts)


def _weekly_tables_sql():
    specs, parts = [s for part in WEEKLY_PARTS.values() for s in part], []
    for name, (order, style, ids) in S.weekly_tables(WEEKLY_PARTS).items():
        parts += Q.table_rows("f", [s for s in specs if s.name in ids], name, order, style)
    return Q.union([*WEEKLY_SQL, Q.CRITICAL], parts)


@query("L19_weekly_tables", _weekly_tables_sql())
def l19_tables(spark, sf):
    return _long(S.weekly_suite(S.weekly_features(week_panel(spark, sf))).tables())


def _first_stage_sql():
    parts = []
    for m, c in (("d_dl_mobility", "dl"), ("d_una_distance", "ud")):
        parts.append(
            f"SELECT 'b_{m}' AS model_id, 'd_avg_precip' AS term, {sig_sql(f'sum(r * {c}) / sum(r * r)', 6)} AS estimate FROM "
            f"(SELECT r - avg(r) OVER (PARTITION BY state) AS r, {c} - avg({c}) OVER (PARTITION BY state) AS {c} FROM f WHERE r IS NOT NULL AND {c} IS NOT NULL)"
        )
    return (
        with_sql(
            *WEEK_BASE[:-2],
            f"zz AS (SELECT state, y, w, rain, {zs('dl')} AS dl, {zs('ud')} AS ud FROM base)",
            "f AS (SELECT state, rain - lag(rain) OVER o AS r, dl - lag(dl) OVER o AS dl, ud - lag(ud) OVER o AS ud FROM zz WINDOW o AS (PARTITION BY state ORDER BY y, w))",
        )
        + " UNION ALL ".join(parts)
    )


@query("L19_weekly_first_stages", _first_stage_sql())
def l19_first(spark, sf):
    features = S.weekly_features(week_panel(spark, sf), lags=1)
    specs = S.G.first_stage_specs(S.MEASURES[:2], "d_avg_precip", ["EmergDec", "GathRestrictAny", "d_COVID_mortality_pc_m1"], "state_id", "week")
    out = S.G.run_grid(features, specs).coefficients.filter(F.col("model_id").startswith("b_") & (F.col("term") == "d_avg_precip"))
    return out.select("model_id", "term", sig("estimate", 6).alias("estimate"))


def _first_stage_f_sql():
    ctes, parts = [], []
    for m, c in (("d_dl_mobility", "dl"), ("d_una_distance", "ud")):
        src = f"(SELECT state, r - avg(r) OVER (PARTITION BY state) AS r, {c} - avg({c}) OVER (PARTITION BY state) AS x FROM f WHERE r IS NOT NULL AND {c} IS NOT NULL)"
        ctes += [
            f"{c}_w AS {src}",
            f"{c}_m AS (SELECT count(*) AS n, count(DISTINCT state) AS g, sum(r * x) / sum(r * r) AS b, sum(r * r) AS sxx FROM {c}_w)",
            f"{c}_s AS (SELECT state, sum(r * (x - b * r)) AS s FROM {c}_w, {c}_m GROUP BY 1)",
            f"{c}_v AS (SELECT max(b) AS b, max(g) / (max(g) - 1.0) * (max(n) - 1.0) / (max(n) - max(g) - 1.0) * sum(s * s) / max(sxx * sxx) AS v, max(g) - 1 AS df FROM {c}_s, {c}_m)",
        ]
        parts.append(f"SELECT 'b_{m}' AS model_id, round(b * b / v, 3) AS f, 1 AS df1, CAST(df AS DOUBLE) AS df2 FROM {c}_v")
    return (
        with_sql(
            *WEEK_BASE[:-2],
            f"zz AS (SELECT state, y, w, rain, {zs('dl')} AS dl, {zs('ud')} AS ud FROM base)",
            "f AS (SELECT state, rain - lag(rain) OVER o AS r, dl - lag(dl) OVER o AS dl, ud - lag(ud) OVER o AS ud FROM zz WINDOW o AS (PARTITION BY state ORDER BY y, w))",
            *ctes,
        )
        + " UNION ALL ".join(parts)
    )


@query("L19_first_stage_f", _first_stage_f_sql())
def l19_f(spark, sf):
    """F of rain in the entity-effect first stages, clustered by state."""
    features = S.weekly_features(week_panel(spark, sf), lags=1)
    specs = S.G.first_stage_specs(S.MEASURES[:2], "d_avg_precip", ["EmergDec", "GathRestrictAny", "d_COVID_mortality_pc_m1"], "state_id", "week")
    grid = S.G.run_grid(features, [m for m in specs if m.name.startswith("b_")])
    return S.G.f_statistics(grid, "d_avg_precip").select("model_id", "f", "df1", "df2")


@query("L19_first_stage_f_list", Q.union(WEEKLY_SQL, Q.f_rows("f", WEEKLY_PARTS["first_stage"], "d_avg_precip")))
def l19_f_list(spark, sf):
    """F of rain in every first stage: three measures by four models, clustered by state."""
    features = S.weekly_features(week_panel(spark, sf), lags=1)
    specs = S.G.first_stage_specs(S.MEASURES, "d_avg_precip", ["EmergDec", "GathRestrictAny", "d_COVID_mortality_pc_m1"], "state_id", "week")
    return S.G.f_statistics(S.G.run_grid(features, specs), "d_avg_precip").select("model_id", "f", "df1", "df2")


DAILY_SQL = [
    FACTS_SQL,
    DAYS_SQL,
    WEEK_BASE[-1],
    "tz AS (SELECT state, date, " + zs("price / 1e5") + " AS z FROM sday WHERE dayofyear(date) % 2 = 0)",
    "dp AS (SELECT state, date, population, qty AS \"COVID_mortality\", qty / population AS \"COVID_mortality_pc\", qty AS precip, CAST(dense_rank() OVER (ORDER BY state) AS INTEGER) AS state_id, "
    + ", ".join(f"CASE WHEN qty > {40 * i} THEN 1 ELSE 0 END AS \"{p}\"" for i, p in enumerate(P.POLICIES, start=1))
    + f", {DAY_REAL['una_distance']} AS una, {DAY_REAL['dl_mobility']} AS dl, last_value(z IGNORE NULLS) OVER (PARTITION BY state ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS twit"
    " FROM sday LEFT JOIN tz USING (state, date) JOIN pop USING (state))",
    Q.features(
        "f0", "dp",
        {f"d_{c}": f"{Q.lag(c, 0)} - {Q.lag(c, 1)}" for c in ("precip", "una", "dl", "twit", "COVID_mortality_pc")}
        | {"d_log_COVID_mortality": "ln(CASE WHEN \"COVID_mortality\" > 0 THEN \"COVID_mortality\" END) - ln(CASE WHEN lag(\"COVID_mortality\") OVER o > 0 THEN lag(\"COVID_mortality\") OVER o END)"}
        | {f"d_{c}_m{k}": f"({Q.lag(c, k)} - {Q.lag(c, k + 1)}) / 100000.0" for c in ("una", "dl", "twit") for k in (1, 2)}
        | {f"d_precip_m{k}": f"{Q.lag('precip', k)} - {Q.lag('precip', k + 1)}" for k in (1, 2)}
        | {f"d_COVID_mortality_pc_m{k}": f"{Q.lag('COVID_mortality_pc', k)} - {Q.lag('COVID_mortality_pc', k + 1)}" for k in (1, 2, 3)}
        | {f"{c}_m1": Q.lag(c, 1) for c in ("precip", "COVID_mortality_pc")},
        "state", "date",
    ),
    Q.features("f", "f0", {"d_log_COVID_mortality_m1": Q.lag("d_log_COVID_mortality", 1)}, "state", "date"),
]
DAILY_POWERS = {f"{c}^2": f'"{c}" * "{c}"' for c in ("d_precip", "d_log_COVID_mortality_m1")}


def daily(spark, sf):
    parts = stand_ins(spark, sf)
    parts.pop("mortality")
    return S.daily_suite(S.daily_features(P.state_day_panel(**parts)))


@query("L20_daily_model_suite", Q.union(DAILY_SQL, Q.model_rows("f", S.daily_specs(), DAILY_POWERS, 5)))
def l20(spark, sf):
    return estimates(daily(spark, sf)[0].coefficients, 5)


DAILY_TABLE = S.daily_table()


@query("L20_daily_table", Q.union([*DAILY_SQL, Q.CRITICAL], Q.table_rows("f", [s for s in S.daily_specs() if s.name in DAILY_TABLE[1]], "daily", DAILY_TABLE[0], "f")))
def l20_table(spark, sf):
    """Cells of the second-stage table at a delay of two days."""
    return _long({"daily": daily(spark, sf)[1]})


def _reduced_sql():
    out = []
    for k in (1, 2):
        out.append(
            f"SELECT 'reduced_b_d_precip_m{k}' AS model_id, 'd_precip_m{k}' AS term, {sig_sql('sum(x * yy) / sum(x * x)', 6)} AS estimate FROM "
            f"(SELECT yy - avg(yy) OVER (PARTITION BY state) AS yy, x{k} - avg(x{k}) OVER (PARTITION BY state) AS x FROM f WHERE yy IS NOT NULL AND x{k} IS NOT NULL)"
        )
    lag = "lag(qty, {0}) OVER o"
    return (
        with_sql(
            FACTS_SQL,
            DAYS_SQL,
            WEEK_BASE[-1],
            "f AS (SELECT state, (qty - lag(qty) OVER o) / population AS yy, "
            + ", ".join(f"{lag.format(k)} - {lag.format(k + 1)} AS x{k}" for k in (1, 2))
            + " FROM sday JOIN pop USING (state) WINDOW o AS (PARTITION BY state ORDER BY date))",
        )
        + " UNION ALL ".join(out)
    )


@query("L20_daily_reduced_forms", _reduced_sql())
def l20_reduced(spark, sf):
    parts = stand_ins(spark, sf)
    parts.pop("mortality")
    features = S.daily_features(P.state_day_panel(**parts))
    specs = [m for m in S.daily_specs() if m.name in ("reduced_b_d_precip_m1", "reduced_b_d_precip_m2")]
    out = S.G.run_grid(features, specs).coefficients.filter(F.col("term").startswith("d_precip"))
    return out.select("model_id", "term", sig("estimate", 6).alias("estimate"))


HAT_LAGS = [f"hat_resid_m{k}" for k in (1, 2, 3, 4)]


def _lag_selection_ctes():
    trend = {"entity": "state_id", "trend": ("week", 2)}
    policies = ["EmergDec", "GathRestrictAny"]
    keys = {"s_": "state", "d_": "date"}
    first, _ = Q.fit_ctes("p", "f", S.ModelSpec("projection", "d_dl_mobility", ["d_avg_precip", *policies], **trend), carry=keys | {"m_": "d_dl_mobility"})
    second, _ = Q.fit_ctes("r", "h1", S.ModelSpec("partial", "hat", policies, **trend), carry=keys)
    return [
        *WEEKLY_SQL,
        *first,
        "h1 AS MATERIALIZED (SELECT f.*, m_ - u AS hat FROM f LEFT JOIN p_u ON s_ = state AND d_ = date)",
        *second,
        "h2 AS MATERIALIZED (SELECT state, date, \"COVID_mortality_pc\", u AS hat_resid FROM f LEFT JOIN r_u ON s_ = state AND d_ = date)",
        Q.features("h3", "h2", {f"hat_resid_m{k}": Q.lag("hat_resid", k) for k in (1, 2, 3, 4)}, "state", "date"),
        Z.standardized("z", "h3", '"COVID_mortality_pc"', HAT_LAGS, ["state", "date"]),
        "zf AS (SELECT *, (dayofyear(date) + length(state)) % 10 AS fold FROM z)",
    ]


def lag_selection(spark, sf):
    panel = S.weekly_features(week_panel(spark, sf), lags=1, variables=["COVID_mortality_pc", "avg_precip", "dl_mobility"])
    fold = F.pmod(F.dayofyear("date") + F.length("state"), F.lit(10)).cast("int")
    return S.lag_selection(panel, "d_dl_mobility", "d_avg_precip", ["EmergDec", "GathRestrictAny"], "COVID_mortality_pc", fold=fold)


# The outcome is a small share: estimates are compared down to 1e-12.
@query("L21_lag_selection", Z.selected_sql(_lag_selection_ctes(), "zf", '"COVID_mortality_pc"', HAT_LAGS, 10, 4, "1e-12"))
def l21(spark, sf):
    """Folds are dealt by a column, so that SQL can deal them too."""
    real = {"lambda_1se": 6, "estimate": 4, "lambda_min": 6, "estimate_min": 4}
    return lag_selection(spark, sf)[0].selected(spark).withColumns({c: sig(c, d, 1e-9 if d == 6 else 1e-12) for c, d in real.items()})


@query("L21_lasso_path", Z.path_sql(_lag_selection_ctes(), "z", '"COVID_mortality_pc"', HAT_LAGS, 4, "1e-12"))
def l21_path(spark, sf):
    """The path itself, one row per step and lag."""
    out = lag_selection(spark, sf)[1].table(spark)
    return out.select("step", sig("lambda", 6).alias("lambda"), "term", sig("estimate", 4, 1e-12).alias("estimate"))


COUNTRY_ROWS = (
    COUNTRY_SQL[5:-1]
    + ", f AS MATERIALIZED (SELECT *, (covid_safety - avg(covid_safety) OVER ()) / stddev_samp(covid_safety) OVER () AS normalized_safety, (hqi - avg(hqi) OVER ()) / stddev_samp(hqi) OVER () AS normalized_hqi, "
    "CASE WHEN infection_deaths > 0 THEN ln(10000 * infection_deaths) END AS log_deaths, ln(10000.0 * covid_deaths / (pop_thousands * 1000)) AS log_covid_deaths, "
    "ln(10000.0 * covid_infections / (pop_thousands * 1000)) AS log_covid_infections FROM m)"
)
POWERS = {f"{c}^{d}": f"pow({c}, {d})" for c in ("log_deaths", "pop_thousands") for d in (2, 3, 4)}


def _country_sql():
    specs, tested = S.country_specs(), ["log_deaths", "log_deaths^2", "log_deaths^3"]
    final = next(s for s in specs if s.name == "fs_final")
    made, tag = Q.fit_ctes("m", "f", final, POWERS)
    joint = Q.alone(made, [f"SELECT 'fs_final', '{' '.join(tested)}', {Q.sig(Q.joint_statistic(tag, final, tested), 4)}, NULL"])
    return Q.union([COUNTRY_ROWS], [*Q.model_rows("f", specs, POWERS, 4), joint])


@query("L22_country_iv_suite", _country_sql())
def l22(spark, sf):
    """Every model's estimates and errors; the last row has the statistic of the joint test of the powers."""
    grid, joint = S.country_suite(materialize(C.country_cross_section(*country_tables(spark, sf)), "countries"))
    test = tests_table(spark, [joint]).select(F.lit("fs_final").alias("model_id"), F.col("test").alias("term"), F.col("statistic").alias("estimate"))
    return estimates(grid.coefficients.unionByName(test, allowMissingColumns=True), 4)


@query(
    "L22_country_first_stage",
    COUNTRY_SQL[:-1]
    + ", z AS (SELECT (covid_safety - avg(covid_safety) OVER ()) / stddev_samp(covid_safety) OVER () AS s, CASE WHEN infection_deaths > 0 THEN ln(10000 * infection_deaths) END AS d FROM m), "
    "b AS (SELECT regr_count(s, d) AS n, regr_sxx(s, d) AS sxx, regr_avgx(s, d) AS xm, regr_slope(s, d) AS b, regr_intercept(s, d) AS a FROM z) "
    f"SELECT 'fs_1' AS model_id, {sig_sql('max(b)', 5)} AS estimate, {sig_sql('sqrt(max(n) / (max(n) - 2.0) * sum(pow((d - xm) * (s - a - b * d), 2))) / max(sxx)', 5)} AS std_error FROM z, b",
)
def l22_first(spark, sf):
    cross = materialize(C.country_cross_section(*country_tables(spark, sf)), "countries")
    out = S.G.run_grid(cross, [m for m in S.country_specs() if m.name == "fs_1"]).coefficients.filter(F.col("term") == "log_deaths")
    return out.select("model_id", sig("estimate", 5).alias("estimate"), sig("std_error", 5).alias("std_error"))


def _search_sql():
    two = Q.two_way("f", S.two_way_spec(), "week", range(1, 53), 5)
    return Q.union(WEEKLY_SQL, [*Q.model_rows("f", S.weekly_search_specs(), {"week^2": "week * week"}, 5), two])


@query("L23_weekly_specification_search", _search_sql())
def l23(spark, sf):
    """All models of the search, and the first stage with entity and week effects."""
    return estimates(S.weekly_search(S.weekly_features(week_panel(spark, sf))).coefficients, 5)


_FLU = 'ln(CASE WHEN "Influenza_Deaths_Share" > 0 THEN "Influenza_Deaths_Share" END)'
CROSS_TERMS = {"log_flu": _FLU, "log_flu^2": f"{_FLU} * {_FLU}", "log_delay": "ln(CASE WHEN ndays_first_uscase > 0 THEN CAST(ndays_first_uscase AS DOUBLE) END)"}


def _state_iv_sql():
    rows = CROSS_SQL.rpartition(' SELECT "State", "Swineflu_Cases"')[0].removeprefix("WITH ")
    specs = S.state_iv_specs()
    tests = Q.robust_iv_tests("x", next(s for s in specs if s.name == "iv"), CROSS_TERMS, 4)
    return Q.union([rows], [*Q.model_rows("x", specs, CROSS_TERMS, 4), f"SELECT 'iv', test, statistic, NULL FROM ({tests})"])


@query("L24_state_iv_suite", _state_iv_sql())
def l24(spark, sf):
    """Every model's estimates and errors, and the statistics of the two-stage model's robust diagnostics."""
    grid, tests = S.state_iv_suite(materialize(cross_section(spark, sf), "cross"))
    rows = tests_table(spark, tests).select(F.lit("iv").alias("model_id"), F.col("test").alias("term"), F.col("statistic").alias("estimate"))
    return estimates(grid.coefficients.unionByName(rows, allowMissingColumns=True), 4)


SHIFT_SHARE_SQL = [
    *WEEK_PANEL_SQL,
    Q.features(
        "f1", "panel",
        {
            "bartik": 'CASE WHEN lag("COVID_mortality_frac") OVER o = 0 THEN (oth - lag(oth) OVER o) / lag(oth) OVER o ELSE lag("COVID_mortality_frac") OVER o * ("US_COVID_mortality" - lag("US_COVID_mortality") OVER o) / lag("US_COVID_mortality") OVER o '
            '+ (1 - lag("COVID_mortality_frac") OVER o) * (oth - lag(oth) OVER o) / lag(oth) OVER o END',
            "d_una_distance": f"{Q.lag('una_distance', 0)} - {Q.lag('una_distance', 1)}",
            "d_COVID_mortality_pc": f"{Q.lag('COVID_mortality_pc', 0)} - {Q.lag('COVID_mortality_pc', 1)}",
        },
        "state", "year, week",
    ).replace("FROM panel", 'FROM (SELECT *, "US_total_mortality" - "US_COVID_mortality" AS oth FROM panel)'),
    Q.features(
        "f", "f1",
        {f"{c}_m2": Q.lag(c, 2) for c in ("bartik", "d_una_distance", "d_COVID_mortality_pc")} | {"d_COVID_mortality_pc_m3": Q.lag("d_COVID_mortality_pc", 3)},
        "state", "year, week",
    ),
]


@query("L25_shift_share_models", Q.union(SHIFT_SHARE_SQL, Q.model_rows("f", S.shift_share_specs(), digits=5)))
def l25(spark, sf):
    return estimates(S.shift_share_suite(week_panel(spark, sf)).coefficients, 5)


@query(
    "L25_shift_share_own_lag",
    with_sql(
        *WEEK_BASE,
        "m AS (SELECT state, y, w, dth / population AS pc, cm / tm AS fr, us_c, us_t - us_c AS us_o FROM base JOIN us USING (y, w) JOIN pop USING (state))",
        "k AS (SELECT *, lag(fr) OVER o AS f0, lag(us_c) OVER o AS c0, lag(us_o) OVER o AS o0, pc - lag(pc) OVER o AS d FROM m WINDOW o AS (PARTITION BY state ORDER BY y, w))",
        "q AS (SELECT *, CASE WHEN f0 = 0 THEN (us_o - o0) / o0 ELSE f0 * (us_c - c0) / c0 + (1 - f0) * (us_o - o0) / o0 END AS bk FROM k)",
        "l AS (SELECT state, d, lag(d, 2) OVER o AS d2, lag(bk, 2) OVER o AS z FROM q WINDOW o AS (PARTITION BY state ORDER BY y, w))",
        "e AS (SELECT d - avg(d) OVER (PARTITION BY state) AS d, d2 - avg(d2) OVER (PARTITION BY state) AS d2, z - avg(z) OVER (PARTITION BY state) AS z FROM l WHERE d IS NOT NULL AND d2 IS NOT NULL AND z IS NOT NULL)",
    )
    + f"SELECT 'own_lag' AS model_id, 'd_COVID_mortality_pc_m2' AS term, {sig_sql('sum(z * d) / sum(z * d2)', 5)} AS estimate FROM e",
)
def l25_own(spark, sf):
    out = S.shift_share_suite(week_panel(spark, sf)).coefficients
    out = out.filter((F.col("model_id") == "own_lag") & (F.col("term") == "d_COVID_mortality_pc_m2"))
    return out.select("model_id", "term", sig("estimate", 5).alias("estimate"))
