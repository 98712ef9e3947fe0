"""Joins, key sets, similarity and grouped rules over the driver tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from fathom.operators import joins as J
from fathom.plans.registry import query, table

SPANS = """spans AS (SELECT user_id, event_id AS span_id, ts AS b, lead(ts, 3) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS e FROM events)"""


@query("interval_enclosing", f"""WITH {SPANS}, p AS (SELECT event_id, user_id, ts FROM events WHERE event_type = 'error')
SELECT p.event_id AS point_id, span_id FROM p LEFT JOIN spans s ON s.user_id = p.user_id AND s.b <= p.ts AND p.ts <= s.e
QUALIFY row_number() OVER (PARTITION BY p.event_id ORDER BY s.e - s.b, s.b, span_id) = 1""")
def interval_enclosing(spark, sf_dir):
    """The innermost of the spans that reach from each event to the third next one, around each error."""
    e = table(spark, sf_dir, "events")
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    spans = e.select("user_id", F.col("event_id").alias("span_id"), F.unix_micros(F.col("ts").cast("timestamp")).alias("begin"), F.unix_micros(F.lead("ts", 3).over(w).cast("timestamp")).alias("end")).where("end is not null")
    points = e.where("event_type = 'error'").select("user_id", F.col("event_id").alias("point_id"), F.unix_micros(F.col("ts").cast("timestamp")).alias("at"))
    return J.enclosing_span(points, spans, "user_id")


@query("asof_enclosing", """SELECT p.event_id, p.user_id, (SELECT max_by(s.event_id, (s.ts, s.event_id)) FROM events s WHERE s.user_id = p.user_id AND s.event_type = 'signup' AND s.ts <= p.ts) AS signup_id
FROM events p WHERE p.event_type = 'purchase'""")
def asof_enclosing(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    right = e.where("event_type = 'signup'").select("user_id", "ts", F.col("event_id").alias("signup_id"))
    left = e.where("event_type = 'purchase'").select("event_id", "user_id", "ts")
    return J.as_of(left, right, "user_id", "ts", "signup_id").select("event_id", "user_id", "signup_id")


@query("next_within_gap", """SELECT p.event_id, (SELECT min(s.ts) FROM events s WHERE s.user_id = p.user_id AND s.event_type = 'purchase' AND s.ts > p.ts AND s.ts <= p.ts + INTERVAL 6 HOUR) AS next_purchase FROM events p WHERE p.event_type = 'view'""")
def next_within_gap(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    left = e.where("event_type = 'view'").select("event_id", "user_id", "ts")
    return J.next_within(left, e.where("event_type = 'purchase'"), "user_id", "ts", F.expr("interval 6 hours"), "next_purchase").select("event_id", "next_purchase")


TIERS = """r AS (SELECT p_partkey AS ref_id, p_name AS a, p_brand || ' ' || p_size AS b, p_type AS c FROM part WHERE p_size > 25),
t AS (SELECT p_partkey AS target, p_name AS a, p_brand || ' ' || p_size AS b, p_type AS c FROM part WHERE p_size <= 25 OR p_brand = 'Brand#1'),
m AS (SELECT ref_id, 1 AS tier, target FROM r JOIN t ON r.b = t.b UNION SELECT ref_id, 2, target FROM r JOIN t ON r.a = t.a)"""


@query("tiered_resolution", f"WITH {TIERS} SELECT ref_id, CAST(tier AS INTEGER) AS tier, target, count(*) OVER (PARTITION BY ref_id) > 1 AS ambiguous FROM (SELECT *, min(tier) OVER (PARTITION BY ref_id) AS mt FROM m) WHERE tier = mt")
def tiered_resolution(spark, sf_dir):
    """Large parts looked up among others: by brand and size, else by name."""
    p = table(spark, sf_dir, "part").withColumn("b", F.concat("p_brand", F.lit(" "), F.col("p_size").cast("string")))
    refs = p.where("p_size > 25").select(F.col("p_partkey").alias("ref_id"), F.col("p_name").alias("a"), "b")
    t = p.where("p_size <= 25 or p_brand = 'Brand#1'").select(F.col("p_partkey").alias("target"), F.col("p_name").alias("a1"), F.col("b").alias("b1"))
    return J.tiered(refs, [(t, "b1", "b"), (t, "a1", "a")])


@query("drift_antijoin", """WITH f AS (SELECT o_orderkey AS id, o_orderpriority AS name, o_orderstatus AS kind, CAST(o_custkey AS BIGINT) AS line, CASE WHEN o_totalprice > 250000 THEN 'f' || o_custkey END AS fqn FROM orders),
k AS (SELECT o_orderpriority AS name, o_orderstatus AS kind, CAST(o_custkey + 15 AS BIGINT) AS line, CASE WHEN o_totalprice > 400000 THEN 'f' || o_custkey END AS fqn FROM orders WHERE o_totalprice > 300000)
SELECT id FROM f WHERE NOT EXISTS (SELECT 1 FROM k WHERE k.name = f.name AND k.kind = f.kind AND CASE WHEN f.fqn IS NOT NULL AND k.fqn IS NOT NULL THEN f.fqn = k.fqn ELSE abs(f.line - k.line) <= 10 END)""")
def drift_antijoin(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    f = o.select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("name"), F.col("o_orderstatus").alias("kind"), F.col("o_custkey").alias("line"), F.when(F.col("o_totalprice") > 250000, F.concat(F.lit("f"), F.col("o_custkey"))).alias("fqn"))
    k = o.where("o_totalprice > 300000").select(F.col("o_orderpriority").alias("name"), F.col("o_orderstatus").alias("kind"), (F.col("o_custkey") + 15).alias("line"), F.when(F.col("o_totalprice") > 400000, F.concat(F.lit("f"), F.col("o_custkey"))).alias("fqn"))
    return J.drift_anti(f, k, ["name", "kind"]).select("id")


KEYS = "SELECT DISTINCT user_id, regexp_extract(props, '\"k\": ([0-9]+)', 1) AS k FROM events WHERE event_type = "


@query("write_only_keys", f"({KEYS}'signup') EXCEPT ({KEYS}'view')")
def write_only_keys(spark, sf_dir):
    """Keys that are written and never read."""
    e = table(spark, sf_dir, "events").select("user_id", "event_type", F.get_json_object("props", "$.k").alias("k"))
    side = lambda t: e.where(F.col("event_type") == t).select("user_id", "k").distinct()
    return side("signup").join(side("view"), ["user_id", "k"], "left_anti")


@query("dao_write_only", """SELECT user_id, regexp_extract(props, '"k": ([0-9]+)', 1) AS k, count(*) FILTER (WHERE event_type IN ('signup', 'purchase')) AS writes FROM events GROUP BY ALL
HAVING count(*) FILTER (WHERE event_type IN ('signup', 'purchase')) >= 2 AND count(*) FILTER (WHERE event_type IN ('view', 'click')) = 0""")
def dao_write_only(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("k", F.get_json_object("props", "$.k"))
    g = e.groupBy("user_id", "k").agg(F.count_if(F.col("event_type").isin("signup", "purchase")).alias("writes"), F.count_if(F.col("event_type").isin("view", "click")).alias("reads"))
    return g.where("writes >= 2 and reads = 0").select("user_id", "k", "writes")


@query("bus_orphans", """SELECT k, side FROM (SELECT DISTINCT regexp_extract(props, '"k": ([0-9]+)', 1) || ':' || (user_id // 4) AS k, CASE WHEN event_type = 'signup' THEN 'subscribed' ELSE 'posted' END AS side FROM events WHERE event_type IN ('signup', 'error'))
QUALIFY count(*) OVER (PARTITION BY k) = 1""")
def bus_orphans(spark, sf_dir):
    """Subscribed and never posted, or posted and never subscribed: two set differences in one grouping."""
    e = table(spark, sf_dir, "events").where("event_type in ('signup', 'error')")
    k = F.concat(F.get_json_object("props", "$.k"), F.lit(":"), F.expr("user_id div 4"))
    g = e.groupBy(k.alias("k")).agg(F.min("event_type").alias("lo"), F.max("event_type").alias("hi")).where("lo = hi")
    return g.select("k", F.when(F.col("lo") == "signup", "subscribed").otherwise("posted").alias("side"))


@query("coverage_merge", "SELECT l_orderkey, l_linenumber, bool_or(l_returnflag = 'R') AS covered, count(*) AS runs FROM lineitem GROUP BY l_orderkey, l_linenumber")
def coverage_merge(spark, sf_dir):
    """A line is covered if any run covers it."""
    g = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber")
    return g.agg(F.bool_or(F.col("l_returnflag") == "R").alias("covered"), F.count(F.lit(1)).alias("runs"))


@query("permissions_dict", "SELECT r_name FROM region WHERE r_regionkey NOT IN (SELECT n_regionkey FROM nation JOIN supplier ON s_nationkey = n_nationkey GROUP BY n_regionkey HAVING count(*) > 20)")
def permissions_dict(spark, sf_dir):
    used = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "supplier"), F.col("s_nationkey") == F.col("n_nationkey")).groupBy("n_regionkey").agg(F.count(F.lit(1)).alias("n")).where("n > 20")
    return table(spark, sf_dir, "region").join(used, F.col("r_regionkey") == F.col("n_regionkey"), "left_anti").select("r_name")


@query("lcov_carry", """SELECT event_id, user_id, last_value(CASE WHEN event_type = 'signup' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS section FROM events""")
def lcov_carry(spark, sf_dir):
    """Records under the last header before them."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return table(spark, sf_dir, "events").select("event_id", "user_id", F.last(F.when(F.col("event_type") == "signup", F.col("event_id")), ignorenulls=True).over(w).alias("section"))
