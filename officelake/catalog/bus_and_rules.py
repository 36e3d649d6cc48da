"""Bindings: topic log and rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from officelake.catalog import query
from officelake.operators import bus, domains, rules
from officelake.plans.inputs import table


def log(spark, sf):
    """Events as log messages; ids start at 1 because an agent's first offset is 0."""
    return table(spark, sf, "events").select(
        (F.col("event_id") + 1).alias("id"),
        F.col("event_type").alias("topic"),
        F.col("props").alias("message"),
        F.col("user_id").cast("string").alias("sender"),
        "ts",
    )


LOG_SQL = """log AS (SELECT event_id + 1 AS id, event_type AS topic, props AS message, CAST(user_id AS VARCHAR) AS sender, ts FROM events)"""


def subscriptions(spark, sf):
    """Every user listens to the topics the user has written to, bar errors."""
    rows = log(spark, sf).where(F.col("topic") != "error")
    return rows.select(F.col("sender").alias("agent"), "topic").distinct()


def cursors(spark, sf):
    """Users have read the purchases up to their own first one, and nothing else."""
    rows = log(spark, sf).where(F.col("topic") == "purchase")
    return rows.groupBy(F.col("sender").alias("agent"), "topic").agg(F.min("id").alias("offset"))


NEXT_SQL = f"""{LOG_SQL},
  subs AS (SELECT DISTINCT sender AS agent, topic FROM log WHERE topic <> 'error'),
  cur AS (SELECT sender AS agent, topic, min(id) AS "offset" FROM log WHERE topic = 'purchase' GROUP BY 1, 2),
  nxt AS (SELECT s.agent, s.topic, coalesce(c."offset", 0) AS "offset", min(l.id) AS next_id FROM subs s
          LEFT JOIN cur c ON c.agent = s.agent AND c.topic = s.topic
          LEFT JOIN kept l ON l.topic = s.topic AND l.id > coalesce(c."offset", 0) GROUP BY 1, 2, 3)"""


def _next_sql(kept: str) -> str:
    return NEXT_SQL.replace("  subs AS", f"  kept AS ({kept}),\n  subs AS")


KEPT_100 = "SELECT * FROM log QUALIFY row_number() OVER (PARTITION BY topic ORDER BY id DESC) <= 100"


@query("w3_topic_retention", f"WITH {LOG_SQL}, kept AS ({KEPT_100}) SELECT id, topic, message FROM kept")
def w3(spark, sf):
    return bus.retained(log(spark, sf)).select("id", "topic", "message")


@query(
    "w4_peek",
    f"WITH {LOG_SQL} SELECT id, topic FROM log QUALIFY row_number() OVER (PARTITION BY topic ORDER BY id DESC) <= 10",
)
def w4(spark, sf):
    return bus.peek(log(spark, sf), 10).select("id", "topic")


@query("w5_next_after_offset", f"WITH {_next_sql('SELECT * FROM log')} SELECT agent, topic, \"offset\", next_id FROM nxt")
def w5(spark, sf):
    return bus.next_ids(log(spark, sf), subscriptions(spark, sf), cursors(spark, sf), block=1000)


@query(
    "t5_publish",
    f"WITH {LOG_SQL} SELECT row_number() OVER (ORDER BY topic <> 'view', ts, id) AS id, topic, message FROM log",
)
def t5(spark, sf):
    rows = log(spark, sf).withColumnRenamed("id", "event")
    order = [F.col("ts"), F.col("event")]
    first = bus.publish(None, rows.where("topic = 'view'"), order)
    second = bus.publish(first, rows.where("topic <> 'view'"), order)
    return first.unionByName(second).select("id", "topic", "message")


@query(
    "t6_receive",
    f"""WITH {_next_sql(KEPT_100)}, got AS (SELECT agent, min(next_id) AS id FROM nxt WHERE next_id IS NOT NULL GROUP BY agent)
        SELECT 'message' AS kind, g.agent, l.topic, l.id FROM got g JOIN log l ON l.id = g.id
        UNION ALL SELECT 'cursor', coalesce(c.agent, g.agent), coalesce(c.topic, g.topic), coalesce(g.id, c."offset") FROM cur c
        FULL JOIN (SELECT g.agent, l.topic, l.id FROM got g JOIN log l ON l.id = g.id) g ON g.agent = c.agent AND g.topic = c.topic""",
)
def t6(spark, sf):
    got, moved = bus.receive(bus.retained(log(spark, sf)), subscriptions(spark, sf), cursors(spark, sf))
    return got.select(F.lit("message").alias("kind"), "agent", "topic", "id").unionByName(
        moved.select(F.lit("cursor").alias("kind"), "agent", "topic", F.col("offset").alias("id"))
    )


@query(
    "t8_agents_and_topics",
    f"""WITH {LOG_SQL} SELECT 'agent' AS kind, sender AS name, max(ts) AS last_seen FROM log GROUP BY sender
        UNION ALL SELECT DISTINCT 'topic', topic, CAST(NULL AS TIMESTAMP) FROM log""",
)
def t8(spark, sf):
    rows = log(spark, sf)
    seen = rows.select(F.col("sender").alias("agent"), "ts")
    agents = bus.agents(rows, seen).select(F.lit("agent").alias("kind"), F.col("agent").alias("name"), "last_seen")
    topics = bus.topics(rows).select(F.lit("topic").alias("kind"), F.col("topic").alias("name"))
    return agents.unionByName(topics, allowMissingColumns=True)


RULES = [
    rules.Rule("big", "l_quantity > 40", "a big line"),
    rules.Rule("cheap", "l_discount >= 0.08"),
    rules.Rule("returned", "l_returnflag = 'R'", "goods came back"),
    rules.Rule("taxed", "l_tax > 0.06", "high tax"),
]
OK_SQL = "l_quantity > 40 AND l_discount >= 0.08 AND l_returnflag = 'R' AND l_tax > 0.06"


@query(
    "r1_rule_audit",
    """SELECT l_orderkey, l_linenumber, l_partkey, array_to_string(list_filter([
         CASE WHEN NOT l_quantity > 40 THEN 'big: a big line' END, CASE WHEN NOT l_discount >= 0.08 THEN 'cheap: No description provided' END,
         CASE WHEN NOT l_returnflag = 'R' THEN 'returned: goods came back' END, CASE WHEN NOT l_tax > 0.06 THEN 'taxed: high tax' END],
         lambda x: x IS NOT NULL), '; ') AS violations FROM lineitem""",
)
def r1(spark, sf):
    out = rules.audit(table(spark, sf, "lineitem"), RULES)
    shown = F.transform("violations", lambda v: F.concat_ws(": ", v["label"], v["description"]))
    return out.select("l_orderkey", "l_linenumber", "l_partkey", F.array_join(shown, "; ").alias("violations"))


@query(
    "r2_consistency",
    f"SELECT l_partkey, CASE WHEN bool_or({OK_SQL}) THEN 'SAT' ELSE 'UNSAT' END AS status FROM lineitem GROUP BY l_partkey",
)
def r2(spark, sf):
    return rules.consistency(table(spark, sf, "lineitem"), ["l_partkey"], RULES)


DOMAIN_RULES = [
    domains.Holds("large", "quantity > 20", ("quantity",)),
    domains.Equal("remainder", "quantity", "quantity % 11", "discount", "discount"),
    domains.Within("close", "discount", "discount - 1", "discount + 1", "tax", "tax"),
    domains.Holds("sum", "quantity + discount + tax <> 50", ("quantity", "discount", "tax")),
]
DOMAIN_SQL = """q AS (SELECT DISTINCT l_partkey, CAST(l_quantity AS INT) AS quantity FROM lineitem),
    d AS (SELECT DISTINCT l_partkey, CAST(round(l_discount * 100) AS INT) AS discount FROM lineitem),
    t AS (SELECT DISTINCT l_partkey, CAST(round(l_tax * 100) AS INT) AS tax FROM lineitem),
    good AS (SELECT * FROM q JOIN d USING (l_partkey) JOIN t USING (l_partkey)
      WHERE quantity > 20 AND quantity % 11 = discount AND tax BETWEEN discount - 1 AND discount + 1 AND quantity + discount + tax <> 50),
    n AS (SELECT l_partkey, count(*) AS n, min(struct_pack(quantity := quantity, discount := discount, tax := tax)) AS m FROM good GROUP BY 1)"""


def _domains(spark, sf):
    """Per part the quantities, discounts and taxes its lines have, each on its own."""
    lines = table(spark, sf, "lineitem")
    of = {"quantity": F.col("l_quantity").cast("int"), "discount": F.round(F.col("l_discount") * 100).cast("int"), "tax": F.round(F.col("l_tax") * 100).cast("int")}
    return {name: lines.select("l_partkey", value.alias(name)) for name, value in of.items()}


@query(
    "r2_domains",
    f"WITH {DOMAIN_SQL} SELECT l_partkey, CASE WHEN n IS NULL THEN 'UNSAT' ELSE 'SAT' END AS status FROM (SELECT DISTINCT l_partkey FROM lineitem) LEFT JOIN n USING (l_partkey)",
)
def r2_domains(spark, sf):
    return domains.consistency(_domains(spark, sf), ["l_partkey"], DOMAIN_RULES)


@query(
    "r3_domains",
    f"""WITH {DOMAIN_SQL} SELECT l_partkey, CASE WHEN n IS NULL THEN 'UNSAT' WHEN n = 1 THEN 'SAT' ELSE 'AMBIGUOUS' END AS status,
        m.quantity AS quantity, m.discount AS discount, m.tax AS tax FROM (SELECT DISTINCT l_partkey FROM lineitem) LEFT JOIN n USING (l_partkey)""",
)
def r3_domains(spark, sf):
    return domains.solutions(_domains(spark, sf), ["l_partkey"], DOMAIN_RULES).select("l_partkey", "status", "model.quantity", "model.discount", "model.tax")


@query(
    "r3_solutions",
    """WITH d AS (SELECT DISTINCT l_partkey, l_quantity, l_discount FROM lineitem),
        c AS (SELECT l_partkey, count(*) FILTER (l_quantity > 40 AND l_discount >= 0.08) AS n,
                arg_min(l_quantity, (l_quantity, l_discount)) FILTER (l_quantity > 40 AND l_discount >= 0.08) AS quantity,
                arg_min(l_discount, (l_quantity, l_discount)) FILTER (l_quantity > 40 AND l_discount >= 0.08) AS discount FROM d GROUP BY 1)
       SELECT l_partkey, CASE WHEN n = 0 THEN 'UNSAT' WHEN n = 1 THEN 'SAT' ELSE 'AMBIGUOUS' END AS status, quantity, discount FROM c""",
)
def r3(spark, sf):
    out = rules.solutions(table(spark, sf, "lineitem"), ["l_partkey"], ["l_quantity", "l_discount"], RULES[:2])
    return out.select("l_partkey", "status", F.col("model.l_quantity").alias("quantity"), F.col("model.l_discount").alias("discount"))


@query(
    "r4_conflict_core",
    """WITH m AS (SELECT l_partkey, list(DISTINCT CASE WHEN l_quantity > 40 THEN 0 ELSE 1 END + CASE WHEN l_discount >= 0.08 THEN 0 ELSE 2 END
                    + CASE WHEN l_returnflag = 'R' THEN 0 ELSE 4 END + CASE WHEN l_tax > 0.06 THEN 0 ELSE 8 END) AS masks FROM lineitem GROUP BY 1),
        s1 AS (SELECT *, CASE WHEN len(list_filter(masks, lambda x: (x & 14) = 0)) = 0 THEN 14 ELSE 15 END AS a FROM m),
        s2 AS (SELECT *, CASE WHEN len(list_filter(masks, lambda x: (x & a & 13) = 0)) = 0 THEN a & 13 ELSE a END AS b FROM s1),
        s3 AS (SELECT *, CASE WHEN len(list_filter(masks, lambda x: (x & b & 11) = 0)) = 0 THEN b & 11 ELSE b END AS c FROM s2),
        s4 AS (SELECT *, CASE WHEN len(list_filter(masks, lambda x: (x & c & 7) = 0)) = 0 THEN c & 7 ELSE c END AS d FROM s3),
        k AS (SELECT l_partkey, CASE WHEN list_contains(masks, 0) THEN 0 ELSE d END AS core FROM s4)
       SELECT l_partkey, array_to_string(list_filter([CASE WHEN core & 1 > 0 THEN 'big' END, CASE WHEN core & 2 > 0 THEN 'cheap' END,
         CASE WHEN core & 4 > 0 THEN 'returned' END, CASE WHEN core & 8 > 0 THEN 'taxed' END], lambda x: x IS NOT NULL), ',') AS core FROM k""",
)
def r4(spark, sf):
    out = rules.conflict_core(table(spark, sf, "lineitem"), ["l_partkey"], RULES)
    return out.withColumn("core", F.array_join("core", ","))
