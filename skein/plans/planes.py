"""Rule-plane queries: scopes, text rules, grounding, throttles and decisions."""

from __future__ import annotations

from pyspark.sql import functions as F

from skein.operators import audit, rules
from skein.plans.tables import read

ALLOW, DENY = ["src/**", "docs/*.md"], ["**/secret/*", "src/1*/**"]
MAIL = r"[A-Za-z0-9._]+@[A-Za-z0-9.]+\.[a-z]+"


def _paths(spark, d):
    """Paths of events: src/<user>/<type>.rs, docs/<user>.md or <type>/secret/<user>."""
    ev = read(spark, d, "events", "event_id", "user_id", "event_type")
    u = F.col("user_id").cast("string")
    path = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("src/"), u, F.lit("/"), "event_type", F.lit(".rs"))).when(F.col("event_id") % 3 == 1, F.concat(F.lit("docs/"), u, F.lit(".md"))).otherwise(F.concat("event_type", F.lit("/secret/"), u))
    return ev.withColumn("path", path)


_PATHS = "pa AS (SELECT event_id, user_id, event_type, CASE event_id % 3 WHEN 0 THEN 'src/' || user_id || '/' || event_type || '.rs' WHEN 1 THEN 'docs/' || user_id || '.md' ELSE event_type || '/secret/' || user_id END AS path FROM events)"


def glob_scope(spark, d):
    return _paths(spark, d).select("event_id", "path", rules.scope_decision(F.col("path"), ALLOW, DENY).alias("decision"))


def scope_ladder(spark, d):
    ev = _paths(spark, d)
    item = F.col("user_id")
    declared = ev.where("user_id % 3 = 0 AND event_id % 2 = 0").select(item.alias("item"), "path")
    parents = ev.where("user_id % 3 = 1").select(item.alias("item"), (item - 1).alias("parent"), F.col("event_id").alias("ordinal"))
    observed = ev.where("user_id % 3 = 2 AND user_id % 2 = 0 AND event_id % 5 = 0").select(item.alias("item"), "path")
    requests = ev.select(item.alias("item"), "path").distinct()
    return rules.scope_ladder(requests, declared, parents, observed)


def text_rules(spark, d):
    docs = read(spark, d, "documents", "doc_id", "text", "source")
    found = rules.text_findings(docs, [{"name": "mail", "pattern": MAIL, "tier": "block"}, {"name": "licence", "pattern": r"License[a-z]*", "tier": "warn"}], "source", "text")
    return found.select("doc_id", "rule", F.array_join("tokens", "|").alias("tokens"), "n_tokens", "blocking")


def text_rule_exempt(spark, d):
    docs = read(spark, d, "documents", "doc_id", "text", "source").withColumn("exposure", F.when(F.col("doc_id") % 2 == 0, "public").otherwise("internal"))
    found = rules.text_findings(docs, [{"name": "mail", "pattern": MAIL, "tier": "block", "exempt": "^src1"}], "source", "text")
    return found.select("doc_id", "rule", "n_tokens", "blocking")


def must_exist_rule(spark, d):
    return rules.must_exist(read(spark, d, "documents", "lang", "text"), "lang", "text", MAIL)


def _grounding(spark, d):
    c = read(spark, d, "customer", "c_custkey")
    ids = c.where("c_custkey % 4 <> 0").select(F.concat(F.lit("customer-"), "c_custkey").alias("id"))
    texts = c.select("c_custkey", F.when(F.col("c_custkey") % 5 == 0, F.lit("see the-manual now")).otherwise(F.concat(F.lit("see customer-"), "c_custkey", F.lit(", please"))).alias("text"))
    return texts, ids


def ground_tokens(spark, d):
    return rules.ground(*_grounding(spark, d), "c_custkey", "text")


def must_ground(spark, d):
    texts, ids = _grounding(spark, d)
    return rules.grounding_rules(texts, rules.ground(texts, ids, "c_custkey", "text"), "c_custkey", "must-ground")


def throttle_active(spark, d):
    ev = read(spark, d, "events", "event_id", "user_id", "event_type", "value")
    log = ev.select(F.col("event_type").alias("constraint_id"), F.when(F.col("user_id") % 5 != 0, F.concat(F.lit("s"), (F.col("user_id") % 3).cast("string"))).alias("scope"), (F.col("event_id") + F.col("value").cast("long")).alias("until"))
    return audit.active_throttles(log, "s1", 500)


def backoff_secs(spark, d):
    ev = read(spark, d, "events", "event_id")
    form = F.when(F.col("event_id") % 7 == 0, "exp(overage)").when(F.col("event_id") % 7 == 1, "exp(min(overage / 0, 8))").otherwise(F.concat(F.lit("exp(min(overage / "), (F.col("event_id") % 5 + 1).cast("string"), F.lit(", 12))")))
    return ev.select("event_id", audit.backoff(form, (F.col("event_id") % 90).cast("double")).alias("secs"))


def first_decision(spark, d):
    ev = read(spark, d, "events", "event_id", "user_id", "event_type")
    found = ev.select("user_id", (F.col("event_id") % 4).alias("plane"), F.concat(F.lit("r"), "event_type").alias("rule"), (F.col("event_id") % 50 == 0).alias("blocking"))
    return rules.first_decision(found.distinct(), "user_id", "plane", "rule")


def mode_outcome(spark, d):
    ev = read(spark, d, "events", "event_id", "user_id")
    mode = F.element_at(F.array(*map(F.lit, rules.MODES)), (F.col("event_id") % 3 + 1).cast("int"))
    rung = F.element_at(F.array(*map(F.lit, ("declared", "derived", "observed", "unknown"))), (F.col("user_id") % 4 + 1).cast("int"))
    return ev.select("event_id", mode.alias("mode"), rung.alias("rung"), rules.outcome(mode, rung).alias("outcome"))


EFFECTS, DECLARED, PLACES, HELD = ("deny", "warn", "record", "allow", "throttle", "quarantine", None), ("hard", "soft", "escalation", None, "odd"), ("PAG", "PAA", None, "ATM", "later", "policy_layer", "tool_layer"), ("orchestration", "tool", "policy", None, "prompt")


def blocking_rules(spark, d):
    p = read(spark, d, "part", "p_partkey", "p_size")
    of = lambda values, at: F.element_at(F.array(*(F.lit(v).cast("string") for v in values)), (at % len(values) + 1).cast("int"))
    key, size = F.col("p_partkey"), F.col("p_size")
    said = rules.blocks(of(DECLARED, F.floor(key / 7)), of(EFFECTS, key), of(rules.MODES, size), of(PLACES, F.floor(key / 35)))
    return p.select("p_partkey", said.alias("blocks"), rules.overclaim(of(HELD, size)).alias("overclaim"), rules.overclaim(of(HELD, size), of(rules.LAYERS, key)).alias("overclaim_there"))


def rule_set_digest(spark, d):
    return rules.rule_digest(read(spark, d, "part", "p_name"), "p_name")


def census_values(spark, d):
    """Distinct ids of a group, in order, joined by +."""
    p = read(spark, d, "part", "p_brand", "p_type")
    return p.groupBy("p_brand").agg(F.array_join(F.array_sort(F.collect_set("p_type")), "+").alias("ids"), F.count_distinct("p_type").alias("n"))


QUERIES = {f.__name__: f for f in (glob_scope, scope_ladder, text_rules, text_rule_exempt, must_exist_rule, ground_tokens, must_ground, throttle_active, backoff_secs, first_decision, mode_outcome, blocking_rules, rule_set_digest, census_values)}

_MAIL = MAIL
ORACLES = {
    "glob_scope": f"WITH {_PATHS} SELECT event_id, path, CASE WHEN path LIKE '%/secret/%' OR path LIKE 'src/1%/%' THEN 'denied' WHEN path LIKE 'src/%' OR path LIKE 'docs/%.md' THEN 'allowed' ELSE 'outside' END AS decision FROM pa",
    "scope_ladder": f"""WITH {_PATHS}, de AS (SELECT DISTINCT user_id AS item, path FROM pa WHERE user_id % 3 = 0 AND event_id % 2 = 0), ob AS (SELECT DISTINCT user_id AS item, path FROM pa WHERE user_id % 3 = 2 AND user_id % 2 = 0 AND event_id % 5 = 0),
        rq AS (SELECT DISTINCT user_id AS item, path, CASE WHEN user_id % 3 = 1 THEN user_id - 1 END AS parent FROM pa),
        g AS (SELECT *, CASE WHEN item IN (SELECT item FROM de) THEN 'declared' WHEN parent IN (SELECT item FROM de) THEN 'derived' WHEN item IN (SELECT item FROM ob) THEN 'observed' ELSE 'unknown' END AS rung FROM rq)
        SELECT item, path, rung, CASE rung WHEN 'declared' THEN EXISTS (SELECT 1 FROM de WHERE de.item = g.item AND de.path = g.path) WHEN 'derived' THEN EXISTS (SELECT 1 FROM de WHERE de.item = g.parent AND de.path = g.path)
               WHEN 'observed' THEN EXISTS (SELECT 1 FROM ob WHERE ob.item = g.item AND ob.path = g.path) ELSE false END AS inside, rung = 'declared' AS decides FROM g""",
    "text_rules": f"""WITH f AS (SELECT doc_id, 'mail' AS rule, regexp_extract_all(text, '{_MAIL}') AS t, true AS blocking FROM documents UNION ALL SELECT doc_id, 'licence', regexp_extract_all(text, 'License[a-z]*'), false FROM documents),
        x AS (SELECT doc_id, rule, blocking, unnest(t) AS tok, unnest(range(len(t))) AS i FROM f), y AS (SELECT doc_id, rule, blocking, tok, min(i) AS i FROM x GROUP BY ALL)
        SELECT doc_id, rule, string_agg(tok, '|' ORDER BY i) AS tokens, count(*)::INTEGER AS n_tokens, blocking FROM y GROUP BY doc_id, rule, blocking""",
    "text_rule_exempt": f"SELECT doc_id, 'mail' AS rule, len(list_distinct(regexp_extract_all(text, '{_MAIL}')))::INTEGER AS n_tokens, doc_id % 2 = 0 AS blocking FROM documents WHERE NOT starts_with(source, 'src1') AND len(regexp_extract_all(text, '{_MAIL}')) > 0",
    "must_exist_rule": f"SELECT lang, bool_or(regexp_matches(coalesce(text, ''), '{_MAIL}')) AS hit, count(*) AS rows FROM documents GROUP BY lang",
    "ground_tokens": """WITH t AS (SELECT c_custkey, unnest(CASE WHEN c_custkey % 5 = 0 THEN ['see', 'the-manual', 'now'] ELSE ['see', 'customer-' || c_custkey, 'please'] END) AS token FROM customer)
        SELECT c_custkey, token, CASE WHEN starts_with(token, 'customer-') THEN CASE WHEN c_custkey % 4 <> 0 THEN 'grounded' ELSE 'fabricated' END ELSE 'unrelated' END AS outcome FROM t""",
    "must_ground": "SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 THEN 'breach' WHEN c_custkey % 4 = 0 THEN 'fabricated' ELSE 'ok' END AS outcome FROM customer",
    "throttle_active": "SELECT event_type AS constraint_id, max(event_id + trunc(value)::BIGINT) AS until FROM events WHERE user_id % 5 <> 0 AND user_id % 3 = 1 GROUP BY 1 HAVING max(event_id + trunc(value)::BIGINT) > 500",
    "backoff_secs": "SELECT event_id, CASE WHEN event_id % 7 >= 2 THEN least(floor(exp(least((event_id % 90)::DOUBLE / (event_id % 5 + 1), 12.0))), 21600)::BIGINT END AS secs FROM events",
    "first_decision": """WITH f AS (SELECT DISTINCT user_id, event_id % 4 AS plane, 'r' || event_type AS rule, event_id % 50 = 0 AS blocking FROM events)
        SELECT user_id, plane, rule, blocking, (SELECT string_agg(DISTINCT g.rule, '+' ORDER BY g.rule) FROM f g WHERE g.user_id = f.user_id) AS rules FROM f QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY blocking DESC, plane, rule) = 1""",
    "mode_outcome": """WITH x AS (SELECT event_id, event_id % 3 AS m, user_id % 4 AS r FROM events)
        SELECT event_id, ['off', 'advise', 'enforce'][m + 1] AS mode, ['declared', 'derived', 'observed', 'unknown'][r + 1] AS rung, ['off', 'advise', 'enforce'][least(m, CASE r WHEN 0 THEN 2 WHEN 3 THEN 0 ELSE 1 END) + 1] AS outcome FROM x""",
    "blocking_rules": """WITH x AS (SELECT p_partkey, ['deny', 'warn', 'record', 'allow', 'throttle', 'quarantine', NULL][p_partkey % 7 + 1] AS e, ['hard', 'soft', 'escalation', NULL, 'odd'][p_partkey // 7 % 5 + 1] AS c, ['off', 'advise', 'enforce'][p_size % 3 + 1] AS m,
          ['PAG', 'PAA', NULL, 'ATM', 'later', 'policy_layer', 'tool_layer'][p_partkey // 35 % 7 + 1] AS p, [1, 2, 3, NULL, NULL][p_size % 5 + 1] AS held, p_partkey % 3 + 1 AS there FROM part)
        SELECT p_partkey, m = 'enforce' AND coalesce(p NOT IN ('PAA', 'ATM', 'policy_layer', 'tool_layer'), true) AND CASE WHEN c IN ('hard', 'escalation') THEN true WHEN c = 'soft' THEN false ELSE coalesce(e NOT IN ('warn', 'record', 'allow', 'throttle'), true) END AS blocks,
               coalesce(held > 1, false) AS overclaim, coalesce(held > there, false) AS overclaim_there FROM x""",
    "rule_set_digest": "SELECT sha256(string_agg(p_name, chr(30) ORDER BY p_name)) AS digest FROM part",
    "census_values": "SELECT p_brand, string_agg(DISTINCT p_type, '+' ORDER BY p_type) AS ids, count(DISTINCT p_type) AS n FROM part GROUP BY 1",
}
