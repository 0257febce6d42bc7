"""The edit planes in batch: payloads in, one decision an edit out, and what is said after the edit.

An edit passes the planes in order: rules over the text it brings in, verification of the
buffer, its tenant's paths, and last its radius. The first plane that finds something decides,
so later planes see only the edits that are still open; the radius, which walks the graph, comes
last. What could not be measured is said and never counted as a pass.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skein.functions import language
from skein.operators import audit, graph, rules, syntax, verify
from skein.scratch import stable

_EDIT = "struct<old_string:string,new_string:string>"
PAYLOAD = f"session_id string, cwd string, tool_name string, tool_input struct<file_path:string,content:string,old_string:string,new_string:string,edits:array<{_EDIT}>>"


def payloads(lines: DataFrame) -> DataFrame:
    """(key, session, cwd, tool, path, rel, anchors, text) of JSON payloads (key, value).

    anchors are the replaced strings in order, text what the edit brings in. Payloads that do not
    parse or name no file are left out: nothing is said about them."""
    p = F.from_json("value", PAYLOAD)
    out = lines.select("key", p.alias("p")).select("key", F.col("p.session_id").alias("session"), F.col("p.cwd").alias("cwd"), F.col("p.tool_name").alias("tool"), F.col("p.tool_input").alias("i")).where("i.file_path IS NOT NULL")
    edits = F.coalesce("i.edits", F.array().cast(f"array<{_EDIT}>"))
    both = F.concat(F.array(F.struct(F.col("i.old_string").alias("old_string"), F.col("i.new_string").alias("new_string"))), edits)
    some = lambda name: F.filter(F.transform(both, lambda e: e[name]), lambda x: x.isNotNull())
    path = F.col("i.file_path")
    rel = F.when(path.startswith(F.concat("cwd", F.lit("/"))), F.substring(path, F.length("cwd") + 2, F.length(path))).otherwise(path)
    text = F.array_join(F.concat(F.array_compact(F.array("i.content")), some("new_string")), "\n")
    return out.select("key", "session", "cwd", "tool", path.alias("path"), rel.alias("rel"), some("old_string").alias("anchors"), text.alias("text"))


def deny_envelope(reason: Column) -> Column:
    """The JSON that blocks an edit. The field names are fixed values of the hook protocol."""
    return F.to_json(F.struct(F.struct(F.lit("PreToolUse").alias("hookEventName"), F.lit("deny").alias("permissionDecision"), reason.alias("permissionDecisionReason")).alias("hookSpecificOutput")))


def notice_envelope(message: Column) -> Column:
    """The JSON that only tells."""
    return F.to_json(F.struct(message.alias("systemMessage")))


def json_lines(rows: DataFrame) -> DataFrame:
    """(value): each row as JSON, for output by command."""
    return rows.select(F.to_json(F.struct(*rows.columns)).alias("value"))


# ---- the radius of an edit ----


def touched(edits: DataFrame, files: DataFrame, symbols: DataFrame) -> DataFrame:
    """(key, rel, name) of the symbols that an edit (key, rel, anchors) lands in, by the first occurrence of each anchor.

    No anchor, an anchor that is not in the file, or none inside a symbol: all symbols of the file."""
    source, whole = F.col("source"), F.size("anchors") <= 0
    lines = lambda text: F.length(text) - F.length(F.replace(text, F.lit("\n")))
    first = lambda a: lines(F.substring(source, F.lit(1), F.instr(source, a) - 1)) + 1
    span = lambda a: F.struct(first(a).alias("lo"), (first(a) + lines(F.regexp_replace(a, "\n$", ""))).alias("hi"))
    placed = edits.join(files.select("rel", "source"), "rel").select("key", "rel", (whole | F.exists("anchors", lambda a: F.instr(source, a) == 0)).alias("_all"), F.transform("anchors", span).alias("_spans"))
    own = placed.join(symbols.select(F.col("file").alias("rel"), "name", "start_line", "end_line"), "rel")
    hit = own.withColumn("_hit", F.coalesce(~F.col("_all") & F.exists("_spans", lambda s: (F.col("start_line") <= s["hi"]) & (F.col("end_line") >= s["lo"])), F.lit(False)))
    some = hit.groupBy("key", "rel").agg(F.bool_or("_hit").alias("_some"))
    return hit.join(some, ["key", "rel"]).where("_hit OR NOT _some").select("key", "rel", "name").distinct()


def sizing(edits: DataFrame, files: DataFrame, symbols: DataFrame, edges: DataFrame, hops: int = 5) -> DataFrame:
    """(key, rel, kind, symbols, files): how far each edit (key, rel, anchors [, late]) reaches, or why that is not known.

    files are (rel, source, parsed). kind is measured, no-grammar (unknown language or no parse),
    unreadable (no source), no-anchors (no symbol to start from) or deadline (late is true); the
    counts are null unless measured. Reached are other files' symbols of the edit's language."""
    late = F.col("late") if "late" in edits.columns else F.lit(False)
    found = stable(touched(edits, files, symbols))
    seeds = found.join(symbols.select("node", "name"), "name").select("key", F.col("name").alias("_name"), "node")
    reached = graph.reach(edges, seeds, "callers", hops, ("key", "_name")).select("key", "node").distinct()
    other = reached.join(symbols.select("node", "name", "file", "language"), "node").join(edits.select("key", "rel"), "key").where((F.col("file") != F.col("rel")) & (F.col("language") == language(F.col("rel"))))
    radius = other.groupBy("key").agg(F.count_distinct("name").alias("symbols"), F.count_distinct("file").alias("files"))
    read = files.select("rel", (F.col("source").isNotNull()).alias("_read"), F.coalesce("parsed", F.lit(False)).alias("_parsed"))
    out = edits.join(read, "rel", "left").join(found.select("key", F.lit(True).alias("_some")).distinct(), "key", "left").join(radius, "key", "left")
    kind = (
        F.when(late, "deadline")
        .when(language(F.col("rel")).isNull(), "no-grammar")
        .when(~F.coalesce("_read", F.lit(False)), "unreadable")
        .when(~F.col("_parsed"), "no-grammar")
        .when(F.col("_some").isNull(), "no-anchors")
        .otherwise("measured")
    )
    sized = out.withColumn("kind", kind)
    count = lambda c: F.when(F.col("kind") == "measured", F.coalesce(c, F.lit(0))).alias(c)
    return sized.select("key", "rel", "kind", count("symbols"), count("files"))


# ---- decisions ----


@dataclass
class Scope:
    """A tenant's declared scope; no allowed paths allow all, a ceiling of None is none."""

    allow: list[str] = field(default_factory=list)
    deny: list[str] = field(default_factory=list)
    max_symbols: int | None = None
    max_files: int | None = None


def _by_tenant(scopes: dict[str, Scope], make, otherwise: Column) -> Column:
    out = otherwise
    for tenant, scope in scopes.items():
        out = F.when(F.col("tenant") == tenant, make(scope)).otherwise(out)
    return out


def path_rule(path: Column, scope: Scope) -> Column:
    """The rule that a path breaks: the first denying glob, or the list of allowed ones; null for none."""
    out = F.when(~rules.any_glob(path, scope.allow), "allow_paths") if scope.allow else F.lit(None).cast("string")
    for glob in reversed(scope.deny):
        out = F.when(rules.any_glob(path, [glob]), F.lit(f"deny_paths:{glob}")).otherwise(out)
    return out


PLANES = ("structure", "rules", "verify", "paths", "radius")


def pre_edit(edits: DataFrame, text_rules: list[dict], files: DataFrame, symbols: DataFrame, edges: DataFrame, scopes: dict[str, Scope], mode: str = "enforce", hops: int = 5, freshness: str = "fresh", structural: list[dict] | None = None, governed: list[dict] | None = None) -> DataFrame:
    """One decision an edit (key, session, tenant, rel, anchors, text, proposed, baseline): key, outcome, plane, rule, constraints, freshness.

    Local structural rules come first and decide by the mode; governed ones stand beside the text rules and block by their class or effect
    (syntax.structural_findings). outcome is allow, notify or deny. A text rule of tier block denies and others notify, whatever
    the mode; the other planes deny under enforce and notify under advise. Tenants without a scope,
    and edits whose radius is not known, get one notice a session and rule (first key) and are
    allowed. Under `off` every edit is allowed. constraints are (rule, outcome, response) of
    all that the deciding plane found, in order of rule."""
    record = "array<struct<rule:string,outcome:string,response:string>>"
    if mode == "off":
        return edits.select("key", F.lit("allow").alias("outcome"), F.lit(None).cast("string").alias("plane"), F.lit(None).cast("string").alias("rule"), F.array().cast(record).alias("constraints"), F.lit(freshness).alias("freshness"))
    strong = "deny" if mode == "enforce" else "notify"
    row = lambda frame, plane, rule, response: frame.select("key", F.lit(PLANES.index(plane)).alias("plane"), rule.alias("rule"), response.alias("response"))

    said = rules.text_findings(edits.select("key", "rel", "text"), text_rules, "rel", "text") if text_rules else None
    first = row(said, "rules", F.col("rule"), F.when(F.col("blocking"), "deny").otherwise("notify")) if said is not None else row(edits.where("false"), "rules", F.lit(""), F.lit(""))
    brought = edits.select("key", "rel", language(F.col("rel")).alias("language"), F.col("text").alias("source"))
    zeroth = row(syntax.structural_findings(brought, structural or [], ["key"], mode), "structure", F.col("rule"), F.lit(strong)).distinct()
    if governed:
        first = first.unionByName(row(syntax.structural_findings(brought, governed, ["key"], mode, governed=True), "rules", F.col("rule"), F.when(F.col("blocking"), "deny").otherwise("notify")).distinct())
    wrong = verify.violations(edits.select("key", "rel", "proposed", "baseline"), symbols, files)
    second = row(wrong, "verify", F.concat(F.lit("verify:"), "kind"), F.lit(strong)).distinct()
    scoped = edits.where(F.col("tenant").isin(*scopes)) if scopes else edits.where("false")
    broken = scoped.withColumn("_rule", _by_tenant(scopes, lambda s: path_rule(F.col("rel"), s), F.lit(None).cast("string"))).where("_rule IS NOT NULL")
    third = row(broken, "paths", F.col("_rule"), F.lit(strong))
    early = stable(zeroth.unionByName(first).unionByName(second).unionByName(third))

    still = stable(edits.join(early.select("key").distinct(), "key", "left_anti"))
    free = still.where(F.col("tenant").isNull() | ~F.col("tenant").isin(*scopes)) if scopes else still
    held = still.where(F.col("tenant").isin(*(t for t, s in scopes.items() if s.max_symbols is not None or s.max_files is not None)))
    size = sizing(held, files, symbols, edges, hops).join(held.select("key", "session", "tenant"), "key")
    size = size.withColumn("_rule", F.when(F.col("kind") == "measured", _by_tenant(scopes, lambda s: rules.ceiling(F.col("symbols"), F.col("files"), s.max_symbols, s.max_files), F.lit(""))))
    over = row(size.where("_rule <> ''"), "radius", F.col("_rule"), F.lit(strong))
    quiet = free.select("key", "session", F.lit("paths").alias("_plane"), F.lit("unscoped").alias("_rule")).unionByName(size.where("kind <> 'measured'").select("key", "session", F.lit("radius").alias("_plane"), F.concat(F.lit("unmeasured-"), "kind", F.lit("-"), "rel").alias("_rule")))
    told = F.row_number().over(Window.partitionBy("session", "_rule").orderBy("key"))
    told = quiet.withColumn("_n", told).where("_n = 1 OR session IS NULL")
    notices = told.select("key", F.when(F.col("_plane") == "paths", PLANES.index("paths")).otherwise(PLANES.index("radius")).alias("plane"), F.when(F.col("_plane") == "paths", "unscoped").otherwise("unmeasured").alias("rule"), F.lit("notify").alias("response"))

    found = early.unionByName(over).unionByName(notices)
    least = found.groupBy("key").agg(F.min("plane").alias("plane"))
    kept = found.join(least, ["key", "plane"]).groupBy("key", "plane").agg(F.array_sort(F.collect_set(F.struct("rule", F.lit("unsatisfied").alias("outcome"), "response"))).alias("constraints"), F.bool_or(F.col("response") == "deny").alias("_deny"))
    out = edits.select("key").join(kept, "key", "left")
    plane = F.element_at(F.array(*map(F.lit, PLANES)), F.col("plane") + 1)
    return out.select(
        "key",
        F.when(F.col("plane").isNull(), "allow").when(F.col("_deny"), "deny").otherwise("notify").alias("outcome"),
        F.when(F.col("plane").isNotNull(), plane).alias("plane"),
        F.when(F.col("plane").isNotNull(), F.array_join(F.transform("constraints", lambda c: c["rule"]), "+")).alias("rule"),
        F.coalesce("constraints", F.array().cast(record)).alias("constraints"),
        F.lit(freshness).alias("freshness"),
    )


# ---- after the edit ----


def post_audit(files: DataFrame, post_rules: list[dict], now: int, mode: str = "enforce") -> DataFrame:
    """(rel, scope, rule, outcome, response, found, secs, until): each rule over each whole file (rel, source, language, scope) it applies to.

    A rule is name, language, paths (globs, none for all), pattern and an optional backoff. A rule that
    holds is recorded too. One that does not warns, and with a backoff throttles for seconds that grow
    with its matches; nothing is blocked. Under `off` nothing is audited."""
    parts = []
    for r in post_rules if mode != "off" else ():
        fits = (F.col("language") == r["language"]) & (rules.any_glob(F.col("rel"), r["paths"]) if r.get("paths") else F.lit(True))
        n = F.size(F.regexp_extract_all(F.coalesce("source", F.lit("")), F.lit(rules.compile_pattern(r["pattern"])), F.lit(0)))
        parts.append(F.when(fits, F.struct(F.lit(r["name"]).alias("rule"), n.cast("int").alias("found"), F.lit(r.get("backoff")).cast("string").alias("backoff"))))
    typed = F.array_compact(F.array(*parts)) if parts else F.array().cast("array<struct<rule:string,found:int,backoff:string>>")
    seen = files.select("rel", "scope", F.explode(typed).alias("r")).select("rel", "scope", "r.*")
    secs = F.when(F.col("found") > 0, audit.backoff(F.col("backoff"), F.col("found").cast("double")))
    out = seen.withColumn("secs", secs)
    return out.select("rel", "scope", "rule", F.when(F.col("found") > 0, "unsatisfied").otherwise("satisfied").alias("outcome"), F.when(F.col("found") > 0, "warned").otherwise("logged").alias("response"), "found", "secs", (F.col("secs") + now).alias("until"))


def out_of_ground(edits: DataFrame, ground: DataFrame, prior: DataFrame, cap: int = 5) -> DataFrame:
    """(key, item, rel, prior): edits (key, item, rel) outside the paths (item, path) that work on their item has touched.

    Items without any ground are not spoken of. prior holds up to `cap` of the items (path, item, outcome) that
    touched the path, in order of item, as item:outcome (open where null)."""
    known = edits.join(ground.select("item").distinct(), "item", "left_semi")
    outside = known.join(ground.select("item", F.col("path").alias("rel")).distinct(), ["item", "rel"], "left_anti")
    w = Window.partitionBy("path").orderBy("item", "outcome")
    few = prior.select("path", "item", "outcome").distinct().withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= cap)
    listed = few.groupBy(F.col("path").alias("rel")).agg(F.transform(F.array_sort(F.collect_list(F.struct("_n", F.concat("item", F.lit(":"), F.coalesce("outcome", F.lit("open"))).alias("v")))), lambda x: x["v"]).alias("prior"))
    return outside.join(listed, "rel", "left").select("key", "item", "rel", F.coalesce("prior", F.array().cast("array<string>")).alias("prior"))


def provenance_chain(triples: DataFrame, implements: str, modifies: str, path: str, identifier: str) -> DataFrame:
    """Distinct (item, commit, entity, path): commits that implement an item and modify an entity that has a path, over triples (s, p, o)."""
    of = lambda p, s, o: triples.where(F.col("p") == p).select(F.col("s").alias(s), F.col("o").alias(o))
    out = of(implements, "commit", "_w").join(of(identifier, "_w", "item"), "_w").join(of(modifies, "commit", "entity"), "commit").join(of(path, "entity", "path"), "entity")
    return out.select("item", "commit", "entity", "path").distinct()


# ---- statuses ----


def rule_set_state(enabled: Column, projected: Column, error: Column, cache_age: Column) -> Column:
    """off, stale (the live read failed and a cache answers), degraded (it failed without one), empty or loaded."""
    return F.when(~enabled, "off").when(error.isNotNull() & cache_age.isNotNull(), "stale").when(error.isNotNull() | projected.isNull(), "degraded").when(projected == 0, "empty").otherwise("loaded")


def policy_status(tenants: DataFrame, scopes: DataFrame, mode: str) -> DataFrame:
    """(tenant, mode, scope_configured, enforcing_without_scope): a guard that enforces nothing is named as such."""
    have = F.coalesce("_has", F.lit(False))
    return tenants.select("tenant").distinct().join(scopes.select("tenant", F.lit(True).alias("_has")).distinct(), "tenant", "left").select("tenant", F.lit(mode).alias("mode"), have.alias("scope_configured"), (F.lit(mode == "enforce") & ~have).alias("enforcing_without_scope"))


def query_literal(text: Column) -> Column:
    """Text inside a double-quoted literal of a graph query."""
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))


def query_id(text: Column) -> Column:
    """Only what an item's id may hold."""
    return F.regexp_replace(text, "[^A-Za-z0-9_-]", "")
