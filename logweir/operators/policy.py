"""Policies: ordered first-match rules over the aggregates, their simulated effects and risks."""

from __future__ import annotations

import hashlib
import json
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.crawlers import catalog
from ..functions.numbers import ratio_ppm, zone_mib
from ..functions.urls import segment_prefix
from .rate import PROFILES

KINDS = ("allow", "deny", "rate_limit", "cache")
CATEGORIES = ("claimed_ai_crawler", "claimed_search_crawler", "claimed_other_crawler")
MAX_RULES = 100
#: MiB of a rate zone beyond which it is to be acknowledged, and beyond which it is refused.
ZONE_MIB = (32, 256)


@dataclass(frozen=True)
class Rule:
    id: str
    kind: str
    crawler_names: tuple[str, ...] = ()
    categories: tuple[str, ...] = ()
    path_prefixes: tuple[str, ...] = ()
    methods: tuple[str, ...] = ()
    rate_profile: str | None = None
    cache_ttl_seconds: int | None = None

    def condition(self, with_path: bool = True) -> str:
        """The rule as a predicate; an empty list matches everything."""
        quoted = lambda xs: ", ".join("'" + x.replace("'", "\\'") + "'" for x in xs)
        parts = []
        if self.crawler_names:
            parts.append(f"coalesce(crawler IN ({quoted(self.crawler_names)}), false)")
        if self.categories:
            parts.append(f"coalesce(category IN ({quoted(self.categories)}), false)")
        if self.methods:
            parts.append(f"coalesce(method IN ({quoted(self.methods)}), false)")
        if self.path_prefixes and with_path:
            parts.append("coalesce(" + " OR ".join(segment_prefix("actionable_prefix", p) for p in self.path_prefixes) + ", false)")
        return " AND ".join(parts) or "true"


@dataclass(frozen=True)
class Policy:
    name: str
    rules: tuple[Rule, ...]
    description: str = ""
    schema_version: int = 1
    errors: tuple[str, ...] = field(default=(), compare=False)

    def canonical(self) -> str:
        rules = [
            {"id": r.id, "match": {"crawler_names": list(r.crawler_names), "categories": list(r.categories), "path_prefixes": list(r.path_prefixes), "methods": list(r.methods)}, "action": {"kind": r.kind, "rate_profile": r.rate_profile, "cache_ttl_seconds": r.cache_ttl_seconds}}
            for r in self.rules
        ]
        text = json.dumps({"schema_version": self.schema_version, "name": self.name, "description": self.description, "rules": rules}, separators=(",", ":"), ensure_ascii=False)
        return text.replace("<", "\\u003c").replace(">", "\\u003e").replace("&", "\\u0026")

    def sha256(self) -> str:
        return hashlib.sha256(self.canonical().encode()).hexdigest()


def parse_policy(text: str) -> Policy:
    """A policy from closed JSON: every key has to be there and no other may."""

    def closed(value: dict, *keys: str) -> dict:
        if not isinstance(value, dict) or set(value) != set(keys):
            raise ValueError(f"policy object needs exactly {', '.join(keys)}")
        return value

    def no_repeats(pairs):
        if len({k for k, _ in pairs}) != len(pairs):
            raise ValueError("duplicate key")
        return dict(pairs)

    top = closed(json.loads(text, object_pairs_hook=no_repeats), "schema_version", "name", "description", "rules")
    rules = []
    for r in top["rules"]:
        closed(r, "id", "match", "action")
        m, a = closed(r["match"], "crawler_names", "categories", "path_prefixes", "methods"), closed(r["action"], "kind", "rate_profile", "cache_ttl_seconds")
        rules.append(Rule(r["id"], a["kind"], *(tuple(m[k]) for k in ("crawler_names", "categories", "path_prefixes", "methods")), a["rate_profile"], a["cache_ttl_seconds"]))
    policy = Policy(top["name"], tuple(rules), top["description"], top["schema_version"])
    validate(policy)
    return policy


def validate(policy: Policy) -> None:
    """Raises ValueError for a policy that can't be simulated or rendered."""
    names, seen, taken = {e["name"]: e["category"] for e in catalog()}, set(), set()
    if policy.schema_version != 1 or not policy.name or not 1 <= len(policy.rules) <= MAX_RULES:
        raise ValueError("invalid policy header")
    for r in policy.rules:
        if not r.id or r.id in seen:
            raise ValueError(f"rule id {r.id!r} is empty or repeated")
        seen.add(r.id)
        if r.kind not in KINDS or (r.kind == "rate_limit") != (r.rate_profile in PROFILES) or (r.kind == "cache") != (r.cache_ttl_seconds is not None):
            raise ValueError(f"rule {r.id}: invalid action")
        if missing := [n for n in r.crawler_names if n not in names]:
            raise ValueError(f"rule {r.id}: unknown crawlers {missing}")
        if any(c not in CATEGORIES for c in r.categories) or any(not p.startswith("/") for p in r.path_prefixes):
            raise ValueError(f"rule {r.id}: invalid match")
        own = {n for n in names if (not r.crawler_names or n in r.crawler_names) and (not r.categories or names[n] in r.categories)}
        own |= set() if r.crawler_names or r.categories else {"{unclaimed}"}
        if r.kind == "rate_limit" and (r.path_prefixes or r.methods or own & taken):
            raise ValueError(f"rule {r.id}: rate rules match whole crawlers that no earlier rule has")
        taken |= own


def first_match(rows: DataFrame, rules: tuple[Rule, ...], with_path: bool = True) -> DataFrame:
    """Adds rule_index of the first rule that matches, or null. CASE stops at the first hit, as the policy does."""
    cases = " ".join(f"WHEN {r.condition(with_path)} THEN {i}" for i, r in enumerate(rules))
    return rows.withColumn("rule_index", F.expr(f"CAST(CASE {cases} END AS INT)"))


def rule_impacts(cells: DataFrame, policy: Policy) -> DataFrame:
    """Per matching rule: what its cells add up to. `cells` carry crawler, category and protected_default."""
    kinds = F.array(*(F.lit(r.kind) for r in policy.rules))
    hit = first_match(cells, policy.rules).where("rule_index IS NOT NULL").withColumn("kind", F.get(kinds, F.col("rule_index")))
    sums = {
        "matched_requests": "sum(requests)",
        "denied_requests": "coalesce(sum(CASE WHEN kind = 'deny' THEN requests END), 0)",
        "allowed_requests": "coalesce(sum(CASE WHEN kind IN ('allow', 'cache') THEN requests END), 0)",
        "bytes_avoided": "coalesce(sum(CASE WHEN kind = 'deny' THEN bytes_sent END), 0)",
        "upstream_us_avoided": "CASE WHEN sum(CASE WHEN kind = 'deny' THEN requests END) = sum(CASE WHEN kind = 'deny' THEN upstream_samples END) THEN sum(CASE WHEN kind = 'deny' AND upstream_samples = requests THEN upstream_duration_us END) END",
        "cache_misses_observed": "coalesce(sum(CASE WHEN kind = 'cache' AND cache_state IN ('miss', 'bypass', 'expired') THEN requests END), 0)",
        "crawlers_affected": "array_join(array_sort(collect_set(crawler)), ',')",
        "protected_affected": "array_join(array_sort(collect_set(CASE WHEN protected_default AND kind IN ('deny', 'rate_limit') THEN crawler END)), ',')",
        "path_unclassified": "coalesce(bool_or(kind = 'deny' AND crawler IS NULL AND primary_class = 'unclassified'), false)",
    }
    return hit.groupBy("rule_index", "kind").agg(*(F.expr(v).alias(k) for k, v in sums.items()))


def simulation_totals(cells: DataFrame, impacts: DataFrame, policy: Policy) -> DataFrame:
    """Totals of a simulation without its rate rules: observed, allowed, denied, avoided and cache candidates."""
    kinds = F.array(*(F.lit(r.kind) for r in policy.rules))
    hit = first_match(cells, policy.rules).withColumn("kind", F.get(kinds, F.col("rule_index")))
    sums = {
        "observed_requests": "coalesce(sum(requests), 0)",
        "allowed_requests": "coalesce(sum(CASE WHEN kind IS NULL OR kind IN ('allow', 'cache') THEN requests END), 0)",
        "denied_requests": "coalesce(sum(CASE WHEN kind = 'deny' THEN requests END), 0)",
        "rate_matched_requests": "coalesce(sum(CASE WHEN kind = 'rate_limit' THEN requests END), 0)",
        "bytes_avoided": "coalesce(sum(CASE WHEN kind = 'deny' THEN bytes_sent END), 0)",
        "cache_candidate_requests": "coalesce(sum(CASE WHEN kind = 'cache' AND cache_state IN ('miss', 'bypass', 'expired') THEN requests END), 0)",
        "path_actionable": "coalesce(sum(CASE WHEN actionable_prefix IS NOT NULL THEN requests END), 0)",
    }
    return hit.agg(*(F.expr(v).alias(k) for k, v in sums.items()))


def rate_rule_impacts(impacts: DataFrame, policy: Policy) -> DataFrame:
    """Rate impacts joined to the first rate rule of their profile that matches. `impacts` carry crawler and category."""
    cases = " ".join(f"WHEN profile = '{r.rate_profile}' AND {r.condition()} THEN {i}" for i, r in enumerate(policy.rules) if r.kind == "rate_limit")
    hit = impacts.withColumn("method", F.lit(None).cast("string")).withColumn("actionable_prefix", F.lit(None).cast("string"))
    hit = hit.withColumn("rule_index", F.expr(f"CAST(CASE {cases} END AS INT)" if cases else "CAST(NULL AS INT)")).where("rule_index IS NOT NULL")
    return hit.groupBy("rule_index").agg(*(F.sum(c).alias(c) for c in ("modeled_requests", "allowed_requests", "limited_requests", "limited_bytes")))


def observed_states(subjects: DataFrame, policy: Policy) -> DataFrame:
    """Subjects whose first matching rate rule has each profile, and the memory a zone of them takes."""
    cases = " ".join(f"WHEN {r.condition(False)} THEN '{r.rate_profile}'" for r in policy.rules if r.kind == "rate_limit")
    hit = subjects.withColumn("method", F.lit(None).cast("string")).withColumn("profile", F.expr(f"CASE {cases} END" if cases else "CAST(NULL AS STRING)"))
    return hit.where("profile IS NOT NULL").groupBy("profile").agg(F.count("*").alias("states")).withColumn("zone_mib", F.expr(zone_mib("states")))


def top_routes(cells: DataFrame, policy: Policy, n: int = 20) -> DataFrame:
    by_route = first_match(cells, policy.rules).where("rule_index IS NOT NULL").groupBy("rule_index", "route").agg(F.sum("requests").alias("requests"))
    w = Window.partitionBy("rule_index").orderBy(F.desc("requests"), "route")
    return by_route.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def ambiguous_paths(cells: DataFrame, policy: Policy) -> DataFrame:
    """Requests in cells where a rule's prefix enters a dynamic segment, for rules up to the first match."""
    hit = first_match(cells.where("actionable_prefix IS NOT NULL AND contains(route, '{')"), policy.rules)
    rows = []
    for i, r in enumerate(policy.rules):
        if r.path_prefixes:
            enters = " OR ".join(f"(('{p.rstrip('/')}' = rtrim('/', actionable_prefix) OR startswith('{p.rstrip('/')}', concat(rtrim('/', actionable_prefix), '/')) OR rtrim('/', actionable_prefix) = '') AND NOT {segment_prefix('actionable_prefix', p)})" for p in r.path_prefixes)
            rows.append(f"CASE WHEN coalesce(rule_index, {MAX_RULES}) >= {i} AND {r.condition(False)} AND ({enters}) THEN {i} END")
    each = hit.select("requests", F.explode(F.expr(f"array_compact(array({', '.join(rows) or 'CAST(NULL AS INT)'}))")).alias("rule_index"))
    return each.groupBy("rule_index").agg(F.sum("requests").alias("requests"))


def risks(policy: Policy, impacts: list[dict], totals: dict, states: list[dict], ambiguous: set[int], modeled: dict[int, int], route_overflow: int = 0, zone_mib: tuple[int, int] = ZONE_MIB) -> list[tuple[str, str, bool]]:
    """(id, severity, acknowledgeable) from the bounded results of the simulation, sorted by id."""
    by_rule, out = {r["rule_index"]: r for r in impacts}, {}
    if route_overflow and any(r.path_prefixes for r in policy.rules):
        out["cardinality-overflow:route"] = ("high", False)
    for i, r in enumerate(policy.rules):
        hit = by_rule.get(i, {})
        restrictive = r.kind in ("deny", "rate_limit")
        out |= {f"protected-crawler:{n}": ("high", True) for n in hit.get("protected_affected", "").split(",") if n}
        if "/" in r.path_prefixes:
            out[f"broad-root-match:{r.id}"] = ("high", True)
        if r.path_prefixes and not r.crawler_names and not r.categories and hit.get("path_unclassified"):
            out[f"path-deny-unclassified:{r.id}"] = ("high", True)
        if restrictive and hit.get("matched_requests", 0) > totals["observed_requests"] // 2:
            out[f"high-impact:{r.id}"] = ("high", True)
        if r.kind == "allow" and (r.crawler_names or r.categories) and any(x.kind in ("deny", "rate_limit") for x in policy.rules[i + 1 :]):
            out[f"claimed-allow-bypass:{r.id}"] = ("medium", True)
        if r.path_prefixes and (i in ambiguous or totals["path_actionable"] < totals["observed_requests"]):
            out[f"path-normalization-drift:{r.id}"] = ("high", False) if i in ambiguous else ("medium", True)
        if r.kind == "rate_limit" and modeled.get(i, 0) != hit.get("matched_requests", 0):
            out[f"rate-coverage-incomplete:{r.id}"] = ("high", False)
        if r.kind == "cache":
            out[f"analysis-only-cache:{r.id}"] = ("info", False)
    for s in states:
        if s["zone_mib"] > zone_mib[1]:
            out[f"nginx-zone-too-large:{s['profile']}"] = ("high", False)
        elif s["zone_mib"] > zone_mib[0]:
            out[f"nginx-zone-memory:{s['profile']}:{s['zone_mib']}"] = ("high", True)
    return sorted((k, *v) for k, v in out.items())


def status(found: list[tuple[str, str, bool]]) -> str:
    hard = [r for r in found if not r[0].startswith("analysis-only-cache:")]
    if any(not ack for _, _, ack in hard):
        return "blocked"
    if len(hard) < len(found):
        return "analysis_only"
    return "requires_ack" if hard else "safe"


def coverage(totals: DataFrame) -> DataFrame:
    return totals.select(F.expr(f"CASE WHEN observed_requests > 0 THEN {ratio_ppm('path_actionable', 'observed_requests')} ELSE 1000000L END").alias("path_policy_ppm"))


def rate_coverage(totals: DataFrame, modeled: DataFrame) -> DataFrame:
    """(rule_index, matched_requests, modeled_requests, coverage_ppm) of each rate rule, and of all of them under a null
    index. `totals` has the requests that each rule matched, `modeled` those that the bucket model saw."""
    both = totals.join(modeled.select("rule_index", "modeled_requests"), "rule_index", "left").select("rule_index", "matched_requests", F.coalesce("modeled_requests", F.lit(0)).alias("modeled_requests"))
    whole = both.agg(F.sum("matched_requests").alias("matched_requests"), F.sum("modeled_requests").alias("modeled_requests")).select(F.lit(None).cast("int").alias("rule_index"), *(F.coalesce(c, F.lit(0)).alias(c) for c in ("matched_requests", "modeled_requests")))
    ppm = F.expr(f"CASE WHEN matched_requests > 0 THEN {ratio_ppm('modeled_requests', 'matched_requests')} ELSE 1000000L END")
    return both.unionByName(whole).withColumn("coverage_ppm", ppm)


def acknowledged(found: list[tuple[str, str, bool]], acks: list[str]) -> bool:
    """Whether the acknowledgements given are exactly the risks that can be acknowledged, each once."""
    return len(set(acks)) == len(acks) and set(acks) == {risk for risk, _, ok in found if ok}
