"""Sustained-condition alert rules in batch form.

Per rule: evaluate conditions -> keep the last reading of each evaluation
interval -> runs of true readings -> fire once when a run has lasted long
enough -> cooldown -> notification limits -> resolve -> escalate.

Work on readings is partitioned by (key, time chunk), not by key. Each chunk
also sees the tail of the one before it (a halo as long as the longest sustain
time plus two gaps), which is all that a firing decision can depend on.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from zonelytics.functions.formulas import fill_template
from zonelytics.functions.timebins import AsOf, as_of_col
from zonelytics.operators.joins import asof_join
from zonelytics.operators.windows import running_total
from zonelytics.session import cut

OPERATORS = {"GreaterThan": ">", "LessThan": "<", "GreaterThanOrEqual": ">=", "LessThanOrEqual": "<=", "Equals": "="}


def to_sql(expression: str) -> str:
    """Rule text to Spark SQL: only the equality sign differs."""
    return re.sub(r"==", "=", expression)


@dataclass(frozen=True)
class Branch:
    name: str
    condition: str
    sustain: int = 0


@dataclass(frozen=True)
class Rule:
    name: str
    branches: tuple[Branch, ...]
    key: str = "zone_id"
    interval: int = 30
    cooldown: int = 900
    severity: str = "critical"
    resolve: str | None = None
    resolve_message: str = ""
    source_filter: str | None = None
    labels: tuple[str, ...] = ()
    measures: dict[str, str] = field(default_factory=dict)
    actions: tuple[dict, ...] = ()
    enabled: bool = True

    @property
    def gap(self) -> int:
        """A pause longer than this ends a run."""
        return 2 * self.interval

    @staticmethod
    def from_dict(d: dict) -> Rule:
        """A rule from its data form (condition types BECOMES, AND, OR)."""
        cond = d["condition"]
        measures = {m["alias"]: to_sql(m["expression"]) for m in [*d.get("measures", []), *([d["measure"]] if "measure" in d else [])]}
        sustain = cond.get("sustained_duration_seconds", 0)

        def test(c: dict) -> str:
            if "expression" in c:
                return to_sql(c["expression"])
            what = c.get("measure") or c.get("measure_expression") or next(iter(measures))
            return f"({measures.get(what, what)}) {OPERATORS[c['operator']]} {float(c['threshold'])!r}D"

        if cond["type"] == "OR":
            branches = tuple(Branch(c["name"], test(c), c.get("sustained_duration_seconds", sustain)) for c in cond["sub_conditions"])
        elif cond["type"] == "AND":
            branches = (Branch(d["name"], " AND ".join(test(c) for c in cond["sub_conditions"]), sustain),)
        else:
            branches = (Branch(d["name"], test(cond), sustain),)
        auto = d.get("auto_resolve", {})
        return Rule(
            name=d["name"], branches=branches, key=d["object_id_column"], interval=cond.get("evaluation_interval_seconds", 30),
            cooldown=int(d["cooldown_minutes"] * 60), severity=d["severity"],
            resolve=to_sql(auto["condition"]) if auto.get("enabled") else None, resolve_message=auto.get("message", ""),
            source_filter=to_sql(d["source"]["filter"]) if d.get("source", {}).get("filter") else None,
            labels=tuple(d.get("grouping_columns", ())), measures=measures, actions=tuple(d.get("actions", ())), enabled=d.get("enabled", True),
        )


def evaluated(df: DataFrame, rules: Sequence[Rule], ts: str = "timestamp", tie: Sequence[str] = (), carry: Sequence[str] = ()) -> DataFrame:
    """Condition results per reading (``_c<rule>_<branch>``, ``_res<rule>``); what the rules do not need is dropped here."""
    first = rules[0]
    if any((r.key, r.interval, r.source_filter) != (first.key, first.interval, first.source_filter) for r in rules):
        raise ValueError("rules of one pass share key, evaluation interval and source filter")
    src = df.filter(first.source_filter) if first.source_filter else df
    measures = {a: F.expr(e) for r in rules for a, e in r.measures.items()}
    src = src.withColumns(measures) if measures else src
    yes = lambda e: F.coalesce(F.expr(e), F.lit(False))
    keep = [c for c in carry if c not in (first.key, ts, *tie)] + [a for a in measures if carry and a not in carry]
    conditions = [yes(b.condition).alias(f"_c{n}_{i}") for n, r in enumerate(rules) for i, b in enumerate(r.branches)]
    resolves = [(yes(r.resolve) if r.resolve else F.lit(False)).alias(f"_res{n}") for n, r in enumerate(rules)]
    return src.select(first.key, ts, *tie, *keep, *conditions, *resolves)


def rule_pass(
    df: DataFrame, rules: Sequence[Rule], ts: str = "timestamp", tie: Sequence[str] = (), carry: Sequence[str] = (), chunk: int = 21600
) -> DataFrame:
    """One pass over the readings for all rules of a source.

    Returns the readings at which something happens: per rule ``fired<n>`` (a
    branch has just held long enough), ``branch<n>`` and ``resolves<n>`` (the
    resolve condition has just turned true). Readings are reduced to one per
    interval first; the halo copies and the windows work on those.
    """
    rows = evaluated(df, rules, ts, tie, carry)
    # the last reading of each interval, with partial aggregation before anything is exchanged
    rest = [c for c in rows.columns if c != rules[0].key]
    newest = F.max_by(F.struct(*rest), F.struct(ts, *tie))
    rows = rows.groupBy(rules[0].key, F.floor(F.unix_seconds(ts) / rules[0].interval).alias("_slot")).agg(newest.alias("_last")).select(rules[0].key, "_slot", "_last.*")
    key, interval, gap = rules[0].key, rules[0].interval, rules[0].gap
    halo = max(b.sustain for r in rules for b in r.branches) + 2 * gap
    halo += -halo % interval
    chunk = max(chunk, halo)  # a halo reaches into the next chunk only
    chunk += -chunk % interval
    sec = F.unix_seconds(ts)
    home = F.floor(sec / chunk)
    near_end = sec >= (home + 1) * chunk - halo
    rows = rows.withColumn("_home", home)
    rows = rows.withColumn("_chunk", F.explode(F.when(near_end, F.array(home, home + 1)).otherwise(F.array(home))))
    w = Window.partitionBy(key, "_chunk").orderBy(ts, *tie)
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    no = lambda c: F.coalesce(c, F.lit(False))
    us = F.unix_micros(ts)
    rows = rows.withColumn("_joined", no(us - F.lag(us).over(w) <= gap * 1_000_000))
    names = [(n, i, b) for n, r in enumerate(rules) for i, b in enumerate(r.branches)]
    rows = rows.withColumns(
        {f"_s{n}_{i}": F.col(f"_c{n}_{i}") & ~(F.col("_joined") & no(F.lag(f"_c{n}_{i}").over(w))) for n, i, _ in names}
    )
    rows = rows.withColumns({f"_b{n}_{i}": F.last(F.when(F.col(f"_s{n}_{i}"), us), ignorenulls=True).over(upto) for n, i, _ in names})
    rows = rows.withColumns({f"_o{n}_{i}": no(F.col(f"_c{n}_{i}") & (us - F.col(f"_b{n}_{i}") >= b.sustain * 1_000_000)) for n, i, b in names})
    rows = rows.withColumns(
        {f"_f{n}_{i}": F.col(f"_o{n}_{i}") & (F.col(f"_s{n}_{i}") | ~no(F.lag(f"_o{n}_{i}").over(w))) for n, i, _ in names}
    )
    out: dict[str, Column] = {}
    for n, r in enumerate(rules):
        fired = F.lit(False)
        for i in range(len(r.branches)):
            fired = fired | F.col(f"_f{n}_{i}")
        out[f"fired{n}"] = fired
        out[f"branch{n}"] = F.coalesce(*[F.when(F.col(f"_f{n}_{i}"), F.lit(b.name)) for i, b in enumerate(r.branches)])
        out[f"resolves{n}"] = F.col(f"_res{n}") & ~no(F.lag(f"_res{n}").over(w))
    rows = rows.withColumns(out)
    happens = F.lit(False)
    for n in range(len(rules)):
        happens = happens | F.col(f"fired{n}") | F.col(f"resolves{n}")
    hidden = [c for c in rows.columns if c.startswith("_")]
    return rows.filter((F.col("_chunk") == F.col("_home")) & happens).drop(*hidden)


def _of_rule(events: DataFrame, n: int, rules: Sequence[Rule]) -> DataFrame:
    """The rows of one rule of a pass, with plain column names."""
    others = [f"{c}{m}" for m in range(len(rules)) if m != n for c in ("fired", "branch", "resolves")]
    own = events.drop(*others).withColumnsRenamed({f"{c}{n}": c for c in ("fired", "branch", "resolves")})
    return own.filter(F.col("fired") | F.col("resolves"))


def rule_events(df: DataFrame, rule: Rule, ts: str = "timestamp", tie: Sequence[str] = (), carry: Sequence[str] = (), chunk: int = 21600) -> DataFrame:
    """The pass for a single rule: ``fired``, ``branch``, ``resolves``."""
    return _of_rule(rule_pass(df, [rule], ts, tie, carry, chunk), 0, [rule])


def spaced(df: DataFrame, by: Sequence[str], ts: str, seconds: int, chunk: int = 86400, tie: Sequence[str] = ()) -> DataFrame:
    """Greedy thinning: a row stays when it is at least ``seconds`` after the last row kept before it.

    Of several rows of a key at one kept instant the first by ``tie`` stays (without it: by all columns).
    NULL keys are a key; rows without a time are dropped.

    Exact, and no key's history is gathered. An instant with none of its key within ``seconds`` before it is
    always kept. Every other pick follows from a link: the first instant ``seconds`` or more after a pick, which
    lies within twice that, so links are found in windows of one (key, time chunk) with neighbours' edges. Picks are then
    what can be reached from the sure ones, by pointer jumping: each round doubles the reach of all links with one join,
    so a burst of n picks takes log2(n) rounds.
    """
    gap = seconds * 1_000_000
    span = max(chunk * 1_000_000, 2 * gap, 1)
    t, whole = F.unix_micros(ts), F.struct(*[F.col(c) for c in by])
    times = df.filter(F.col(ts).isNotNull()).select(whole.alias("_key"), t.alias("_t")).distinct()
    home = F.floor(F.col("_t") / span)
    into = F.col("_t") - home * span
    near = F.array_compact(F.array(home, F.when(into < 2 * gap, home - 1), F.when(into >= span - gap, home + 1)))
    spread = times.withColumns({"_home": home, "_chunk": F.explode(near)})
    w = Window.partitionBy("_key", "_chunk").orderBy("_t")
    found = {"_sure": F.coalesce(F.col("_t") - F.lag("_t").over(w) >= gap, F.lit(True)), "_to": F.min("_t").over(w.rangeBetween(gap, 2 * gap))}
    rows = cut(spread.withColumns(found).filter("_chunk = _home").select("_key", "_t", "_sure", "_to"), "spaced")
    # picks have no start; a link to a sure pick is not needed
    sure = rows.filter("_sure").select("_key", F.lit(None).cast("bigint").alias("_from"), F.col("_t").alias("_to"))
    links = rows.filter("_to is not null").select("_key", F.col("_t").alias("_from"), "_to")
    state = cut(sure.unionByName(links.join(sure.select("_key", "_to"), ["_key", "_to"], "left_anti")), "spaced")
    while not (links := state.filter("_from is not null")).isEmpty():
        onward = links.select("_key", F.col("_from").alias("_to"), F.col("_to").alias("_next"))
        further = state.join(onward, ["_key", "_to"]).select("_key", "_from", F.col("_next").alias("_to"))
        state = cut(further.unionByName(state.filter("_from is null")), "spaced")
    picks = state.select(F.col("_key"), F.col("_to").alias("_t"))
    kept = df.withColumns({"_key": whole, "_t": t}).join(picks, ["_key", "_t"], "left_semi")
    order = [F.col(c) for c in tie] or [F.xxhash64(*[F.col(f"`{c}`") for c in df.columns])]
    one = Window.partitionBy("_key", "_t").orderBy(*order)
    return kept.withColumn("_n", F.row_number().over(one)).filter("_n = 1").select(*[F.col(f"`{c}`") for c in df.columns])


def settle(events: DataFrame, rule: Rule, ts: str = "timestamp", tie: Sequence[str] = (), dedup: int = 300) -> DataFrame:
    """Alerts from a rule's events: cooldown, duplicate suppression, resolve time."""
    alerts = spaced(events.filter("fired"), [rule.key], ts, rule.cooldown, tie=tie)
    if dedup > rule.cooldown:  # rows are already further apart otherwise
        alerts = spaced(alerts, [rule.key], ts, dedup, tie=tie)
    alerts = alerts.drop("fired", "resolves", *tie)
    if rule.resolve:
        ends = events.filter("resolves").select(rule.key, F.col(ts).alias("_at"), ts)
        alerts = asof_join(alerts, ends, [rule.key], ts, direction="forward", strict=True, chunk=86400)
        alerts = alerts.withColumn("resolved_at", F.col("_at")).drop("_at", f"right_{ts}")
    else:
        alerts = alerts.withColumn("resolved_at", F.lit(None).cast("timestamp"))
    return alerts.withColumns({"rule": F.lit(rule.name), "severity": F.lit(rule.severity)})


def fire(df: DataFrame, rule: Rule, ts: str = "timestamp", tie: Sequence[str] = (), carry: Sequence[str] = (), dedup: int = 300) -> DataFrame:
    """Alerts of one rule with their resolve time.

    The pass over the readings runs here, once: its few firing and resolving
    rows are written out, and the later steps work on those.
    """
    return settle(cut(rule_events(df, rule, ts, tie, carry), "rule-events"), rule, ts, tie, dedup)


def fire_all(df: DataFrame, rules: Sequence[Rule], ts: str = "timestamp", tie: Sequence[str] = (), dedup: int = 300) -> list[DataFrame]:
    """Alerts of several rules of one source from a single pass over its readings."""
    events = cut(rule_pass(df, rules, ts, tie), "rule-events")
    return [settle(_of_rule(events, n, rules), r, ts, tie, dedup) for n, r in enumerate(rules)]


def throttle(alerts: DataFrame, ts: str = "timestamp", key: str = "zone_id", per_key: int = 3, overall: int = 50) -> DataFrame:
    """Notification limits on clock hours: first per key, then over all keys; at one instant by rule, branch and alert id.

    Both ranks are limits, so Spark cuts each task's rows before the exchange;
    the overall hour group receives at most ``overall`` rows per task.
    """
    hour = F.date_trunc("hour", ts)
    last = ["rule", *[c for c in ("branch", "alert_id") if c in alerts.columns]]
    own = Window.partitionBy(key, hour).orderBy(ts, *last)
    some = alerts.withColumn("_n", F.row_number().over(own)).filter(F.col("_n") <= per_key)
    every = Window.partitionBy(hour).orderBy(ts, key, *last)
    return some.withColumn("_n", F.row_number().over(every)).filter(F.col("_n") <= overall).drop("_n")


def escalate(alerts: DataFrame, acks: DataFrame, as_of: AsOf = None, delay_minutes: int = 30, ts: str = "timestamp", key: str = "zone_id") -> DataFrame:
    """Critical alerts nobody acknowledged within the delay. ``acks`` holds (key, rule, ack_time).

    Each alert meets only the next acknowledgement of its key and rule.
    """
    now = as_of_col(alerts, as_of, ts)
    wait = F.expr(f"INTERVAL {int(delay_minutes)} MINUTE")
    due = alerts.filter((F.col("severity") == "critical") & (F.col(ts) + wait <= now))
    answers = acks.select(key, "rule", F.col("ack_time").alias(ts)).distinct()
    paired = asof_join(due, answers, [key, "rule"], ts, direction="forward", chunk=86400, prefix="_ack_")
    late = paired.filter(F.col(f"_ack_{ts}").isNull() | (F.col(f"_ack_{ts}") > F.col(ts) + wait)).drop(f"_ack_{ts}")
    return late.withColumn("escalated_at", F.col(ts) + wait)


def action_rows(alerts: DataFrame, rule: Rule) -> DataFrame:
    """One row per alert and action with the filled templates. Nothing is sent."""
    made = []
    for n, action in enumerate(rule.actions):
        fill = lambda text: fill_template(text, alerts.columns)
        template = action.get("template", {})
        params = action.get("parameters", {})
        entries = [x for k, v in params.items() for x in (F.lit(k), fill(v))]
        made.append(
            F.struct(
                F.lit(n + 1).alias("action_no"), F.lit(action["type"]).alias("action_type"),
                F.lit(action.get("channel") or ",".join(action.get("recipients", [])) or action.get("notebook_name")).alias("target"),
                fill(template.get("title") or template.get("subject") or action.get("description", "")).alias("subject"),
                fill(template.get("body", "")).alias("body"),
                (F.to_json(F.create_map(*entries)) if entries else F.lit(None).cast("string")).alias("parameters"),
            )
        )
    return alerts.select("*", F.explode(F.array(*made)).alias("_a")).select(*alerts.columns, "_a.*")


def to_alert_table(alerts: DataFrame, rule: Rule, alert_type: str, score: Column | None = None, ts: str = "timestamp") -> DataFrame:
    """Rows in the alert table's schema; the id is derived from rule, key and time, so reruns agree."""
    raw = F.concat_ws("|", F.lit(rule.name), F.col(rule.key), F.col(ts).cast("string"))
    return alerts.select(
        F.col(ts).alias("timestamp"), F.concat(F.lit("ALR-"), F.substring(F.sha2(raw, 256), 1, 16)).alias("alert_id"),
        F.col("greenhouse_id") if "greenhouse_id" in alerts.columns else F.lit(None).cast("string").alias("greenhouse_id"),
        F.col(rule.key).alias("zone_id"), F.lit(rule.severity).alias("severity"), F.lit(alert_type).alias("alert_type"),
        F.concat(F.lit(f"{rule.name}: "), F.coalesce("branch", F.lit(""))).alias("message"),
        (score if score is not None else F.lit(None).cast("double")).alias("anomaly_score"), F.lit(False).alias("acknowledged"),
    )


def daily_ids(df: DataFrame, prefix: str, ts: str, order: Sequence[str], name: str = "id") -> DataFrame:
    """Ids like ``ANM-20240115-0003``, numbered per day in the given order.

    Rows are ranked per minute and offset by the counts of the minutes before,
    so a busy day does not end up in one task.
    """
    rows = df.withColumns({"_day": F.to_date(ts), "_one": F.lit(1.0)})
    minute = F.floor(F.unix_seconds(ts) / 60)
    counted = running_total(rows, "_one", ["_day"], [ts, *order], minute, "_before")
    number = F.format_string("-%04d", F.col("_before").cast("bigint") + 1)
    return counted.withColumn(name, F.concat(F.lit(f"{prefix}-"), F.date_format(ts, "yyyyMMdd"), number)).drop("_day", "_one", "_before")
