"""Provider events (JSON text) to ledger actions, with a quarantine for what does not fit; clicks to conversion events."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values.
TOOLS = {
    "cms.publish_post": ("page.publish", "web", "url", "markdown"),
    "social.create_post": ("social.post", "organic_social", "permalink", "text"),
    "google_ads.update_budget": ("ad.budget_change", "paid_search", "campaign", None),
}
CLICKS = (("cv", r"(?i)(^|/)cv(\.html|\.pdf|$)"), ("contact", r"(?i)^mailto:|/contact"), ("agent_surface", r"(?i)llms(-full)?\.txt"), ("outbound", r"(?i)^https?://"))


def slug(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def normalise(raw: DataFrame, json_col: str = "raw") -> tuple[DataFrame, DataFrame]:
    """(actions, quarantine) from JSON events of the two providers.

    Email automations give email.send actions, agent tools page, post and budget actions. Unknown providers, action
    types and tools, and text that is no JSON go to the quarantine with the reason.
    """
    g = lambda path: F.get_json_object(json_col, path)
    rows = raw.select(F.col(json_col), g("$.provider").alias("provider"), g("$.ext_id").alias("event_id"), g("$.agent_key").alias("agent_key"), g("$.tool_call.tool").alias("tool"), g("$.action.type").alias("type"))
    tool = F.col("tool")
    reason = (
        F.when(F.col("provider").isNull(), "no provider")
        .when(F.col("provider") == "zapier", F.when(F.coalesce("type", F.lit("")) != "send_email", F.concat(F.lit("unsupported action "), F.coalesce("type", F.lit("?")))))
        .when(F.col("provider") == "lindy", F.when(~F.coalesce(tool.isin(*TOOLS), F.lit(False)), F.concat(F.lit("unsupported tool "), F.coalesce(tool, F.lit("?")))))
        .otherwise(F.concat(F.lit("unknown provider "), "provider"))
    )
    rows = rows.withColumn("reason", reason)
    label = F.coalesce(g("$.zap_title"), g("$.agent"))

    def pick(k: int) -> Column:
        return reduce(lambda out, t: F.when(tool == t[0], F.lit(t[1][k])).otherwise(out), TOOLS.items(), F.lit(None).cast("string"))

    def arg(k: int) -> Column:
        return reduce(lambda out, t: F.when(tool == t[0], g(f"$.tool_call.args.{t[1][k]}")).otherwise(out) if t[1][k] else out, TOOLS.items(), F.lit(None).cast("string"))

    email = F.col("provider") == "zapier"
    actions = rows.filter("reason is null").select(
        "event_id",
        F.coalesce(g("$.started_at"), g("$.completed_at")).try_cast("timestamp").alias("ts"),
        F.col("provider").alias("source"),
        F.coalesce("agent_key", slug(label)).alias("agent_id"),
        label.alias("agent_label"),
        F.when(F.col("agent_key").isNotNull(), "high").otherwise("medium").alias("attribution_confidence"),
        F.when(email, "email.send").otherwise(pick(0)).alias("action_type"),
        F.when(email, "email").otherwise(pick(1)).alias("channel"),
        F.when(email, g("$.action.output.subject")).otherwise(arg(2)).alias("subject_ref"),
        F.when(email, g("$.action.output.subject")).when(tool == "cms.publish_post", g("$.tool_call.args.title")).alias("subject"),
        F.when(email, g("$.action.output.body_text")).otherwise(arg(3)).alias("text"),
        g("$.tool_call.args.daily_budget_usd").try_cast("double").alias("budget_new"),
    ).withColumn("day", F.to_date("ts"))
    return actions, rows.filter("reason is not null").select(json_col, "reason")


def click_events(clicks: DataFrame, href_col: str = "href") -> DataFrame:
    """(event, clicks): the first rule that a link fits."""
    event = reduce(lambda out, r: F.when(F.col(href_col).rlike(r[1]), r[0]).otherwise(out), reversed(CLICKS), F.lit(None).cast("string"))
    return clicks.withColumn("event", event).filter("event is not null").groupBy("event").agg(F.count("*").alias("clicks"))
