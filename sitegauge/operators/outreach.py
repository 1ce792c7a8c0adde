"""Mail state, funnels, suppression, limits, proposals, templates."""

from __future__ import annotations

import datetime as dt
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ranks import numbered

# Limits of a user without settings, statuses that count as sent, order of mail states.
LIMITS = {"emails_per_hour": 10, "emails_per_day": 50, "emails_per_domain_day": 3}
MAIL_SENT = ["sent", "delivered", "opened", "clicked"]
OFFER_SENT = ["sent", "opened", "clicked", "responded", "converted"]
MAIL_ORDER = ["sent", "delivered", "opened", "clicked", "bounced", "complained"]
EVENT_STATE = {"send": "sent", "delivery": "delivered", "open": "opened", "click": "clicked", "bounce": "bounced", "complaint": "complained"}


def rate(part: Column, whole: Column) -> Column:
    """Percent with two digits; 0 without a whole."""
    return F.when(whole > 0, F.round(part / whole * 100, 2)).otherwise(0.0)


def mail_stats(logs: DataFrame, start: dt.datetime | None = None, end: dt.datetime | None = None) -> DataFrame:
    """Messages of each user by current status with rates (E1); opened_ever and clicked_ever go by time stamps, which a later state
    does not undo."""
    rows = logs if start is None else logs.where(F.col("created_at") >= F.lit(start))
    rows = rows if end is None else rows.where(F.col("created_at") <= F.lit(end))
    is_ = lambda s: F.count_if(F.col("status") == s)
    out = rows.groupBy("user_id").agg(
        F.count("*").alias("total"), F.count_if(F.col("status").isin(MAIL_SENT)).alias("sent"), *(is_(s).alias(s) for s in ("delivered", "opened", "clicked", "bounced", "complained", "failed")),
        F.count("opened_at").alias("opened_ever"), F.count("clicked_at").alias("clicked_ever"),
    )
    return out.select("*", *(rate(F.col(c), F.col("sent")).alias(n) for c, n in (("delivered", "delivery_rate"), ("opened", "open_rate"), ("clicked", "click_rate"))), rate(F.col("bounced"), F.col("sent")).alias("bounce_rate"))


def offer_funnel(offers: DataFrame, since: dt.datetime | None = None) -> DataFrame:
    """Offers of each user: sent by status, later steps by time stamp, and rates."""
    rows = offers if since is None else offers.where(F.col("created_at") >= F.lit(since))
    steps = ("opened", "clicked", "responded", "converted")
    out = rows.groupBy("user_id").agg(F.count("*").alias("total"), F.count_if(F.col("status").isin(OFFER_SENT)).alias("sent"), *(F.count(f"{s}_at").alias(s) for s in steps))
    return out.select("*", *(rate(F.col(s), F.col("sent")).alias(n) for s, n in zip(steps, ("open_rate", "click_rate", "response_rate", "conversion_rate"), strict=True)))


def status_counts(rows: DataFrame) -> DataFrame:
    """Offers or proposals by user and status."""
    return rows.groupBy("user_id", "status").agg(F.count("*").alias("n"))


def fold_mail(events: DataFrame, message: str = "message_id", at: str = "event_time", kind: str = "type") -> DataFrame:
    """Events to the state of each message: first times, and the status that ranks highest; neither depends on their order.
    A click implies an open; a permanent bounce is hard, others soft; a complaint counts as bounce type."""
    first = lambda *kinds: F.min(F.when(F.col(kind).isin(*kinds), F.col(at)))
    place = F.lit(None).cast("int")
    for i, k in enumerate(EVENT_STATE):
        place = F.when(F.col(kind) == k, F.lit(i)).otherwise(place)
    bounce = F.when(F.col(kind) == "complaint", "complaint").when((F.col(kind) == "bounce") & (F.col("bounce_type") == "Permanent"), "hard").when(F.col(kind) == "bounce", "soft")
    strength = F.when(bounce == "complaint", 3).when(bounce == "hard", 2).when(bounce == "soft", 1)
    out = events.groupBy(message).agg(
        first("send").alias("sent_at"), first("delivery").alias("delivered_at"), first("open", "click").alias("opened_at"), first("click").alias("clicked_at"),
        first("bounce", "complaint").alias("bounced_at"), F.max_by(bounce, strength).alias("bounce_type"), F.max(place).alias("_p"), F.max(at).alias("last_event_at"),
    )
    return out.withColumn("status", F.get(F.array(*(F.lit(s) for s in MAIL_ORDER)), F.col("_p"))).drop("_p")


def fold_offers(offers: DataFrame, hits: DataFrame) -> DataFrame:
    """Opens and clicks (token, type, event_time) folded into offers; an unknown token and an offer that was never sent are left (E5)."""
    first = lambda *kinds: F.min(F.when(F.col("type").isin(*kinds), F.col("event_time")))
    folded = hits.groupBy(F.col("token").alias("tracking_token")).agg(first("open", "click").alias("_o"), first("click").alias("_c"))
    joined = offers.join(folded, "tracking_token", "left")
    sent = F.col("sent_at").isNotNull()
    joined = joined.withColumn("opened_at", F.when(sent, F.least("opened_at", "_o")).otherwise(F.col("opened_at"))).withColumn("clicked_at", F.when(sent, F.least("clicked_at", "_c")).otherwise(F.col("clicked_at")))
    status = F.when(F.col("status").isin("sent", "opened") & F.col("clicked_at").isNotNull(), "clicked").when((F.col("status") == "sent") & F.col("opened_at").isNotNull(), "opened").otherwise(F.col("status"))
    return joined.withColumn("status", status).select(*offers.columns)


def suppression_entries(events: DataFrame, stored: DataFrame, kind: str = "type") -> DataFrame:
    """New entries (email, user_id, type): permanent bounces and complaints for all, unsubscriptions for the user, none twice."""
    entry = F.when((F.col(kind) == "bounce") & (F.col("bounce_type") == "Permanent"), "hard_bounce").when(F.col(kind) == "complaint", "complaint").when(F.col(kind) == "unsubscribe", "unsubscribe")
    rows = events.select(F.lower(F.trim("email")).alias("email"), F.when(entry == "unsubscribe", F.col("user_id")).alias("user_id"), entry.alias("type"), "event_time").where("type is not null and email is not null")
    w = Window.partitionBy("email", "user_id").orderBy("event_time", "type")
    rows = rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
    old = stored.select(F.lower("email").alias("_e"), F.col("user_id").alias("_u"))
    return rows.join(old, (F.col("email") == F.col("_e")) & F.col("user_id").eqNullSafe(F.col("_u")), "left_anti")


def suppressed(mails: DataFrame, blacklist: DataFrame, keep: bool = False) -> DataFrame:
    """Mails (email, user_id) that no entry, global or of the user, suppresses; with ``keep`` those that one does."""
    entries = blacklist.select(F.lower("email").alias("_e"), F.col("user_id").alias("_u")).distinct()
    everywhere = entries.where("_u is null").select("_e", F.lit(True).alias("_g"))
    own = entries.where("_u is not null").select("_e", "_u", F.lit(True).alias("_o"))
    marked = mails.withColumn("_e", F.lower("email")).join(everywhere, "_e", "left")
    marked = marked.join(own.withColumnRenamed("_u", "user_id"), ["_e", "user_id"], "left")
    hit = F.coalesce("_g", "_o", F.lit(False))
    return marked.where(hit if keep else ~hit).select(*mails.columns)


def suppression_list(blacklist: DataFrame, user_id: object = None, types: list[str] | None = None) -> DataFrame:
    """Global entries, or those of a user, of some types, newest first."""
    rows = blacklist.where(F.col("user_id").isNull() if user_id is None else F.col("user_id") == F.lit(user_id))
    return (rows if types is None else rows.where(F.col("type").isin(types))).orderBy(F.desc("created_at"), "email")


def suppression_counts(blacklist: DataFrame) -> DataFrame:
    return blacklist.groupBy("type", F.col("user_id").isNull().alias("is_global")).agg(F.count("*").alias("n"))


def mail_domain(email: Column) -> Column:
    return F.lower(F.substring_index(email, "@", -1))


def usage(sends: DataFrame, as_of: dt.datetime) -> tuple[DataFrame, DataFrame]:
    """Sends of each user in the hour before ``as_of`` and since its midnight, and since midnight by recipient domain."""
    midnight = dt.datetime.combine(as_of.date(), dt.time())
    at = F.col("sent_at")
    today = sends.where((at >= F.lit(min(midnight, as_of - dt.timedelta(hours=1)))) & (at <= F.lit(as_of)))
    by_user = today.groupBy("user_id").agg(F.count_if(at >= F.lit(as_of - dt.timedelta(hours=1))).alias("per_hour"), F.count_if(at >= F.lit(midnight)).alias("per_day"))
    by_domain = today.where(at >= F.lit(midnight)).groupBy("user_id", mail_domain(F.col("to_email")).alias("domain")).agg(F.count("*").alias("per_domain_day"))
    return by_user, by_domain


def rolling_sends(sends: DataFrame, at: str = "sent_at", seconds: int = 3600) -> DataFrame:
    """Each send with the number of its user's sends in the hour up to it.

    Sends are counted by instant, in blocks of so many seconds of a user, which spread over tasks.  An instant enters a block with its
    count, and leaves the next block again when the window has passed it; what is in the window is the running sum of both, so the
    time goes by the number of instants, however many of them a window has.
    """
    span = seconds * 1_000_000
    timed = sends.withColumn("_us", F.unix_micros(F.col(at).cast("timestamp")))
    counts = timed.groupBy("user_id", "_us").agg(F.count("*").alias("_n")).withColumn("_block", F.floor(F.col("_us") / span))
    after = F.col("_block") + 1
    own = F.struct("_block", "_us", "_n", F.lit(True).alias("_own"))
    enters = F.struct(after.alias("_block"), (after * span).alias("_us"), F.col("_n"), F.lit(False).alias("_own"))
    leaves = F.struct(after.alias("_block"), (F.col("_us") + span + 1).alias("_us"), (-F.col("_n")).alias("_n"), F.lit(False).alias("_own"))
    steps = counts.select("user_id", F.explode(F.when(F.col("_us").isNull(), F.array(own)).otherwise(F.array(own, enters, leaves))).alias("s")).select("user_id", "s.*")
    w = Window.partitionBy("user_id", "_block").orderBy("_us").rangeBetween(Window.unboundedPreceding, 0)
    summed = steps.withColumn("in_last_hour", F.sum("_n").over(w)).where("_own")
    summed = summed.select(F.col("user_id").alias("_user"), F.col("_us").alias("_at"), "in_last_hour")
    return timed.join(summed, F.col("user_id").eqNullSafe(F.col("_user")) & F.col("_us").eqNullSafe(F.col("_at"))).select(*sends.columns, "in_last_hour")


def decide(requests: DataFrame, by_user: DataFrame, by_domain: DataFrame, settings: DataFrame | None, as_of: dt.datetime) -> DataFrame:
    """Requests (user_id, to_email) with allowed, the first limit that fails, seconds to wait, and what is left of each limit."""
    rows = requests.withColumn("domain", mail_domain(F.col("to_email")))
    if settings is not None:
        rows = rows.join(settings.select("user_id", *LIMITS), "user_id", "left")
    for name, n in LIMITS.items():
        rows = rows.withColumn(name, F.coalesce(name, F.lit(n)) if name in rows.columns else F.lit(n))
    rows = rows.join(by_user, "user_id", "left").join(by_domain, ["user_id", "domain"], "left").fillna(0, ["per_hour", "per_day", "per_domain_day"])
    hour = as_of.replace(minute=0, second=0, microsecond=0) + dt.timedelta(hours=1)
    day = dt.datetime.combine(as_of.date(), dt.time()) + dt.timedelta(days=1)
    failed = F.when(F.col("per_hour") >= F.col("emails_per_hour"), "hour").when(F.col("per_day") >= F.col("emails_per_day"), "day").when(F.col("per_domain_day") >= F.col("emails_per_domain_day"), "domain_day")
    wait = F.when(failed == "hour", int((hour - as_of).total_seconds())).when(failed.isNotNull(), int((day - as_of).total_seconds()))
    left = lambda limit, used: F.greatest(F.lit(0), F.col(limit) - F.col(used))
    return rows.select(
        *requests.columns, failed.isNull().alias("allowed"), failed.alias("failed_limit"), wait.alias("retry_after"), left("emails_per_hour", "per_hour").alias("left_hour"),
        left("emails_per_day", "per_day").alias("left_day"), left("emails_per_domain_day", "per_domain_day").alias("left_domain_day"),
    )


def reuse_proposals(requests: DataFrame, proposals: DataFrame) -> DataFrame:
    """Requests (request_id, industry, type) paired with the oldest rejected, made, untouched, recyclable proposals, one each."""
    free = proposals.where((F.col("status") == "rejected") & F.col("is_ai_generated") & ~F.col("is_customized") & F.col("recyclable"))
    free = numbered(free, ["industry", "type"], ["created_at", "proposal_id"], "_n").select("industry", "type", "_n", "proposal_id")
    asked = numbered(requests, ["industry", "type"], ["request_id"], "_n")
    return asked.join(free, ["industry", "type", "_n"], "left").drop("_n")


def expire_proposals(proposals: DataFrame, as_of: dt.datetime) -> DataFrame:
    """Past their date, and neither used, recycled nor expired, they expire."""
    late = (F.col("expires_at") < F.lit(as_of)) & ~F.col("status").isin("used", "recycled", "expired")
    return proposals.withColumn("status", F.when(F.coalesce(late, F.lit(False)), "expired").otherwise(F.col("status")))


def choose_template(requests: DataFrame, user_templates: DataFrame, templates: DataFrame) -> DataFrame:
    """The template of each request (request_id, user_id, name, industry): the user's of that name, then the global one of name and
    industry, of the name, the user's default, the industry's default, the global default (E13)."""
    active = user_templates.where(F.coalesce("is_active", F.lit(True)))
    mine = active.where("user_id is not null")
    columns = ["name", "industry", "is_default", "template_id"]
    templates = templates.select(*columns).unionByName(active.where("user_id is null").withColumn("industry", F.lit(None).cast("string")).select(*columns))
    by_default, plain, of_industry = F.col("is_default"), F.col("industry").isNull(), F.col("industry").isNotNull()
    # of each key one template, so that a request meets one of each kind, however many share a name
    kinds = [
        (mine, ["user_id", "name"]), (templates.where(of_industry), ["name", "industry"]), (templates.where(plain), ["name"]), (mine.where(by_default), ["user_id"]),
        (templates.where(of_industry & by_default), ["industry"]), (templates.where(plain & by_default), []),
    ]
    out = requests
    for i, (rows, keys) in enumerate(kinds, 1):
        best = rows.groupBy(*(F.col(k).alias(f"_key_{k}") for k in keys)).agg(F.min("template_id").alias(f"_t{i}"))
        same = reduce(Column.__and__, (F.col(k) == F.col(f"_key_{k}") for k in keys), F.lit(True))
        out = (out.join(best, same, "left") if keys else out.crossJoin(F.broadcast(best))).drop(*(f"_key_{k}" for k in keys))  # without keys: one row
    found = [F.col(f"_t{i}") for i in range(1, len(kinds) + 1)]
    rank = F.coalesce(*(F.when(t.isNotNull(), i) for i, t in enumerate(found, 1)))
    return out.select(*requests.columns, F.coalesce(*found).alias("template_id"), rank.alias("rank"))


def render(sends: DataFrame, template: str = "template", variables: str = "variables") -> DataFrame:
    """The template with each {{key}} replaced by its value of the map."""
    step = lambda acc, e: F.replace(acc, F.concat(F.lit("{{"), e["key"], F.lit("}}")), F.coalesce(e["value"], F.lit("")))
    return sends.withColumn("rendered", F.aggregate(F.map_entries(variables), F.col(template), step))


def notes_by_tag(notes: DataFrame, tag: str) -> DataFrame:
    return notes.where(F.array_contains("tags", tag))


def without_blacklisted(companies: DataFrame, notes: DataFrame) -> DataFrame:
    """Companies that the user has not blacklisted; companies come with user_id."""
    return companies.join(notes.where("relationship_status = 'blacklisted'").select("user_id", "company_id"), ["user_id", "company_id"], "left_anti")


def expiring_certificates(results: DataFrame, runs: DataFrame, leads: DataFrame, days: int = 30) -> DataFrame:
    """Certificates of the latest runs that expire within some days, as a list for each user."""
    latest = runs.groupBy("lead_id").agg(F.max_by("analysis_id", F.struct("created_at", "analysis_id")).alias("analysis_id"))
    left = F.get_json_object("raw_data", "$.ssl.expiresDays").try_cast("int")
    found = results.where(F.col("category") == "http").withColumn("days", left).where((F.col("days") > 0) & (F.col("days") <= days))
    joined = found.join(latest, "analysis_id").join(leads.select("lead_id", "user_id", "domain"), "lead_id")
    return joined.groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("days", "domain"))).alias("certificates"))


def ready_for_proposal(leads: DataFrame, proposals: DataFrame, most: int | None = None) -> DataFrame:
    """Analysed leads without proposal that are not dismissed and are manual or have an e-mail, best score first."""
    rows = leads.where((F.col("analyzed_at").isNotNull()) & (F.col("status") != "dismissed") & ((F.col("source") == "manual") | F.col("email").isNotNull()))
    rows = rows.join(proposals.select("lead_id").distinct(), "lead_id", "left_anti").orderBy(F.desc_nulls_last("score"), "lead_id")
    return rows if most is None else rows.limit(most)


def ready_for_offer(leads: DataFrame, runs: DataFrame, offers: DataFrame) -> DataFrame:
    """Analysed leads with e-mail to which their user has made no offer."""
    rows = leads.where("email is not null").join(runs.select("lead_id").distinct(), "lead_id", "left_semi")
    return rows.join(offers.select("lead_id", "user_id").distinct(), ["lead_id", "user_id"], "left_anti")


def send_queue(offers: DataFrame, blacklist: DataFrame, by_user: DataFrame, by_domain: DataFrame, settings: DataFrame | None, as_of: dt.datetime) -> DataFrame:
    """Approved offers, oldest first, without suppressed recipients, as many as each user's and domain's limits leave."""
    ready = suppressed(offers.where("status = 'approved'").withColumn("email", F.col("recipient_email")), blacklist).withColumn("to_email", F.col("recipient_email"))
    rated = decide(ready, by_user, by_domain, settings, as_of).withColumn("domain", mail_domain(F.col("to_email")))
    by_dom = Window.partitionBy("user_id", "domain").orderBy("created_at", "offer_id")
    fits = rated.where("allowed").withColumn("_d", F.row_number().over(by_dom)).where(F.col("_d") <= F.col("left_domain_day"))
    place = F.row_number().over(Window.partitionBy("user_id").orderBy("created_at", "offer_id"))
    out = fits.withColumn("position", place).where(F.col("position") <= F.least("left_hour", "left_day"))
    return out.select(*offers.columns, "position").orderBy("user_id", "position")
