"""Schemas of the library's tables, as DDL: what the operators read.  Keys that are unique stand in KEYS."""

from __future__ import annotations

from pyspark.sql.types import StructType

_ISSUE = "struct<code:string,evidence:string>"
TABLES = {
    "pages": "page_id bigint, url string, html string, status int, headers map<string,string>, industry string",
    "leads": "lead_id bigint, user_id bigint, url string, domain string, source string, status string, priority int, industry string, type string, has_website boolean, ico string, company_name string, email string, phone string, detected_cms string, detected_technologies array<string>, social_media map<string,string>, company_id string, snapshot_period string, score int, created_at timestamp_ntz, analyzed_at timestamp_ntz",
    "analyses": "analysis_id bigint, lead_id bigint, industry string, status string, total_score int, is_eshop boolean, created_at timestamp_ntz, completed_at timestamp_ntz",
    "analysis_results": f"analysis_id bigint, category string, status string, score int, issues array<{_ISSUE}>, raw_data string, error_message string, created_at timestamp_ntz",
    "issues": "analysis_id bigint, category string, code string, evidence string",
    "analysis_snapshots": "lead_id bigint, analysis_id bigint, period_type string, period_start date, total_score int, issue_count int, critical_issue_count int, top_issues array<string>, industry string",
    "industry_benchmarks": "industry string, period_start date, avg_score double, median_score double, percentiles struct<p10:double,p25:double,p50:double,p75:double,p90:double>, avg_category_scores map<string,double>, top_issues array<struct<code:string,count:bigint,percentage:double>>, sample_size bigint, avg_issue_count double, avg_critical_issue_count double",
    "companies": "ico string, dic string, name string, legal_form string, street string, city string, city_part string, postal_code string, business_status string, raw_data string, ares_updated_at timestamp_ntz",
    "demand_signals": "signal_id bigint, user_id bigint, source string, external_id string, signal_type string, status string, title string, description string, industry string, region string, value decimal(15,2), value_max decimal(15,2), currency string, deadline timestamp_ntz, published_at timestamp_ntz",
    "market_watch_filters": "filter_id bigint, user_id bigint, user_industry string, active boolean, regions array<string>, signal_types array<string>, keywords array<string>, exclude_keywords array<string>, min_value decimal(15,2), max_value decimal(15,2)",
    "demand_signal_subscriptions": "user_id bigint, signal_id bigint, status string",
    "monitored_domains": "domain string, url string, last_crawled_at timestamp_ntz, crawl_frequency string, active boolean",
    "monitored_domain_subscriptions": "user_id bigint, domain string, snapshot_types array<string>, alert_on_change boolean, min_significance string",
    "competitor_snapshots": "domain string, snapshot_type string, content_hash string, significance string, raw_data string, taken_at timestamp_ntz",
    "offers": "offer_id bigint, user_id bigint, lead_id bigint, status string, tracking_token string, recipient_email string, created_at timestamp_ntz, sent_at timestamp_ntz, opened_at timestamp_ntz, clicked_at timestamp_ntz, responded_at timestamp_ntz, converted_at timestamp_ntz",
    "email_logs": "message_id string, user_id bigint, offer_id bigint, to_email string, status string, bounce_type string, created_at timestamp_ntz, sent_at timestamp_ntz, delivered_at timestamp_ntz, opened_at timestamp_ntz, clicked_at timestamp_ntz, bounced_at timestamp_ntz",
    "email_blacklist": "email string, user_id bigint, type string, reason string, created_at timestamp_ntz",
    "mail_events": "event_time timestamp, type string, message_id string, email string, bounce_type string, bounce_sub_type string, feedback_type string",
    "proposals": "proposal_id bigint, user_id bigint, lead_id bigint, type string, status string, industry string, is_ai_generated boolean, is_customized boolean, recyclable boolean, expires_at timestamp_ntz, created_at timestamp_ntz",
    "discovery_profiles": "profile_id bigint, user_id bigint, name string, discovery_enabled boolean, source string, queries array<string>, priority int",
    "user_company_notes": "user_id bigint, company_id string, tags array<string>, relationship_status string",
    "users": "user_id bigint, admin_id bigint, code string, industry string, active boolean, emails_per_hour int, emails_per_day int, emails_per_domain_day int",
    "email_templates": "template_id bigint, user_id bigint, name string, industry string, is_default boolean, is_active boolean",
}
KEYS = {
    "leads": ["user_id", "domain"], "analysis_results": ["analysis_id", "category"], "analysis_snapshots": ["lead_id", "period_type", "period_start"], "industry_benchmarks": ["industry", "period_start"],
    "companies": ["ico"], "demand_signals": ["source", "external_id"], "demand_signal_subscriptions": ["user_id", "signal_id"], "monitored_domains": ["domain"],
    "monitored_domain_subscriptions": ["user_id", "domain"], "email_logs": ["message_id"], "email_blacklist": ["email", "user_id"], "proposals": ["lead_id", "type"], "user_company_notes": ["user_id", "company_id"],
}


def schema(table: str) -> StructType:
    return StructType.fromDDL(TABLES[table])
