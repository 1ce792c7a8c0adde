"""The registry of issues: code, category, severity; a constant table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Weights by severity, and the codes of each category with C (critical), R (recommended) or O (optimization).
WEIGHTS = {"critical": -10, "recommended": -3, "optimization": -1}
_CODES = {
    "http": "ssl_not_https C, ssl_connection_failed C, ssl_expired C, ssl_expiring_soon R, http_connection_failed C, http_slow_ttfb R, http_mixed_content R, http_soft_404 R",
    "security": "security_missing_content_security_policy R, security_missing_x_frame_options R, security_missing_x_content_type_options O, security_missing_strict_transport_security R, security_missing_referrer_policy O, security_missing_permissions_policy O, security_server_version_disclosure O, security_x_powered_by O, security_insecure_form C",
    "seo": "seo_missing_title C, seo_short_title R, seo_long_title O, seo_missing_description R, seo_short_description O, seo_long_description O, seo_missing_og_tags O, seo_missing_viewport C, seo_missing_h1 R, seo_multiple_h1 O, seo_missing_sitemap O, seo_missing_robots O, seo_images_missing_alt R",
    "libraries": "lib_outdated_jquery R, lib_outdated_bootstrap R, lib_jquery_with_modern_framework O, lib_multiple_frameworks O",
    "outdated_code": "outdated_missing_doctype R, outdated_old_doctype R, outdated_deprecated_tags R, outdated_no_semantic_html O, outdated_excessive_inline_styles O, outdated_table_layout C, outdated_flash_content C, outdated_java_applet C, outdated_fixed_width R, outdated_jquery R, outdated_blocking_scripts R, outdated_ancient_copyright C, outdated_old_copyright R, outdated_stale_copyright O, outdated_last_modified_old R",
    "performance": "perf_lcp_poor C, perf_lcp_needs_improvement R, perf_fcp_poor R, perf_fcp_needs_improvement O, perf_cls_poor C, perf_cls_needs_improvement R, perf_ttfb_poor R, perf_ttfb_needs_improvement O",
    "responsiveness": "resp_missing_viewport_meta C, resp_horizontal_overflow_mobile C, resp_horizontal_overflow_tablet R, resp_small_touch_targets_mobile O, resp_small_touch_targets_tablet O",
    "visual": "visual_inconsistent_padding O, visual_many_fonts O, visual_inconsistent_typography O, visual_upscaled_images O",
    "design_modernity": "design_very_outdated C, design_outdated R, design_no_modern_layout R, design_float_layout R, design_table_display R, design_no_css_variables O, design_no_gradients O, design_no_animations O, design_no_visual_effects O, design_excessive_important O",
    "accessibility": "a11y_color_contrast C, a11y_image_alt C, a11y_label C, a11y_link_name C, a11y_html_has_lang R, a11y_duplicate_id R, a11y_button_name C, a11y_document_title R, a11y_frame_title R, a11y_heading_order O, a11y_meta_viewport C, a11y_list O",
    "eshop_detection": "",
    "cms_quality": "cms_free_platform C, cms_subdomain_hosting C, cms_builder_limitations R, cms_wordpress_default_theme R, cms_outdated_platform R, cms_platform_ads C",
    "content_quality": "content_small_images R, content_blurry_images R, content_broken_images C, content_placeholder_text C, content_empty_sections R, content_outdated_copyright O, content_generic_stock_photos O",
    "branding": "branding_no_favicon R, branding_default_favicon R, branding_no_logo R, branding_low_quality_logo O, branding_inconsistent_colors O, branding_no_brand_identity R",
    "navigation_ux": "nav_too_many_items R, nav_deep_hierarchy O, nav_no_breadcrumbs O, nav_no_search O, nav_broken_links C, nav_no_mobile_menu C, nav_inconsistent_navigation O, nav_no_404_page O",
    "conversion": "conversion_no_cta C, conversion_weak_cta R, conversion_no_contact_form C, conversion_hidden_contact R, conversion_no_trust_signals R, conversion_no_social_proof O, conversion_no_phone R, conversion_no_email R",
    "legal_compliance": "legal_no_cookie_consent C, legal_no_privacy_policy C, legal_no_terms R, legal_no_company_info C, legal_no_withdrawal_info R, legal_cookies_before_consent R",
    "typography": "typography_wrong_dashes O, typography_multiple_spaces O, typography_wrong_quotes O, heading_multiple_h1 R, heading_no_h1 C, heading_skipped_levels R, design_too_many_fonts R, design_inconsistent_font_sizes O, design_excessive_inline_styles O, design_too_many_colors R, design_excessive_br_tags O, design_excessive_nbsp O, design_poor_image_alts R, design_deprecated_elements C, design_table_layout R, design_autoplay_media O",
    "industry_eshop": "eshop_no_product_pages C, eshop_no_product_schema R, eshop_no_cart C, eshop_cart_ux_issues R, eshop_no_payment_methods C, eshop_limited_payment_methods R, eshop_no_shipping_info C, eshop_no_free_shipping_threshold O, eshop_no_ssl_seal R, eshop_no_reviews R, eshop_no_trust_badges O, eshop_no_return_policy R, eshop_no_contact_info C, eshop_no_search R",
    "industry_webdesign": "webdesign_no_portfolio C, webdesign_few_portfolio_items R, webdesign_no_case_studies R, webdesign_no_pricing R, webdesign_no_services C, webdesign_no_testimonials R, webdesign_no_team O, webdesign_outdated_own_design C, webdesign_no_cta R, webdesign_no_contact_form C, webdesign_no_blog O, webdesign_no_social_proof O",
    "industry_real_estate": "realestate_no_listings C, realestate_no_search_filters R, realestate_no_contact_agent C",
    "industry_automobile": "automobile_no_inventory C, automobile_no_financing R, automobile_no_test_drive R",
    "industry_restaurant": "restaurant_no_menu C, restaurant_menu_pdf_only R, restaurant_no_reservation R",
    "industry_medical": "medical_no_appointment C, medical_no_services R, medical_no_doctor_profiles R",
}
CATEGORIES = list(_CODES)
FALLBACK = ("http", "optimization")
_SEVERITY = {"C": "critical", "R": "recommended", "O": "optimization"}
ISSUES = [(*entry.strip().split(" "), category) for category, codes in _CODES.items() for entry in codes.split(",") if entry]
ISSUES = [(code, category, _SEVERITY[s]) for code, s, category in ISSUES]


def registry(spark: SparkSession, category: str | None = None, severity: str | None = None) -> DataFrame:
    """The codes with category, severity, weight and title, all or of one category or severity."""
    rows = [(code, c, s, WEIGHTS[s], code.split("_", 1)[1].replace("_", " ").capitalize()) for code, c, s in ISSUES if category in (None, c) and severity in (None, s)]
    return spark.createDataFrame(rows, "code string, category string, severity string, weight int, title string")


def with_texts(issues: DataFrame, texts: DataFrame) -> DataFrame:
    """Issues with the words that describe their codes, in a table of one's own (code, title, description, impact): the registry itself
    has codes alone, and makes a title out of each.  A code that the table lacks keeps that title."""
    own = F.initcap(F.regexp_replace(F.regexp_replace("code", "^[^_]*_", ""), "_", " "))
    made = F.concat(F.substring(own, 1, 1), F.lower(F.substring(own, 2, 1000)))
    known = texts.select("code", "title", "description", "impact")
    joined = issues.drop("title", "description", "impact").join(known, "code", "left")
    return joined.withColumn("title", F.coalesce("title", made))


def with_registry(issues: DataFrame) -> DataFrame:
    """Issues (code, ...) with category, severity and weight; a code that the registry lacks keeps its own category, else falls back."""
    known = F.broadcast(registry(issues.sparkSession).select("code", F.col("category").alias("_c"), F.col("severity").alias("_s"), F.col("weight").alias("_w")))
    joined = issues.join(known, "code", "left")
    own = F.col("category") if "category" in issues.columns else F.lit(None)
    severity = F.col("severity") if "severity" in issues.columns else F.lit(None)
    return joined.select(
        *(c for c in issues.columns if c not in ("category", "severity", "weight")),
        F.coalesce("_c", own, F.lit(FALLBACK[0])).alias("category"),
        F.coalesce("_s", severity, F.lit(FALLBACK[1])).alias("severity"),
        F.coalesce("_w", weight_of(severity), F.lit(WEIGHTS[FALLBACK[1]])).alias("weight"),
    )


def weight_of(severity: Column) -> Column:
    out = F.lit(None).cast("int")
    for s, w in WEIGHTS.items():
        out = F.when(severity == s, F.lit(w)).otherwise(out)
    return out
