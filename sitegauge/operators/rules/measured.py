"""Rules over tables of measurements: performance, responsiveness, visual consistency, design, accessibility."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..registry import ISSUES
from . import Rule, said

# The good and poor ends of web vitals (ms; CLS without unit).
VITALS = {"lcp": (2500, 4000), "fcp": (1800, 3000), "cls": (0.1, 0.25), "ttfb": (800, 1800)}
MODERNITY_LEVELS = [(15, "excellent"), (10, "good"), (5, "fair")]


def metric_rules(thresholds: dict[str, tuple[float, float]] | None = None) -> list[Rule]:
    """Rules over one row of ``page_metrics`` (A20, A22); a null metric raises nothing."""
    c, out = F.col, []
    for name, (good, poor) in (VITALS | (thresholds or {})).items():
        out.append(Rule("performance", f"perf_{name}_poor", c(name) > poor, said(c(name), name)))
        out.append(Rule("performance", f"perf_{name}_needs_improvement", (c(name) > good) & (c(name) <= poor), said(c(name), name)))
    for view in ("mobile", "tablet"):
        out.append(Rule("responsiveness", f"resp_horizontal_overflow_{view}", c(f"overflow_{view}")))
        out.append(Rule("responsiveness", f"resp_small_touch_targets_{view}", c(f"small_targets_{view}") > 0, said(c(f"small_targets_{view}"), "targets")))
    for code, column, most in (("inconsistent_padding", "padding_values", 10), ("many_fonts", "font_families", 4), ("inconsistent_typography", "font_sizes", 8), ("upscaled_images", "upscaled_images", 0)):
        out.append(Rule("visual", f"visual_{code}", c(column) > most, said(c(column), column)))
    score = c("modernity_score")
    out.append(Rule("design_modernity", "design_very_outdated", score < 3, said(score, "points")))
    out.append(Rule("design_modernity", "design_outdated", (score >= 3) & (score < 5), said(score, "points")))
    return out


def viewport_rules(html: Column) -> list[Rule]:
    """The rule over a page's source that belongs to the views (A22); a page without source raises nothing."""
    # fixed value: the tag, with its name behind or before other attributes
    tag = r"(?i)<meta[^>]+name=[\"']viewport[\"'][^>]*>"
    return [Rule("responsiveness", "resp_missing_viewport_meta", ~html.rlike(tag), F.lit("no viewport tag"))]


def design_rules() -> list[Rule]:
    """Rules over counts of style features: grid, flex, float, table_display, css_variables, gradients, transitions, animations,
    box_shadow, border_radius, important, modernity_score (A22)."""
    c = F.col
    r = lambda code, when, evidence=None: Rule("design_modernity", code, when, evidence)
    modern = (c("grid") > 0) | (c("flex") > 0)
    below = c("modernity_score") < 10
    return [
        r("design_no_modern_layout", ~modern),
        r("design_float_layout", (c("float") > 10) & ~modern, said(c("float"), "floats")),
        r("design_table_display", c("table_display") > 5, said(c("table_display"), "tables")),
        r("design_no_css_variables", (c("css_variables") == 0) & below),
        r("design_no_gradients", (c("gradients") == 0) & below),
        r("design_no_animations", (c("transitions") == 0) & (c("animations") == 0) & below),
        r("design_no_visual_effects", (c("box_shadow") == 0) & (c("border_radius") < 3) & below),
        r("design_excessive_important", c("important") > 20, said(c("important"), "marks")),
    ]


def accessibility_issues(findings: DataFrame) -> DataFrame:
    """Findings (page_id, rule_id, impact, nodes) as issues with codes a11y_<id>; an id that the registry lacks keeps its own code
    and takes its severity from the impact (A21)."""
    code = F.concat(F.lit("a11y_"), F.replace("rule_id", F.lit("-"), F.lit("_")))
    known = [c for c, category, _ in ISSUES if category == "accessibility"]
    by_impact = F.when(F.col("impact").isin("critical", "serious"), "critical").when(F.col("impact") == "moderate", "recommended").otherwise("optimization")
    return findings.select(
        "page_id", F.lit("accessibility").alias("category"), code.alias("code"), F.when(~code.isin(known), by_impact).alias("severity"), said(F.col("nodes"), "nodes").alias("evidence")
    )


def accessibility_counts(findings: DataFrame) -> DataFrame:
    """Findings of each page by impact."""
    return findings.groupBy("page_id").pivot("impact", ["critical", "serious", "moderate", "minor"]).count().fillna(0)


def modernity_level(score: Column) -> Column:
    out = F.lit("outdated")
    for low, name in reversed(MODERNITY_LEVELS):
        out = F.when(score >= low, F.lit(name)).otherwise(out)
    return out
