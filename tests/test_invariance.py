"""Order of rows and number of partitions don't change results."""

import pytest
from pyspark.sql import functions as F

from sitegauge.plans import queries as plans

SF = "/root/testdata/sf0.001"
NAMES = ["run_deltas", "issue_deltas", "snapshot_deltas", "lead_trend", "benchmark_compare", "mail_states", "rate_limits", "suppression_entries", "snapshot_changes", "keep_latest", "discovery_outcomes", "import_outcomes", "page_links", "proposal_reuse", "chosen_templates", "ingested_signals", "lead_bundles", "top_issues"]


def rows(df):
    order = sorted(df.columns)
    return sorted(str([round(v, 6) if isinstance(v, float) else v for v in (r[c] for c in order)]) for r in df.collect())


@pytest.mark.parametrize("name", NAMES)
def test_same_rows(spark, monkeypatch, name):
    want = rows(plans.QUERIES[name](spark, SF))
    plain = plans.table
    monkeypatch.setattr(plans, "table", lambda s, d, t: plain(s, d, t).repartition(7, F.rand(3)).sortWithinPartitions(F.rand(5)))
    assert rows(plans.QUERIES[name](spark, SF)) == want
