"""Plan-shaping helpers: one-row totals as scalar subqueries, lineage cuts on the
shared checkpoint directory, and plan inspection used by the plan tests."""
