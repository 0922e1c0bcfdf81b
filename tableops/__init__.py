"""tableops: business table operations as Spark DataFrame -> DataFrame functions.

Every public function takes DataFrames (plus plain Python arguments) and returns a
lazy DataFrame. Nothing is executed until the caller acts on the result, so Catalyst
sees the whole chain: filters reach the Parquet scan, unused columns are pruned, and
aggregations run partial/final around one shuffle.
"""

from tableops.session import get_spark, ensure_checkpoint_dir  # noqa: F401
from tableops.sources.io import (  # noqa: F401
    read_table, read_workbook, write_workbook, next_output, preview, json_rows,
)
from tableops.sources.versions import (  # noqa: F401
    read_version, reserve_version, save_version, versions,
)
from tableops.sources.raw import read_raw, read_raw_blocks, read_sheet, with_row_index  # noqa: F401
from tableops.sources.oplog import append_entry, compact, read_log  # noqa: F401
from tableops.sources.audit import (  # noqa: F401
    AUDIT_SCHEMA, audit, read_audit, export_audit,
)
from tableops.functions.predicates import token_match  # noqa: F401
from tableops.operators.transform import (  # noqa: F401
    select_as, add_column, rename_column, remove_column, split_column,
    merge_columns, fill_missing, replace_values, to_numeric, normalize_text,
    drop_missing, bin_values, number_format,
)
from tableops.operators.filters import (  # noqa: F401
    filter_rows, filter_any_token, search_rows,
)
from tableops.operators.calc import calc  # noqa: F401
from tableops.operators.order import sort_rows, top_k, deduplicate  # noqa: F401
from tableops.operators.aggregate import (  # noqa: F401
    aggregate, group_by, group_count, pivot_table, cross_tab, summary_stats, subtotals,
    value_counts, column_stat, rollup_totals,
)
from tableops.operators.lookup import (  # noqa: F401
    lookup, index_match, join_tables, fuzzy_match, nearest_match,
)
from tableops.operators.quality import (  # noqa: F401
    Rule, allowed, in_range, max_length, unique, blank, of_type,
    check_allowed, check_range, check_length, check_unique, check_blank,
    check_type, violations, quality_report,
)
from tableops.operators.rules import flag, color_when, data_bar, color_scale  # noqa: F401
from tableops.operators.charts import (  # noqa: F401
    chart_series, pie_shares, line_series, scatter_points, kpi, sparkline,
)
from tableops.operators.profile import (  # noqa: F401
    detect_header, apply_header, unique_names, profile, classify_columns,
    column_roles, top_values, region_sample, data_profile, summary_table, export_summary,
)
from tableops.operators.textjobs import (  # noqa: F401
    classify_intent, column_mentions, extract_json,
)
from tableops.operators.metrics import row_counts, observed_counts  # noqa: F401
from tableops.plans.quantiles import exact_quantiles  # noqa: F401
from tableops.plans.ranks import ranked  # noqa: F401
from tableops.plans.totals import column_median, with_scalars  # noqa: F401
