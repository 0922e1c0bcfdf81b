"""Table sources and sinks: tables, workbooks (directories of tables), raw
headerless sheets with a distributed row index, and the audit table."""
