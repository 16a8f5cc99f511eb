"""Sources and sinks: pools, feature tables, signature stores and logs."""
