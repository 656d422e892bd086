"""DataFrame operators: joins, measures, windows, visuals, profiling, rules, extraction."""
