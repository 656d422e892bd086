"""Time the headline queries, and DuckDB on the same files beside each; prints one JSON line."""

from __future__ import annotations

import glob
import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from starfold import queries as registry  # noqa: E402
from starfold.session import local_session  # noqa: E402

HEADLINE = [
    "region_revenue", "measure_sum", "measure_distinct", "measure_ratio", "measure_percentile", "measure_rank",
    "running_total", "running_count", "join_m2o", "join_composite", "join_role_playing", "join_drill_across", "join_bridge",
    "join_path", "filter_semi", "filter_semi_both", "hierarchy_path", "join_theta", "visual_matrix", "visual_card",
    "paginated_list", "top_k", "profile_keys", "profile_fk", "orient_rels", "active_relationships", "model_summary",
    "artifact_kind", "extract_report_items", "extract_module_columns", "extract_dashboard_fields", "expr_rewrite",
    "coverage_report",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    names = os.environ.get("BENCH_QUERIES")
    registry.load_all()
    spark = local_session(cores, shuffle_partitions=int(cores) if cores.isdigit() else 8)
    run = lambda name: registry.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
    run("scan_table")  # start the engine
    times, beside = {}, {}
    con = _connect(sf_dir, cores)
    for name in names.split(",") if names else HEADLINE:
        started = time.perf_counter()
        run(name)
        times[name] = round(time.perf_counter() - started, 3)
        if con and name in registry.ORACLES:
            started = time.perf_counter()
            con.execute(registry.ORACLES[name]).fetchall()
            beside[name] = round(time.perf_counter() - started, 3)
    print(json.dumps({"metric": "total wall time of headline queries", "value": round(sum(times.values()), 3),
                      "unit": "sec", "queries": times, "sf": os.path.basename(sf_dir.rstrip("/")), "duckdb": beside}))


def _connect(sf_dir: str, cores: str):
    try:
        import duckdb
    except ModuleNotFoundError:
        return None
    con = duckdb.connect()
    if cores.isdigit():
        con.execute(f"set threads = {cores}")
    for path in sorted(glob.glob(f"{sf_dir}/*.parquet")):
        files = f"{path}/*.parquet" if os.path.isdir(path) else path
        con.execute(f"create view {os.path.basename(path)[:-8]} as select * from read_parquet('{files}')")
    return con


if __name__ == "__main__":
    main()
