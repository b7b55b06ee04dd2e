"""Times the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from advisoryspark import catalog  # noqa: E402
from advisoryspark.session import get_session  # noqa: E402

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", str(os.cpu_count()))

HEADLINE = [
    "clean_text", "exploit_labels", "component_labels", "impact_labels", "enrich_rules",
    "stats_grouping_sets", "severity_counts", "top_components", "year_exploit_pivot", "score_histogram",
    "search_filter", "page_listing", "exact_lookup", "class_report", "upsert_merge", "insert_new_only",
    "chronological_index", "prev_state", "transition_matrix", "forecast_yearly", "arima110_forecast",
    "forecast_by_exploit", "arima111", "tfidf_vocabulary", "tfidf_weights",
    "hmm_fit", "hmm_decode", "memm_fit", "memm_decode", "rf_score", "oof_score",
    "token_sequences", "text_classifier", "stream_import",
]


def main():
    spark = get_session("bench", master=f"local[{CPUS}]", spark__sql__shuffle__partitions=CPUS,
                        spark__driver__memory="16g", spark__ui__enabled="false",
                        spark__ui__showConsoleProgress="false")
    spark.sparkContext.setLogLevel("ERROR")
    spark.range(1000).selectExpr("sum(id)").collect()
    seconds = {}
    start = time.time()
    catalog.stored(spark, SF_DIR).count()
    seconds["store_enriched_table"] = round(time.time() - start, 3)
    for name in HEADLINE:
        start = time.time()
        # The noop sink computes every column of every row without collecting them.
        catalog.QUERIES[name](spark, SF_DIR).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.time() - start, 3)
        print(name, seconds[name], file=sys.stderr)
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": SF_DIR.rstrip("/").rsplit("/sf", 1)[-1], "cpus": int(CPUS),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
