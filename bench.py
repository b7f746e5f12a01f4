"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

import json
import os
import sys
import time

from tidewake.plans import load_all
from tidewake.session import local_session

HEADLINE = [
    "W00_causal_features", "W02_prior_sum", "W04_rolling_sum", "W16_prior_distinct", "W22_causal_win_rate",
    "W24_expanding_entropy", "W43_pct_rank", "J05_asof_backward", "J09_range_join", "A03_describe_by", "A04_pivot_sum",
    "A09_corr_matrix", "A15_quantile_table", "K01_top_fraction", "K03_topk_by", "U05_jaccard_pairs", "E01_auc", "E03_ece",
    "R05_stratified_kfold", "R09_cluster_bootstrap_ci", "B01_strategy_signals", "B02_flat_stake", "N04_bigram_mle", "N10_tfidf",
    "N30_bm25_topk", "N29_dense_topk", "T01_standard_scale", "T25_iforest_score", "Y04_acf", "Y17_ets_ses",
    "Q10_check_duplicates", "X02_stream_tumbling", "T27_similar_items", "W20_prior_median_gap", "W21_whale_flag", "T22_dbscan",
    "J13_cosine_join", "N31_rrf", "N33_retrieval_at_k", "N34_route_architectures", "T15_fit_gbt",
]


def main():
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"))
    queries = load_all()[0]
    spark.range(10).count()
    times = {}
    for name in HEADLINE:
        spark.catalog.clearCache()  # no query starts from what another one left
        t0 = time.time()
        queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - t0, 3)
        print(name, times[name], file=sys.stderr, flush=True)
    sf = os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")
    print(json.dumps({"metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": float(sf)}))


if __name__ == "__main__":
    main()
