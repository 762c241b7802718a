import os
import time

import pytest
from lemmary.plans import graph_queries, pipeline

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are absent")

#: Queries whose parts, computed side by side, each sent the package.
NAMED = [
    "weighted_rrf_ps_heavy_k100_rank_sim",
    "average_precision",
    "weighted_rrf_ps_heavy_k100_sim",
    "weighted_rrf_pretrained_tuned",
    "weighted_rrf_lexical_ps",
    "weighted_rrf_theorem_frontier",
    "first_gold_rank",
    "marginal_hits",
    "weighted_rrf_llm_theorem_source",
    "weighted_rrf_ps_heavy",
    "candidate_rankings",
    "weighted_rrf_theorem_heavy",
    "weighted_rrf_tuned_frontier",
    "metric_delta",
    "rrf_union",
    "weighted_rrf_llm_theorem_tuned",
    "weighted_rrf_ps_heavy_k100",
    "weighted_rrf_theorem_source",
    "full_union_rrf",
    "weighted_rrf_tuned_recall",
]


@pytest.mark.parametrize("name", NAMED)
def test_first_query_of_an_application_sends_the_package_once(spark, monkeypatch, name):
    sent, sc = [], spark.sparkContext

    class Begun(Exception):
        pass

    def refuses_a_second(path):
        """As a cluster does for a second path of the same name."""
        sent.append(path)
        time.sleep(0.3)
        if len(sent) > 1:
            raise ValueError("already registered with a different path")

    def together(p, *names):
        """Only the first parts are computed."""
        side_by_side(p, *names)
        raise Begun

    side_by_side = pipeline.Pipeline.together
    monkeypatch.setattr(sc, "addPyFile", refuses_a_second)
    monkeypatch.setattr(sc, "_lemmary_shipped", False)
    monkeypatch.setattr(pipeline, "store", lambda df: df)
    monkeypatch.setattr(pipeline.Pipeline, "together", together)
    graph_queries.forget()
    try:
        with pytest.raises(Begun):
            graph_queries.QUERIES[name](spark, SF)
    finally:
        graph_queries.forget()
    assert len(sent) == 1
