import numpy as np
import pytest

from quernel import service
from quernel.operators import search
from quernel.sources.store import VectorStore


def test_service(spark, tmp_path):
    s = service.VectorService(spark, VectorStore(spark, str(tmp_path / "v")), 8)
    x = np.random.default_rng(1).normal(size=(120, 8))
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(500, [1.0]), (501, None)]
    assert s.add(spark.createDataFrame(rows, "vec_id long, embedding array<float>")) == (120, 2)
    q = {"query": [*x[7].tolist(), "noise", None], "k": 3}
    assert s.call_tool("vector_search", q)[0]["vec_id"] == 7
    for kind in ("hnsw", "ivf"):
        s.configure(kind, partitions=8, nprobe=8)
        assert s.call_tool("vector_search", q)[0]["vec_id"] == 7
    with pytest.raises(search.NotTrained):
        s.configure("ivf", partitions=4000)
    assert s.call_tool("index_status", {})["index"] == "ivf"
    s.reset()
    assert s.remove(7) and s.call_tool("vector_search", q)[0]["vec_id"] != 7 and s.get(7) is None and s.health()["vectors"] == 119
    s.configure("ivf", partitions=8, nprobe=8)
    s.remove(8)  # from the built index as well
    assert s.call_tool("vector_search", {"query": x[8].tolist(), "k": 1})[0]["vec_id"] != 8
    s.add(spark.createDataFrame([(900, x[8].tolist())], "vec_id long, embedding array<float>"))
    assert s.call_tool("vector_search", {"query": x[8].tolist(), "k": 1})[0]["vec_id"] == 900
    assert s.recommend_preset("accuracy") == "flat" and s.apply_recommended_preset("accuracy") == "flat" and s.config.kind == "flat"
    assert s.matching_precomputed() == [0] and s.apply_recommended_from_grid("max") == 0
    with pytest.raises(LookupError):
        s.apply_best_precomputed(0.99, 0.01)
    s.add_concepts(spark.createDataFrame([("a", "A", ""), ("b", "B", ""), ("c", "C", "")], "id string, name string, description string"))
    s.add_concepts(spark.createDataFrame([("a", "AA", "")], "id string, name string, description string"))
    s.add_relations(spark.createDataFrame([("a", "b", "is_a", 1.0), ("b", "c", "is_a", 1.0)], "src string, dst string, rel_type string, weight double"))
    assert s.concept("a")["name"] == "AA" and s.concept("x") is None
    assert s.call_tool("concept_traverse", {"start": "a"}) == [{"id": "a", "depth": 0}, {"id": "b", "depth": 1}, {"id": "c", "depth": 2}]
    elites = s.tune("speed_first")
    assert s.best_elite()["fitness"] == elites.first().fitness and s.diverse(2) and s.coverage() > 0
    s.set_priority("recall_first")
    assert s.elites["fitness"].is_monotonic_decreasing
    with pytest.raises(ValueError):
        s.call_tool("other", {})
    s.clear()
    assert s.health()["vectors"] == 0
    assert len(service.tool_definitions()) == 4 and "input_schema" in service.tool_definitions("plain")[0]
