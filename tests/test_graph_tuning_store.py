import random

import pytest
from pyspark.sql import functions as F

from quernel.operators import graph as G
from quernel.operators import ingest as I
from quernel.operators import tuning as T
from quernel.sources import store as St
from quernel.streaming.upsert import upsert_stream


def edges(spark, *rows):
    return spark.createDataFrame([(a, b, k, float(w)) for a, b, k, w in rows], "src string, dst string, rel_type string, weight double")


def nodes(spark, *ids):
    return spark.createDataFrame([(i,) for i in ids], "id string")


def test_graph(spark):
    chain = edges(spark, ("dog", "mammal", "is_a", 1), ("mammal", "animal", "is_a", 1), ("animal", "living", "is_a", 1))
    assert sorted(r.id for r in G.ancestors(chain, nodes(spark, "dog")).collect()) == ["animal", "living", "mammal"]
    assert G.descendants(chain, nodes(spark, "living")).count() == 3
    all_ = nodes(spark, "dog", "mammal", "animal", "living")
    with pytest.raises(G.CycleError):
        G.add_edges(chain, edges(spark, ("living", "dog", "is_a", 1)), all_)
    assert G.add_edges(chain, edges(spark, ("dog", "nobody", "is_a", 1), ("dog", "animal", "related_to", 7)), all_).count() == 4
    path = edges(spark, ("a", "b", "r", 1), ("b", "c", "r", 1), ("c", "d", "r", 0.5), ("a", "c", "r", 0.1))
    assert {r.id: r.depth for r in G.bfs(path, nodes(spark, "a")).collect()} == {"a": 0, "b": 1, "c": 1, "d": 2}
    assert G.shortest_path(path, "a", "d").first().path == ["a", "b", "c", "d"]
    assert G.shortest_path(path, "a", "d", 2).first().path == ["a", "c", "d"]
    assert G.shortest_path(path, "d", "a").count() == 0 and G.shortest_path(path, "a", "a").first().path == ["a"]
    assert sorted(r.path for r in G.all_paths(path, "a", "d", 5).collect()) == [["a", "b", "c", "d"], ["a", "c", "d"]]
    assert {r.id: r.score for r in G.neighbourhood(path, nodes(spark, "a"), 1).collect()} == {"a": 1, "b": 0.5, "c": 0.5}


def test_tuning(spark):
    rows = [(0, 0.95, 500.0, 3500.0, 100.0), (1, 1.0, 0.0, 900.0, 0.5)]
    r = spark.createDataFrame(rows, "seq long, recall double, latency_us double, bytes double, build_ms double").select("seq", T.fitness().alias("f"), *T.behaviour()).orderBy("seq").collect()
    assert 0 < r[0].f < 1 and r[1].f == pytest.approx(1) and all(0 <= x[c] < 6 for x in r for c in ("r_bin", "l_bin", "m_bin"))
    a = spark.createDataFrame([(0, [1], 1.0), (1, [1], 2.0), (2, [1], 0.5), (3, [1], 2.0)], "seq long, cell array<int>, fitness double")
    assert T.archive(a, ["cell"]).first().seq == 1
    assert spark.range(1).select(T.behaviour_cell(F.array(F.lit(0.25), F.lit(0.75)), 10, 2).alias("c")).first().c == [2, 7, 0, 0]
    assert spark.range(1).select(T.from_range(F.lit(50.0), 0, 100).alias("x"), T.from_range(F.lit(5.0), 1, 1).alias("y")).first()[:] == (0.5, 0.5)
    rng = random.Random(1)
    g = T.genome(rng)
    assert set(T.mutated(g, rng)) == set(g) and all(v in (g[k], h[k]) for h in [T.genome(rng)] for k, v in T.crossed(g, h, rng).items())
    out = T.map_elites(lambda r: "a b c", T.mutated_words, lambda b: [(len(t), [0.1, 0.2]) for t in b], T.MapElites(5, 4, 4, 5))
    assert len(out.elites()) == 1 and out.get((0, 1)).fitness >= 5 and out.evaluations >= 8 and out.random_elite(rng) == out.elites()[0] and out.coverage() == 1 / 25
    one = T.Archive(10, 2)
    assert [one.try_add("x", f, [0.25, 0.75]) for f in (1.0, 2.0, 0.5)] == [True, True, False] and one.get((2, 7)).fitness == 2
    assert sum(T.balanced(4, 3, 2, 1)) == pytest.approx(1) and T.retry_delays(3) == [100, 200, 400]
    assert spark.range(1).select(T.behaviour_distance(F.array(F.lit(0.0), F.lit(0.0)), F.array(F.lit(1.0), F.lit(0.0))).alias("x")).first().x == 1
    import numpy as np

    x = np.random.default_rng(1).normal(size=(130, 6))
    for name in T.INSERT_GENES["strategy"]:
        y = x.copy()
        T._normalise(y, name, 50, name == "interleaved")
        assert np.allclose(np.linalg.norm(y, axis=1), 1), name
    v = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "vec_id long, embedding array<float>")
    best = T.evolve_inserts(v, T.TUNINGS["fast"]).first()
    assert 0 < best.fitness <= 1 and best.strategy in T.INSERT_GENES["strategy"]
    with pytest.raises(ValueError):
        T.evolve_inserts(v.limit(50))


def test_chunkers(spark):
    assert I.sentences("short", 500, 100) == ["short"]
    text = "One sentence here. " * 60
    parts = I.sentences(text, 200, 40)
    assert all(len(p) <= 200 for p in parts) and all(p.endswith(".") for p in parts)
    with pytest.raises(ValueError):
        I.sentences("x", 100, 50)
    with_tail = I.sentences("y" * 980, 500, 100)
    assert [len(p) for p in with_tail] == [500, 500, 180] and [len(p) for p in I.sentences("y" * 850, 500, 100)] == [500, 450, 50]
    docs = spark.createDataFrame([(1, "a" * 30), (2, "Short start. " + "word " * 60), (3, None), (4, "")], "id long, text string")
    parts = {(r.id, r.part): r for r in I.equal_parts(docs, "id", "text").collect()}
    assert [parts[1, i].char_count for i in range(3)] == [10, 10, 10] and parts[2, 0].text == "Short start." and all(parts[2, i].text for i in range(3)) and parts[4, 0].text == "" and (3, 0) not in parts
    packed = I.paragraph_chunks(spark.createDataFrame([(1, "x\n\ny"), (2, " " + "a" * 40 + "\n\n \n\n" + "b" * 40 + "\n\n" + "c" * 90), (3, None)], "id long, text string"), "id", "text", 100)
    assert sorted((r.id, r.chunk_index, r.chunk) for r in packed.collect()) == [(2, 0, "a" * 40 + "\n\n" + "b" * 40), (2, 1, "c" * 90)]
    df = spark.createDataFrame([("f.txt", 3)], "filename string, i int")
    assert df.select(I.doc_id("filename", "i").alias("x")).first().x == I.doc_id_of("f.txt", 3)
    assert I.chunk_fixed(spark.createDataFrame([(1, None), (2, ""), (3, "z" * 900)], "id long, text string"), "id", "text").count() == 3


def test_store(spark, tmp_path):
    s = St.VectorStore(spark, str(tmp_path / "s"))
    assert s.count() == 0 and s.get(1) is None
    s.put_batch(spark.createDataFrame([(i, [float(i)] * 4) for i in range(10)], "vec_id long, embedding array<float>"))
    s.put(3, [9.0] * 4)
    assert s.count() == 10 and s.get(3) == [9.0] * 4
    assert s.delete(3) and not s.delete(3) and not s.contains(3)
    s.compact()
    assert s.count() == 9 and [r.vec_id for r in s.ordered().collect()] == [0, 1, 2, 4, 5, 6, 7, 8, 9]
    good, bad = s.recover(4)
    assert good.count() == 9 and bad.count() == 0
    src = tmp_path / "in"
    spark.createDataFrame([(77, [1.0] * 4)], "vec_id long, embedding array<float>").write.parquet(str(src))
    q = upsert_stream(spark.readStream.schema("vec_id long, embedding array<float>").parquet(str(src)), s, str(tmp_path / "ck"), once=True)
    q.awaitTermination()
    assert s.get(77) == [1.0] * 4
    assert s.put_batch(spark.createDataFrame([(77, [5.0] * 4)], "vec_id long, embedding array<float>"), batch=f"{tmp_path / 'ck'}#0") == 0  # replayed
    other = s.clone()
    assert other.get(77) == [1.0] * 4 and s.disk_size() > 0 and not s.is_empty()
    s.close()
    with pytest.raises(St.StoreClosed):
        s.count()
    assert St.decode_key(St.encode_key(2**40)) == 2**40 and St.decode_value(St.encode_value([1.5, -2.0])) == [1.5, -2.0]
    with pytest.raises(ValueError):
        St.decode_key(b"123")


def rows_of(spark, *rows):
    return spark.createDataFrame([(i, [float(v)] * 2, o) for i, v, o in rows], "vec_id long, embedding array<float>, o long")


def test_store_is_the_same_for_every_handle(spark, tmp_path):
    path = str(tmp_path / "s")
    a = St.VectorStore(spark, path)
    a.put(1, [1.0, 1.0])
    a.compact()
    a.put(2, [2.0, 2.0])
    a.delete(1)
    b = St.VectorStore(spark, path)  # opened anew: deleted stays deleted, written stays written
    assert [r.vec_id for r in b.ordered().collect()] == [2] and b.generation() == 1
    b.compact()
    a.put(3, [3.0, 3.0])
    assert [r.vec_id for r in b.ordered().collect()] == [2, 3] and a.get(3) == [3.0, 3.0]
    (tmp_path / "s" / "g9").mkdir()  # a compaction that broke off is never seen
    assert a.count() == 2
    assert a.put_batch(rows_of(spark, (7, 1, None), (8, 1, 5), (9, 1, None), (9, 2, 3), (None, 1, 1)), "o") == 4
    assert a.get(7) == [1.0, 1.0] and a.get(9) == [2.0, 2.0] and a.count() == 5
    a.clear()
    assert a.is_empty()


def test_store_does_not_take_a_broken_path_for_an_empty_one(spark, tmp_path):
    path = tmp_path / "s"
    s = St.VectorStore(spark, str(path))
    s.put(1, [1.0])
    next((path / "g0").glob("*.parquet")).write_bytes(b"broken")
    with pytest.raises(Exception):  # noqa: B017, PT011
        s.count()


def test_batch_operators_of_the_store(spark):
    rows = rows_of(spark, (1, 1, 1), (2, 2, 1), (3, 3, None))
    wanted = spark.createDataFrame([(1,), (5,)], "vec_id long")
    assert {tuple(r) for r in St.contained(rows, wanted).collect()} == {(1, True), (5, False)}
    assert [r.vec_id for r in St.looked_up(rows, wanted).collect()] == [1]
    good, bad = St.recovered(rows, 3)
    assert good.count() == 0 and bad.count() == 3 and St.summary(rows).first()[:] == (3, 2)
    meta = spark.createDataFrame([(1, "a"), (2, "b")], "id long, name string")
    assert {tuple(r) for r in St.write_metadata(meta, spark.createDataFrame([(2, "c"), (3, "d")], "id long, name string")).collect()} == {(1, "a"), (2, "c"), (3, "d")}


def test_file_sources(spark, tmp_path):
    import json

    one = tmp_path / "e.json"
    one.write_text(json.dumps({"model": "m", "dimension": 2, "count": 1, "embeddings": [{"id": 4, "source": "s", "text": "t", "vector": [1.0, 2.0]}]}))
    assert [tuple(r) for r in St.read_embedding_json(spark, str(one)).collect()] == [(4, "s", "t", [1.0, 2.0])]
    two = tmp_path / "p.json"
    two.write_text(json.dumps({"embeddings": [[1.0], [2.0]], "chunks": ["a", "b"]}))
    assert [tuple(r) for r in St.read_positional_json(spark, str(two)).orderBy("id").collect()] == [(0, [1.0], "a"), (1, [2.0], "b")]
    folder = tmp_path / "texts"
    (folder / "deep").mkdir(parents=True)
    (folder / "a.txt").write_text("line one\nline two")
    (folder / "b.md").write_text("  ")
    (folder / "c.exe").write_text("no")
    (folder / "deep" / "d.csv").write_text("x,y")
    assert [r.content for r in St.read_texts(spark, str(folder)).collect()] == ["line one\nline two"]
    assert St.read_texts(spark, str(folder), recursive=True).count() == 2
    St.write_json(spark.createDataFrame([(1, "a")], "id long, t string"), str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).first().t == "a"


def test_command_line(spark, tmp_path, capsys):
    from quernel.__main__ import main

    texts = tmp_path / "texts"
    texts.mkdir()
    (texts / "a.txt").write_text("The index reads every vector and keeps a graph.")
    (texts / "b.txt").write_text("Nothing of that kind is here.")
    lib = str(tmp_path / "lib")
    main([lib, "ingest", str(texts)])
    main([lib, "query", "the index reads every vector", "-k", "1"])
    main([lib, "list"])
    main([lib, "stats"])
    out = capsys.readouterr().out
    assert "2 chunks" in out and "keeps a graph" in out and "b.txt" in out
    main([lib, "delete", "a.txt"])
    main([lib, "clear"])
    main([lib, "stats"])
    assert "1 chunks" in capsys.readouterr().out
