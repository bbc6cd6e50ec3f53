from __future__ import annotations

import math
import random

import numpy as np
from pyspark.sql import functions as F

from meshwork.llm import pivot_index


def vectors(seed=1):
    r = np.random.default_rng(seed)
    rows = []
    for _ in range(60):
        centre = r.normal(size=16)
        for _ in range(r.integers(1, 12)):
            rows.append((centre + 0.12 * r.normal(size=16)).astype(np.float32).tolist())
    rows += [rows[0], rows[0], None, [0.0] * 16, [float("nan")] * 16, [None] + [1.0] * 15, [float("inf")] + [1.0] * 15, [], [1.0, 2.0], [1.0, 2.0]]
    return [(i, v, i % 3) for i, v in enumerate(rows)]


def brute(rows):
    ok = {i: np.array(v, np.float64) for i, v, _ in rows if v and all(x is not None and math.isfinite(x) for x in v) and any(v)}
    unit = {i: v / np.linalg.norm(v) for i, v in ok.items()}
    links = [(a, b) for a in unit for b in unit if a < b and len(ok[a]) == len(ok[b]) and unit[a] @ unit[b] >= 0.9]
    return ok, links


def test_pivot_index(spark, monkeypatch):
    rows = vectors()
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumns({c: F.lit(1) for c in ("id", "v", "n_links", "weight", "key", "ok")})
    ok, links = brute(rows)
    degree = {i: 0 for i, *_ in rows}
    for a, b in links:
        degree[a] += 1
        degree[b] += 1
    for block in (pivot_index.BLOCK, 3):  # lists cut into many blocks
        monkeypatch.setattr(pivot_index, "BLOCK", block)
        got = {r[0]: r for r in pivot_index.near_vectors(frame).collect()}
        assert len(got) == len(rows)
        assert all(got[i]["n_links"] <= degree[i] for i in degree)  # none below the threshold
        assert sum(r["n_links"] for r in got.values()) >= 0.9 * sum(degree.values())
        assert all(got[i]["n_links"] == 0 and got[i]["component_id"] == i for i in degree if i not in ok)
        assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in got.values())
        assert got[len(rows) - 1]["component_id"] == len(rows) - 2  # equal vectors of another length
    assert pivot_index.near_vectors(frame.limit(0)).count() == 0


def test_pivots_of_concentrated_tiny_and_mixed_tables(spark):
    r = np.random.default_rng(7)
    centre = r.normal(size=16)
    cone = [(centre + 0.35 * r.normal(size=16)).tolist() for _ in range(150)]  # within a cosine of 0.7 of each other, mostly
    tight = [(centre + 0.1 * r.normal(size=16)).tolist() for _ in range(60)]
    near = [[1.0, 2.0, 3.0], [1.0, 2.0, 3.1]]
    mixed = [(x[:n] + 0.05 * r.normal(size=n)).tolist() for n in (16, 9, 4, 1) for x in r.normal(size=(12, 16)) for _ in range(4)]
    for rows in (cone, tight, near, [*mixed, *near]):
        unit = [np.array(x) / np.linalg.norm(x) for x in rows]
        links = [[j for j, y in enumerate(unit) if j != i and len(x) == len(y) and x @ y >= 0.9] for i, x in enumerate(unit)]
        got = spark.createDataFrame(list(enumerate(rows)), "vec_id long, embedding array<double>")
        got = {x["vec_id"]: x["n_links"] for x in pivot_index.near_vectors(got).collect()}
        assert sum(map(len, links)) > 0 and all(got[i] <= len(x) for i, x in enumerate(links))
        for n in {len(x) for x in rows}:
            of = [i for i, x in enumerate(rows) if len(x) == n]
            assert sum(got[i] for i in of) >= 0.9 * sum(len(links[i]) for i in of)


def test_pivot_recall(spark):
    """In the given vectors with planted ones, of cosine 0.9 to 0.95 to a given one: alone, in groups of 3 to 60, and a large one."""
    given = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").orderBy("vec_id").select("embedding").collect()
    x = np.array([r[0] for r in given], np.float64)
    r = np.random.default_rng(5)
    planted, group = [], []
    for k, size in enumerate([1] * 60 + [3] * 30 + [12] * 10 + [60] * 3 + [400]):
        centre = x[37 * k % len(x)] / np.linalg.norm(x[37 * k % len(x)])
        for _ in range(size):
            off = r.normal(size=len(centre))
            off -= (off @ centre) * centre
            c = r.uniform(0.9, 0.95)
            planted.append(c * centre + math.sqrt(1 - c * c) * off / np.linalg.norm(off))
            group.append(size)
    every = np.concatenate([x, np.array(planted)])
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(every)], "vec_id long, embedding array<double>")
    unit = every / np.linalg.norm(every, axis=1, keepdims=True)
    want = (unit @ unit.T >= 0.9).sum(axis=1) - 1
    got = np.array([row[0] for row in pivot_index.near_vectors(frame).orderBy("vec_id").select("n_links").collect()])
    assert (got <= want).all() and want.sum() > 400
    sizes = np.array([0] * len(x) + group)
    for size in np.unique(group):
        assert got[sizes == size].sum() >= 0.9 * want[sizes == size].sum() > 0, size


def planted(spark):
    """Documents with exact copies, near copies that share no line, a copied line, junk and a repeated id."""
    r = random.Random(6)
    word = lambda: "".join(r.choice("abcdefghijklmnop") for _ in range(r.randint(3, 9)))
    rows = []
    for i in range(60):
        ws = [word() for _ in range(80)]
        rows.append((i, " ".join(ws)))
        if i % 10 == 0:
            rows.append((100 + i, " ".join(ws)))  # exact
        if i % 10 == 1:  # near: other line breaks, one word changed
            changed = [*ws[:79], "other"]
            rows.append((200 + i, "\n".join(" ".join(changed[k : k + 16]) for k in range(0, 80, 16))))
        if i % 10 == 2:
            rows.append((300 + i, " ".join(word() for _ in range(40)) + "\n" + " ".join(ws)))
    rows += [(400, "#$% " * 50), (401, None), (402, ""), (403, "few words")]
    docs = spark.createDataFrame([(i, t, ["en", "fr"][i % 2], "s", None if t is None else len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    labels = spark.createDataFrame([(i, 0 if i == 400 else 1, 0) for i, _ in rows], "doc_id long, quality int, toxic int")
    return docs, labels


def test_pipeline(spark, tmp_path):
    import corpus_pipeline
    import public_tokenizers
    import sentencepiece

    docs, labels = planted(spark)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    folder, now, left = str(tmp_path), docs, {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        now = spark.createDataFrame(stage(spark, now, folder).collect(), docs.schema)
        assert now.columns == docs.columns, name
        left[name] = {r["doc_id"]: r for r in now.collect()}
    given = {r["doc_id"]: r for r in docs.collect()}
    assert set(left["quality rules"]) == set(given) - {400, 401, 402, 403}
    lined = left["line dedup"]
    assert not any(100 <= i < 160 for i in lined) and all(i in lined for i in range(60))  # exact copies lose every line and go
    assert all(lined[300 + i]["text"] == given[300 + i]["text"].split("\n")[0] for i in range(2, 60, 10))
    joined = left["n-gram jaccard join"]
    assert set(joined) == {i for i in lined if not 200 <= i < 260}  # near copies with other line breaks
    assert all(joined[i]["text"] == lined[i]["text"] and joined[i]["n_chars"] == len(joined[i]["text"]) for i in joined)
    assert set(left["mixing"]) <= set(joined) and left["mixing"]
    out = corpus_pipeline.run(spark, folder)
    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    assert out.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids", "decoded"]
    got = out.collect()
    assert len(got) == now.count()
    for r in got:
        ids = library.encode(joined[r["doc_id"]]["text"]) + [library.eos_id()]
        assert r["ids"] == " ".join(map(str, ids)) and r["decoded"] == library.decode(ids)
    empty = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        empty = stage(spark, empty, folder)
    assert empty.count() == 0


def test_random_order_gives_equal_results(spark):
    rows = vectors(3)
    random.Random(1).shuffle(rows)
    schema = "vec_id long, embedding array<float>, label int"
    one = pivot_index.near_vectors(spark.createDataFrame(rows, schema).repartition(5)).collect()
    two = pivot_index.near_vectors(spark.createDataFrame(sorted(rows), schema).repartition(2)).collect()
    assert sorted(one) == sorted(two)
