import random
import zlib
from array import array
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from meridia.llm import blocks
from meridia.llm import lattice as E
from meridia.llm import wavelet as W
from meridia.llm.common import local_path
from meridia.llm.queries import BYTE_VOCABULARY, op7_embeddings, op10_tokens, vocabulary

from ..conftest import DATA
from .test_simhash import least_reachable


def test_nearest_lattice_point():
    r = np.random.default_rng(0)
    x = r.normal(scale=2, size=(500, 8))
    p = E.nearest_e8(x)
    doubled = (2 * p).round().astype(int)
    assert np.allclose(2 * p, doubled) and (doubled % 2 == doubled[:, :1] % 2).all() and (doubled.sum(axis=1) % 4 == 0).all()
    # No neighbour is closer, and nothing is further than the covering radius 1.
    d = ((x - p) ** 2).sum(axis=1)
    assert d.max() <= 1 + 1e-9
    assert all((((x - p - root) ** 2).sum(axis=1) >= d - 1e-9).all() for root in E.e8_roots())


def brute(rows, least=0.9):
    """Links by full comparison; rows: (id, vector or None)."""
    good = [(i, np.array(v, float)) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    good = [(i, v / np.abs(v).max()) for i, v in good]
    links = set()
    for n, (i, a) in enumerate(good):
        for m, (j, b) in enumerate(good[n + 1 :], n + 1):
            if len(a) == len(b) and a @ b / np.linalg.norm(a) / np.linalg.norm(b) >= least:
                links.add((n, m))
    return good, links


def result(rows, least=0.9):
    good, links = brute(rows, least)
    n_links = Counter(x for pair in links for x in pair)
    ids = [i for i, _ in good]
    # Rows in the order of their ids, so that the least row of a group has its least id.
    order = sorted(range(len(good)), key=lambda n: ids[n])
    rank = {n: k for k, n in enumerate(order)}
    group = least_reachable(set(rank.values()), [(rank[a], rank[b]) for a, b in links])
    linked = Counter((i, n_links[n], (least_id := ids[order[group[rank[n]]]]), least_id == i) for n, (i, _) in enumerate(good))
    rest = Counter(i for i, _ in rows) - Counter(ids)
    return linked + Counter({(i, 0, i, i is not None): n for i, n in rest.items()})


def found(df):
    return Counter((r.vec_id, r.n_links, r.component_id, r.kept) for r in df.collect())


@pytest.fixture(scope="module")
def crowded():
    """Tight and loose clusters, copies, scaled copies and strangers."""
    r = np.random.default_rng(3)
    rows = []
    for size, spread in ((40, 0.01), (30, 0.03), (150, 0.005)):
        centre = r.normal(size=64)
        rows += [(centre + spread * np.linalg.norm(centre) * r.normal(size=64) / 1.0).tolist() for _ in range(size)]
    rows += [rows[0]] * 20 + [[2 * x for x in rows[1]]] + r.normal(size=(60, 64)).tolist()
    return [(i, v) for i, v in enumerate(rows)]


@pytest.mark.parametrize("block", [16, 512])
def test_links_against_brute_force(spark, monkeypatch, crowded, block):
    monkeypatch.setattr(blocks, "BLOCK_ROWS", block)
    df = spark.createDataFrame(crowded, "vec_id long, embedding array<double>")
    got, wanted = found(E.near_duplicate_vectors(df)), result(crowded)
    links, all_links = (sum(k[1] * n for k, n in c.items()) for c in (got, wanted))
    assert links <= all_links
    assert links >= 0.9 * all_links
    # Copies and tight clusters are whole.
    assert {k[0]: k[1:] for k in got if k[0] >= 70 and k[0] < 220} == {k[0]: k[1:] for k in wanted if k[0] >= 70 and k[0] < 220}


@pytest.mark.parametrize("plan", [None, (29, 3), (77, 4)])
def test_recall_near_the_threshold(spark, plan):
    """Pairs at cosine 0.90 to 0.92 exactly; recall of links against all, with the plan of each size."""
    assert E.lattice_plan(1200) == (10, 2) and E.lattice_plan(10**9) == (77, 4)
    r = np.random.default_rng(4)
    a = r.normal(size=(600, 64))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    z = r.normal(size=(600, 64))
    z -= (z * a).sum(axis=1, keepdims=True) * a
    z /= np.linalg.norm(z, axis=1, keepdims=True)
    c = np.linspace(0.9005, 0.92, 600)[:, None]
    b = c * a + np.sqrt(1 - c * c) * z
    rows = [(2 * i, x) for i, x in enumerate(a.tolist())] + [(2 * i + 1, x) for i, x in enumerate(b.tolist())]
    got = E.near_duplicate_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), plan=plan).cache()
    assert got.filter("n_links > 0").count() / 1200 >= 0.9
    assert got.filter("vec_id % 2 = 1 and component_id not in (vec_id, vec_id - 1)").count() == 0


def test_shared_ids(spark):
    """Rows that share an id are vectors of their own; equal vectors link whatever their ids."""
    r = np.random.default_rng(5)
    a, b = r.normal(size=(2, 64))
    rows = [(i, (a + 0.02 * r.normal(size=64)).tolist()) for i in (1, 2, 3, 5)] + [(i, (b + 0.02 * r.normal(size=64)).tolist()) for i in (5, 7, 8, 9)] + [(5, b.tolist())] * 2
    got = found(E.near_duplicate_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>")))
    assert got == result(rows) and got[5, 3, 1, False] == 1


@pytest.mark.parametrize("many", [False, True])
def test_hot_cells_either_way(spark, monkeypatch, many):
    """Large cells are found by broadcast or by a salted join, with the same links."""
    monkeypatch.setattr(blocks, "BLOCK_ROWS", 8)
    if many:
        monkeypatch.setattr(blocks, "BROADCAST_CELLS", 0)
    r = np.random.default_rng(6)
    centre = r.normal(size=32)
    rows = [(i, (centre + 0.05 * r.normal(size=32)).tolist()) for i in range(120)]
    assert found(E.near_duplicate_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))) == result(rows)


def test_embedding_query(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{DATA}/sf0.001/embeddings.parquet").collect()]
    assert found(op7_embeddings(spark, f"{DATA}/sf0.001")) == result(rows)


def test_embedding_edges(spark):
    one, nan = [1.0] * 64, float("nan")
    rows = [(1, one), (2, None), (3, []), (4, [0.0] * 64), (5, [nan] * 64), (6, [*one[1:], None]), (None, one), (7, one), (8, [1e200] * 64), (9, [1.0, 2.0]), (10, [1.0, 2.0]), (11, [float("inf"), 1.0]), (12, [-1.0] * 64)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("node", F.lit("clash")).withColumn("h1", F.lit(1))
    assert found(E.near_duplicate_vectors(df)) == result(rows)
    assert E.near_duplicate_vectors(df.limit(0)).collect() == []


@pytest.mark.parametrize("seed", range(8))
def test_wavelet_shard(seed, tmp_path):
    r = random.Random(seed)
    top = r.choice([1, 2, 5, 300, 50_257, 1 << 20])
    values = np.array([min(int(r.expovariate(1) * top / 4), top - 1) for _ in range(r.choice([1, 7, 511, 512, 513, 3000, 300_000]))], np.uint32)
    path = tmp_path / "x.wvmx"
    import pyarrow as pa

    path.write_bytes(W.shard_bytes(pa.table({"doc_id": [1], "n_tokens": [len(values)]}), values))
    with open(path, "rb") as f:
        shard = W.WaveletShard(f)
        assert (shard.all() == values).all()
        for i in r.sample(range(len(values)), min(60, len(values))):
            assert shard.access(i) == values[i]
        for v in {int(x) for x in r.sample(values.tolist(), min(20, len(values)))} | {0, top + 5}:
            places = np.flatnonzero(values == v)
            a, b = sorted((r.randint(0, len(values)), r.randint(0, len(values))))
            assert shard.count(v) == len(places) and shard.count(v, a, b) == ((places >= a) & (places < b)).sum()
            for j in {0, len(places) // 2, len(places) - 1, len(places)}:
                assert shard.find(v, j) == (places[j] if 0 <= j < len(places) else -1)
        with pytest.raises(IndexError):
            shard.access(len(values))


def test_wavelet_planes_are_compressed():
    values = np.minimum(np.random.default_rng(0).zipf(1.3, 400_000), 50_000).astype(np.uint32)
    import pyarrow as pa

    whole = W.shard_bytes(pa.table({"doc_id": [1], "n_tokens": [len(values)]}), values)
    assert len(whole) < 0.8 * len(values) * 16 / 8


def test_shards_of_repeated_ids_have_bounded_parts(spark, tmp_path, monkeypatch):
    """Equal and null ids are dealt to many tasks; starts come from grouped prefix sums."""
    monkeypatch.setattr(W, "PARTITION_BYTES", 2000)
    monkeypatch.setattr(W, "GROUP_PARTS", 3)
    rows = [(None if i % 3 else 7, f"text number {i % 40} of many") for i in range(600)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((tuple(r) for r in W.tokenise_to_shards(df, vocabulary(BYTE_VOCABULARY), folder=str(tmp_path)).collect()), key=lambda r: r[1])
    wanted = expected(rows)
    assert [r[1:] for r in got] == [r[1:] for r in wanted] and [r[0] for r in got] == [r[0] for r in wanted]
    assert len(list(tmp_path.iterdir())) > 6


def expected(docs):
    library = Tokenizer.from_file(vocabulary(BYTE_VOCABULARY))
    start, out = 0, []
    for doc_id, text in sorted(docs, key=lambda d: (d[0] is not None, d[0] or 0, d[1] or "")):
        ids = array("I", [*library.encode(text or "", add_special_tokens=False).ids, 0])
        out.append((doc_id, start, len(ids), zlib.crc32(ids.tobytes()), ids[0]))
        start += len(ids)
    return sorted(out, key=lambda r: r[1])


def test_token_query(spark):
    docs = spark.read.parquet(f"{DATA}/sf0.001/documents.parquet").select("doc_id", "text").collect()
    got = sorted((tuple(r) for r in op10_tokens(spark, f"{DATA}/sf0.001").collect()), key=lambda r: r[1])
    assert got == expected(docs)


def test_token_edges_and_files(spark, edge_docs, empty_docs, tmp_path):
    path = vocabulary(BYTE_VOCABULARY)
    docs = edge_docs.select("doc_id", "text").collect()
    got = W.tokenise_to_shards(edge_docs, path, shard_tokens=20, folder=str(tmp_path))
    assert sorted((tuple(r) for r in got.collect()), key=lambda r: r[1]) == expected(docs)
    assert len(list(tmp_path.iterdir())) > 3 and not [p for p in tmp_path.iterdir() if p.name.startswith(".")]
    assert W.tokenise_to_shards(empty_docs, path).collect() == []
    assert local_path("file:/a") == "/a" and local_path("hdfs://a/b") is None
