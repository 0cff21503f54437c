import hashlib
import re
import time
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from meridia.llm import linededup as L
from meridia.llm import mixing
from meridia.llm.common import materialize
from meridia.llm.mixing import mix_documents, mix_plan
from meridia.llm.queries import OP5_SQL, OP9_SQL, op5_mix, op9_line_dedup

from ..conftest import DATA, same_rows


def shares(sizes, weights=(1, 2, 3), most=3):
    """Shares by weight; the excess over the limit is shared anew until there is none."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    total, limited = sum(sizes.values()), {}
    while True:
        free = [s for s in order if s not in limited]
        left = total - sum(limited.values())
        target = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = [s for s in free if target[s] > most * sizes[s]]
        if not over:
            return {**limited, **target}
        limited |= {s: most * sizes[s] for s in over}


def size(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def brute_mix(docs):
    """How often each (doc_id, size, source) is taken, one row after the other."""
    sizes, by, out = defaultdict(int), defaultdict(list), Counter()
    for i, text, source in docs:
        sizes[source] += size(text)
        key = hashlib.md5(f"42:{'null' if i is None else i}:{hashlib.md5((text or '').encode()).hexdigest()}".encode()).hexdigest()
        by[source].append((key, i, size(text)))
    target = shares(sizes)
    for source, group in by.items():
        epochs, upto = (int(target[source] // sizes[source]) if sizes[source] else 0), 0
        for _, i, n in sorted(group, key=lambda g: g[0]):
            upto += n
            out[i, n, source, epochs + (2 * upto - n <= 2 * (target[source] - epochs * sizes[source]))] += 1
    return out, sizes, target


def check_mix(docs, plan):
    expected, sizes, target = brute_mix(docs)
    rows = plan.collect()
    assert Counter((r.doc_id, r.size, r.source, r.copies) for r in rows) == expected
    by = defaultdict(list)
    for r in rows:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(target[r.source])
        assert 0 <= r.copies <= 3
        by[r.source].append(r)
    for source, group in by.items():
        assert abs(sum(r.size * r.copies for r in group) - target[source]) <= max(r.size for r in group) / 2 + 1e-6


def test_mix_query(spark):
    same_rows(op5_mix(spark, f"{DATA}/sf0.01"), OP5_SQL, "sf0.01")
    docs = spark.read.parquet(f"{DATA}/sf0.01/documents.parquet")
    check_mix(docs.select("doc_id", "text", "source").collect(), mix_plan(docs))


def check_mixed(plan, mixed):
    expected = Counter()
    for r in plan.collect():
        expected[r.doc_id, r.size, r.source] += r.copies
    assert Counter((r.doc_id, size(r.text), r.source) for r in mixed.collect()) == +expected


def test_mix_of_null_and_repeated_ids(spark, monkeypatch):
    """Ids don't hold documents together: targets are met within half a document."""
    monkeypatch.setattr(mixing, "CHUNK_ROWS", 3)
    rows = [(None, f"a{i} b c d e", "s1", i) for i in range(100)] + [(7, f"x{i} y", "s2", i) for i in range(60)] + [(8, "same text", "s2", i % 3) for i in range(40)] + [(i, "p q r", "s3", 0) for i in range(30)]
    rows += [(9, "one two three", "s4", i // 20) for i in range(50)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, other long")
    plan, mixed = mix_plan(docs), mix_documents(docs)
    check_mix([r[:3] for r in rows], plan)
    check_mixed(plan, mixed)
    assert mixed.columns == docs.columns and len({r.copies for r in plan.collect() if r.source == "s4"}) == 2


def test_mix_edges(spark, edge_docs, empty_docs):
    plan = mix_plan(edge_docs)
    check_mix(edge_docs.select("doc_id", "text", "source").collect(), plan)
    mixed = mix_documents(edge_docs)
    assert mixed.columns == edge_docs.columns
    check_mixed(plan, mixed)
    assert mix_plan(empty_docs).collect() == [] and mix_documents(empty_docs).collect() == []
    blank = edge_docs.withColumn("text", F.lit(None).cast("string"))
    assert {(r.target, r.size) for r in mix_plan(blank).collect()} == {(0.0, 0)}


def test_line_query(spark):
    same_rows(op9_line_dedup(spark, f"{DATA}/sf0.01"), OP9_SQL, "sf0.01")


def brute_lines(docs, ratio=0.05, least=3):
    pages, seen = Counter(s for _, _, s in docs), Counter()
    for _, text, source in docs:
        for line in {x.strip(" ") for x in (text or "").split("\n")} - {""}:
            seen[source, line] += 1
    drop = {k for k, n in seen.items() if n >= least and n > ratio * pages[k[0]]}
    return Counter((i, None if t is None else "\n".join(x for x in t.split("\n") if (s, x.strip(" ")) not in drop)) for i, t, s in docs)


@pytest.mark.parametrize(("broadcast", "host_lines"), [(0, 512), (1000, 512), (1000, 2)])
def test_all_ways_drop_the_same(spark, monkeypatch, edge_docs, broadcast, host_lines):
    monkeypatch.setattr(L, "HOST_LINES", host_lines)
    docs = spark.read.parquet(f"{DATA}/sf0.01/documents.parquet")
    kept = L.drop_boilerplate(docs, broadcast_lines=broadcast)
    assert kept.columns == docs.columns
    assert Counter((r.doc_id, r.text) for r in kept.select("doc_id", "text").collect()) == brute_lines(docs.select("doc_id", "text", "source").collect())
    repeated = edge_docs.unionByName(edge_docs).unionByName(edge_docs)
    got = L.drop_boilerplate(repeated, broadcast_lines=broadcast)
    assert got.columns == edge_docs.columns
    counts = L.drop_boilerplate(repeated, broadcast_lines=broadcast, counts=True)
    assert {(r.doc_id, r.n_lines, r.n_dropped) for r in counts.collect()} >= {(2, 0, 0), (3, 1, 0), (6, 1, 1), (7, 4, 3)}
    assert Counter((r.doc_id, r.text) for r in got.select("doc_id", "text").collect()) == brute_lines(repeated.select("doc_id", "text", "source").collect())


def test_line_edges(empty_docs, edge_docs):
    assert L.drop_boilerplate(empty_docs, counts=True).collect() == []
    counted = L.drop_boilerplate(edge_docs, counts=True)
    assert [c for c in counted.columns if c == "n_lines"] == ["n_lines"]
    assert {(r.doc_id, r.n_lines, r.n_dropped) for r in counted.collect()} >= {(2, 0, 0), (3, 1, 0), (7, 4, 0)}


def test_many_boilerplate_lines_of_a_host(spark):
    """The cost of a line doesn't grow with the number of its host's boilerplate lines."""

    def seconds(lines):
        rows = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("h").alias("source"), F.concat_ws("\n", F.transform(F.sequence(F.lit(0), F.lit(39)), lambda x: F.concat(F.lit("line "), ((x * 101 + F.col("id") * 7) % lines).cast("string")))).alias("text"))
        docs = materialize(rows, "many")
        began = time.perf_counter()
        out = L.drop_boilerplate(docs, most_ratio=0.0, counts=True)
        assert out.agg(F.sum("n_dropped"), F.sum(F.length("text"))).first()[:] == (4000 * 40, 0)
        return time.perf_counter() - began

    seconds(100)
    assert seconds(16_000) < 3 * seconds(1_000) + 2
