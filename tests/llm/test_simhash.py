import random
import re

import pytest
import xxhash
from pyspark.sql import functions as F

from meridia.llm import blocks
from meridia.llm import simhash as S
from meridia.llm.components import connected_components
from meridia.llm.queries import op6_simhash

from ..conftest import DATA


def fingerprint(text):
    words = re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def least_reachable(nodes, links):
    parent = {n: n for n in nodes}

    def root(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for a, b in links:
        a, b = sorted((root(a), root(b)))
        parent[b] = a
    return {n: root(n) for n in nodes}


def brute(docs):
    by = [(i, fingerprint(t)) for i, t in docs]
    distinct = sorted({f for _, f in by})
    group = least_reachable(distinct, [(a, b) for n, a in enumerate(distinct) for b in distinct[n + 1 :] if (a ^ b).bit_count() <= 2])
    least = {}
    for i, f in by:
        if i is not None:
            least[group[f]] = min(i, least.get(group[f], i))
    return sorted((str(i), f"{f:016x}", least.get(group[f])) for i, f in by)


def rows(df):
    return sorted((str(r.doc_id), r.fingerprint, r.component_id) for r in df.collect())


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_query_against_brute_force(spark, sf):
    docs = spark.read.parquet(f"{DATA}/{sf}/documents.parquet").select("doc_id", "text").collect()
    assert rows(op6_simhash(spark, f"{DATA}/{sf}")) == brute(docs)


@pytest.mark.parametrize("large", [1, 3, 64])
def test_links_with_large_buckets(spark, monkeypatch, large):
    """Fingerprints crowded into shared segments, so that both ways of searching meet."""
    monkeypatch.setattr(S, "LARGE_BUCKET", large)
    r = random.Random(large)
    found = set()
    for _ in range(6):
        base = r.getrandbits(64)
        for _ in range(60):
            x = base
            for _ in range(r.randint(0, 4)):
                x ^= 1 << r.choice([*range(0, 6), *range(15, 18), *range(30, 35), *range(46, 50), 63])
            found.add(x)
    signed = {x - (1 << 64) if x >> 63 else x: x for x in found}
    df = spark.createDataFrame([(x,) for x in signed], "fp long")
    got = {tuple(sorted((signed[a], signed[b]))) for a, b in S.fingerprint_links(df).collect()}
    ordered = sorted(found)
    assert got == {(a, b) for n, a in enumerate(ordered) for b in ordered[n + 1 :] if (a ^ b).bit_count() <= 2}


def test_components(spark):
    r = random.Random(1)
    edges = [(i, i + 1) for i in range(300)] + [(1000 + r.randrange(200), 1000 + r.randrange(200)) for _ in range(150)] + [(5000, 5000 + i) for i in range(1, 300)] + [(-5, -(2**62)), (7, 7)]
    got = dict(connected_components(spark.createDataFrame(edges, "a long, b long")).collect())
    nodes = {n for e in edges for n in e if e[0] != e[1]}
    assert got == least_reachable(nodes, [e for e in edges if e[0] != e[1]])
    assert connected_components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_edges(spark, edge_docs, empty_docs):
    assert rows(S.near_duplicates(edge_docs)) == brute(edge_docs.select("doc_id", "text").collect())
    assert S.near_duplicates(empty_docs).collect() == []
    kept = S.drop_near_duplicates(edge_docs)
    assert kept.columns == edge_docs.columns
    component = {str(r.doc_id): r.component_id for r in S.similar_texts(edge_docs).collect()}
    assert component == {str(i): c for i, c in brute_similar(edge_docs.select("doc_id", "text").collect()).items()}
    expected = sorted(str(r.doc_id) for r in edge_docs.collect() if r.doc_id is None or str(component[str(r.doc_id)]) == str(r.doc_id))
    assert sorted(str(r.doc_id) for r in kept.select("doc_id").collect()) == expected


def shingle_set(text):
    words = re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))
    return frozenset(b" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def similar_pairs(sets, least=0.8):
    """All pairs of different sets at that similarity."""
    ordered, by, out = sorted(set(sets), key=sorted), {}, []
    for n, s in enumerate(ordered):
        for x in s:
            by.setdefault(x, []).append(n)
    common = {}
    for group in by.values():
        for k, a in enumerate(group):
            for b in group[k + 1 :]:
                common[a, b] = common.get((a, b), 0) + 1
    for (a, b), n in common.items():
        if n >= least * (len(ordered[a]) + len(ordered[b]) - n):
            out.append((ordered[a], ordered[b]))
    return out


def brute_similar(docs, least=0.8):
    """The least id of each document's group, by Jaccard similarity of all pairs."""
    by = [(i, shingle_set(t)) for i, t in docs if i is not None]
    number = {s: n for n, s in enumerate({s for _, s in by})}
    group = least_reachable(set(number.values()), [(number[a], number[b]) for a, b in similar_pairs([s for _, s in by], least)])
    least_id = {}
    for i, s in by:
        least_id[group[number[s]]] = min(i, least_id.get(group[number[s]], i))
    return {i: least_id[group[number[s]]] for i, s in by}


def edited(r, words, share):
    out = list(words)
    for _ in range(max(1, round(share * len(words)))):
        out[r.randrange(len(out))] = f"w{r.randrange(10**6)}"
    return out


@pytest.mark.parametrize("block", [8, 256])
def test_similar_texts_against_all_pairs(spark, monkeypatch, block):
    """Edited copies around the least similarity, and a crowd of copies of one text."""
    monkeypatch.setattr(blocks, "BLOCK_ROWS", block)
    r, texts = random.Random(block), []
    for _ in range(120):
        base = [f"w{r.randrange(5000)}" for _ in range(r.randint(40, 400))]
        texts += [base, edited(r, base, r.choice([0.005, 0.01, 0.02, 0.03, 0.05]))]
    crowd = [f"w{r.randrange(5000)}" for _ in range(150)]
    texts += [edited(r, crowd, 0.005) for _ in range(150)]
    docs = [(i, " ".join(t)) for i, t in enumerate(texts)]
    docs += [(1000 + i, t.upper() + " ") for i, (_, t) in enumerate(docs[:30])]
    got = {x.doc_id: x.component_id for x in S.similar_texts(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    wanted = brute_similar(docs)
    # Nothing is grouped that isn't linked, and few links are missed.
    assert all(wanted[c] == wanted[i] for i, c in got.items())
    pairs = [(i, i + 1) for i in range(0, 240, 2) if wanted[i] == wanted[i + 1]]
    assert len(pairs) > 50 and sum(got[a] == got[b] for a, b in pairs) >= 0.93 * len(pairs)
    assert sum(got[i] == 240 for i in range(240, 390)) >= 148 and all(got[1000 + i] == got[i] for i in range(30))


@pytest.mark.parametrize("block", [8, 256])
def test_reruns_compare_the_same_texts(spark, monkeypatch, block):
    """The links to verify don't depend on the order of arrival, with ties and crowds."""
    monkeypatch.setattr(blocks, "BLOCK_ROWS", block)
    verify, seen = S._similar_enough, []

    def recorded(links, sets, least):
        seen.append(sorted(tuple(x) for x in links.collect()))
        return verify(links, sets, least)

    monkeypatch.setattr(S, "_similar_enough", recorded)
    r, docs = random.Random(block), []
    for n in (2, 5, 12, 60):
        base = [f"w{r.randrange(5000)}" for _ in range(120)]
        docs += [(len(docs) + k, " ".join(edited(r, base, 0.015))) for k in range(n)]
    found = []
    for parts in (1, 5):
        r.shuffle(docs)
        df = spark.createDataFrame(docs, "doc_id long, text string").repartition(parts)
        found.append(sorted(tuple(x) for x in S.similar_texts(df).collect()))
    assert seen[0] == seen[1] and seen[0] and found[0] == found[1]


def test_similar_texts_of_a_table(spark):
    """Recall of pairs over all of sf0.01."""
    df = spark.read.parquet(f"{DATA}/sf0.01/documents.parquet")
    docs = df.select("doc_id", "text").collect()
    got = {x.doc_id: x.component_id for x in S.similar_texts(df).collect()}
    wanted = brute_similar(docs)
    assert all(wanted[c] == wanted[i] for i, c in got.items())
    first = {}
    for i, t in docs:
        first.setdefault(shingle_set(t), i)
    pairs = [(first[a], first[b]) for a, b in similar_pairs([shingle_set(t) for _, t in docs])]
    assert sum(got[a] == got[b] for a, b in pairs) >= 0.9 * len(pairs)


def test_nearest_links(monkeypatch):
    """Spanning forests, whatever the order and the links held; against plain Kruskal."""
    import numpy as np

    r = random.Random(4)
    for held, forests in ((3, 1), (1 << 18, 1), (3, 2), (1 << 18, 2)):
        monkeypatch.setattr(blocks.NearestLinks, "HELD", held)
        for _ in range(15):
            n = r.randint(2, 12)
            links = {(a, b): r.randint(0, 9) for a in range(n) for b in range(a + 1, n) if r.random() < 0.6}
            expected, left = set(), sorted((d, a, b) for (a, b), d in links.items())
            for _ in range(forests):
                part, over = {x: x for x in range(n)}, []
                for d, a, b in left:
                    if part[a] == part[b]:
                        over.append((d, a, b))
                        continue
                    expected.add((a, b))
                    part = {x: part[a] if p == part[b] else p for x, p in part.items()}
                left = over
            found, arrivals = blocks.NearestLinks(forests), [(*r.sample(k, 2), d) for k, d in links.items() for _ in range(2)]
            r.shuffle(arrivals)
            for at in range(0, len(arrivals), 5):
                a, b, d = np.array(arrivals[at : at + 5], np.int64).T
                found.add(a, b, d)
            assert set(zip(*(x.tolist() for x in found.links()), strict=True)) == expected


@pytest.mark.parametrize("block, sample", [(8, 10_000), (8, 1), (256, 10_000)])
def test_no_similar_pair_is_left_out(spark, monkeypatch, block, sample):
    """Tiny texts at just the least similarity, and crowds in which nearer links fail; whatever the blocks and the order of shingles."""
    monkeypatch.setattr(blocks, "BLOCK_ROWS", block)
    monkeypatch.setattr(S, "SAMPLE_DOCS", sample)
    r, texts = random.Random(7), []
    for _ in range(80):
        base = [f"w{r.randrange(5000)}" for _ in range(r.choice([8, 8, 10, 12, 14]))]
        texts += [base, [*base, "more"]]
    for n in (5, 12, 60, 150):
        base = [f"w{r.randrange(5000)}" for _ in range(120)]
        texts += [edited(r, base, 0.015) for _ in range(n)]
    docs = [(i, " ".join(t)) for i, t in enumerate(texts)]
    got = {x.doc_id: x.component_id for x in S.similar_texts(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == brute_similar(docs)


def test_similar_sets_share_a_shingle_of_their_prefixes():
    """Also where sizes times the similarity are whole numbers, in every order of shingles."""
    import numpy as np

    r = np.random.default_rng(3)
    for least in (0.5, 0.7, 0.8, 0.9):
        for _ in range(300):
            union = r.choice(10**6, int(r.integers(1, 60)), replace=False).astype(np.uint64)
            both = int(np.ceil(least * len(union) - 1e-9))
            cut = int(r.integers(both, len(union) + 1))
            a, b = np.sort(union[:cut]), np.sort(np.concatenate([union[:both], union[cut:]]))
            frequent = np.sort(r.choice(union, len(union) // 2, replace=False))
            counts = r.integers(2, 5, len(frequent))
            first = [S.prefix(x, frequent, counts, least).tolist() for x in (a, b)]
            shared = [x for x in first[0] if x in first[1]]
            assert shared
            left = min(len(a) - first[0].index(shared[0]), len(b) - first[1].index(shared[0]))
            assert left >= both


def test_an_id_with_two_texts(spark):
    docs = spark.createDataFrame([(1, "one two three"), (5, "one two three"), (5, "something else here")], "doc_id long, text string")
    # Id 5 still names the second text's group, so its rows stay.
    assert sorted(r.doc_id for r in S.drop_near_duplicates(docs).collect()) == [1, 5, 5]


def test_fingerprint_column(spark):
    df = spark.createDataFrame([("Hello World",), ("",), ("a " * 200_000,)], "t string")
    got = [r.f & (2**64 - 1) for r in df.select(S.simhash_column(F.col("t")).alias("f")).collect()]
    assert got == [fingerprint("Hello World"), 0, fingerprint("a " * 200_000)]
