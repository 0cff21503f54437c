import html
import re
import time
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from meridia.llm import htmlcrf as H
from meridia.llm import quality as Q
from meridia.llm.queries import op3_quality, op4_html

from ..conftest import DATA


def test_hinge_is_the_optimum():
    """Against the primal objective: no small move from the solution lowers it."""
    r = np.random.default_rng(0)
    ratio = r.normal(size=40)
    rows = [np.sort(r.choice(40, 8, replace=False)) for _ in range(60)]
    y = np.where(r.random(60) < 0.5, 1.0, -1.0)
    w, bias = Q.fit_hinge(rows, y, ratio, rounds=500)
    limit = np.where(y > 0, 60 / (2 * (y > 0).sum()), 60 / (2 * (y < 0).sum()))

    def objective(w, bias):
        margins = [(w[k] @ (ratio[k] / np.linalg.norm(ratio[k]))) + bias for k in rows]
        return 0.5 * (w @ w + bias**2) + (limit * np.maximum(0, 1 - y * np.array(margins))).sum()

    best = objective(w, bias)
    for _ in range(200):
        assert objective(w + 0.02 * r.normal(size=40), bias + 0.02 * r.normal()) >= best - 1e-3


def test_indicators():
    found = Q.Indicators()
    assert len(found("")) == 0 and len(found("a")) == 0
    assert len(found("abcd")) == 6 and (found("abcd") == found("abcd" * 1)).all()
    repeats = [len(set(found(" ".join(["ab"] * n)).tolist()) - set(found("ab ab ab").tolist())) for n in (3, 4, 8, 9)]
    assert repeats == [0, 1, 5, 5]
    long = "xy z" * 600_000
    assert (found(long) == found(long[:2_000])).all()


def ngrams(text):
    """Buckets by the definition, one n-gram after the other."""
    raw, found, words = text.encode(), set(), text.split()
    for n in (2, 3, 4):
        for i in range(len(raw) - n + 1):
            found.add(((int.from_bytes(raw[i : i + n], "big") * 2654435761 + n * 40503) % 2**32) >> 14)
    run = 1
    for a, b in zip(words, words[1:]):
        run = run + 1 if a == b else 1
        if 2 <= run <= 8:
            found.add(zlib.crc32(f"{run} equal words".encode()) % 2**18)
    return found


RUNS = [zlib.crc32(f"{n} equal words".encode()) % 2**18 for n in range(2, 9)]


def dense_ratio(x, y):
    p, q = 1 + x[y > 0].sum(axis=0), 1 + x[y < 0].sum(axis=0)
    # Buckets that no text here has count one for each class.
    ratio = np.log((p / (p.sum() + 2**18 - x.shape[1])) / (q / (q.sum() + 2**18 - x.shape[1])))
    ratio[~x.any(axis=0)] = 0
    return ratio


def dense_fit(x, y, ratio, rounds):
    z = x * ratio
    norm = np.linalg.norm(z, axis=1, keepdims=True)
    z = np.divide(z, norm, out=np.zeros_like(z), where=norm > 0)
    w, bias, alpha = np.zeros(x.shape[1]), 0.0, np.zeros(len(y))
    r = np.random.default_rng(0)
    for _ in range(rounds):
        moved = 0.0
        for i in r.permutation(len(y)):
            top = len(y) / (2 * (y == y[i]).sum())
            new = min(max(alpha[i] - (y[i] * (w @ z[i] + bias) - 1) / (z[i] @ z[i] + 1), 0), top)
            w, bias, moved = w + (new - alpha[i]) * y[i] * z[i], bias + (new - alpha[i]) * y[i], moved + abs(new - alpha[i])
            alpha[i] = new
        if moved < 1e-3 * len(y) ** 0.5:
            break
    return z @ w + bias, lambda v: (lambda u: (u @ w) / (np.linalg.norm(u) or 1) + bias)(v * ratio)


def test_scores_against_dense_brute_force(spark):
    """Counts, ratios, choice, fit and scores with full matrices, on all of sf0.001."""
    got = {r.doc_id: r.score for r in op3_quality(spark, f"{DATA}/sf0.001").collect()}
    docs = {r.doc_id: ngrams(r.text or "") for r in spark.read.parquet(f"{DATA}/sf0.001/documents.parquet").collect()}
    labels = sorted((r.doc_id, r.quality) for r in spark.read.parquet(f"{DATA}/sf0.001/labels.parquet").collect() if zlib.crc32(str(r.doc_id).encode()) % 5)
    used = sorted(set().union(*docs.values()) | set(RUNS))
    column = {b: n for n, b in enumerate(used)}
    matrix = {i: np.isin(np.array(used), list(f)).astype(float) for i, f in docs.items()}
    x, y = np.array([matrix[i] for i, _ in labels]), np.array([1.0 if q else -1.0 for _, q in labels])
    run_columns = [column[b] for b in RUNS]

    def ratios(x, y, runs):
        ratio = dense_ratio(x, y)
        if not runs:
            ratio[run_columns] = 0
        return ratio

    runs = False
    if min((y > 0).sum(), (y < 0).sum()) >= 6:
        part, r, wrong = np.empty(len(y), int), np.random.default_rng(0), [0, 0]
        for side in (-1, 1):
            part[r.permutation(np.flatnonzero(y == side))] = np.arange((y == side).sum()) % 3
        for k in range(3):
            for kind in (0, 1):
                _, margin = dense_fit(x[part != k], y[part != k], ratios(x[part != k], y[part != k], kind), 6)
                wrong[kind] += sum((margin(v) * s <= 0) / (y == s).sum() for v, s in zip(x[part == k], y[part == k]))
        runs = wrong[1] < wrong[0]
    margins, margin = dense_fit(x, y, ratios(x, y, runs), 12)
    slope, shift = Q.fit_logistic(margins, y, np.ones(len(y)))
    for i, v in matrix.items():
        assert got[i] == pytest.approx(1 / (1 + np.exp(-(slope * margin(v) + shift))), abs=1e-4)


def test_runs_are_chosen_only_if_they_serve():
    r = np.random.default_rng(2)
    plain = [" ".join(r.choice(list("abcdefgh"), 30)) for _ in range(60)]
    rows = [Q.Indicators()(t) for t in plain]
    y = np.where(np.arange(60) % 2 == 0, 1.0, -1.0)
    assert not Q.choose_family(rows[:4], y[:4])
    stuck = [Q.Indicators()(t if s > 0 else " ".join(w for w in t.split() for _ in range(r.integers(1, 6)))) for t, s in zip(plain, y, strict=True)]
    assert Q.choose_family(stuck, y)


@pytest.fixture(scope="module")
def scored(spark):
    return op3_quality(spark, f"{DATA}/sf0.1").join(spark.read.parquet(f"{DATA}/sf0.1/labels.parquet"), "doc_id").collect()


def test_held_out_accuracy(scored):
    held = [r for r in scored if r.held_out]
    assert len(held) > 500 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in scored)
    assert np.mean([r.predicted == r.quality for r in held]) > 0.97
    good = [r.predicted for r in held if r.quality == 1]
    assert np.mean(good) > 0.99


def test_counts(spark):
    df = spark.createDataFrame([("ab", 1), ("abc", 1), ("ab", 0), ("", 0)], "text string, label int")
    ns, by = Q.class_counts(df)
    assert ns.tolist() == [2, 2]
    bucket = Q.Indicators()("ab")
    assert by[1, bucket].tolist() == [2] and by[0, bucket].tolist() == [1]


def test_quality_edges(spark, edge_docs, empty_docs):
    labels = spark.createDataFrame([(1, 1), (5, 0), (7, 1), (8, 0), (None, 1), (9, None), (9, 1), (9, 0)], "doc_id long, quality int")
    train = Q.training_labels(labels)
    assert {tuple(r) for r in train.collect()} <= {(1, 1), (5, 0), (7, 1), (8, 0), (9, 1), (9, 0)}
    model = Q.fit_quality(edge_docs, train)
    rows = edge_docs.withColumn("score", Q.quality_score(model, edge_docs)).collect()
    assert len(rows) == edge_docs.count() and all(0 <= r.score <= 1 for r in rows)
    assert Q.keep_quality(edge_docs, train).columns == edge_docs.columns
    assert Q.keep_quality(empty_docs, train).collect() == []
    one_class = Q.fit_quality(edge_docs, train.filter("label = 1"))
    assert one_class.score(np.array([], int)) > 0.99
    assert Q.fit_quality(empty_docs, train).score(np.array([], int)) == pytest.approx(0.5)


def article(page):
    """The given pages' articles, by their one template."""
    m = re.search(r"<article>(.*?)(</article>|$)", page or "", re.S)
    parts = re.split(r"</?(?:p|h1)>", m[1]) if m else []
    return "\n".join(x for x in (" ".join(html.unescape(re.sub(r"<[^>]*>", " ", s)).split()) for s in parts) if x)


def test_html_query(spark):
    pages = {r.page_id: r for r in spark.read.parquet(f"{DATA}/sf0.01/pages.parquet").collect()}
    rows = op4_html(spark, f"{DATA}/sf0.01").collect()
    assert len(rows) == len(pages)
    for r in rows:
        assert r.text == article(pages[r.page_id].html) and r.n_chars == len(r.text) and r.url == pages[r.page_id].url


def test_field_on_unseen_pages():
    field, right, total = H.trained(), 0, 0
    for page in H.labelled_pages(200, seed=12345):
        blocks = H.blocks_of(page)
        labels = field.decode([field.emission(b) for b in blocks])
        right += sum(y == (b[3] or 0) for b, y in zip(blocks, labels, strict=True))
        total += len(blocks)
    assert right / total > 0.99


def share_right(field, pages):
    right = total = 0
    for page in pages:
        blocks = H.blocks_of(page)
        labels = field.decode([field.emission(b) for b in blocks])
        right += sum(y == (b[3] or 0) for b, y in zip(blocks, labels, strict=True))
        total += len(blocks)
    return right / total


@pytest.mark.parametrize("held_out", [("table",), ("unlisted",), ("bare",), ("main", "section")])
def test_field_on_unseen_layouts(held_out):
    """Trained without a layout, tested on it alone."""
    field = H.train(H.labelled_pages(500, shapes=[s for s in H.SHAPES if s not in held_out]))
    assert share_right(field, H.labelled_pages(150, seed=99, shapes=held_out)) > 0.95


PROSE = "Some words, of an article, that go on for a while."


@pytest.mark.parametrize(
    ("page", "text"),
    [
        (f"<body>{f'<p>{PROSE}</p>' * 3}</body>", [PROSE] * 3), (f"<table><tr><td><ul><li><a href=/a>One</a><li><a href=/b>Two</a></ul></td><td><p>{PROSE}</p><p>{PROSE}</p></td></tr></table>", [PROSE] * 2),
        (f'<div class="story-lead">{f"<p>{PROSE}</p>" * 2}</div>', [PROSE] * 2), (f'<article><p>{PROSE}</p></article>', [PROSE]), (f'<div id="mw-content-text"><p>{PROSE}</p></div>', [PROSE]),
        (f'<table><tr><td class="post"><p>{PROSE}</p></td></tr></table>', [PROSE]), (f'<nav><ul><li><a href="/">Home</a></ul></nav><h1>A title of it</h1><p>{PROSE}</p><p>{PROSE}</p><footer>© 2020 Someone</footer>', ["A title of it", PROSE, PROSE]),
        (f'<header><p>{PROSE}</p></header><div class="js-x k7"><p>{PROSE}</p><p>{PROSE}</p></div><div class="cookie-notice"><p>We use cookies.</p></div>', [PROSE] * 2),
    ],
)
def test_plain_layouts(page, text):
    assert H.trained().text(page).split("\n") == text


def test_hostile_pages_take_seconds():
    for page in ("<svg>" * 200_000, "<noscript>" * 100_000, "<p><object>" * 100_000, "<template><iframe>" * 60_000, "<script>x</script>" * 60_000):
        began = time.perf_counter()
        H.blocks_of(page)
        assert len(page) >= 10**6 and time.perf_counter() - began < 4


def test_viterbi_against_every_labelling():
    import itertools
    import random

    r, field = random.Random(0), H.BlockField()
    for _ in range(100):
        field.step = [[r.gauss(0, 1) for _ in range(2)] for _ in range(2)]
        field.start = [r.gauss(0, 1), r.gauss(0, 1)]
        e = [r.gauss(0, 1) for _ in range(r.randint(0, 7))]

        def total(ys, e=e):
            return (field.start[ys[0]] if ys else 0) + sum(x for x, y in zip(e, ys, strict=True) if y) + sum(field.step[a][b] for a, b in itertools.pairwise(ys))

        best = max(itertools.product((0, 1), repeat=len(e)), key=total)
        assert total(tuple(field.decode(e))) == pytest.approx(total(best))


@pytest.mark.parametrize(
    ("page", "blocks"),
    [
        ("", []), ("<p>a &amp; b&nbsp; c<br>d", ["a & b c d"]), ("<ul><li>x<li>y</ul>z", ["x", "y", "z"]), ("<script>var a='</p>';</script>t", ["t"]), ("<!-- <p>no</p> -->yes<!-- open", ["yes"]),
        ("a < b<p", ["a < b"]), ("<p>one<b>two</b>three</p></div>four", ["onetwothree", "four"]), ('<p title="a>b">t</p>', ["t"]), ("<title>no</title><textarea>no</textarea>x", ["x"]), ("<p> </p>", []),
        ('<p title="open>t', ["t"]), ("<script>never closed", []), ("</p></p>x<![CDATA[y]]>z", ["xz"]), ("&#x41;&copy;&bogus;", ["A©&bogus;"]),
        ("a&<b>amp;</b>", ["a&amp;"]), ("&lt<i>;x</i>", ["<;x"]), ("&am<!-- -->p;", ["&amp;"]), ("<svg>a<p>b</p>", ["a", "b"]),
    ],
)
def test_blocks(page, blocks):
    assert [b[0] for b in H.blocks_of(page)] == blocks


def test_long_and_broken_pages_are_linear():
    for page in ("<div>" * 50_000 + "x", '<a "' * 50_000, "<!--" * 50_000, "</div>" * 50_000, "<p>w </p>" * 50_000, "<" * 200_000, "<script " * 50_000):
        H.blocks_of(page)


def test_all_names_and_all_ancestors_count():
    long_list = '<div class="mt-4 flex w-full items-center px-2 py-1 border-t comments"><p>x</p></div>'
    late_id = f'<div class="{" ".join("abcdefghij")}" id="comments"><p>x</p></div>'
    deep = '<div class="comments">' + "<div>" * 30 + "x"
    for page in (long_list, late_id, deep):
        (block,) = H.blocks_of(page)
        assert {"group=comment", "name=comments"} <= H.ancestor_features(block[2])
    prose = "<p>Some words, of an article, that go on for a while.</p>"
    page = f"<article>{prose * 3}</article><footer>{'<div>' * 20}{prose.replace('article', 'footer')}{'</div>' * 20}</footer>"
    assert H.trained().text(page) == "\n".join(["Some words, of an article, that go on for a while."] * 3)


@pytest.mark.parametrize(
    ("page", "blocks"),
    [
        ("<p>so <math><msup><mi>x</mi><mn>2</mn></msup><mo>&gt;</mo><mn>1</mn></math> holds</p>", ["so x2>1 holds"]), ("<math><mtr><mtd>1</mtd><mtd>2</mtd></mtr></math>", ["1 2"]),
        (r"<p>a <math><semantics><mi>x</mi><annotation-xml><p>n</p></annotation-xml><annotation encoding='tex'>\x</annotation></semantics></math> b", ["a x b"]), ("<math><annotation/><mi>x</mi></math>y", ["xy"]),
        ("<p>see<xmp><b>if (a &lt; b)</b> </xmpx>\n&copy</XMP >after", ["see", "<b>if (a &lt; b)</b> </xmpx> &copy", "after"]), ("<xmp>a</p>b", ["a</p>b"]), ("<math>x</math> <annotation>shown</annotation>", ["x shown"]),
    ],
)
def test_formulas_and_raw_listings(page, blocks):
    assert [b[0] for b in H.blocks_of(page)] == blocks


def test_formulas_and_listings_stay_in_articles():
    prose = "<p>Some words, of an article, that go on for a while.</p>"
    page = f"<article>{prose * 2}<p>Then, as shown, <math><mi>E</mi><mo>=</mo><mi>m</mi></math> holds.</p><xmp>for x in <list>: run</xmp>{prose}</article>"
    text = "Some words, of an article, that go on for a while."
    assert H.trained().text(page).split("\n") == [text, text, "Then, as shown, E=m holds.", "for x in <list>: run", text]


def test_broken_formulas_and_listings_are_linear():
    for page in ("<math>" + "<annotation>" * 50_000, "<xmp>" * 50_000, "<math>" * 50_000, "<mphantom/>" * 50_000, "<xmp></xmp>" * 50_000):
        H.blocks_of(page)


def test_names_of_deep_pages_stay_linear():
    r = "abcdefghijklmnopqrstuvwxyz"
    page = "".join(f'<div class="q{r[n % 26]}{r[n // 26 % 26]}{r[n // 676 % 26]}{r[n // 17576]}">' for n in range(50_000)) + "x"
    (block,) = H.blocks_of(page, H.trained().weight)
    assert len(block[2][0]) < 100


def test_html_edges(spark):
    rows = [(1, None, None), (2, "u", ""), (3, "u", "<html></html>"), (4, "u", "<nav><a href=x>menu</a></nav>"), (5, "u", "<article><p>Text, of an article.</p></article>" * 2000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit(1))
    got = {r.page_id: r.t for r in pages.select("page_id", H.main_text(H.trained(), pages).alias("t")).collect()}
    assert got == {1: "", 2: "", 3: "", 4: "", 5: "\n".join(["Text, of an article."] * 2000)}
    assert pages.limit(0).select(H.main_text(H.trained(), pages).alias("t")).collect() == []
