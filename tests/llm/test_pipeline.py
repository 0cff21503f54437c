from collections import Counter

import pytest

import corpus_pipeline as C
from meridia.llm import quality as Q
from meridia.llm.common import materialize
from meridia.llm.mixing import mix_plan

from ..conftest import DATA
from .test_mixing_lines import brute_lines, check_mix
from .test_packing import check_packing
from .test_simhash import brute_similar

SF = f"{DATA}/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    """The input of each stage and the output of the last, each written and reread."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = [docs]
    for name, stage in C.STAGES:
        kept.append(materialize(stage(spark, kept[-1], SF), name))
    return kept


def rows(df):
    return Counter(tuple(r) for r in df.select("doc_id", "text", "source").collect())


def test_columns(stages):
    assert [n for n, _ in C.STAGES] == ["quality", "lines", "near_duplicates", "mix", "pack"]
    for df in stages[1:-1]:
        assert df.dtypes == stages[0].dtypes


def test_quality_keeps_what_its_model_accepts(spark, stages):
    docs = stages[0]
    model = Q.fit_quality(docs, Q.training_labels(spark.read.parquet(f"{SF}/labels.parquet")))
    found = Q.Indicators()
    expected = Counter(tuple(r) for r in docs.select("doc_id", "text", "source").collect() if model.score(found(r.text or "")) >= 0.3)
    assert rows(stages[1]) == expected and 0 < len(expected) < docs.count()


def test_lines(stages):
    got = Counter((r.doc_id, r.text) for r in stages[2].select("doc_id", "text").collect())
    assert got == brute_lines(stages[1].select("doc_id", "text", "source").collect())
    assert stages[2].filter("n_chars <> length(text)").count() == 0


def test_near_duplicates(stages):
    """One of each group by Jaccard similarity of five-word shingles; at this size no link is missed."""
    component = brute_similar(stages[2].select("doc_id", "text").collect())
    assert rows(stages[3]) == Counter({r: n for r, n in rows(stages[2]).items() if component[r[0]] == r[0]})


def test_mix(stages):
    plan = mix_plan(stages[3])
    check_mix(stages[3].select("doc_id", "text", "source").collect(), plan)
    copies = {r.doc_id: r.copies for r in plan.collect()}
    assert rows(stages[4]) == +Counter({r: n * copies[r[0]] for r, n in rows(stages[3]).items()})


def test_pack_and_run(spark, stages):
    check_packing(stages[4].select("doc_id", "text").collect(), stages[5])
    same = lambda df: Counter((r.doc_id, r.piece, r.length, r.ids_crc32) for r in df.collect())
    assert same(C.run(spark, SF)) == same(stages[5])


def test_empty_and_edges(spark, edge_docs, tmp_path):
    names = ["doc_id", "text", "lang", "source", "n_chars", "fp", "score", "label", "copies"]
    labels = spark.createDataFrame([(1, 1, 0), (5, 0, 0), (7, 1, 0)], "doc_id long, quality int, toxic int")
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    for docs in (edge_docs.select(names), edge_docs.select(names).limit(0)):
        for name, stage in C.STAGES[:-1]:
            columns = docs.columns
            docs = materialize(stage(spark, docs, str(tmp_path)), name)
            assert docs.columns == columns
        C.pack(spark, docs, str(tmp_path)).collect()
