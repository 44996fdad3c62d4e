"""The registered queries on the small tables: against their SQL, and the pipeline against brute force."""

import cases
import pytest
from compare import compare, connect
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
from tallywire.llm import queries

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, con, name):
    assert compare(spark, con, SF, entry.queries()[name], entry.oracle_sql().get(name)) is None


def test_all_are_registered():
    names = set(entry.queries())
    assert "pipeline" in names and all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 14))


def test_classifier_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    scored = entry.queries()["op8_additive_quality"](spark, sf)
    labels = spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", "quality")
    rows = scored.where("held_out").join(labels, "doc_id").select("predicted", "quality").collect()
    assert sum(r["predicted"] == r["quality"] for r in rows) / len(rows) > 0.95


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        before = {r["doc_id"]: r for r in docs.collect()}
        out = stage(spark, docs, SF)
        kept[name] = {r["doc_id"]: r for r in out.collect()}
        assert set(kept[name]) <= set(before)
        if name == "quality rules":
            assert all(cases.measures(before[i]["text"])[0] >= 50 for i in kept[name])
        elif name == "line dedup":
            assert set(kept[name]) == set(before)
            sites = {}
            for r in before.values():
                for x in (r["text"] or "").split("\n"):
                    sites.setdefault(x, set()).add(r["source"])
            for i, r in kept[name].items():
                want = [x for x in before[i]["text"].split("\n") if not x.strip() or len(sites[x]) < corpus_pipeline.MIN_SITES]
                assert r["text"] == "\n".join(want)
        elif name == "n-gram Jaccard join":
            want = cases.components([(i, r["text"]) for i, r in before.items()])
            assert set(kept[name]) == {c for _, c in want.values()}
        elif name == "SentencePiece encoding":
            assert set(kept[name]) == set(before)
            assert all(len(r["piece_ids"]) == r["n_pieces"] for r in kept[name].values())
            continue
        assert out.columns == docs.columns
        docs = out.select(*[F.col(c) for c in out.columns]).persist()
    assert len(kept["benchmark decontamination"]) < len(kept["n-gram Jaccard join"]) <= len(kept["line dedup"])
