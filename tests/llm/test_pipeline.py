import os

import pytest
from conftest import SF
from test_decontaminate import D
from test_mixing import level
from test_run_index import brute
from test_near_copies import brute_by_shingle as near

import __spark_entry__ as entry
import corpus_pipeline as P
from tickloom.llm.common import table


def test_registered():
    assert entry.queries()["pipeline"] is P.run
    assert [n for n, _ in P.STAGES] == ["toxicity", "simhash near-dedup", "suffix-array dedup", "benchmark decontamination", "mixing sources to target weights"]


def rows(df):
    return {r["doc_id"]: r for r in df.collect()}


@pytest.fixture(scope="module")
def docs(spark):
    return table(spark, SF, "documents")


def test_toxic_documents_go(spark, docs):
    scores = {r["doc_id"]: r["score"] for r in entry.queries()["op1_toxicity"](spark, SF).collect()}
    out = P.reject_toxic(spark, docs, SF)
    assert out.columns == docs.columns and set(rows(out)) == {i for i, s in scores.items() if s < 0.3}


def test_near_copies_go(spark, docs):
    groups = near([(r["doc_id"], r["text"]) for r in docs.collect()])
    out = dict(P.STAGES)["simhash near-dedup"](spark, docs, SF)
    assert out.columns == docs.columns and sorted(rows(out)) == sorted(min(docs_of) for docs_of in groups)


def test_a_stage_drops_the_tables_of_the_one_before(spark, docs, tmp_path):
    first, second = P.STAGES[1][1], P.STAGES[2][1]
    out = first(spark, docs, SF)
    made = list(P._tables)
    assert made and all(os.path.isdir(p) for p in made)
    out.write.parquet(str(tmp_path / "kept"))
    again = second(spark, spark.read.parquet(str(tmp_path / "kept")), SF)
    n = again.count()
    assert not any(os.path.isdir(p) for p in made) and n == spark.read.parquet(str(tmp_path / "kept")).count()
    lazy = first(spark, docs, SF)
    held = list(P._tables)
    assert second(spark, lazy, SF).count() == n  # a result that was not written keeps what it reads
    assert any(os.path.isdir(p) for p in held)


def test_repeats_are_cut(spark, docs):
    out = P.cut_repeats(spark, docs, SF)
    got = rows(out)
    removed = {r[0]: r for r in brute([(r["doc_id"], r["text"]) for r in docs.collect()])}
    assert out.columns == docs.columns and set(got) == set(removed)
    for i, r in got.items():
        kept = removed[i][1] - removed[i][2]
        assert 0 <= len(r["text"].encode()) - kept <= 6 * removed[i][3] and r["n_chars"] == len(r["text"])


def test_contaminated_documents_go(spark, docs):
    items = [D.words(r["text"]) for r in table(spark, SF, "benchmark").collect()]
    def holds(text):
        seen = D.shingles(D.words(text), 5)
        return any(len(s & seen) >= 0.8 * len(s) for s in (D.shingles(t, 5) for t in items))
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    out = P.drop_contaminated(spark, docs, SF)
    want = {i for i, t in texts.items() if not holds(t)}
    assert out.columns == docs.columns and set(rows(out)) == want and len(want) < len(texts)


def test_whole_run(spark):
    out = P.run(spark, SF).collect()
    assert out and [r["position"] for r in out] == sorted(r["position"] for r in out)
    by = {}
    for r in out:
        by.setdefault(r["source"], []).append(r)
        assert 0 < r["taken"] <= 3 * r["size"]
    names = sorted(by)
    want = level([by[s][0]["source_size"] for s in names], [1 + i % 3 for i in range(len(names))])
    for s, t in zip(names, want):
        assert by[s][0]["target"] == pytest.approx(t, rel=1e-6) and abs(sum(r["taken"] for r in by[s]) - t) <= 1


ODD = [(None, None, None, None, None), (None, "a b c", "en", "s", 5), (1, "", "en", None, 0), (2, "word " * 60, "en", "s", 1), (2, "word " * 60, "en", "s", 1),
       (3, "word " * 60, None, "t", 1), (4, "x" * 200000, "en", "t", 1)]


def test_odd_rows_and_no_rows(spark, docs):
    for data in (ODD, []):
        df = spark.createDataFrame([(*r, "clash", "clash") for r in data], "doc_id long, text string, lang string, source string, n_chars long, size string, marks string")
        for _, stage in P.STAGES[:-1]:
            df = spark.createDataFrame(stage(spark, df, SF).collect(), df.schema)
            assert df.count() <= len(data)
        out = P.STAGES[-1][1](spark, df, SF).collect()
        assert len(out) <= len(data) and all(r["taken"] > 0 for r in out)
