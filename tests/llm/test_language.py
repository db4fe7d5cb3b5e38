import random
from collections import Counter

import numpy as np
from conftest import SF

from tickloom.llm import language
from tickloom.llm.common import table
from tickloom.llm.queries import QUERIES

DOCS = "doc_id long, text string, lang string, score string"


def run(spark, train, docs):
    model = language.fitted(spark.createDataFrame(train, DOCS))
    return {r["doc_id"]: (r["lang_pred"], r["score"]) for r in language.predicted(spark.createDataFrame(docs, DOCS), model).collect()}


def material(n=240):
    rnd = random.Random(1)
    kinds = {"xx": ["ka", "ru", "to"], "yy": ["sch", "ein", "ü"], "zz": ["ção", "os", "lh"]}
    return [(i, " ".join("".join(rnd.choices(kinds[k], k=3)) for _ in range(rnd.randint(3, 40))), k, "s")
            for i, k in enumerate(rnd.choices(sorted(kinds), k=n))]


def test_held_out_languages(spark):
    rows = material()
    got = run(spark, rows[:160], rows[160:])
    assert np.mean([got[i][0] == k for i, _, k, _ in rows[160:]]) > 0.97
    assert all(0 < got[i][1] <= 1 for i, *_ in rows[160:])
    assert got == run(spark, rows[:160], rows[160:])


def test_odd_rows(spark):
    rows = material(60)
    odd = [(1000, None, None, ""), (1001, "", "", ""), (1002, "12 __ ²!", "xx", ""), (1003, "KARUTO", None, ""), (1004, rows[0][1] * 3000, "", "")]
    got = run(spark, rows + [(None, "karu", "xx", ""), (70, None, "xx", ""), (71, "karu", None, ""), (0, rows[0][1], rows[0][2], "")], odd)
    assert [got[i][0] for i in (1000, 1001, 1002)] == ["und"] * 3
    assert got[1003][0] == "xx" and got[1004][0] == rows[0][2]
    assert run(spark, [], rows[:2]) == {0: ("und", 0.0), 1: ("und", 0.0)}
    assert run(spark, [(1, "abc", "only", "")], odd)[1003] == ("only", 1.0)
    assert run(spark, rows, []) == {}


def test_counts_do_not_depend_on_pieces(monkeypatch):
    text = " ".join(r[1] for r in material(30))
    whole = language.counts(text)
    clean = language.letters(text)
    assert whole[1].sum() == sum(len(clean) - n + 1 for n in range(1, 5))
    monkeypatch.setattr(language, "PIECE", 37)
    assert all((a == b).all() for a, b in zip(language.counts(text), whole))


def test_document_frequencies_cover_all_rows(spark):
    rows = material(50)
    df, total = language.document_frequencies(spark.createDataFrame(rows, DOCS).repartition(7))
    want = Counter(p for r in rows for p in language.counts(r[1])[0])
    assert total == 50 and {p: df[p] for p in np.flatnonzero(df)} == want


def test_query_covers_every_document(spark):
    out = QUERIES["op5_language"](spark, SF).collect()
    lang = {r["doc_id"]: r["lang"] for r in table(spark, SF, "documents").collect()}
    assert sorted(r["doc_id"] for r in out) == sorted(lang)
    assert np.mean([lang[r["doc_id"]] == r["lang_pred"] for r in out if r["held_out"]]) > 0.95
