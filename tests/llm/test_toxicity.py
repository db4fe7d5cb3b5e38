import random

import numpy as np
from conftest import SF

from tickloom.llm import toxicity
from tickloom.llm.common import table
from tickloom.llm.queries import QUERIES

DOCS = "doc_id long, text string, score string, toxic string"
LABELS = "doc_id long, quality int, toxic int"


def material(n=400):
    rnd = random.Random(4)
    syllables = ["tha", "rin", "ed", "on", "est", "ing", "mor", "la"]
    def word():
        return "".join(rnd.choices(syllables, k=rnd.randint(1, 3)))
    docs, labels = [], []
    for i in range(n):
        words = [word() for _ in range(rnd.randint(30, 200))]
        if i % 4 == 0:
            for _ in range(6):
                words.insert(rnd.randint(0, len(words)), rnd.choice(["vilegrump", "zukkwort", "brazzook"]))
        docs.append((i, " ".join(words).capitalize() + ".", "s", "t"))
        if i % 2 == 0:
            labels.append((i, 0, int(i % 4 == 0)))
    return docs, labels


def run(spark, docs, labels):
    d = spark.createDataFrame(docs, DOCS)
    return toxicity.scored(d, toxicity.fitted(d, spark.createDataFrame(labels, LABELS)), "score").collect()


def test_unlabelled_toxic_documents_are_found(spark):
    docs, labels = material()
    labels = [x for x in labels if x[0] < 300]
    out = {r["doc_id"]: r["score"] for r in run(spark, docs, labels)}
    late = [i for i in range(300, 400)]
    assert np.mean([out[i] >= 0.3 for i in late if i % 4 == 0]) >= 0.9
    assert np.mean([out[i] >= 0.3 for i in late if i % 4]) <= 0.05
    assert run(spark, docs, labels) == run(spark, docs, labels)


def test_odd_rows(spark):
    docs, labels = material(120)
    docs += [(500, None, None, None), (501, "", "", ""), (502, "... 12 !", "", ""), (None, "tha rin", "", ""), (0, docs[0][1], "", "")]
    docs += [(503, docs[1][1] * 400, "", "")]
    labels += [(None, 0, 1), (1, 0, None), (0, 0, 0), (9999, 0, 1)]
    out = run(spark, docs, labels)
    assert len(out) == len(docs) and all(0 <= r["score"] <= 1 for r in out)
    by = {r["doc_id"]: r["score"] for r in out}
    assert by[500] == by[501] == by[502] < 0.3
    assert by[503] < 0.3


def test_no_labels_or_one_class(spark):
    docs, _ = material(8)
    assert {r["score"] for r in run(spark, docs, [])} == {0.0}
    assert {r["score"] for r in run(spark, docs, [(0, 0, 1)])} == {1.0}
    assert {r["score"] for r in run(spark, docs, [(1, 0, 0), (99, 0, 1)])} == {0.5}
    assert run(spark, [], [(0, 0, 1), (1, 0, 0)]) == []


def test_windows_hold_every_letter():
    text = "Ab, cd! 12 " + "x" * 90 + " ünï"
    assert b"".join(toxicity.windows(text)).replace(b" ", b"").decode() == "abcd" + "x" * 90 + "ünï"


def test_query_covers_every_document(spark):
    out = QUERIES["op1_toxicity"](spark, SF)
    assert [f.simpleString() for f in out.schema] == ["doc_id:bigint", "held_out:boolean", "score:double", "predicted:int"]
    assert sorted(r["doc_id"] for r in out.collect()) == sorted(r["doc_id"] for r in table(spark, SF, "documents").collect())


def test_copies_do_not_make_words_telling():
    rnd = random.Random(2)
    word = lambda: "".join(rnd.choices("abcdefgh", k=7))
    copied = [word() for _ in range(60)]
    toxic = [toxicity.windows(" ".join([word() for _ in range(60)] + ["vilegrump", word(), "vilegrump"])) for _ in range(60)] + [toxicity.windows(" ".join(copied))] * 30
    ordinary = [toxicity.windows(" ".join(word() for _ in range(60))) for _ in range(60)]
    special, base = toxicity.dictionaries(toxic, ordinary)
    assert b"vilegru" in special and not any(w.encode() in special[: -len(base)] for w in copied)
