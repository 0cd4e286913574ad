"""The pipeline over a small corpus, against what plain versions of its stages leave."""

import random

import corpus_pipeline
from test_best_fit import check
from test_line_quality import brute as quality
from test_prob_minhash import brute_classes

from weftline.llm.line_quality import clean


def corpus(rng):
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    line = lambda n: " ".join(word() for _ in range(n)) + "."
    prose = lambda n: "\n".join(line(12) for _ in range(n))
    passage, base = "\n".join(line(14) for _ in range(5)), prose(10)
    docs = [prose(rng.randint(3, 12)) for _ in range(12)]
    docs += [f"{prose(4)}\n{passage}\n{prose(4)}" for _ in range(6)]
    docs += [base, base, base.replace(base.split()[30], "changed"), base + "\n" + "Home | About | Help"]
    docs += ["A | B | C\n" * 30, "too short.", None, "", line(60) + "\n" + "x y z " * 30, "long. " + prose(900)]
    return list(enumerate(docs)), passage


def test_whole_pipeline(spark, tmp_path):
    docs, passage = corpus(random.Random(3))
    frame = spark.createDataFrame([(i, t, "en", None, len(t or "")) for i, t in docs], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    frame.write.parquet(str(tmp_path / "documents.parquet"))
    # Plain versions: rules, then classes of all pairs, then the passage is known to lie in six documents.
    left = {i: clean(t or "")[2] for i, t in docs if quality(t or "")["kept"]}
    assert set(left) == {i for i, t in docs if t and i not in (22, 23, 24, 25, 26)}
    classes = brute_classes(list(left.items()), 0.8)
    left = {i: t for i, t in left.items() if classes[i] == i}
    assert 18 in left and not {19, 20, 21} & set(left)
    holders = [i for i in left if passage in left[i]]
    assert holders == [12, 13, 14, 15, 16, 17]
    for i in holders[1:]:
        left[i] = left[i].replace(passage + "\n", "")
    check(corpus_pipeline.run(spark, str(tmp_path)).collect(), left)


def test_stages_keep_the_columns_and_take_empty_tables(spark):
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint"
    docs = spark.createDataFrame([], schema)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, "")
        assert docs.schema.simpleString() == spark.createDataFrame([], schema).schema.simpleString()
    assert corpus_pipeline.STAGES[-1][1](spark, docs, "").collect() == []


def test_one_of_repeated_rows_stays(spark):
    text = " ".join(f"w{i}" for i in range(30))
    rows = [(1, text), (1, text), (2, text), (None, text), (None, text), (3, "a b")]
    kept = corpus_pipeline.near_dedup(spark, spark.createDataFrame([(*r, 1) for r in rows], "doc_id bigint, text string, rank int"), "")
    assert sorted((r.doc_id or 0, r.rank) for r in kept.collect()) == [(0, 1), (0, 1), (1, 1), (3, 1)]


def test_texts_that_share_a_doc_id_are_judged_one_by_one(spark):
    x, y, z = (" ".join(f"{c}{i}" for i in range(40)) for c in "xyz")
    rows = [(2, x), (5, x), (5, y), (5, y), (5, z), (6, z), (7, None), (7, None), (7, "  ")]
    kept = corpus_pipeline.near_dedup(spark, spark.createDataFrame(rows, "doc_id bigint, text string"), "")
    assert sorted((r.doc_id, r.text or "") for r in kept.collect()) == [(2, x), (5, y), (5, z), (7, ""), (7, "  ")]
