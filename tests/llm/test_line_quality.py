"""Quality measures against a plain version, and the verdicts against labels."""

import random
import re

import pytest

from weftline.llm.line_quality import clean, kept_documents, line_quality
from weftline.sources import read_table

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    words = WORD.findall(text)
    grams = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    covered = {i + k for i, g in enumerate(grams) if grams.count(g) > 1 for k in range(8)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    failed = len(words) < 20 or 100 * len(covered) > 30 * len(words)
    return {
        "n_words": len(words),
        "word_chars": sum(map(len, words)),
        "n_symbols": sum(c in "#*$%&|<>" for c in text),
        "n_dup_lines": sum(x in lines[:i] for i, x in enumerate(lines)),
        "n_repeat_words": len(covered),
        "base_failed": failed,
        "kept": not failed and 2 * clean(text)[1] <= sum(map(len, words)),
    }


def texts(rng):
    pool = ["a", "b", "né", "漢字", "x|y", "###", "end.", "wow!!", "\t", "\x0b", " ", "|"]
    made = ["".join(rng.choice(pool) + rng.choice([" ", " ", "\n", ". "]) for _ in range(rng.randint(0, 120))) for _ in range(60)]
    return [*made, "", "\n\n", "one two three " * 20, "word " * 5000 + ".", " \r\n".join(f"Line {i} of prose here." for i in range(30))]


@pytest.mark.parametrize("seed", range(2))
def test_matches_plain_version(spark, seed):
    docs = list(enumerate(texts(random.Random(seed))))
    frame = spark.createDataFrame([*[(i, t, 0, "x") for i, t in docs], (-1, None, 1, None), (-1, None, 1, None)], "doc_id bigint, text string, kept int, `row` string")
    rows = line_quality(frame).select("row.doc_id", "quality.*").collect()
    assert len(rows) == len(docs) + 2
    expected = {**dict(docs), -1: ""}
    for r in rows:
        assert {k: r[k] for k in brute("")} == brute(expected[r.doc_id])


def test_lines():
    assert clean("Good line.\nHome | About | Help\nGood line.\nno ending\nOf!! Buy!! Now!!\nLicensed Under X.\n\nEnd?") == (1, 15 + 8 + 14 + 15, "Good line.\nGood line.\n\nEnd?")


def test_kept_documents(spark):
    prose = "\n".join(f"This is line number {i} of it." for i in range(9))
    frame = spark.createDataFrame([(1, prose + "\nA | B | C", "en", "s", 0), (2, "A | B | C\n" * 9, "en", "s", 0), (3, None, None, None, None)], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    kept = kept_documents(frame)
    assert kept.schema.names == frame.schema.names and [tuple(r) for r in kept.collect()] == [(1, prose, "en", "s", len(prose))]
    assert kept_documents(frame.limit(0)).collect() == []


def test_labels(spark):
    docs = line_quality(read_table(spark, "/root/testdata/sf0.01", "documents")).filter("NOT quality.base_failed")
    labels = read_table(spark, "/root/testdata/sf0.01", "labels")
    rows = docs.select("row.doc_id", "quality.kept").join(labels, "doc_id").collect()
    good, bad = [r.kept for r in rows if r.quality], [r.kept for r in rows if not r.quality]
    assert sum(good) >= 0.99 * len(good) and sum(bad) <= 0.05 * len(bad)


def test_prose_of_other_scripts_and_wrapped_lines_is_kept(spark):
    wrapped = "\n".join(["The keeper of the old lighthouse had seen many", "storms and few ships in the long winter when", "nobody came up the hill to ask him for"] * 1 + [f"the {w} lamp that burned above the grey water" for w in ("small", "green", "last", "only", "first", "other")] + ["and he did not mind."])
    texts = {
        "wrapped": wrapped,
        "hindi": "\n".join(f"यह नदी बहुत पुरानी है और गाँव {w} पास बहती है।" for w in ("के", "से", "का", "की")),
        "japanese": "\n".join(f"これは 長い 文章 です が 川 は 町 の {w} を 流れて います。" for w in ("北", "南", "東", "西")),
        "arabic": "\n".join(f"هل رأيت النهر القديم الذي يمر قرب {w} في الشتاء؟" for w in ("القرية", "المدينة", "الجبل", "البحر")),
        "quoted": "\n".join(f"«Das alte Haus am {w} steht leer, und niemand kommt.»" for w in ("Fluss", "Berg", "See", "Wald")),
        "menu": "Home\nProducts\nAbout us\nContact\nSign in\n" * 6,
        "titles": "\n".join(f"Ten Great Ways To Cook A Big {w}" for w in ("Fish", "Goose", "Cake", "Pie")),
    }
    rows = line_quality(spark.createDataFrame(list(texts.items()), "doc_id string, text string")).collect()
    # The other measures don't matter here: some lines repeat on purpose.
    lost = {r.row.doc_id: r.quality.lost_chars / r.quality.word_chars for r in rows}
    assert {k: x <= 0.1 for k, x in lost.items()} == {k: k not in ("menu", "titles") for k in texts} and lost["menu"] == lost["titles"] == 1
    # A wrapped line that a heading follows has no ending.
    assert clean("one two three four five six\nHeading Here.")[1] == 22 and clean("one two three four five six\nseven.")[1] == 0
