import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tideline.llm import langid
from tideline.llm.catalog import op3_language_id

from .conftest import SF, nasty_texts


def plain_viterbi(scores, penalty):
    value, back = scores[0].astype(float), []
    for s in scores[1:]:
        moves = value[:, None] - penalty * (1 - np.eye(len(value)))
        back.append(moves.argmax(0))
        value = moves.max(0) + s
    best, path = value.max(), [int(value.argmax())]
    for b in reversed(back):
        path.append(int(b[path[-1]]))
    return best, path[::-1]


def value_of(scores, path, penalty):
    return scores[np.arange(len(path)), path].sum() - penalty * np.count_nonzero(np.diff(path))


def test_decoding_is_optimal():
    rng = np.random.default_rng(1)
    lengths = [0, 1, 2, 30, 0, 7, 55, 3]
    for penalty in (0.5, 3.0, 6.0):
        scores = -rng.gamma(1.0, 2.0, (sum(lengths), 3))
        bounds = np.concatenate([[0], np.cumsum(lengths)])
        path = langid.decode(scores, bounds, penalty)
        for s, e in zip(bounds[:-1], bounds[1:]):
            if e > s:
                best, _ = plain_viterbi(scores[s:e], penalty)
                assert value_of(scores[s:e], path[s:e].astype(int), penalty) == pytest.approx(best)


def test_a_third_language_is_no_compromise():
    """Both halves leave the best single language for less than the penalty each, and together for more."""
    scores = np.array([[-5.0, 0.0, -12.0], [-5.0, -12.0, 0.0]])
    assert langid.decode(scores, np.array([0, 2]), 6.0).tolist() == [1, 2]
    assert value_of(scores, [1, 2], 6.0) > value_of(scores, [0, 0], 6.0)


LATIN = {"aa": "banana tamara kalamata baraka", "bb": "skrift stykke hvordan sproget", "cc": "привет дорога человек слово"}


@pytest.fixture(scope="module")
def model(spark):
    rng = random.Random(3)
    rows = [(" ".join(rng.choices(t.split(), k=40)), lang) for lang, t in LATIN.items() for _ in range(5)]
    rows += [(None, "aa"), ("text", None), ("", "bb"), ("123", "cc")]
    return langid.train(spark.createDataFrame(rows, "text string, lang string"))


def test_spans_and_scripts(spark, model):
    mixed = " ".join([LATIN["aa"]] * 4 + [LATIN["bb"]] * 6 + [LATIN["cc"]] * 3)
    texts = [mixed, LATIN["cc"], "漢字 仮名", "12 --", None, "", LATIN["bb"] + " 漢字"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("lang", F.lit("zz"))
    got = {r.doc_id: r for r in langid.identify(docs, model).collect()}
    assert [(s.first_word, s.n_words, s.lang) for s in got[0].spans] == [(0, 16, "aa"), (16, 24, "bb"), (40, 12, "cc")]
    assert [got[i].lang_pred for i in range(7)] == ["bb", "cc", "und", "und", "und", "und", "bb"]
    assert all(got[i].score == 0 and not got[i].spans for i in (2, 3, 4, 5)) and got[1].score > 0.9


def test_nasty_rows_and_nothing_learned(spark, model, nasty, nothing):
    got = langid.identify(nasty, model).toPandas()
    assert len(got) == len(nasty_texts()) and got["score"].between(0, 1).all()
    wide = langid.annotate(nasty, model)
    assert wide.columns == [*nasty.columns, "__lang", "__score"] and wide.count() == len(got)
    empty = langid.train(nothing)
    assert {r.lang_pred for r in langid.identify(nasty, empty).collect()} == {"und"}
    assert langid.identify(nothing, model).count() == 0


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang")
    got = op3_language_id(spark, SF).join(docs, "doc_id").where("held_out").toPandas()
    assert (got["lang_pred"] == got["lang"]).mean() > 0.95
