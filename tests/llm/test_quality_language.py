import random

import duckdb
import pandas as pd
import pytest

from allelix.llm import language_id, quality

COLUMNS = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]


def both(spark, docs):
    rows = docs.toPandas()
    con = duckdb.connect()
    con.register("frame", pd.DataFrame({c: rows[c] for c in ("doc_id", "text", "lang", "source")}))
    con.execute("CREATE VIEW documents AS SELECT CAST(doc_id AS BIGINT) AS doc_id, CAST(text AS VARCHAR) AS text, CAST(lang AS VARCHAR) AS lang, CAST(source AS VARCHAR) AS source FROM frame")
    want = con.sql(f"SELECT {', '.join(COLUMNS)} FROM ({quality.ORACLE_SQL})").fetchall()
    got = [tuple(r) for r in quality.quality_rules(docs).select(*COLUMNS).collect()]
    key = lambda r: tuple((x is None, x or 0) for x in r)
    return sorted(got, key=key), sorted(want, key=key)


def corpus(n=120):
    rnd = random.Random(2)
    texts = [" ".join(f"wo{rnd.randint(0, 999)}" for _ in range(rnd.randint(60, 120))) for _ in range(n)]
    return texts + [" ".join(f"{w}###" for w in texts[0].split()), "\n".join(["the same line of words here again"] * 20)]


def test_figures_and_verdicts_are_those_of_sql(spark, make, odd_texts):
    texts = odd_texts + corpus()
    got, want = both(spark, make(texts, [None, 1, 1, *range(5, 2 + len(texts))], ["en", None, "fr"] * len(texts)))
    assert got == want


def test_outliers_go_and_clean_texts_stay(make):
    texts = corpus()
    kept = {r.doc_id: r.kept for r in quality.quality_rules(make(texts)).collect()}
    assert not kept[120] and not kept[121]
    assert sum(kept[i] for i in range(120)) >= 118


def test_windows_beyond_the_positions_are_compared_as_strings(make, odd_texts, monkeypatch):
    docs = make(odd_texts)
    want = sorted(r.n_repeat_words for r in quality.quality_rules(docs).collect())
    monkeypatch.setattr(quality, "_POSITION_BITS", 4)
    assert sorted(r.n_repeat_words for r in quality.quality_rules(docs).collect()) == want


def test_empty_tables_and_columns(make):
    assert quality.quality_rules(make([])).collect() == []
    assert quality.keep_good(make([])).collect() == []
    docs = make(corpus())
    assert quality.keep_good(docs).columns == docs.columns


@pytest.fixture(scope="module")
def tongues():
    rnd = random.Random(4)
    sets = {"xx": "bado kuli mena rosi tupa".split(), "yy": "sträng björk fjöll häst grön".split(), "zz": "quez llano ciñe ranco ojal".split()}

    def word(lang):
        return rnd.choice(sets[lang])[:3] + rnd.choice(sets[lang])[2:]

    texts, langs = [], []
    for i in range(150):
        lang = list(sets)[i % 3]
        texts.append(" ".join(word(lang) for _ in range(40)))
        langs.append(lang)
    mixed = " ".join([word("xx") for _ in range(60)] + [word("yy") for _ in range(30)])
    return texts, langs, mixed


def test_languages_and_mixtures(make, tongues):
    texts, langs, mixed = tongues
    extra = [None, "", "12 34 --", mixed, texts[0], texts[0]]
    docs = make(texts + extra, [*range(len(texts)), None, 900, 901, 902, 903, 903], langs + [None, "xx", "yy", None, "xx", "xx"])
    model = language_id.fit(docs)
    assert model.languages == ["xx", "yy", "zz"]
    rows = language_id.predict(docs.select("doc_id", "text"), model).collect()
    found = {r.doc.doc_id: r for r in rows}
    assert len(rows) == len(texts) + 6
    held = [i for i in range(len(texts)) if language_id.is_held_out(i)]
    assert held and sum(found[i].lang_pred == langs[i] for i in held) / len(held) > 0.95
    assert all(found[i].lang_pred == "und" and found[i].score == 0 for i in (None, 900, 901))
    assert found[902].lang_pred == "xx" and set(found[902].languages) == {"xx", "yy"} and 0.55 < found[902].score < 0.8
    assert found[1].languages == [langs[1]] and 0 <= found[1].score <= 1


def test_no_labels_and_no_rows(make, spark):
    docs = make(["abc def", None], langs=[None, None])
    assert {r.lang_pred for r in language_id.predict(docs, language_id.fit(docs)).collect()} == {"und"}
    empty = make([])
    assert language_id.predict(empty, language_id.fit(empty)).collect() == []
    assert language_id.keep_known(docs).columns == docs.columns


def test_unlabelled_documents_stay(make):
    docs = make(["some words here", None, "", "123"], langs=[None] * 4)
    assert language_id.keep_known(docs).count() == 4
    assert language_id.keep_known(make([])).count() == 0


def test_many_languages_get_fewer_slots():
    sizes = [language_id.slot_count(n) for n in (0, 1, 42, 500, 50_000)]
    assert sizes == sorted(sizes, reverse=True) and sizes[0] == language_id.SLOTS
    assert all(language_id.slot_count(n) * n * 12 <= language_id.MODEL_BYTES for n in (1, 42, 500, 50_000))
