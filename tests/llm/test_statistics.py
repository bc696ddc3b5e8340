import random

import pyarrow as pa
import pytest

from paperloom.llm import catalog
from paperloom.llm.language_id import Grams, fit, identify, identify_all, named, paragraphs
from paperloom.llm.text_stats import classify, judged

from .conftest import SENTENCES, prose, wrapped

QUERIES = catalog.queries()
ITEMS = ["the old page labels", "Quilpim A18", "the crop box of page 4", "the parser;", "every object stream"]
KINDS = {
    "prose": [wrapped(prose(lang, 3)) for lang in SENTENCES] + ["The parser reads no more than page\n4. The rest waits here.", "The page renderer keeps the hid¬", "One sentence only.", prose("en", 1) + "\n\n- one\n- two", "A HEADING OF THE TEXT\n\n" + wrapped(prose("en", 2))],
    "list": ["\n".join(f"- {i}" for i in ITEMS * 3), "\n".join(f"{k}. {i}" for k, i in enumerate(ITEMS * 3, 1)), "\n".join(f"{i} ........ {k}" for k, i in enumerate(ITEMS * 2, 3)), "\n".join(ITEMS * 3), "The parser keeps:\n" + "\n".join(f"a) {i}" for i in ITEMS * 3)],
    "table": ["a,b,c\n" + "\n".join(f"{i},{i * 3.5:.2f},n/a" for i in range(9)), "x\ty\n" + "\n".join(f"{i}\t\t{i}%" for i in range(9)), "w | v\n" + "\n".join(f"the | {i}" for i in range(9)), "a  b   c\n" + "\n".join(f"word {i}.5   2025-01-0{i}" for i in range(1, 9))],
    "junk": ["(cid:12)(cid:3)\n(cid:99)(cid:1)", "=====\n*~*~*~*\n_ _ _ _", "120 53 l\n411 535 l\n363 359 re f\n223 1 cm", "obj obj obj obj obj obj obj\nobj obj obj", "w q d w f j c 9 ? r s !\no n 7 ? g u t 5", "bddppnfkh zzjwsnmh ngggdw\nzxwvct hntfv gxpgt", "3xKCMHsFd5PRSPuRrwSYghGl/iQ0zoTGrdmadXe==\na81e2272aa9345a458579fa9a56ebd035a3ea69fa1"],
}


@pytest.mark.parametrize(("kind", "text"), [(k, t) for k, ts in KINDS.items() for t in ts])
def test_kinds(kind, text):
    assert classify(pa.array([text])) == [kind]


def test_texts_do_not_touch_each_other():
    texts = [t for ts in KINDS.values() for t in ts] + [None, "", " \n\t"]
    assert classify(pa.array(texts)) == [classify(pa.array([t], pa.string()))[0] for t in texts]
    assert classify(pa.array([], pa.string())) == [] and classify(pa.array([None], pa.string())) == [None]


def test_rules_tell_their_names():
    got = judged(pa.array([prose("en", 1, 20), "# # # # …", None, "a b"]), {"the", "a"})[1].to_pylist()
    assert got[0] == [] and {"few_words", "short_words", "symbols", "not_alphabetic", "few_common_words"} <= set(got[1]) and got[2] == [] and "short_words" in got[3]


def test_class_comes_from_the_failed_rules():
    rng = random.Random(2)
    letters = "\n".join(" ".join("".join(rng.choice("aeioubcdfglmnprstz") for _ in range(rng.randint(4, 8))) for _ in range(6)) for _ in range(8))
    texts = ["token " * 60 + "5", "5 " + "token " * 60, letters, prose("en", 1, 20), "\n".join(f"- {i}" for i in ITEMS * 3), "1 2 3\n4 5 6"]
    kinds, failed = judged(pa.array(texts), {"the", "a", "of", "after"})
    assert kinds == ["junk", "junk", "junk", "prose", "list", "table"] == classify(pa.array(texts), {"the", "a", "of", "after"})
    reasons = [set(f) for f in failed.to_pylist()]
    assert "one_word" in reasons[0] & reasons[1] and "no_common_words" in reasons[2] and not reasons[3] and "mostly_items" in reasons[4] and "mostly_rows" in reasons[5]
    # without common words, nothing is judged by them
    assert classify(pa.array([letters])) == ["list"]


def test_statistics_of_results(tables, spark):
    tables.results([(1, "The page reads.\n- the x!\n\n", "en"), (1, "The page reads.\n- the x!\n\n", "en"), (2, None, None), (3, " \n", "en"), (4, "1 2", "en")], extra=True)
    rows = {r.result_id: r for r in QUERIES["p2_stats"](spark, tables.folder).where("result_id < 10").collect()}
    assert set(rows) == {1, 4}
    assert (rows[1].word_count, rows[1].mean_word_length, rows[1].ended_lines, rows[1].common_share) == (6, 19 / 6, 1.0, 0.4)
    assert rows[1].symbol_ratio == 3 / 19 and rows[4].common_share == 0.0
    assert QUERIES["p2_found"](spark, tables.folder).where("result_id < 10").collect()[0].text_class == "table"


@pytest.mark.parametrize(("label", "code"), [("EN", "en"), ("en-US", "en"), ("en_GB", "en"), ("ger", "de"), ("Portuguese", "pt"), ("pt-BR", "pt"), (" ", None), ("und", None), ("n/a", None), (None, None), ("-", None), ("xx", None), ("unknown", None)])
def test_labels(label, code):
    assert named(label) == code


def test_held_out_accuracy():
    train = [(prose(lang, i, 3), lang) for lang in SENTENCES for i in range(30)]
    train += [(prose("de", i + 500, 3), "en") for i in range(6)]  # wrong labels
    model = fit(train)
    held = [(prose(lang, i + 1000, 1), lang) for lang in SENTENCES for i in range(20)]
    assert sum(identify(model, t)[0] == lang for t, lang in held) >= 0.98 * len(held)
    assert identify(model, "12345 ---")[0] is None and identify(model, "")[0] is None
    lang, confidence, parts = identify(model, f"{prose('de', 1)}\n \n{prose('fr', 1)}\n\n{prose('de', 2)}\n\n7")
    assert lang == "de" and [p[0] for p in parts] == ["de", "fr", "de", "de"] and 0 < confidence <= 1


@pytest.mark.parametrize(
    ("main", "short", "lang"),
    [("en", "본문 추출기는 여러 잘못된 참조를 닫는다.", "ko"), ("es", "글꼴 저장소가 앞 문단을 읽는다", "ko"), ("de", "Он читает файл.", "ru"), ("de", "It reads the page.", "en"), ("ru", "The page.", "en"),
     ("de", "7쪽", "de"), ("de", "Page 3 of 9", "de"), ("en", "стр. 5", "en"), ("de", "– 81 –", "de"), ("en", "Notes on Files", "en")],
)
def test_short_paragraphs(main, short, lang):
    model = fit([(prose(code, i), code) for code in SENTENCES for i in range(40)])
    found, _, parts = identify(model, f"{prose(main, 900)}\n\n{short}\n\n{prose(main, 901)}")
    assert found == main and [p[0] for p in parts] == [main, lang, main]


def test_fit_of_nothing():
    assert identify(fit([]), "The page.")[0] is None


def test_grams_do_not_cross_parts():
    texts = ["ab ab", "", " -- 7", "Ab\tc.", "é", "x", "\U0001d41aa b"]
    together = Grams.of(texts)
    for k, text in enumerate(texts):
        alone, own = Grams.of([text]), together.part == k
        assert alone.key.tolist() == together.key[own].tolist() and alone.weight.tolist() == together.weight[own].tolist() and alone.letters[0] == together.letters[k]
    assert (Grams.of(["ab ab"]).weight > 1).any() and not len(Grams.of([""]).key) and not len(Grams.of([]).key)
    # two letters between spaces: 3 single characters, 3 pairs, 2 triples, 1 of four, the space twice
    assert len(Grams.of(["ab"]).key) == 9 and together.letters.tolist() == [4, 0, 0, 3, 1, 1, 3]


def test_paragraphs():
    assert paragraphs("a\r\n\r\nb\n \nc\n\n\n") == ["a", "b", "c"] and paragraphs("") == []


def test_languages_not_known_are_rejected():
    model = fit([(prose(lang, i, 3), lang) for lang in ("en", "de", "fr", "es") for i in range(60)])
    for text in ("Dokument zawiera opis głównych funkcji wraz z przykładami użycia.", "Dokumentet innehåller en fullständig beskrivning av modulen.", "이 문서는 모듈을 설명한다."):
        assert identify(model, text)[0] is None
    held = [(prose(lang, i + 900, 1), lang) for lang in ("en", "de", "fr", "es") for i in range(30)]
    assert sum(row[0] == lang for row, (_, lang) in zip(identify_all(model, [t for t, _ in held]), held)) >= 0.97 * len(held)


def test_rare_languages_are_sampled(tables, spark):
    from paperloom.llm import language_queries

    tables.results([(k, prose("en", k), "en") for k in range(400)] + [(1000 + k, prose("ru", k), "Russian") for k in range(7)] + [(2000, "x", "n/a"), (2001, None, "ru"), (2002, " ", "ru")])
    sample = language_queries.labelled_sample(spark.read.parquet(f"{tables.folder}/batch_results.parquet").where("result_id < 10000"))
    counts = {lang: sum(code == lang for _, code in sample) for lang in ("en", "ru")}
    assert counts["ru"] == len({prose("ru", k) for k in range(7)}) and 100 < counts["en"] <= language_queries.SAMPLE_ROWS and len(set(sample)) == len(sample)


def test_languages_of_results(tables, spark):
    mixed = f"{prose('de', 1)}\n\n{prose('fr', 1)}"
    rows = [(1, prose("es", 1), "English"), (2, prose("es", 2), "es-MX"), (3, prose("ko", 1), None), (4, mixed, "de"), (5, None, "en"), (6, "\n".join(ITEMS * 3), "de"), (7, "", "fr"), (1, prose("es", 1), "English")]
    tables.results(rows, extra=True)
    found = sorted((r.result_id, r.seg_no, r.lang) for r in QUERIES["p4_found"](spark, tables.folder).where("result_id < 10").collect())
    assert [x for x in found if x[0] != 4] == [(1, 0, "es"), (3, 0, "ko")]
    assert (4, 1, "de") in found and (4, 2, "fr") in found
    assert QUERIES["p4_languages"](spark, tables.folder).where("result_id = 2 and lang = 'es'").count() == 1


def test_all_labelled_texts_are_fitted(tables, spark):
    import numpy as np

    from paperloom.llm import language_id, language_queries
    from paperloom.llm.records import vocabulary_of
    from paperloom.llm.stats_queries import common_words

    # German texts of which the sample has one kind only: the others have hashes that it does not take
    other = ["Zwölf Boxkämpfer jagen Viktor quer über den großen Sylter Deich.", "Schöne Ärzte üben wöchentlich gemütliche Volksmusik.", "Falsches Üben von Xylophonmusik quält jeden größeren Zwerg."]
    rng = random.Random(3)
    kinds = [{prose("de", k, 7) for k in range(450)}, {" ".join(rng.choice(other) for _ in range(7)) for _ in range(1200)}]
    hashes = spark.createDataFrame([(t,) for t in sorted(kinds[1])], "t string").selectExpr("t", "pmod(xxhash64(t, 'de'), 1 << 30) / (1 << 30) h").collect()
    far = [r.t for r in hashes if r.h > 0.7]
    tables.results([(k, t, "de") for k, t in enumerate([*kinds[0], *far])])
    vocabulary, common = vocabulary_of(spark, tables.folder), common_words(spark, tables.folder)
    prose_ = language_queries._prose(spark, tables.folder, vocabulary, common)
    sample = language_queries.labelled_sample(language_queries._labelled(prose_))
    assert len(far) > 100 and not {t for t, _ in sample} & set(far)
    # all labelled texts together have the frequencies and means that tell
    texts = [language_queries._unpacked(pa.record_batch({"text": pa.array([r.text], pa.binary())}))[0] for r in prose_.collect()]
    assert len(set(texts) & set(far)) == len(far)
    model, of_sample = language_queries.fitted(prose_), fit(sample)
    german = language_id.LANGUAGES.index("de")
    near = [m.scores(far)[0][:, german] for m in (of_sample, model)]
    assert near[1].min() > 0.5 > near[0].max() + 0.1
    counts = language_queries._summed(prose_.where("langs > 0"), len(language_id.LANGUAGES), language_id.frequencies)
    grams = Grams.of([t for t in texts if t in set(far) | kinds[0]])
    assert (counts[german] >= np.bincount(grams.key, minlength=language_id.SIZE)).all()


def test_parts_of_labelled_texts_add_up():
    import numpy as np

    from paperloom.llm.language_id import LANGUAGES, SIZE, frequencies, held_pieces, moved, sums

    rows = [(prose(lang, k, 3), lang) for lang in SENTENCES for k in range(20)]
    rows += [(prose("de", 900 + k), "en") for k in range(3)]  # wrong labels
    texts, masks = [t for t, _ in rows], np.array([1 << LANGUAGES.index(lang) for _, lang in rows])
    model = fit(rows)
    for work in (frequencies, lambda t, m: sums(model, t, m)):
        assert (work(texts, masks) == work(texts[:50], masks[:50]) + work(texts[50:], masks[50:])).all()
    assert frequencies(texts, masks).shape == (len(LANGUAGES), SIZE) and frequencies(texts, masks)[LANGUAGES.index("nl")].sum() == 0
    # texts of wrong labels move nothing and have no pieces that count
    total = sums(model, texts, masks)
    assert (total == sums(model, texts[:-3], masks[:-3])).all() and not len(held_pieces(model, texts[-3:], masks[-3:])[0])
    centers = moved(model, total).centers
    assert np.allclose(np.linalg.norm(centers, axis=0), 1, atol=1e-3) and (moved(model, total * 0).centers == model.centers).all()
    # a text of two labels counts for the one it is nearest to
    both = masks | 1 << LANGUAGES.index("nl")
    assert (sums(model, texts, both) == total).all()
