import unicodedata

import pytest
from pyspark.sql import functions as F

from paperloom.llm import catalog
from paperloom.llm.character_forms import Forms, script
from paperloom.llm.encoding_repair import Repairer, clean_vocabulary, utf8_lattice
from paperloom.llm.vocabulary import Vocabulary, capitalised, frequent_words, pieces, word_counts

from .conftest import SENTENCES, prose, wrapped

QUERIES = catalog.queries()


def damaged(text, wrong, right="utf-8", times=1):
    for _ in range(times):
        text = "".join(bytes([b]).decode(wrong, "ignore") or chr(b) for b in text.encode(right, "ignore"))
    return text


@pytest.mark.parametrize(
    ("lang", "wrong", "right", "times"),
    [("de", "cp1252", "utf-8", 1), ("fr", "latin-1", "utf-8", 1), ("es", "cp1252", "utf-8", 2), ("fr", "mac_roman", "utf-8", 1), ("ru", "cp1252", "utf-8", 1), ("ru", "cp1251", "utf-8", 1), ("ko", "latin-1", "utf-8", 1),
     ("ko", "latin-1", "cp949", 1), ("ru", "latin-1", "cp1251", 1), ("ru", "koi8_r", "cp1251", 1), ("ru", "cp1251", "koi8_r", 1), ("ru", "cp1251", "cp866", 1), ("de", "mac_roman", "latin-1", 1), ("es", "cp1252", "cp850", 1)],
)
def test_restores_what_was_wrongly_decoded(vocabulary, lang, wrong, right, times):
    repairer = Repairer(vocabulary)
    text = " ".join(SENTENCES[lang]).replace("’", "'")
    broken = damaged(text, wrong, right, times)
    assert broken != text
    damage = repairer.damage(broken)
    assert damage
    same = sum(a == b for a, b in zip(repairer.restore(broken, damage).split(" "), text.split(" ")))
    assert same >= 0.85 * len(text.split(" "))


def test_lost_bytes_are_filled_from_the_vocabulary(vocabulary):
    repairer = Repairer(vocabulary)
    assert repairer.verdict("Pr�fung.")[0] == "Prüfung."
    lost = "".join(c for c in damaged("родительское", "latin-1") if not "\x80" <= c <= "\x9f")
    assert repairer.verdict(lost)[0] == "родительское"
    assert repairer.damage("L?ouverture du fichier le cadre vide perd l?ouverture") == {"L?ouverture": "L’ouverture", "l?ouverture": "l’ouverture"}


@pytest.mark.parametrize(("word", "lang_wrong", "right"), [("родительское", "cp1252", "cp1251"), ("родительское", "cp1251", "koi8_r"), ("сохраняет", "cp1252", "cp866"), ("추출기는", "latin-1", "cp949"), ("Prüfung", "cp1252", "cp850"), ("родительское", "latin-1", "utf-8")])
def test_lost_bytes_of_all_encodings(vocabulary, word, lang_wrong, right):
    repairer = Repairer(vocabulary)
    broken = damaged(word, lang_wrong, right)
    assert broken != word
    for i in range(len(broken)):
        if broken[i] > "\x7f" and repairer.verdict(broken[:i] + "�" + broken[i + 1 :])[0] == word:
            break
    else:
        raise AssertionError(broken)


def test_a_byte_that_became_a_space():
    words = Vocabulary({"il": 90, "est": 80, "voilà": 20, "la": 90, "maison": 30, "à": 50}, 500)
    repairer = Repairer(words)
    for text in ("il est voilÃ  la maison", "il est voilÃ\xa0 la maison"):
        assert repairer.restore(text, repairer.damage(text)) == "il est voilà la maison"
    text = "il est voilÃ la maison"
    assert repairer.restore(text, repairer.damage(text)) == "il est voilà la maison"
    assert repairer.damage("la maison  IRMÃ  il est") == {}


def test_search_is_exact():
    # many words fit the first lost letters; only the last letter tells which
    first = [a + b for a in "àâäáãåæ" for b in "èêëéęėē"]
    words = Vocabulary({f"{s}xyé": 50 for s in first} | {"ÿÿxyz".lower(): 3}, 5000)
    assert Repairer(words).verdict("��xyz")[0] == "ÿÿxyz"


@pytest.mark.parametrize("lang", SENTENCES)
def test_sound_text_has_no_damage(vocabulary, lang):
    assert Repairer(vocabulary).damage(prose(lang, 9)) == {}


@pytest.mark.parametrize("text", ["The log shows “Ã©” where the page reads “é”.", 'The hidden layer keeps "â€™" in the list.', "Â§©¶ ¤¦¬ ½¾ÃÂ", "", "a?b", "Why? The page."])
def test_mentions_symbols_and_questions_are_no_damage(vocabulary, text):
    assert Repairer(vocabulary).damage(text) == {}


def test_lattice_has_wildcards_for_lost_bytes():
    steps, whole, broken = utf8_lattice("é".encode() + b"\xd0x" + b"\xe2\x82")
    assert (whole, broken) == (1, 2) and steps[0][0] == "é" and steps[1] == ("", 0x400, 0x43F) and steps[2][0] == "x" and steps[3] == ("", 0x2080, 0x20BF)


def test_vocabulary_is_cleared_of_damaged_words():
    v = clean_vocabulary(Vocabulary({"für": 90, "fã¼r": 5, "fãƒâ¼r": 4, "début": 40, "but": 50, "d": 60}, 300), {"fã¼r": "fÃ¼r", "fãƒâ¼r": "fÃƒÂ¼r"})
    assert set(v.counts) == {"für", "début", "but", "d"}


def test_pieces():
    assert pieces("“l’entrée-X”,") == ["l", "entrée", "x"] and pieces("fÃ©r.") == [] and pieces("12") == [] and pieces("") == []


def test_word_counts_cover_all_rows(spark):
    rows = spark.createDataFrame([("a b a",), (None,), ("",), ("b\nb\tc",)], "word string")
    assert {r["word"]: r["n"] for r in word_counts(rows, "word").collect()} == {"a": 2, "b": 3, "c": 1, "": 6}
    v, forms = frequent_words(word_counts(rows, "word"))
    assert v.counts == {"b": 3} and v.total == 6 and forms == {}


def test_small_languages_keep_their_words(spark):
    text = "".join(f"{w} " * n for w, n in (("alpha", 3), ("beta", 5), ("once", 1)))
    alone = spark.createDataFrame([(text, "nl")], "text string, lang string")
    large = spark.createDataFrame([("the page " * 500_000, "en")], "text string, lang string")
    small, mixed = (frequent_words(word_counts(t, "text", F.col("lang")))[0] for t in (alone, alone.union(large)))
    assert set(small.counts) == {"alpha", "beta"} and set(mixed.counts) == {"alpha", "beta", "the", "page"}
    assert all(mixed.cost[w] == small.cost[w] for w in small.counts)
    assert mixed.without({"beta"}).cost == {w: c for w, c in mixed.cost.items() if w != "beta"}


def test_broken_words_are_no_words(spark):
    rows = spark.createDataFrame([("é-\nlan élan Élan ÉLAN\nvo¬\ntre",)], "word string")
    assert {r["word"]: (r["n"], capitalised(r["word"], r["capitals"])) for r in word_counts(rows, "word").collect()} == {"élan": (3, "ÉLAN"), "": (3, "")}


def test_no_words(spark):
    rows = spark.createDataFrame([("a b a",)], "word string")
    assert frequent_words(word_counts(rows.limit(0), "word"))[0].counts == {} and frequent_words(word_counts(rows, "word"))[0].counts == {}


@pytest.mark.parametrize(
    ("text", "plain"),
    [("Ｔｈｅ　ｐａｇｅ", "The page"), ("𝗧𝗵𝗲 𝗽𝗮𝗴𝗲", "The page"), ("th​e﻿ page", "the page"), ("the\xa0page x", "the page x"), (unicodedata.normalize("NFD", "größten"), "größten"),
     (unicodedata.normalize("NFD", "두 번째"), "두 번째"), ("pаge", "page"), ("Тhe", "The"), ("сkрытый слой скpытый", "скрытый слой скрытый"), ("rοtated", "rotated"), ("rօtated pɑge", "rotated page"), ("Ꭲhe page", "The page"), ("ⲣage", "page"), ("слⲟй", "слой")],
)
def test_forms(vocabulary, text, plain):
    forms = Forms(vocabulary)
    assert forms.consistent(text) == (plain, True)
    assert forms.consistent(plain) == (plain, False)


@pytest.mark.parametrize("text", ["“x” – ‘y’ 4² ½ ™ Ω π Δx μm", "x̂", "👩‍💻", "Привет world", "La dÃ©tection des lignes complÃ¨te le cadre"])
def test_no_deviation(vocabulary, text):
    assert Forms(vocabulary).consistent(text)[1] is False


def test_scripts():
    assert [script(c) for c in "aéяЖαΩ한"] == ["LATIN", "LATIN", "CYRILLIC", "CYRILLIC", "GREEK", "GREEK", ""]


def test_found_in_results_and_pages(tables, spark):
    moji, form = damaged(SENTENCES["fr"][0], "cp1252"), "The pаge renderer keeps the hidden layer."
    rows = [(1, moji, "fr"), (1, moji, "fr"), (2, form, "en"), (3, None, None), (4, "", "en"), (5, "x" * 200_000, "en"), (6, "�" * 50, "en"), (None, moji, "fr")]
    tables.results(rows, extra=True)
    tables.glyphs({(1, 1): moji, (2, 3): form, (7, 1): "The hidden layer."})
    found = {n: sorted((r.field, r.result_id or 0, r.page_no) for r in QUERIES[n](spark, tables.folder).collect()) for n in ("p1_found", "p5_found")}
    assert found == {"p1_found": [("result", 0, 0), ("result", 1, 0), ("unicode", 1, 1)], "p5_found": [("result", 2, 0), ("unicode", 2, 3)]}
    assert {r.text for r in QUERIES["p1_restored"](spark, tables.folder).collect()} == {SENTENCES["fr"][0]}
    assert QUERIES["p5_text"](spark, tables.folder).where("deviates = 1").count() == 2


def test_empty_tables(tables, spark):
    tables.spark.read.parquet(f"{tables.folder}/batch_results.parquet").limit(0).write.parquet(f"{tables.folder}/e/batch_results.parquet")
    tables.spark.read.parquet(f"{tables.folder}/pdf_glyphs.parquet").limit(0).write.parquet(f"{tables.folder}/e/pdf_glyphs.parquet")
    tables.spark.read.parquet(f"{tables.folder}/common_words.parquet").limit(0).write.parquet(f"{tables.folder}/e/common_words.parquet")
    for name in ("p1_found", "p1_restored", "p2_found", "p2_stats", "p2_quality", "p3_found", "p3_text", "p4_found", "p4_languages", "p5_found", "p5_text"):
        assert QUERIES[name](spark, f"{tables.folder}/e").count() == 0, name


def test_wrapping_helper():
    assert max(map(len, wrapped(prose("en", 1)).split("\n"))) <= 48
