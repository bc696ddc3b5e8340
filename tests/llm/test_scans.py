import random
from collections import Counter

import numpy as np
import pytest

from paperloom.llm import catalog
from paperloom.llm.boosting import BoostedTrees
from paperloom.llm.scan_noise import Cleaner, Confusions, Corrector, Furniture, Index, Joiner, LineStatistics, difference, differences, is_candidate, template, title_like, without_misread
from paperloom.llm.vocabulary import Vocabulary

from .conftest import SENTENCES, prose, wrapped

QUERIES = catalog.queries()
STATISTICS = LineStatistics({"handbook for form exchange": 40}, {"cross-reference": 50, "en-tête": 30, "quil-77": 20})


@pytest.fixture(scope="module")
def cleaner(vocabulary):
    corrector = Corrector(vocabulary, Confusions({})).fit()
    texts = [wrapped(prose("en", i)) + f"\n– {i} –\nHandbook for Form Exchange\n" + wrapped(prose("de", i)) + f"\n– {i + 1} –\n" + wrapped(prose("de", i + 1)) for i in range(30)] + [wrapped(prose("fr", i)) for i in range(30)]
    return Cleaner(corrector, Furniture(STATISTICS, corrector).fit(texts), Joiner(vocabulary, STATISTICS).fit())


def test_trees_learn_a_rule():
    rng = np.random.default_rng(0)
    x = rng.random((2000, 4))
    y = ((x[:, 0] > 0.5) ^ (x[:, 2] > 0.3)).astype(float)
    model = BoostedTrees().fit(x[:1500], y[:1500])
    assert ((model.probability(x[1500:]) > 0.5) == y[1500:]).mean() > 0.95
    assert BoostedTrees().fit(np.zeros((0, 3)), np.zeros(0)).probability(np.zeros((2, 3))).tolist() == [0.5, 0.5]


@pytest.mark.parametrize(("word", "meant", "steps"), [("moclule", "module", 1), ("rnodule", "module", 1), ("pa9e", "page", 1), ("page", "page", 0), ("pxge", "page", None), ("vvhcn", "when", 2)])
def test_known_steps(word, meant, steps):
    found = Confusions({("zz", "q"): 50}).known_steps(word, meant)
    assert (found and found[0]) == steps


@pytest.mark.parametrize(("word", "meant", "parts"), [("moclule", "module", ("cl", "d", 2, 3)), ("pge", "paage", None), ("page", "page", None), ("naar", "nar", ("aa", "a", 1, 1)), ("xage", "page", ("x", "p", 0, 3)), ("wfh", "wxyh", ("f", "xy", 1, 1))])
def test_differences_at_one_place(word, meant, parts):
    assert difference(word, meant) == parts


def test_confusions_are_learned_from_the_corpus():
    frequent = {"quality": 9000, "quarter": 8000, "request": 7000, "unique": 6000, "queue": 5000}
    index = Index(Vocabulary(frequent, 40_000))
    noisy = [(w.replace("qu", "kv"), 3) for w in frequent] + [("qualitys", 5), ("quarzer", 900), ("requezt", 1), ("12", 4), ("", 1)]
    found = list(differences(noisy, index))
    assert found.count(("kv", "qu")) == 5 and set(found) == {("kv", "qu"), ("z", "s")}
    confusions = Confusions({("kv", "qu"): 5})
    assert confusions.known_steps("kvarter", "quarter")[0] == 1 and Confusions({}).known_steps("kvarter", "quarter") is None
    assert confusions.cost["kv", "qu"] < confusions.cost["q", "g"] < confusions.like < confusions.unlike


def test_held_out_corrections(vocabulary):
    # what the words are misread as here was never told, it is learned from other words of the corpus
    unseen = [("r", "zz"), ("t", "k"), ("n", "x"), ("e", "w"), ("s", "p")]
    rng = random.Random(42)

    def broken(word):
        fits = [(meant, written) for meant, written in unseen if meant in word[1:-1]]
        if not fits:
            return None
        meant, written = rng.choice(fits)
        i = word.index(meant, 1)
        return word[:i] + written + word[i + len(meant) :]

    words = sorted(w for w in vocabulary.counts if len(w) > 4 and w.isascii())
    rng.shuffle(words)
    half = len(words) // 2
    noisy = Counter(m for w in words[:half] for _ in range(6) if (m := broken(w)) and m not in vocabulary)
    raised = Vocabulary({w: 400 * n for w, n in vocabulary.counts.items()}, 400 * vocabulary.total)
    learned = {p: n for p, n in Counter(differences(noisy.items(), Index(raised))).items() if n >= 2}
    assert len(learned) >= 3
    corrector = Corrector(vocabulary, Confusions(learned)).fit()
    cases = [(m, w) for w in words[half:] for _ in range(4) if (m := broken(w)) and m not in vocabulary and any(a in m and b in w for a, b in learned)]
    right = sum(corrector.correct(m) == w for m, w in cases)
    assert len(cases) >= 20 and right >= 0.75 * len(cases)
    assert not any(corrector.correct(w) for w in ["Quilgorhep", "zzz", "xlii", "1234", "xq", "weiterhin"])


def test_letters_of_like_shape(vocabulary):
    counts = {"the": 90_000, "and": 60_000, "font": 9000, "table": 900} | {w: 300 * n for w, n in vocabulary.counts.items() if w not in ("the", "and", "font", "table")}
    corrector = Corrector(Vocabulary(counts, sum(counts.values())), Confusions({})).fit()
    assert [corrector.correct(w) for w in ("tne", "lhe", "aud", "tabie")] == ["the", "the", "and", "table"]
    assert [m for m, *_ in corrector.candidates("fonl")] == ["font"]


def test_nothing_to_correct_by():
    assert Corrector(Vocabulary({}, 0), Confusions({})).fit().correct("page") is None
    assert list(differences([("page", 1)], Index(Vocabulary({}, 0)))) == []


def test_line_forms():
    assert template("240     Handbook for Form Exchange") == template("HANDBOOK FOR FORM EXCHANGE | Quil") == "handbook for form exchange"
    assert title_like("Notes on Column Order") and not title_like("the page") and not title_like("It reads the whole page again")
    assert is_candidate("– 81 –") and is_candidate("xii") and is_candidate("Page 3 of 9") and not is_candidate("and the font cache keeps")


@pytest.mark.parametrize("line", ["– 81 –", "[9]", "p. 12", "Page 3 of 9", "xlii", "Handbook for Form Exchange", "HANDBOOK FOR FORM EXCHANGE", "82     Handbook for Form Exchange"])
def test_furniture(cleaner, line):
    first, second = wrapped(SENTENCES["en"][1] + " " + SENTENCES["en"][0], 30).split("\n", 1)
    # a heading runs only where it stands beside a number or at an edge
    above = "[7]\n" if line[0] in "hH" else ""
    repair = cleaner.clean(f"{first}\n{above}{line}\n{second}")
    assert repair.noise == {"furniture"} and repair.text == f"{SENTENCES['en'][1]} {SENTENCES['en'][0]}"


@pytest.mark.parametrize("lang", SENTENCES)
def test_clean_text_has_no_noise(cleaner, lang):
    assert cleaner.clean(wrapped(prose(lang, 5))).noise == set()


def test_broken_words(cleaner):
    repair = cleaner.clean("The page ren-\nderer keeps the hid¬\nden layer. A cross-\nreference keeps the quil-\n77 layer.")
    assert "hyphen" in repair.noise and "renderer keeps the hidden layer." in repair.text and "crossreference" not in repair.text
    assert cleaner.clean("The page ren-\n– 4 –\nderer keeps.").noise == {"hyphen", "furniture"}
    assert cleaner.clean("The page keeps the hid¬").noise == {"hyphen"}
    assert cleaner.clean("The page keeps the rea-").noise == {"hyphen"}
    assert cleaner.clean("L’en-\ntête complète le cadre vide.").noise == set()


def test_misread_words(cleaner):
    repair = cleaner.clean("The pa9e renderer keeps the hiclden layer. A rotatcd page reads.")
    assert repair.noise == {"chars"} and repair.text == "The page renderer keeps the hidden layer. A rotated page reads."
    assert cleaner.clean("The pa9e renderer keeps the hidden layer.", {"pa9e"}).noise == set()
    assert cleaner.clean("").noise == set() and cleaner.clean("\n\n").text == ""


def test_the_rest_of_a_word_is_not_corrected(vocabulary):
    counts = {"una": 90_000, "the": 90_000, "page": 9000} | {w: 300 * n for w, n in vocabulary.counts.items()}
    corrector = Corrector(Vocabulary(counts, sum(counts.values())), Confusions({})).fit()
    whole = Cleaner(corrector, Furniture(STATISTICS, corrector).fit([]), Joiner(vocabulary, STATISTICS).fit())
    corrector.known["ura"] = "una"
    assert whole.clean("ura. The page renderer keeps the hidden layer.").noise == set()
    assert whole.clean("The page ura renderer keeps the hidden layer.").noise == {"chars"}


def test_what_was_meant_among_many_like_words():
    # words that share more two-letter runs with the misread one than what was meant does
    like = ["vvh", "vvhe", "vvhi", "hcn", "ehcn", "ahcn", "vvha", "vvho", "ohcn"]
    corrector = Corrector(Vocabulary({"when": 900} | dict.fromkeys(like, 3), 10_000), Confusions({}))
    assert ("when", 2) in {(meant, steps) for meant, steps, _, other in corrector.candidates("vvhcn") if not other}


def test_misread_words_in_the_vocabulary():
    counts = {"page": 5000, "poge": 30, "pa9e": 2600, "pagc": 27, "the": 9000, "fonf": 25, "font": 1300, "pagina": 37, "página": 847, "cache": 2287, "caché": 569, "renderer": 90, "mp3": 40, "x86": 30}
    vocabulary, confusions = Vocabulary(counts, 50_000), Confusions({})
    sound = without_misread(vocabulary, confusions)
    assert set(counts) - set(sound.counts) == {"poge", "pa9e", "pagc", "fonf"}
    for word in ["pa9e", "poge", "page", "rnp3", "fonf"]:
        assert confusions.meant_words(word, vocabulary) == {w for w in counts if w != word and confusions.known_steps(word, w)}


@pytest.mark.parametrize(("line", "number"), [("– 81 –", 81), ("xiv", 14), ("Page 3 of 9", 3), ("—", None)])
def test_numbers_of_lines(line, number):
    from paperloom.llm.scan_noise import _number

    assert _number(line) == number


def test_frequent_misreadings_are_found(tables, spark):
    rows = [(i, wrapped(prose("en", i)).replace("page", "pa9e", 1), "en") for i in range(1, 12)]
    rows = [r for r in rows if "pa9e" in r[1]]
    tables.results(rows)
    found = {r.result_id for r in QUERIES["p3_found"](spark, tables.folder).where("field = 'result' and noise = 'chars'").collect()}
    assert found == {r[0] for r in rows} and len(rows) > 4


def test_found(tables, spark):
    noisy = wrapped(prose("en", 1)).replace("hidden", "hiclden", 1).replace("page", "pa9e", 1)
    rows = [(1, noisy, "en"), (1, noisy, "en"), (2, None, "en"), (3, "", "en"), (4, "\n".join(f"- thc lay0ut {i}" for i in range(9)), "en"), (5, wrapped(prose("en", 2)), "en"), (6, "x-\n" * 3000, "en")]
    tables.results(rows, extra=True)
    tables.glyphs({(1, 2): noisy, (2, 1): "The page renderer keeps the hid¬", (5, 1): "The page."})
    found = sorted((r.field, r.result_id, r.page_no, r.noise) for r in QUERIES["p3_found"](spark, tables.folder).where("result_id < 6").collect())
    assert found == [("result", 1, 0, "chars"), ("unicode", 1, 2, "chars"), ("unicode", 2, 1, "hyphen")]
    texts = {r.text for r in QUERIES["p3_text"](spark, tables.folder).where("result_id = 1 and page_no = 0").collect()}
    assert texts == {prose("en", 1)}
