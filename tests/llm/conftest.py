"""Small tables made for the tests: texts of a few sentences in several languages, damaged on purpose."""

import random

import pytest

SENTENCES = {
    "en": ["The page renderer keeps the hidden layer.", "A rotated page reads the bookmark tree after the last update.", "The font cache joins the list of field names without any warning.", "Each worker thread moves the reader’s own fallback font."],
    "de": ["Der Parser ersetzt den größten Absatz während der Prüfung.", "Die zweite Spalte löscht das übergeordnete Feld.", "Der nächste Prüflauf verliert die frühere Fassung der Übersicht."],
    "fr": ["Le moteur de rendu vérifie le paragraphe précédent.", "La détection des lignes complète le cadre vide après l’ouverture du fichier.", "Une référence endommagée perd la qualité générale du résultat."],
    "es": ["La última prueba conserva el párrafo siguiente.", "La configuración añadida pierde el campo superior durante la revisión.", "El analizador repara la codificación española."],
    "ru": ["Разбор строк сохраняет родительское поле.", "Второй столбец теряет общий словарь ресурсов.", "Анализатор проверяет скрытый слой."],
    "ko": ["본문 추출기는 줄 끝의 빈칸을 읽는다.", "두 번째 단은 숨겨진 층을 비교한다.", "글꼴 저장소가 모든 객체 번호를 옮긴다."],
}
RESULT = "result_id bigint, run_id string, path string, status string, error_class string, error_message string, result string, declared_lang string, n_pages int, finished_at timestamp, loaded_at timestamp"
GLYPH = "doc_id bigint, page_no int, seq bigint, unicode string, a float, b float, tx float, ty float, height float, width float, space_width float, font_size float, font_name string, page_width float, page_height float"
DOCUMENT = "doc_id bigint, text string, lang string, source string, n_chars bigint, doc_kind string, component string, created_at timestamp"


def prose(lang, seed, n=4):
    rng = random.Random(f"{lang}{seed}")
    return " ".join(rng.choice(SENTENCES[lang]) for _ in range(n))


def wrapped(text, width=48):
    lines, row = [], ""
    for word in text.split(" "):
        if row and len(row) + len(word) >= width:
            lines.append(row)
            row = word
        else:
            row = f"{row} {word}" if row else word
    return "\n".join([*lines, row])


class Tables:
    """A folder of tables as the queries expect it."""

    def __init__(self, spark, folder):
        self.spark, self.folder = spark, str(folder)

    def results(self, rows, extra=False):
        """Rows of ``(result_id, text, declared language)`` over a background of sound ones."""
        background = [(10_000 + i, wrapped(prose(lang, i)), lang) for i in range(60) for lang in SENTENCES]
        full = [(k, "run", f"/p/{k}.pdf", "ok", None, None, text, lang, 1, None, None) for k, text, lang in [*background, *rows]]
        df = self.spark.createDataFrame(full, RESULT)
        if extra:
            df = df.selectExpr("*", "1 as word", "'x' as text", "2 as field", "3 as page_no", "4 as _h")
        df.write.mode("overwrite").parquet(f"{self.folder}/batch_results.parquet")

    def glyphs(self, pages):
        rows = []
        for (doc, page), text in pages.items():
            seq = 0
            for k, line in enumerate(text.split("\n")):
                for i, c in enumerate(line):
                    rows.append((doc, page, seq, c, 10.0, 0.0, 50.0 + 6 * i, 700.0 - 12 * k, 10.0, 6.0, 6.0, 10.0, "F", 612.0, 792.0))
                    seq += 1
        self.spark.createDataFrame(rows, GLYPH).write.mode("overwrite").parquet(f"{self.folder}/pdf_glyphs.parquet")

    def words(self, rows=(("en", 1, "the"), ("de", 1, "der"))):
        self.spark.createDataFrame(list(rows), "lang string, word_rank int, word string").write.mode("overwrite").parquet(f"{self.folder}/common_words.parquet")

    def documents(self, rows, extra=False):
        """Rows of ``(doc_id, text, source)`` or with n_chars."""
        full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", r[3] if len(r) > 3 else None, "mail", "c", None) for r in rows]
        df = self.spark.createDataFrame(full, DOCUMENT)
        if extra:
            df = df.selectExpr("*", "1 as ids", "2 as first", "3 as cut", "4 as key")
        df.write.mode("overwrite").parquet(f"{self.folder}/documents.parquet")

    def items(self, rows):
        full = [(k, "suite", None, text, None, "en") for k, text in rows]
        self.spark.createDataFrame(full, "item_id bigint, suite string, instruction string, text string, answer string, lang string").write.mode("overwrite").parquet(f"{self.folder}/eval_items.parquet")


@pytest.fixture
def tables(spark, tmp_path):
    made = Tables(spark, tmp_path)
    made.results([])
    made.glyphs({})
    made.words()
    made.documents([])
    made.items([])
    return made


@pytest.fixture(scope="session")
def vocabulary():
    from collections import Counter

    from paperloom.llm.vocabulary import Vocabulary, pieces, tokens

    counts = Counter(p for i in range(40) for lang in SENTENCES for t in tokens(prose(lang, i)) for p in pieces(t))
    return Vocabulary({w: n for w, n in counts.items() if n >= 3}, sum(counts.values()))
