"""Small inputs on which queries that do less than their whole job give other rows."""

from tests.llm import test_texts
from terravane.llm import language

trees = test_texts.trees


def test_every_run_and_every_document_has_a_row(spark, trees):
    en, fr = test_texts.speak("en", 5, 7), test_texts.speak("fr", 4, 8)
    texts = {1: en + fr + en + fr, 2: en, 3: None, 4: "", 5: "#REDIRECT [[Weg]]", 6: test_texts.speak("en", 6, 11)[::-1]}
    df = spark.createDataFrame([(k, t, "en") for k, t in texts.items()], "doc_id long, text string, lang string")
    rows = sorted(language.segments(df, trees).collect(), key=lambda r: (r.doc_id, r.segment))
    n, m = len(language.sentences(en)), len(language.sentences(fr))
    runs = [(r.language, r.first, r.last, r.sentences) for r in rows if r.doc_id == 1 and r.segment]
    assert runs == [("en", 0, n - 1, n), ("fr", n, n + m - 1, m), ("en", n + m, 2 * n + m - 1, n), ("fr", 2 * n + m, 2 * n + 2 * m - 1, m)]
    assert [(r.doc_id, r.language, r.words > 0) for r in rows if r.segment == 0] == [(1, "en", True), (2, "en", True), *[(k, None, False) for k in (3, 4, 5, 6)]]
    assert [r.language for r in rows if r.doc_id == 2] == ["en", "en"] and len(rows) == 4 + 6 + 1
    assert all(0 < r.confidence <= 1 for r in rows if r.language)
    assert sorted((r.doc_id, r.language) for r in language.label_faults(language.segments(df, trees)).collect()) == [(1, "en"), (1, "fr")]
