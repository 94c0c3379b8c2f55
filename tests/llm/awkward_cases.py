"""Rows that every operator must take: (doc_id, text, lang, source)."""

AWKWARD = [
    (1, "The cat sat on the mat. " * 30, "en", "a"),
    (2, "The cat sat on the mat. " * 30, "en", "a"),
    (3, " The cat\tsat on the mat.\n" * 30, "en", None),
    (3, "repeated id", None, "b"),
    (3, "repeated id", None, "b"),
    (None, "no id", "en", "a"),
    (5, None, None, None),
    (6, "", "en", "b"),
    (7, " \t\n\x0b\f\r", "en", ""),
    (8, "word " * 40_000, "en", "c"),
    (9, "éèê ß 日本語   emoji 🙂 <|endoftext|>  two  spaces", "fr", "b"),
    (10, "x", "en", "c"),
    (-4, "negative id\nand lines\n", "de", "c"),
]
