"""Rows that every operator must bear."""

from __future__ import annotations

#: Null and empty texts, nulls in other columns, rows that repeat, an id with two texts, very long lines.
LONG = "long words in a row " * 3000
AWKWARD = [
    (1, "one two three four five six\nshared line here\nend", "en", "a"),
    (1, "one two three four five six\nshared line here\nend", "en", "a"),
    (2, None, None, None),
    (3, "", "fr", "b"),
    (4, LONG, "en", None),
    (5, "one two three four five six\nshared line here\nend", "en", "c"),
    (None, "a row without an id\nshared line here", "de", "c"),
    (6, "Ünïcödé ſtraße İK   \x1c 123 4539 1488 0343 6467 <|endoftext|> 你好", "de", "c"),
    (7, "one text of an id", "en", "c"),
    (7, "another text of the same id", "en", "c"),
    (8, "   \n\t\n  ", "en", "d"),
]
SCHEMA = "doc_id long, text string, lang string, source string"
