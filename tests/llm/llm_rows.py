"""Rows that are awkward in every way the operators must stand."""

LONG = "word and words. " * 20_000

#: Nulls in every column, empty, blank and very long texts, repeated rows, an id with two texts, and extra columns with clashing names.
ROWS = [
    (1, "the quick brown fox jumps over the lazy dog near the river bank today", "en", "a", 69, "x", 0.5, "s"),
    (2, "The quick, brown fox jumps over the lazy dog near the river bank today!", "en", "b", 71, "x", None, None),
    (3, "", "en", "a", 0, None, 1.0, "t"),
    (4, "   \n\t ", None, None, None, "y", 1.0, "t"),
    (5, None, "de", "a", None, None, None, None),
    (6, LONG, "en", "b", len(LONG), "z", 0.0, "u"),
    (None, "you are a stupid worthless idiot", None, "c", 32, "z", 0.0, "u"),
    (7, 'my token = "04dbebab91ab85687d33eeaaf9ac699e1188f962" here', "en", "c", 58, "z", 0.0, "u"),
    (7, 'my token = "04dbebab91ab85687d33eeaaf9ac699e1188f962" here', "en", "c", 58, "z", 0.0, "u"),
    (8, "two texts share this identifier number one of them", "fr", None, 50, "z", 0.0, "u"),
    (8, "quite another text with the very same identifier", "fr", None, 48, "z", 0.0, "u"),
    (9, "漢字かな交じり文 🙂 x\x00y ▁ ퟿", "ja", "d", 20, "z", 0.0, "u"),
]
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, shard string, score double, secret string"
