"""Rows with the edge cases that every operator must handle."""

#: Nulls, empty and blank texts, equal rows, ties but for case, a long text, and texts that share lines and passages.
LONG = " ".join(f"word{i % 997} is number {i}." for i in range(6000))
PASSAGE = "The harbour was quiet that evening and nobody spoke. A single lamp burned above the door of the old customs house. "
BOILER = "All rights reserved by Example Press 2024\n"
EDGE = [
    (1, "Alpha beta gamma delta epsilon zeta eta theta iota kappa", "en", "web"),
    (2, "ALPHA beta gamma delta epsilon zeta eta theta iota kappa", "en", "web"),
    (3, None, None, None),
    (4, "", "en", None),
    (5, " \n\t ", "de", "web"),
    (6, LONG, "en", "books"),
    (7, LONG + " one more word at the end", "en", "books"),
    (8, "ein kurzer Satz über Füchse und Hühner im Garten", "de", "news"),
    (8, "ein kurzer Satz über Füchse und Hühner im Garten", "de", "news"),
    (None, "a row without an id but with words of its own", "en", "web"),
    (None, None, None, None),
    (9, "123 456 !!", None, "web"),
    (10, PASSAGE + "Mail ann.lee@example.org or call +44 20 7946 0958.", "en", "web"),
    (11, "Something else first, to begin with. " + PASSAGE + "From 192.168.10.4 by 4111 1111 1111 1111.", "en", "web"),
    (12, "𝔘nicode ✨ astral " * 3, "en", "web"),
    *[(20 + i, f"{BOILER}Own line number {chr(97 + i)} stays here", "en", "web") for i in range(12)],
    (-5, "x" * 50_000, "en", "web"),
]
#: Names that the operators use inside.
CLASHING = "rep string, bucket string, text_hash string, label string, at string, __key string, size string"
SCHEMA = f"doc_id long, text string, lang string, source string, n_chars long, {CLASHING}"


def rows(spark, data):
    full = [(i, t, lang, s, len(t or ""), *["c"] * 7) for i, t, lang, s in data]
    return spark.createDataFrame(full, SCHEMA)
