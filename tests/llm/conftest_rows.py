"""Edge cases that every operator on documents takes."""

HARD = [
    (1, None), (2, ""), (3, " \n\t "), (4, "one"), (None, "no id at all here"), (5, "same text twice"), (5, "same text twice"),
    (6, "same text twice"), (7, "\U0001f600 é \x00 ß ﬁ 日本"), (8, "word " * 30000), (9, "x" * 50000),
]
