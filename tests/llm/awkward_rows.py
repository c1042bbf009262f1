"""Documents that every operator must take: nulls, repeated and empty rows, a long text."""

LONG = " ".join(f"word{i % 977} of line{i // 50}" for i in range(60_000))
AWKWARD = [
    (1, "The quick brown fox jumps over the lazy dog and runs far away from here"),
    (2, "The quick brown fox jumps over the lazy dog and runs far away from here"),
    (2, "The quick brown fox jumps over the lazy dog and runs far away from here"),
    (3, None),
    (4, ""),
    (None, "a text without an id"),
    (None, None),
    (5, " \t\n\x0b\x0c\r "),
    (6, "é\x00\x1c\x85ü 日本語 \U0001f600 . , -"),
    (7, LONG),
    (2, "another text of the same id"),
    (-9, "UPPER lower UPPER lower"),
]
