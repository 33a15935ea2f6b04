"""Small tables with everything that may go wrong in them."""

from __future__ import annotations

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"
#: Columns that the operators use themselves as names.
CLASHES = ["fp", "id", "row", "score", "size", "rank", "step", "word", "sender", "part", "length", "hit", "gone", "u", "mix_copies"]
LONG = " ".join(f"w{i % 997}x" for i in range(25_000))
ROWS = [
    (1, None, "en", "b", 0),
    (2, "", "en", "b", 0),
    (3, "  \n\t ", None, None, 5),
    (4, "The Quick brown fox", "en", "a", 19),
    (5, "the quick BROWN fox", "en", "a", 19),
    (6, LONG, "de", "a", len(LONG)),
    (7, "ÄPFEL und Öl", "de", "c", 12),
    (8, "äPFEL und Öl", "de", "c", 12),
    (9, "1234 ... !!", "fr", None, 11),
    (10, "you idiot ### you moron", "en", "b", 23),
    (11, "one", "en", "b", 3),
    (12, "the quick brown fox", "en", "a", 19),
    (12, "the quick brown fox", "en", "a", 19),
    (13, "日本語 テキスト <|endoftext|> x", None, "a", 10),
    (14, LONG, "de", "a", len(LONG)),
]


def documents(spark, rows=ROWS, clash=True):
    df = spark.createDataFrame(rows, COLUMNS)
    if clash:
        from pyspark.sql import functions as F

        df = df.withColumns({c: F.lit("x") for c in CLASHES})
    return df


def lower(text):
    return (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
