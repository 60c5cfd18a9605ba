"""Small tables for the operators' edge cases."""

from pyspark.sql import functions as F

HARD = [
    (0, "The cat sat.\nOn the mat, twice!"), (1, None), (2, ""), (3, "The cat sat.\nOn the mat, twice!"), (4, "don't won't they're <|endoftext|> ÀḆ Å İΣ xΣ"),
    (5, "héllo,wörld... %%% a1b2 'tis 'S n't \t tabs nbsp em  double\r\nline"), (6, "word " * 9000), (7, "x" * 3000), (8, "\n\n \n"), (9, "\U0001f600 emoji 你好 กำ"), (9, "a second row of nine"), (None, "no id"),
]


def hard(spark, rows=HARD):
    """Nulls, empty and very long texts, ties and repeated rows, and extra columns with names that operators use."""
    return spark.createDataFrame(rows, "doc_id long, text string").withColumns({"n_tokens": F.lit("x"), "start": F.lit(1), "kept": F.lit(None).cast("int"), "row": F.lit(1), "hash": F.lit("h")})


def key(row):
    return tuple((x is not None, x) for x in row)
