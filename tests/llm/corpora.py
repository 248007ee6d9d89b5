"""Small document tables with the cases that every operator must define."""

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"

ODD_TEXTS = [
    "",
    None,
    " ",
    "one",
    "  two  spaced\n\nwords\t\there ",
    "▁already▁ marked ▁▁ text",
    "日本語 テスト 🤖🤖 é",
    "<s> </s><0x0A><unk> <|endoftext|>x y<|endoftext|>",
    "1234 56a7 it's WE'LL don't!? (a.b),c",
    "nb sp wide   mixed　\n",
    "\x00ctl\x1f \x0b\x0c",
    "Licensed under the Apache License, Version 2.0.",
    "a" * 3000,
    "word " * 4000,
]


def odd_documents(spark, more=()):
    """The odd texts, then more; a repeated row, a null id and clashing column names are among them."""
    texts = [*ODD_TEXTS, *more]
    rows = [(i, t, "en", None, None) for i, t in enumerate(texts)]
    rows += [rows[4], (None, "no id here", None, "s", 1)]
    return spark.createDataFrame(rows, SCHEMA).selectExpr("*", "0 AS key", "'x' AS bucket", "1 AS copies")
