"""Documents with everything that may go wrong, for every operator."""

TEXTS = [
    None, "", " ", "\n\t \r\n", "a", "word", "  two  spaces  ", "<s> </s> <|endoftext|> <unk>", "▁▁a ▁b", "é① 日本語の文章 ﬁ",
    "tab\tnew\nline\r\nnon break　ideographic​zero \u0085next", "x" * 3000, "日本" * 1500, "a b " * 2000, "it's  we'll\n\n I'd  'x",
    "the cat sat on the mat and " * 40, "the cat sat on the mat and " * 40, "\\ ### </turn> : \\\\", "1234567890 " * 50, "ünïcödé " * 30, "\x00\x1c\x1f \x0b\x0c",
]


def documents(spark):
    """Repeated rows and keys, null keys, and columns whose names an operator might use itself."""
    rows = [(None if i == 4 else 3 if i in (2, 3) else i, t, [None, "en", "fr"][i % 3], ["a", None, "b"][i % 3], len(t or ""), "clash", float(i), i)
            for i, t in enumerate(TEXTS)]
    rows += rows[5:8]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, key string, length double, part long")


def empty(spark):
    return documents(spark).limit(0)
