"""Shared by the tests of the training-data operators."""

SF = "/root/testdata/sf0.001"


def rows(df):
    return [r.asDict(recursive=True) for r in df.collect()]


TRICKY = [
    (1, "plain words, and more words."), (2, None), (3, ""), (4, "  \n\n\t "), (None, "null id"), (5, "repeat"), (5, "repeat"),
    (6, "İstanbul ΣΑΣ naïve don't 12,5% x_y <|endoftext|> ---... !!! é   z\x0bq"), (9, "क़. שׁ! ड़, ÀÉ; ﬁ? ﬀ."), (7, "word " * 9000), (8, "a" * 5000),
]
