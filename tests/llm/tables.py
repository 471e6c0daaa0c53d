"""Small tables for the operators of this folder."""

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
ODD_TEXTS = [
    "", None, " ", "  a b  c\n\n d ", "\x1cq\x1d w\x85z a's we'll  \t x", "ÀÉ naïve ﬁ İstanbul ΣΑΣ 12345 ٣٤ <|endoftext|> don't", "a" * 5000, "😀😀 é ́x",
    "one.\nTwo three,four", "\n a\n", " lead", "trail ", "tab\tx y", "　a　b c", "same text", "same text", "word " * 30_000,
]


def documents(spark, texts, first=100_000):
    """Documents with these texts and two clashing extra columns."""
    rows = [(first + i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA)


def write(df, path, name="documents"):
    df.coalesce(1).write.mode("overwrite").parquet(f"{path}/{name}.parquet")


def labels(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")
