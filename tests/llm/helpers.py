"""Small fixtures for the tests of this folder."""

DOC_SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def docs(spark, texts, **more):
    """Documents numbered from 0; ``more`` gives other columns by name, as lists."""
    rows = [(i, t, more.get("lang", ["en"] * len(texts))[i], more.get("source", ["s"] * len(texts))[i], len(t or "")) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOC_SCHEMA)


ODD = [None, "", " ", "\n\t", "word", "a b c", "a b c", "x" * 30_000, "naïve 東京 😀 e\u0301", "1 22 333", "The The " * 3000, "tab\tsep\x0bvt\x0cff\x1cfs\u00a0nb"]
