"""Small document tables for the tests of the training-data operators."""

DOC_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def docs_frame(spark, texts, extra=None):
    """Documents with ids 0, 1, ... over the given texts (a pair gives its own id)."""
    rows = []
    for i, t in enumerate(texts):
        key, text = t if isinstance(t, tuple) else (i, t)
        rows.append((key, text, "en", f"src{i % 3}" if i % 7 else None, None if text is None else len(text)))
    return spark.createDataFrame(rows, DOC_SCHEMA)


def write_tables(spark, folder, **frames):
    for name, df in frames.items():
        df.write.mode("overwrite").parquet(f"{folder}/{name}.parquet")
    return str(folder)


def rows_by(df, key):
    return {r[key]: r.asDict() for r in df.collect()}
