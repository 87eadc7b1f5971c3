"""Small tables and comparisons for the tests of this folder."""

from __future__ import annotations

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
PAGES = "page_id bigint, url string, html string"
VECTORS = "vec_id bigint, embedding array<float>, label int"


def documents(spark, rows):
    """Rows of (doc_id, text[, lang[, source]])."""
    full = [(*r, *("en", "src0")[len(r) - 2 :]) if len(r) < 4 else r for r in rows]
    return spark.createDataFrame([(i, t, lang, s, len(t) if t is not None else None) for i, t, lang, s in full], DOCS)


def rows_of(df, *columns):
    return sorted((tuple(r) for r in (df.select(*columns) if columns else df).collect()), key=repr)
