from __future__ import annotations

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def documents(spark, texts, sources=None, ids=None):
    """A documents table of these texts."""
    rows = [(i if ids is None else ids[i], t, "en", "s" if sources is None else sources[i], None if t is None else len(t)) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


def saved(df, tmp_path, name="documents"):
    """A folder of tables with this one, for a query."""
    df.coalesce(2).write.parquet(str(tmp_path / f"{name}.parquet"))
    return str(tmp_path)


def words(text):
    return (text or "").encode().split()


def least_reachable(n, linked, ids):
    """Each row's smallest id over the transitive closure of linked(i, j)."""
    out = list(ids)
    changed = True
    while changed:
        changed = False
        for i in range(n):
            low = min([out[i], *(out[j] for j in range(n) if linked(i, j))])
            if low < out[i]:
                out[i], changed = low, True
    return out
