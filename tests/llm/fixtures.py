"""Small tables with nulls, empty and long texts, repeats, ties and clashing extra columns."""

from __future__ import annotations

import random

WORDS = "the of and in lorem ipsum apache license version gnu general public mit cc by été日本 x1 naïve".split()


def texts(n: int = 60, seed: int = 4) -> list[str | None]:
    r = random.Random(seed)
    line = lambda k: " ".join(r.choice(WORDS) for _ in range(k))
    made: list[str | None] = [None, "", " ", "\n\n", "a", "<|endoftext|>", "  two  spaces ", line(4000)]
    passage = "Shared passage. " + " ".join(f"w{i}" for i in range(80))
    while len(made) < n:
        kind = r.randrange(5)
        if kind == 0:
            made.append(f"{line(10)}. {passage}\n{line(12)}")
        elif kind == 1:
            base = [f"u{r.randrange(10**6)}" for _ in range(60)]
            made += [" ".join(base), " ".join([*base[:-1], "Z"]), " ".join(base)]
        else:
            made.append(f"{line(r.randrange(1, 60)).capitalize()}. {line(r.randrange(1, 60))}!")
    return made[:n]


def frame(spark, rows, extra: bool = True):
    """documents with columns that clash with names operators might use."""
    data = [(i, t, "en", "src0", None if t is None else len(t), "kept", 7) for i, t in rows]
    df = spark.createDataFrame(data, "doc_id long, text string, lang string, source string, n_chars long, ids string, score int")
    return df if extra else df.select("doc_id", "text", "lang", "source", "n_chars")


def tables(tmp_path, spark, rows, labels=None, benchmark=None, pages=None) -> str:
    frame(spark, rows, False).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels or [], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame(benchmark or [], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame(pages or [], "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    return str(tmp_path)


def numbered(n: int = 60, seed: int = 4):
    """Rows with repeats: two whole rows twice, and a null id."""
    rows = list(enumerate(texts(n, seed)))
    return [*rows, rows[9], rows[10], (None, "no id " * 60)]
