"""Benchmark decontamination by winnowing.  DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumigraph.llm.text import ascii_lower, free_name
from lumigraph.sources.tables import stash, table

WINDOW, GRAM = 10, 5
#: So many rows of hashes, or of windows as text, are broadcast at most; more are joined by shuffle.
BROADCAST_HASHES, BROADCAST_WINDOWS = 500_000, 100_000


def words(text: Column) -> Column:
    r"""Words [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ of the text with A-Z in lower case; null has none."""
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", -1), "")


def _shifted(df: DataFrame, out: str, a: str, b: str, by: int, f) -> DataFrame:
    """Column `out`: f of each element of array `a` and the element of `b` that is `by` places on."""
    return df.withColumn(out, F.zip_with(a, F.slice(b, by + 1, F.greatest(F.size(b), F.lit(1))), f))


def _covered(df: DataFrame, out: str, a: str, n: int, f) -> DataFrame:
    """Column `out`: f folded over each run of n elements of `a`, in log2(n) passes that overlap (f must not mind overlaps)."""
    span = 1
    while span < n:
        step = min(span, n - span)
        df = _shifted(df, out, a, a, step, f)
        a, span = out, span + step
    return df


def _hashed(df: DataFrame, out: str, n: int) -> DataFrame:
    """Column `out`: a hash of each run of n words of `w`."""
    df = df.withColumn(out, F.transform("w", lambda x: F.xxhash64(x)))
    df = _covered(df, out, out, n, lambda a, b: F.xxhash64(a, b))
    return df.withColumn(out, F.slice(out, 1, F.greatest(F.size("w") - n + 1, F.lit(0))))


def fingerprints(df: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """`df` (with array `w` of words) exploded to (…, w, fp, start, n).

    A window of `window` words has window - gram + 1 grams; its fingerprint is
    their least hash.  Consecutive windows with one fingerprint give one row:
    `start` (from 1) of the first, and `n`, the words that they cover together.
    Two texts that share a window share its fingerprint, always.
    """
    df = _hashed(df.where(F.size("w") >= window), "g", gram)
    df = _covered(df, "m", "g", window - gram + 1, lambda a, b: F.least(a, b))
    df = df.withColumn("m", F.slice("m", 1, F.size("w") - window + 1))
    at = F.filter(F.sequence(F.lit(1), F.size("m")), lambda i: (i == 1) | (F.get("m", i - 1) != F.get("m", i - 2)))
    df = df.withColumn("at", at)
    row = lambda s, i: F.struct(F.get("m", s - 1).alias("fp"), s.alias("start"), (F.coalesce(F.get("at", i + 1), F.size("m") + 1) - s + window - 1).alias("n"))
    return df.select(*[x for x in df.columns if x not in ("g", "m", "at")], F.inline(F.transform("at", row)))


def windows(ws: Column, n: int | Column) -> Column:
    """Every run of n words of `ws`, each as one string, in order."""
    n = F.lit(n) if isinstance(n, int) else n
    return F.when(F.size(ws) >= n, F.transform(F.sequence(F.lit(1), F.size(ws) - n + 1), lambda i: F.array_join(F.slice(ws, i, n), " "))).otherwise(F.array().cast("array<string>"))


def _few(df: DataFrame, most: int) -> bool:
    return df.limit(most + 1).count() <= most


def _cut(w: Column, start: Column, many: Column, n: int) -> Column:
    """(start, s) of each window of n words in the run of `many` words from `start`."""
    return F.transform(windows(F.slice(w, start, many), n), lambda s, i: F.struct((start + i).cast("int").alias("start"), s.alias("s")))


def _met(text: DataFrame, marks: DataFrame, prints: DataFrame, key: str, n: int) -> DataFrame:
    """(d, f, start, n, s): the windows of n words under those of `marks` (d, f, w, start, n, key) whose key is in `prints`.

    Few prints are broadcast, and words are cut out where a mark is found, in
    the task that made it.  More are joined by a shuffle of the marks, without
    words; what is found goes back to its text, each text once.
    """
    if _few(prints, BROADCAST_HASHES):
        rows = marks.join(F.broadcast(prints), key, "left_semi").select("d", "f", F.inline(_cut(F.col("w"), F.col("start"), F.col("n"), n)))
    else:
        some = marks.select("d", "f", "start", "n", key).join(prints, key, "left_semi")
        some = some.groupBy("d", "f").agg(F.collect_set(F.struct("start", "n")).alias("at")).select(F.col("d").alias("of"), F.col("f").alias("with"), "at")
        back = text.join(some, F.col("d").eqNullSafe(F.col("of")) & (F.col("f") == F.col("with")))
        rows = back.select("d", "f", F.inline(F.flatten(F.transform("at", lambda x: _cut(F.col("w"), x["start"], x["n"], n)))))
    return rows.select("d", "f", "start", F.lit(n).alias("n"), "s")


def hits(docs: DataFrame, items: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """(d, f, n_hit, items) of every document, as doc_id and hash of the text, that has a window of an item.

    Texts and items are winnowed, fingerprints joined, and each hit is extended
    to the windows under it, whose words are compared as text.  Items shorter
    than a window have no fingerprint: runs of as many words are joined by hash
    first.  Words are cut out of a text only where a hash was found; no row of
    a hash carries a text further than its task.
    """
    item = stash(items.select(F.col("item_id").alias("item"), words(F.col("text")).alias("w")).where("size(w) > 0"))
    spans = item.select("item", F.least(F.size("w"), F.lit(window)).alias("n"), "w").select("item", "n", F.explode(windows(F.col("w"), F.col("n"))).alias("s")).distinct()
    spans = stash(spans)
    prints = stash(fingerprints(item.select("w"), window, gram).select("fp").distinct())
    spans_n = {r["n"] for r in spans.select("n").distinct().collect()}  # numbers up to `window`
    spans = F.broadcast(spans) if _few(spans, BROADCAST_WINDOWS) else spans
    text = docs.select(F.col("doc_id").alias("d"), F.xxhash64("text").alias("f"), words(F.col("text")).alias("w"))
    found = []
    if window in spans_n:
        found.append(_met(text, fingerprints(text, window, gram), prints, "fp", window))
    for n in sorted(spans_n - {window}):
        own = stash(_hashed(item.where(F.size("w") == n), "h", n).select(F.get("h", F.lit(0)).alias("fp")).distinct())
        runs = _hashed(text, "h", n).select("d", "f", "w", F.posexplode("h").alias("i", "fp")).withColumns({"start": F.col("i") + 1, "n": F.lit(n)})
        found.append(_met(text, runs, own, "fp", n))
    if not found:
        found = [text.select("d", "f", F.lit(0).alias("start"), F.lit(0).alias("n"), F.lit("").alias("s")).limit(0)]
    every = found[0]
    for x in found[1:]:
        every = every.unionByName(x)
    every = every.join(spans, ["n", "s"]).groupBy("d", "f").agg(F.sort_array(F.collect_set(F.struct("start", "n"))).alias("at"), F.collect_set("item").alias("items"))
    zero = F.struct(F.lit(0).alias("n"), F.lit(0).alias("end"))
    end = lambda x: x["start"] + x["n"]
    add = lambda acc, x: F.struct((acc["n"] + F.greatest(F.lit(0), end(x) - F.greatest(acc["end"], x["start"]))).alias("n"), F.greatest(acc["end"], end(x)).alias("end"))
    return every.select("d", "f", F.aggregate("at", zero, add)["n"].cast("long").alias("n_hit"), "items")


def contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """(doc_id, n_words, n_hit, items) of every document; items: sorted ids, as strings, of the items with a window there.

    Null and empty texts have no words and hit nothing; null or wordless items
    are never hit.  Items with a null id count for n_hit but are not listed.
    Repeated rows of items count once; repeated documents give a row each.  A
    very long text is winnowed whole.  Empty tables on either side are fine;
    extra columns are not looked at.
    """
    hit = hits(docs, items, window, gram)
    # The words that a text has are as many before A-Z become lower case.
    count = F.size(F.array_remove(F.split(F.coalesce("text", F.lit("")), r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", -1), ""))
    out = docs.select("doc_id", F.xxhash64("text").alias("of"), count.cast("long").alias("n_words"))
    out = out.join(hit, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("of") == F.col("f")), "left")
    ids = F.array_sort(F.transform(F.coalesce("items", F.array().cast(hit.schema["items"].dataType)), lambda x: x.cast("string")))
    return out.select("doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), ids.alias("items"))


def decontaminate(docs: DataFrame, items: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """`docs` without the documents that have a window of an item; all columns as they were."""
    names = [free_name(docs.columns, x) for x in ("lg_d", "lg_f")]
    hit = hits(docs, items, window, gram).select(*[F.col(x).alias(y) for x, y in zip(("d", "f"), names, strict=True)])
    return docs.join(hit, F.col("doc_id").eqNullSafe(F.col(names[0])) & (F.xxhash64("text") == F.col(names[1])), "left_anti")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    n_items, digest = F.size("items").cast("long"), F.sha2(F.array_join("items", ","), 256)
    return out.select("doc_id", "n_words", "n_hit", n_items.alias("n_items"), digest.alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


SQL = r"""
WITH dw AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
iw AS (SELECT item_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark),
ip AS (SELECT item_id, w, least(len(w), 10) AS n, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS i FROM iw WHERE len(w) > 0),
win AS (SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS s FROM ip),
lens AS (SELECT DISTINCT n FROM win),
dp AS (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM dw, lens WHERE len(w) >= n),
dwin AS (SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS s FROM dp),
m AS (SELECT DISTINCT d.doc_id, d.i, d.n, win.item_id FROM dwin d JOIN win USING (n, s)),
pos AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM m) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS ids FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS x FROM m) GROUP BY doc_id)
SELECT dw.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN pos USING (doc_id) LEFT JOIN its USING (doc_id)
"""
