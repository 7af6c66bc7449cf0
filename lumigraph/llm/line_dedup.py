"""Line dedup: lines that many documents share stay in one document only.  DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumigraph.llm.text import SPACE, ascii_lower, free_name
from lumigraph.sources.tables import stash, table

MIN_CHARS, MIN_DOCS = 40, 5
#: Keys that are broadcast, at most (24 bytes each); of more, the most frequent are broadcast and the rest, none of which is frequent, shuffled.
BROADCAST_KEYS = 100_000
#: Positions to drop, by document, are broadcast up to so many bytes; more meet the texts by a shuffle.  What a document takes besides its positions.
BROADCAST_DROPS, ROW_BYTES = 32 << 20, 64


def dedup_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, stats: str | None = None) -> DataFrame:
    """`docs` with repeated lines taken out of `text`; all other columns as they were.

    A line's key is the line stripped of white space at both ends, A-Z in lower
    case.  Keys of at least `min_chars` code points found in at least `min_docs`
    documents lose all their lines except in the largest doc_id that holds
    them.  `stats` names a struct column (n_lines, n_dropped) to add.

    Lines are exploded with their position and hashed to 128 bits; documents
    are counted per hash after a distinct per document, so that no hash
    gathers rows, and the most frequent hashes meet the lines by broadcast, so
    that none is a hot key; positions to drop meet their document again in one
    join, and the text is reassembled from the positions that remain.

    Null or empty texts are one empty line and stay as they are.  Rows with one
    doc_id are one document.  A null doc_id is one document, smaller than all
    others.  Documents without a dropped line keep their text byte for byte;
    one whose lines all go stays, with an empty text.  A very long text is
    split whole; its lines are rows like others, and only their positions, four
    bytes each, meet again.  An empty table gives an empty table.  Extra
    columns, whatever their names, pass through.
    """
    row = docs.select(F.col("doc_id").alias("d"), F.xxhash64("text").alias("f"), F.coalesce("text", F.lit("")).alias("t"))
    lines = row.select("d", "f", F.posexplode(F.split("t", "\n", -1)).alias("pos", "line"))
    lines = lines.select("d", "f", "pos", ascii_lower(F.btrim("line", F.lit(SPACE))).alias("key")).where(F.length("key") >= min_chars)
    lines = lines.select("d", "f", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), "key").alias("h2"))
    common = lines.select("h1", "h2", "d").distinct().groupBy("h1", "h2").agg(F.count("*").alias("n"), F.max("d").alias("stays")).where(F.col("n") >= min_docs)
    common = stash(common)
    many = common.count() > BROADCAST_KEYS
    frequent = F.broadcast(common.orderBy(F.desc("n"), "h1", "h2").limit(BROADCAST_KEYS) if many else common)
    held = lines.join(frequent, ["h1", "h2"])
    if many:
        held = held.unionByName(lines.join(frequent, ["h1", "h2"], "left_anti").join(common, ["h1", "h2"]))
    drops = held.where(F.col("d").isNull() | (F.col("d") != F.col("stays"))).groupBy("d", "f").agg(F.collect_set("pos").alias("gone"))

    names = [free_name(docs.columns, x) for x in ("lg_lines", "lg_print", "lg_doc", "lg_gone")]
    split, mark, doc, gone = names
    drops = stash(drops.select(F.col("d").alias(doc), F.col("f").alias(mark + "_"), F.col("gone").alias(gone)))
    held = drops.agg(F.coalesce(F.sum(ROW_BYTES + 4 * F.size(gone)), F.lit(0))).first()[0]
    drops = F.broadcast(drops) if held <= BROADCAST_DROPS else drops
    out = docs.withColumn(mark, F.xxhash64("text")).join(drops, F.col("doc_id").eqNullSafe(F.col(doc)) & (F.col(mark) == F.col(mark + "_")), "left")
    out = out.withColumn(split, F.split(F.coalesce("text", F.lit("")), "\n", -1))
    kept = F.array_except(F.sequence(F.lit(0), F.size(split) - 1), F.col(gone))
    text = F.when(F.col(gone).isNull(), F.col("text")).otherwise(F.array_join(F.transform(kept, lambda i: F.get(F.col(split), i)), "\n"))
    columns = [text.alias("text") if x == "text" else F.col(f"`{x}`") for x in docs.columns]
    if stats:
        columns.append(F.struct(F.size(split).cast("long").alias("n_lines"), F.coalesce(F.size(gone), F.lit(0)).cast("long").alias("n_dropped")).alias(stats))
    return out.select(*columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"), stats="info")
    return out.select("doc_id", "info.n_lines", "info.n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


SQL = r"""
WITH docs AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
parts AS (SELECT doc_id, unnest(ls) AS line, unnest(range(len(ls))) AS pos FROM docs),
keyed AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                              'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM parts),
common AS (SELECT k, max(doc_id) AS stays FROM keyed WHERE length(k) >= 40 GROUP BY k HAVING count(DISTINCT doc_id) >= 5),
marked AS (SELECT p.doc_id, p.line, p.pos, c.k IS NOT NULL AND p.doc_id <> c.stays AS gone FROM keyed p LEFT JOIN common c ON p.k = c.k)
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (gone)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
