"""Spelling variants: each word's distance-one neighbours, found in shards of a compact trie, and its most usual form.

The vocabulary is sorted into ranges; a task makes a trie of each.  The tries are
broadcast a group at a time, and every word's Levenshtein automaton for one edit
is run against each of them, depth first.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumigraph.llm.text import LOWER, UPPER
from lumigraph.sources.tables import stash, stash_each, table

RUN, REST = re.compile("[A-Za-zÀ-ÿ]+"), re.compile("[^A-Za-zÀ-ÿ]")
_FOLD = str.maketrans(UPPER, LOWER)
MIN_CHARS, MIN_COUNT, FACTOR, DROP_ONE_OF = 6, 5, 5, 199
#: Words of a trie (some 25 bytes each), bytes of tries that are broadcast together, and words that one task looks up.
SHARD, GROUP_BYTES, TASK = 100_000, 32 << 20, 10_000
#: Different words that a task counts before it hands them on, and code points of a text looked at together.
HELD, PART = 200_000, 1 << 20
FOUND = "word string, n long, n_near long, form string, form_n long"


def parts(text: str) -> Iterator[str]:
    """The text in parts of about PART code points, cut where no word is."""
    at = 0
    while len(text) - at > 2 * PART:
        cut = REST.search(text, at + PART)
        end = cut.start() if cut else len(text)
        yield text[at:end]
        at = end
    yield text[at:]


def altered(doc_id: str, run: str) -> str:
    """The lower-cased run, or where the sum over it and its document says so, the run without one code point."""
    h = zlib.crc32(f"{doc_id}:{run}".encode())
    if h % DROP_ONE_OF:
        return run
    return run[: h % len(run)] + run[h % len(run) + 1 :]


def counted(docs: DataFrame, min_chars: int = MIN_CHARS, min_count: int = MIN_COUNT) -> DataFrame:
    """(word, n): words of at least `min_chars` code points that occur `min_count` times at least."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[str] = Counter()
        for batch in batches:
            for doc, text in zip(batch.column("doc_id"), batch.column("text"), strict=True):
                doc, text = doc.as_py(), text.as_py()
                name = "" if doc is None else str(doc)
                for part in parts(text or ""):
                    for run, n in Counter(RUN.findall(part)).items():
                        if len(run) >= min_chars:
                            word = altered(name, run.translate(_FOLD))
                            if len(word) >= min_chars:
                                held[word] += n
                    if len(held) > HELD:
                        yield pa.RecordBatch.from_pydict({"word": list(held), "n": list(held.values())})
                        held.clear()
        yield pa.RecordBatch.from_pydict({"word": pa.array(list(held), pa.string()), "n": pa.array(list(held.values()), pa.int64())})

    each = docs.select("doc_id", "text").mapInArrow(count, "word string, n long")
    return each.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= min_count)


class Trie:
    """Words as Latin-1 bytes in a trie whose nodes lie level by level: the children of a node side by side, by label.

    `label` has a byte for each node, `first` the first child of each (its last
    one comes before the next node's first), `count` the n of the word that
    ends there, or 0.
    """

    def __init__(self, label: bytes, first: array, count: array):
        self.label, self.first, self.count = label, first, count

    @classmethod
    def of(cls, words: list[bytes], counts: list[int]) -> Trie:
        """From different words in ascending order."""
        label, first, count = bytearray(b"\0"), array("I"), array("q", [0])
        level = [(0, len(words))]  # the words below each node of the level
        depth = 0
        while level:
            below = []
            for start, end in level:
                first.append(len(label))
                if len(words[start]) == depth:  # a word that ends here comes first
                    count[len(first) - 1] = counts[start]
                    start += 1
                while start < end:
                    c, stop = words[start][depth], start + 1
                    while stop < end and words[stop][depth] == c:
                        stop += 1
                    label.append(c)
                    count.append(0)
                    below.append((start, stop))
                    start = stop
            level, depth = below, depth + 1
        first.append(len(label))
        return cls(bytes(label), first, count)

    def dump(self) -> tuple[bytes, bytes, bytes]:
        return self.label, self.first.tobytes(), self.count.tobytes()

    @classmethod
    def load(cls, label: bytes, first: bytes, count: bytes) -> Trie:
        return cls(label, array("I", first), array("q", count))

    def near(self, word: bytes) -> dict[bytes, int]:
        """The words at one edit from `word`, with their counts.

        A state is a node, how much of the word is used up and whether an edit
        was made; from a state with an edit there is one way on, to the end.
        """
        label, first, count, size = self.label, self.first, self.count, len(word)
        out: dict[bytes, int] = {}

        def end(node: int, at: int) -> int:
            """The count of the word at the end of the way along word[at:] from `node`; 0 if there is none."""
            while at < size:
                node = label.find(word[at], first[node], first[node + 1])
                if node < 0:
                    return 0
                at += 1
            return count[node]

        node = at = 0
        while node >= 0:  # along the word itself; from each state every edit is tried
            if at < size and (n := end(node, at + 1)):
                out[word[:at] + word[at + 1 :]] = n
            same = -1
            own = word[at] if at < size else -1
            for child in range(first[node], first[node + 1]):
                c = label[child]
                if c == own:
                    same = child
                elif at < size and (n := end(child, at + 1)):
                    out[word[:at] + bytes((c,)) + word[at + 1 :]] = n
                if n := end(child, at):
                    out[word[:at] + bytes((c,)) + word[at:]] = n
            node, at = same, at + 1
        return out


def tries(words: DataFrame, shard: int = SHARD) -> DataFrame:
    """(label, first, count): tries of `shard` words at most, over ranges of the words (word, n).

    A task takes some neighbouring ranges, so that tries are few however many
    partitions a sort has.
    """
    many = words.count()

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names: list[bytes] = []
        counts: list[int] = []

        def made() -> pa.RecordBatch:
            row = Trie.of(*zip(*sorted(zip(names, counts, strict=True)), strict=True)).dump()
            return pa.RecordBatch.from_pydict({k: pa.array([v], pa.binary()) for k, v in zip(("label", "first", "count"), row, strict=True)})

        for batch in batches:
            for word, n in zip(batch.column("word").to_pylist(), batch.column("n").to_pylist(), strict=True):
                names.append(word.encode("latin-1"))
                counts.append(n)
                if len(names) == shard:
                    yield made()
                    names, counts = [], []
        if names:
            yield made()

    return words.sort("word").coalesce(max(1, -(-many // shard))).mapInArrow(build, "label binary, first binary, count binary")


def neighbours(words: DataFrame, shard: int = SHARD, group_bytes: int = GROUP_BYTES, factor: int = FACTOR) -> DataFrame:
    """FOUND of each word (word, n): how many words are near, the most frequent of them (ties: the smallest), and its n.

    Tries meet all words a group at a time; a group has `group_bytes` at most,
    or one trie, so that what the driver and a task hold doesn't grow with the
    vocabulary.  Words have code points up to U+00FF.
    """
    spark, many = words.sparkSession, words.count()
    shards = stash(tries(words, shard).withColumn("id", F.monotonically_increasing_id()))
    groups: list[list[int]] = []
    left = 0
    for row in shards.select("id", F.expr("length(label) + length(first) + length(count)").alias("size")).orderBy("id").toLocalIterator():
        if not groups or row["size"] > left:
            groups.append([])
            left = group_bytes
        groups[-1].append(row["id"])
        left -= row["size"]
    dealt = words.repartition(max(1, -(-many // TASK)), "word")

    def look_up(group: list[int]) -> DataFrame:
        own = shards.where(F.col("id").between(group[0], group[-1])).select("label", "first", "count").collect()
        sent = spark.sparkContext.broadcast([tuple(bytes(x) for x in row) for row in own])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            loaded = [Trie.load(*x) for x in sent.value]
            for batch in batches:
                rows = []
                for word, n in zip(batch.column("word").to_pylist(), batch.column("n").to_pylist(), strict=True):
                    near: dict[bytes, int] = {}
                    for trie in loaded:
                        near |= trie.near(word.encode("latin-1"))
                    form, most = min(near.items(), key=lambda x: (-x[1], x[0]), default=(None, None))
                    rows.append((word, n, len(near), form and form.decode("latin-1"), most))
                columns = zip(*rows, strict=True) if rows else [()] * 5
                kinds = (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["word", "n", "n_near", "form", "form_n"])

        return dealt.mapInArrow(run, FOUND)

    found = stash_each(spark, (look_up(g) for g in groups), FOUND)
    if len(groups) > 1:
        best = F.min(F.when(F.col("form").isNotNull(), F.struct((-F.col("form_n")).alias("less"), "form", "form_n")))
        found = found.groupBy("word", "n").agg(F.sum("n_near").alias("n_near"), best.alias("best")).select("word", "n", "n_near", "best.form", "best.form_n")
    holds = F.col("form_n") >= factor * F.col("n")
    return found.select("word", "n", "n_near", *[F.when(holds, F.col(c)).alias(c) for c in ("form", "form_n")])


def rooted(found: DataFrame, factor: int = FACTOR) -> DataFrame:
    """`found` with `root`: where a word's form, that one's form and so on end; the word itself if it has no form.

    The n of each is `factor` times that of the one before at least, which
    bounds the length of a way; every round doubles how far the known part of
    it reaches.
    """
    ways = stash(found.where("form IS NOT NULL").select("word", F.col("form").alias("root")))
    most = found.agg(F.max("form_n")).first()[0] or 0
    steps, reach = 0, 1
    while most >= factor ** (steps + 1):
        steps += 1
    while reach < steps:
        on = ways.select(F.col("word").alias("lg_word"), F.col("root").alias("lg_root"))
        ways = stash(ways.join(on, F.col("root") == F.col("lg_word"), "left").select("word", F.coalesce("lg_root", "root").alias("root")))
        reach *= 2
    return found.join(ways, "word", "left").withColumn("root", F.coalesce("root", "word"))


def variants(docs: DataFrame, min_chars: int = MIN_CHARS, min_count: int = MIN_COUNT, factor: int = FACTOR, shard: int = SHARD, group_bytes: int = GROUP_BYTES) -> DataFrame:
    """(word, n, n_near, form, form_n, root) of all words of the texts of `docs` (doc_id, text).

    Words are maximal runs of A-Z, a-z and U+00C0 to U+00FF, A-Z in lower case;
    one in DROP_ONE_OF pairs of document and word loses a code point first, as
    `altered` says.  A word's form is the near word with the largest n, of
    several the first by code points, if its n is at least `factor` times the
    word's own; `n_near` counts near words of any n.

    Null and empty texts have no words.  A null doc_id counts as an empty name.
    Each of several equal rows counts.  Long texts are read whole, in parts; an
    empty table has no words; columns beside doc_id and text are not looked at.
    """
    words = stash(counted(docs, min_chars, min_count))
    return rooted(stash(neighbours(words, shard, group_bytes, factor)), factor).select("word", "n", "n_near", "form", "form_n", "root")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants(table(spark, sf_dir, "documents"))


#: The checksum goes byte by byte through a table of 256 entries that follow from its polynomial; near words meet by what is left when a code point goes.
SQL = r"""
WITH RECURSIVE bits AS (SELECT i, i::BIGINT AS v, 0 AS k FROM range(256) t(i)
  UNION ALL SELECT i, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END, k + 1 FROM bits WHERE k < 8),
tab AS (SELECT list(v ORDER BY i) AS t FROM bits WHERE k = 8),
runs AS (SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-z\x{C0}-\x{FF}]+')),
                                  'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS w FROM documents),
pairs AS (SELECT hex(encode(coalesce(doc_id::VARCHAR, '') || ':' || w)) AS x, w, count(*) AS n FROM runs WHERE length(w) >= 6 GROUP BY 1, 2),
summed AS (SELECT w, n, xor(list_reduce(list_transform(range(1, length(x)::BIGINT, 2), lambda i: ('0x' || substr(x, i, 2))::BIGINT),
                            lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1]), 4294967295), 4294967295) AS h FROM pairs, tab),
words AS (SELECT CASE WHEN h % 199 = 0 THEN substr(w, 1, h % length(w)) || substr(w, h % length(w) + 2) ELSE w END AS word, sum(n)::BIGINT AS n FROM summed GROUP BY 1),
v AS (SELECT word, n FROM words WHERE length(word) >= 6 AND n >= 5),
cut AS (SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS d FROM (SELECT *, unnest(range(1, length(word) + 1)) AS i FROM v)),
near AS (SELECT a.word, a.n, b.word AS other, b.n AS m FROM cut a JOIN cut b ON a.i = b.i AND a.d = b.d AND a.word <> b.word
  UNION SELECT a.word, a.n, b.word, b.n FROM cut a JOIN v b ON a.d = b.word
  UNION SELECT b.word, b.n, a.word, a.n FROM cut a JOIN v b ON a.d = b.word),
best AS (SELECT word, count(*) AS n_near FROM near GROUP BY 1),
pick AS (SELECT DISTINCT ON (word) word, other, m FROM near ORDER BY word, m DESC, other),
found AS (SELECT v.word, v.n, coalesce(b.n_near, 0) AS n_near, CASE WHEN p.m >= 5 * v.n THEN p.other END AS form, CASE WHEN p.m >= 5 * v.n THEN p.m END AS form_n
  FROM v LEFT JOIN best b USING (word) LEFT JOIN pick p USING (word)),
way AS (SELECT word, word AS at FROM found UNION ALL SELECT w.word, f.form FROM way w JOIN found f ON w.at = f.word WHERE f.form IS NOT NULL),
ends AS (SELECT w.word, w.at AS root FROM way w JOIN found f ON w.at = f.word WHERE f.form IS NULL)
SELECT f.word, f.n, f.n_near::BIGINT AS n_near, f.form, f.form_n::BIGINT AS form_n, e.root FROM found f JOIN ends e USING (word)
"""
