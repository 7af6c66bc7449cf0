"""Personal data: patterns, and terms that reveal the entities found by corpus co-occurrence.  DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumigraph.llm.spans import SPAN, count, let, listed, ordered, replaced, running, spans
from lumigraph.llm.text import ascii_lower
from lumigraph.sources.tables import stash, table

KINDS = ["email", "ip", "card", "phone", "term"]
#: A run that begins inside a run of the same characters could only match what the whole run matches, or what follows a match (\G).
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
#: 16 digits at least; the possessive loop takes all there are.
CARD = r"[0-9](?:[\x20-]?[0-9]){15,}+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
BYTE = r"0*(?:[0-9]|[1-9][0-9]|1[0-9][0-9]|2[0-4][0-9]|25[0-5])"

#: Words and entities on either side of an entity among which a word co-occurs with it.
WINDOW = 100
#: A term discloses an entity if so many texts, with so many different neighbours and as many for each text, hold it by the entity,
#: if that is this share of all texts that hold it, and if it tells so many bits.
CONTEXTS, DIVERSITY, SHARE, BITS = 3, 0.5, 0.8, 4.0
#: So many terms, and so many documents that hold one, are broadcast at most; more are joined by shuffle.
BROADCAST = 100_000
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
GAP = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """Sum of the digits from the right, each second one doubled less 9 if over 9, divides by 10."""
    at = F.sequence(F.lit(1), F.length(digits))
    value = lambda i: F.substring(F.reverse(digits), i, F.lit(1)).cast("int")
    part = lambda i: F.when(i % 2 == 1, value(i)).when(value(i) > 4, 2 * value(i) - 9).otherwise(2 * value(i))
    return F.aggregate(at, F.lit(0), lambda acc, i: acc + part(i)) % 10 == 0


def base(text: Column) -> Column:
    """The spans of the four patterns, by kind, then start."""
    ip = F.filter(spans(text, "ip", IP), lambda s: s["hit"].rlike(rf"^(?:{BYTE}\.){{3}}{BYTE}$"))
    n = lambda s: F.length(_digits(s["hit"]))
    card = F.filter(spans(text, "card", CARD), lambda s: F.when((n(s) >= 16) & (n(s) <= 19), _luhn(_digits(s["hit"]))).otherwise(False))
    phone = F.filter(spans(text, "phone", PHONE), lambda s: (n(s) >= 8) & (n(s) <= 15))
    having = lambda sign, found: F.when(F.instr(text, sign) > 0, found).otherwise(F.array().cast(SPAN))
    return F.concat(having("@", spans(text, "email", EMAIL)), ip, card, having("+", phone))


def _sequence(text: Column, found: Column) -> Column:
    """The text's entities and the words outside them, in order: (kind, hit, c); c is a hash of a word's two neighbours, of entities by their kind.

    Kind is empty for words.  All in lower case.
    """
    row = lambda s, rank: F.struct(s["start"].alias("start"), F.lit(rank).alias("rank"), s["end"].alias("end"), s["kind"].alias("kind"), ascii_lower(s["hit"]).alias("hit"))
    every = F.array_sort(F.concat(F.transform(found, lambda s: row(s, 0)), F.transform(spans(text, "", WORD), lambda s: row(s, 1))))

    def outside(all_: Column) -> Column:
        high = running(F.transform(all_, lambda x: F.when(x["rank"] == 0, x["end"]).otherwise(0)), lambda a, b: F.greatest(a, b), 0)
        return F.filter(F.arrays_zip(all_.alias("x"), high.alias("high")), lambda y: (y["x"]["rank"] == 0) | (y["high"] <= y["x"]["start"]))

    def neighbours(kept: Column) -> Column:
        name = lambda i: F.when(F.get(kept, i)["x"]["rank"] == 0, F.concat(F.lit("@"), F.get(kept, i)["x"]["kind"])).otherwise(F.get(kept, i)["x"]["hit"])
        return F.transform(kept, lambda y, i: F.struct(y["x"]["kind"].alias("kind"), y["x"]["hit"].alias("hit"), F.xxhash64(name(i - 1), name(i + 1)).alias("c")))

    return let(let(every, outside), neighbours)


def terms(docs: DataFrame) -> tuple[DataFrame, DataFrame] | None:
    """((term,) of the terms that disclose an entity, (d, f, term) of the documents that hold a term that may); None without any.

    An entity is the text of a base span that CONTEXTS different texts hold or
    more.  Words within WINDOW places of it, in any of its documents, co-occur
    with it.  A word discloses it if, over the corpus, as many texts have it
    there, with as many different neighbours and DIVERSITY of them for each
    text; if P(entity | word) is SHARE or more; and if log2 of P(entity | word)
    over P(entity) is BITS or more.  All are counted over different texts of all
    documents; neighbours are looked at so that a text copied many times, with
    a word changed here and there, discloses nothing by that.
    """
    text = F.coalesce("text", F.lit(""))
    held = docs.select(F.xxhash64("text").alias("f"), text.alias("t"), base(text).alias("spans")).where(F.size("spans") > 0)
    entity = lambda s: F.concat_ws(":", s["kind"], ascii_lower(s["hit"]))
    held = stash(held.withColumn("entities", F.array_distinct(F.transform("spans", entity))))
    known = held.select("f", F.explode("entities").alias("entity")).distinct().groupBy("entity").agg(F.count("*").alias("of_entity")).where(F.col("of_entity") >= CONTEXTS)
    known = stash(known)
    few = known.limit(BROADCAST + 1).count()
    if not few:
        return None
    small = F.broadcast(known) if few <= BROADCAST else known
    again = held.select("f", F.explode("entities").alias("entity")).join(small, "entity", "left_semi").select("f").distinct()
    row = held.join(again, "f", "left_semi").dropDuplicates(["f"]).select("f", _sequence(F.col("t"), F.col("spans")).alias("s"))
    row = stash(row)
    at = F.filter(F.sequence(F.lit(1), F.size("s")), lambda i: F.get("s", i - 1)["kind"] != "")
    seen = row.select("f", "s", F.explode(at).alias("i"))
    name = F.concat_ws(":", F.get("s", F.col("i") - 1)["kind"], F.get("s", F.col("i") - 1)["hit"])
    around = F.filter(F.slice("s", F.greatest(F.col("i") - WINDOW, F.lit(1)), F.col("i") + WINDOW - F.greatest(F.col("i") - WINDOW, F.lit(1)) + 1), lambda x: x["kind"] == "")
    seen = seen.select("f", name.alias("entity"), around.alias("around")).join(small, "entity")
    near = seen.select("f", "entity", "of_entity", F.explode("around").alias("x")).select("f", "entity", "of_entity", F.col("x.hit").alias("term"), F.col("x.c").alias("c"))
    near = near.groupBy("entity", "of_entity", "term").agg(F.countDistinct("c").alias("contexts"), F.countDistinct("f").alias("together"))
    near = near.where((F.col("together") >= CONTEXTS) & (F.col("contexts") >= CONTEXTS) & (F.col("contexts") >= DIVERSITY * F.col("together")))
    # A word in too many of the texts with any entity can't have the share over all: so go the common words.
    own = F.array_distinct(F.transform(F.filter("s", lambda x: x["kind"] == ""), lambda x: x["hit"]))
    inside = row.select("f", F.explode(own).alias("term")).groupBy("term").agg(F.count("*").alias("inside"))
    near = stash(near.join(inside, "term").where(F.col("together") >= SHARE * F.col("inside")))
    maybe = near.select("term").distinct()
    few = maybe.limit(BROADCAST + 1).count()
    if not few:
        return None
    words = F.array_distinct(F.split(ascii_lower(text), GAP, -1))
    every = docs.select(F.col("doc_id").alias("d"), F.xxhash64("text").alias("f"), F.explode(words).alias("term"))
    every = stash(every.join(F.broadcast(maybe) if few <= BROADCAST else maybe, "term", "left_semi").distinct())
    n = docs.select(F.xxhash64("text").alias("f")).distinct().count()
    of_term = every.select("f", "term").distinct().groupBy("term").agg(F.count("*").alias("of_term"))
    share = F.col("together") / F.col("of_term")
    risky = near.join(of_term, "term").where((share >= SHARE) & (F.log2(share * n / F.col("of_entity")) >= BITS))
    return risky.select("term").distinct(), every


def disclosing(docs: DataFrame) -> DataFrame:
    """(d, f, terms): the terms of each document, as doc_id and hash of the text, that reveal an entity; few documents have any."""
    found = terms(docs)
    if found is None:
        return docs.select(F.col("doc_id").alias("d"), F.xxhash64("text").alias("f"), F.array(F.lit("")).alias("terms")).limit(0)
    risky, every = found
    return every.join(risky, "term").groupBy("d", "f").agg(F.collect_set("term").alias("terms"))


def find(docs: DataFrame) -> DataFrame:
    """(doc_id, text, base, spans) of every row: arrays of (kind, start, end, hit, part), by kind, then start.

    `spans` adds to `base` the disclosing terms of the text, kind `term`, where
    they are whole words outside base spans.

    A null text is empty and has no spans; a very long one is matched whole, in
    time that grows with its length times the logarithm of its matches.
    Repeated rows give a row each and count once; values at a threshold pass it;
    an empty table gives no rows; extra columns are not looked at.
    """
    risky = stash(disclosing(docs))
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", "text", F.xxhash64("text").alias("of"))
    risky = F.broadcast(risky) if risky.agg(F.coalesce(F.sum(F.size("terms")), F.lit(0))).first()[0] <= BROADCAST else risky
    rows = rows.join(risky, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("of") == F.col("f")), "left")
    rows = rows.withColumn("base", base(text))
    edge = "A-Za-z0-9" + r"\x{80}-\x{10FFFF}"
    pattern = F.concat(F.lit(f"(?i)(?<![{edge}])(?:"), F.array_join(F.array_sort("terms"), "|"), F.lit(f")(?![{edge}])"))  # words hold no character that a pattern reads otherwise
    more = F.when(F.col("terms").isNotNull(), spans(text, "term", pattern)).otherwise(F.array().cast(SPAN))
    outside = F.filter(more, lambda s: ~F.exists("base", lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"])))
    return rows.select("doc_id", "text", "base", ordered(F.concat("base", outside), KINDS, False).alias("spans"))


def sanitised(docs: DataFrame) -> DataFrame:
    """(doc_id, text): base spans and worded terms replaced by their kind in brackets, terms with digits generalised to # for each digit."""
    kind = lambda s: F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]"))
    by = lambda s: F.when((s["kind"] == "term") & s["hit"].rlike("[0-9]"), F.regexp_replace(s["hit"], "[0-9]", "#")).otherwise(kind(s))
    return find(docs).select("doc_id", replaced(F.col("text"), F.col("spans"), by).alias("text"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = find(table(spark, sf_dir, "documents"))
    b = F.col("base")
    return out.select("doc_id", *[count(b, k).alias(f"n_{k}") for k in KINDS[:4]], F.sha2(listed(b), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))


SQL = None
