"""Secret scans: patterns, and a battery of randomness tests with false-discovery control.  DataFrame functions only."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lumigraph.llm.spans import count, let, listed, ordered, replaced, spans
from lumigraph.sources.tables import stash, table

KINDS = ["assign", "access", "hex", "random"]
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: Runs of at least so many characters are as good as longer runs with the rest dropped: a run is matched whole or not at all.
ACCESS, HEX = r"AKIA[A-Z0-9]{12,}+", r"[0-9a-f]{32,}+"
CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}+"

#: Encodings in the order in which they are inferred: which tokens, the characters, and what structured text of that alphabet is taken to be like:
#: the chances that two, and that three, of its characters are equal (ten digits; letters as in prose), and that the kind of character changes from one to the next.
ENCODINGS = (
    ("hex", r"^[0-9a-f]+$|^[0-9A-F]+$", "0123456789abcdef", 0.1, 0.01, 0.12),
    ("base32", r"^[A-Z2-7]+=*$", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", 0.065, 0.0054, 0.12),
    ("base36", r"^[0-9a-z]+$|^[0-9A-Z]+$", "0123456789abcdefghijklmnopqrstuvwxyz", 0.065, 0.0054, 0.12),
    ("base64", r"", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", 0.05, 0.0035, 0.33),
)
#: Kinds of characters.
CLASSES = ("0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "+/")
#: Lower ends of the length classes, level of the false discovery rate in each, and p under which the battery refuses a token as not random.
LENGTHS, LEVEL, REFUSED = (20, 24, 32, 48, 80), 0.05, 1e-4
#: Bins of -log10 p, each a tenth wide.
BINS = 300


def upper_tail(z: Column) -> Column:
    """P(Z > z) of a normal Z, to a relative error of about 1e-7 in either tail (Chebyshev fit of erfc, fixed values)."""
    x = F.abs(z) / F.lit(2.0**0.5)
    t = 1 / (1 + x / 2)
    fit = F.lit(0.17087277)
    for c in (-0.82215223, 1.48851587, -1.13520398, 0.27886807, -0.18628806, 0.09678418, 0.37409196, 1.00002368, -1.26551223):
        fit = fit * t + c
    half = t * F.exp(fit - x * x) / 2
    return F.when(z >= 0, half).otherwise(1 - half)


def fisher(*ps: Column) -> Column:
    """p of several independent p-values together: of -2 times the sum of their logarithms, by chi-squared with two degrees of freedom for each."""
    t = sum((-F.ln(F.greatest(p, F.lit(1e-300))) for p in ps), F.lit(0.0))
    series = F.lit(1.0)
    for k in reversed(range(1, len(ps))):
        series = 1 + series * t / k
    return F.exp(-t) * series


def _encoding(value: Column) -> Column:
    """(alphabet, pair, triple, change, random_change) of the first encoding that the token's characters allow."""

    def row(_: str, __: str, alphabet: str, pair: float, triple: float, change: float) -> Column:
        share = [sum(c in alphabet for c in kind) / len(alphabet) for kind in CLASSES]
        values = {"alphabet": alphabet, "pair": pair, "triple": triple, "change": change, "random_change": 1 - sum(x * x for x in share)}
        return F.struct(*[F.lit(v).alias(k) for k, v in values.items()])

    out = row(*ENCODINGS[-1])
    for e in reversed(ENCODINGS[:-1]):
        out = F.when(value.rlike(e[1]), row(*e)).otherwise(out)
    return out


def _battery(n: Column, k: Column, e: Column, at: Column, kinds: Column) -> Column:
    """The tests of a token of n characters, k in the alphabet: their places in it, counted from its middle, and their kinds."""
    total = lambda xs, f: F.aggregate(xs, F.lit(0.0), lambda acc, x: acc + f(x))
    both = lambda xs, f: F.zip_with(F.slice(xs, 1, F.size(xs) - 1), F.slice(xs, 2, F.size(xs) - 1), f)
    squares = total(F.array_distinct(at), lambda c: F.pow(F.size(F.filter(at, lambda x: x == c)).cast("double"), F.lit(2.0)))
    steps = n - 1
    # Each fold over the characters is done once; formulas name its result.
    sums = {
        "squares": squares,
        "changes": total(both(kinds, lambda a, b: F.when(a != b, 1.0).otherwise(0.0)), lambda x: x),
        "turns": total(both(at, lambda a, b: F.when((a < 0) != (b < 0), 1.0).otherwise(0.0)), lambda x: x),
        "mean": total(at, lambda x: x) / n,
        "power": total(at, lambda x: x * x),
        "lagged": total(both(at, lambda a, b: a * b), lambda x: x),
    }

    def tests(s: Column) -> Column:
        # Randomness: chi-squared over the alphabet (its cube root is nearly normal), runs about the middle, changes of kind, serial correlation.
        chi, free = k * s["squares"] / n - n, k - 1
        cube = (F.pow(F.greatest(chi, F.lit(0.0)) / free, F.lit(1 / 3)) - (1 - 2 / (9 * free))) / F.sqrt(2 / (9 * free))
        mean, free_change, rate, usual = s["mean"], e["random_change"], s["changes"] / steps, e["change"]
        serial = (s["lagged"] - steps * mean * mean) / F.greatest(s["power"] - n * mean * mean, F.lit(1e-9)) * F.sqrt(n)
        z_turns = (s["turns"] - steps / 2) / F.sqrt(steps / 4)
        z_changes = (s["changes"] - steps * free_change) / F.sqrt(steps * free_change * (1 - free_change))
        # Structure: so few equal characters (mean and variance of the count of pairs), and so many changes of kind (a bound on a binomial tail:
        # Stirling's on its first term, and a geometric series for the rest).
        spread = F.sqrt(2 * n * steps * (e["pair"] - e["pair"] * e["pair"]) + 4 * n * steps * (n - 2) * (e["triple"] - e["pair"] * e["pair"]))
        distance = rate * F.ln(rate / usual) + (1 - rate) * F.ln((1 - rate) / (1 - usual))
        series = F.sqrt(F.lit(2 * math.pi) * steps * rate * (1 - rate)) * (1 - (1 - rate) * usual / (rate * (1 - usual)))
        mixed = F.when(rate <= usual, 1.0).when(rate >= 1, F.pow(usual, steps)).otherwise(F.least(F.exp(-steps * distance) / series, F.lit(1.0)))
        scores = {"cube": cube, "turns": F.abs(z_turns), "changes": F.abs(z_changes), "serial": F.abs(serial), "alike": (n + n * steps * e["pair"] - s["squares"]) / spread}
        return let(F.struct(*[v.alias(x) for x, v in scores.items()], mixed.alias("mixed")), combined)

    def combined(z: Column) -> Column:
        twice = lambda name: F.least(2 * upper_tail(z[name]), F.lit(1.0))  # noqa: E731  two-sided
        tails = {"cube": upper_tail(z["cube"]), "turns": twice("turns"), "changes": twice("changes"), "serial": twice("serial"), "alike": upper_tail(z["alike"])}
        p = F.struct(*[v.alias(x) for x, v in tails.items()], z["mixed"].alias("mixed"))
        return let(p, lambda p: F.when((n < 16) | (fisher(p["cube"], p["turns"], p["changes"], p["serial"]) < REFUSED), 1.0).otherwise(fisher(p["alike"], p["mixed"])))

    return let(F.struct(*[v.alias(x) for x, v in sums.items()]), tests)


def randomness(value: Column) -> Column:
    """p of a token under the hypothesis that it is structured text; 1 if the battery refuses it as random.

    In the encoding that its characters allow, a token is first held against
    randomness: chi-squared uniformity over the alphabet, runs about the
    alphabet's middle, changes of the kind of character, and serial
    correlation, combined by Fisher's method.  What passes is held against
    structure, in which characters repeat and kinds come in blocks: the count
    of equal pairs behind chi-squared and the runs of kinds, combined again.
    Both of these p-values fall with length.
    """

    def tested(x: Column) -> Column:
        t = F.when(x["e"]["alphabet"] == F.lower(x["e"]["alphabet"]), F.lower(x["t"])).otherwise(x["t"])
        middle = (F.length(x["e"]["alphabet"]) + 1) / 2
        chars = F.split(t, "")
        at = F.transform(chars, lambda c: F.instr(x["e"]["alphabet"], c).cast("double") - middle)
        kind = lambda c: F.when(c.between("0", "9"), 0).when(c.between("a", "z"), 1).when(c.between("A", "Z"), 2).otherwise(3)
        size = lambda c, name: F.length(c).cast("double").alias(name)
        facts = F.struct(x["e"].alias("e"), size(t, "n"), size(x["e"]["alphabet"], "k"), at.alias("at"), F.transform(chars, kind).alias("kinds"))
        return let(facts, lambda y: _battery(y["n"], y["k"], y["e"], y["at"], y["kinds"]))

    plain = F.regexp_replace(F.translate(value, "-_", "+/"), "=+$", "")
    return let(_encoding(value), lambda e: let(F.struct(plain.alias("t"), e.alias("e")), tested))


def _bin(p: Column) -> Column:
    return F.least(F.floor(-10 * F.log10(F.greatest(p, F.lit(1e-40)))), F.lit(BINS)).cast("int")


def _length_class(n: Column) -> Column:
    return sum((F.when(n >= low, 1).otherwise(0) for low in LENGTHS), F.lit(-1))


def base(text: Column) -> Column:
    """The spans of the three patterns."""
    assigned = F.filter(spans(text, "assign", ASSIGN, 1), lambda s: F.length(s["part"]) >= 8)
    return F.concat(assigned, spans(text, "access", ACCESS), spans(text, "hex", HEX))


def scan(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """(*keep, base, spans) of every row: arrays of (kind, start, end, hit, part), ordered by start, then kind.

    `spans` adds to `base` those runs of 20 characters or more, outside all base
    spans, that the battery takes for random.  Their p-values, over all
    documents and by class of lengths, pass the step-up rule of Benjamini and
    Hochberg at LEVEL; the rule needs only counts of different tokens by length
    class and bin of p, a table of fixed size.  A token counts once, however
    many documents repeat it.

    A null text is empty and has no spans; a very long one is matched whole,
    and a token of any length is tested whole.  Tokens of equal p pass or fail
    together.  Repeated rows give a row each; an empty table gives no rows;
    extra columns are not looked at.
    """
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(F.struct(*keep).alias("kept"), base(text).alias("base"), spans(text, "random", CANDIDATE).alias("more"))
    outside = F.filter("more", lambda s: ~F.exists("base", lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"])))
    rows = rows.withColumn("more", outside)
    fields = lambda s: [s[x].alias(x) for x in ("kind", "start", "end", "hit", "part")]
    tested = lambda s: F.struct(*fields(s), _length_class(F.length(s["hit"])).alias("size"), _bin(randomness(s["hit"])).alias("bin"))
    rows = stash(rows.withColumn("more", F.transform("more", tested)))
    seen = rows.select(F.explode("more").alias("s")).select("s.size", "s.bin", F.xxhash64("s.hit").alias("token")).distinct().groupBy("size", "bin").agg(F.count("*").alias("n"))
    down = Window.partitionBy("size").orderBy(F.desc("bin"))
    rule = seen.withColumn("so_far", F.sum("n").over(down)).withColumn("all", F.sum("n").over(Window.partitionBy("size")))
    rule = rule.where(F.pow(F.lit(10.0), -F.col("bin") / 10) <= LEVEL * F.col("so_far") / F.col("all")).groupBy("size").agg(F.min("bin").alias("least"))
    least = {r["size"]: r["least"] for r in rule.collect()}  # one row for each of the length classes
    passes = lambda s: sum((F.when((s["size"] == k) & (s["bin"] >= v), 1).otherwise(0) for k, v in least.items()), F.lit(0)) > 0
    added = F.transform(F.filter("more", passes), lambda s: F.struct(*fields(s)))
    order = lambda x: ordered(x, KINDS, True)
    return rows.select("kept.*", order(F.col("base")).alias("base"), order(F.concat("base", added)).alias("spans"))


def redact(docs: DataFrame) -> DataFrame:
    """(doc_id, text) with each secret replaced by its kind in brackets."""
    by = lambda s: F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]"))
    return scan(docs, ("doc_id", "text")).select("doc_id", replaced(F.col("text"), F.col("spans"), by).alias("text"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = scan(table(spark, sf_dir, "documents"))
    b = F.col("base")
    counts = [count(b, k).alias(f"n_{k}") for k in KINDS[:3]]
    return out.select("doc_id", *counts, F.sha2(listed(b), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))


SQL = None
