"""Secrets: fixed patterns, and character Markov models of random strings and ordinary identifiers.

DataFrame functions only.  Texts are cut into pieces of some thousand characters where no match can go on, so the
work grows with a text's length however many hits it has.  One pass over the pieces keeps the matches of each
pattern; the models are trained on these matches and then judge the strings that touch no pattern.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberscope.llm.shared import stage

# The patterns of the contract, in its order.
PATTERNS = {
    "assign": r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    "access": r"AKIA[A-Z0-9]+",
    "hex": r"[0-9a-f]+",
}
LEAST = {"assign": 6, "access": 20, "hex": 24}
#: The same matches without those too short: such runs are maximal, so a bound on the length drops whole runs.
SEARCHED = PATTERNS | {"access": r"AKIA[A-Z0-9]{16,}", "hex": r"[0-9a-f]{24,}"}
KINDS = [*PATTERNS, "markov"]
LEAST_CANDIDATE = 16
#: A piece has this many characters, and then all up to a place where no match goes on: after a character that is
#: part of none, or after a space that follows a letter or digit but no name of a secret.
PIECE = 4096
NAMES = "(?i:password|passwd|secret|token|api_?key)"
CUT = rf"""[^A-Za-z0-9+/_.=:"'\x20-]|(?<=[A-Za-z0-9])(?<!{NAMES.replace('api_?key', 'api_key|apikey')})\x20"""
GROUP = 64
LOW, HIGH = ord("+"), ord("z")
SYMBOLS = HIGH - LOW + 1
UNITS = 1000
RATIO = 15 * UNITS
PRIOR = 0.2
BACKOFF = 8.0


def once(df: DataFrame, **columns: Column) -> DataFrame:
    """Add columns that are computed once a row, however often a lambda refers to them."""
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))))


def pieces(texts: DataFrame) -> DataFrame:
    """One row per piece of ``text``, with the number of characters before it; an empty text is one empty piece."""
    cut = F.regexp_extract_all("text", F.lit(rf"(?s).{{{PIECE},}}?(?:{CUT}|\z)|.+"), F.lit(0))
    cut = F.when(F.length("text") <= PIECE, F.array("text")).otherwise(cut)
    rows = once(texts, parts=cut).drop("text")
    rows = once(rows, lengths=F.transform("parts", F.length))
    total = lambda first, n: F.aggregate(F.slice("lengths", first, n), F.lit(0), lambda a, x: a + x)
    groups = F.sequence(F.lit(0), F.floor((F.size("lengths") - 1) / GROUP).cast("int"))
    rows = once(rows, groups=F.transform(groups, lambda j: total(F.lit(1), j * GROUP)))
    own = lambda i: F.floor(i / GROUP).cast("int")
    before = F.transform(
        F.sequence(F.lit(0), F.size("lengths") - 1), lambda i: F.get("groups", own(i)) + total(own(i) * GROUP + 1, i - own(i) * GROUP)
    )
    rows = once(rows, before=before).drop("lengths", "groups")
    return rows.withColumn("part", F.explode(F.arrays_zip("parts", "before"))).select(
        *[c for c in texts.columns if c != "text"], F.col("part.parts").alias("piece"), F.col("part.before").alias("before")
    )


def matches(text: str, pattern: str) -> Column:
    """Struct of the matches and the lengths of the stretches before, between and after them."""
    empty = F.struct(F.array().cast("array<string>").alias("hits"), F.array().cast("array<int>").alias("gaps"))
    found = F.struct(
        F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("hits"),
        F.transform(F.split(text, pattern, -1), F.length).alias("gaps"),
    )
    return F.when(F.col(text).rlike(pattern), found).otherwise(empty)


def spans(found: Column, kind: int, wanted) -> Column:
    """(start, kind, end, value) of a piece's matches that are ``wanted``, in code points of the text."""

    def at(i):
        before = F.aggregate(F.slice(found["gaps"], 1, i + 1), F.col("before"), lambda a, x: a + x)
        start = F.aggregate(F.slice(found["hits"], 1, i), before, lambda a, x: a + F.length(x))
        value = F.element_at(found["hits"], i + 1)
        return F.struct(start.alias("start"), F.lit(kind).alias("kind"), (start + F.length(value)).alias("end"), value.alias("value"))

    places = F.when(F.size(found["hits"]) > 0, F.sequence(F.lit(0), F.size(found["hits"]) - 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(F.filter(places, lambda i: wanted(F.element_at(found["hits"], i + 1))), at)


def base_wanted(kind: str):
    if kind == "assign":
        return lambda hit: F.length(F.regexp_extract(hit, PATTERNS[kind], 2)) >= LEAST[kind]
    return lambda hit: F.length(hit) >= LEAST[kind]


def pair_codes(token: Column) -> Column:
    """The code of each pair of neighbouring characters of a candidate, from 0."""
    code = lambda i: F.ascii(F.substr(token, i, F.lit(1))) - LOW
    return F.transform(F.sequence(F.lit(1), F.length(token) - 1), lambda i: code(i) * SYMBOLS + code(i + 1))


def train(samples: DataFrame) -> DataFrame:
    """One row: ``ratios``, the log-likelihood ratio (in thousandths) of every pair of characters.

    ``samples`` has token (of the candidates' characters, two or more) and label (1 random, 0 ordinary).  Each
    model is the chance of a character after another, backed off to its chance after any (``BACKOFF`` counts'
    worth), which starts from ``PRIOR`` counts each, so without samples of a label its model is uniform.  Integers keep sums exact in any order.
    """
    distinct = samples.groupBy("token", "label").agg(F.count("*").alias("n"))
    pairs = distinct.select("label", "n", F.explode(pair_codes(F.col("token"))).alias("pair")).groupBy("label", "pair").agg(F.sum("n").alias("n"))
    grid = samples.sparkSession.range(2 * SYMBOLS * SYMBOLS).select(
        (F.col("id") % 2).cast("int").alias("label"), F.floor(F.col("id") / 2).cast("int").alias("pair")
    )
    n = F.coalesce("n", F.lit(0))
    counted = grid.join(pairs, ["label", "pair"], "left").select(
        "label", "pair", n.alias("n"), F.floor(F.col("pair") / SYMBOLS).alias("first"), (F.col("pair") % SYMBOLS).alias("second")
    )
    firsts = counted.groupBy("label", "first").agg(F.sum("n").alias("n_first"))
    seconds = counted.groupBy("label", "second").agg(F.sum("n").alias("n_second"))
    totals = counted.groupBy("label").agg(F.sum("n").alias("total"))
    alone = (F.col("n_second") + PRIOR) / (F.col("total") + PRIOR * SYMBOLS)
    chance = counted.join(firsts, ["label", "first"]).join(seconds, ["label", "second"]).join(totals, "label").withColumn(
        "log", F.log((F.col("n") + BACKOFF * alone) / (F.col("n_first") + BACKOFF))
    )
    ratio = chance.groupBy("pair").agg(F.sum(F.when(F.col("label") == 1, F.col("log")).otherwise(-F.col("log"))).alias("ratio"))
    one = F.struct("pair", F.round(F.col("ratio") * UNITS).cast("int").alias("ratio"))
    return ratio.agg(F.sort_array(F.collect_list(one)).alias("r")).select(F.transform("r", lambda x: x["ratio"]).alias("ratios"))


def labelled(found: DataFrame) -> DataFrame:
    """Samples from the matches: values of the fixed patterns are random strings, candidates that touch none ordinary.

    Every candidate string counts as often as it stands somewhere.
    """
    value = F.regexp_replace(F.col("b.value"), PATTERNS["assign"], "$2")
    secret = found.select(F.explode("base").alias("b")).select(F.explode(F.regexp_extract_all(value, F.lit(r"[A-Za-z0-9+/_-]{6,}"), F.lit(0))).alias("token"), F.lit(1).alias("label"))
    plain = found.select(F.explode("candidates").alias("c")).select(F.col("c.value").alias("token"), F.lit(0).alias("label"))
    return secret.unionByName(plain)


def found_in(docs: DataFrame, least: int) -> DataFrame:
    """Per row: doc_id, ``base``, the spans of the fixed patterns, and ``candidates``, those of strings that touch none."""
    text = docs.select(
        F.monotonically_increasing_id().alias("row"), docs["doc_id"].cast("long").alias("doc_id"), F.coalesce(docs["text"], F.lit("")).alias("text")
    )
    columns = {f"m_{k}": matches("piece", p) for k, p in SEARCHED.items()}
    found = pieces(text).select("row", "doc_id", "before", matches("piece", rf"[A-Za-z0-9+/_-]{{{least},}}").alias("strings"), *[c.alias(n) for n, c in columns.items()])
    base = F.concat(*[spans(F.col(f"m_{k}"), i, base_wanted(k)) for i, k in enumerate(PATTERNS)])
    each = once(found, base_at=base, strings_at=spans(F.col("strings"), len(PATTERNS), lambda hit: F.lit(True)))
    clear = F.filter("strings_at", lambda m: ~F.exists("base_at", lambda b: (b["start"] < m["end"]) & (b["end"] > m["start"])))
    # A text's pieces are read by one task, so most of this is put together before it is moved.
    return each.groupBy("row", "doc_id").agg(
        F.flatten(F.collect_list("base_at")).alias("base"), F.flatten(F.collect_list(clear)).alias("candidates")
    ).drop("row")


def scan(docs: DataFrame, samples: DataFrame | None = None, ratio: int = RATIO, least: int = LEAST_CANDIDATE) -> DataFrame:
    """Per row: doc_id, n_assign, n_access, n_hex, n_markov, base_sha256, spans and ``found``, the spans as structs.

    ``samples`` (token, label) replaces the ones taken from the documents; ``ratio`` is the least log-likelihood
    ratio, in thousandths, of a random string.  Strings of letters, digits and ``+/_-`` shorter than ``least``
    are not judged by the models.  Spans of the Markov models that touch one of the fixed
    patterns are left out.  Null and empty texts have no spans; repeated rows are each scanned; ids may be
    null; other columns are ignored; no rows give no rows.  The work grows with the length of a text, however
    many hits it has, but for a text that has no place to cut.
    """
    found = stage(found_in(docs, least), "secret-matches")
    ratios = stage(train(labelled(found) if samples is None else samples), "markov-ratios").scalar()

    def random(token):
        return F.aggregate(pair_codes(token), F.lit(0), lambda a, p: a + F.get("ratios", p)) >= ratio

    scored = found.withColumn("ratios", ratios).withColumn("markov", F.filter("candidates", lambda c: random(c["value"])))
    names = F.array(*map(F.lit, KINDS))
    written = lambda s: F.array_join(F.transform(F.sort_array(s), lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["start"], x["end"])), ",")
    every = F.concat("base", "markov")
    count = lambda k: F.size(F.filter("every", lambda x: x["kind"] == k)).cast("long")
    return scored.withColumn("every", every).select(
        "doc_id", *[count(i).alias(f"n_{k}") for i, k in enumerate(KINDS)],
        F.sha2(written("base"), 256).alias("base_sha256"), written("every").alias("spans"), F.sort_array("every").alias("found"),
    )
