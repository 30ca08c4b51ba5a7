"""Secrets by base patterns and by character Markov models, in built-in functions only.

Beside three base patterns, long runs of key characters are candidates. Two first-order
Markov chains over characters, one of random strings and one of ordinary identifiers,
give a log-likelihood ratio; a candidate whose ratio per character passes the threshold
is added. Both chains are trained from labelled samples: hashed random strings in usual
alphabets, and identifiers put together from all short words that stand alone in the documents.
The threshold comes from samples that the chains were not trained on.
"""

from __future__ import annotations

import math
import string
from collections import defaultdict

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kelpline.llm import common, spans

KINDS = ["assign", "access", "hex", "random"]
#: Random strings; least length of a candidate.
STRINGS, LEAST = 6000, 20
#: Rows of words that identifiers are put together from, at least, and words of a row on average, at most. All words are used.
ROWS, WORDS = 200, 100
#: Shares of the held strings below the threshold: of ordinary ones this one at least, of random ones about this one at most.
ORDINARY, RANDOM = 0.999, 0.02
#: Where between these two the threshold is.
BETWEEN = 0.75

# Java forms of the contract's patterns; runs too short to count are passed over where that can't change another match.
_ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
_ACCESS = r"AKIA[A-Z0-9]{16,}+"
_HEX = r"[0-9a-f]{24,}+"
_RANDOM = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{%d,}+"

#: Characters of candidates; every other one counts as the edge of the string.
ALPHABET = string.ascii_letters + string.digits + "+/_=-"


def base_spans(text: Column) -> dict[str, Column]:
    assign = spans.matches(text, _ASSIGN, 0, text.rlike(r"(?i)(?:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]"))
    return {
        "assign": F.filter(assign, lambda s: F.length(F.regexp_extract(s["text"], _ASSIGN, 1)) >= 6),
        "access": spans.matches(text, _ACCESS, 1, text.contains("AKIA")),
        "hex": spans.matches(text, _HEX, 2, text.rlike("[0-9a-f]{24}")),
    }


def _steps(s: Column) -> Column:
    """Numbers of neighbouring characters, as first * size + second, the edges included as 0."""
    size = len(ALPHABET) + 1
    edge = F.array(F.lit(0))
    codes = F.transform(F.split(s, ""), lambda c: F.instr(F.lit(ALPHABET), c))
    return spans.with_(codes, lambda k: F.zip_with(F.concat(edge, k), F.concat(k, edge), lambda a, b: a * size + b))


# Parts of ordinary identifiers, for corpora that have none.
_PARTS = "get set user name index value count list item data file path size type node key next load save read write table row column test main config server client request response error handler update create delete parse format string number".split()


def samples(docs: DataFrame) -> DataFrame:
    """Labelled strings: label 1 for random ones, 0 for ordinary identifiers; held (one in three)
    for the threshold."""
    spark = docs.sparkSession
    digest = F.unhex(F.sha2(F.concat(F.lit("sample"), F.col("id").cast("string")), 256))
    plain = F.regexp_replace(F.base64(digest), "[^A-Za-z0-9]", "")
    forms = [F.base64(digest), F.translate(F.base64(digest), "+/=", "-_"), plain, plain, F.upper(F.hex(digest)), F.lower(plain), F.upper(plain)]
    length = (F.pmod(F.xxhash64("id"), F.lit(24)) + LEAST).cast("int")
    random = spark.range(0, STRINGS, 1, 4).select(F.lit(1).alias("label"), F.substring(F.element_at(F.array(*forms), (F.col("id") % len(forms)).cast("int") + 1), F.lit(1), length).alias("s"))

    def identifiers(words: Column) -> Column:
        several = lambda i: F.slice(words, i * 2 + 1, 2 + i % 3)
        glue = lambda i: F.element_at(F.array(*map(F.lit, ["_", "-", "/", ""])), i % 4 + 1)
        camel = lambda i: F.array_join(F.transform(several(i), lambda w: F.initcap(w)), "")
        each = lambda i: F.when(i % 5 == 4, F.concat(camel(i), (i * 7).cast("string"))).when(i % 4 == 3, camel(i)).otherwise(F.concat(F.array_join(F.slice(words, i * 2 + 1, 1), ""), glue(i), F.array_join(F.slice(several(i), 2, 3), "_")))
        return F.transform(F.sequence(F.lit(0), F.floor(F.size(words) / 2).cast("int")), each)

    # short words that stand alone: what is random, or a piece of a random string, is none
    alone = "(?<![A-Za-z0-9+/_=-])[A-Z]?[a-z]{1,14}(?![A-Za-z0-9+/_=-])"
    often = docs.select(F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(alone), F.lit(0)))).alias("w")).distinct()
    often = common.stored(often, "words")
    groups = max(ROWS, often.count() // WORDS)
    shuffled = F.array_sort(F.collect_list(F.struct(F.xxhash64("w").alias("h"), "w")))
    words = often.groupBy(F.pmod(F.xxhash64("w", F.lit(1)), F.lit(groups)).alias("g")).agg(shuffled.alias("s")).select(F.transform("s", lambda x: x["w"]).alias("w"))
    parts = spark.range(0, 200, 1, 1).select(F.transform(F.sequence(F.lit(0), F.lit(19)), lambda i: F.element_at(F.array(*map(F.lit, _PARTS)), F.pmod(F.xxhash64("id", i), F.lit(len(_PARTS))).cast("int") + 1)).alias("w"))
    ordinary = words.unionAll(parts).select(F.lit(0).alias("label"), F.explode(identifiers(F.col("w"))).alias("s"))
    return random.unionAll(ordinary).filter(F.length("s") >= 4).withColumn("held", F.pmod(F.xxhash64("s"), F.lit(3)) == 0)


class Chains:
    """Log-likelihood ratios of character pairs, and the threshold."""

    def __init__(self, ratios: list[float], least: float):
        self.ratios, self.least = ratios, least

    def score(self, s: Column) -> Column:
        """Log-likelihood ratio per character, random against ordinary."""
        table = F.expr("array(" + ",".join(f"{x:.5f}D" for x in self.ratios) + ")")
        return F.aggregate(_steps(s), F.lit(0.0), lambda a, k: a + F.element_at(table, k + 1)) / (F.length(s) + 1)

    @classmethod
    def fit(cls, docs: DataFrame) -> "Chains":
        rows = samples(docs)
        # a count for each label and pair of characters
        pairs = rows.filter(~F.col("held")).select("label", F.explode(_steps(F.col("s"))).alias("k")).groupBy("label", "k").agg(F.count("*").alias("n")).collect()
        size = len(ALPHABET) + 1
        counts, sums = defaultdict(int), defaultdict(int)
        for r in pairs:
            counts[r["label"], r["k"]] += r["n"]
            sums[r["label"], r["k"] // size] += r["n"]
        log = lambda label, k: math.log((counts[label, k] + 0.5) / (sums[label, k // size] + 0.5 * size))
        chains = cls([log(1, k) - log(0, k) for k in range(size * size)], 0.0)
        held = rows.filter(F.col("held") & (F.length("s") >= LEAST)).select("label", chains.score(F.col("s")).alias("score"))
        share = lambda label, p: F.percentile_approx(F.when(F.col("label") == label, F.col("score")), F.lit(p))
        r = held.agg(share(0, ORDINARY).alias("ordinary"), share(1, RANDOM).alias("random")).first()
        ordinary, random = (0.0 if x is None else x for x in (r["ordinary"], r["random"]))
        # between the two, nearer to random strings, so that words of other texts are left alone too
        chains.least = max(ordinary, ordinary + BETWEEN * (random - ordinary))
        return chains


def _spans(docs: DataFrame) -> DataFrame:
    """``_row``, ``base`` and ``every``: the row, and its base and all spans by start and kind."""
    chains = Chains.fit(docs)
    text = F.coalesce(F.col("_row.text"), F.lit(""))
    found = common.as_row(docs).withColumn("kinds", F.struct(*[c.alias(k) for k, c in base_spans(text).items()]))
    each = [F.col(f"kinds.{k}") for k in KINDS[:3]]
    found = found.withColumn("base", spans.by_start(F.concat(*each)))
    runs = spans.matches(text, _RANDOM % LEAST, 3, text.rlike("[A-Za-z0-9+/_=-]{%d}" % LEAST))
    found = found.withColumn("runs", spans.apart(runs, each))
    found = found.withColumn("added", F.when(F.size("runs") > 0, F.filter("runs", lambda s: chains.score(s["text"]) >= chains.least)).otherwise(spans.none()))
    return found.select("_row", "base", F.when(F.size("added") > 0, spans.by_start(F.concat("base", "added"))).otherwise(F.col("base")).alias("every"))


def find(docs: DataFrame, column: str = "spans") -> DataFrame:
    """``docs`` with a column of all spans, and ``base_<column>`` with the base ones only, by start and
    kind. Columns of these names are replaced; others stay, whatever their names and types."""
    kept = [c for c in docs.columns if c not in (column, f"base_{column}")]
    return _spans(docs).select(*common.from_row(kept), F.col("base").alias(f"base_{column}"), F.col("every").alias(column))


def redact(docs: DataFrame, by: str = "[SECRET]") -> DataFrame:
    """``docs`` with every secret replaced; all rows and columns stay, n_chars follows the text
    if there is one. Null texts stay null, repeated rows are cut each, overlapping spans are
    replaced as one, a long text is cut whole, and an empty table stays empty."""
    cut = _spans(docs).withColumn("text", spans.replaced(F.col("_row.text"), F.col("every"), by))
    other = {"text": F.col("text")}
    if "n_chars" in docs.columns:
        other["n_chars"] = F.when(F.size("every") > 0, F.length("text")).otherwise(F.col("_row.n_chars")).cast(docs.schema["n_chars"].dataType)
    return cut.select(*common.from_row(docs.columns, **other))


def secret_scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256 and spans of every row.

    Null texts count as empty and have no spans. Repeated rows are searched each; of spans that
    start together the kind that is listed first comes first; long texts are searched whole, in
    time that grows little faster than they do. An empty table gives no rows; columns but doc_id
    and text are not looked at."""
    found = find(docs.select("doc_id", "text"))
    count = lambda k: F.size(F.filter("base_spans", lambda s: s["kind"] == k)).cast("long")
    return found.select("doc_id", *[count(k).alias(f"n_{name}") for k, name in enumerate(KINDS[:3])], F.sha2(spans.joined(F.col("base_spans"), KINDS), 256).alias("base_sha256"), spans.joined(F.col("spans"), KINDS).alias("spans"))


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan(common.documents(spark, sf_dir))
