"""Full-text search over an inverted index, with phrase, any-word and substring stages."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kelpline.functions.text import like_folded
from kelpline.sources.scratch import stored

K1, B, LEAST_IDF = 1.2, 0.75, 1e-6
#: Folders of a stored index.
BUCKETS = 64


def _marked() -> dict[str, str]:
    """Lower-case Latin letters that are one of a-z with a single mark, and the long s, by that letter."""
    letters = [chr(c) for a, b in ((0xC0, 0x250), (0x1E00, 0x1F00)) for c in range(a, b)]
    parts = {c: unicodedata.normalize("NFKD" if c in "ſẛ" else "NFD", c) for c in letters if c == c.lower()}
    return {c: d[0] for c, d in parts.items() if "a" <= d[0] <= "z" and (len(d) == 2 or c in "ſẛ")}


_MARKED = _marked()
_LOOSE = "".join(map(chr, range(0x300, 0x370)))


def folded_text(c: Column) -> Column:
    """In lower case. Latin letters with one mark lose it, as in café, also where the mark is a
    character of its own; letters with two and of other scripts keep them."""
    return F.translate(F.lower(c), "".join(_MARKED) + _LOOSE, "".join(_MARKED.values()))


def tokens_of(c: Column) -> Column:
    """Runs of letters and digits of the folded text."""
    return F.filter(F.split(folded_text(c), r"[^\p{L}\p{N}]+"), lambda t: t != "")


def _holding(docs: DataFrame, text: str, words: list[str], every: bool) -> DataFrame:
    """Documents with one of the words, or all, inside of their text: what is left needs no token.
    ``words`` are tokens; a token stands in the folded text as it is."""
    folded = folded_text(F.col(text))
    found = [folded.contains(w) for w in dict.fromkeys(words)]
    keep = F.lit(every)
    for f in found:
        keep = keep & f if every else keep | f
    return docs.filter(keep)


def _spaced(text: str) -> Column:
    """The tokens with a space before and after each: places of a phrase can be counted in it."""
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(folded_text(F.col(text)), r"[^\p{L}\p{N}]+", " ")), F.lit(" "))


def _times(spaced: Column, words: list[str]) -> Column:
    """How often tokens follow one another in just this way; places may overlap."""
    return F.regexp_count(spaced, F.lit("(?= " + " ".join(words) + " )")).cast("long")


def _length(spaced: Column) -> Column:
    """Tokens of a text, from the spaces between them."""
    return F.when(F.trim(spaced) == "", 0).otherwise(F.regexp_count(spaced, F.lit(" ")) - 1)


def phrase(docs: DataFrame, key: str, text: str, words: list[str]) -> DataFrame:
    """Documents with the words (tokens) one after another, how often, and their length in tokens.
    Each document is looked at by itself: nothing is exploded or shuffled."""
    spaced = _holding(docs, text, words, True).select(key, _spaced(text).alias("_s"))
    return spaced.select(key, _times(F.col("_s"), words).alias("tf"), _length(F.col("_s")).alias("length")).filter("tf > 0")


def any_word(docs: DataFrame, key: str, text: str, words: list[str]) -> DataFrame:
    """(key, token, tf, length) of documents with any of the words, each document by itself."""
    words = list(dict.fromkeys(words))
    spaced = _holding(docs, text, words, False).select(key, _spaced(text).alias("_s"))
    counts = F.array(*[F.struct(F.lit(w).alias("token"), _times(F.col("_s"), [w]).alias("tf")) for w in words])
    return spaced.select(key, _length(F.col("_s")).alias("length"), F.explode(counts).alias("_c")).filter("_c.tf > 0").select(key, "_c.token", "_c.tf", "length")


def corpus_size(docs: DataFrame, text: str) -> DataFrame:
    """One row: docs, and the mean of their lengths in tokens."""
    return docs.select(_spaced(text).alias("_s")).agg(F.count("*").alias("docs"), F.avg(_length(F.col("_s"))).alias("mean"))


def bm25(hits: DataFrame, size: DataFrame, key: str, term: str = "token") -> DataFrame:
    """(key, rank): the negated score, so that lower is better. ``hits`` has a row for each document
    and term, which may be a phrase; document frequencies and ``size`` are of the whole corpus."""
    df = hits.groupBy(term).agg(F.count("*").alias("df"))
    odds = F.log((F.col("docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    idf = F.when(odds > 0, odds).otherwise(LEAST_IDF)
    part = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("length") / F.col("mean")))
    return hits.join(F.broadcast(df), term).crossJoin(F.broadcast(size)).groupBy(key).agg((-F.sum(part)).alias("rank"))


def bm25_words(docs: DataFrame, key: str, text: str, words: list[str]) -> DataFrame:
    """``bm25`` of all documents with any of the words. Each text is looked at once: its length and
    counts are stored, and the corpus' size, frequencies and scores come from these."""
    words = list(dict.fromkeys(words))
    s = F.col("_s")
    spaced = docs.select(key, _spaced(text).alias("_s"))
    counts = F.array(*[F.struct(F.lit(w).alias("token"), F.when(s.contains(f" {w} "), _times(s, [w])).otherwise(F.lit(0).cast("long")).alias("tf")) for w in words])
    one = stored(spaced.select(key, _length(s).alias("length"), F.filter(counts, lambda c: c["tf"] > 0).alias("_c")), "counted")
    size = one.agg(F.count("*").alias("docs"), F.avg("length").alias("mean"))
    return bm25(one.select(key, "length", F.explode("_c").alias("_c")).select(key, "length", "_c.*"), size, key)


def top(ranked: DataFrame, key: str, n: int) -> DataFrame:
    """The n most relevant."""
    return ranked.orderBy("rank", key).limit(n)


def write_index(docs: DataFrame, key: str, text: str, path: str, buckets: int = BUCKETS) -> None:
    """Store the postings (token, key, length, positions) in folders by a hash of the token, sorted
    by token inside, so that a query reads the files of its words' folders, and of these the
    row groups that can hold the words. Rows of a common token are dealt to several tasks."""
    t = docs.select(F.col(key).alias("key"), tokens_of(F.col(text)).alias("_t"))
    one = t.select("key", F.size("_t").alias("length"), F.posexplode("_t").alias("position", "token"))
    postings = one.groupBy("token", "key", "length").agg(F.array_sort(F.collect_list("position")).alias("positions"))
    dealt = postings.withColumn("bucket", _bucket(F.col("token"), buckets)).repartition("bucket", F.pmod(F.xxhash64("key"), F.lit(8)))
    dealt.sortWithinPartitions("bucket", "token").write.partitionBy("bucket").parquet(path)


def _bucket(token: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(token), F.lit(buckets)).cast("int")


def postings(spark: SparkSession, path: str, words: list[str], buckets: int = BUCKETS) -> DataFrame:
    """(token, key, length, positions) of the words from a stored index."""
    wanted = spark.range(1).select(*[_bucket(F.lit(w), buckets) for w in words]).first()  # numbers of folders, by the same hash
    return spark.read.parquet(path).filter(F.col("bucket").isin(*set(wanted)) & F.col("token").isin(*words)).drop("bucket")


def indexed_phrase(spark: SparkSession, path: str, words: list[str], buckets: int = BUCKETS) -> DataFrame:
    """``phrase`` from a stored index: a place where all words name the same begin is a hit."""
    wanted = F.explode(F.array(*[F.struct(F.lit(w).alias("w"), F.lit(i).alias("i")) for i, w in enumerate(words)]))
    hits = postings(spark, path, list(dict.fromkeys(words)), buckets).withColumn("_w", wanted).filter("token = _w.w")
    begins = hits.select("key", "length", F.explode(F.transform("positions", lambda p: p - F.col("_w.i"))).alias("begin")).groupBy("key", "length", "begin").agg(F.count("*").alias("n"))
    return begins.filter(F.col("n") == len(words)).groupBy("key", "length").agg(F.count("*").alias("tf"))


def substring_hits(docs: DataFrame, text: str, query: str) -> DataFrame:
    return docs.filter(like_folded(F.col(text), F.lit(query)))


def cascade(stages: list[DataFrame]) -> DataFrame:
    """The rows of the first stage that has any, with its number; all have the same columns. A stage is
    asked for one row, and those after the first that has one are never run."""
    for i, rows in enumerate(stages):
        if i == len(stages) - 1 or not rows.isEmpty():
            return rows.withColumn("stage", F.lit(i + 1))
    raise ValueError("a cascade has stages")


def context(hits: DataFrame, recent: DataFrame, text: str, order: list[Column], most: int = 8, clip: int = 200, prefix: int = 100) -> DataFrame:
    """Hits that don't begin like a recent message, the first few, clipped."""
    known = recent.select(F.substring(text, 1, prefix).alias("_p")).distinct()
    fresh = hits.join(known, F.substring(hits[text], 1, prefix) == known["_p"], "left_anti")
    return fresh.orderBy(*order).limit(most).withColumn(text, F.substring(text, 1, clip))


def within_budget(turns: DataFrame, text: str, role: str, order: str, most: int = 300_000, keep: int = 10, by: list[str] | None = None) -> DataFrame:
    """If the turns of a conversation are longer than the budget: the system turns and the last
    few others; else all. ``turns`` is one conversation, or one for each value of ``by``."""
    by = by or []
    place = F.row_number().over(Window.partitionBy(*by, F.col(role) == "system").orderBy(F.col(order).desc()))
    sizes = turns.groupBy(*by).agg(F.coalesce(F.sum(F.length(text)), F.lit(0)).alias("_size"))
    kept = turns.withColumn("_place", place)
    kept = kept.join(sizes, by) if by else kept.crossJoin(F.broadcast(sizes))
    return kept.filter((F.col("_size") <= most) | (F.col(role) == "system") | (F.col("_place") <= keep)).select(*turns.columns)
