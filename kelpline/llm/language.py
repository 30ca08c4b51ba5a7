"""Language identification by words first, then by shorter and shorter character n-grams.

A word that the training texts hold is scored by its log frequency in each language. An
unseen word is scored by its n-grams (with its edges marked) of the greatest length of
which any is known. A text's scores are the sums over its words.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kelpline.llm import common

#: Bounds of the training sample: texts of a language, and of all languages together; length of one.
SAMPLE, EVERY, TEXT_BYTES = 500, 8000, 32 << 10
#: Groups that the hashes of a language are drawn in at first.
GROUPS = 64
LONGEST, UNKNOWN = 5, "und"
#: Words whose scores a worker keeps.
_CACHE = 400_000

_LETTERS = re.compile(rb"[a-z]")
_TABLE = bytes(c if c >= 128 or 97 <= c <= 122 else 32 for c in range(256))


def words(text: str) -> list[bytes]:
    """Lower-case runs of ASCII letters and of characters beyond ASCII."""
    return text.lower().encode("utf-8", "replace").translate(_TABLE).split()


def has_letter(text: str) -> bool:
    return bool(_LETTERS.search(text.lower().encode("utf-8", "replace"))) or any(map(str.isalpha, text))


class Table:
    """Log frequencies by language, a row for each word or n-gram of the sample."""

    def __init__(self, counts: list[Counter]):
        every = sorted(set().union(*counts))
        self.index = {w: i for i, w in enumerate(every)}
        table = np.zeros((len(every), len(counts)), np.float32)
        for k, c in enumerate(counts):
            for w, n in c.items():
                table[self.index[w], k] = n
        self.logs = np.log((table + 1) / (table.sum(0, dtype=np.float64) + len(every) + 1)).astype(np.float32)


class Model:
    """Tables of words and of n-grams by length. All of the sample's words and n-grams are in them."""

    def __init__(self, languages: list[str], known: Table, grams: dict[int, Table]):
        self.languages, self.known, self.grams = languages, known, grams

    @classmethod
    def fit(cls, rows: list[tuple[str, str]]) -> "Model":
        """rows: (text, language)."""
        languages = sorted({lang for _, lang in rows})
        counts = {lang: Counter() for lang in languages}
        for text, lang in rows:
            counts[lang].update(words(text or ""))
        grams = {}
        for n in range(1, LONGEST + 1):
            by = [Counter() for _ in languages]
            for c, lang in zip(by, languages, strict=True):
                for w, k in counts[lang].items():
                    for g in cls._cut(w, n):
                        c[g] += k
            grams[n] = Table(by)
        return cls(languages, Table([counts[lang] for lang in languages]), grams)

    @staticmethod
    def _cut(word: bytes, n: int) -> list[str]:
        w = word.decode("utf-8", "replace")
        w = f" {w} " if n > 1 else w
        return [w[i : i + n] for i in range(len(w) - n + 1)]

    def scores(self, words: list[bytes]) -> np.ndarray:
        """Of each word by language; less its greatest, so that all words speak on one scale."""
        out, left = np.zeros((len(words), len(self.languages))), list(range(len(words)))
        for n in range(LONGEST + 1, 0, -1):
            table = self.known if n > LONGEST else self.grams[n]
            ids, starts, hit, rest = [], [], [], []
            for k in left:
                keys = [words[k]] if n > LONGEST else self._cut(words[k], n)
                found = [i for i in map(table.index.get, keys) if i is not None]
                if found:
                    hit.append(k)
                    starts.append(len(ids))
                    ids += found
                else:
                    rest.append(k)
            if hit:
                s = np.add.reduceat(table.logs[ids].astype(np.float64), starts, axis=0) / np.diff([*starts, len(ids)])[:, None]
                out[hit] = s - s.max(1, keepdims=True)
            left = rest
        return out


def training(docs: DataFrame, train: Column, sample: int = SAMPLE) -> list[tuple[str, str]]:
    """Up to ``sample`` different texts of each language, those of least hash of doc_id and text, from the
    rows where ``train`` holds; with many languages fewer of each, but one at least. Texts of up to
    TEXT_BYTES come first; of a longer one its beginning is learned. However often rows repeat, the
    driver holds no more: first the hashes are drawn, then the texts that have them."""
    long = (F.octet_length("text") > TEXT_BYTES).cast("int")
    rows = docs.filter(train & F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & F.col("text").isNotNull())
    rows = rows.select("lang", F.struct(long.alias("long"), F.xxhash64("doc_id", "text", F.lit("language")).alias("hash")).alias("mark"), "text")
    once = rows.select("lang", "mark").distinct()
    languages = rows.select("lang").distinct().count()
    if not languages:
        return []
    each = max(1, min(sample, EVERY // languages))
    drawn = once.withColumn("group", F.pmod(F.col("mark.hash"), F.lit(GROUPS)))
    for by in (["lang", "group"], ["lang"]):  # the least of each group first, so that few rows of a language meet
        drawn = drawn.withColumn("k", F.row_number().over(Window.partitionBy(*by).orderBy("mark"))).filter(F.col("k") <= each)
    drawn = drawn.select("lang", "mark")
    drawn = docs.sparkSession.createDataFrame(drawn.collect(), drawn.schema)  # at most EVERY rows, or one per language
    texts = rows.select("lang", "mark", F.left("text", F.lit(TEXT_BYTES)).alias("text")).join(F.broadcast(drawn), ["lang", "mark"])
    return sorted((r["text"], r["lang"]) for r in texts.groupBy("lang", "mark").agg(F.min("text").alias("text")).collect())


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred and score (the posterior of the language)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the sample

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Model = shared.value
        index: dict[bytes, int] = {}
        scores = np.zeros((1 << 14, len(model.languages)))
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for a, b in common.slices([len(t or "") for t in texts], 4 << 20):
                if len(index) > _CACHE:
                    index = {}
                at, ends, fresh, known = [], [0], [], len(index)
                for t in texts[a:b]:
                    for w in words(t) if t else ():
                        i = index.get(w)
                        if i is None:
                            i = index[w] = len(index)
                            fresh.append(w)
                        at.append(i)
                    ends.append(len(at))
                while len(index) > len(scores):
                    scores = np.concatenate([scores, np.zeros_like(scores)])
                scores[known : len(index)] = model.scores(fresh)
                sums = np.concatenate([np.zeros((1, len(model.languages))), np.cumsum(scores[at], axis=0)]) if at else np.zeros((1, len(model.languages)))
                each = np.diff(sums[ends], axis=0)
                best = each.argmax(1) if model.languages else np.zeros(b - a, int)
                sure = 1 / np.exp(each - each.max(1, keepdims=True)).sum(1) if model.languages else np.zeros(b - a)
                ok = [bool(model.languages) and t is not None and has_letter(t) for t in texts[a:b]]
                pred = [model.languages[k] if good else UNKNOWN for k, good in zip(best.tolist(), ok, strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(pred, pa.string()), pa.array(np.where(ok, sure, 0.0))], names=["doc_id", "lang_pred", "score"])

    return common.mapped(docs.select("doc_id", "text"), run, "doc_id long, lang_pred string, score double")


def identify(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every row of ``docs`` (doc_id, text, lang).

    Learned from rows with a language whose crc32 of doc_id as text, modulo 4, isn't 2. Null
    texts and texts without a letter are ``und`` with score 0, and so is all if nothing could
    be learned. A null doc_id is never learned from and not held out. Repeated rows are
    predicted each; an empty table gives no rows; other columns are not looked at. A text is
    worked on whole: its words take some times its own size. Languages of equal score are told
    apart by name."""
    common.tune(docs.sparkSession)
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))
    model = Model.fit(training(docs, ~held, sample))
    return predict(docs, model).select("doc_id", held.alias("held_out"), "lang_pred", "score")


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(common.documents(spark, sf_dir))
