"""Personal data by candidate generators and boosted trees, in built-in functions only.

Four base patterns (e-mail, IP, card, phone) always stay. Generators of high recall propose
further spans, which may overlap: spelled-out e-mail addresses, phone numbers without a
plus, identity numbers, bank accounts, IPv6 addresses. Boosted trees score each from its
format and from the words and characters around it; what passes the calibrated threshold
is added, the likelier of two that overlap. The trees are fitted on labelled examples that
fixed templates fill with hashed digits, natively as well.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kelpline.llm import common, spans
from kelpline.llm.trees import Boosted

BASE = ["email", "ip", "card", "phone"]
ADDED = ["email_spelled", "phone_plain", "identity", "account", "ip6"]
#: Least probability of added spans; examples to fit and to calibrate on; trees.
LEAST, EXAMPLES, ROUNDS = 0.9, 3000, 40

# Java forms of the contract's patterns. A match may begin at the last match's end or where
# no earlier character could be in it; possessive loops keep long runs linear.
_EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
_IP = r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
_CARD = r"[0-9](?:[ -]?[0-9])++"
_PHONE = r"\+[0-9][ ().0-9-]+[0-9]"
_PART = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"

# Patterns, each with a part that every match of it holds: a test that loses no match. What stands between a name and its host
# can't be part of the name, so possessive names lose none either.
_GENERATORS = [
    (r"(?<![A-Za-z0-9._%+-])(?:[A-Za-z0-9_%+-]{1,32}+ dot ){0,3}+[A-Za-z0-9._%+-]{1,64}+ ?(?:@|\(at\)|\[at\]| at ) ?[A-Za-z0-9-]{1,63}(?: ?(?:\.|\(dot\)|\[dot\]| dot ) ?[A-Za-z0-9-]{2,63}){1,4}", r"@|\(at\)|\[at\]| at "),
    (r"(?<![0-9A-Za-z.+-])(?![0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9]))(?=\(?[0-9](?:[ ()./-]{0,2}[0-9]){6})(?:1[ .-])?\(?[0-9]{2,5}\)?[ ./-]?[0-9]{2,5}(?:[ ./-]?[0-9]{2,5}){0,3}(?![0-9A-Za-z])", r"[0-9](?:[ ()./-]{0,2}[0-9]){6}"),
    (r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", r"[0-9]-[0-9]{2}-[0-9]"),
    (r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])", r"[A-Z]{2}[0-9]{2}"),
    (r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}:){3,7}:?[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:])", r"[0-9A-Fa-f]:[0-9A-Fa-f]{1,4}:"),
]

# Words before personal data of a kind.
_PHONE_WORDS = "phone|tel|telefon|téléphone|teléfono|call|mobile|mobil|cell|fax|contact|reach|whatsapp|sms|handy"
_MAIL_WORDS = "e-?mail|mail|write|contact|correo|courriel|address"
_ID_WORDS = "ssn|social security|identity|passport|tax id|national id"
_BANK_WORDS = "iban|account|bank|konto|compte|cuenta"
_DOMAINS = "com|org|net|edu|gov|info|io|eu|uk|us|de|fr|es|it|nl|be|ch|at|no|se"


def _digits(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def _luhn(text: Column) -> Column:
    doubled = F.array(*[F.lit(x) for x in (0, 2, 4, 6, 8, 1, 3, 5, 7, 9)])

    def valid(d: Column) -> Column:
        place = lambda i: F.substring(d, F.length(d) + 1 - i, F.lit(1)).cast("int")
        total = F.aggregate(F.sequence(F.lit(1), F.length(d)), F.lit(0), lambda a, i: a + F.when(i % 2 == 1, place(i)).otherwise(F.element_at(doubled, place(i) + 1)))
        return F.when(F.length(d).between(13, 19), total % 10 == 0).otherwise(False)

    return spans.with_(_digits(text), valid)


def base_spans(text: Column) -> dict[str, Column]:
    found = {
        "email": spans.matches(text, _EMAIL, 0, text.contains("@")),
        "ip": spans.matches(text, _IP, 1, text.rlike(r"[0-9]\.[0-9]++\.[0-9]++\.[0-9]")),
        "card": spans.matches(text, _CARD, 2, text.rlike(r"[0-9](?:[ -]?[0-9]){12}")),
        "phone": spans.matches(text, _PHONE, 3, text.rlike(r"\+[0-9][ ().0-9-]")),
    }
    valid = {
        "ip": lambda s: s["text"].rlike(rf"^{_PART}\.{_PART}\.{_PART}\.{_PART}$"),
        "card": lambda s: _luhn(s["text"]),
        "phone": lambda s: F.length(_digits(s["text"])).between(9, 15),
    }
    return {k: F.filter(v, valid[k]) if k in valid else v for k, v in found.items()}


def candidates(text: Column) -> list[Column]:
    """Spans of each generator, kinds counted on from the base ones."""
    return [spans.matches(text, pattern, len(BASE) + i, text.rlike(test)) for i, (pattern, test) in enumerate(_GENERATORS)]


def features(s: Column) -> dict[str, Column]:
    """Format and context of a span, as numbers."""
    t = s["text"]
    before = F.lower(s["before"])
    n = F.length(_digits(t))
    groups = F.size(F.split(t, "[^0-9]+"))
    word = lambda words: before.rlike(rf"(?:^|[^a-z])(?:{words})[^a-z]*(?:[a-z]+[^a-z]+)?$").cast("int")
    return {
        "kind": s["kind"] - len(BASE),
        "digits": n,
        "length": F.length(t),
        "groups": groups,
        "brackets": t.rlike(r"[\[(]").cast("int"),
        "hyphens": F.length(F.regexp_replace(t, "[^-]", "")),
        "dots": F.length(F.regexp_replace(t, "[^.]", "")),
        "marked": t.rlike(r"(?i)@|[\[(](?:at|dot)[\])]").cast("int"),
        "domain": t.rlike(rf"(?i)(?:\.|dot)[)\]]? ?(?:{_DOMAINS})$").cast("int"),
        "lead": t.rlike(r"^\(?0[1-9]").cast("int"),
        "slash": t.contains("/").cast("int"),
        "year": t.rlike(r"(?:^|[^0-9])(?:1[89]|20)[0-9]{2}(?:[^0-9]|$)").cast("int"),
        "tail": F.coalesce(F.length(F.regexp_extract(t, "([0-9]+)$", 1)), F.lit(0)),
        "letters": F.length(F.regexp_replace(t, "[^A-Za-z]", "")),
        "phone_word": word(_PHONE_WORDS),
        "mail_word": word(_MAIL_WORDS),
        "id_word": word(_ID_WORDS),
        "bank_word": word(_BANK_WORDS),
        "glued": F.left(s["after"], F.lit(1)).rlike("[A-Za-z0-9.,/%-]").cast("int"),
        "money": before.rlike(r"[$€£#=/*]\s*$").cast("int"),
    }


# Templates of the labelled examples. {n:k} stands for k digits, {w} for a word; the
# candidate is what the generators find in the sentence.
_EXAMPLES = [
    (1, "call me at {n:3}-{n:3}-{n:4} today"), (1, "tel: ({n:3}) {n:3}-{n:4}"), (1, "phone {n:3} {n:3} {n:4}"), (1, "mobile 0{n:3} {n:6} or later"),
    (1, "fax: {n:3}.{n:3}.{n:4}, thanks"), (1, "contact us on 0{n:2} {n:4} {n:4}"), (1, "Telefon 0{n:3}-{n:7}"), (1, "reach {w} by ({n:3}) {n:3} {n:4}"),
    (1, "{w} ({n:3}) {n:3}-{n:4} {w}"), (1, "whatsapp {n:3} {n:2} {n:2} {n:2} please"),
    (1, "write to {w} at {w} dot com"), (1, "{w}.{w} (at) {w} (dot) org"), (1, "email {w}[at]{w}[dot]net"), (1, "mail {w} @ {w} . com now"), (1, "e-mail: {w}_{n:2} at {w} dot co dot uk"),
    (1, "{w} (at) {w}.org"), (1, "{w}.{w} (at) {w}.com wrote"), (1, "{w} at {w}.org"), (1, "{w} at {w}.net {w}"), (1, "{w} dot {w} at {w} dot com"), (1, "{w} at {w} dot org {w}"), (1, "{w}_{n:2} [at] {w}.de"), (1, "to {w}@{w} dot com please"), (1, "{w} @ {w}.com"), (1, "{w}(at){w}.fr"), (1, "{w} at {w}.org {w} {w}"), (1, "{w}_{n:2} at {w}.com"), (1, "{w} at {w} dot es"), (1, "{w} at {w} dot no {w}"),
    (1, "text 0{n:4} {n:6} {w}"), (1, "{w} 0{n:3} {n:4} {n:4} {w}"), (1, "{w} 0{n:2}/{n:7}, {w}"), (1, "{w} 1-{n:3}-{n:3}-{n:4} {w}"), (1, "0{n:4} {n:6}"), (1, "compte BE{n:2} {n:4} {n:4} {n:4}"), (1, "{w} BE{n:2} {n:4} {n:4} {n:4} {w}"),
    (1, "Tel {n:3}/{n:7}"), (1, "tel. 0{n:3}/{n:6} {w}"), (1, "{w} 0{n:2}/{n:8}"), (1, "call {n:3}/{n:3}-{n:4}"), (1, "phone {n:10}"), (1, "mobile 0{n:10} {w}"), (1, "number is {n:3}-{n:3}-{n:4}"), (1, "{w} {n:3}-{n:3}-{n:4} {w}"), (1, "{w} ({n:3}) {n:3} {n:4}"), (1, "fax 0{n:2} {n:3} {n:2} {n:2}"),
    (1, "{w} GB{n:2} ABCD {n:4} {n:4} {n:4} {n:2} {w}"), (1, "konto DE{n:2}{n:4}{n:4}{n:4}{n:4}{n:2}"), (1, "{w} fd{n:2}:{n:4}:{n:3}:{n:1}:{n:4}:{n:4}:{n:4}:{n:1} {w}"),
    (1, "ssn {n:3}-{n:2}-{n:4}"), (1, "social security number {n:3}-{n:2}-{n:4}."), (1, "{w} {n:3}-{n:2}-{n:4} {w}"),
    (1, "iban DE{n:2} {n:4} {n:4} {n:4} {n:4} {n:2}"), (1, "account GB{n:2}ABCD{n:4}{n:4}{n:4}{n:2}"), (1, "compte FR{n:2} {n:4} {n:4} {n:4} {n:4} {n:4} {n:3}"), (1, "{w} ES{n:2}{n:4}{n:4}{n:4}{n:4}{n:4} {w}"),
    (1, "{w} 2001:db8:{n:4}:{n:4}:{n:2}a:{n:4}:{n:4}:{n:3} {w}"), (1, "host fe80:{n:4}:ab{n:2}:{n:4}::{n:3}"),
    (0, "in 19{n:2} 20{n:2} 20{n:2} {w}"), (0, "from 19{n:2}-20{n:2} {n:2} {w}"), (0, "{w} 18{n:2}-19{n:2} 19{n:2} 19{n:2}"), (0, "{w} 19{n:2}-19{n:2} 19{n:2} {w}"), (0, "dated 20{n:2}-{n:2}-{n:2} and"), (0, "on {n:2}.{n:2}.20{n:2} {w}"), (0, "order {n:5}-{n:4}-{n:3} shipped"),
    (0, "isbn 978-{n:1}-{n:4}-{n:4}-{n:1}"), (0, "total {n:3} {n:3} {n:3} units"), (0, "$ {n:3}.{n:3}.{n:3} paid"), (0, "{w} {n:8} {w}"), (0, "{w} {n:10} {w}"), (0, "{w} {n:12} {w}"), (0, "number {n:16} {w}"),
    (0, "rows {n:2} {n:2} {n:2} {n:2}"), (0, "version {n:2}.{n:2}.{n:3}"), (0, "id={n:9} {w}"), (0, "pages {n:3}-{n:3} {n:2} {w}"), (0, "lat {n:2}.{n:5} {n:2}.{n:5}"), (0, "{w} # {n:3} {n:3} {n:3}"),
    (0, "we met at {w}. com {w}"), (0, "look at the dot on {w}"), (0, "{w} at {w}. {w} {w}"), (0, "{w} at {w} dot {w}"), (0, "{w} at {w}.{w}"), (0, "{w} stayed at home . and {w}"), (0, "price @ {n:2}.{n:2} each"), (0, "{w} at {n:2}.{n:2} {w}"),
    (0, "{w} {n:2}/{n:2}/20{n:2} {w}"), (0, "on {n:2}/{n:2} and {n:3}/{n:3} {w}"), (0, "ratio {n:3}/{n:3} {w}"), (0, "{w} {n:4}/{n:4} {w}"), (0, "{w} {n:6} {w}"), (0, "about {n:3} {n:3} {w}"), (0, "score {n:2}-{n:2} {w}"), (0, "{w} {n:5} {n:5} {w}"), (0, "{w} {n:4} {n:4} {n:4} {w}"), (0, "{w} at {w}. The {w}"), (0, "look at {w}.{w} for {w}"), (0, "{w} 20{n:2}-{n:4} {w}"),
    (0, "model AB{n:2} {n:4} WXYZ {w}"), (0, "code XR{n:2}QWER TYUI {w}"), (0, "at {n:2}:{n:2}:{n:2}:{n:2} sharp"), (0, "ratio {n:1}:{n:1}:{n:1}:{n:1} {w}"), (0, "time {n:2}:{n:2}:{n:2}:{n:3} {w}"),
]
_WORDS = "alpha harbour stone anna miller garden peter lemon river olive smith table maria window forest paper".split()


def examples(spark: SparkSession, n: int = EXAMPLES) -> DataFrame:
    """id, label and text of ``n`` filled templates."""
    import re

    rows = []
    for which, (label, template) in enumerate(_EXAMPLES):
        parts, at = [], 0
        for k, m in enumerate(re.finditer(r"\{n:(\d+)\}|\{w\}", template)):
            parts.append((template[at : m.start()], k, int(m[1]) if m[1] else 0))
            at = m.end()
        rows.append((which, label, parts, template[at:]))
    templates = spark.createDataFrame(rows, "which int, label int, parts array<struct<text:string,k:int,digits:int>>, rest string")
    words, powers = F.array(*map(F.lit, _WORDS)), F.array(*[F.lit(10**k).cast("long") for k in range(17)])

    def filled(p: Column) -> Column:
        h = F.xxhash64("id", p["k"])
        number = F.lpad(F.pmod(h, F.element_at(powers, p["digits"] + 1)).cast("string"), p["digits"], "0")
        return F.concat(p["text"], F.when(p["digits"] > 0, number).otherwise(F.element_at(words, (F.pmod(h, F.lit(len(_WORDS))) + 1).cast("int"))))

    ids = spark.range(0, n, 1, 4).withColumn("which", (F.col("id") % len(_EXAMPLES)).cast("int"))
    # of each template one row
    return ids.join(F.broadcast(templates), "which").select("id", "label", F.concat(F.array_join(F.transform("parts", filled), ""), F.col("rest")).alias("text"))


def fit(spark: SparkSession) -> Boosted:
    """Trees from the examples' candidates: fitted on two thirds, calibrated on the rest."""
    found = examples(spark).select("id", "label", F.explode(F.concat(*candidates(F.col("text")))).alias("s"))
    f = features(F.col("s"))
    # at most a few candidates of each example
    rows = found.select("id", "label", *[c.cast("double").alias(k) for k, c in f.items()]).orderBy("id", *f).collect()
    x, y, held = np.array([r[2:] for r in rows], float), np.array([r[1] for r in rows], float), np.array([r[0] // len(_EXAMPLES) % 3 == 0 for r in rows])
    return Boosted.fit(list(f), x[~held], y[~held], ROUNDS).calibrate(x[held], y[held])


def _of_kind(k: int):
    return lambda x: x["kind"] == k


def find(docs: DataFrame, least: float = LEAST, column: str = "spans") -> DataFrame:
    """``docs`` with a column of all spans, and ``base_<column>`` with the base ones only, by kind and
    start. Columns of these names are replaced; others stay, whatever their names and types."""
    model = fit(docs.sparkSession)
    text = F.coalesce(F.col("_row.text"), F.lit(""))
    kinds = list(range(len(_GENERATORS)))
    found = common.as_row(docs).withColumn("kinds", F.struct(*[c.alias(k) for k, c in base_spans(text).items()])).withColumn("found", F.concat(*candidates(text)))
    base = [F.col(f"kinds.{k}") for k in BASE]
    found = found.withColumn("found", spans.apart(F.col("found"), base))

    def probability(s: Column) -> Column:
        # the trees ask for a feature many times: each is computed once
        each = features(s)
        return spans.with_(F.array(*[each[k].cast("double") for k in model.names]), model.probability)

    each = F.transform("found", lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s.alias("s"), probability(s).alias("p")))
    found = found.withColumn("likely", F.filter(each, lambda x: x["p"] >= least))
    found = found.withColumn("scored", F.struct(*[F.filter("likely", _of_kind(len(BASE) + i)).alias(f"g{i}") for i in kinds]))
    # of two that overlap the likelier one stays, of equals the one that is first
    better = lambda a, b: (a["kind"] != b["kind"]) & ((a["p"] > b["p"]) | ((a["p"] == b["p"]) & ((a["start"] < b["start"]) | ((a["start"] == b["start"]) & (a["kind"] < b["kind"])))))
    left = spans.best(F.col("likely"), [F.col(f"scored.g{i}") for i in kinds], better)
    added = F.coalesce(F.transform(left, lambda c: c["s"]), spans.none())
    kept = [c for c in docs.columns if c not in (column, f"base_{column}")]
    return found.select(*common.from_row(kept), F.concat(*base).alias(f"base_{column}"), F.concat(*base, added).alias(column))


def private_data(docs: DataFrame, least: float = LEAST) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256 and spans of every row.

    Null texts count as empty and have no spans. Repeated rows are searched each; of overlapping
    added spans the likelier one stays, of equally likely ones the first; long texts are searched
    whole, in time that grows little faster than they do. An empty table gives no rows; columns
    but doc_id and text are not looked at."""
    found = find(docs.select("doc_id", "text"), least)
    count = lambda k: F.size(F.filter("base_spans", lambda s: s["kind"] == k)).cast("long")
    names = BASE + ADDED
    return found.select("doc_id", *[count(k).alias(f"n_{name}") for k, name in enumerate(BASE)], F.sha2(spans.joined(F.col("base_spans"), names), 256).alias("base_sha256"), spans.joined(F.col("spans"), names).alias("spans"))


def op5_private_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return private_data(common.documents(spark, sf_dir))
