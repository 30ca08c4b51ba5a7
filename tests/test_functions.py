import math

import numpy as np
from pyspark.sql import functions as F

from kelpline.functions import phash, rules, text


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def L(x):
    return F.lit(x)


def cases():
    return [
        (text.sanitize(L("  a\x00b\tc \n")), "ab\tc"), (text.sanitize(L(None).cast("string")), ""), (text.sanitize(L(" " + "x" * 600)), "x" * 500),
        (text.strip_mention(L("@MyBot hi"), "mybot"), "hi"), (text.strip_mention(L("@mybot"), "mybot"), "@mybot"), (text.strip_mention(L("@other hi")), "hi"),
        (text.ascii_lower(L("ABCЖ")), "abcЖ"), (text.safe_filename(L("a b/ж.jpg")), "a_b_ж.jpg"),
        (text.html_to_text(L("<p>a<script>x</script>b</p> <b>c</b>")), "ab c"),
        (text.or_query(L("is the big fish")), "the OR big OR fish"),
        (text.display_name(L(""), L("B"), L("u"), L(7)), "B"), (text.display_name(L(""), L(None), L(""), L(7)), "7"),
        (text.large_url(L("http://x/1/square.jpg")), "http://x/1/large.jpg"), (text.large_url(L("x/square.jpg")), None),
        (text.redirect_target(L("//d/?uddg=https%3A%2F%2Fa.b&r=1")), "https://a.b"),
        (text.pieces(L("abcde"), 2), ["ab", "cd", "e"]), (text.class_map(L("a: b,c,d:e,a:f")), {"d": "e", "a": "f"}),
        (text.is_thumb(L("photos/a_thumb (2).JPG")), True), (text.is_photo_ref(L("photos/a.JPG")), True), (text.is_photo_ref(L("photos/a_thumb.jpg")), False),
        (text.page_number(L("messages.html")), 1), (text.page_number(L("messages12.html")), 12), (text.page_number(L("x.html")), 999999),
        (text.like_folded(L("Hello WORLD"), L("lo w")), True), (text.like_folded(L("abc"), L("a%c")), True),
        (rules.export_epoch(L("25.12.2017 19:47:37 UTC+03:00")), 1514220457), (rules.iso_utc(L(1514220457)), "2017-12-25T16:47:37Z"), (rules.export_epoch(L("nonsense")), None),
        (rules.compass(L(11.25)), "С"), (rules.compass(L(56.25)), "СВ"), (rules.compass(L(359.0)), "С"),
        (rules.outing_score(L(760.0), L(5.0), L(15.0), L(0.0)), 9), (rules.outing_score(L(740.0), L(40.0), L(30.0), L(9.0)), 1),
        (rules.hamming(L(0), L(15)), 4), (rules.human_size(L(1023)), "1023.0 B"), (rules.human_size(L(1536)), "1.5 KB"), (rules.human_time(L(3_661_000)), "1h 1m"),
        (rules.uptime(L(90061)), "1д 1ч 1м 1с"), (rules.uptime(L(59)), "59с"),
        (rules.passes_gate(L("whole_fish"), L(0.6)), True), (rules.passes_gate(L("whole_fish"), L(0.59)), False), (rules.passes_gate(L("lure"), L(0.9)), False),
        (rules.rejection(L("whole_fish"), L(0.9)), None), (rules.rejection(L("lure"), L(0.9)), rules.REJECTIONS["lure"]),
        (rules.species(L("pike"), L(0.64), ["pike"]), "unknown_fish"), (rules.species(L("pike"), L(0.65), ["pike"]), "pike"), (rules.species(L("cat"), L(1.0), ["pike"]), "unknown_fish"),
        (rules.capped_count(L(0)), 0), (rules.capped_count(L(None), 1), 1), (rules.capped_count(L(50)), 20),
        (rules.valid_amount(L("12.5")), 12.5), (rules.valid_amount(L("x")), None), (rules.valid_amount(L("1000001")), None),
        (rules.retry_delay(L("3"), L(1)), 3.0), (rules.retry_delay(L("x"), L(3)), 4.0), (rules.has_location(L(0.0), L(5.0)), False),
        (rules.size_bucket(L(1280)), "ge_1280"), (rules.size_bucket(L(800)), "800_1279"), (rules.size_bucket(L(400)), "400_799"), (rules.size_bucket(L(399)), "lt_400"),
        (rules.licensed(L("cc-by-nc"), "prefix", ["cc-by"]), True), (rules.licensed(L("cc-by-nc"), "prefix", ["cc-by"], strict=True), False), (rules.licensed(L("cc-by-4.0"), "prefix", ["cc-by"]), True), (rules.licensed(L("CC BY 4.0"), "exact", rules.EXACT_LICENCES), True),
        (rules.schedule_minutes(L("09:00")), 540), (rules.due(L(543), L("09:00"), L(None).cast("string"), L("d")), True), (rules.due(L(547), L("09:00"), L(None).cast("string"), L("d")), False),
        (rules.due(L(543), L("09:00"), L("d"), L("d")), False), (rules.due(L(1), L("23:58"), L(None).cast("string"), L("d")), False),
        (rules.rain_days(F.array(L("a"), L("b"), L("c"), L("d")), F.array(L(61), L(0), L(3), L(61)), F.array(L(0.0), L(0.0), L(1.0), L(9.0)), True), ["a", "c"]),
        (rules.weather_name(L(61)), "🌧 Небольшой дождь"), (rules.status_tier(L(3), L(0)), "ДЕГРАДАЦИЯ"), (rules.status_tier(L(0), L(301)), "ПРОСТОЙ"),
    ]


def test_values(spark):
    for i, (column, want) in enumerate(cases()):
        assert one(spark, column) == want, (i, column)


def test_mention(spark):
    e = F.array(F.struct(L("mention").alias("type"), L(0).alias("offset"), L(6).alias("length")))
    assert one(spark, text.mentioned(L("@MyBot hi"), e, "mybot"))
    assert not one(spark, text.mentioned(L("@other @mybot"), e, "mybot"))


def test_resampling():
    """Rows and columns by a plain Lanczos kernel in fixed point; enlarged pictures have nearly the same hash."""
    rng = np.random.default_rng(1)
    kernel = lambda x: 1.0 if x == 0 else math.sin(math.pi * x) / (math.pi * x) * math.sin(math.pi * x / 3) / (math.pi * x / 3) if abs(x) < 3 else 0.0

    def along(row):
        n, out = len(row), []
        for i in range(32):
            scale, centre = max(n / 32, 1), (i + 0.5) * n / 32
            low, high = max(int(centre - 3 * scale + 0.5), 0), min(int(centre + 3 * scale + 0.5), n)
            w = [kernel((x - centre + 0.5) / scale) for x in range(low, high)]
            out.append(min(255, max(0, (sum(int(v) * round(a / sum(w) * (1 << 22)) for v, a in zip(row[low:high], w, strict=True)) + (1 << 21)) >> 22)))
        return out

    for shape in ((20, 50), (70, 64), (33, 31)):
        gray = rng.integers(0, 256, shape)
        rows = [along(list(r)) for r in gray]
        want = np.array([along([r[x] for r in rows]) for x in range(32)]).T
        assert np.array_equal(phash._resized(gray, 32), want)
    big = rng.integers(0, 256, (64, 64)).repeat(4, 0).repeat(4, 1).astype(np.uint8)
    a, b = phash.phash(256, 256, 1, big.tobytes()), phash.phash(128, 128, 1, big[::2, ::2].tobytes())
    assert ((a ^ b) % 2**64).bit_count() <= 4
    assert phash.phash(-1, -1, 3, b"") is None
