"""Numeric, time and decision rules as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Class domains, thresholds, weather codes and compass points.
STAGE_A = ["whole_fish", "lure", "fish_part", "fry", "no_fish"]
COMPASS = ["С", "ССВ", "СВ", "ВСВ", "В", "ВЮВ", "ЮВ", "ЮЮВ", "Ю", "ЮЮЗ", "ЮЗ", "ЗЮЗ", "З", "ЗСЗ", "СЗ", "ССЗ"]
WEATHER = {
    0: "☀️ Ясно", 1: "🌤 Малооблачно", 2: "⛅ Переменная облачность", 3: "☁️ Пасмурно", 45: "🌫 Туман", 48: "🌫 Изморозь",
    51: "🌦 Лёгкая морось", 53: "🌦 Морось", 55: "🌧 Сильная морось", 61: "🌧 Небольшой дождь", 63: "🌧 Дождь", 65: "🌧 Сильный дождь",
    66: "🌨 Ледяной дождь", 67: "🌨 Сильный ледяной дождь", 71: "🌨 Небольшой снег", 73: "🌨 Снег", 75: "❄️ Сильный снег", 77: "❄️ Снежная крупа",
    80: "🌦 Ливень", 81: "🌧 Сильный ливень", 82: "⛈ Очень сильный ливень", 85: "🌨 Снегопад", 86: "❄️ Сильный снегопад",
    95: "⛈ Гроза", 96: "⛈ Гроза с градом", 99: "⛈ Сильная гроза с градом",
}
MEDALS = {1: "🥇", 2: "🥈", 3: "🥉"}
RAIN_WORDS = ["дождь", "дожд", "ливень", "осадки", "осадк", "мокр", "зонт", "промокн", "дожди", "дождик", "снег", "снеж", "метель", "гроза", "грозы"]
REJECTIONS = {
    "lure": "На фото рыболовная приманка (воблер/блесна/джиг), а не настоящая рыба",
    "fish_part": "На фото часть рыбы (нет головы или хвоста), а не целая рыба",
    "fry": "На фото малёк — слишком маленькая рыба, не считается уловом",
    "no_fish": "На фото нет рыбы или рыболовных объектов",
}
EXACT_LICENCES = ["http://creativecommons.org/publicdomain/zero/1.0/", "http://creativecommons.org/licenses/by/4.0/", "CC0_1_0", "CC_BY_4_0", "CC0 1.0", "CC BY 4.0"]
PART_LICENCES = ["cc0", "cc-by", "cc by", "public domain", "pd ", "pd-", "cc-by-sa", "cc by-sa", "cc-by 4", "cc-by-sa 4", "attribution"]
BLOCKED_TITLES = ["hybrid", "plug-in", "toyota", "kia", "car ", "automobile", "socket", "electric", "charger", "voltmeter", "connecto"]
LEAST_CONFIDENCE, LEAST_SPECIES = 0.60, 0.65


def export_epoch(c: Column) -> Column:
    """Epoch of ``dd.MM.yyyy HH:mm:ss UTC±hh:mm``; null for anything else."""
    ok = c.rlike(r"^\d{2}\.\d{2}\.\d{4} \d{2}:\d{2}:\d{2} UTC[+-]\d{2}:\d{2}$")
    return F.when(ok, F.try_to_timestamp(F.regexp_replace(c, "UTC", ""), F.lit("dd.MM.yyyy HH:mm:ss XXX")).cast("long"))


def iso_utc(epoch: Column) -> Column:
    return F.date_format(F.timestamp_seconds(epoch), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def minute_of_day(ts: Column) -> Column:
    return F.hour(ts) * 60 + F.minute(ts)


def schedule_minutes(c: Column) -> Column:
    """Minutes of 'HH:MM'; null if it isn't one."""
    return F.when(c.rlike(r"^\d{1,2}:\d{2}$"), F.split(c, ":")[0].cast("int") * 60 + F.split(c, ":")[1].cast("int"))


def due(now: Column, send_time: Column, last_sent: Column, today: Column, within: int = 5) -> Column:
    """Within some minutes of the time of day, both ends included and not across midnight, and not sent today."""
    return (F.abs(now - schedule_minutes(send_time)) <= within) & ~last_sent.eqNullSafe(today)


def next_daily(ts: Column, hour: int, minute: int = 0) -> Column:
    """When a job that runs once a day at that time is due next, after ``ts``."""
    today = F.date_trunc("day", ts) + F.make_dt_interval(F.lit(0), F.lit(hour), F.lit(minute))
    return F.when(today > ts, today).otherwise(today + F.make_dt_interval(F.lit(1)))


def next_tick(ts: Column, minutes: int) -> Column:
    """When a job that runs every few minutes, counted from the epoch, is due next, after ``ts``."""
    step = minutes * 60
    return F.timestamp_seconds((F.floor(F.unix_seconds(ts) / step) + 1) * step)


def uptime(seconds: Column) -> Column:
    """Days, hours and minutes that are not zero, and seconds."""
    n = seconds.cast("long")
    part = lambda value, unit: F.when(value > 0, F.concat(value.cast("string"), F.lit(unit)))
    day, hour, minute = (F.floor(n / 86400), F.floor(n % 86400 / 3600), F.floor(n % 3600 / 60))
    return F.concat_ws(" ", part(day, "д"), part(hour, "ч"), part(minute, "м"), F.concat((n % 60).cast("string"), F.lit("с")))


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def mmhg(hpa: Column) -> Column:
    return F.round(hpa * 0.75006, 1)


def compass(degrees: Column) -> Column:
    """Name of the nearest of 16 points; ties go to the even one."""
    point = (F.bround(degrees / 22.5) % 16).cast("int")
    return F.coalesce(F.element_at(F.array(*map(F.lit, COMPASS)), point + 1), F.lit("?"))


def outing_score(pressure: Column, wind: Column, temperature: Column, rain: Column) -> Column:
    """From 1 to 10: 5, plus or minus what pressure (mmHg), wind, temperature and rain say."""
    score = (
        F.lit(5)
        + F.when(pressure.between(755, 765), 2).when((pressure < 750) | (pressure > 770), -1).otherwise(0)
        + F.when(wind < 15, 1).when(wind > 30, -2).otherwise(0)
        + F.when(temperature.between(10, 25), 1).otherwise(0)
        + F.when(rain > 5, -1).otherwise(0)
    )
    return F.greatest(F.lit(1), F.least(F.lit(10), score))


def score_mark(score: Column) -> Column:
    return F.when(score >= 7, "🟢").when(score >= 4, "🟡").otherwise("🔴")


def weather_name(code: Column) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in WEATHER.items() for x in kv]), code), F.lit("?"))


def rainy(code: Column, rain: Column) -> Column:
    return code.between(51, 67) | code.between(80, 82) | code.between(95, 99) | (F.coalesce(rain, F.lit(0.0)) > 0)


def rain_days(days: Column, codes: Column, rain: Column, wet: bool, most: int = 3) -> Column:
    """Of the first days of a forecast held as arrays, those that are wet, or dry."""
    zipped = F.slice(F.arrays_zip(days.alias("day"), codes.alias("code"), rain.alias("rain")), 1, most)
    keep = lambda x: rainy(x["code"], x["rain"]) if wet else ~rainy(x["code"], x["rain"])
    return F.transform(F.filter(zipped, keep), lambda x: x["day"])


def human_size(n: Column, largest: str = "TB") -> Column:
    """In the greatest unit up to ``largest`` that leaves 1 or more."""
    text = lambda power, unit: F.format_string(f"%.1f {unit}", F.bround(n / float(1 << power), 1))
    units = ["B", "KB", "MB", "GB", "TB"]
    last = units.index(largest)
    out = F.when(F.lit(False), "")
    for i, unit in enumerate(units[:last]):
        out = out.when(n < 1 << 10 * (i + 1), text(10 * i, unit))
    return out.otherwise(text(10 * last, largest))


def human_time(milliseconds: Column) -> Column:
    n = F.call_function("div", milliseconds, F.lit(1000))  # whole numbers also beyond 2 ** 53
    minutes = F.concat(F.floor(n / 60).cast("string"), F.lit("m "), (n % 60).cast("string"), F.lit("s"))
    hours = F.concat(F.floor(n / 3600).cast("string"), F.lit("h "), F.floor(n % 3600 / 60).cast("string"), F.lit("m"))
    return F.when(n < 60, F.concat(n.cast("string"), F.lit("s"))).when(n < 3600, minutes).otherwise(hours)


def training_ms(images: Column, epochs: Column) -> Column:
    """100 milliseconds an image and epoch."""
    return images * epochs * 100


def retry_delay(retry_after: Column, attempt: Column) -> Column:
    """The server's wish if it is a positive number, else 2 to the power of attempt - 1."""
    wish = retry_after.try_cast("double")
    return F.when(wish > 0, wish).otherwise(F.pow(F.lit(2.0), attempt - 1))


def falsy(c: Column, default: Column) -> Column:
    """``c or default``: null and zero, or null and the empty string, give the default."""
    return F.when(c.isNull() | c.cast("string").isin("", "0", "0.0"), default).otherwise(c)


def capped_count(c: Column, floor: int = 0, most: int = 20) -> Column:
    """At most ``most``; zero and null give ``floor``."""
    return F.least(falsy(c.cast("int"), F.lit(floor)), F.lit(most))


def passes_gate(kind: Column, confidence: Column) -> Column:
    return F.coalesce((kind == "whole_fish") & (confidence >= LEAST_CONFIDENCE), F.lit(False))


def rejection(kind: Column, confidence: Column) -> Column:
    """The first reason that applies, or null."""
    low = F.format_string("Низкая уверенность определения (%.0f%%) — результат не записывается, чтобы не испортить статистику", F.bround(confidence * 100, 0))
    out = None
    for name, why in REJECTIONS.items():
        out = F.when(kind == name, why) if out is None else out.when(kind == name, why)
    return out.when(confidence < LEAST_CONFIDENCE, low)


def species(key: Column, confidence: Column, domain: list[str]) -> Column:
    """The key, or unknown_fish outside the domain or below the threshold."""
    return F.when(key.isin(*domain) & (clamped(confidence) >= LEAST_SPECIES), key).otherwise("unknown_fish")


def clamped(c: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))


def is_valid(confidence: Column) -> Column:
    """Positive confidence is valid, whatever the species."""
    return F.coalesce(confidence > 0, F.lit(False))


def confidence_label(c: Column) -> Column:
    return F.when(c >= 0.85, "высокая").when(c >= 0.65, "средняя").otherwise("низкая")


def valid_amount(c: Column) -> Column:
    """The amount as a number, if it is one from 0 to a million."""
    n = c.try_cast("double")
    return F.when(n.between(0, 1_000_000), n)


def intent(c: Column, known: list[str], default: str = "general") -> Column:
    return F.when(c.isin(*known), c).otherwise(default)


def stale(ts: Column, now: Column, seconds: int = 120) -> Column:
    return ts < now - F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(seconds))


def has_location(latitude: Column, longitude: Column) -> Column:
    """Both set and not zero: a zero coordinate counts as unset."""
    return F.coalesce((latitude != 0) & (longitude != 0), F.lit(False))


def size_bucket(side: Column) -> Column:
    return F.when(side >= 1280, "ge_1280").when(side >= 800, "800_1279").when(side >= 400, "400_799").when(side.isNotNull(), "lt_400")


def coverage_tier(n: Column, name: Column, special: str = "unknown_fish") -> Column:
    return F.when(name == special, "ok").when(n == 0, "empty").when(n < 15, "weak").when(n < 50, "soft_warn").otherwise("ok")


def status_tier(errors: Column, idle_seconds: Column) -> Column:
    return F.when(errors >= 10, "КРИТИЧНО").when(errors >= 3, "ДЕГРАДАЦИЯ").when(idle_seconds > 300, "ПРОСТОЙ").otherwise("РАБОТАЕТ")


def licensed(c: Column, rule: str, allowed: list[str], strict: bool = False) -> Column:
    """By exact name, by prefix (the name or its beginning before a hyphen), or by part. If
    ``strict``, a non-commercial or unchangeable licence is never taken for the free one whose
    name begins it."""
    name = F.trim(c) if rule == "exact" else F.lower(F.trim(c)) if rule == "prefix" else F.lower(c)
    fits = {
        "exact": name.isin(*allowed),
        "prefix": F.exists(F.array(*map(F.lit, allowed)), lambda a: (name == a) | F.startswith(name, F.concat(a, F.lit("-")))),
        "part": F.exists(F.array(*map(F.lit, allowed)), lambda a: F.contains(name, a)),
    }
    free = ~F.lower(name).rlike(r"(?:^|[^a-z])(?:nc|nd)(?:[^a-z]|$)") if strict else F.lit(True)
    return F.coalesce(fits[rule] & free, F.lit(False))


def usable_media(mime: Column, width: Column, height: Column, title: Column, size: Column, blocked: list[str]) -> Column:
    """An image of 200 pixels each way and 5000 bytes at least, with no blocked word in its title."""
    title = F.lower(title)
    fits = mime.startswith("image/") & (width >= 200) & (height >= 200) & (size >= 5000)
    for word in blocked:
        fits &= ~title.contains(word)
    return F.coalesce(fits, F.lit(False))


def first_media(media: Column, allowed: list[str]) -> Column:
    """The first item that is a still image with an address and an exactly allowed licence."""
    fits = F.filter(media, lambda m: (m["type"] == "StillImage") & m["identifier"].isNotNull() & m["license"].isin(*allowed))
    return F.try_element_at(fits, F.lit(1))


def first_photo(photos: Column, allowed: list[str], among: int = 3) -> Column:
    """The first licensed photo among the first few."""
    return F.try_element_at(F.filter(F.slice(photos, 1, among), lambda p: licensed(p["license_code"], "prefix", allowed)), F.lit(1))
