"""Queries over predicates, lookups and string functions of the library, over columns made from the
standard tables. Most texts of conversations serve as messages, parts as species, events as updates."""

from __future__ import annotations

from pyspark.sql import functions as F

from kelpline.functions import rules, text
from kelpline.operators import curation, store
from kelpline.plans.queries import query


def _pick(values: list, place) -> object:
    """The value at a place that runs on from the beginning."""
    return F.element_at(F.array(*map(F.lit, values)), (place % len(values) + 1).cast("int"))


def _sql_pick(values: list, place: str) -> str:
    return "list_extract([" + ",".join("null" if v is None else f"'{v}'" if isinstance(v, str) else str(v) for v in values) + f"], cast({place}%{len(values)} as int)+1)"


@query("select event_id, user_id from events where value>15")
def valid_only(t):
    e = t("events").withColumn("is_valid_catch", (F.col("value") > 15).cast("int"))
    return store.valid_only(e).select("event_id", "user_id")


_NAMES = ["photos/a{}.jpg", "photos/a{}_thumb.jpg", "photos/a{}_thumb (2).JPG", "files/a{}.jpg", "photos/A{}.JPG", "photos/a{}.png", "photos/_thumb{}.jpg", "a{}.tiff"]
_PATH = _sql_pick(_NAMES, "event_id")


@query(f"""with x as (select event_id, replace({_PATH}, '{{}}', cast(event_id as varchar)) as p from events)
select event_id, regexp_matches(p, '_thumb(\\s*\\(\\d+\\))?\\.jpg$', 'i') as thumb, p like 'photos/%' and lower(p) like '%.jpg' and not regexp_matches(p, '_thumb(\\s*\\(\\d+\\))?\\.jpg$', 'i') as photo,
 regexp_matches(lower(p), '\\.(jpg|jpeg|png|webp)$') as image, regexp_matches(lower(p), '\\.(jpg|jpeg|png|webp|bmp|tiff)$') as prepared from x""")
def path_predicates(t):
    from kelpline.sources.readers import SUFFIXES

    p = F.replace(_pick(_NAMES, F.col("event_id")), F.lit("{}"), F.col("event_id").cast("string"))
    rows = t("events").select("event_id", p.alias("p"))
    p = F.col("p")
    return rows.select("event_id", text.is_thumb(p).alias("thumb"), text.is_photo_ref(p).alias("photo"), text.has_suffix(p, SUFFIXES["validate"]).alias("image"), text.has_suffix(p, SUFFIXES["prepare"]).alias("prepared"))


_KINDS = ["whole_fish", "lure", "fish_part", "fry", "no_fish", None]


@query(f"""with x as (select event_id, {_sql_pick(_KINDS, 'event_id')} as kind, case when event_id%11=0 then null else cast(event_id%101 as double)/100 end as c from events)
select event_id, case kind when 'lure' then 'На фото рыболовная приманка (воблер/блесна/джиг), а не настоящая рыба' when 'fish_part' then 'На фото часть рыбы (нет головы или хвоста), а не целая рыба'
 when 'fry' then 'На фото малёк — слишком маленькая рыба, не считается уловом' when 'no_fish' then 'На фото нет рыбы или рыболовных объектов'
 else case when c<0.6 then 'Низкая уверенность определения ('||cast(round_even(c*100,0) as int)||'%) — результат не записывается, чтобы не испортить статистику' end end as reason,
 coalesce(c>0,false) as valid, case when kind in ('lure','fry') and greatest(0,least(1,c))>=0.65 then kind else 'unknown_fish' end as species from x""")
def rejection_rules(t):
    c = F.when(F.col("event_id") % 11 != 0, (F.col("event_id") % 101).cast("double") / 100)
    rows = t("events").select("event_id", _pick(_KINDS, F.col("event_id")).alias("kind"), c.alias("c"))
    k, c = F.col("kind"), F.col("c")
    return rows.select("event_id", rules.rejection(k, c).alias("reason"), rules.is_valid(c).alias("valid"), rules.species(k, c, ["lure", "fry"]).alias("species"))


@query("""with x as (select conv_id, turn, case when turn%3=0 then '@SomeBot '||text when turn%3=1 then text else '@somebot in text' end as body, turn%4<3 as entity from conversations)
select conv_id, turn, entity and lower(substr(body,1,8))='@somebot' as mentioned from x""")
def mention_test(t):
    """Only an entity at the beginning that is the bot's name counts; the text alone doesn't."""
    k = F.col("turn")
    body = F.when(k % 3 == 0, F.concat(F.lit("@SomeBot "), "text")).when(k % 3 == 1, F.col("text")).otherwise("@somebot in text")
    entity = F.array(F.struct(F.when(k % 4 < 3, "mention").otherwise("bold").alias("type"), F.lit(0).alias("offset"), F.lit(8).alias("length")))
    return t("conversations").select("conv_id", "turn", text.mentioned(body, entity, "somebot").alias("mentioned"))


_AMOUNTS = ["12.5", "0", "-1", "1000000", "1000000.5", "abc", "", None, "1e3"]


@query(f"select o_orderkey, case when try_cast({_sql_pick(_AMOUNTS, 'o_orderkey')} as double) between 0 and 1000000 then try_cast({_sql_pick(_AMOUNTS, 'o_orderkey')} as double) end as amount from orders")
def amount_rules(t):
    return t("orders").select("o_orderkey", rules.valid_amount(_pick(_AMOUNTS, F.col("o_orderkey"))).alias("amount"))


_INTENTS = ["search", "weather", "joke", "photo", None]


@query(f"""select doc_id, contains(lower(text),'que') or contains(lower(text),'ung') as any_word, case when {_sql_pick(_INTENTS, 'doc_id')} in ('search','weather','photo') then {_sql_pick(_INTENTS, 'doc_id')} else 'general' end as intent from documents""")
def keyword_and_intent(t):
    return t("documents").select("doc_id", text.contains_any(F.col("text"), ["que", "ung"]).alias("any_word"), rules.intent(_pick(_INTENTS, F.col("doc_id")), ["search", "weather", "photo"]).alias("intent"))


@query("select c_custkey, coalesce(case when c_custkey%5=0 then 0 when c_custkey%7=0 then null else c_acctbal end<>0 and c_custkey%11<>0, false) as located from customer")
def location_guard(t):
    """A zero coordinate counts as unset."""
    lat = F.when(F.col("c_custkey") % 5 == 0, 0.0).when(F.col("c_custkey") % 7 != 0, F.col("c_acctbal"))
    return t("customer").select("c_custkey", rules.has_location(lat, (F.col("c_custkey") % 11).cast("double")).alias("located"))


@query("""with m as (select p_partkey, p_type, case p_type when 'ECONOMY' then 'eco' when 'PROMO' then 'pro' end as found from part)
select p_partkey, coalesce(found, p_type) as kept, found as mapped, case p_type when 'ECONOMY' then 'Эконом' else '?' end as shown from m""")
def class_lookup(t):
    """A parsed class map with the class itself as fallback, without one, and display names with a default."""
    p = t("part").select("p_partkey", "p_type")
    parsed = text.class_map(F.lit("ECONOMY: eco, PROMO:pro,broken, ECONOMY :eco"))
    mapped = p.withColumn("mapped", F.try_element_at(parsed, F.col("p_type")))
    kept = store.looked_up(mapped, F.col("p_type"), {"ECONOMY": "eco", "PROMO": "pro"}, "kept", F.col("p_type"))
    return store.looked_up(kept, F.col("p_type"), {"ECONOMY": "Эконом"}, "shown", F.lit("?")).select("p_partkey", "kept", "mapped", "shown")


@query("select p_partkey, case p_type when 'ECONOMY' then 'eco' else 'pro' end as name from part where p_type in ('ECONOMY','PROMO')")
def class_lookup_strict(t):
    """What the map lacks is left out."""
    return store.looked_up(t("part"), F.col("p_type"), {"ECONOMY": "eco", "PROMO": "pro"}, "name").select("p_partkey", "name")


@query("select cast(coalesce(sum(p_size),0) as bigint) as bytes, (select count(*)*50*100 from part) as milliseconds from part where p_partkey%3=0")
def disk_and_training(t):
    used = curation.disk_usage(t("part").filter("p_partkey % 3 = 0"), "p_size")
    n = t("part").agg(F.count("*").alias("n"))
    return used.crossJoin(F.broadcast(n)).select("bytes", rules.training_ms(F.col("n"), F.lit(50)).alias("milliseconds"))


# ---------- strings ----------
@query("select conv_id, turn, trim(replace(replace(lower(text),'que',''),'qu','')) as left_text from conversations")
def keyword_strip(t):
    return t("conversations").select("conv_id", "turn", text.strip_words(F.col("text"), ["que", "qu"]).alias("left_text"))


@query(r"select doc_id, regexp_replace(substr(text,1,60)||'/x y.z-é_1', '[^\p{L}\p{N}._-]', '_', 'g') as name from documents")
def safe_filenames(t):
    return t("documents").select("doc_id", text.safe_filename(F.concat(F.substring("text", 1, 60), F.lit("/x y.z-é_1"))).alias("name"))


@query("""with x as (select c_custkey, case when c_custkey%3=0 then '' else c_mktsegment end as f, case when c_custkey%5<3 then null else 'L'||c_nationkey end as l, case when c_custkey%2=0 then c_name else '' end as u from customer)
select c_custkey, coalesce(nullif(concat_ws(' ', nullif(f,''), l),''), nullif(u,''), cast(c_custkey as varchar)) as name from x""")
def display_name_rules(t):
    k = F.col("c_custkey")
    first, last = F.when(k % 3 == 0, "").otherwise(F.col("c_mktsegment")), F.when(k % 5 >= 3, F.concat(F.lit("L"), "c_nationkey"))
    return t("customer").select("c_custkey", text.display_name(first, last, F.when(k % 2 == 0, F.col("c_name")).otherwise(""), k).alias("name"))


@query("""select page_id, case when page_id%4=3 then null else replace(replace(url||'/'||case page_id%4 when 0 then 'square' when 1 then 'medium' else 'huge' end||'.jpg','/square.','/large.'),'/medium.','/large.') end as large,
 case when page_id%2=0 then 'https://a b/ü?x='||page_id else url end as target from pages""")
def url_rules(t):
    size = _pick(["square", "medium", "huge", "huge"], F.col("page_id"))
    address = F.when(F.col("page_id") % 4 == 3, F.concat(F.lit("ftp:"), "url")).otherwise(F.concat("url", F.lit("/"), size, F.lit(".jpg")))
    redirect = F.when(F.col("page_id") % 2 == 0, F.concat(F.lit("//d/l/?uddg=https%3A%2F%2Fa%20b%2F%C3%BC%3Fx%3D"), "page_id", F.lit("&rut=1"))).otherwise(F.col("url"))
    return t("pages").select("page_id", text.large_url(address).alias("large"), text.redirect_target(redirect).alias("target"))


@query("select doc_id, unnest(range(0, cast(ceil(length(text)/4000.0) as int))) as i, substr(text, i*4000+1, 4000) as piece from documents")
def text_pieces(t):
    return t("documents").select("doc_id", F.posexplode(text.pieces(F.col("text"))).alias("i", "piece")).select("doc_id", F.col("i").cast("long").alias("i"), "piece")


# ---------- numbers ----------
@query("""with x as (select o_orderkey, o_orderkey*37 as n from orders)
select o_orderkey, concat_ws(' ', case when n//86400>0 then (n//86400)||'д' end, case when n%86400//3600>0 then (n%86400//3600)||'ч' end, case when n%3600//60>0 then (n%3600//60)||'м' end, (n%60)||'с') as uptime,
 round((n%1100)*0.75006::double, 1) as mmhg from x""")
def uptime_and_pressure(t):
    n = F.col("o_orderkey") * 37
    return t("orders").select("o_orderkey", rules.uptime(n).alias("uptime"), rules.mmhg((n % 1100).cast("double")).alias("mmhg"))


_WAITS = ["5", "0", "-2", "soon", None, "1.5"]


@query(f"with x as (select event_id, try_cast({_sql_pick(_WAITS, 'event_id')} as double) as w from events) select event_id, case when w>0 then w else cast(pow(2, event_id%4) as double) end as delay from x")
def retry_delays(t):
    return t("events").select("event_id", rules.retry_delay(_pick(_WAITS, F.col("event_id")), F.col("event_id") % 4 + 1).alias("delay"))


@query("""select p_partkey, case p_partkey%100 when 0 then '☀️ Ясно' when 1 then '🌤 Малооблачно' when 2 then '⛅ Переменная облачность' when 3 then '☁️ Пасмурно' when 45 then '🌫 Туман' when 48 then '🌫 Изморозь'
 when 51 then '🌦 Лёгкая морось' when 53 then '🌦 Морось' when 55 then '🌧 Сильная морось' when 61 then '🌧 Небольшой дождь' when 63 then '🌧 Дождь' when 65 then '🌧 Сильный дождь'
 when 66 then '🌨 Ледяной дождь' when 67 then '🌨 Сильный ледяной дождь' when 71 then '🌨 Небольшой снег' when 73 then '🌨 Снег' when 75 then '❄️ Сильный снег' when 77 then '❄️ Снежная крупа'
 when 80 then '🌦 Ливень' when 81 then '🌧 Сильный ливень' when 82 then '⛈ Очень сильный ливень' when 85 then '🌨 Снегопад' when 86 then '❄️ Сильный снегопад'
 when 95 then '⛈ Гроза' when 96 then '⛈ Гроза с градом' when 99 then '⛈ Сильная гроза с градом' else '?' end as name, case when p_size%11>=7 then '🟢' when p_size%11>=4 then '🟡' else '🔴' end as mark from part""")
def weather_names(t):
    return t("part").select("p_partkey", rules.weather_name((F.col("p_partkey") % 100).cast("int")).alias("name"), rules.score_mark(F.col("p_size") % 11).alias("mark"))


@query("""select event_id, epoch(case when date_trunc('day',ts)+interval 7 hour>ts then date_trunc('day',ts)+interval 7 hour else date_trunc('day',ts)+interval 31 hour end)::bigint as daily,
 cast((cast(floor(epoch(ts)) as bigint)//300+1)*300 as bigint) as tick from events""")
def job_times(t):
    """When a daily job at seven and one of every five minutes are due after each event."""
    ts = F.col("ts").cast("timestamp")
    return t("events").select("event_id", F.unix_seconds(rules.next_daily(ts, 7)).alias("daily"), F.unix_seconds(rules.next_tick(ts, 5)).alias("tick"))
