"""Queries over what the pipelines exchange as files: pages, images, labels, answers, archives. The
standard tables are written in these forms into the shared folder, and read back by the library."""

from __future__ import annotations

import io
import struct
import zipfile

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kelpline.functions import phash, rules, text
from kelpline.operators import clusters, intake, store
from kelpline.plans.queries import Tables, query
from kelpline.sources import buckets, html_export, paged, readers, sinks
from kelpline.sources.scratch import scratch_path, stored
from kelpline.streaming import jobs


def _folder(df: DataFrame, name: str) -> str:
    return scratch_path(df.sparkSession, name)


# ---------- scans ----------
@query("select o_orderkey, o_custkey from orders order by o_totalprice desc, o_orderkey limit 1")
def single_row(t):
    row = readers.one(t("orders").orderBy(F.desc("o_totalprice"), "o_orderkey").select("o_orderkey", "o_custkey"))
    return t("orders").sparkSession.createDataFrame([row] if row else [], "o_orderkey long, o_custkey long")


@query("select max(o_orderkey) as value from orders")
def scalar_value(t):
    value = readers.scalar(t("orders").agg(F.max("o_orderkey")))
    return t("orders").sparkSession.createDataFrame([(value,)], "value long")


@query("select conv_id as chat_id, turn as message_id, role as message_type, text as message_text, null::varchar as username from conversations")
def json_lines_scan(t):
    """Lines of JSON, a blank one after every third."""
    c = t("conversations")
    line = F.to_json(F.struct(F.col("conv_id").alias("chat_id"), F.col("turn").alias("message_id"), F.col("role").alias("message_type"), F.col("text").alias("message_text")))
    path = _folder(c, "lines")
    c.select(F.when(F.col("turn") % 3 == 0, F.concat(line, F.lit("\n\n"))).otherwise(line).alias("value")).write.text(path)
    return readers.json_lines(c.sparkSession, path, "messages").select("chat_id", "message_id", "message_type", "message_text", "username")


@query("""with m as (select event_id%700 as k, max_by(event_type, event_id) as sender, max(event_id) as last from events group by 1)
select c_custkey, coalesce(m.sender, '') as sender, m.last from customer left join m on m.k=c_custkey""")
def manifest_join(t):
    """Audited files with the last manifest line of each; files without one get defaults."""
    lines = t("events").select((F.col("event_id") % 700).alias("k"), "event_id", "event_type")
    last = readers.last_per_key(lines, "k", F.col("event_id"))
    joined = t("customer").select("c_custkey").join(last, F.col("c_custkey") == F.col("k"), "left")
    return joined.select("c_custkey", F.coalesce("event_type", F.lit("")).alias("sender"), F.col("event_id").alias("last"))


_SUFFIXES = [".jpg", ".JPG", ".png", ".webp", ".bmp", ".txt", ".tiff", ".gif"]


@query("""select replace(r_name,' ','_') as cls, 'n'||n_nationkey as stem, cast(n_nationkey+3 as bigint) as length, n_nationkey%8=4 as extra from nation join region on n_regionkey=r_regionkey where n_nationkey%8<5""")
def image_scan(t):
    """Images in class folders; which suffixes count differs by step."""
    n = t("nation").join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    suffix = F.element_at(F.array(*map(F.lit, _SUFFIXES)), (F.col("n_nationkey") % 8 + 1).cast("int"))
    path = _folder(n, "images")
    sinks.files(n.select(F.concat(F.replace("r_name", F.lit(" "), F.lit("_")), F.lit("/n"), "n_nationkey", suffix).alias("path"), F.rpad(F.lit("x"), F.col("n_nationkey") + 3, "x").alias("content")), path)
    found = readers.images(n.sparkSession, path, readers.SUFFIXES["labels"])
    return found.select("cls", "stem", "length", (~text.has_suffix(F.col("path"), readers.IMAGES)).alias("extra"))


@query("""select replace(r_name,' ','_') as cls, count(*) as n from nation join region on n_regionkey=r_regionkey where n_nationkey%8<4 group by 1""")
def class_folders(t):
    n = t("nation").join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    suffix = F.element_at(F.array(*map(F.lit, _SUFFIXES)), (F.col("n_nationkey") % 8 + 1).cast("int"))
    path = _folder(n, "classes")
    sinks.files(n.select(F.concat(F.replace("r_name", F.lit(" "), F.lit("_")), F.lit("/n"), "n_nationkey", suffix).alias("path"), F.lit("x").alias("content")), path)
    return readers.images(n.sparkSession, path, recursive=False).groupBy("cls").agg(F.count("*").alias("n"))


def _bitmap(width: int, height: int, value: int) -> bytes:
    """An uncompressed picture of one grey with a diagonal."""
    row = (3 * width + 3) // 4 * 4
    body = b"".join(bytes(value if x != y else 255 - value for x in range(width) for _ in range(3)).ljust(row, b"\0") for y in range(height))
    return b"BM" + struct.pack("<IHHI", 54 + len(body), 0, 0, 54) + struct.pack("<IiiHHIIiiII", 40, width, height, 1, 24, 0, len(body), 0, 0, 0, 0) + body


def _pictures(t: Tables) -> tuple[DataFrame, str]:
    """A small picture for each nation; every sixth can't be decoded."""
    import pyarrow as pa

    def run(batches):
        for batch in batches:
            keys, regions = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            content = [b"BMxx" if k % 6 == 5 else _bitmap(k % 4 * 300 + 20, r + 10, k * 9 % 256) for k, r in zip(keys, regions, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array([f"n{k}.bmp" for k in keys]), pa.array(content, pa.binary())], names=["path", "content"])

    made = t("nation").select(F.col("n_nationkey").cast("int"), F.col("n_regionkey").cast("int")).mapInArrow(run, "path string, content binary")
    path = _folder(made, "pictures")
    sinks.files(made, path)
    return made, path


_AUDIT = """a as (select 'n'||n_nationkey||'.bmp' as filename, n_nationkey%6=5 as corrupt, case when n_nationkey%6<>5 then cast(n_nationkey%4*300+20 as int) end as width, case when n_nationkey%6<>5 then cast(n_regionkey+10 as int) end as height from nation),
b as (select *, greatest(width, height) as max_side, cast(case when corrupt then 4 else 54+((3*width+3)//4*4)*height end as bigint) as file_size from a)"""


@query(f"with {_AUDIT} select filename, width, height, max_side, file_size, coalesce(max_side<800,false) as low_res, corrupt from b")
def image_audit(t):
    made, path = _pictures(t)
    return intake.audit_record(readers.image_sizes(made.sparkSession, path)).drop("sha256")


@query()
def image_hashes(t):
    """Perceptual hashes of the pictures; no SQL computes them."""
    made, path = _pictures(t)
    images = made.sparkSession.read.format("image").option("dropInvalid", "true").load(path)
    return phash.with_phash(images).select(F.element_at(F.split("image.origin", "/"), -1).alias("filename"), "phash")


@query()
def image_clusters(t):
    """From image files to the rows of the cluster file: perceptual hashes, pairs within 8 bits, and of each
    cluster the largest image kept. No SQL computes the hashes; a test has all pairs."""
    made, path = _pictures(t)
    images = made.sparkSession.read.format("image").option("dropInvalid", "true").load(path)
    hashes = stored(phash.with_phash(images).select(F.element_at(F.split("image.origin", "/"), -1).alias("filename"), F.greatest("image.width", "image.height").alias("max_side"), "phash"), "hashes")
    members = clusters.near_clusters(clusters.near_pairs(hashes, "filename", "phash", 8))
    rows = hashes.join(members.select(F.col("node").alias("filename"), "component"), "filename").withColumn("msg_id", F.lit(None).cast("long"))
    return clusters.clustered(rows, "component", "filename", clusters.perceptual_order(), "perceptual")


_BLOCKED = " or ".join(f"contains(lower(text), '{w}')" for w in rules.BLOCKED_TITLES)


@query(f"select doc_id, ({_BLOCKED}) as blocked from documents where text is not null")
def blocked_titles(t):
    """Titles with a word that image searches return for other things."""
    low = F.lower("text")
    found = F.lit(False)
    for w in rules.BLOCKED_TITLES:
        found = found | low.contains(w)
    return t("documents").filter("text is not null").select("doc_id", found.alias("blocked"))


@query("""select n_nationkey as k, n_name as name, cast(n_regionkey as varchar) as region from nation where n_nationkey%5<>4""")
def naive_csv_scan(t):
    """Lines without quoting, a header in each file, and lines that are too short."""
    n = t("nation").withColumn("line", F.when(F.col("n_nationkey") % 5 == 4, F.concat("n_nationkey", F.lit(",short"))).otherwise(F.concat_ws(", ", "n_nationkey", "n_name", "n_regionkey")))
    files = n.groupBy("n_regionkey").agg(F.concat(F.lit("k,name,region\n"), F.array_join(F.sort_array(F.collect_list("line")), "\n")).alias("content"))
    path = _folder(n, "csv")
    sinks.files(files.select(F.concat(F.lit("r"), "n_regionkey", F.lit(".csv")).alias("path"), "content"), path)
    return readers.naive_csv(n.sparkSession, path, ["k", "name", "region"]).select(F.col("k").cast("long").alias("k"), "name", "region")


@query("select c_nationkey||'.yaml' as file, cast(row_number() over (partition by c_nationkey order by c_name)-1 as int) as i, c_name as name from customer")
def yaml_name_list(t):
    """A YAML file for each nation with its customers' names, in one of three forms."""
    names = F.sort_array(F.collect_list("c_name"))
    c = t("customer").groupBy("c_nationkey").agg(names.alias("n"))
    form = F.col("c_nationkey") % 3
    dashed = F.concat(F.lit("\n  - '"), F.array_join("n", "'\n  - '"), F.lit("'\n"))
    numbered = F.concat(F.lit("\n"), F.array_join(F.transform("n", lambda x, i: F.concat(F.lit("  "), i.cast("string"), F.lit(": "), x)), "\n"), F.lit("\n"))
    inline = F.concat(F.lit(" ['"), F.array_join("n", "', '"), F.lit("']\n"))
    content = F.concat(F.lit("path: x\nnames:"), F.when(form == 0, dashed).when(form == 1, numbered).otherwise(inline), F.lit("nc: 5\n"))
    path = _folder(c, "yaml")
    sinks.files(c.select(F.concat("c_nationkey", F.lit(".yaml")).alias("path"), content.alias("content")), path)
    return readers.yaml_lists(c.sparkSession, path)


@query("select 'r'||n_regionkey||'.zip' as archive, 'labels/n'||n_nationkey||'.txt' as entry, n_name as text from nation")
def zip_scan(t):
    """Landed archives, one for each region, and one that is broken."""
    import pyarrow as pa

    def run(batches):
        for batch in batches:
            for k, names, texts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                out = io.BytesIO()
                with zipfile.ZipFile(out, "w") as z:
                    z.writestr("labels/", "")
                    for name, content in zip(names, texts, strict=True):
                        z.writestr(f"labels/n{name}.txt", content)
                yield pa.RecordBatch.from_arrays([pa.array([f"r{k}.zip", f"broken{k}.zip"]), pa.array([out.getvalue(), b"PK"], pa.binary())], names=["path", "content"])

    n = t("nation").groupBy("n_regionkey").agg(F.collect_list("n_nationkey").alias("k"), F.collect_list("n_name").alias("x"))
    path = _folder(n, "zip")
    sinks.files(n.mapInArrow(run, "path string, content binary"), path)
    return readers.zip_entries(n.sparkSession, path).select("archive", "entry", F.col("content").cast("string").alias("text"))


def _landed(df: DataFrame, name: str) -> str:
    path = _folder(df, name)
    df.write.json(path)
    return path


_MEDIA = """m as (select p_partkey as key, p_brand as species, p_partkey//50*50 as off, p_partkey%3=0 as video, p_partkey%4=1 as nowhere, p_partkey%5<2 as free from part)"""


@query(f"""with {_MEDIA}, last as (select min(off) as o from m where off%250=200)
select key, species, cast(case when not nowhere and free then key else null end as bigint) as first_media from m, last where last.o is null or off<=last.o""")
def paged_occurrences(t):
    """Landed pages of 50, of which every fifth says it is the last; the first usable medium of each."""
    p = t("part").withColumn("off", F.floor(F.col("p_partkey") / 50) * 50)
    address = F.when(F.col("p_partkey") % 4 != 1, F.concat(F.lit("http://x/"), "p_partkey"))
    licence = F.when(F.col("p_partkey") % 5 < 2, rules.EXACT_LICENCES[1]).otherwise("all rights reserved")
    medium = lambda kind: F.struct(F.lit(kind).alias("type"), address.alias("identifier"), licence.alias("license"), F.lit("c").alias("creator"))
    media = F.when(F.col("p_partkey") % 3 == 0, F.array(medium("Sound"), medium("StillImage"))).otherwise(F.array(medium("StillImage")))
    page = p.groupBy("off").agg(F.collect_list(F.struct(F.col("p_partkey").alias("key"), F.col("p_brand").alias("species"), media.alias("media"))).alias("results"))
    path = _landed(page.select(F.col("off").alias("offset"), (F.col("off") % 250 == 200).alias("endOfRecords"), "results"), "occurrences")
    found = readers.occurrences(p.sparkSession, path).withColumn("m", rules.first_media(F.col("media"), rules.EXACT_LICENCES))
    return found.select("key", "species", F.regexp_extract(F.col("m.identifier"), "([0-9]+)$", 1).try_cast("long").alias("first_media"))


def _page_files(t):
    """(path, content, off): pages of 50 parts as files that are named by their offset; every fifth says it is the last."""
    p = t("part").withColumn("off", F.floor(F.col("p_partkey") / 50) * 50)
    medium = F.struct(F.lit("StillImage").alias("type"), F.concat(F.lit("http://x/"), "p_partkey").alias("identifier"), F.lit("c").alias("license"), F.lit(None).cast("string").alias("creator"))
    page = p.groupBy("off").agg(F.sort_array(F.collect_list(F.struct(F.col("p_partkey").alias("key"), F.col("p_brand").alias("species"), F.when(F.col("p_partkey") % 4 != 1, F.array(medium)).alias("media")))).alias("results"))
    content = F.to_json(F.struct(F.col("off").alias("offset"), (F.col("off") % 250 == 200).alias("endOfRecords"), "results"))
    return page.select(F.format_string("%012d.json", F.col("off")).alias("path"), content.alias("content"), "off")


_PAGES = "select p_partkey as key, p_brand as species, case when p_partkey%4<>1 then 'http://x/'||p_partkey end as address from part"


@query(f"""with m as (select p_partkey//50*50 as off, * from part), last as (select min(off) as o from m where off%250=200)
select * from ({_PAGES}) where key in (select p_partkey from m, last where last.o is null or off<=last.o)""")
def paged_source(t):
    """Pages through the data source, a range of them per task, up to the first that says it is the last."""
    pages = _page_files(t)
    path = scratch_path(pages.sparkSession, "pages")
    sinks.files(pages.select("path", "content"), path)
    found = paged.up_to_last(paged.read(pages.sparkSession, path, limit="50", pages="4"))
    return found.select("key", "species", F.col("media")[0]["identifier"].alias("address"))


@query(_PAGES)
def paged_stream(t):
    """Pages as they land, in two runs with a restart between: the second run asks for none of the first's."""
    pages = _page_files(t)
    spark = pages.sparkSession
    path, out, state = (scratch_path(spark, f"pages_{x}") for x in ("in", "out", "state"))
    half = pages.agg(F.floor(F.max("off") / 2).alias("h")).first()["h"]
    found = None
    for part in (pages.filter(F.col("off") <= half), pages.filter(F.col("off") > half)):
        sinks.files(part.select("path", "content"), path)
        found = jobs.run_to_end(paged.stream(spark, path, limit="50", pages="4"), out, state)
    return found.select("key", "species", F.col("media")[0]["identifier"].alias("address"))


@query("""with o as (select o_custkey as id, list({'k': o_orderkey, 'free': o_orderkey%4=0} order by o_orderkey) as p from orders group by 1),
f as (select id, list_filter(p[1:3], lambda x: x.free) as f from o)
select id, case when len(f)>0 then f[1].k end as photo from f""")
def paged_observations(t):
    """Observations with photos, and the first licensed one of the first three."""
    photo = F.struct(F.col("o_orderkey").alias("id"), F.concat(F.lit("http://x/square."), "o_orderkey").alias("url"), F.when(F.col("o_orderkey") % 4 == 0, "cc-by-4.0").otherwise("c").alias("license_code"))
    seen = t("orders").groupBy("o_custkey").agg(F.sort_array(F.collect_list(photo)).alias("photos"))
    result = F.struct(F.col("o_custkey").alias("id"), F.lit("research").alias("quality_grade"), F.struct(F.lit("x").alias("name")).alias("taxon"), "photos")
    path = _landed(seen.groupBy(F.floor(F.col("o_custkey") / 100).alias("page")).agg(F.collect_list(result).alias("results")), "observations")
    found = readers.observations(seen.sparkSession, path)
    return found.select("id", rules.first_photo(F.col("photos"), ["cc0", "cc-by", "cc-by-sa"])["id"].alias("photo"))


@query("""with x as (select p_partkey, p_name, p_partkey%300 as w, p_partkey%400 as h, p_size*300 as size, case when p_partkey%7=0 then 'video/mp4' else 'image/jpeg' end as mime from part)
select p_partkey, mime like 'image/%' and w>=200 and h>=200 and size>=5000 and not contains(lower(p_name),'red ') as usable from x""")
def image_answers(t):
    """Landed answers of an image search, and which images are usable."""
    p = t("part")
    info = F.struct(F.concat(F.lit("http://x/"), "p_partkey").alias("url"), F.when(F.col("p_partkey") % 7 == 0, "video/mp4").otherwise("image/jpeg").alias("mime"), (F.col("p_partkey") % 300).cast("int").alias("width"), (F.col("p_partkey") % 400).cast("int").alias("height"), (F.col("p_size") * 300).cast("long").alias("size"), F.lit("cc0").alias("license"))
    entry = F.struct(F.col("p_partkey").cast("string"), F.struct(F.upper("p_name").alias("title"), F.array(info).alias("imageinfo")))
    answers = p.groupBy(F.floor(F.col("p_partkey") / 20).alias("b")).agg(F.map_from_entries(F.collect_list(entry)).alias("pages"))
    path = _landed(answers.select(F.struct("pages").alias("query")), "image_infos")
    found = readers.image_infos(p.sparkSession, path)
    usable = rules.usable_media(F.col("mime"), F.col("width"), F.col("height"), F.col("title"), F.col("size"), ["red "])
    return found.select(F.col("page_id").cast("long").alias("p_partkey"), usable.alias("usable"))


@query("""select c_custkey as user_id, c_nationkey as chat_id, c_name as display_name from customer where c_custkey%2=0
union all select c_custkey, c_nationkey, case when c_custkey%3=0 then null else c_mktsegment end from customer where c_custkey%2=1""")
def legacy_union(t):
    """Tables of two older layouts: of a column's old names the first present one counts, even if it is null."""
    c = t("customer")
    first = c.filter("c_custkey % 2 = 0").select(F.col("c_custkey").alias("uid"), F.col("c_nationkey").cast("long").alias("chat_id"), F.col("c_name").alias("display_name"))
    second = c.filter("c_custkey % 2 = 1").select(F.col("c_custkey").alias("user_id"), F.col("c_nationkey").cast("long").alias("chat"), F.when(F.col("c_custkey") % 3 != 0, F.col("c_mktsegment")).alias("name"), F.col("c_name").alias("nick"))
    out = readers.legacy(c.sparkSession, [first, second], "users", {"user_id": ["user_id", "uid"], "chat_id": ["chat_id", "chat"], "display_name": ["display_name", "name", "nick"]})
    return out.select("user_id", F.col("chat_id").cast("int").alias("chat_id"), "display_name")


@query("""select doc_id, doc_id%3=0 as known, case when doc_id%3=0 then n_chars end as result, substr(sha1(source||'/'||doc_id||'|v2|cpu'),1,20) as cache_key from documents""")
def cache_split(t):
    """Rows whose result is cached, and the others with their keys."""
    d = t("documents").select("doc_id", F.concat_ws("/", "source", "doc_id").alias("path"), "n_chars")
    key = F.substring(F.sha1(F.concat_ws("|", "path", F.lit("v2"), F.lit("cpu"))), 1, 20)
    cache = d.filter("doc_id % 3 = 0").select(key.alias("cache_key"), F.col("n_chars").alias("result"))
    known, new = readers.cached(d.select("doc_id", "path"), cache, F.col("path"), "v2", "cpu")
    parts = [known.select("doc_id", F.lit(True).alias("known"), "result", "cache_key"), new.select("doc_id", F.lit(False).alias("known"), F.lit(None).cast("long").alias("result"), "cache_key")]
    return parts[0].unionByName(parts[1])


@query("""with d as (select n_nationkey as k, unnest(range(0,4)) as i from nation), x as (select k, i, cast((k*7+i*13)%100 as int) as code, case when (k+i)%6=0 then 1.5 else 0.0 end as rain from d),
 y as (select *, code between 51 and 67 or code between 80 and 82 or code between 95 and 99 or rain>0 as wet from x)
select k, coalesce(string_agg('d'||i, ',' order by i) filter (where wet and i<3), '') as wet_days, coalesce(string_agg('d'||i, ',' order by i) filter (where not wet and i<3), '') as dry_days, cast(count(*) as int) as days,
 case max(case when i=0 then code end) when 0 then '☀️ Ясно' when 61 then '🌧 Небольшой дождь' when 63 then '🌧 Дождь' when 77 then '❄️ Снежная крупа' else 'x' end as today from y group by 1""")
def weather_scan(t):
    """Landed forecasts of four days: wet and dry days of the first three, and the first day's weather in words."""
    n = t("nation")
    each = lambda f: F.transform(F.sequence(F.lit(0), F.lit(3)), f)
    k = F.col("n_nationkey").cast("int")
    daily = F.struct(each(lambda i: F.concat(F.lit("d"), i)).alias("time"), each(lambda i: (k * 7 + i * 13) % 100).alias("weathercode"), each(lambda i: F.when((k + i) % 6 == 0, 1.5).otherwise(0.0)).alias("precipitation_sum"))
    path = _landed(n.select(k.cast("double").alias("latitude"), F.lit(0.0).alias("longitude"), daily.alias("daily")), "weather")
    days = readers.weather(n.sparkSession, path)
    lists = days.groupBy("latitude").agg(F.sort_array(F.collect_list(F.struct("time", "weathercode", "precipitation_sum"))).alias("d"))
    rain = lambda wet: F.array_join(rules.rain_days(F.col("d.time"), F.col("d.weathercode"), F.col("d.precipitation_sum"), wet), ",")
    name = rules.weather_name(F.col("d")[0]["weathercode"])
    shown = F.when(F.col("d")[0]["weathercode"].isin(0, 61, 63, 77), name).otherwise("x")
    return lists.select(F.col("latitude").cast("int").alias("k"), rain(True).alias("wet_days"), rain(False).alias("dry_days"), F.size("d").alias("days"), shown.alias("today"))


# ---------- sinks ----------
@query("""select s_name, cast(row_number() over (order by s_suppkey) as bigint) as id from supplier where s_suppkey%2=0
union all select s_name, (select count(*) from supplier where s_suppkey%2=0)+row_number() over (order by s_suppkey) from supplier where s_suppkey%2=1""")
def insert_returning(t):
    """Two inserts; ids are counted on."""
    s = t("supplier").select("s_suppkey", "s_name")
    path = _folder(s, "inserted")
    first = sinks.insert(s.filter("s_suppkey % 2 = 0"), path, "s_suppkey").select("s_name", "id")
    return first.unionByName(sinks.insert(s.filter("s_suppkey % 2 = 1"), path, "s_suppkey").select("s_name", "id"))


@query("select n_nationkey, n_name, count(*) as n from (select * from nation union all select * from nation where n_nationkey%2=0) group by 1,2")
def append_rows(t):
    """Appended twice; a dry run between them writes nothing."""
    n = t("nation").select("n_nationkey", "n_name")
    path = _folder(n, "appended")
    sinks.append(n, path)
    sinks.append(n, path, dry_run=True)
    sinks.append(n.filter("n_nationkey % 2 = 0"), path)
    return n.sparkSession.read.parquet(path).groupBy("n_nationkey", "n_name").agg(F.count("*").alias("n"))


@query("select event_id, event_type, case when event_id%5=0 then null else value end as value from events")
def json_sink(t):
    e = t("events").select("event_id", "event_type", F.when(F.col("event_id") % 5 != 0, F.col("value")).alias("value"))
    path = _folder(e, "json")
    sinks.json_lines(e, path)
    return e.sparkSession.read.schema("event_id long, event_type string, value double").json(path)


@query("select count(*) as rows, max(event_id) as last, count(*) filter (where event_type='error') as errors from events")
def summary_sink(t):
    """Only aggregates are written; what is returned equals what was written."""
    e = t("events")
    path = _folder(e, "summary")
    sinks.summary(e.agg(F.count("*").alias("rows"), F.max("event_id").alias("last"), F.count_if(F.col("event_type") == "error").alias("errors")), path)
    return e.sparkSession.read.schema("rows long, last long, errors long").json(path)


@query("""select s_name as stem, cast(i as int) as line, (s_suppkey%5)||' 0.5 0.5 0.'||(i+1)||' 0.2' as value from (select *, unnest(range(0, s_nationkey%3)) as i from supplier)
union all select s_name, cast(s_nationkey%3 as int), '' from supplier where s_nationkey%3>0""")
def label_file_sink(t):
    """A label file for the picture of each supplier. Empty files of pictures without objects have no line."""
    s = t("supplier")
    n = F.col("s_nationkey") % 3
    lines = F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.concat(F.col("s_suppkey") % 5, F.lit(" 0.5 0.5 0."), i + 1, F.lit(" 0.2\n")))).otherwise(F.array().cast("array<string>"))
    path = _folder(s, "labels")
    sinks.label_files(s.select(F.when(F.col("s_suppkey") % 3 == 0, "val").otherwise("train").alias("split"), F.col("s_name").alias("stem"), F.array_join(lines, "").alias("text")), path)
    return readers.label_lines(s.sparkSession, f"{path}/*")


@query("select n_name as filename, 'first' as source, 'cc0' as license from nation union all select r_name, 'second', 'cc-by' from region")
def provenance_sink(t):
    """Records of two sources in one table, the second without the first's columns."""
    n = t("nation")
    path = _folder(n, "provenance")
    sinks.provenance(n.select(F.col("n_name").alias("filename"), F.lit("first").alias("source"), F.lit("cc0").alias("license")), path)
    sinks.provenance(t("region").select(F.col("r_name").alias("filename"), F.lit("second").alias("source"), F.lit("cc-by").alias("license")), path)
    return n.sparkSession.read.schema("filename string, source string, license string").parquet(path)


# ---------- export ----------
_REF = "case when event_id%4<2 then 'photos/p'||(event_id%97)||'.jpg' when event_id%4=2 then 'photos/p'||(event_id%97)||'_thumb.jpg' end"
_EXPORT = f"""x as (select cast(event_id//1000+1 as int) as page, event_id, row_number() over (partition by event_id//1000 order by event_id)-1 as position, {_REF} as href,
 case when event_id%3=0 then (case when event_id%15=0 then '' else event_type||'&'||user_id end) end as from_name, event_id%3=0 as has_name,
 strftime(ts + interval 3 hour, '%d.%m.%Y %H:%M:%S')||' UTC+03:00' as date, case when event_id%5<2 then 'n '||event_id||' <'||event_type||'>' else '' end as caption, epoch(date_trunc('second', ts)) as stamp from events),
 named as (select *, sum(case when has_name then 1 else 0 end) over (partition by page order by position rows unbounded preceding) as run from x),
 sent as (select *, case when run>0 then nullif(max(case when has_name then from_name end) over (partition by page, run),'') end as sender from named),
 photo as (select *, row_number() over (partition by href order by page, position) as r from sent where href is not null and href not like '%_thumb.jpg')"""


def _export(t: Tables) -> DataFrame:
    """The event log as pages of an exported chat, of a thousand messages each: page, html."""
    e, k = t("events"), F.col("event_id")
    photo = F.concat(F.lit("photos/p"), k % 97)
    href = F.when(k % 4 < 2, F.concat(photo, F.lit(".jpg"))).when(k % 4 == 2, F.concat(photo, F.lit("_thumb.jpg")))
    name = F.when(k % 15 == 0, "").otherwise(F.concat("event_type", F.lit("&amp;"), "user_id"))
    caption = F.when(k % 5 < 2, F.concat(F.lit("n "), k, F.lit(" &lt;"), "event_type", F.lit("&gt;"))).otherwise("")
    date = F.concat(F.date_format(F.col("ts") + F.expr("interval 3 hours"), "dd.MM.yyyy HH:mm:ss"), F.lit(" UTC+03:00"))
    div = lambda cls, inside: F.concat(F.lit(f'<div class="{cls}">'), inside, F.lit("</div>\n"))
    message = F.concat(
        F.lit('<div class="message default clearfix" id="message'), k, F.lit('"><div class="body"><div class="pull_right date details" title="'), date, F.lit('">12:00</div>\n'),
        F.when(k % 3 == 0, div("from_name", name)).otherwise(""), F.when(href.isNotNull(), F.concat(F.lit('<a class="photo_wrap clearfix" href="'), href, F.lit('"></a>'))).otherwise(""), div("text", caption), F.lit("</div></div>"),
    )
    pages = e.groupBy((F.floor(k / 1000) + 1).cast("int").alias("page")).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(k, message.alias("m")))), lambda x: x["m"]), '\n<div class="message service">x</div>\n').alias("html"))
    return pages.select("page", F.concat(F.lit("<html><body>"), "html", F.lit("</body></html>")).alias("html"))


@query(f"with {_EXPORT} select page, cast(position as int) as position, event_id as msg_id, date, has_name, from_name, href, caption from x")
def export_messages(t):
    return html_export.messages(_export(t))


@query(f"""with {_EXPORT} select href as filename, event_id as msg_id, cast(stamp as bigint) as timestamp, strftime(make_timestamp(cast(stamp*1000000 as bigint)),'%Y-%m-%dT%H:%M:%SZ') as timestamp_iso, sender as sender_name, caption, 's' as source, 'l' as license, regexp_extract(href,'p(\\d+)',1)::int%10=9 as parse_error from photo where r=1""")
def export_manifest(t):
    """A record for each photo at its first reference, with the sender carried on; a tenth of the photos is absent."""
    there = t("events").sparkSession.range(97).filter("id % 10 <> 9").select(F.concat(F.lit("photos/p"), "id", F.lit(".jpg")).alias("filename"))
    return html_export.manifest(_export(t), "s", "l", there)[0]


@query(f"""with {_EXPORT}, refs as (select distinct href from x where href is not null)
select (select count(*) from photo where r=1) as records, (select count(*) from photo where r=1 and caption<>'') as captions, (select count(*) from photo where r=1 and length(caption)>100) as captions_over_100,
 cast((select max(length(caption)) from photo where r=1) as int) as longest_caption, (select count(*) from photo where r=1 and regexp_extract(href,'p(\\d+)',1)::int%10=9) as parse_errors,
 (select count(*) from refs) as raw_refs, (select count(*) from refs where href like '%_thumb.jpg') as thumbs, (select count(*) from refs where href not like '%_thumb.jpg') as photos,
 (select count(*) from photo where r>1) as duplicate_refs, (select count(*) from photo) as candidates""")
def manifest_summary(t):
    pages = _export(t)
    there = t("events").sparkSession.range(97).filter("id % 10 <> 9").select(F.concat(F.lit("photos/p"), "id", F.lit(".jpg")).alias("filename"))
    records, later = html_export.manifest(pages, "s", "l", there)
    return intake.manifest_summary(records, intake.photo_refs(pages), later)


@query(f"with {_EXPORT} select distinct href as ref from x where href is not null")
def raw_photo_refs(t):
    return intake.photo_refs(_export(t))


@query("""select 'messages'||case when n_nationkey=0 then '' else cast(n_nationkey+1 as varchar) end||'.html' as file, cast(n_nationkey+1 as int) as page, n_name as html from nation union all select 'other.html', 999999, 'x'""")
def page_order(t):
    """Pages as files: the first has no number, other files come last."""
    n = t("nation")
    name = F.concat(F.lit("messages"), F.when(F.col("n_nationkey") > 0, (F.col("n_nationkey") + 1).cast("string")).otherwise(""), F.lit(".html"))
    files = n.select(name.alias("path"), F.col("n_name").alias("content")).unionByName(n.sparkSession.range(1).select(F.lit("other.html").alias("path"), F.lit("x").alias("content")))
    path = _folder(n, "pages")
    sinks.files(files, path)
    return readers.pages(n.sparkSession, path)


@query("""select c_nationkey as chat_id, max_by(c_custkey, (c_acctbal, -c_custkey)) as session_id from customer where c_mktsegment<>'MACHINERY' group by 1""")
def active_sessions(t):
    c = t("customer").select(F.col("c_nationkey").alias("chat_id"), F.col("c_custkey").alias("session_id"), F.when(F.col("c_mktsegment") == "MACHINERY", "closed").otherwise("active").alias("status"), F.col("c_acctbal").alias("created_at"), F.col("c_custkey").alias("inserted"))
    return store.active_session(c).select("chat_id", "session_id")


@query("select o_orderkey%50 as session_id, o_orderkey as id, cast(row_number() over (partition by o_orderkey%50 order by o_orderdate, o_orderkey) as int) as place from orders")
def expenses_in_order(t):
    e = t("orders").select((F.col("o_orderkey") % 50).alias("session_id"), F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("created_at"))
    return store.session_expenses(e).select("session_id", "id", "place")


@query("""with o as (select c_custkey, c_name, c_acctbal, c_mktsegment from customer),
u as (select s_suppkey as c_custkey, s_name as c_name, s_acctbal as c_acctbal, case when s_suppkey%2=0 then s_name end as c_mktsegment from supplier),
m as (select c_custkey, coalesce(u.c_name, o.c_name) as c_name, coalesce(u.c_acctbal, o.c_acctbal) as c_acctbal, coalesce(u.c_mktsegment, o.c_mktsegment) as c_mktsegment from o full join u using (c_custkey))
select c_custkey, c_name, case when n.c is not null then n.c else c_acctbal end as c_acctbal, c_mktsegment from m left join (select n_nationkey as c_custkey, cast(n_nationkey as double) as c from nation) n using (c_custkey) where c_custkey not in (select r_regionkey from region)""")
def bucketed_writes(t):
    """An upsert, an update and a delete of customers in place: only the folders of their keys are written."""
    people = t("customer").select("c_custkey", "c_name", "c_acctbal", "c_mktsegment")
    spark, path = people.sparkSession, scratch_path(people.sparkSession, "bucketed")
    buckets.create(people, path, ["c_custkey"], 32)
    came = t("supplier").select(F.col("s_suppkey").alias("c_custkey"), F.col("s_name").alias("c_name"), F.col("s_acctbal").alias("c_acctbal"), F.when(F.col("s_suppkey") % 2 == 0, F.col("s_name")).alias("c_mktsegment"))
    buckets.upsert(spark, path, ["c_custkey"], 32, came, ["c_mktsegment"])
    buckets.update(spark, path, ["c_custkey"], 32, t("nation").select(F.col("n_nationkey").cast("long").alias("c_custkey"), F.col("n_nationkey").cast("double").alias("c_acctbal")))
    buckets.delete(spark, path, ["c_custkey"], 32, t("region").select(F.col("r_regionkey").cast("long").alias("c_custkey")))
    return buckets.read(spark, path)
