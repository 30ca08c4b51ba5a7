"""Queries and writes of the chat store: history, names, catches, expenses.

Writes are functions from the old table and the new rows to the new table, as files don't
change in place; the caller writes the result. Every order ends in a key, so limits and
row numbers are the same on each run.
"""

from __future__ import annotations

import heapq
from decimal import Decimal

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kelpline.functions.text import ascii_lower


# ---- scans, top-k, existence (S1-S3, F1-F5, O1-O7, A3, A4) ----
def recent(df: DataFrame, n: int, time: str, key: str, where: Column | None = None) -> DataFrame:
    """The latest n rows; within one time the greatest key first."""
    df = df if where is None else df.filter(where)
    return df.orderBy(F.col(time).desc_nulls_last(), F.col(key).desc()).limit(n)


def first_of(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """The first row of each key."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rank", F.row_number().over(w)).filter("_rank = 1").drop("_rank")


def earliest(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """The first row of each key by ascending columns. One aggregate with partial minima: a key's
    rows need not meet."""
    row = F.min_by(F.struct(*df.columns), F.struct(*order))
    return df.groupBy(*keys).agg(row.alias("_row")).select(*[F.col(f"_row.{c}").alias(c) for c in df.columns])


def last_value(df: DataFrame, keys: list[str], *order: str) -> DataFrame:
    """The last row of each key. One aggregate with partial maxima, so that a key with very many
    rows is no burden."""
    row = F.max(F.struct(*order, *[c for c in df.columns if c not in keys and c not in order]))
    return df.groupBy(*keys).agg(row.alias("_row")).select(*[c if c in keys else F.col(f"_row.{c}").alias(c) for c in df.columns])


def existing(df: DataFrame, other: DataFrame, on) -> DataFrame:
    return df.join(other, on, "left_semi")


def missing(df: DataFrame, other: DataFrame, on) -> DataFrame:
    return df.join(other, on, "left_anti")


def valid_only(df: DataFrame, wanted: bool = True, column: str = "is_valid_catch") -> DataFrame:
    return df.filter(F.col(column) == 1) if wanted else df


# ---- leaderboard and counts (A1, A2, W9) ----
def active_session(sessions: DataFrame) -> DataFrame:
    """The newest active session of each chat; within one second the one inserted first."""
    active = sessions.filter("status = 'active'")
    row = F.max_by(F.struct(*active.columns), F.struct("created_at", -F.col("inserted")))
    return active.groupBy("chat_id").agg(row.alias("_row")).select("_row.*")


def session_expenses(expenses: DataFrame) -> DataFrame:
    """Expenses with their place in the order of time, by session."""
    return expenses.withColumn("place", F.row_number().over(Window.partitionBy("session_id").orderBy("created_at", "id")))


def leaderboard(df: DataFrame, person: str, count: str, weight: str, species: str, key: Column) -> DataFrame:
    """By person without ASCII case: catches, fish, total and greatest weight, the name as
    written on the heaviest catch, and the species in order. Order by total weight, nulls last.
    A person's distinct species are made distinct before they are collected."""
    folded = ascii_lower(F.col(person))
    kilos = F.col(weight).cast("decimal(18,2)")
    return (
        df.groupBy(folded.alias("person_key"))
        .agg(
            F.count("*").alias("catches"),
            F.sum(F.col(count)).cast("double").alias("total_fish"),
            F.sum(kilos).cast("double").alias("total_weight"),
            F.max(F.col(weight)).alias("best_weight"),
            F.max_by(F.col(person), F.struct(F.col(weight), -key)).alias("person_name"),
            F.array_join(F.array_sort(F.collect_set(F.col(species))), ",").alias("species"),
        )
        .orderBy(F.col("total_weight").desc_nulls_last(), "person_key")
    )


def counts_by_kind(df: DataFrame, valid: Column, kinds: dict[str, Column]) -> DataFrame:
    """Totals in one pass: all, valid, rejected, and one count for each further condition."""
    return df.agg(F.count("*").alias("total"), F.count_if(valid).alias("valid"), F.count_if(~valid).alias("rejected"), *[F.count_if(c).alias(k) for k, c in kinds.items()])


def ranked(df: DataFrame, *order: Column) -> DataFrame:
    """Rows with rank and, for the first three, a medal. For short, already aggregated tables."""
    from kelpline.functions.rules import MEDALS

    medals = F.create_map(*[F.lit(x) for kv in MEDALS.items() for x in kv])
    return df.withColumn("rank", F.row_number().over(Window.orderBy(*order))).withColumn("medal", F.try_element_at(medals, F.col("rank")))


# ---- writes (K1-K6) ----
def insert_ignore(old: DataFrame, new: DataFrame, keys: list[str], *arrival: Column) -> DataFrame:
    """The first writer of a key wins. Nulls in a key never clash."""
    whole = F.lit(True)
    for k in keys:
        whole &= F.col(k).isNotNull()
    fresh = first_of(new.filter(whole), keys, *arrival).unionByName(new.filter(~whole))
    return old.unionByName(fresh.join(old, keys, "left_anti"), allowMissingColumns=True)


def insert_replace(old: DataFrame, new: DataFrame, keys: list[str], *arrival: Column) -> DataFrame:
    """The last writer of a key wins, with the whole row."""
    both = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)), allowMissingColumns=True)
    return first_of(both, keys, F.col("_new").desc(), *[a.desc() for a in arrival]).drop("_new")


def upsert(old: DataFrame, new: DataFrame, keys: list[str], keep_if_null: list[str]) -> DataFrame:
    """New rows overwrite; a null in ``keep_if_null`` leaves the stored value. An empty string is
    a value. ``new`` has a key once."""
    o, n = old.alias("o"), new.alias("n")
    on = [F.col(f"o.{k}") == F.col(f"n.{k}") for k in keys]
    came = F.col(f"n.{keys[0]}").isNotNull()

    def pick(c: str) -> Column:
        if c in keys or c in keep_if_null:
            return F.coalesce(F.col(f"n.{c}"), F.col(f"o.{c}")).alias(c)
        return F.when(came, F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")).alias(c)

    return o.join(n, on, "full_outer").select(*map(pick, old.columns))


def update(df: DataFrame, where: Column, values: dict[str, Column]) -> DataFrame:
    hit = F.coalesce(where, F.lit(False))
    return df.select(*[F.when(hit, values[c]).otherwise(F.col(c)).alias(c) if c in values else F.col(c) for c in df.columns])


# ---- lookups (J9-J11, J13-J15) ----
def resolve_alias(df: DataFrame, aliases: DataFrame, name: str, keys: list[str]) -> DataFrame:
    """``resolved``: the canonical name of a name in any case, or the name itself."""
    a = aliases.select(*keys, F.lower("alias").alias("_alias"), "canonical_name")
    left = df.withColumn("_alias", F.lower(name))
    return left.join(a, [*keys, "_alias"], "left").withColumn("resolved", F.coalesce("canonical_name", F.col(name))).drop("_alias", "canonical_name")


def with_name(df: DataFrame, users: DataFrame, keys: list[str], user: str) -> DataFrame:
    names = users.select(*keys, F.col("display_name").alias("_name"))
    return df.join(names, keys, "left").withColumn("shown_name", F.coalesce("_name", F.col(user).cast("string"))).drop("_name")


def nearest_location(asked: DataFrame, locations: DataFrame) -> DataFrame:
    """The user's own location in the chat, else the latest of the chat."""
    own = locations.select("chat_id", "user_id", F.struct("latitude", "longitude").alias("_own"))
    latest = locations.groupBy("chat_id").agg(F.max_by(F.struct("latitude", "longitude"), F.struct("updated_at", "user_id")).alias("_chat"))
    place = F.coalesce("_own", "_chat")
    return asked.join(own, ["chat_id", "user_id"], "left").join(latest, "chat_id", "left").select(*asked.columns, place["latitude"].alias("latitude"), place["longitude"].alias("longitude"))


def looked_up(df: DataFrame, key: Column, table: dict[str, str], out: str, default: Column | None = None) -> DataFrame:
    """A small fixed map; without default, rows that it hasn't are left out."""
    found = F.try_element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), key)
    return df.withColumn(out, F.coalesce(found, default) if default is not None else found).filter(F.col(out).isNotNull())


def with_zero_counts(names: DataFrame, counts: DataFrame, on: str, n: str = "n") -> DataFrame:
    return names.join(counts, on, "left").withColumn(n, F.coalesce(n, F.lit(0)))


# ---- expenses (A5, U1, W10, T6) ----
def sharers(split: Column, participants: Column, payer: Column) -> Column:
    """Who shares: the split if it is a JSON list with names; the payer alone if it is an empty
    list; else the session's participants, or the payer alone if there are none."""
    own, everyone = F.from_json(split, "array<string>"), F.from_json(participants, "array<string>")
    alone = F.array(payer)
    group = F.when(F.size(everyone) > 0, everyone).otherwise(alone)
    return F.when(F.size(own) > 0, own).when(F.size(own) == 0, alone).otherwise(group)


_MONEY = "decimal(20,6)"


def shares(expenses: DataFrame, sessions: DataFrame) -> DataFrame:
    """(session_id, name, paid, owed) rows, as decimals: what each expense lets its payer and sharers count."""
    e = expenses.join(sessions.select("session_id", "participants"), "session_id", "left")
    e = e.withColumn("_by", sharers(F.col("split_among"), F.col("participants"), F.col("paid_by_name")))
    none, money = F.lit(0).cast(_MONEY), F.col("amount").cast(_MONEY)
    paid = e.select("session_id", F.col("paid_by_name").alias("name"), money.alias("paid"), none.alias("owed"))
    owed = e.select("session_id", F.explode("_by").alias("name"), none.alias("paid"), (F.col("amount") / F.size("_by")).cast(_MONEY).alias("owed"))
    return paid.unionByName(owed)


def balances(expenses: DataFrame, sessions: DataFrame) -> DataFrame:
    """paid, owed and their difference by session and name, as decimals: sums don't depend on the order of rows."""
    total = shares(expenses, sessions).groupBy("session_id", "name").agg(*[F.sum(c).cast(_MONEY).alias(c) for c in ("paid", "owed")])
    return total.withColumn("balance", (F.col("paid") - F.col("owed")).cast(_MONEY))


def settled(people: list[tuple[str, Decimal]], least: Decimal) -> list[tuple[str, str, Decimal]]:
    """(debtor, creditor, amount) of one session's balances: debtors by debt, each to the creditors
    in the order of what is still due to them, equal amounts by name. Creditors wait in a heap."""
    due = [(-x, name) for name, x in people if x > least]
    heapq.heapify(due)
    moves = []
    for debt, debtor in sorted((x, name) for name, x in people if -x > least):
        rest = -debt
        while due and rest > least:
            most, creditor = heapq.heappop(due)
            amount = min(rest, -most)
            moves.append((debtor, creditor, amount))
            rest -= amount
            if -most - amount > least:
                heapq.heappush(due, (most + amount, creditor))
    return moves


def settlements(balance: DataFrame, least: float = 0.01) -> DataFrame:
    """Who pays whom, by session (``settled``). The people of one session meet in a task, as who pays next
    depends on all before; a session of n people takes n log n steps. Rows of one name are one."""
    bound, money = Decimal(str(least)), pa.decimal128(20, 6)

    def run(table: pa.Table) -> pa.Table:
        moves = settled(list(zip(table.column("name").to_pylist(), table.column("balance").to_pylist(), strict=True)), bound)
        columns = list(zip(*moves, strict=True)) or [(), (), ()]
        session = pa.array([table.column("session_id")[0].as_py()] * len(moves), table.schema.field("session_id").type)
        return pa.table([session, pa.array(columns[0], pa.string()), pa.array(columns[1], pa.string()), pa.array(columns[2], money)], names=["session_id", "debtor", "creditor", "amount"])

    kind = balance.schema["session_id"].dataType.simpleString()
    people = balance.groupBy("session_id", "name").agg(F.sum("balance").cast(_MONEY).alias("balance")).filter(F.abs("balance") > F.lit(bound))
    moves = people.groupBy("session_id").applyInArrow(run, f"session_id {kind}, debtor string, creditor string, amount {_MONEY}")
    return moves.select("session_id", "debtor", "creditor", F.round("amount", 2).cast("double").alias("amount"))


def receipts_once(expenses: DataFrame, keys: list[str], file: str, *arrival: Column) -> DataFrame:
    """The first expense of each photo of a receipt; expenses without a photo all stay."""
    with_file = expenses.filter(F.col(file).isNotNull())
    return earliest(with_file, [*keys, file], *arrival).unionByName(expenses.filter(F.col(file).isNull()))


def due_for(events: DataFrame, schedules: DataFrame, minute: Column, at: Column, within: int = 5) -> DataFrame:
    """Pairs of an event and a schedule whose minutes of the day are within some minutes, both ends included and not
    across midnight. Minutes are cut into bins as wide as the reach; a schedule goes to the bins
    that it reaches into, two or three, so the join is on equality of bins."""
    width = 2 * within + 1
    e = events.withColumn("_minute", minute).withColumn("_bin", F.floor(F.col("_minute") / width))
    s = schedules.withColumn("_at", at).filter("_at is not null")
    s = s.withColumn("_bin", F.explode(F.sequence(F.floor((F.col("_at") - within) / width), F.floor((F.col("_at") + within) / width))))
    return e.join(s, "_bin").filter(F.abs(F.col("_minute") - F.col("_at")) <= within).drop("_bin", "_minute", "_at")


def due_counts(events: DataFrame, schedules: DataFrame, key: str, event: str, minute: Column, at: Column, within: int = 5) -> DataFrame:
    """(key, due, first): for each schedule's key the number of its pairs in ``due_for``, and their least event, without making
    the pairs. Events are counted by their minute and minutes meet minutes, so what is broadcast
    to the schedules has a row for each time of day."""
    minutes = events.select(minute.alias("_m"), F.col(event).alias("_e")).filter("_m is not null").groupBy("_m").agg(F.count("*").alias("_n"), F.min("_e").alias("_first"))
    timed = schedules.select(key, at.alias("_time")).filter("_time is not null")
    met = due_for(minutes, timed.select("_time").distinct(), F.col("_m"), F.col("_time"), within)
    sums = met.groupBy("_time").agg(F.sum("_n").alias("_n"), F.min("_first").alias("_first"))
    return timed.join(F.broadcast(sums), "_time").groupBy(key).agg(F.sum("_n").alias("due"), F.min("_first").alias("first"))
