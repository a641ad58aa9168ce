"""Usage, prices, quotas, health, throttling, history."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.functions.text import ascii_lower

# fixed values: US dollars a million tokens, in and out
MODEL_PRICES = (
    ("gpt-5.6-sol", 5.0, 30.0),
    ("gpt-5.6-terra", 2.5, 15.0),
    ("gpt-5.6-luna", 1.0, 6.0),
    ("gpt-5.5", 5.0, 30.0),
    ("gpt-5.4", 2.5, 15.0),
    ("gpt-5.4-mini", 0.75, 4.5),
    ("gpt-5.4-nano", 0.2, 1.25),
    ("o4-mini", 1.1, 4.4),
)
LOCAL_PROVIDER = "ollama"
# fixed values: the services that report heartbeats
DAEMONS = ("ocr", "classifier", "indexer", "search")
STALE_SECONDS = 90


def price_calls(calls: DataFrame, prices: DataFrame) -> DataFrame:
    """calls (model, provider, prompt, completion) with usd and local: local calls cost nothing, unknown models have no price."""
    local = F.col("provider") == LOCAL_PROVIDER
    cost = F.col("prompt") / 1e6 * F.col("input_per_mtok") + F.col("completion") / 1e6 * F.col("output_per_mtok")
    return calls.join(prices, "model", "left").select(*calls.columns, F.when(local, 0.0).otherwise(cost).alias("usd"), local.alias("local"))


def price_table(payload: object) -> tuple[list[tuple[str, float, float]], str]:
    """Rows of prices and the date of a price list {currency, as_of, models: {name: {input_per_mtok, output_per_mtok}}}; ValueError names what is wrong."""
    if not isinstance(payload, dict) or payload.get("currency") != "USD":
        raise ValueError("a price list is an object with prices in USD")
    as_of, models = payload.get("as_of"), payload.get("models")
    if not isinstance(as_of, str) or not as_of.strip():
        raise ValueError("as_of must be a date")
    if not isinstance(models, dict) or not models:
        raise ValueError("models must have entries")
    rows = []
    for model, entry in models.items():
        prices = []
        for name in ("input_per_mtok", "output_per_mtok"):
            value = entry.get(name) if isinstance(entry, dict) else None
            if isinstance(value, bool) or not isinstance(value, (int, float)) or not 0 <= value < float("inf"):
                raise ValueError(f"{model}: {name} must be a finite number of 0 or more")
            prices.append(float(value))
        rows.append((model, *prices))
    return rows, as_of


def roll_up_costs(priced: DataFrame, *keys: str) -> DataFrame:
    """Per key: calls, tokens, usd (none if any call has none) and local (all are)."""
    return priced.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("calls"),
        F.sum("prompt").alias("prompt"),
        F.sum("completion").alias("completion"),
        F.when(~F.bool_or(F.col("usd").isNull()), F.sum("usd")).alias("usd"),
        F.bool_and("local").alias("local"),
    )


def daily_usage(calls: DataFrame, key: str, ts: str, tokens: Column) -> DataFrame:
    """key, day (UTC), tokens, calls."""
    return calls.groupBy(key, F.to_date(ts).alias("day")).agg(F.sum(tokens).cast("long").alias("tokens"), F.count(F.lit(1)).alias("calls"))


def add_usage(usage: DataFrame, more: DataFrame, key: str) -> DataFrame:
    """Both day tables added up."""
    return usage.unionByName(more).groupBy(key, "day").agg(F.sum("tokens").alias("tokens"), F.sum("calls").alias("calls"))


def over_quota(keys: DataFrame, usage: DataFrame, key: str, day: str) -> DataFrame:
    """Keys with a quota above 0 that the day's tokens reach; a missing day is 0. keys: key, quota."""
    today = usage.where(F.col("day") == F.lit(day).cast("date")).select(key, "tokens")
    return keys.join(today, key, "left").withColumn("tokens", F.coalesce("tokens", F.lit(0).cast("long"))).where("quota > 0 AND tokens >= quota")


def recent_searches(searches: DataFrame, most: int = 20) -> DataFrame:
    """user_id, query, id, created: each user's newest entry of a query, and of those the newest `most`."""
    newest = searches.groupBy("user_id", "query").agg(F.max(F.struct("created", "id")).alias("m")).select("user_id", "query", F.col("m.id").alias("id"), F.col("m.created").alias("created"))
    n = F.row_number().over(Window.partitionBy("user_id").orderBy(F.col("created").desc(), F.col("id").desc()))
    return newest.withColumn("_n", n).where(F.col("_n") <= most).drop("_n")


def lockouts(failures: DataFrame, key: list[str], threshold: int, seconds: int = 900) -> DataFrame:
    """Failures at which a key has `threshold` within the last `seconds` (detection; streaming/throttle.py also locks and resets). failures: key columns, ts.

    A key's failures are one window's partition, sorted and spilled as a whole; for a key that holds a large part of a log replay it by throttle_batch, which takes a batch's memory."""
    t = F.unix_timestamp(F.col("ts").cast("timestamp"))
    w = Window.partitionBy(*key).orderBy(t).rangeBetween(-(seconds - 1), 0)
    return failures.withColumn("in_window", F.count(F.lit(1)).over(w)).where(F.col("in_window") >= threshold)


def latest_heartbeats(beats: DataFrame) -> DataFrame:
    """name, last_heartbeat, detail, processed_count of each daemon's newest beat. beats: name, ts, detail, processed."""
    return beats.groupBy("name").agg(F.max("ts").alias("last_heartbeat"), F.max_by("detail", "ts").alias("detail"), F.sum("processed").cast("long").alias("processed_count"))


def daemon_state(last: Column, detail: Column, now: Column, stale: int = STALE_SECONDS) -> Column:
    """stopped if the beat is old or can't be read, else idle or running."""
    age = F.unix_timestamp(now) - F.unix_timestamp(last)
    return F.when(age.isNull() | (age > stale), "stopped").when(F.trim(detail) == "idle", "idle").otherwise("running")


def daemon_states(known: DataFrame, beats: DataFrame, now: Column) -> DataFrame:
    """name, state, detail, processed_count of every known daemon; one without a beat is stopped."""
    j = known.join(latest_heartbeats(beats), "name", "left")
    state = daemon_state(F.col("last_heartbeat"), F.coalesce("detail", F.lit("")), now)
    return j.select("name", state.alias("state"), F.coalesce("detail", F.lit("no heartbeat recorded")).alias("detail"), F.coalesce("processed_count", F.lit(0).cast("long")).alias("processed_count"))


def overall_health(states: DataFrame) -> DataFrame:
    """One row, health: ok if none is stopped, down if all are, else degraded."""
    stopped = F.count_if(F.col("state") == "stopped")
    return states.agg(F.when(stopped == 0, "ok").when(stopped == F.count(F.lit(1)), "down").otherwise("degraded").alias("health"))


def capped_activity(log: DataFrame, most: int = 500) -> DataFrame:
    """The rows whose id is within `most` of the greatest."""
    top = log.agg(F.max("id").alias("_top"))
    return log.join(F.broadcast(top)).where(F.col("id") > F.col("_top") - most).drop("_top")


def user_counts(users: DataFrame) -> DataFrame:
    """One row: users, and admins among the active ones. users: id, role, status."""
    return users.agg(F.count(F.lit(1)).alias("users"), F.count_if((F.col("role") == "admin") & (F.col("status") == "active")).alias("admins"))


def by_username(users: DataFrame, username: str) -> DataFrame:
    """The user of that name, ASCII case aside."""
    return users.where(ascii_lower(F.col("username")) == ascii_lower(F.lit(username)))


def keys_of(keys: DataFrame, owner_id: int | None = None) -> DataFrame:
    """All keys, or those of one owner, by id."""
    return (keys if owner_id is None else keys.where(F.col("owner_id") == owner_id)).orderBy("id")


def key_by_hash(keys: DataFrame, presented: str) -> DataFrame:
    """The key whose stored hash (column hash) is that of the presented one, whatever its state."""
    from docloom.functions.identity import hash_key

    return keys.where(F.col("hash") == hash_key(F.lit(presented)))


def live_keys(keys: DataFrame, users: DataFrame, now: Column) -> DataFrame:
    """Keys that may be used: not revoked, not expired, of an active owner. keys: id, owner_id, revoked, expires_at; users: id, active."""
    from docloom.functions.identity import is_expired

    owners = users.where("active").select(F.col("id").alias("owner_id"))
    return keys.where(~F.col("revoked") & ~is_expired(F.col("expires_at"), now)).join(owners, "owner_id", "left_semi")


def unexpired(sessions: DataFrame, now: str) -> DataFrame:
    """Sessions that stay when expired ones are pruned; dates are compared as strings."""
    return sessions.where(F.col("expires_at") > now)
