"""Wide tables that gather what is known about every owner, and cards for requested keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rollbook.constants import DORMANT_MAX
from rollbook.functions.keys import SUFFIX_DIGITS, normalize_key, segment_form, status_name


def rank_label(rank: Column, total: Column) -> Column:
    """'#12 of 481', NULL without a rank."""
    text = F.concat(F.lit("#"), rank.cast("string"), F.lit(" of "), total.cast("string"))
    return F.when(rank.isNotNull() & (total > 0), text)


def owner_profile(
    inventory: DataFrame,
    docs: DataFrame,
    hidden: DataFrame,
    ranks: DataFrame,
    trajectory: DataFrame,
    enrichment: DataFrame,
    flows: DataFrame,
    episodes: DataFrame,
    flags: DataFrame,
) -> DataFrame:
    """One row per visible owner that holds keys or has a document.

    All inputs have one row per owner, so the joins never multiply rows.
    """
    spine = inventory.select("owner").unionByName(docs.select("owner")).distinct()
    spine = spine.join(F.broadcast(hidden), "owner", "left_anti")
    about = docs.select(
        "owner", "title", "alias", "website", F.col("address.city").alias("city"), F.col("address.state").alias("state")
    )
    out = (
        spine.join(inventory, "owner", "left")
        .join(about, "owner", "left")
        .join(ranks, "owner", "left")
        .join(trajectory.select("owner", "acquired", "harvested", "opportunism", "delta", "pct"), "owner", "left")
        .join(enrichment, "owner", "left")
        .join(flows, "owner", "left")
        .join(episodes.select("owner", "n_abbreviated", "n_standard", "abbrev_rate"), "owner", "left")
        .join(flags.select("owner", F.col("brand").alias("mailbox"), F.col("confidence").alias("mailbox_confidence")), "owner", "left")
    )
    out = out.na.fill(0, ["inventory", "acquired", "harvested", "delta", "working_count", "match_count"])
    unknown = F.concat(F.lit("Unknown owner ("), F.col("owner"), F.lit(")"))
    names = [f for f in ("inv", "opp", "growth", "match", "age") if f"{f}_rank" in ranks.columns]
    out = out.withColumn("title", F.coalesce("title", unknown))
    out = out.withColumns({f"{n}_label": rank_label(F.col(f"{n}_rank"), F.col(f"{n}_total")) for n in names})
    return out.withColumn("is_small", F.col("inventory") <= DORMANT_MAX).drop(
        *[f"{n}_{part}" for n in names for part in ("rank", "total")]
    )


def key_status_card(requests: DataFrame, current: DataFrame, names: DataFrame, longest: int | None = SUFFIX_DIGITS) -> DataFrame:
    """What the newest snapshot says about each requested key.

    requests is (request_id, text, owner); texts that are no key and keys that are not found
    give no row. The join is by key; a key asked for by many requests is no problem because
    current has it once.
    """
    wanted = requests.select("request_id", normalize_key(F.col("text"), longest).alias("phone"), F.col("owner").alias("asked"))
    found = wanted.where(F.col("phone").isNotNull()).join(current, "phone")
    named = found.join(F.broadcast(names.select("owner", "name")), "owner", "left")
    return named.select(
        "request_id",
        segment_form(F.col("phone").cast("long")).alias("formatted"),
        status_name(F.col("status")).alias("status"),
        "sub_owner",
        "owner",
        (F.col("owner") == F.upper("asked")).alias("owner_match"),
        F.coalesce("name", "owner").alias("owner_name"),
        F.date_format("changed_at", "MMM yyyy").alias("last_change"),
    )
