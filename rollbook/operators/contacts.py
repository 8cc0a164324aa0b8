"""Contact lists, shared contacts and addresses, mailbox flags and web domains."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rollbook.functions.text import address_key, brand_of, contact_struct, domain_of, split_address
from rollbook.operators.directory import base_id, owner_of

CONTACT_SCHEMA = (
    "`ID` string, `Company Name` string, `Company Address` string, `Primary Contact` string, "
    "`Change Contact` string, `Notes` string"
)


def read_contacts_csv(spark: SparkSession, *paths: str) -> DataFrame:
    """Quoted CSV files with line breaks inside quotes, in the order of their names.

    The declared schema makes the marked first header word harmless. A record that does not fit
    it keeps its text in `corrupt`. `row_no` counts up through the files and the records of each:
    a record may span lines, so a file is read by one task from its start.
    """
    schema = f"{CONTACT_SCHEMA}, corrupt string"
    read = spark.read.schema(schema).options(header=True, enforceSchema=True, escape='"', multiLine=True, mode="PERMISSIVE", columnNameOfCorruptRecord="corrupt")
    rows = read.csv(list(paths)).select("*", F.col("_metadata.file_path").alias("path"), F.monotonically_increasing_id().alias("at"))
    # a number per file; a file has far fewer records than 2^40
    files = rows.select("path").distinct().select("path", F.row_number().over(Window.orderBy("path")).alias("file_no"))
    first = rows.groupBy("path").agg(F.min("at").alias("first"))
    placed = rows.join(F.broadcast(files.join(first, "path")), "path")
    return placed.withColumn("row_no", F.shiftleft(F.col("file_no").cast("long"), 40) + F.col("at") - F.col("first")).drop("at", "first", "file_no")


def parse_contact_lines(lines: DataFrame) -> DataFrame:
    """CSV texts in column value, other columns kept."""
    others = [c for c in lines.columns if c != "value"]
    return lines.select(*others, F.from_csv("value", CONTACT_SCHEMA, {"escape": '"'}).alias("r")).select(*others, "r.*")


def admin_codes(rows: DataFrame, order: str) -> DataFrame:
    """One row per three-character code: the smallest full code, of equal ones the last row."""
    full = F.upper(F.trim(F.coalesce("ID", F.lit(""))))
    usable = rows.withColumn("full_code", full).where(F.length("full_code") >= 3)
    cells = {
        "company_name": "Company Name",
        "address_raw": "Company Address",
        "primary_raw": "Primary Contact",
        "change_raw": "Change Contact",
        "notes": "Notes",
    }
    packed = F.struct(
        F.col("full_code").alias("code"),
        *[F.trim(F.coalesce(F.col(f"`{c}`"), F.lit(""))).alias(n) for n, c in cells.items()],
    )
    first = usable.groupBy(F.substring("full_code", 1, 3).alias("admin_code")).agg(
        F.min_by(packed, F.struct(F.col("full_code"), -F.col(order))).alias("r")
    )
    return first.select("admin_code", F.substring("admin_code", 1, 2).alias("owner"), "r.*")


def contact_table(codes: DataFrame) -> DataFrame:
    """Address and both contacts of every code taken apart."""
    parsed = split_address(codes, "address_raw").withColumnRenamed("phone", "company_phone")
    parsed = parsed.withColumn("p", contact_struct(F.col("primary_raw"))).withColumn("c", contact_struct(F.col("change_raw")))
    fields = ("name", "email", "phone", "fax")
    return parsed.select(
        "owner",
        "admin_code",
        "code",
        "company_name",
        "street",
        "city",
        "state",
        "country",
        "zip",
        "company_phone",
        *[F.col(f"p.{f}").alias(f"primary_{f}") for f in fields],
        *[F.col(f"c.{f}").alias(f"change_{f}") for f in fields],
        "notes",
    )


def contact_clusters(contacts: DataFrame) -> DataFrame:
    """E-mails and phones shared by two or more codes.

    The collected codes have three characters, so a list is bounded however many rows
    share one contact.
    """
    email = F.trim(F.lower(F.coalesce("primary_email", F.lit(""))))
    digits = F.regexp_replace(F.coalesce("primary_phone", F.lit("")), r"[^0-9]", "")
    keys = F.array_compact(
        F.array(
            F.when(email != "", F.struct(F.lit("email").alias("key_type"), email.alias("key"))),
            F.when(
                F.length(digits) >= 10, F.struct(F.lit("phone").alias("key_type"), F.substring(digits, -10, 10).alias("key"))
            ),
        )
    )
    flat = contacts.select("admin_code", F.inline(keys))
    groups = flat.groupBy("key_type", "key").agg(F.sort_array(F.collect_set("admin_code")).alias("admin_codes"))
    owners = F.array_sort(F.array_distinct(F.transform("admin_codes", lambda c: F.substring(c, 1, 2))))
    return groups.where(F.size("admin_codes") >= 2).select(
        "key_type",
        "key",
        F.size("admin_codes").alias("n_codes"),
        "admin_codes",
        F.size(owners).alias("n_owners"),
        owners.alias("owners"),
    )


def shared_address(docs: DataFrame) -> DataFrame:
    """Documents whose address is used by another owner, with the other owners.

    Owner codes have two characters, so the collected set stays small even for an address
    that a third of all documents share.
    """
    rows = docs.select(
        "doc_no", owner_of(F.col("code")).alias("owner"), address_key(F.col("address")).alias("address_key")
    ).where(F.col("owner").isNotNull() & F.col("address_key").isNotNull())
    shared = (
        rows.groupBy("address_key").agg(F.collect_set("owner").alias("owners")).where(F.size("owners") > 1)
    )
    joined = rows.join(shared, "address_key")
    peers = F.array_sort(F.array_remove("owners", F.col("owner")))
    total = F.size("owners")
    return joined.select(
        "doc_no",
        "owner",
        "address_key",
        total.alias("n_owners"),
        F.when(total >= 3, "high").otherwise("medium").alias("confidence"),
        peers.alias("peers"),
    )


def mailbox_flags(docs: DataFrame) -> DataFrame:
    """Every document that a brand or a shared address marks as a mailbox."""
    coded = docs.withColumn("owner", owner_of(F.col("code"))).where(F.col("owner").isNotNull())
    branded = coded.select(
        "doc_no", "owner", "_id", F.col("address.street1").alias("street1"), brand_of(F.col("address.street1")).alias("b")
    )
    shared = shared_address(docs).select("doc_no", "n_owners", "confidence", "peers")
    rows = branded.join(shared, "doc_no", "left")
    others = F.concat(F.lit("also: "), F.array_join(F.slice("peers", 1, 5), ", "))
    label = F.concat(F.lit("Shared address ("), F.col("n_owners").cast("string"), F.lit(" owners)"))
    by_brand = F.col("b").isNotNull()
    return rows.where(by_brand | F.col("n_owners").isNotNull()).select(
        "owner",
        "doc_no",
        base_id(F.col("_id")).alias("doc_id"),
        F.when(by_brand, F.col("b.brand")).otherwise(label).alias("brand"),
        F.when(by_brand, F.col("b.confidence")).otherwise(F.col("confidence")).alias("confidence"),
        F.when(by_brand, F.col("b.raw_hit")).otherwise(others).alias("raw_hit"),
        F.coalesce("street1", F.lit("")).alias("street1"),
    )


def flag_dedupe(flags: DataFrame) -> DataFrame:
    """One flag per owner, high before medium, then document order."""
    w = Window.partitionBy("owner").orderBy((F.col("confidence") != "high").cast("int"), "doc_no")
    return flags.withColumn("n", F.row_number().over(w)).where(F.col("n") == 1).drop("n")


def owner_domains(docs: DataFrame, skip: Sequence[str]) -> DataFrame:
    """(owner, doc_id, domain) from the website, else from the alias."""
    domain = F.coalesce(domain_of(F.col("website")), domain_of(F.col("alias")))
    rows = docs.select(owner_of(F.col("code")).alias("owner"), base_id(F.col("_id")).alias("doc_id"), domain.alias("domain"))
    return rows.where(F.col("owner").isNotNull() & F.col("domain").isNotNull() & ~F.col("domain").isin(*skip))


def domain_age(domains: DataFrame, lookups: DataFrame, as_of) -> DataFrame:
    """Age in years of each domain that has been looked up."""
    days = F.datediff(as_of, F.col("created"))
    return domains.join(lookups, "domain").select(
        "owner", "doc_id", "domain", "created", (days / 365.25).alias("age_years"), "looked_up_at"
    )


def stale_lookups(domains: DataFrame, lookups: DataFrame, now, ttl_days: int) -> DataFrame:
    """Domains never looked up or looked up too long ago."""
    unique = domains.select("domain").distinct()
    seconds = F.unix_timestamp(now) - F.unix_timestamp(F.col("looked_up_at").cast("timestamp"))
    fresh = F.floor(seconds / 86400) < ttl_days
    joined = unique.join(lookups.select("domain", "looked_up_at"), "domain", "left")
    return joined.where(~F.coalesce(fresh, F.lit(False))).select("domain")
