"""Link enrichment from a threat list and a table of domain registrations.

Both tables take the place of live lookups and may be large. A link or domain that is
not in them gives no finding.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from baitwatch.functions.findings import FINDINGS, finding
from baitwatch.functions.text import fill
from baitwatch.functions.urls import URL_PATTERN, extract_urls, hostname, root_domain
from baitwatch.plans.lookup import side_lookup
from baitwatch.plans.once import exploded
from baitwatch.registry import (
    DOMAINS_PER_MAIL,
    MESSAGES,
    NEW_DOMAIN_DAYS,
    NEW_DOMAIN_POINTS,
    THREAT_POINTS,
)


def link_check_queue(scans: DataFrame, text: str = "email_text") -> DataFrame:
    """Scans that have a link and were not checked yet."""
    return scans.filter(~F.col("network_checked") & F.col(text).rlike(URL_PATTERN))


def distinct_urls(mail: DataFrame, key: str = "mail_id", text: str = "email_text") -> DataFrame:
    urls = F.array_distinct(extract_urls(F.col(text)))
    return exploded(mail, [key], urls, "url")


def _first_roots(urls: Column, limit: int | None) -> Column:
    roots = F.array_distinct(F.transform(urls, lambda u: root_domain(hostname(u))))
    return roots if limit is None else F.slice(roots, 1, limit)


def capped_domains(
    mail: DataFrame, limit: int | None = DOMAINS_PER_MAIL, key: str = "mail_id", text: str = "email_text"
) -> DataFrame:
    """The first ``limit`` distinct root domains of every mail, or all; ``pos`` from 1."""
    roots = _first_roots(F.array_distinct(extract_urls(F.col(text))), limit)
    rows = exploded(mail, [key], roots, "domain", "pos")
    return rows.withColumn("pos", F.col("pos") + 1)


def first_threats(threat_list: DataFrame) -> DataFrame:
    """One row per listed link: its first threat type in words."""
    listed = threat_list.filter(F.col("url").isNotNull() & (F.col("url") != ""))
    kind = F.replace(
        F.lower(F.coalesce("threat_type", F.lit("threat"))), F.lit("_"), F.lit(" ")
    )
    return listed.groupBy("url").agg(
        F.min_by(kind, "ord").alias("threat"), F.min("ord").alias("ord")
    )


def threat_hits(
    mail: DataFrame, threat_list: DataFrame, key: str = "mail_id", text: str = "email_text"
) -> DataFrame:
    """One row per mail and distinct listed link: ``key, url, threat, ord, message``."""
    hits = side_lookup(distinct_urls(mail, key, text), first_threats(threat_list), ["url"])
    return hits.select(key, "url", "threat", "ord", threat_message().alias("message"))


def age_in_days(created: Column, as_of: Column) -> Column:
    """Whole days from ``created`` to ``as_of``, rounded down; times without a zone."""
    gap = as_of.cast("timestamp_ntz") - created.cast("timestamp_ntz")
    seconds = gap.cast(T.DayTimeIntervalType(T.DayTimeIntervalType.SECOND)).cast("decimal(18,6)")
    return F.floor(seconds / 86400).cast("int")


def registration_dates(domain_reg: DataFrame) -> DataFrame:
    """One creation time per domain; of a list of times the first counts."""
    created = F.col("created_at")
    if isinstance(domain_reg.schema["created_at"].dataType, T.ArrayType):
        created = F.get(created, F.lit(0))
    dated = domain_reg.select("domain", created.alias("created_at"))
    return dated.filter(F.col("created_at").isNotNull()).groupBy("domain").agg(
        F.min("created_at").alias("created_at")
    )


def young_domains(domain_reg: DataFrame, as_of: str) -> DataFrame:
    """Domains registered less than 30 days before ``as_of``, with their age."""
    age = age_in_days(F.col("created_at"), F.lit(as_of))
    aged = registration_dates(domain_reg).select("domain", age.alias("age_days"))
    return aged.filter(F.col("age_days") < NEW_DOMAIN_DAYS)


def threat_message() -> Column:
    return fill(MESSAGES["safe_browsing"], url=F.col("url"), threat=F.col("threat"))


def _new_domain_message() -> Column:
    return fill(
        MESSAGES["new_domain"], domain=F.col("domain"), days=F.col("age_days").cast("string")
    )


def new_domain_hits(
    mail: DataFrame, domain_reg: DataFrame, as_of: str, key: str = "mail_id",
    text: str = "email_text", domains_per_mail: int | None = None,
) -> DataFrame:
    """One row per mail and recently registered domain among its domains."""
    young = young_domains(domain_reg, as_of)
    domains = capped_domains(mail, domains_per_mail, key, text)
    hits = side_lookup(domains, young, ["domain"])
    return hits.select(key, "pos", "domain", "age_days", _new_domain_message().alias("message"))


def check_links(
    mail: DataFrame, threat_list: DataFrame, domain_reg: DataFrame, as_of: str,
    key: str = "mail_id", text: str = "email_text", domains_per_mail: int | None = None,
) -> DataFrame:
    """``key, link_findings, points`` for every mail with a hit.

    Points count per finding, not per category: threats first, in list order, then
    new domains in order of appearance. Links and domains are looked up together, so
    the text is read once and there is one join.
    """
    listed = first_threats(threat_list).select(
        F.lit(0).alias("kind"), F.col("url").alias("value"), F.col("ord").cast("long"),
        F.lit(THREAT_POINTS).alias("points"),
        finding("safe_browsing", "link_manipulation", threat_message()).alias("finding"),
    )
    young = young_domains(domain_reg, as_of).select(
        F.lit(1).alias("kind"), F.col("domain").alias("value"),
        F.lit(None).cast("long").alias("ord"), F.lit(NEW_DOMAIN_POINTS).alias("points"),
        finding("new_domain", "link_manipulation", _new_domain_message()).alias("finding"),
    )
    df = mail.withColumn("_urls", F.array_distinct(extract_urls(F.col(text))))
    asked = F.concat(
        F.transform("_urls", lambda u: F.struct(
            F.lit(0).alias("kind"), u.alias("value"), F.lit(0).alias("pos"))),
        F.transform(_first_roots(F.col("_urls"), domains_per_mail), lambda d, i: F.struct(
            F.lit(1).alias("kind"), d.alias("value"), i.alias("pos"))),
    )
    rows = exploded(df, [key], asked, "q").select(key, "q.*")
    hits = side_lookup(rows, listed.unionByName(young), ["kind", "value"])
    hits = hits.withColumn("ord", F.coalesce("ord", F.col("pos").cast("long")))
    ordered = F.array_sort(F.collect_list(F.struct("kind", "ord", "finding")))
    return hits.groupBy(key).agg(
        ordered["finding"].cast(FINDINGS).alias("link_findings"),
        F.sum("points").cast("int").alias("points"),
    )
