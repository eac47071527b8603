"""Link checks.

Brand, shortener and domain-ending lists have a few dozen entries and are part of
the program, so they are literals in the row-local expression. No host x brand join
and no shuffle by host, whose frequencies are very uneven in real mail.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from baitwatch.functions import urls as U
from baitwatch.functions.findings import finding, no_findings
from baitwatch.functions.text import fill, sql_array
from baitwatch.operators.text_rules import FOLDED, with_folded
from baitwatch.plans.once import exploded, once
from baitwatch.registry import BRAND_DOMAINS, MESSAGES, SHORTENERS, SUSPICIOUS_TLDS

# Parts a rule key from its message while both travel as one string, so repeats
# can be dropped by hash instead of comparing every pair of records.
_SEP = "\x01"


def url_facts(mail: DataFrame, text: str = "email_text") -> DataFrame:
    """One row per link, repeats kept: ``mail_id, pos, url, host, root, tld, has_userinfo``."""
    return with_url_parts(exploded(mail, ["mail_id"], U.extract_urls(F.col(text)), "url", "pos"))


def with_url_parts(rows: DataFrame, url: str = "url") -> DataFrame:
    rows = once(rows, host=U.hostname(F.col(url)))
    rows = rows.withColumn("root", U.root_domain(F.col("host")))
    return rows.withColumns({
        "tld": U.top_level(F.col("root")), "has_userinfo": U.has_userinfo(F.col(url)),
    })


def with_links(mail: DataFrame, text: str = "email_text") -> DataFrame:
    """Adds ``_urls`` (all, in order) and ``_links`` (distinct, with their parts)."""
    df = with_folded(mail, text)
    df = df.withColumn("_urls", U.extract_urls(F.col(text), F.col(FOLDED)))
    hosts = F.transform(
        F.array_distinct("_urls"),
        lambda u: F.struct(u.alias("url"), U.hostname(u).alias("host")),
    )
    roots = F.transform(hosts, lambda x: F.struct(
        x["url"].alias("url"), x["host"].alias("host"), U.root_domain(x["host"]).alias("root"),
    ))
    return df.withColumn("_links", F.transform(roots, lambda x: F.struct(
        x["url"].alias("url"),
        x["host"].alias("host"),
        x["root"].alias("root"),
        U.top_level(x["root"]).alias("tld"),
        F.substring_index(x["root"], ".", 1).alias("name"),
        U.plain_letters(F.substring_index(x["root"], ".", 1)).alias("plain"),
    )))


def _brands() -> Column:
    records = ", ".join(
        f"named_struct('brand', '{b}', 'title', '{b.title()}', 'official', {sql_array(domains)})"
        for b, domains in BRAND_DOMAINS.items()
    )
    return F.expr(f"array({records})")


def _alike(b: Column, host: Column, root: Column, plain: Column) -> Column:
    near = (F.length(b["brand"]) >= 5) & (F.levenshtein(plain, b["brand"], 1) == 1)
    close = host.contains(b["brand"]) | (plain == b["brand"]) | near
    return close & ~F.array_contains(b["official"], root)


def _brand_spoofs(host: Column, root: Column, plain: Column) -> Column:
    """Messages about brands a host resembles, in registry order."""

    def message(b: Column) -> Column:
        return (
            F.when(host.contains(b["brand"]),
                   fill(MESSAGES["brand_in_host"], host=host, brand=b["title"]))
            .when(plain == b["brand"],
                  fill(MESSAGES["misspelled"], root=root, brand=b["title"]))
            .otherwise(fill(MESSAGES["typo_squat"], root=root, brand=b["title"]))
        )

    alike = F.filter(_brands(), lambda b: _alike(b, host, root, plain))
    return F.transform(alike, message)


def spoof_messages(link: Column) -> Column:
    """Ways the host of a link is dressed up as a brand it is not."""
    host, root = link["host"], link["root"]
    script = F.filter(F.array(
        F.when(U.is_punycode(host), fill(MESSAGES["punycode"], host=host)),
        F.when(U.has_confusable(link["name"]), fill(MESSAGES["homograph"], root=root)),
    ), lambda m: m.isNotNull())
    return F.concat(script, _brand_spoofs(host, root, link["plain"]))


def _tagged(rule: str, message: Column) -> Column:
    return F.concat(F.lit(rule + _SEP), message)


def _link_messages(link: Column) -> Column:
    own = F.filter(F.array(
        F.when(link["root"].isin(*SHORTENERS), _tagged("shortener", fill(
            MESSAGES["shortener"], url=link["url"], root=link["root"]))),
        F.when(U.has_userinfo(link["url"]), _tagged("userinfo_trick", fill(
            MESSAGES["userinfo_trick"], url=link["url"]))),
        F.when(link["tld"].isin(*SUSPICIOUS_TLDS), _tagged("suspicious_tld", fill(
            MESSAGES["suspicious_tld"], url=link["url"], tld=link["tld"]))),
    ), lambda m: m.isNotNull())
    spoofs = F.transform(spoof_messages(link), lambda m: _tagged("domain_spoofing", m))
    return F.concat(own, spoofs)


def suspicious_links(links: Column) -> Column:
    """Findings about single links, each message once per mail."""
    tagged = F.array_distinct(F.flatten(F.transform(links, _link_messages)))
    return F.transform(tagged, lambda t: finding(
        F.substring_index(t, _SEP, 1), "link_manipulation", F.substring_index(t, _SEP, -1),
    ))


def link_findings(text: Column, folded: Column, urls: Column, links: Column) -> Column:
    """All link findings of a mail in reporting order."""
    any_link = F.size(urls) > 0

    def one(rule: str, category: str, cond: Column, message: Column) -> Column:
        return F.when(cond, F.array(finding(rule, category, message))).otherwise(no_findings())

    has_scheme = folded.contains("http")
    return F.concat(
        one("has_links", "informational", any_link, fill(
            MESSAGES["has_links"], count=F.size(urls).cast("string"))),
        one("ip_url", "link_manipulation", has_scheme & text.rlike(U.IP_URL_PATTERN),
            F.lit(MESSAGES["ip_url"])),
        F.when(any_link, suspicious_links(links)).otherwise(no_findings()),
        one("credential_path", "informational",
            any_link & has_scheme & text.rlike(U.CREDENTIAL_PATH_PATTERN),
            F.lit(MESSAGES["credential_path"])),
        one("insecure_http", "informational",
            folded.contains("http://"), F.lit(MESSAGES["insecure_http"])),
    )


def deceptive_link(text: Column, folded: Column, links: Column) -> Column:
    """Whether any scoring link finding exists, without writing its message."""

    def bad(link: Column) -> Column:
        return (
            link["root"].isin(*SHORTENERS)
            | link["tld"].isin(*SUSPICIOUS_TLDS)
            | U.has_userinfo(link["url"])
            | U.is_punycode(link["host"])
            | U.has_confusable(link["name"])
            | F.exists(_brands(), lambda b: _alike(b, link["host"], link["root"], link["plain"]))
        )

    raw_ip = folded.contains("http") & text.rlike(U.IP_URL_PATTERN)
    return raw_ip | F.exists(links, bad)


def mentioned_brand(lower: str) -> Column:
    """First brand named in a lower-case text column, NULL when there is none."""
    named = " ".join(f"WHEN contains({lower}, '{b}') THEN '{b}'" for b in BRAND_DOMAINS)
    return F.expr(f"CASE {named} END")


def _official(brand: Column) -> Column:
    pairs = ", ".join(f"'{b}', {sql_array(domains)}" for b, domains in BRAND_DOMAINS.items())
    return F.element_at(F.expr(f"map({pairs})"), brand)


def brand_mismatch(brand: Column, links: Column) -> Column:
    """Finding for mail that names a brand while no link leads to it, else NULL."""
    roots = F.array_distinct(links["root"])
    shown = F.array_join(F.slice(F.array_sort(roots), 1, 3), ", ")
    return F.when(
        brand.isNotNull() & ~F.arrays_overlap(roots, _official(brand)),
        finding("brand_link_mismatch", "link_manipulation", fill(
            MESSAGES["brand_link_mismatch"], brand=F.initcap(brand), roots=shown)),
    )


# --- long tables ----------------------------------------------------------------------


def tag_links(mail: DataFrame, text: str = "email_text") -> DataFrame:
    """Long table of link findings."""
    df = with_links(mail.select("mail_id", text), text)
    found = link_findings(F.col(text), F.col(FOLDED), F.col("_urls"), F.col("_links"))
    rows = exploded(df, ["mail_id"], found, "f", "pos")
    return rows.select(
        "mail_id", (F.col("pos") + 1).alias("ord"), "f.rule", "f.category", "f.message"
    )


def tag_domain_spoofing(mail: DataFrame, text: str = "email_text") -> DataFrame:
    """Long table of spoofing messages, one row per mail and message."""
    df = with_links(mail.select("mail_id", text), text)
    messages = F.array_distinct(F.flatten(F.transform("_links", spoof_messages)))
    return exploded(df, ["mail_id"], messages, "message")


def links_to(mail: DataFrame, column: str, values, text: str = "email_text") -> DataFrame:
    """Links whose ``root`` or ``tld`` is in a short fixed list."""
    rows = url_facts(mail, text)
    return rows.filter(F.col(column).isin(*values)).select("mail_id", "pos", "url", "root", "tld")


def shortened_links(mail: DataFrame, text: str = "email_text") -> DataFrame:
    return links_to(mail, "root", SHORTENERS, text)


def suspicious_tld_links(mail: DataFrame, text: str = "email_text") -> DataFrame:
    return links_to(mail, "tld", SUSPICIOUS_TLDS, text)
