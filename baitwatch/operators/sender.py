"""Sender checks over the header block at the top of a mail."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from baitwatch.functions.findings import finding, no_findings, present
from baitwatch.functions.mail_headers import (
    address,
    address_domain,
    display_name,
    find_address,
    header_block,
    header_value,
)
from baitwatch.functions.text import any_word, fill, sql_text
from baitwatch.functions.urls import root_domain
from baitwatch.plans.once import exploded
from baitwatch.registry import (
    BRAND_DOMAINS,
    HEADER_NAMES,
    MESSAGES,
    ORGANISATION_WORDS,
    WEBMAIL_DOMAINS,
)


def extract_headers(mail: DataFrame, text: str = "email_text") -> DataFrame:
    """``headers(mail_id, name, value)``, the first line of each name."""
    blocks = mail.select("mail_id", header_block(F.col(text)).alias("block"))
    pairs = F.array(*[
        F.struct(F.lit(n).alias("name"), header_value(F.col("block"), n).alias("value"))
        for n in HEADER_NAMES
    ])
    found = F.filter(pairs, lambda h: h["value"].isNotNull())
    return exploded(blocks, ["mail_id"], found, "h").select("mail_id", "h.name", "h.value")


def with_sender(mail: DataFrame, text: str = "email_text") -> DataFrame:
    """Adds ``_sender``: names, addresses and root domains, NULL without a From line."""
    df = mail.withColumn("_block", header_block(F.col(text)))

    def value(name: str) -> Column:
        return F.when(F.col("_block") != "", header_value(F.col("_block"), name))

    df = df.withColumns({
        "_from": value("from"), "_reply": value("reply-to"), "_return": value("return-path"),
    })
    df = df.withColumn("_parts", F.when(
        F.col("_from").isNotNull(),
        F.struct(
            display_name(F.col("_from")).alias("display"),
            address(F.col("_from")).alias("address"),
            F.coalesce(address(F.col("_reply")), F.lit("")).alias("reply_address"),
            F.coalesce(address(F.col("_return")), F.lit("")).alias("return_address"),
        ),
    ))
    p = F.col("_parts")
    df = df.withColumn("_sender", F.when(
        p.isNotNull(),
        F.struct(
            p["display"].alias("display"),
            find_address(p["display"]).alias("shown"),
            p["address"].alias("address"),
            address_domain(p["address"]).alias("domain"),
            root_domain(address_domain(p["address"])).alias("root"),
            p["reply_address"].alias("reply_address"),
            root_domain(address_domain(p["reply_address"])).alias("reply_root"),
            p["return_address"].alias("return_address"),
            root_domain(address_domain(p["return_address"])).alias("return_root"),
        ),
    ))
    return df.drop("_block", "_from", "_reply", "_return", "_parts")


def _false_brand(sender: str) -> Column:
    """First brand the display name claims without sending from its domains."""
    squeezed = f"replace(lower({sender}.display), ' ', '')"
    claimed = [
        f"WHEN contains({squeezed}, '{brand}') AND {sender}.root NOT IN "
        f"({', '.join(sql_text(d) for d in domains)}) THEN '{brand.title()}'"
        for brand, domains in BRAND_DOMAINS.items()
    ]
    return F.expr(f"CASE {' '.join(claimed)} END")


def sender_findings(sender: str) -> Column:
    """Findings about a column like ``_sender``, in reporting order."""
    s = F.col(sender)
    shown_root = root_domain(address_domain(s["shown"]))
    sent = s["root"] != ""

    def other(rule: str, header: str, addr: Column, root: Column) -> Column:
        return F.when(
            sent & (root != "") & (root != s["root"]),
            finding(rule, "sender", fill(
                MESSAGES["other_address"], header=F.lit(header), other=addr, address=s["address"]
            )),
        )

    brand = _false_brand(sender)
    found = present(
        F.when(
            sent & (s["shown"] != "") & (shown_root != "") & (shown_root != s["root"]),
            finding("display_name_address_mismatch", "sender", fill(
                MESSAGES["display_name_address_mismatch"], shown=s["shown"], address=s["address"]
            )),
        ),
        F.when(
            sent & brand.isNotNull(),
            finding("display_name_brand_mismatch", "sender", fill(
                MESSAGES["display_name_brand_mismatch"], brand=brand, root=s["root"]
            )),
        ),
        other("reply_to_mismatch", "Reply-To", s["reply_address"], s["reply_root"]),
        other("return_path_mismatch", "Return-Path", s["return_address"], s["return_root"]),
        F.when(
            s["domain"].isin(*WEBMAIL_DOMAINS)
            & F.expr(any_word(f"lower({sender}.display)", ORGANISATION_WORDS)),
            finding("organisation_from_free_mail", "sender", fill(
                MESSAGES["organisation_from_free_mail"], display=s["display"],
                address=s["address"],
            )),
        ),
    )
    return F.when(s.isNotNull(), found).otherwise(no_findings())


def sender_addresses(mail: DataFrame, text: str = "email_text") -> DataFrame:
    """Display name and addresses of every mail with a From line."""
    df = with_sender(mail.select("mail_id", text), text)
    return exploded(df, ["mail_id"], F.array("_sender"), "s").select(
        "mail_id", "s.display", "s.address", "s.root", "s.reply_address", "s.return_address"
    )


def tag_sender(mail: DataFrame, text: str = "email_text") -> DataFrame:
    """Long table of sender findings."""
    df = with_sender(mail.select("mail_id", text), text)
    rows = exploded(df, ["mail_id"], sender_findings("_sender"), "f")
    return rows.select("mail_id", "f.rule", "f.message")
