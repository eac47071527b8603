"""Mail and side tables derived from the test tables.

The given ``documents`` are prose without any mail in it, so every document is
wrapped, whole, in one of the templates below: a header block or greeting in front,
links or closing lines behind. Half of them are near misses that must stay silent.
All tables here grow with the given ones. ``baitwatch.oracle`` builds the same
tables in SQL.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from baitwatch.functions.text import sql_array
from baitwatch.functions.urls import plain_letters
from baitwatch.operators.detect import analyse_mail
from baitwatch.operators.link_index import add_links
from baitwatch.operators.search_index import BUCKETS as INDEX_BUCKETS
from baitwatch.operators.search_index import add_to_index
from baitwatch.operators.validate import valid_mail
from baitwatch.plans import snapshots
from baitwatch.plans.scan_store import BUCKETS, store_scans
from baitwatch.plans.session import work_folder
from baitwatch.plans.spread import spread
from baitwatch.registry import BRAND_DOMAINS, CORPORA

AS_OF = "2024-02-01 00:00:00"


@dataclass(frozen=True)
class Template:
    """``{page}`` stands for a page URL, ``{id}`` for the document number."""

    bad: int
    head: str
    tail: str


TEMPLATES = (
    Template(1, "From: Amazon Returns <refunds@amazon-refund-desk.tk>\nReply-To: desk7@post.example\n"
                "Subject: One refund is waiting\n\nDear Customer,\nConfirm your password before "
                "noon, or your account will be suspended.\n",
             "\nhttp://amazon-refund-desk.tk/signin/confirm?r={id}\nFailure to answer leads to "
             "termination of your account."),
    Template(0, "Morning all, here is what we discussed on the bus.\n", "\nMap of the stops: {page}"),
    Template(1, "Subject: A matter for you alone\n\nDear Friend,\nMy name is Barrister Tamsin Vole. "
                "A late client of mine left the sum of USD 7,350,000.00 in a dormant account.\n",
             "\nKeep 25% of the total sum as the next of kin. Reply to me at vole.chambers@yahoo.com "
             "and keep it strictly confidential."),
    Template(0, "From: Water Works <meter@waterworks.example>\nSubject: Your reading\n\nHello,\n",
             "\nThe readings of the year are at https://waterworks.example/readings."),
    Template(1, "Subject: Storage\n\nDear Email User,\nYour mailbox is almost full and has exceeded "
                "the storage limit.\n",
             "\nEnter your username and password to upgrade your mailbox: "
             "http://webmail-upgrade{id}.xyz/owa\nThe system administrator"),
    Template(0, "The library shuts early on Thursday; books can wait.\n",
             "\nSee www.example.org/news, or example.com."),
    Template(1, "You have won! Lucky winner of the national lottery draw, batch number {id}.\n",
             "\nClaim your prize at http://192.168.1.1/claim or open prize-form.exe"),
    Template(0, "The plant sale is limited to one table this year!\n", "\nStall plan: {page}"),
    Template(1, "Renew your BVN this evening to avoid restriction of the card.\n",
             "\nhttp://bit.ly/x{id} http://bit.ly/x{id} https://t.co/y{id}"),
    Template(0, "From: Odile Brandt <odile@post.harbour.example>\nReply-To: crew@harbour.example\n\n"
                "Dear crew,\n", "\nUntil Monday, Odile"),
    Template(1, "From: desk@savings.example <box{id}@rented.example>\nReturn-Path: "
                "<lists@third.example>\n\nUnusual activity was seen on your account.\n",
             "\nConfirm your password: http://www.ebay.com@198.51.100.9/login"),
    Template(0, "Meeting moved to room 4.\n", "\n"),
    Template(1, "From: Tenant Support Team <rooms{id}@gmail.com>\n\nDear valued customer,\n",
             "\nReply with your details. Contact me on +1 555 or write to us at x@hotmail.com."),
    Template(0, "From: Marisol <marisol.k@gmail.com>\nTo: hut@alps.example\nTo: hut2@alps.example\n\nHello!\n",
             "\nPhotos: https://photos.example.net/album/{id}"),
    Template(1, "Security alert: please validate your account by clicking the link below.\n",
             "\nhttps://g00gle.com/{id} and http://paypa1.com/login and http://amazom.com/"),
    Template(0, "The chess club watched a film on Netflix last night.\n",
             "\nRead more at https://news.example.org/story/{id}"),
    Template(1, "Dear Customer, validate your account with Netflix on this page.\n",
             "\nhttp://billing-update.example.org/login {page} http://w{id}.top/a"),
    Template(0, "Please verify your account to continue.\n",
             "\nhttps://www.netflix.com/account?n={id}"),
    Template(1, "Attention: email user\nYour email will be closed if you do not update it. "
                "Otherwise your account is lost.\n",
             "\nhttp://xn--pple-43d.com/{id} and http://pаypal.com/login"),
    Template(0, "Your order has been delivered. Thank you for shopping.\n",
             "\nTrack it in the app. Purchase no. {id}"),
    Template(1, "My name is Dr Ann. I am the only daughter of the late Mr Ben, who passed away.\n",
             "\nKeep this secret. Transfer of the funds: $4,200,000 ; 2.5 million dollars, "
             "twenty percent of the fund."),
    Template(0, "Weekend only: extra 20% off sitewide. Use code WEEKEND20.\n", "\n{page}"),
    Template(1, "\n\n  From: \"IT Department\" <it@outlook.com>\r\nSubject: Quota\r\n\r\nYou have "
                "exceeded the storage limit.\n",
             "\nUpgrade your mailbox in the next 48 hours: https://owa{id}.click/login."),
    Template(0, "Subject: Lunch\nFrom Bob it is.\n\nAre we on for Friday?\n",
             "\nFrom: Bob <bob@elsewhere.example>"),
    Template(1, "The federal ministry and the World Bank hold an unclaimed deposit.\n",
             "\nI await your urgent reply. Treat this as very urgent. {page}"),
    Template(0, "Minutes of the security team are in the folder.\n",
             "\nhttps://intranet.example.com/minutes/{id}.zip"),
    Template(1, "DEAR SIR OR MADAM, YOUR ACCOUNT HAS BEEN SUSPENDED.\n",
             "\nHTTP://UPPER{id}.example.com/LOGIN VERIFY YOUR IDENTITY"),
    Template(0, "Invoice attached: report-{id}.pdf and notes.txt.\n", "\nexample.com"),
    Template(1, "Invoice attached: invoice-{id}.DOCM, open it to enter your PIN.\n",
             "\n(see http://paypal.com, or http://example.com.)"),
    Template(0, "Re: draw for the raffle\nNobody has won yet.\n", "\n{page}\n{page}"),
    Template(1, "We detected some suspicious sign-in; our system has noticed unauthorised use.\n",
             "\nhttp://login-ebay.com/{id} http://drop-box.work/ http://dropbax.com/ "
             "http://a{id}.party/ http://b{id}.loan/"),
    Template(0, "Reply to this email with the agenda.\n", "\nhttps://maps.google.com/?q={id}"),
    Template(1, "From: Wells Fargo Bank <alerts@wells{id}.example>\n\nYour access is restricted. "
                "Send us your login.\n",
             "\nhttps://wellsfarg0.com/?x=https://wellsfargo.com/"),
    Template(0, "From: eBay <post@ebay.com>\n\nThe seller has packed the lamp.\n",
             "\nhttps://www.ebay.com/order/{id}"),
    Template(1, "Password expires today. Click here now.\n",
             "\nhttps://[bad/{id} http://a[b].com/x www.office-login.top/{id}"),
    Template(0, "A package from DHL is on its way.\n", "\nhttps://www.dhl.com/track/{id}"),
    Template(1, "I am writing as widow of the late Chief; I am terminally ill.\n",
             "\nAssist me, strictly confidential. The inheritance is with a security company."),
    Template(0, "Doors close within the building at ten.\n", "\n{page} {page}?again"),
    Template(1, "From: \"Apple <apple@id.example>\" <no-reply@x{id}.ga>\nReply-To: apple.com\n\n"
                "Dear user, your iCloud is locked.\n",
             "\nRestore your account: https://appleid.x{id}.ga/verify/session"),
    Template(0, "Subject:\nNo header value here.\n", "\nuser_name@example.org wrote {page}"),
    Template(1, "Legal action: you have been selected.\nSocial security number needed, provide "
                "your social security number.\n",
             "\nhttp://1.2.3.4:8080/auth http://u:p@host{id}.cf/"),
    Template(0, "The bank of the river; a friend of mine.\n", "\nftp://files.example.com/{id}"),
    Template(1, "Ticket number 77 has won. Winning notification.\n",
             "\nWrite back to me via claims.desk@rediffmail.com {page}"),
    Template(0, "Please find attached the monthly report.\n", "\nhttps://linkedin.com/in/p{id}"),
    Template(1, "From: LinkedIn Team <team@linkedin.com.example>\nReturn-Path: <a@b.example>\n\n"
                "Confirm account activity.\n",
             "\nhttps://lnkd.in/{id} https://linkedln.com/{id}"),
    Template(0, "Cancer of the word; the sum total is fine.\n", "\n<a href=\"{page}\">here</a>"),
    Template(1, "Utmost confidentiality. Foreign partner needed. 15 % of the money.\n",
             "\nE-mail us at pay{id}@gmx.net or fax. wire transfer of funds"),
    Template(0, "Hello, the draft is 90% done.\n", "\nDraft: draft-{id}.docx ({page})"),
)
N_TEMPLATES = len(TEMPLATES)

POSITIVE_ALIASES = ("phishing", " Phish ", "MALICIOUS", "spam", "1", "True")
NEGATIVE_ALIASES = ("legitimate", "Legit", " safe", "HAM ", "0", "FALSE")

NOTES = ("", "checked", "Reported to the help desk and kept for the weekly review of open cases, "
             "see 100%_list", None, "ok")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _pick(values, index: Column) -> Column:
    if isinstance(values[0], int):
        items = F.expr(f"array({', '.join(map(str, values))})")
    else:
        items = F.expr(sql_array(values))
    return F.element_at(items, index.cast("int") + 1)


def mail_from(documents: DataFrame, labels: DataFrame, pages: DataFrame) -> DataFrame:
    """``mail(mail_id, source, raw_label, bad, email_text)`` for a document table or stream."""
    n_pages = pages.select(F.count("*")).scalar()
    kind = F.pmod("doc_id", F.lit(N_TEMPLATES))
    docs = documents.select("doc_id", "source", "text")

    def with_sides(rows: DataFrame) -> DataFrame:
        rows = rows.withColumn("page_id", F.pmod(F.col("doc_id"), n_pages))
        rows = rows.join(pages.select("page_id", "url"), "page_id", "left")
        return rows.join(labels.select("doc_id", "toxic"), "doc_id", "left")

    if documents.isStreaming:
        docs = with_sides(docs)
    else:
        # Side tables are found for the ids alone, so that texts stay where they were spread.
        docs = docs.join(with_sides(documents.select("doc_id").distinct()), "doc_id", "left")

    def placed(part: str) -> Column:
        text = F.replace(
            _pick([getattr(t, part) for t in TEMPLATES], kind),
            F.lit("{page}"), F.coalesce("url", F.lit("")),
        )
        return F.replace(text, F.lit("{id}"), F.col("doc_id").cast("string"))

    bad = F.when(F.col("toxic") == 1, 1).otherwise(_pick([t.bad for t in TEMPLATES], kind))
    alias = F.pmod("doc_id", F.lit(6))
    docs = docs.withColumn("bad", bad)
    return docs.select(
        F.col("doc_id").alias("mail_id"),
        "source",
        F.when(F.col("bad") == 1, _pick(POSITIVE_ALIASES, alias))
        .otherwise(_pick(NEGATIVE_ALIASES, alias)).alias("raw_label"),
        "bad",
        F.concat(placed("head"), F.col("text"), placed("tail")).alias("email_text"),
    )


def mail(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents, labels, pages = (table(spark, sf_dir, t) for t in ("documents", "labels", "pages"))
    return mail_from(spread(documents, "doc_id"), labels, pages)


def raw_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``raw_corpus(row_id, source, label, subject, body)``: five corpora with gaps."""
    m, i = mail(spark, sf_dir), F.col("mail_id")
    number = F.substr("source", F.lit(4)).cast("int")
    subject = (
        F.when(i % 7 == 2, F.lit(None)).when(i % 7 == 4, F.lit(" \t "))
        .otherwise(F.concat(F.lit("  Notice "), i.cast("string"), F.lit(" \n")))
    )
    body = (
        F.when(i % 11 == 3, F.lit(None)).when(i % 11 == 5, F.lit("\n  "))
        .otherwise(F.concat(F.lit(" \r\n"), F.col("email_text"), F.lit("\t ")))
    )
    label = (
        F.when(i % 9 == 4, F.lit("2")).when(i % 9 == 7, F.lit(None))
        .otherwise(F.col("bad").cast("string"))
    )
    return m.select(
        i.alias("row_id"), _pick(CORPORA, F.pmod(number, F.lit(5))).alias("source"),
        label.alias("label"), subject.alias("subject"), body.alias("body"),
    )


def threat_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``threat_list(url, threat_type, ord)``: two entries a page, a third of them in use."""
    kinds = ("MALWARE", "SOCIAL_ENGINEERING", None, "UNWANTED_SOFTWARE")
    p = F.col("page_id")
    url = F.when(p % 3 == 0, F.col("url")).when(p % 3 == 1, F.concat("url", F.lit("#gone")))
    first = F.struct(url.alias("url"), _pick(kinds, p % 4).alias("threat_type"),
                     (p * 2 + 1).alias("ord"))
    second = F.struct(url.alias("url"), _pick(kinds, (p + 1) % 4).alias("threat_type"),
                      (p * 2).alias("ord"))
    pages = table(spark, sf_dir, "pages")
    return pages.select(F.explode(F.array(first, second)).alias("t")).select("t.*")


def domain_reg(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``domain_reg(domain, created_at)`` with ages around 30 days of ``AS_OF``."""
    d = F.col("doc_id")
    hours = F.make_dt_interval(F.lit(0), ((d * 7) % 1500 - 20).cast("int"))
    age = F.lit(AS_OF).cast("timestamp_ntz") - hours
    endings = ("top", "xyz", "click", "ga", "party", "cf")
    names = ("w{}.top", "webmail-upgrade{}.xyz", "owa{}.click", "x{}.ga", "a{}.party", "host{}.cf")
    domains = F.array(*[
        F.concat(F.lit(n.split("{}")[0]), d.cast("string"), F.lit("." + e))
        for n, e in zip(names, endings)
    ])
    docs = table(spark, sf_dir, "documents")
    return docs.select(
        F.explode(domains).alias("domain"),
        F.when(d % 10 != 4, age).alias("created_at"),
    )


#: Threat entries that arrive after the mail was checked.
LATE_ENTRY = "ord % 5 = 2"
#: Scans of the second of two batches.
SECOND_BATCH = "id % 3 = 0"

#: Buckets of up to a megabyte a table of snapshots has before they grow, and what they grow to.
SNAPSHOT_BUCKETS, SNAPSHOT_BYTES = 32, 32 << 20

#: Bytes of text whose trigrams are in one bucket of a search index.
INDEX_BYTES = 64 << 20

_stored: dict[tuple[str, str, str], str] = {}


def _once(spark: SparkSession, sf_dir: str, what: str, write) -> str:
    """Name of a table that ``write(name, path)`` stores once per application."""
    key = (spark.sparkContext.applicationId, sf_dir, what)
    if key not in _stored:
        path = work_folder(spark, what)
        name = path.rsplit("/", 1)[-1].replace("-", "_")
        write(name, path)
        _stored[key] = name
    return _stored[key]


def scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The scan table, written once per application as a stored table would be."""
    def write(name: str, path: str) -> None:
        own = snapshots.buckets_for(table(spark, sf_dir, "documents"), "text")
        store_scans(scored_scans(spark, sf_dir), name, path, max(BUCKETS, own))

    return spark.table(_once(spark, sf_dir, "scans", write))


def scan_snapshots(spark: SparkSession, sf_dir: str) -> str:
    """Where the scans are a table of snapshots, anew for each change; the buckets of a small
    table are small, so that it has several, those of a large one larger instead of more."""
    path = work_folder(spark, "snapshots")
    docs = table(spark, sf_dir, "documents")
    own = max(min(snapshots.buckets_for(docs, "text", 1 << 20), SNAPSHOT_BUCKETS),
              snapshots.buckets_for(docs, "text", SNAPSHOT_BYTES))
    snapshots.create(scans(spark, sf_dir), path, own)
    return path


def search_index(spark: SparkSession, sf_dir: str) -> str:
    """Name of a search index over all scans, filled by two batches."""

    def write(name: str, path: str) -> None:
        own = max(INDEX_BUCKETS, snapshots.buckets_for(
            table(spark, sf_dir, "documents"), "text", INDEX_BYTES))
        for batch in (f"NOT ({SECOND_BATCH})", SECOND_BATCH):
            add_to_index(scans(spark, sf_dir).filter(batch), name, path, buckets=own)

    return _once(spark, sf_dir, "search", write)


def link_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The links of all scans by ``id``, filled by two batches."""

    def write(name: str, path: str) -> None:
        for batch in (f"NOT ({SECOND_BATCH})", SECOND_BATCH):
            add_links(scans(spark, sf_dir).filter(batch), name, path)

    return spark.table(_once(spark, sf_dir, "links", write))


def brand_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``brand_registry(ord, brand, title, official)``: the fixed brands and one per document,
    half of which own the domain of their name."""
    fixed = [(i, b, b.title(), list(d)) for i, (b, d) in enumerate(BRAND_DOMAINS.items())]
    schema = "ord long, brand string, title string, official array<string>"
    d = F.col("doc_id")
    name = F.concat(F.lit("webmail-upgrade"), d.cast("string"))
    official = F.when(d % 2 == 0, F.array(F.concat(name, F.lit(".xyz")))).otherwise(
        F.array().cast("array<string>"))
    brand = plain_letters(name)
    own = table(spark, sf_dir, "documents").select(
        (d + 100).alias("ord"), brand.alias("brand"), F.concat(
            F.upper(F.substring(brand, 1, 1)), F.substring(brand, 2, 100)).alias("title"),
        official.alias("official"))
    return spark.createDataFrame(fixed, schema).unionByName(own)


def scored_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scan table: every valid mail scored, with a note and an arrival time."""
    events = table(spark, sf_dir, "events").select(F.col("event_id").alias("mail_id"), "ts")
    scored = analyse_mail(valid_mail(mail(spark, sf_dir)).select("mail_id", "email_text"))
    i = F.col("mail_id")
    return scored.join(events, "mail_id").select(
        (i + 1).alias("id"), "email_text", "flags", "findings", "score", "risk_level",
        _pick(NOTES, i % len(NOTES)).alias("note"),
        F.date_trunc("minute", "ts").cast("timestamp_ntz").alias("created_at"),
        (i % 6 == 0).alias("network_checked"),
    )


def old_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scans as an older release stored them: text flags and JSON findings.

    Some rows hold broken JSON, none at all, or only categories that no longer
    exist.
    """
    s, i = scans(spark, sf_dir), F.col("id")
    gone = F.lit('[{"rule":"old","category":"retired","message":"gone","match":""}]')
    raw = (
        F.when(i % 7 == 0, F.lit("[]")).when(i % 7 == 1, F.lit(None))
        .when(i % 7 == 2, F.lit("{not json")).when(i % 7 == 3, gone)
        .otherwise(F.to_json("findings"))
    )
    return s.select(
        "id", "email_text", F.array_join("flags", "\n").alias("flags"), raw.alias("findings"),
        "score", "risk_level", "note", F.date_format("created_at", "yyyy-MM-dd HH:mm")
        .alias("created_at"), F.col("network_checked").cast("int").alias("network_checked"),
    )


def note_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``note_edits(id, seq, note)``: some too long, some for unknown ids, some twice."""
    d = F.col("doc_id")
    note = (
        F.when(d % 4 == 0, F.lit("   "))
        .when(d % 4 == 1, F.concat(F.lit(" seen by "), d.cast("string"), F.lit("\n")))
        .when(d % 4 == 2, F.rpad(F.lit("n"), 2000 + 1, "n"))
        .otherwise(F.rpad(F.lit("m"), 2000, "m"))
    )
    docs = table(spark, sf_dir, "documents")
    return docs.select(
        (F.floor(d * 2 / 3) * 2).cast("long").alias("id"), d.alias("seq"), note.alias("note"),
    )


def delete_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``delete_requests(id)``: every third number up to three times the scan ids."""
    return table(spark, sf_dir, "documents").select((F.col("doc_id") * 3).alias("id"))


def submissions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``submissions(mail_id, email_text)``: conversation turns handed in as mail."""
    c = table(spark, sf_dir, "conversations")
    key = F.col("conv_id") * 1000 + F.col("turn")
    blank = F.when(F.col("turn") % 5 == 4, F.lit("  ")).otherwise(F.col("text"))
    return c.select(
        key.alias("mail_id"),
        F.concat(F.when(F.col("turn") % 2 == 0, F.lit(" ")).otherwise(
            F.lit("Dear member, act now: http://bit.ly/q\n")), blank).alias("email_text"),
    )


