"""The registered queries in DuckDB SQL, for side-by-side checks.

Nothing here is used by the Spark jobs. Each statement starts from the given tables
and computes its result its own way: rules as a union of selects, windows for repeats,
line numbers for header blocks, brand pairs by join.
"""

from __future__ import annotations

from baitwatch import fixture as X
from baitwatch import registry as R
from baitwatch.operators.scans import FEED_SPAN
from baitwatch.operators.splits import COPY_NOISE


def q(value) -> str:
    return "NULL" if value is None else "'" + str(value).replace("'", "''") + "'"


def values(rows) -> str:
    return ", ".join("(" + ", ".join(v if isinstance(v, str) else str(v) for v in r) + ")"
                     for r in rows)


def in_(items) -> str:
    return "(" + ", ".join(q(i) for i in items) + ")"


SPACES = "||".join(f"chr({c})" for c in (9, 10, 11, 12, 13, 28, 29, 30, 31, 32, 133, 160, 8232, 8233))


def strip(x: str) -> str:
    return f"trim({x}, {SPACES})"


def pick(items, index: str) -> str:
    return "CASE " + index + " " + " ".join(
        f"WHEN {i} THEN {q(v)}" for i, v in enumerate(items)) + " END"


def fill(template: str, **parts: str) -> str:
    sql = q(template)
    for name, expr in parts.items():
        sql = f"replace({sql}, '{{{name}}}', {expr})"
    return sql


def ratio(a: str, b: str) -> str:
    return f"CASE WHEN ({b}) = 0 THEN 0.0::DOUBLE ELSE ({a})::DOUBLE / ({b})::DOUBLE END"


# --- derived tables -------------------------------------------------------------------

_PLACED = "replace(replace(t.{0}, '{{page}}', coalesce(p.url, '')), '{{id}}', d.doc_id::VARCHAR)"

MAIL = f"""
tpl(k, bad, head, tail) AS (VALUES {values(
    (i, t.bad, q(t.head), q(t.tail)) for i, t in enumerate(X.TEMPLATES))}),
numbered AS (SELECT *, doc_id % (SELECT count(*) FROM pages) AS page_no FROM documents),
mail AS (
  SELECT d.doc_id AS mail_id, d.source,
    CASE WHEN l.toxic = 1 THEN 1 ELSE t.bad END AS bad,
    CASE WHEN l.toxic = 1 OR t.bad = 1 THEN {pick(X.POSITIVE_ALIASES, 'd.doc_id % 6')}
         ELSE {pick(X.NEGATIVE_ALIASES, 'd.doc_id % 6')} END AS raw_label,
    {_PLACED.format('head')} || d.text || {_PLACED.format('tail')} AS email_text
  FROM numbered d JOIN tpl t ON t.k = d.doc_id % {X.N_TEMPLATES}
  LEFT JOIN pages p ON p.page_id = d.page_no LEFT JOIN labels l ON l.doc_id = d.doc_id)"""

CORPUS = MAIL + f""",
raw_corpus AS (
  SELECT mail_id AS row_id, {pick(R.CORPORA, "substr(source, 4)::INT % 5")} AS source,
    CASE WHEN mail_id % 9 = 4 THEN '2' WHEN mail_id % 9 = 7 THEN NULL
         ELSE bad::VARCHAR END AS label,
    CASE WHEN mail_id % 7 = 2 THEN NULL WHEN mail_id % 7 = 4 THEN ' ' || chr(9) || ' '
         ELSE '  Notice ' || mail_id::VARCHAR || ' ' || chr(10) END AS subject,
    CASE WHEN mail_id % 11 = 3 THEN NULL WHEN mail_id % 11 = 5 THEN chr(10) || '  '
         ELSE ' ' || chr(13) || chr(10) || email_text || chr(9) || ' ' END AS body
  FROM mail),
composed AS (
  SELECT * FROM (SELECT row_id, source, label,
    {strip(strip("coalesce(subject, '')") + " || chr(10) || chr(10) || "
           + strip("coalesce(body, '')"))} AS email_text FROM raw_corpus)
  WHERE email_text <> ''),
labelled AS (
  SELECT row_id, source, CASE label WHEN '1' THEN 'phishing' ELSE 'legitimate' END AS label,
    email_text FROM composed WHERE label IN ('0', '1')),
focused AS (
  SELECT row_id, source, 'phishing' AS label, email_text FROM composed
    WHERE source IN {in_(R.PHISHING_CORPORA)}
  UNION ALL SELECT row_id, source, 'legitimate', email_text FROM composed
    WHERE source IN {in_(R.LEGITIMATE_CORPORA)} AND label = '0')"""

VALID = MAIL + f""",
checked AS (SELECT mail_id, coalesce({strip('email_text')}, '') AS email_text FROM mail),
valid AS (SELECT * FROM checked WHERE email_text <> '')"""

THREATS = f"""
threat_list AS (
  SELECT CASE page_id % 3 WHEN 0 THEN url WHEN 1 THEN url || '#gone' END AS url, k.threat_type,
    page_id * 2 + k.add AS ord
  FROM pages JOIN (VALUES (0, 1, 'MALWARE'), (1, 1, 'SOCIAL_ENGINEERING'), (2, 1, NULL),
    (3, 1, 'UNWANTED_SOFTWARE'), (3, 0, 'MALWARE'), (0, 0, 'SOCIAL_ENGINEERING'), (1, 0, NULL),
    (2, 0, 'UNWANTED_SOFTWARE')) k(kind, add, threat_type) ON k.kind = page_id % 4),
domain_reg AS (
  SELECT replace(n.name, '{{}}', doc_id::VARCHAR) AS domain,
    CASE WHEN doc_id % 10 <> 4 THEN TIMESTAMP '{X.AS_OF}'
      - to_hours(((doc_id * 7) % 1500 - 20)::INT) END AS created_at
  FROM documents CROSS JOIN (VALUES ('w{{}}.top'), ('webmail-upgrade{{}}.xyz'), ('owa{{}}.click'),
    ('x{{}}.ga'), ('a{{}}.party'), ('host{{}}.cf')) n(name))"""


# --- detection ------------------------------------------------------------------------


def text_rules(src: str) -> str:
    selects = []
    for i, r in enumerate(R.TEXT_RULES, 1):
        pattern = r.pattern or "|".join(r.phrases)
        selects.append(
            f"SELECT mail_id, {i} AS ord, {q(r.key)} AS rule, {q(r.category)} AS category, "
            f"{q(r.message)} AS message, "
            f"trim(regexp_extract(email_text, {q(pattern)}, 0, 'i')) AS match FROM {src}")
    return f""",
hits AS (
  SELECT mail_id, ord, rule, category, replace(message, '{{match}}', match) AS message, match
  FROM ({" UNION ALL ".join(selects)}) WHERE match <> ''),
kept AS (
  SELECT * FROM hits QUALIFY row_number() OVER (
    PARTITION BY mail_id, category, lower(match) ORDER BY ord) = 1)"""


def attachments(src: str) -> str:
    return f""",
attached AS (
  SELECT mail_id, match, {fill(R.ATTACHMENT_MESSAGE, match='match')} AS message
  FROM (SELECT mail_id, regexp_extract(email_text, {q(R.ATTACHMENT_PATTERN)}, 0, 'i') AS match
        FROM {src}) WHERE match <> '')"""


_HEADER = R.HEADER_PATTERN
_ADDRESS = R.ADDRESS_PATTERN


def _domain(a: str) -> str:
    return f"CASE WHEN contains({a}, '@') THEN regexp_replace(lower({a}), '^.*@', '') ELSE '' END"


def _root(host: str) -> str:
    return f"regexp_extract({host}, '([^.]*\\.)?[^.]*$', 0)"


def headers(src: str) -> str:
    named = q(r"(?s)^(.*?)<([^>]*)>\s*$")
    return f""",
lines AS (
  SELECT mail_id, unnest(l) AS line, generate_subscripts(l, 1) AS no FROM (
    SELECT mail_id, regexp_split_to_array(email_text, '\\r\\n|[\\n\\r\\x0b\\x0c\\x1c-\\x1e]') AS l
    FROM {src})),
starts AS (SELECT mail_id, min(no) AS f FROM lines WHERE {strip('line')} <> '' GROUP BY mail_id),
stops AS (
  SELECT mail_id, min(no) AS s FROM lines JOIN starts USING (mail_id)
  WHERE no >= f AND NOT regexp_matches(line, {q(_HEADER)}, 'i') GROUP BY mail_id),
headers AS (
  SELECT mail_id, name, arg_min(value, no) AS value FROM (
    SELECT mail_id, no, lower(regexp_extract(line, {q(_HEADER)}, 1, 'i')) AS name,
      {strip(f"regexp_extract(line, {q(_HEADER)}, 2, 'i')")} AS value
    FROM lines JOIN starts USING (mail_id) LEFT JOIN stops USING (mail_id)
    WHERE no >= f AND (s IS NULL OR no < s))
  GROUP BY mail_id, name),
addressed AS (
  SELECT mail_id, name,
    {strip("trim(" + strip(f"regexp_extract(value, {named}, 1)") + ", '\"')")} AS display,
    lower(regexp_extract(CASE WHEN regexp_matches(value, {named})
      THEN regexp_extract(value, {named}, 2) ELSE value END, {q(_ADDRESS)}, 0)) AS address
  FROM headers WHERE name IN ('from', 'reply-to', 'return-path')),
senders AS (
  SELECT f.mail_id, f.display, f.address, {_root(_domain('f.address'))} AS root,
    {_domain('f.address')} AS domain, regexp_extract(f.display, {q(_ADDRESS)}, 0) AS shown,
    coalesce(r.address, '') AS reply_address, coalesce(b.address, '') AS return_address
  FROM addressed f
  LEFT JOIN addressed r ON r.mail_id = f.mail_id AND r.name = 'reply-to'
  LEFT JOIN addressed b ON b.mail_id = f.mail_id AND b.name = 'return-path'
  WHERE f.name = 'from'),
brand(brand, ord) AS (VALUES {values((q(b), i) for i, b in enumerate(R.BRAND_DOMAINS))}),
brand_domain(brand, domain) AS (VALUES {values(
    (q(b), q(d)) for b, ds in R.BRAND_DOMAINS.items() for d in ds)}),
claims AS (
  SELECT mail_id, root, brand FROM senders JOIN brand
    ON contains(replace(lower(display), ' ', ''), brand)
  WHERE root <> '' AND NOT EXISTS (
    SELECT 1 FROM brand_domain b WHERE b.brand = brand.brand AND b.domain = senders.root)
  QUALIFY row_number() OVER (PARTITION BY mail_id ORDER BY ord) = 1),
sender_hits AS (
  SELECT mail_id, 1 AS sub, 'display_name_address_mismatch' AS rule,
    {fill(R.MESSAGES['display_name_address_mismatch'], shown='shown', address='address')} AS message
  FROM senders WHERE shown <> '' AND root <> '' AND {_root(_domain('shown'))} <> root
  UNION ALL
  SELECT mail_id, 2, 'display_name_brand_mismatch',
    {fill(R.MESSAGES['display_name_brand_mismatch'],
          brand="upper(brand[1]) || brand[2:]", root='root')} FROM claims
  UNION ALL
  SELECT mail_id, 3, 'reply_to_mismatch', {fill(
      R.MESSAGES['other_address'], header="'Reply-To'", other='reply_address',
      address='address')} FROM senders
  WHERE root <> '' AND {_root(_domain('reply_address'))} NOT IN ('', root)
  UNION ALL
  SELECT mail_id, 4, 'return_path_mismatch', {fill(
      R.MESSAGES['other_address'], header="'Return-Path'", other='return_address',
      address='address')} FROM senders
  WHERE root <> '' AND {_root(_domain('return_address'))} NOT IN ('', root)
  UNION ALL
  SELECT mail_id, 5, 'organisation_from_free_mail', {fill(
      R.MESSAGES['organisation_from_free_mail'], display='display', address='address')}
  FROM senders WHERE domain IN {in_(R.WEBMAIL_DOMAINS)}
    AND ({" OR ".join(f"contains(lower(display), {q(w)})" for w in R.ORGANISATION_WORDS)}))"""


_URL = R.LINK_PATTERN
_CREDENTIAL = R.CREDENTIAL_LINK_PATTERN


def urls(src: str) -> str:
    rest = ("CASE WHEN starts_with(url, 'https://') THEN substr(url, 9) "
            "WHEN starts_with(url, 'http://') THEN substr(url, 8) ELSE url END")
    return f""",
url_lists AS (SELECT mail_id, regexp_extract_all(email_text, {q(_URL)}, 0, 'i') AS l FROM {src}),
raw_urls AS (
  SELECT mail_id, unnest(l) AS url, generate_subscripts(l, 1) - 1 AS pos FROM url_lists),
hosts AS (
  SELECT mail_id, pos, url, regexp_replace(split_part(regexp_replace(lower(
      CASE WHEN starts_with(url, 'https://') AND regexp_matches(a, '[\\[\\]]') THEN '' ELSE a END
    ), '^.*@', ''), ':', 1), '^www\\.', '') AS host,
    contains(regexp_extract(regexp_replace(url, '^https?://', '', 'i'), '^[^/?#]*', 0), '@')
      AS has_userinfo
  FROM (SELECT *, regexp_extract({rest}, '^[^/?#]*', 0) AS a FROM raw_urls)),
roots AS (SELECT *, {_root('host')} AS root FROM hosts),
url_facts AS (
  SELECT mail_id, pos::INT AS pos, url, host, root,
    CASE WHEN contains(root, '.') THEN regexp_extract(root, '[^.]*$', 0) ELSE '' END AS tld,
    has_userinfo FROM roots)"""


_PLAIN = {**R.CONFUSABLES, **R.LOOKALIKES}


def links(src: str) -> str:
    title = "upper(b.brand[1]) || b.brand[2:]"
    return f""",
named AS (
  SELECT *, split_part(root, '.', 1) AS name,
    translate(split_part(root, '.', 1), {q("".join(_PLAIN))}, {q("".join(_PLAIN.values()))})
      AS plain FROM url_facts),
spoof_raw AS (
  SELECT mail_id, pos, 4 AS sub, {fill(R.MESSAGES['punycode'], host='host')} AS message
  FROM named WHERE contains('.' || host, '.xn--')
  UNION ALL
  SELECT mail_id, pos, 5, {fill(R.MESSAGES['homograph'], root='root')} FROM named
  WHERE translate(name, {q("".join(R.CONFUSABLES))}, '') <> name
  UNION ALL
  SELECT mail_id, pos, 6 + b.ord,
    CASE WHEN contains(host, b.brand)
           THEN {fill(R.MESSAGES['brand_in_host'], host='host', brand=title)}
         WHEN plain = b.brand THEN {fill(R.MESSAGES['misspelled'], root='root', brand=title)}
         ELSE {fill(R.MESSAGES['typo_squat'], root='root', brand=title)} END
  FROM named n JOIN brand b ON contains(host, b.brand) OR plain = b.brand
    OR (length(b.brand) >= 5 AND levenshtein(plain, b.brand) = 1)
  WHERE NOT EXISTS (SELECT 1 FROM brand_domain o WHERE o.brand = b.brand AND o.domain = n.root)),
per_url AS (
  SELECT mail_id, pos, 1 AS sub, 'shortener' AS rule,
    {fill(R.MESSAGES['shortener'], url='url', root='root')} AS message FROM url_facts
    WHERE root IN {in_(R.SHORTENERS)}
  UNION ALL SELECT mail_id, pos, 2, 'userinfo_trick',
    {fill(R.MESSAGES['userinfo_trick'], url='url')} FROM url_facts WHERE has_userinfo
  UNION ALL SELECT mail_id, pos, 3, 'suspicious_tld',
    {fill(R.MESSAGES['suspicious_tld'], url='url', tld='tld')} FROM url_facts
    WHERE tld IN {in_(R.SUSPICIOUS_TLDS)}
  UNION ALL SELECT mail_id, pos, sub, 'domain_spoofing', message FROM spoof_raw),
link_hits AS (
  SELECT mail_id, -2 AS pos, 0 AS sub, 'has_links' AS rule, 'informational' AS category,
    {fill(R.MESSAGES['has_links'], count='len(l)::VARCHAR')} AS message
  FROM url_lists WHERE len(l) > 0
  UNION ALL SELECT mail_id, -1, 0, 'ip_url', 'link_manipulation', {q(R.MESSAGES['ip_url'])}
  FROM {src} WHERE regexp_matches(email_text, {q(R.IP_LINK_PATTERN)})
  UNION ALL SELECT mail_id, pos, sub, rule, 'link_manipulation', message FROM (
    SELECT * FROM per_url QUALIFY row_number() OVER (
      PARTITION BY mail_id, message ORDER BY pos, sub) = 1)
  UNION ALL SELECT mail_id, 1000000, 1, 'credential_path', 'informational',
    {q(R.MESSAGES['credential_path'])} FROM {src} JOIN url_lists USING (mail_id)
  WHERE len(l) > 0 AND regexp_matches(email_text, {q(_CREDENTIAL)}, 'i')
  UNION ALL SELECT mail_id, 1000000, 2, 'insecure_http', 'informational',
    {q(R.MESSAGES['insecure_http'])} FROM {src} WHERE contains(lower(email_text), 'http://'))"""


def findings(src: str) -> str:
    """All findings of a mail, numbered in reporting order, and their score."""
    weights = values((q(c.key), c.weight, q(c.label)) for c in R.CATEGORIES)
    return text_rules(src) + attachments(src) + headers(src) + urls(src) + links(src) + f""",
gated AS (
  SELECT DISTINCT mail_id FROM kept WHERE category IN ('credentials', 'account_threat')
  INTERSECT SELECT mail_id FROM url_lists WHERE len(l) > 0),
mentions AS (
  SELECT mail_id, brand FROM {src} JOIN gated USING (mail_id)
  JOIN brand b ON contains(lower(email_text), b.brand)
  QUALIFY row_number() OVER (PARTITION BY mail_id ORDER BY b.ord) = 1),
mismatches AS (
  SELECT m.mail_id, {fill(R.MESSAGES['brand_link_mismatch'],
      brand="upper(m.brand[1]) || m.brand[2:]",
      roots="(SELECT string_agg(root, ', ' ORDER BY root) FROM (SELECT DISTINCT root FROM "
            "url_facts u WHERE u.mail_id = m.mail_id ORDER BY root LIMIT 3))")} AS message
  FROM mentions m WHERE NOT EXISTS (
    SELECT 1 FROM url_facts u JOIN brand_domain o ON o.domain = u.root AND o.brand = m.brand
    WHERE u.mail_id = m.mail_id)),
findings AS (
  SELECT mail_id, row_number() OVER (PARTITION BY mail_id ORDER BY grp, a, b)::INT AS ord,
    rule, category, message, match
  FROM (
    SELECT mail_id, 1 AS grp, ord AS a, 0 AS b, rule, category, message, match FROM kept
    UNION ALL SELECT mail_id, 2, 0, 0, 'risky_attachment', 'attachment', message, match
      FROM attached
    UNION ALL SELECT mail_id, 3, sub, 0, rule, 'sender', message, '' FROM sender_hits
    UNION ALL SELECT mail_id, 4, pos, sub, rule, category, message, '' FROM link_hits
    UNION ALL SELECT mail_id, 5, 0, 0, 'brand_link_mismatch', 'link_manipulation', message, ''
      FROM mismatches)),
category(category, weight, label) AS (VALUES {weights}),
points AS (
  SELECT mail_id, sum(weight)::INT AS score FROM (SELECT DISTINCT mail_id, category FROM findings)
  JOIN category USING (category) GROUP BY mail_id),
scored AS (
  SELECT mail_id, email_text, coalesce(score, 0)::INT AS score,
    CASE WHEN coalesce(score, 0) < 3 THEN 'Safe' WHEN score < 6 THEN 'Suspicious'
         ELSE 'Dangerous' END AS risk_level,
    coalesce((SELECT string_agg(message, chr(10) ORDER BY ord) FROM findings f
              WHERE f.mail_id = s.mail_id), '') AS flags
  FROM {src} s LEFT JOIN points USING (mail_id))"""


def level(score: str) -> str:
    return (f"CASE WHEN {score} < 3 THEN 'Safe' WHEN {score} < 6 THEN 'Suspicious' "
            "ELSE 'Dangerous' END")


SCANS = f""",
scans AS (
  SELECT mail_id + 1 AS id, mail_id, email_text, flags, score, risk_level,
    {pick(X.NOTES, f'mail_id % {len(X.NOTES)}')} AS note,
    date_trunc('minute', e.ts) AS created_at, mail_id % 6 = 0 AS network_checked
  FROM scored JOIN events e ON e.event_id = mail_id)"""
MINUTE = "strftime(created_at, '%Y-%m-%d %H:%M')"
SCAN_VIEW = f"id, email_text, flags, score, risk_level, note, {MINUTE} AS created_at, network_checked"


def checks(src: str) -> str:
    """Link findings of the mail in ``src``; needs ``url_facts``, threats and domains."""
    return f""",
threats AS (
  SELECT url, arg_min(replace(lower(coalesce(threat_type, 'threat')), '_', ' '), ord) AS threat,
    min(ord) AS ord FROM threat_list WHERE url IS NOT NULL AND url <> '' GROUP BY url),
threat_hits AS (
  SELECT DISTINCT mail_id, url, threat, ord, {fill(
      R.MESSAGES['safe_browsing'], url='url', threat='threat')} AS message
  FROM (SELECT mail_id, url FROM url_facts) JOIN threats USING (url)),
domains AS (
  SELECT mail_id, domain, row_number() OVER (PARTITION BY mail_id ORDER BY p)::INT AS pos
  FROM (SELECT mail_id, root AS domain, min(pos) AS p FROM url_facts GROUP BY ALL)),
aged AS (
  SELECT domain, floor((epoch_us(TIMESTAMP '{X.AS_OF}') - epoch_us(created_at)) / 86400000000.0)::INT
    AS age_days FROM domain_reg WHERE created_at IS NOT NULL),
new_domains AS (
  SELECT mail_id, pos, domain, age_days, {fill(
      R.MESSAGES['new_domain'], domain='domain', days='age_days::VARCHAR')} AS message
  FROM domains JOIN aged USING (domain) WHERE age_days < {R.NEW_DOMAIN_DAYS}),
link_checks AS (
  SELECT mail_id, string_agg(message, chr(10) ORDER BY kind, ord) AS messages,
    sum(points)::INT AS points
  FROM (SELECT mail_id, 0 AS kind, ord, message, {R.THREAT_POINTS} AS points FROM threat_hits
        UNION ALL SELECT mail_id, 1, pos, message, {R.NEW_DOMAIN_POINTS} FROM new_domains)
  WHERE mail_id IN (SELECT mail_id FROM {src}) GROUP BY mail_id)"""


def with_(*parts: str) -> str:
    return "WITH " + "".join(parts) + " "


ON_MAIL = findings("mail")
ON_VALID = findings("valid")
SCAN_TABLE = with_(VALID, ON_VALID, SCANS)
_ACTUAL = (f"CASE WHEN lower({strip('raw_label')}) IN {in_(R.POSITIVE_LABELS)} THEN 'phishing' "
           f"WHEN lower({strip('raw_label')}) IN {in_(R.NEGATIVE_LABELS)} THEN 'legitimate' END")


def queries() -> dict[str, str]:
    out: dict[str, str] = {}
    for category in R.TEXT_CATEGORIES:
        out[f"tag_{category}"] = (
            with_(MAIL, text_rules("mail"))
            + f"SELECT mail_id, ord::INT AS ord, rule, category, message, match FROM hits "
              f"WHERE category = {q(category)}")
    out["dedupe_findings"] = with_(MAIL, text_rules("mail")) + (
        "SELECT mail_id, row_number() OVER (PARTITION BY mail_id ORDER BY ord)::INT AS ord, rule, "
        "category, message, match FROM kept")
    out["tag_attachment"] = with_(MAIL, attachments("mail")) + (
        "SELECT mail_id, 'risky_attachment' AS rule, 'attachment' AS category, message, match "
        "FROM attached")
    head = with_(MAIL, headers("mail"))
    out["header_block"] = head + "SELECT mail_id, name, value FROM headers"
    out["sender_address"] = head + (
        "SELECT mail_id, display, address, root, reply_address, return_address FROM senders")
    out["sender_checks"] = head + "SELECT mail_id, rule, message FROM sender_hits"
    out["sender_brand"] = head + (
        "SELECT mail_id, rule, message FROM sender_hits WHERE sub = 2")
    link = with_(MAIL, headers("mail"), urls("mail"), links("mail"))
    out["url_facts"] = with_(MAIL, urls("mail")) + "SELECT * FROM url_facts"
    out["url_findings"] = link + (
        "SELECT mail_id, row_number() OVER (PARTITION BY mail_id ORDER BY pos, sub)::INT AS ord, "
        "rule, category, message FROM link_hits")
    for key, column, items in (("url_shorteners", "root", R.SHORTENERS),
                               ("url_suspicious_tld", "tld", R.SUSPICIOUS_TLDS)):
        out[key] = with_(MAIL, urls("mail")) + (
            f"SELECT mail_id, pos, url, root, tld FROM url_facts WHERE {column} IN {in_(items)}")
    out["domain_spoofing"] = link + "SELECT DISTINCT mail_id, message FROM spoof_raw"
    full = with_(MAIL, ON_MAIL)
    out["brand_link_mismatch"] = full + "SELECT mail_id, message FROM mismatches"
    out["all_findings"] = full + "SELECT * FROM findings"
    out["score_mail"] = full + "SELECT mail_id, score, risk_level FROM scored"
    out["analyse_mail"] = full + (
        "SELECT mail_id, score, risk_level, flags, (SELECT count(*) FROM findings f WHERE "
        "f.mail_id = s.mail_id)::INT AS n_findings FROM scored s")
    out["scored_categories"] = full + (
        "SELECT m.mail_id, coalesce(string_agg(category, ',' ORDER BY weight DESC, category), '') "
        "AS categories FROM mail m LEFT JOIN (SELECT DISTINCT mail_id, category, weight FROM "
        "findings JOIN category USING (category) WHERE weight > 0) USING (mail_id) "
        "GROUP BY m.mail_id")
    out["grouped_findings"] = full + (
        "SELECT mail_id, row_number() OVER (PARTITION BY mail_id ORDER BY weight DESC, category)"
        "::INT AS place, category, weight, messages FROM (SELECT mail_id, category, weight::INT AS "
        "weight, string_agg(message, chr(10) ORDER BY ord) AS messages FROM findings "
        "JOIN category USING (category) GROUP BY ALL)")
    out["category_listing"] = full + (
        "SELECT c.category, label, weight::INT AS weight, advice, count(DISTINCT mail_id) AS mails "
        f"FROM category c JOIN (VALUES {values((q(c.key), q(c.advice)) for c in R.CATEGORIES)}) "
        "a(category, advice) USING (category) LEFT JOIN findings f ON f.category = c.category WHERE weight > 0 "
        "GROUP BY ALL ORDER BY weight DESC, label")

    # evaluation
    labelled = full.rstrip() + f", e AS (SELECT s.*, {_ACTUAL} AS actual FROM scored s JOIN " \
                               "(SELECT mail_id, raw_label FROM mail) USING (mail_id)) "
    p, hit = "actual = 'phishing'", "risk_level <> 'Safe'"
    out["normalize_label"] = with_(MAIL) + f"SELECT mail_id, raw_label, {_ACTUAL} AS label FROM mail"
    out["confusion_matrix"] = labelled.rstrip() + f""", c AS (
  SELECT count_if({p} AND {hit})::BIGINT AS true_positive,
    count_if(NOT {p} AND {hit})::BIGINT AS false_positive,
    count_if(NOT {p} AND NOT {hit})::BIGINT AS true_negative,
    count_if({p} AND NOT {hit})::BIGINT AS false_negative FROM e),
r AS (SELECT *, true_positive + false_negative AS actual_phishing,
    false_positive + true_negative AS actual_legitimate, true_positive + true_negative AS correct,
    {ratio('true_positive', 'true_positive + false_positive')} AS "precision",
    {ratio('true_positive', 'true_positive + false_negative')} AS recall FROM c)
SELECT *, array_to_string(list_filter([
    (SELECT 'Safe=' || count(*) FROM e WHERE risk_level = 'Safe' HAVING count(*) > 0),
    (SELECT 'Suspicious=' || count(*) FROM e WHERE risk_level = 'Suspicious' HAVING count(*) > 0),
    (SELECT 'Dangerous=' || count(*) FROM e WHERE risk_level = 'Dangerous' HAVING count(*) > 0)],
    lambda x: x IS NOT NULL), ',') AS risk_levels, actual_phishing + actual_legitimate AS total,
  {ratio('correct', 'actual_phishing + actual_legitimate')} AS accuracy,
  {ratio('false_positive', 'actual_legitimate')} AS false_positive_rate,
  {ratio('false_negative', 'actual_phishing')} AS false_negative_rate,
  {ratio('2 * "precision" * recall', '"precision" + recall')} AS f1_score FROM r"""
    out["risk_distribution"] = labelled + (
        "SELECT risk_level, count(*) AS mails FROM e GROUP BY risk_level")

    def sweep(ctes: str, bars: str, group: str = "") -> str:
        """Quality of every threshold over ``bars`` with columns ``actual, score``."""
        return ctes.rstrip() + f""", c AS (
  SELECT {group} t::INT AS threshold, count_if({p} AND score >= t) AS tp, count_if({p} AND score < t) AS fn,
    count_if(NOT {p} AND score >= t) AS fp, count_if(NOT {p} AND score < t) AS tn
  FROM {bars}, range(1, {R.MAX_THRESHOLD + 1}) x(t) GROUP BY {group} t),
r AS (SELECT *, {ratio('tp', 'tp + fp')} AS "precision", {ratio('tp', 'tp + fn')} AS recall FROM c)
SELECT {group} threshold, "precision", recall,
  {ratio('2 * "precision" * recall', '"precision" + recall')} AS f1_score,
  {ratio('tp + tn', 'tp + fn + fp + tn')} AS accuracy, {ratio('fp', 'fp + tn')} AS fp_rate,
  CASE threshold WHEN 3 THEN 'suspicious' WHEN 6 THEN 'dangerous' ELSE '' END AS in_use FROM r"""

    out["threshold_sweep"] = sweep(labelled, "e")
    flipped = f"CASE WHEN mail_id % 7 <> 3 THEN actual WHEN {p} THEN 'legitimate' ELSE 'phishing' END"
    out["kept_sweep"] = sweep(labelled.rstrip() + (
        f", judged AS (SELECT score, {flipped} AS actual FROM e WHERE mail_id % 5 <> 2)"), "judged")
    out["category_ablation"] = sweep(labelled.rstrip() + """,
partial AS (
  SELECT e.mail_id, e.actual, w.category AS without, coalesce(sum(c.weight), 0) AS score
  FROM e CROSS JOIN (SELECT category FROM category WHERE weight > 0) w
  LEFT JOIN (SELECT DISTINCT mail_id, category FROM findings) f
    ON f.mail_id = e.mail_id AND f.category <> w.category
  LEFT JOIN category c ON c.category = f.category GROUP BY ALL)""", "partial", "without,")
    out["write_results"] = out["threshold_sweep"]

    # corpora
    out["compose_mail"] = with_(CORPUS) + "SELECT row_id, source, label, email_text FROM composed"
    out["corpus_union"] = with_(CORPUS) + "SELECT row_id, source, label, email_text FROM labelled"
    out["focused_pool"] = with_(CORPUS) + "SELECT row_id, source, label, email_text FROM focused"
    out["label_counts"] = with_(CORPUS) + "SELECT label, count(*) AS n FROM labelled GROUP BY label"
    out["read_labelled"] = with_(CORPUS) + "SELECT label, email_text FROM labelled"
    out["damaged_input"] = with_(CORPUS) + (
        "SELECT problem, count(*) AS n, sum(CASE WHEN problem = '' THEN length(email_text) END)::BIGINT "
        "AS chars FROM (SELECT email_text, CASE WHEN row_id % 10 IN (3, 7) THEN 'ragged' "
        "WHEN row_id % 10 = 5 THEN 'undecodable' ELSE '' END AS problem FROM labelled) GROUP BY problem")
    out["read_tsv"] = out["read_labelled"]
    out["load_split"] = out["read_labelled"] + " WHERE label = 'phishing'"
    out["read_corpora"] = with_(CORPUS) + "SELECT source, label, subject, body FROM raw_corpus"
    out["seeded_sample"] = with_(CORPUS) + (
        "SELECT row_id, source, label, email_text FROM labelled "
        f"ORDER BY md5('{R.MIXED_SEED}:' || row_id), row_id "
        "LIMIT (SELECT count(*) // 4 FROM labelled)")
    out["merged_sample"] = out["seeded_sample"]
    splits = with_(CORPUS).rstrip() + (
        ", target AS (SELECT count(*) // 8 AS size FROM focused), "
        "splits AS (SELECT row_id, label, CASE WHEN n <= size THEN 'tuning' ELSE 'holdout' END AS "
        "split FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY "
        f"md5('{R.SPLIT_SEED}:' || row_id), row_id) AS n FROM focused), target WHERE n <= 2 * size) ")
    out["focused_splits"] = splits + "SELECT row_id, label, split FROM splits"
    out["split_disjoint"] = splits + (
        "SELECT count_if(split = 'tuning')::BIGINT AS tuning_rows, "
        "count_if(split = 'holdout')::BIGINT AS holdout_rows, (SELECT count(*) FROM "
        "(SELECT row_id FROM splits WHERE split = 'tuning' INTERSECT "
        "SELECT row_id FROM splits WHERE split = 'holdout')) AS shared_rows FROM splits")
    copies = with_(CORPUS).rstrip() + f""",
target AS (SELECT count(*) // 8 AS size FROM focused),
copied AS (SELECT *, md5(regexp_replace(email_text, {q(COPY_NOISE)}, '', 'g')) AS copy FROM focused),
classes AS (
  SELECT copy, min(label) AS label, count(*) AS n FROM copied
  GROUP BY copy HAVING count(DISTINCT label) = 1),
placed AS (
  SELECT copy, label, n, size, sum(n) OVER (PARTITION BY label ORDER BY
    md5('{R.SPLIT_SEED}:' || copy), copy ROWS UNBOUNDED PRECEDING) - n AS before
  FROM classes, target WHERE n <= size),
drawn AS (
  SELECT copy, CASE WHEN before < size THEN 'tuning' WHEN before - used < size THEN 'holdout' END
    AS split
  FROM (SELECT *, max(CASE WHEN before < size THEN before + n END) OVER (PARTITION BY label)
        AS used FROM placed)),
splits AS (
  SELECT row_id, label, split, copy FROM copied JOIN drawn USING (copy) WHERE split IS NOT NULL)
"""
    out["copy_splits"] = copies + "SELECT row_id, label, split FROM splits"
    out["copies_in_both"] = copies + (
        "SELECT label, count_if(split = 'tuning')::BIGINT AS tuning_rows, "
        "count_if(split = 'holdout')::BIGINT AS holdout_rows, "
        "count(DISTINCT CASE WHEN split = 'tuning' THEN copy END) AS tuning_texts, "
        "count(DISTINCT CASE WHEN split = 'holdout' THEN copy END) AS holdout_texts, "
        "count(DISTINCT copy) FILTER (copy IN (SELECT copy FROM splits WHERE split = 'tuning') AND "
        "copy IN (SELECT copy FROM splits WHERE split = 'holdout')) AS shared_texts "
        "FROM splits GROUP BY label")
    rated = with_(CORPUS).rstrip() + (
        ", src AS (SELECT row_id AS mail_id, label, email_text FROM focused)"
        + text_rules("src"))
    rules = values((q(r.key), q(r.category), R.WEIGHTS[r.category]) for r in R.TEXT_RULES)
    out["rule_hit_rates"] = rated + f""", rules(rule, category, weight) AS (VALUES {rules}),
n AS (SELECT count_if(label = 'phishing') AS np, count_if(label = 'legitimate') AS nl FROM src),
c AS (SELECT r.rule, r.category, r.weight::INT AS weight, count_if(s.label = 'phishing') AS hp,
    count_if(s.label = 'legitimate') AS hl
  FROM rules r LEFT JOIN hits h ON h.rule = r.rule LEFT JOIN src s ON s.mail_id = h.mail_id
  GROUP BY ALL),
x AS (SELECT rule, category, weight, {ratio('hp', 'np')} * 100 AS phishing_pct,
    {ratio('hl', 'nl')} * 100 AS legitimate_pct FROM c, n)
SELECT *, CASE WHEN legitimate_pct = 0 THEN 'Infinity'::DOUBLE
  ELSE phishing_pct / legitimate_pct END AS ratio FROM x"""
    pool = with_(CORPUS).rstrip() + (
        ", src AS (SELECT row_id AS mail_id, email_text FROM labelled)" + findings("src")
        + ", pos AS (SELECT l.source, s.score FROM labelled l JOIN scored s ON s.mail_id = l.row_id"
          " WHERE l.label = 'phishing') ")
    kind = f"CASE WHEN source IN {in_(R.PHISHING_CORPORA)} THEN 'phishing' ELSE 'spam' END"
    out["source_breakdown"] = pool + (
        f"SELECT source, count(*) AS mails, {ratio('count(*)', '(SELECT count(*) FROM pos)')} AS "
        f"share, count_if(score >= 3)::BIGINT AS caught, {ratio('count_if(score >= 3)', 'count(*)')} "
        f"AS recall, {kind} AS kind FROM pos GROUP BY source")
    out["kind_recall"] = pool + (
        f"SELECT k.kind, count(source) AS mails, {ratio('count(source)', '(SELECT count(*) FROM pos)')}"
        f" AS share, {ratio('count_if(score >= 3)', 'count(source)')} AS recall FROM (VALUES "
        f"('phishing'), ('spam')) k(kind) LEFT JOIN pos ON {kind} = k.kind GROUP BY k.kind")

    # validation and scans
    out["validate_mail"] = with_(VALID) + (
        f"SELECT mail_id, length(email_text)::INT AS chars, CASE WHEN email_text = '' THEN "
        f"{q(R.EMPTY_MAIL)} WHEN length(email_text) > {R.MAX_MAIL_CHARS} THEN "
        f"{q(R.LONG_MAIL.format(limit=R.MAX_MAIL_CHARS))} END AS error FROM checked")
    out["quarantined_mail"] = with_(VALID) + (
        f"SELECT mail_id, length(email_text)::INT AS chars, CASE WHEN email_text = '' THEN "
        f"{q(R.EMPTY_MAIL)} ELSE {q(R.LONG_MAIL.format(limit=R.MAX_MAIL_CHARS))} END AS error "
        f"FROM checked WHERE email_text = '' OR length(email_text) > {R.MAX_MAIL_CHARS}")
    s = SCAN_TABLE
    out["history_search"] = s + (
        f"SELECT {SCAN_VIEW} FROM scans WHERE email_text ILIKE '%paypal%LOGIN%' OR note ILIKE "
        "'%paypal%LOGIN%' OR flags ILIKE '%paypal%LOGIN%'")
    out["indexed_search"] = out["history_search"]
    listed = "ILIKE '%100\\%\\_list%' ESCAPE '\\'"
    out["indexed_search_literal"] = s + (
        f"SELECT {SCAN_VIEW} FROM scans WHERE email_text {listed} OR note {listed} OR flags {listed}")
    out["history_risk"] = s + f"SELECT {SCAN_VIEW} FROM scans WHERE risk_level = 'Suspicious'"
    out["scan_detail"] = s + f"SELECT {SCAN_VIEW} FROM scans WHERE id = 42"
    out["history_page"] = s + (
        f"SELECT {SCAN_VIEW} FROM scans WHERE risk_level = 'Dangerous' AND (email_text ILIKE "
        "'%your account%' OR note ILIKE '%your account%' OR flags ILIKE '%your account%') "
        "ORDER BY id DESC LIMIT 50")
    out["indexed_page"] = out["history_page"]
    out["link_check_queue"] = s + (
        "SELECT id FROM scans JOIN url_lists USING (mail_id) WHERE len(l) > 0 "
        "AND NOT network_checked")
    text = "replace(email_text, chr(10), ' ')"
    out["history_preview"] = s + (
        f"SELECT id, CASE WHEN length({text}) <= 95 THEN {text} ELSE substr({text}, 1, 89) || '…' "
        "END AS preview, substr(email_text, 1, 300) AS title, CASE WHEN coalesce(note, '') = '' "
        "THEN 'No note' WHEN length(note) <= 65 THEN note ELSE substr(note, 1, 59) || '…' END AS "
        "note, risk_level, score, least(score, 10)::INT AS meter FROM scans")
    out["risk_totals"] = s + (
        "SELECT coalesce(risk_level, 'all') AS risk_level, count(*) AS scans FROM scans "
        "GROUP BY ROLLUP (risk_level)")
    out["export_flat"] = s + (
        f"SELECT id, {MINUTE} AS created_at, risk_level, score, coalesce(note, '') AS note, "
        "replace(flags, chr(10), ' | ') AS flags, email_text FROM scans")
    out["export_nested"] = s + (
        f"SELECT id, {MINUTE} AS created_at, risk_level, score, coalesce(note, '') AS note, "
        "email_text, coalesce((SELECT string_agg(f.category || '|' || label || '|' || message, "
        "chr(10) ORDER BY ord) FROM findings f JOIN category USING (category) "
        "WHERE f.mail_id = s.mail_id), '') AS findings FROM scans s")
    inbox = (", inbox AS (SELECT conv_id * 1000 + turn AS mail_id, CASE WHEN turn % 2 = 0 THEN ' ' "
             "ELSE 'Dear member, act now: http://bit.ly/q' || chr(10) END || CASE WHEN turn % 5 = 4 "
             "THEN '  ' ELSE text END AS email_text FROM conversations), fresh AS (SELECT mail_id, "
             f"{strip('email_text')} AS email_text FROM inbox WHERE {strip('email_text')} <> '')")
    # Both tables go through one detection, the new mail with the numbers of its feed.
    both = with_(VALID, inbox, ", alls AS (SELECT mail_id, email_text FROM valid UNION ALL SELECT "
                 f"mail_id + {FEED_SPAN}, email_text FROM fresh)",
                 findings("alls"))
    out["append_scans"] = both + (
        "SELECT mail_id + 1 AS id, email_text, flags, score, risk_level, CASE WHEN mail_id <= "
        f"(SELECT max(mail_id) FROM valid) THEN {pick(X.NOTES, f'mail_id % {len(X.NOTES)}')} ELSE "
        "'' END AS note, strftime(CASE WHEN mail_id <= (SELECT max(mail_id) FROM valid) THEN "
        f"(SELECT e.ts FROM events e WHERE e.event_id = a.mail_id) ELSE TIMESTAMP '{X.AS_OF}' END, "
        "'%Y-%m-%d %H:%M') AS created_at, mail_id <= (SELECT max(mail_id) FROM valid) AND "
        "mail_id % 6 = 0 AS network_checked FROM scored a")
    on_mail = with_(MAIL, ", ", THREATS.strip(), urls("mail"), checks("mail"))
    out["threat_join"] = on_mail + "SELECT mail_id, url, threat, ord, message FROM threat_hits"
    valid_links = with_(VALID, ", ", THREATS.strip(), urls("valid"), checks("valid"))
    out["late_threats"] = valid_links + (
        "SELECT mail_id + 1 AS id, url, threat, ord, message FROM threat_hits")
    out["stream_late_threats"] = out["late_threats"]
    registry = values((str(i), q(b), q(b.title()), "[" + ", ".join(map(q, d)) + "]")
                      for i, (b, d) in enumerate(R.BRAND_DOMAINS.items()))
    letters = f"{q(''.join(_PLAIN))}, {q(''.join(_PLAIN.values()))}"
    out["registry_spoofing"] = with_(MAIL, urls("mail")) + f""",
registry(ord, brand, title, official) AS (
  VALUES {registry}
  UNION ALL SELECT doc_id + 100, b, upper(b[1]) || b[2:],
    CASE WHEN doc_id % 2 = 0 THEN ['webmail-upgrade' || doc_id || '.xyz'] ELSE [] END
  FROM (SELECT doc_id, translate('webmail-upgrade' || doc_id, {letters}) AS b FROM documents)),
named AS (
  SELECT DISTINCT mail_id, host, root, translate(split_part(root, '.', 1), {letters}) AS plain
  FROM url_facts)
SELECT mail_id, host, ord, CASE
    WHEN contains(host, brand) THEN {fill(R.MESSAGES['brand_in_host'], host='host', brand='title')}
    WHEN plain = brand THEN {fill(R.MESSAGES['misspelled'], root='root', brand='title')}
    ELSE {fill(R.MESSAGES['typo_squat'], root='root', brand='title')} END AS message
FROM named JOIN registry ON contains(host, brand) OR plain = brand
  OR (length(brand) >= 5 AND abs(length(brand) - length(plain)) < 2 AND levenshtein(plain, brand) = 1)
WHERE NOT list_contains(official, root)"""
    out["domain_cap"] = on_mail + f"SELECT mail_id, pos, domain FROM domains WHERE pos <= {R.DOMAINS_PER_MAIL}"
    out["domain_age"] = on_mail + "SELECT mail_id, pos, domain, age_days, message FROM new_domains"
    out["check_links"] = on_mail + "SELECT mail_id, messages, points FROM link_checks"

    def merged(scans: str, note: str, at: str, *extra: str) -> str:
        total = "CASE WHEN network_checked THEN score ELSE score + coalesce(points, 0) END"
        return with_(VALID, ON_VALID, *extra, ", ", THREATS.strip(), checks("valid")) + (
            "SELECT id, email_text, CASE WHEN network_checked OR points IS NULL THEN flags "
            "WHEN flags = '' THEN messages ELSE flags || chr(10) || messages END AS flags, "
            f"({total})::INT AS score, {level(total)} AS risk_level, {note} AS note, "
            f"{at} AS created_at, true AS network_checked "
            f"FROM {scans} LEFT JOIN link_checks USING (mail_id)")

    out["merge_link_findings"] = merged("scans", "note", MINUTE, SCANS)
    out["merge_legacy"] = out["merge_link_findings"]
    out["kept_totals"] = with_(VALID, ON_VALID, SCANS, ", ", THREATS.strip(), checks("valid")) + f""",
left_over AS (
  SELECT CASE WHEN network_checked THEN score ELSE score + coalesce(points, 0) END AS score
  FROM scans LEFT JOIN link_checks USING (mail_id) WHERE id NOT IN (SELECT doc_id * 3 FROM documents))
SELECT coalesce(risk_level, 'all') AS risk_level, count(*) AS scans
FROM (SELECT {level("score")} AS risk_level FROM left_over) GROUP BY ROLLUP (risk_level)"""
    # Entries known at the time of the check give its findings their places; late ones change
    # what these say, and add findings for links that were not listed.
    out["merge_late_threats"] = with_(
        VALID, ON_VALID, SCANS, ", ", THREATS.strip(), checks("valid")) + f""",
early AS (
  SELECT url, min(ord) AS ord FROM threat_list
  WHERE url <> '' AND NOT ({X.LATE_ENTRY}) GROUP BY url),
notes AS (
  SELECT mail_id, CASE WHEN e.url IS NULL THEN 2 ELSE 0 END AS kind, coalesce(e.ord, h.ord) AS ord,
    message, {R.THREAT_POINTS} AS points FROM threat_hits h LEFT JOIN early e USING (url)
  UNION ALL SELECT mail_id, 1, pos, message, {R.NEW_DOMAIN_POINTS} FROM new_domains),
due AS (
  SELECT mail_id, string_agg(message, chr(10) ORDER BY kind, notes.ord) AS messages,
    sum(points)::INT AS points
  FROM notes JOIN scans USING (mail_id) WHERE kind = 2 OR NOT network_checked GROUP BY mail_id)
SELECT id, CASE WHEN points IS NULL THEN flags WHEN flags = '' THEN messages
    ELSE flags || chr(10) || messages END AS flags,
  (score + coalesce(points, 0))::INT AS score,
  {level("score + coalesce(points, 0)")} AS risk_level
FROM scans LEFT JOIN due USING (mail_id)"""
    edits = (", edits AS (SELECT (doc_id * 2 // 3) * 2 AS id, doc_id AS seq, CASE doc_id % 4 WHEN 0 "
             "THEN '' WHEN 1 THEN 'seen by ' || doc_id WHEN 2 THEN repeat('n', 2001) ELSE "
             "repeat('m', 2000) END AS note FROM documents)")
    edited = with_(VALID, ON_VALID, SCANS, edits)
    out["update_notes"] = edited + (
        "SELECT id, email_text, flags, score, risk_level, coalesce(n.note, s.note) AS note, "
        f"{MINUTE} AS created_at, network_checked FROM scans s LEFT JOIN (SELECT id, "
        "arg_max(note, seq) AS note FROM edits WHERE length(note) <= 2000 GROUP BY id) n USING (id)")
    out["rejected_notes"] = edited + (
        "SELECT id, seq, CASE WHEN s.id IS NULL THEN 'Scan not found' ELSE "
        f"{q(R.LONG_NOTE)} END AS error FROM edits LEFT JOIN scans s USING (id) "
        "WHERE s.id IS NULL OR length(edits.note) > 2000")
    out["delete_scans"] = s + (
        f"SELECT {SCAN_VIEW} FROM scans WHERE id NOT IN (SELECT doc_id * 3 FROM documents)")
    out["rewritten_notes"] = out["update_notes"]
    out["rewritten_deletes"] = out["delete_scans"]
    out["missing_deletes"] = s + (
        "SELECT DISTINCT doc_id * 3 AS id FROM documents WHERE doc_id * 3 NOT IN "
        "(SELECT id FROM scans)")
    out["evolve_schema"] = s + (
        f"SELECT id, email_text, flags, score, risk_level, note, {MINUTE} AS created_at, '[]' AS findings, "
        "0::INT AS network_checked FROM scans")
    # Rows whose stored JSON is unreadable or names no known category fall back to flags.
    out["legacy_findings"] = s + """
SELECT id, (CASE WHEN id % 7 < 4 THEN CASE WHEN flags = '' THEN 0 ELSE
    len(string_split(flags, chr(10))) END ELSE (SELECT count(*) FROM findings f
    WHERE f.mail_id = s.mail_id) END)::INT AS n_findings,
  CASE WHEN id % 7 < 4 AND flags = '' THEN ''
    WHEN id % 7 < 4 THEN 'legacy|informational|' || replace(flags, chr(10),
      '|' || chr(10) || 'legacy|informational|') || '|'
    ELSE coalesce((SELECT string_agg(rule || '|' || category || '|' || message || '|' || match,
      chr(10) ORDER BY ord) FROM findings f WHERE f.mail_id = s.mail_id), '') END AS findings
FROM scans s"""
    out["stream_scan"] = with_(VALID, ON_VALID) + (
        f"SELECT mail_id + 1 + {FEED_SPAN} AS id, email_text, flags, score, risk_level, '' AS note, "
        "'2024-02-01 00:00' AS created_at, false AS network_checked FROM scored")
    out["stream_resubmitted"] = out["stream_scan"]
    arrived = (f", arrived AS (SELECT mail_id + 1 + {FEED_SPAN} AS id, mail_id, email_text, flags, score, risk_level, "
               "false AS network_checked FROM scored)")
    out["stream_link_check"] = merged("arrived", "''", "'2024-02-01 00:00'", arrived)
    return out
