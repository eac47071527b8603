"""URL parts as column expressions.

``parse_url`` is not used: it has no host for names such as ``a_b.com`` and
fails on a stray bracket, while pasted mail is full of both.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from baitwatch.functions.text import SPACE
from baitwatch.registry import CONFUSABLES, CREDENTIAL_PATH_WORDS, LOOKALIKES

_STOP = SPACE + r"<>\"')"
URL_PATTERN = rf"(?iu)https?://[^{_STOP}]+|www\.[^{_STOP}]+"
IP_URL_PATTERN = r"https?://(?:\p{Nd}{1,3}\.){3}\p{Nd}{1,3}"

# A quote ends the path here, a closing bracket does not. The first slash after
# the host leaves the longest rest, so looking behind that one is enough.
_PATH_STOP = SPACE + r"<>\"'"
CREDENTIAL_PATH_PATTERN = (
    rf"(?iu)https?://[^/{_PATH_STOP}]*+/[^{_PATH_STOP}]*?(?:"
    + "|".join(CREDENTIAL_PATH_WORDS) + ")"
)

# Characters whose compatibility form holds one of / ? # @ :
_DELIMITER_LIKE = (
    r"⁇-⁉℀℁℅℆⩴︓︖﹕﹖﹟﹫"
    r"＃／：？＠"
)
_BRACKETED_ADDRESS = r"^(?:.*@)?\[[0-9A-Fa-f:.]+\](?::.*)?$"


def extract_urls(text: Column, lower: Column | None = None) -> Column:
    """Every link in order of appearance, repeats kept."""
    lower = F.lower(text) if lower is None else lower
    return F.when(
        lower.contains("http") | lower.contains("www."),
        F.regexp_extract_all(text, F.lit(URL_PATTERN), F.lit(0)),
    ).otherwise(F.array().cast("array<string>"))


def _authority(url: Column) -> Column:
    """What stands between the scheme and the first ``/``, ``?`` or ``#``.

    A link without a lower-case scheme gets one in front. A malformed authority
    behind ``https://`` counts as empty.
    """
    secure = url.startswith("https://")
    rest = (
        F.when(secure, F.substr(url, F.lit(9)))
        .when(url.startswith("http://"), F.substr(url, F.lit(8)))
        .otherwise(url)
    )
    authority = F.regexp_extract(rest, r"^[^/?#]*", 0)
    malformed = authority.rlike(rf"[\[\]{_DELIMITER_LIKE}]") & ~authority.rlike(_BRACKETED_ADDRESS)
    return F.when(secure & malformed, F.lit("")).otherwise(authority)


def hostname(url: Column) -> Column:
    """Host in lower case without user info, port and one leading ``www.``"""
    after_user = F.substring_index(F.lower(_authority(url)), "@", -1)
    return F.regexp_replace(F.substring_index(after_user, ":", 1), r"^www\.", "")


def root_domain(host: Column) -> Column:
    """Last two labels; no public-suffix list."""
    return F.substring_index(host, ".", -2)


def top_level(host: Column) -> Column:
    return F.when(host.contains("."), F.substring_index(host, ".", -1)).otherwise(F.lit(""))


def has_userinfo(url: Column) -> Column:
    rest = F.regexp_replace(url, r"(?iu)^https?://", "")
    return F.regexp_extract(rest, r"^[^/?#]*", 0).contains("@")


def is_punycode(host: Column) -> Column:
    return host.rlike(r"(?:^|\.)xn--")


def has_confusable(value: Column) -> Column:
    return value.rlike("[" + "".join(CONFUSABLES) + "]")


def plain_letters(value: Column) -> Column:
    """Look-alike characters and digits replaced by the letters they resemble."""
    table = CONFUSABLES | LOOKALIKES
    return F.translate(value, "".join(table), "".join(table.values()))
