"""Header block and address parts as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from baitwatch.functions.text import INLINE_SPACE, LINE_END, SPACES, java_pattern, strip
from baitwatch.registry import ADDRESS_PATTERN, HEADER_NAMES

_LINE_START = rf"(?:\A|(?<=[{LINE_END}])(?!(?<=\r)\n))"


def _header_line(names) -> str:
    return rf"[{INLINE_SPACE}]*(?:{'|'.join(names)})[{INLINE_SPACE}]*:"


# From the first line that is not a header on. White space before the block is
# dropped first, so blank lines in front of it do not count.
_AFTER_BLOCK = rf"(?isu){_LINE_START}(?!{_header_line(HEADER_NAMES)}[^{LINE_END}]).*\z"

# An address can only begin where a run of its characters begins, which keeps the
# search linear on long runs without an ``@``. Its labels are taken without going back
# (nothing follows them), so a very long domain needs no deep stack.
_ADDRESS = r"(?<![\p{L}\p{N}_.+-])" + java_pattern(ADDRESS_PATTERN, flags="") + "+"


def header_block(text: Column) -> Column:
    """The leading run of header lines, empty when the mail has none."""
    return F.regexp_replace(F.ltrim(text, F.lit(SPACES)), _AFTER_BLOCK, "")


def header_value(block: Column, name: str) -> Column:
    """Value of the first line with that name; NULL when there is none."""
    line = rf"(?iu){_LINE_START}{_header_line([name])}([^{LINE_END}]+)"
    return F.when(block.rlike(line), strip(F.regexp_extract(block, line, 1)))


def find_address(text: Column) -> Column:
    """First address in ``text`` as written, ``''`` when there is none."""
    return F.regexp_extract(text, _ADDRESS, 0)


def _last_brackets(value: Column) -> tuple[Column, Column]:
    """For ``name <address>``: what follows the last but one ``>``, and where ``<`` is in it.

    Plain string functions instead of a pattern, which would try every ``<`` of a line
    full of them.
    """
    inner = F.substring_index(F.substr(value, F.lit(1), F.length(value) - 1), ">", -1)
    return inner, F.when(value.endswith(">"), F.instr(inner, "<")).otherwise(0)


def display_name(value: Column) -> Column:
    """Name in front of ``<address>``, without quotes; ``''`` for a bare address."""
    value = strip(value)
    inner, opening = _last_brackets(value)
    before = F.substr(value, F.lit(1), F.length(value) - F.length(inner) + opening - 2)
    name = F.when(opening > 0, before).when(value.isNotNull(), F.lit(""))
    return strip(F.btrim(strip(name), F.lit('"')))


def address(value: Column) -> Column:
    """Lower-case address of a header value, ``''`` when there is none."""
    value = strip(value)
    inner, opening = _last_brackets(value)
    part = F.when(opening > 0, strip(F.substr(inner, opening + 1))).otherwise(value)
    return F.lower(find_address(part))


def address_domain(addr: Column) -> Column:
    return F.when(
        addr.contains("@"), F.lower(F.substring_index(addr, "@", -1))
    ).otherwise(F.lit(""))
