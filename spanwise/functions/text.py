"""Text measures and patterns. Offsets count code points, as Spark's length and substring do."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

BYTES_PER_TOKEN = 3

# White space that ends a sentence (and makes an input blank), and white space between words.
BLANK_CLASS = "".join(map(chr, (0x9, 0xA, 0xB, 0xC, 0xD, 0x20, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000, 0xFEFF)))
WORD_SPACE = "".join(map(chr, (0x20, 0x9, 0xA, 0xB, 0xC, 0xD, 0x3000)))
#: Quotes and brackets that may follow a sentence's end.
CLOSERS = "\"'" + chr(0x201D) + chr(0x2019) + ")\\]"
_WIDE_ENDS = chr(0x3002) + chr(0xFF01) + chr(0xFF1F)
#: What ends a sentence, for RE2, which has no possessive quantifiers.
BREAK = rf"\n+|[.!?]+[{CLOSERS}]*[{BLANK_CLASS}]+|[{_WIDE_ENDS}]+[{CLOSERS}]*[{BLANK_CLASS}]*"
#: The same ends for Python and Java, in time that grows with the text alone: a run of marks is tried from its start, once.
#: What follows a run is the same wherever in it a match begins, so no match is lost.
ENDING = rf"\n++|(?<![.!?])[.!?]++[{CLOSERS}]*+[{BLANK_CLASS}]++|[{_WIDE_ENDS}]++[{CLOSERS}]*+[{BLANK_CLASS}]*+"
#: A sentence with what ends it, or the text's last one, for RE2 and for Java.
SENTENCE_RE2 = rf"[\s\S]*?(?:{BREAK})|[\s\S]+\z"
SENTENCE = rf"[\s\S]*?(?:{ENDING})|[\s\S]+\z"
#: A word and the spaces after it, or leading spaces.
ATOM = f"[^{WORD_SPACE}]*[{WORD_SPACE}]+|[^{WORD_SPACE}]+"


def let(value: Column, body) -> Column:
    """``body(value)``, with ``value`` computed once however often ``body`` uses it, lambdas included."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def token_count(text: str) -> int:
    return math.ceil(len(text.encode("utf-8", "surrogatepass")) / BYTES_PER_TOKEN)


def estimate_tokens(text: Column) -> Column:
    """UTF-8 bytes by three, rounded up."""
    return F.ceil(F.octet_length(text) / BYTES_PER_TOKEN).cast("long")


def nonblank(text: Column) -> Column:
    return F.coalesce(text.rlike(f"[^{BLANK_CLASS}]"), F.lit(False))


def size_gate(text: Column, max_tokens: int) -> Column:
    """The message for an input over the limit; null for others."""
    tokens = estimate_tokens(text)
    said = F.concat(F.lit("The input is about "), F.format_number(tokens, 0), F.lit(f" tokens, over the limit of {max_tokens:,}. Split it, or raise max_input_tokens."))
    return F.when(tokens > max_tokens, said)


def sentences(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(SENTENCE), 0)


def utf16_offset(text: Column, offset: Column) -> Column:
    """A code point offset as UTF-16 units: one more for each character beyond the basic plane before it."""
    before = F.substring(text, F.lit(1), offset)
    return offset + F.length(F.regexp_replace(before, r"[^\x{10000}-\x{10FFFF}]", ""))
