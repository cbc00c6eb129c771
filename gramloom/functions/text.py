"""Text clean-up as column expressions."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterable
from html.entities import name2codepoint

from pyspark.sql import Column
from pyspark.sql import functions as F

# ASCII white space, and the spelling of each digit.
SPACES = r"[ \t\n\r\f\x0B]+"
DIGIT_WORDS = {
    "0": "zero", "1": "one", "2": "two", "3": "three", "4": "four",
    "5": "five", "6": "six", "7": "seven", "8": "eight", "9": "nine",
}


def as_col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def squeeze(c: Column | str) -> Column:
    """Every run of white space becomes one space."""
    return F.regexp_replace(as_col(c), SPACES, " ")


def plain_alphabet(c: Column | str) -> Column:
    """Only a-z and single spaces remain; digits are spelled out; padded by one space each side."""
    text = F.lower(F.concat(F.lit(" "), as_col(c), F.lit(" ")))
    for digit, word in DIGIT_WORDS.items():
        text = F.replace(text, F.lit(digit), F.lit(f" {word} "))
    return F.regexp_replace(text, "[^a-z]+", " ")


# Fixed values of the established sentence form: characters that stay, clitics, marks set off, marks set off with a backslash.
SENTENCE_OTHERS, CLITICS, SET_OFF, BACKSLASHED = r"[^A-Za-z0-9(),!?'`]", r"('s|'ve|n't|'re|'d|'ll)", r"([,!])", r"([()?])"


def clean_sentence(c: Column | str) -> Column:
    """Sentence form: clitics and punctuation set off by spaces, lower case.

    Brackets and question marks keep the backslash that the established form of this
    normaliser puts before them, so vocabularies stay comparable.
    """
    text = F.regexp_replace(as_col(c), SENTENCE_OTHERS, " ")
    text = F.regexp_replace(text, CLITICS, " $1")
    text = F.regexp_replace(text, SET_OFF, " $1 ")
    text = F.regexp_replace(text, BACKSLASHED, r" \\$1 ")
    return F.lower(F.trim(F.regexp_replace(text, r"\s{2,}", " ")))


def _accent_pairs() -> tuple[str, str]:
    source, target = [], []
    for code in range(0x00C0, 0x2000):
        char = chr(code)
        base = "".join(x for x in unicodedata.normalize("NFKD", char) if not unicodedata.combining(x))
        if len(base) == 1 and base != char:
            source.append(char)
            target.append(base)
    return "".join(source), "".join(target)


ACCENTED, UNACCENTED = _accent_pairs()


def strip_accents(c: Column | str) -> Column:
    """Latin, Greek and Cyrillic letters lose their marks; loose combining marks go."""
    text = as_col(c)
    stripped = F.regexp_replace(F.translate(text, ACCENTED, UNACCENTED), r"\p{Mn}+", "")
    # plain ASCII, told by one byte per character, needs no look-up
    return F.when(F.octet_length(text) == F.length(text), text).otherwise(stripped)


def strip_tag(c: Column | str) -> Column:
    """Text between the sentence tags, or '' for an untagged line."""
    return F.regexp_extract(as_col(c), r"^\s*<s>\s*(.*?)\s*</s>", 1)


REFERENCE = r"&(?:#[0-9]{1,7}|#[xX][0-9A-Fa-f]{1,6}|[A-Za-z][A-Za-z0-9]{1,8});"


def _decode_reference(ref: Column, names: Column) -> Column:
    body = F.regexp_replace(ref, "^&#?[xX]?|;$", "")
    code = F.when(ref.rlike("^&#[xX]"), F.conv(body, 16, 10)).when(ref.rlike("^&#"), body).try_cast("bigint")
    valid = code.between(1, 0x10FFFF) & ~code.between(0xD800, 0xDFFF)
    # through UTF-32, so that every code point decodes, not only the first 256
    number = F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")
    named = F.try_element_at(names, F.regexp_replace(ref, "[&;]", ""))
    return F.coalesce(F.when(valid, number), named, ref)


def decode_entities(c: Column | str) -> Column:
    """Numeric and named character references become characters, in one pass; unknown ones stay."""
    text = as_col(c)
    names = F.create_map(*[F.lit(x) for name, code in name2codepoint.items() for x in (name, chr(code))])
    between = F.split(text, REFERENCE, -1)
    refs = F.regexp_extract_all(text, F.lit(f"({REFERENCE})"), F.lit(1))
    # one more piece than references: the last one is joined to an empty reference
    pieces = F.zip_with(between, refs, lambda p, r: F.concat(p, F.coalesce(_decode_reference(r, names), F.lit(""))))
    return F.when(F.instr(text, "&") > 0, F.array_join(pieces, "")).otherwise(text)


def join_text(cols: Iterable[str], sep: str = " ") -> Column:
    """Columns glued to one text, nulls skipped."""
    return F.concat_ws(sep, *[F.col(c) for c in cols])


def canonical_title(c: Column | str, namespaces: Iterable[str]) -> Column:
    """Page title in canonical form: spaces squeezed, namespace and title capitalised.

    A prefix counts as a namespace only when it is in `namespaces`.
    """
    title = F.trim(F.regexp_replace(as_col(c), r"[\s_]+", " "))
    prefix = F.regexp_extract(title, r"^([^:]*):", 1)
    name = F.trim(prefix)
    rest = F.ltrim(F.regexp_extract(title, r"^[^:]*:(.*)$", 1))
    known = F.lower(name).isin([n.lower() for n in namespaces])
    return (
        F.when((F.instr(title, ":") > 0) & known, F.concat(_capital(F.lower(name)), F.lit(":"), _capital(rest)))
        .otherwise(_capital(title))
    )


def _capital(c: Column) -> Column:
    return F.concat(F.upper(F.substring(c, 1, 1)), c.substr(F.lit(2), F.length(c)))


def title_key(c: Column | str) -> Column:
    """Letters, digits and underscores of the title, lower case."""
    return F.lower(F.regexp_replace(as_col(c), r"[^\p{L}\p{N}_]+", ""))


def title_bucket(key: Column | str) -> Column:
    """Folder of an article: first two characters of its key, one padded with '_'."""
    return F.rpad(F.substring(as_col(key), 1, 2), 2, "_")


def page_url(base: str, c: Column | str) -> Column:
    return F.concat(F.lit(f"{base}?curid="), as_col(c).cast("string"))
