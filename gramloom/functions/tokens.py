"""Tokenisers and token-array helpers as column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from gramloom.functions.text import as_col, plain_alphabet, strip_accents

# Character classes of the tokenisers (regular-expression class bodies).
WORD = r"\p{L}\p{N}_"
TOKEN_CLASSES = {
    "alpha": r"\p{L}\p{Nl}\p{No}_",
    "nopunct": WORD,
    "all": WORD + r".,()\"&\\/!?:;'\-",
}
# Mode -> (class, mask digits, lower case)
WIKI_MODES = {
    "alpha": ("alpha", False, False),
    "alpha-lower": ("alpha", False, True),
    "all": ("all", True, False),
    "all-lower": ("all", True, True),
    "all-num": ("all", False, False),
    "all-lower-num": ("all", False, True),
    "nopunct": ("nopunct", True, False),
    "nopunct-lower": ("nopunct", True, True),
    "nopunct-num": ("nopunct", False, False),
    "nopunct-lower-num": ("nopunct", False, True),
}


def extract_all(c: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(c, F.lit(pattern), group)


def wiki_tokens(c: Column | str, mode: str) -> Column:
    """Token array of one of the ten named modes."""
    cls, mask, lower = WIKI_MODES[mode]
    text = as_col(c)
    if lower:
        text = F.lower(text)
    text = F.regexp_replace(F.translate(text, "_", " "), "''+", '"')
    if mask:
        # masking keeps every masked digit inside the class, so it may run before the split
        text = F.regexp_replace(F.translate(text, "#", " "), r"\p{Nd}", "#")
        return extract_all(text, f"[{TOKEN_CLASSES[cls]}#]+")
    return extract_all(text, f"[{TOKEN_CLASSES[cls]}]+")


def word_tokens(c: Column | str, pattern: str = f"[{WORD}]+", lower: bool = False) -> Column:
    text = as_col(c)
    return extract_all(F.lower(text) if lower else text, pattern)


def analyze(c: Column | str, preprocessor: Callable[[Column], Column] | None = None) -> Column:
    """Words of two or more characters; a preprocessor replaces accent stripping and lower-casing."""
    text = preprocessor(as_col(c)) if preprocessor else strip_accents(F.lower(as_col(c)))
    return extract_all(text, f"[{WORD}]{{2,}}")


def alpha_tokens(tokens: Column | str) -> Column:
    """Purely alphabetic tokens, lower case."""
    kept = F.filter(as_col(tokens), lambda t: t.rlike("^[A-Za-z]+$"))
    return F.transform(kept, F.lower)


def char_grams(c: Column | str, order: int) -> Column:
    """All overlapping character n-grams of one order; the space shows as '_'."""
    return extract_all(F.translate(as_col(c), " ", "_"), rf"(?s)(?=(.{{{order}}})).", 1)


def char_gram_range(c: Column | str, lo: int, hi: int) -> Column:
    """Grams of every order lo..hi, order by order."""
    arrays = [char_grams(c, n) for n in range(lo, hi + 1)]
    return arrays[0] if len(arrays) == 1 else F.concat(*arrays)


def char_grams_interleaved(c: Column | str, lo: int, hi: int) -> Column:
    """Grams of orders lo..hi by end position, shorter first.

    The grams that end at one place are the ends of the longest of them. Those are found in one pass over the text behind
    hi - lo more letters; at the first places only the grams without any of these letters count.
    """
    ahead = hi - lo

    def ends(gram: Column, longest: int) -> Column:
        return F.array(*[gram if n == hi else F.right(gram, F.lit(n)) for n in range(lo, longest + 1)])

    def placed(grams: Column) -> Column:
        none = F.array().cast("array<string>")
        first = [F.when(F.size(grams) > i, ends(F.get(grams, F.lit(i)), lo + i)).otherwise(none) for i in range(ahead)]
        rest = F.slice(grams, F.lit(ahead + 1), F.greatest(F.size(grams) - ahead, F.lit(0)))
        return F.concat(*first, F.flatten(F.transform(rest, lambda gram: ends(gram, hi))))

    if not ahead:
        return char_grams(c, lo)
    # the array of one value has the grams computed once
    return F.transform(F.array(char_grams(F.concat(F.lit("_" * ahead), as_col(c)), hi)), placed)[0]


def parse_order(arg: str) -> tuple[int, int]:
    """'3' -> (3, 3); '3,6' -> (3, 6)."""
    parts = [int(p) for p in arg.split(",")]
    if len(parts) not in (1, 2):
        raise ValueError(f"expected one or two orders, got {arg!r}")
    return parts[0], parts[-1]


def bounds(orders: int | tuple[int, int]) -> tuple[int, int]:
    """Least and largest order of one entry of a recipe."""
    return (orders, orders) if isinstance(orders, int) else orders


def recipe(orders: int | tuple[int, int] | list | None = None) -> Callable[[Column], Column]:
    """Preprocessor: clean text, or clean text turned into gram arrays.

    An int is one order, a tuple a range, a list several of either one after the other.
    """

    def run(c: Column) -> Column:
        text = plain_alphabet(c)
        if orders is None:
            return text
        if isinstance(orders, list):
            return F.concat(*[char_grams_interleaved(text, *bounds(o)) for o in orders])
        return char_grams_interleaved(text, *bounds(orders))

    return run


# The named gram presets.
PRESETS = {"c4": 4, "c5": 5, "c6": 6, "c35": (3, 5), "c45": (4, 5), "c36": (3, 6)}


def word_ngrams(tokens: Column | str, lo: int, hi: int) -> Column:
    """Word n-grams of sizes lo..hi, words joined by a space."""
    arr = as_col(tokens)

    def of(n: int) -> Column:
        if n == 1:
            return arr
        shifted = [F.slice(arr, F.lit(k + 1), F.greatest(F.size(arr) - (n - 1), F.lit(0))) for k in range(n)]
        zipped = shifted[0]
        for nxt in shifted[1:]:
            zipped = F.zip_with(zipped, nxt, lambda a, b: F.concat(a, F.lit(" "), b))
        return zipped

    parts = [of(n) for n in range(lo, hi + 1)]
    return parts[0] if len(parts) == 1 else F.concat(*parts)


def unique_tokens(c: Column | str) -> Column:
    return F.array_distinct(as_col(c))


def topic_overlap(c: Column | str, topics: list[str]) -> Column:
    return F.array_intersect(as_col(c), F.array(*[F.lit(t) for t in topics]))


def pad(c: Column | str, n: int | Column, value: str | int) -> Column:
    """Array cut or filled at the end to exactly n entries."""
    arr = as_col(c)
    size = F.lit(n) if isinstance(n, int) else n
    filler = F.array_repeat(F.lit(value), F.greatest(size - F.size(arr), F.lit(0)))
    return F.concat(F.slice(arr, F.lit(1), size), filler)


# The character alphabets of the id encoder.
ALPHABET = "abcdefghijklmnopqrstuvwxyz0123456789-,;.!?:\"'/\\|_@#$%ˆ&* ̃‘+-=<>()[]{}\n\t "
LARGE_ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZ" + ALPHABET


def char_ids(c: Column | str, alphabet: str = ALPHABET, length: int = 1014, pad_id: int | None = None) -> Column:
    """Ids of the first `length` characters, padded with the id of the space unless told otherwise.

    A character's id is its first place in the alphabet; all others share the id len(alphabet).
    """
    ids: dict[str, int] = {}
    for place, char in enumerate(alphabet):
        ids.setdefault(char, place)
    table = F.create_map(*[F.lit(x) for pair in ids.items() for x in pair])
    chars = extract_all(F.substring(as_col(c), 1, length), "(?s).")
    known = F.transform(chars, lambda ch: F.coalesce(F.try_element_at(table, ch), F.lit(len(alphabet))))
    return pad(known, length, ids[" "] if pad_id is None else pad_id)


def explode_tokens(df, tokens: Column, *keys: str, pos: bool = False):
    """Long form: one row per token, with its position when asked for."""
    if pos:
        return df.select(*keys, F.posexplode(tokens).alias("pos", "token"))
    return df.select(*keys, F.explode(tokens).alias("token"))
