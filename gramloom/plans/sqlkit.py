"""Pieces of DuckDB SQL shared by the twins. They are written for that engine, not derived from the jobs."""

from gramloom.functions.text import ACCENTED, DIGIT_WORDS, UNACCENTED

W = r"[\p{L}\p{N}_]"


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def clean(c: str) -> str:
    text = f"lower(' ' || {c} || ' ')"
    for digit, word in DIGIT_WORDS.items():
        text = f"replace({text}, '{digit}', ' {word} ')"
    return f"regexp_replace({text}, '[^a-z]+', ' ', 'g')"


def words(c: str) -> str:
    """Accent-free lower-case words of two or more characters."""
    plain = f"regexp_replace(translate(lower({c}), {q(ACCENTED)}, {q(UNACCENTED)}), '\\p{{Mn}}+', '', 'g')"
    return f"regexp_extract_all({plain}, '{W}{{2,}}')"


def grams(c: str, n: int) -> str:
    """Overlapping n-grams: runs of n characters from each of the n starting offsets."""
    parts = [f"regexp_extract_all(substr(g, {k + 1}), '(?s).{{{n}}}')" for k in range(n)]
    return "list_transform([replace(" + c + ", ' ', '_')], lambda g: list_concat(" + ", ".join(parts) + "))[1]"


def gram_range(c: str, lo: int, hi: int) -> str:
    return "list_concat(" + ", ".join(grams(c, n) for n in range(lo, hi + 1)) + ")" if hi > lo else grams(c, lo)


def term_counts(tokens: str, source: str = "documents") -> str:
    """CTE body: token, tf, df."""
    return (
        "SELECT token, CAST(sum(n) AS BIGINT) AS tf, count(*) AS df FROM ("
        f"SELECT doc_id, token, count(*) AS n FROM (SELECT doc_id, unnest({tokens}) AS token FROM {source}) GROUP BY 1, 2"
        ") GROUP BY 1"
    )
