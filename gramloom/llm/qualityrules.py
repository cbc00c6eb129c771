"""Quality rules: a table of thresholds over measures of a text, compiled into one projection.

Measures are counts of words, characters, lines and repeated windows. A rule bounds a ratio of two of them, in
thousandths, so that it is compared in whole numbers. No user function takes part.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gramloom.llm.tables import table

SPACE = r"[\x20\x09-\x0D]"
SPACES = " \t\n\x0b\f\r"
WORD = r"[^\x20\x09-\x0D]"
SYMBOL = r"[#*$%&|<>]"
LETTER = r"\p{L}"
BULLET = r"^[\x20\x09-\x0D]*[-*•‣▪]"
ELLIPSIS = ("...", "…")
WINDOW = 8
# fixed values: frequent function words of each language
STOP_WORDS = {
    "en": "the of and to a in is that for was on with as it at by be this are from or an not have which".split(),
    "de": "der die und das den dem ist ein eine einer zu im mit auf für von sich nicht des es auch an als bei nach".split(),
    "fr": "le la les et de des du un une est que qui dans en pour sur au aux par pas ne se il elle plus".split(),
    "es": "el la los las y de del que en un una es por con para se no su al lo como más o ha".split(),
}


class Rule(NamedTuple):
    """1000 * `measure` must lie between `least` and `most` times `per`; None is no bound; `langs`: only texts of these languages or of none."""

    name: str
    measure: str
    per: str
    least: int | None
    most: int | None
    langs: tuple[str, ...] = ()


BASE_RULES = (
    Rule("few_words", "n_words", "one", 20_000, None),
    Rule("repeated_words", "n_repeat_words", "n_words", None, 300),
)
RULES = (
    *BASE_RULES,
    Rule("word_length", "word_chars", "n_words", 2_000, 40_000),
    Rule("symbols", "n_symbols", "n_words", None, 200),
    Rule("letters", "n_alpha_words", "n_words", 600, None),
    Rule("stop_words", "n_stop_words", "n_words", 10, None, tuple(STOP_WORDS)),
    Rule("same_lines", "n_dup_lines", "n_lines", None, 300),
    Rule("bullet_lines", "n_bullet_lines", "n_lines", None, 900),
    Rule("ellipsis_lines", "n_ellipsis_lines", "n_lines", None, 300),
)


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` of a value that is computed once, not at each use inside a lambda."""
    return F.transform(F.array(value), body)[0]


def _covered(found: Column) -> Column:
    """Words inside the windows that begin at the given places (sorted, distinct)."""
    steps = F.zip_with(found, F.slice(found, F.lit(2), F.size(found)), lambda a, b: F.least(F.lit(WINDOW), F.coalesce(b - a, F.lit(WINDOW))))
    return F.aggregate(steps, F.lit(0), lambda total, step: total + step)


def _repeated_places(words: Column) -> Column:
    """Sorted first places of the windows that occur twice or more: windows are sorted and compared with their neighbours."""
    windows = F.sort_array(F.transform(F.sequence(F.lit(1), F.size(words) - (WINDOW - 1)), lambda i: F.struct(F.slice(words, i, F.lit(WINDOW)).alias("w"), i.alias("at"))))

    def twice(sorted_windows: Column) -> Column:
        def same(w: Column, i: Column) -> Column:
            return F.coalesce(F.get(sorted_windows, i - 1)["w"] == w["w"], F.lit(False)) | F.coalesce(F.get(sorted_windows, i + 1)["w"] == w["w"], F.lit(False))

        return F.sort_array(F.transform(F.filter(sorted_windows, same), lambda w: w["at"]))

    return _let(windows, twice)


def _repeat_words(words: Column) -> Column:
    """Words in windows found twice or more. Hashes of windows tell the texts that have none, which are nearly all."""

    def joined(step: int) -> Callable[[Column], Column]:
        """Hashes of up to four values each, `step` places apart; at the end of a text they are of fewer words, which may only look like repeats."""
        return lambda h: F.transform(h, lambda x, i: F.xxhash64(x, *[F.get(h, i + k * step) for k in range(1, 4 if step == 1 else 2)]))

    hashes = F.transform(words, lambda w: F.xxhash64(w))
    for step in (1, 4):
        hashes = _let(hashes, joined(step))
    repeats = _let(hashes, lambda h: F.size(F.array_distinct(h)) < F.size(h))
    exact = _let(words, lambda w: _let(_repeated_places(w), _covered))
    return F.when(F.size(words) <= WINDOW, 0).when(repeats, exact).otherwise(0)


def measures(stop_words: Sequence[str] | None = None) -> dict[str, Column]:
    """Columns by name over columns `_text`, `_words` and `_lines`: counts of a text, all bigint."""
    stops = sorted({w for ws in STOP_WORDS.values() for w in ws} if stop_words is None else set(stop_words))
    words, lines, whole = F.col("_words"), F.col("_lines"), F.col("_text")
    found = {
        "one": F.lit(1),
        "n_chars": F.length(whole),
        "n_words": F.size(words),
        "word_chars": F.length(F.array_join(words, "")),
        "n_symbols": F.length(whole) - F.length(F.regexp_replace(whole, F.lit(SYMBOL), F.lit(""))),
        "n_alpha_words": F.size(F.filter(words, lambda w: w.rlike(LETTER))),
        "n_stop_words": F.size(F.filter(words, lambda w: F.lower(w).isin(stops))),
        "n_repeat_words": _repeat_words(words),
        "n_lines": F.size(lines),
        "n_dup_lines": F.size(lines) - F.size(F.array_distinct(lines)),
        "n_bullet_lines": F.size(F.filter(lines, lambda x: x.rlike(BULLET))),
        "n_ellipsis_lines": F.size(F.filter(lines, lambda x: F.rtrim(x, F.lit(SPACES)).endswith(ELLIPSIS[0]) | F.rtrim(x, F.lit(SPACES)).endswith(ELLIPSIS[1]))),
    }
    return {name: c.cast("bigint") for name, c in found.items()}


def _broken(rule: Rule, lang: str | None) -> Column:
    value, per = F.col(f"_m_{rule.measure}") * 1000, F.col(f"_m_{rule.per}")
    out = F.lit(False)
    if rule.least is not None:
        out = out | (value < per * rule.least)
    if rule.most is not None:
        out = out | (value > per * rule.most)
    if rule.langs and lang is not None:
        out = out & (F.col(lang).isNull() | F.col(lang).isin(*rule.langs))
    return out


def judge(docs: DataFrame, rules: Sequence[Rule] = RULES, text: str = "text", lang: str | None = None, stop_words: Sequence[str] | None = None) -> DataFrame:
    """All columns with `quality`: a struct of all measures, `failed` (names of broken rules, in table order) and `kept`.

    Words are runs of characters other than ASCII white space; lines are cut at line feeds, and only lines with a word
    count. Null counts as an empty text: no words, so it breaks a rule that asks for some. Ratios to nothing break no
    upper bound but by a measure above 0. Rows stay where they are; repeated rows are judged each by itself. A column
    of the name `quality` is replaced.
    """
    unknown = {n for r in rules for n in (r.measure, r.per)} - set(measures())
    if unknown:
        raise ValueError(f"no such measures: {sorted(unknown)}")
    carry = [c for c in docs.columns if c != "quality"]
    rest = [F.col(f"_row.`{c}`").alias(c) for c in carry]
    source = docs.select(F.struct(*[F.col(f"`{c}`") for c in carry]).alias("_row"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("_text"))
    trimmed = F.btrim("_text", F.lit(SPACES))
    split = source.select("_row", "_text", F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, f"{SPACE}+")).alias("_words"),
                          F.filter(F.split("_text", "\n"), lambda x: x.rlike(WORD)).alias("_lines"))
    # columns, not a struct: fields of a struct would be computed again at each use
    counted = split.select("_row", *[c.alias(f"_m_{n}") for n, c in measures(stop_words).items()])
    names = F.array_compact(F.array(*[F.when(_broken(r, f"_row.`{lang}`" if lang else None), F.lit(r.name)) for r in rules])) if rules else F.array().cast("array<string>")
    judged = counted.select("*", names.alias("_failed"))
    fields = [F.col(f"_m_{n}").alias(n) for n in measures() if n != "one"]
    return judged.select(*rest, F.struct(*fields, F.col("_failed").alias("failed"), (F.size("_failed") == 0).alias("kept")).alias("quality"))


def op12_quality_rules(spark, sf_dir):
    """Base rules and the table's own verdict for every whole text."""
    q = judge(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"), lang="lang")
    base = F.lit(False)
    for rule in BASE_RULES:
        base = base | F.array_contains("quality.failed", rule.name)
    counts = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_alpha_words", "n_stop_words"]
    return q.select("doc_id", *[F.col(f"quality.{c}").alias(c) for c in counts], base.alias("base_failed"), F.col("quality.kept").alias("kept"),
                    F.array_join("quality.failed", ",").alias("failed"))


def _sql() -> str:
    def broken(r: Rule) -> str:
        bounds = [f"1000 * {r.measure} {sign} {bound} * {r.per}" for sign, bound in (("<", r.least), (">", r.most)) if bound is not None]
        where = f" AND (lang IS NULL OR lang IN ({', '.join(repr(x) for x in r.langs)}))" if r.langs else ""
        return f"(({' OR '.join(bounds)}){where})"

    stops = ", ".join(f"'{w}'" for w in sorted({w for ws in STOP_WORDS.values() for w in ws}))
    failed = ", ".join(f"CASE WHEN {broken(r)} THEN '{r.name}' END" for r in RULES)
    return f"""
WITH d AS (
  SELECT row_number() OVER () AS row, doc_id, lang, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{WORD}+') AS words,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '{WORD}')) AS lines
  FROM documents
), places AS (
  SELECT row, unnest(range(1, greatest(len(words) - {WINDOW - 2}, 1))) AS pos, words FROM d
), windows AS (
  SELECT row, pos, array_to_string(list_slice(words, pos, pos + {WINDOW - 1}), ' ') AS w FROM places
), twice AS (
  SELECT row, pos FROM (SELECT row, pos, count(*) OVER (PARTITION BY row, w) AS n FROM windows) WHERE n > 1
), covered AS (
  SELECT row, count(DISTINCT word) AS n FROM (SELECT row, unnest(range(pos, pos + {WINDOW})) AS word FROM twice) GROUP BY row
), m AS (
  SELECT doc_id, lang, 1 AS one, len(words) AS n_words, length(array_to_string(words, '')) AS word_chars,
         length(t) - length(regexp_replace(t, '{SYMBOL}', '', 'g')) AS n_symbols,
         len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(covered.n, 0) AS n_repeat_words, len(lines) AS n_lines,
         len(list_filter(words, lambda w: regexp_matches(w, '{LETTER}'))) AS n_alpha_words,
         len(list_filter(words, lambda w: lower(w) IN ({stops}))) AS n_stop_words,
         len(list_filter(lines, lambda x: regexp_matches(x, '{BULLET}'))) AS n_bullet_lines,
         len(list_filter(lines, lambda x: regexp_matches(x, '({'|'.join(re.escape(e) for e in ELLIPSIS)}){SPACE}*$'))) AS n_ellipsis_lines
  FROM d LEFT JOIN covered USING (row)
)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols,
       CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words, CAST(n_lines AS BIGINT) AS n_lines,
       CAST(n_alpha_words AS BIGINT) AS n_alpha_words, CAST(n_stop_words AS BIGINT) AS n_stop_words,
       (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AS base_failed, NOT ({' OR '.join(broken(r) for r in RULES)}) AS kept,
       array_to_string(list_filter([{failed}], lambda x: x IS NOT NULL), ',') AS failed
FROM m"""


SQL = _sql()
