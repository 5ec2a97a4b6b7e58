"""Quality rules, line first. DataFrame functions only.

Every line is judged by itself; lines that fail go, and a document is rejected if too little of its
text is left. A line with a word fails if it is

- navigation: three or more ``|``, or three or more of ``» › •``,
- marked all over: three or more words that end in doubled ``! # * $ % &``,
- boilerplate: a short line with one of the phrases of BOILERPLATE, or with braces of code,
- without punctuation: four words or more and no sentence mark (``. ! ? …`` or the wide forms).

Before that, a document fails the base rules if it has under ``min_words`` words, or if more than
``max_repeat`` percent of its words lie in 8-word windows that occur twice or more.

NULL and empty texts have no words and fail the base rules. Every row is judged by itself, so ids may
repeat or be NULL; other columns are not looked at; an empty table gives no rows.

A very long text is judged whole, as one row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import plain
from .line_dedup import let

SPACES = r"[\x20\x09-\x0D]+"
NAVIGATION = r"(\|[^|]*\|[^|]*\|)|([»›•][^»›•]*[»›•][^»›•]*[»›•])"
MARKED = r"[!#*$%&]{2}([\x20\x09-\x0D].*)?[\x20\x09-\x0D]\S*[!#*$%&]{2}[\x20\x09-\x0D](.*[\x20\x09-\x0D])?\S*[!#*$%&]{2}"
BOILERPLATE = (
    r"cookie policy|privacy policy|terms of (use|service)|all rights reserved|lorem ipsum|enable javascript"
    r"|click here|sign up for|subscribe to our|share (this )?on|log ?in to|back to top|skip to (main )?content"
)
CODE = r"[{}]\s*$"
SENTENCE = "[.!?…。！？]"
WINDOW = 8


def _repeat_words(n: Column, hashes: Column) -> Column:
    """Words covered by windows whose hash occurs twice or more; ``hashes`` are of the words."""

    def covered(windows: Column) -> Column:
        pairs = F.array_sort(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def starts(s: Column) -> Column:
            same = lambda x, i, d: F.coalesce(F.get(s, i + d)["h"] == x["h"], F.lit(False))
            marked = F.transform(s, lambda x, i: F.when(same(x, i, 1) | same(x, i, -1), x["i"]))
            return F.array_sort(F.filter(marked, lambda i: i.isNotNull()))

        def total(p: Column) -> Column:
            steps = F.transform(p, lambda x, i: F.least(F.lit(WINDOW), F.coalesce(F.get(p, i + 1) - x, F.lit(WINDOW))))
            return F.aggregate(steps, F.lit(0), lambda a, x: a + x)

        return F.when(F.size(F.array_distinct(windows)) == F.size(windows), F.lit(0)).otherwise(let(let(pairs, starts), total))

    def windows(h: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.size(h) - WINDOW), lambda i: F.xxhash64(*(F.get(h, i + k) for k in range(WINDOW))))

    return F.when(n <= WINDOW, F.lit(0)).otherwise(let(let(hashes, windows), covered))


def _line_fails(line: Column) -> Column:
    n = F.size(F.split(F.btrim(line, F.lit(" \t\n\x0b\f\r")), SPACES))
    return (
        line.rlike(NAVIGATION)
        | (line.rlike("[!#*$%&]{2}") & line.rlike(MARKED))
        | ((F.length(line) <= 200) & (F.lower(line).rlike(BOILERPLATE) | line.rlike(CODE)))
        | (~line.rlike(SENTENCE) & (n >= 4))
    )


def line_quality(docs: DataFrame, *, min_words: int = 20, max_repeat: int = 30, min_kept: float = 0.5) -> DataFrame:
    """Per row: doc_id, cleaned (the text without failed lines), the counts, base_failed and kept."""
    base = plain(docs, "doc_id", "text").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    cut = base.select(
        "doc_id", "text",
        F.filter(F.split("text", SPACES), lambda w: w != "").alias("words"),
        F.split("text", "\n").alias("lines"),
    )
    has_word = lambda line: F.btrim(line, F.lit(" \t\n\x0b\f\r")) != ""
    measured = cut.select(
        "doc_id", "lines",
        F.size("words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        F.length(F.regexp_replace("text", "[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        let(F.filter("lines", has_word), lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
        _repeat_words(F.size("words"), F.transform("words", lambda w: F.xxhash64(w))).cast("long").alias("n_repeat_words"),
        F.filter("lines", lambda x: ~has_word(x) | ~_line_fails(x)).alias("good"),
    )
    chars = lambda c: F.aggregate(F.filter(c, has_word), F.lit(0), lambda a, x: a + F.length(x))
    judged = measured.select(
        "*",
        ((F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat * F.col("n_words"))).alias("base_failed"),
        chars("good").alias("good_chars"), chars("lines").alias("all_chars"),
    )
    return judged.select(
        "doc_id", F.array_join("good", "\n").alias("cleaned"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (~F.col("base_failed") & (F.col("good_chars") >= min_kept * F.col("all_chars"))).alias("kept"),
    )


SQL = rf"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text, string_split(coalesce(text, ''), chr(10)) AS lines,
         list_filter(regexp_split_to_array(coalesce(text, ''), '{SPACES}'), lambda x: x <> '') AS ws
  FROM documents),
g AS (SELECT doc_id, p, list_slice(ws, p, p + 7) AS g FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 6)) AS p FROM d)),
r AS (SELECT doc_id, p FROM g QUALIFY count(*) OVER (PARTITION BY doc_id, g) >= 2),
c AS (SELECT doc_id, sum(least(8, coalesce(nxt - p, 8))) AS n
      FROM (SELECT doc_id, p, lead(p) OVER (PARTITION BY doc_id ORDER BY p) AS nxt FROM r) GROUP BY doc_id),
l AS (SELECT doc_id, line, len(line) AS chars,
        regexp_matches(line, '{NAVIGATION}') OR regexp_matches(line, '{MARKED}')
        OR (len(line) <= 200 AND (regexp_matches(lower(line), '{BOILERPLATE}') OR regexp_matches(line, '{CODE}')))
        OR (NOT regexp_matches(line, '{SENTENCE}') AND len(list_filter(regexp_split_to_array(line, '{SPACES}'), lambda x: x <> '')) >= 4) AS bad
      FROM (SELECT doc_id, unnest(lines) AS line FROM d)
      WHERE regexp_replace(line, '{SPACES}', '', 'g') <> ''),
s AS (SELECT doc_id, count(*) - count(DISTINCT line) AS dup, sum(chars) AS total, coalesce(sum(chars) FILTER (WHERE NOT bad), 0) AS good
      FROM l GROUP BY doc_id),
m AS (SELECT doc_id, len(ws)::BIGINT AS n_words, len(array_to_string(ws, ''))::BIGINT AS word_chars,
        len(regexp_replace(text, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols,
        coalesce(s.dup, 0)::BIGINT AS n_dup_lines, coalesce(c.n, 0)::BIGINT AS n_repeat_words,
        coalesce(s.total, 0) AS total, coalesce(s.good, 0) AS good
      FROM d LEFT JOIN s USING (doc_id) LEFT JOIN c USING (doc_id)),
b AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND good >= 0.5 * total AS kept
FROM b
"""
