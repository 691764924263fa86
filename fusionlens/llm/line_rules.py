"""Quality rules, line first (DataFrame functions only).

Every line with a word is judged on its own. Failing lines are removed:

* navigation: items of a few words between separators that stand alone
  ("Home > News | Contact"), or symbols for a large share of the words;
* punctuation: shouting marks for a large share of the words, or a line of
  several words without any sentence end in a text whose other lines mostly have one
  (a heading is short, a paragraph cut off in its last sentence stays, a text
  without end marks keeps its lines);
* boilerplate: phrases of page furniture, copyright notices with a year, lines
  that are an address or a counter alone ("12 comments");
* repeats of an earlier line.

A document that loses more than ``MAX_LOST_PERCENT`` of its word characters, or that
fails a base rule (too short, too repetitive), is rejected.

All work is per row inside the JVM: no shuffle, no Python. Windows of eight
words are compared by a 64-bit hash inside one document; a document of 20,000
words has a chance of about 1e-11 to count one window too many.

Edge cases: a NULL text is an empty text (no words, ``base_failed``); a NULL
id or any other NULL column is carried through; repeated rows give repeated
results; an empty table gives an empty result. Extra columns never clash,
because only the id and text columns are read unless ``carry`` names more.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Word and symbol classes, base rules, line rules.
WHITE = r"[\x20\x09-\x0D]+"
NOT_WHITE = r"[^\x20\x09-\x0D]"
SYMBOLS = r"[#*$%&|<>]"
SEPARATOR = r"[\x20\x09][|>»›•·][\x20\x09]"
END_MARK = r"""[.!?…。！？:;,"'”’»)\]|>*~-][\x20\x09-\x0D]*\z"""
SENTENCE_END = r"[.!?…。！？]"
SHOUT = r"!!"
WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
MIN_MARKS = 3           # a line needs so many marks before a share of them counts
SHARE_OF_WORDS = 4      # one mark for every 4 words fails a line
ITEM_WORDS = 3          # a navigation item has so many words at most, on average
OPEN_WORDS = 6          # so many words without an end mark are no heading
ENDED_PERCENT = 60      # of the lines end with a mark in prose
MAX_LOST_PERCENT = 30   # of a document's word characters
PHRASES = [
    "all rights reserved", "accept cookies", "cookie policy", "enable javascript", "lorem ipsum",
    "privacy policy", "terms of service", "terms of use", "subscribe to our newsletter",
    "sign in to continue", "click here to", "skip to content", "back to top", "powered by",
]
NOTICES = [
    r"(copyright|©|\(c\))[\x20\x09]*[0-9]{4}",
    r"^[\x20\x09]*(https?://|www\.)[^\x20\x09-\x0D]+[\x20\x09-\x0D]*\z",
    r"^[\x20\x09]*[0-9][0-9.,]*[\x20\x09]*(comments?|shares?|likes?|views?|replies|votes?)[\x20\x09-\x0D]*\z",
]
BOILERPLATE = "(?i)(" + "|".join(PHRASES + NOTICES) + ")"


def _words(text: Column) -> Column:
    return F.array_remove(F.split(text, WHITE), "")


def _marks(line: Column, pattern: str) -> Column:
    return F.regexp_count(line, F.lit(pattern))


def _ended(line: Column) -> Column:
    """Whether ``END_MARK`` matches, by the last character that is not white space."""
    return F.substring(F.rtrim(line, F.lit(" \t\x0b\x0c\r")), -1, 1).rlike(END_MARK)


def line_fails(line: Column, prose: Column) -> Column:
    """Navigation, punctuation and boilerplate rules for one line; ``prose``: most lines of the text have an end mark."""
    words = F.size(_words(line))
    items = _marks(line, SEPARATOR)

    def dense(pattern: str) -> Column:
        n = _marks(line, pattern)
        return (n >= MIN_MARKS) & (n * SHARE_OF_WORDS >= words)

    navigation = (items >= 1) & (words - items <= ITEM_WORDS * (items + 1))
    unfinished = prose & (words >= OPEN_WORDS) & ~_ended(line) & ~line.rlike(SENTENCE_END)
    return navigation | dense(SYMBOLS) | dense(SHOUT) | unfinished | line.rlike(BOILERPLATE)


def _repeat_words(words: Column) -> Column:
    """Words covered by windows that occur twice or more in ``words``."""
    hashes = F.transform(words, lambda w: F.xxhash64(w))

    def windows(h: Column) -> Column:
        return F.transform(F.sequence(F.lit(1), F.size(h) - (WINDOW - 1)),
                           lambda i: F.xxhash64(*[F.element_at(h, i + k) for k in range(WINDOW)]))

    def covered(win: Column) -> Column:
        ranked = F.array_sort(F.transform(win, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        starts = _let(ranked, lambda s: F.array_sort(F.filter(
            F.transform(s, lambda x, j: F.when(
                F.coalesce(F.get(s, j - 1)["h"] == x["h"], F.lit(False))
                | F.coalesce(F.get(s, j + 1)["h"] == x["h"], F.lit(False)), x["i"])),
            lambda i: i.isNotNull())))
        # a start covers up to the next start, at most a whole window
        return _let(starts, lambda p: F.aggregate(
            F.transform(p, lambda i, j: F.least(F.lit(WINDOW), F.coalesce(F.get(p, j + 1) - i, F.lit(WINDOW)))),
            F.lit(0), lambda a, x: a + x))

    counted = _let(hashes, lambda h: _let(windows(h), lambda win: F.when(
        F.size(F.array_distinct(win)) < F.size(win), covered(win)).otherwise(F.lit(0))))
    return F.when(F.size(words) >= WINDOW, counted).otherwise(F.lit(0))


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once for each row."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def apply_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                carry: list[str] | None = None) -> DataFrame:
    """One row per document: counts, ``base_failed``, ``kept``, ``clean_text``.

    ``clean_text`` is the text as it was if no line failed, else the lines
    that passed, joined by newlines. ``carry`` names input columns to return as
    they are, in the struct ``row``.
    """
    base = docs.select(
        docs[id_col].alias("doc_id"), F.coalesce(docs[text_col], F.lit("")).alias("_t"),
        *([F.struct(*[docs[c].alias(c) for c in carry]).alias("row")] if carry else []))
    base = base.withColumns({
        "_w": _words(F.col("_t")),
        "_l": F.filter(F.split("_t", "\n"), lambda x: x.rlike(NOT_WHITE)),
    }).withColumn("_u", F.array_distinct("_l"))
    base = base.withColumns({
        "n_words": F.size("_w").cast("long"),
        "word_chars": F.char_length(F.array_join("_w", "")).cast("long"),
        "n_symbols": _marks(F.col("_t"), SYMBOLS).cast("long"),
        "n_dup_lines": (F.size("_l") - F.size("_u")).cast("long"),
        "n_repeat_words": _repeat_words(F.col("_w")).cast("long"),
        # whether the text is prose is found once a text: a column of its own would be computed again for every line
        "_k": _let(F.size(F.filter("_l", _ended)) * 100 >= F.size("_l") * ENDED_PERCENT,
                   lambda prose: F.filter("_u", lambda x: ~line_fails(x, prose))),
    })
    left = F.char_length(F.array_join(F.flatten(F.transform("_k", _words)), ""))
    base = base.withColumns({
        "base_failed": (F.col("n_words") < MIN_WORDS)
        | (F.col("n_repeat_words") * 100 > F.col("n_words") * MAX_REPEAT_PERCENT),
        "_c": F.when(F.size("_k") == F.size("_l"), F.col("word_chars")).otherwise(left),
    })
    enough = F.col("_c") * 100 >= F.col("word_chars") * (100 - MAX_LOST_PERCENT)
    return base.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (~F.col("base_failed") & enough).alias("kept"),
        F.when(F.size("_k") == F.size("_l"), F.col("_t")).otherwise(F.array_join("_k", "\n")).alias("clean_text"),
        *(["row"] if carry else []))


def _sql_words(text: str) -> str:
    return f"list_filter(string_split_regex({text}, '{WHITE}'), lambda w: w <> '')"


def oracle() -> str:
    """The same verdicts in DuckDB SQL."""
    def dense(pattern: str) -> str:
        n = f"len(regexp_extract_all(l, '{pattern}'))"
        return f"({n} >= {MIN_MARKS} AND {n} * {SHARE_OF_WORDS} >= len({_sql_words('l')}))"

    def quoted(pattern: str) -> str:
        return pattern.replace("'", "''")

    items = f"len(regexp_extract_all(l, '{SEPARATOR}'))"
    navigation = f"({items} >= 1 AND len({_sql_words('l')}) - {items} <= {ITEM_WORDS} * ({items} + 1))"
    unfinished = f"(prose AND len({_sql_words('l')}) >= {OPEN_WORDS} AND NOT regexp_matches(l, '{quoted(END_MARK)}') "
    unfinished += f"AND NOT regexp_matches(l, '{SENTENCE_END}'))"

    return f"""
WITH base AS (
  SELECT doc_id, coalesce(text, '') AS t, {_sql_words("coalesce(text, '')")} AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)),
                     lambda l: regexp_matches(l, '{NOT_WHITE}')) AS ls, row_number() OVER () AS rid
  FROM documents),
win AS (
  SELECT rid, i, array_to_string(w[i:i + {WINDOW - 1}], ' ') AS g
  FROM (SELECT rid, w, unnest(range(1, len(w) - {WINDOW - 2})) AS i FROM base)),
hit AS (
  SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS c FROM win) WHERE c > 1),
cover AS (
  SELECT rid, sum(least({WINDOW}, coalesce(nxt - i, {WINDOW}))) AS n
  FROM (SELECT rid, i, lead(i) OVER (PARTITION BY rid ORDER BY i) AS nxt FROM hit) GROUP BY rid),
kept_lines AS (
  SELECT rid, sum(length(regexp_replace(l, '{WHITE}', '', 'g'))) AS c
  FROM (SELECT DISTINCT rid, l, prose FROM (
    SELECT rid, unnest(ls) AS l,
           len(list_filter(ls, lambda x: regexp_matches(x, '{quoted(END_MARK)}'))) * 100 >= len(ls) * {ENDED_PERCENT} AS prose
    FROM base))
  WHERE NOT ({navigation} OR {dense(SYMBOLS)} OR {dense(SHOUT)} OR {unfinished} OR regexp_matches(l, '{BOILERPLATE}'))
  GROUP BY rid),
counted AS (
  SELECT doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
         len(regexp_extract_all(t, '{SYMBOLS}'))::BIGINT AS n_symbols,
         (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines,
         coalesce(cover.n, 0)::BIGINT AS n_repeat_words, coalesce(kept_lines.c, 0) AS c
  FROM base LEFT JOIN cover USING (rid) LEFT JOIN kept_lines USING (rid))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       (n_words < {MIN_WORDS} OR n_repeat_words * 100 > n_words * {MAX_REPEAT_PERCENT}) AS base_failed,
       NOT (n_words < {MIN_WORDS} OR n_repeat_words * 100 > n_words * {MAX_REPEAT_PERCENT})
         AND c * 100 >= word_chars * {100 - MAX_LOST_PERCENT} AS kept
FROM counted"""
