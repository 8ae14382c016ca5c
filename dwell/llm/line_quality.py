"""Operator 3: quality rules with cross-document line frequency, in DataFrame functions only.

Base rules judge a text alone: too few words, or too many words inside three-word windows that
repeat in the text.  The cross-document rule counts, per host, the distinct documents that hold
each normalised line.  A line in more documents than the host's limit is boilerplate and is removed
from the text; a document whose words are mostly in removed lines is rejected.  The limit of a host is
``min_docs`` or ``max_share`` of its documents, whichever is greater, so one rule serves a host of
fifty documents and one that holds a third of the corpus.

Lines are compared by a 64-bit hash.  A host's frequent lines are summed before the shuffle, and
the join that marks them is a plain equi-join, which adaptive execution splits when a line is hot.

Defined results: a null or empty text has no words and fails the base rules; a null host is a host
of its own; a document id that occurs in several rows counts once per line, and rows of equal id,
text and host get equal results; blank lines are never boilerplate; an empty table gives no rows;
other columns are not read by ``judge`` and ``clean`` and pass through ``remove_lines``, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dwell.llm import common

#: Fixed values of the rules.
SYMBOLS = "#*$%&|<>"
MIN_WORDS, MAX_REPEAT_PERCENT, WINDOW = 50, 50, 3
#: Parameters: a line is boilerplate beyond the greater of both; least percent of words to keep.
MIN_DOCS, MAX_SHARE, MIN_KEPT_PERCENT = 20, 0.02, 50
#: Up to so many repeated windows are looked up in a list, more by sorting.
SHORT_LIST = 48

SPACES = " \t\n\x0b\x0c\r"


def _words(text: Column) -> Column:
    return F.array_remove(F.split(text, common.SEPARATORS), "")


def _normal(line: Column) -> Column:
    """Case and the length of white space do not tell lines apart."""
    return F.btrim(F.regexp_replace(F.lower(line), common.SEPARATORS, " "))


def text_measures(docs: DataFrame) -> DataFrame:
    """``docs`` with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and base_failed."""
    text = F.coalesce("text", F.lit(""))
    out = docs.withColumn("_words", _words(text))
    long_ = lambda c: c.cast("long")
    lines = F.filter(F.split(text, "\n", -1), lambda x: F.translate(x, SPACES, "") != "")
    out = (out.withColumn("_lines", lines)
           .withColumn("n_words", long_(F.size("_words")))
           .withColumn("word_chars", long_(F.char_length(F.translate(text, SPACES, ""))))
           .withColumn("n_symbols", long_(F.char_length(text) - F.char_length(F.translate(text, SYMBOLS, ""))))
           .withColumn("n_dup_lines", long_(F.size("_lines") - F.size(F.array_distinct("_lines"))))
           .drop("_lines"))
    hashes = F.transform("_words", lambda x, i: F.xxhash64(x, F.get("_words", i + 1), F.get("_words", i + 2)))
    out = out.withColumn("_hashes", F.when(F.col("n_words") >= WINDOW, F.slice(hashes, 1, F.greatest(F.col("n_words") - (WINDOW - 1), F.lit(1)).cast("int")))
                         .otherwise(F.array().cast("array<bigint>"))).drop("_words")
    ordered = F.sort_array("_hashes")
    out = out.withColumn("_sorted", F.when(F.size(F.array_distinct("_hashes")) < F.size("_hashes"), ordered))
    twice = F.array_distinct(F.filter("_sorted", lambda x, i: x == F.get("_sorted", i + 1)))
    out = out.withColumn("_twice", twice).drop("_sorted")
    by_list = F.filter(F.transform("_hashes", lambda x, i: F.when(F.array_contains("_twice", x), i)), lambda i: i.isNotNull())
    pairs = F.sort_array(F.transform("_hashes", lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
    out = out.withColumn("_pairs", F.when(F.size("_twice") > SHORT_LIST, pairs))
    by_sort = F.sort_array(F.transform(F.filter("_pairs", lambda p, k: (
        (p["h"] == F.get("_pairs", k + 1)["h"]) & (k + 1 < F.size("_pairs"))) | ((k > 0) & (p["h"] == F.get("_pairs", F.greatest(k - 1, F.lit(0)))["h"]))),
        lambda p: p["i"]))
    out = out.withColumn("_at", F.when(F.col("_twice").isNull(), F.array().cast("array<int>"))
                         .when(F.size("_twice") > SHORT_LIST, by_sort).otherwise(by_list)).drop("_hashes", "_twice", "_pairs")
    covered = F.transform("_at", lambda x, k: F.when(k == 0, F.lit(WINDOW)).otherwise(F.least(F.lit(WINDOW), x - F.get("_at", F.greatest(k - 1, F.lit(0))))))
    out = out.withColumn("n_repeat_words", F.aggregate(covered, F.lit(0).cast("long"), lambda a, x: a + x)).drop("_at")
    return out.withColumn("base_failed", (F.col("n_words") < MIN_WORDS)
                          | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words")))


def _host() -> Column:
    return F.coalesce("source", F.lit("\x00"))


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_rows(docs: DataFrame) -> DataFrame:
    """One row per line with a word: host, line hash, its place in the text, and the document's row key."""
    rows = docs.select("doc_id", _host().alias("host"), common.row_key("doc_id", "text").alias("row"),
                       F.posexplode(_lines(F.col("text"))).alias("place", "line"))
    return (rows.withColumn("line", _normal(F.col("line"))).where("line <> ''")
            .select("doc_id", "host", "row", "place", F.xxhash64("line").alias("line")))


def boilerplate_places(docs: DataFrame, min_docs: int = MIN_DOCS, max_share: float = MAX_SHARE) -> DataFrame:
    """Per host and row key that has a boilerplate line: the places of such lines in the text, sorted."""
    lines = common.materialise(line_rows(docs), "lines")
    held = lines.groupBy("host", "line", "doc_id").agg(F.lit(1).alias("one")).groupBy("host", "line").agg(F.count("*").alias("in_docs"))
    hosts = (docs.select(_host().alias("host"), "doc_id").groupBy("host", "doc_id").agg(F.lit(1).alias("one"))
             .groupBy("host").agg(F.count("*").alias("host_docs")))
    limit = F.greatest(F.lit(min_docs), F.floor(F.col("host_docs") * max_share))
    # only lines beyond the fixed part of the limit reach the join with the hosts
    frequent = held.where(F.col("in_docs") > min_docs).join(hosts, "host").where(F.col("in_docs") > limit).select("host", "line")
    return lines.join(frequent, ["host", "line"]).groupBy("host", "row").agg(F.sort_array(F.collect_set("place")).alias("places"))


def remove_lines(docs: DataFrame, min_docs: int = MIN_DOCS, max_share: float = MAX_SHARE) -> DataFrame:
    """``docs`` with ``clean_text``: the text without its boilerplate lines, all other lines as they
    are and in order.  A text without such a line is unchanged, a null one stays null."""
    host, row, lines, ends = (common.fresh(docs, x) for x in ("host", "row", "lines", "ends"))
    places = common.fresh(docs, "places")
    found = boilerplate_places(docs, min_docs, max_share).toDF(host, row, places)
    rows = docs.withColumn(host, _host()).withColumn(row, common.row_key("doc_id", "text"))
    # the runs of lines between two removed places, so that the work grows with the lines alone
    out = rows.join(found, [host, row], "left").withColumn(lines, F.when(F.col(places).isNotNull(), _lines(F.col("text"))))
    bounds = F.concat(F.array(F.lit(-1)), F.col(places), F.array(F.size(lines)))
    out = out.withColumn(ends, F.when(F.col(places).isNotNull(), bounds))
    before = lambda k: F.get(ends, k - 1)
    runs = F.transform(ends, lambda x, k: F.when(k > 0, F.slice(lines, before(k) + 2, x - before(k) - 1)).otherwise(F.array().cast("array<string>")))
    return (out.withColumn("clean_text", F.when(F.col(places).isNull(), F.col("text")).otherwise(F.array_join(F.flatten(runs), "\n")))
            .drop(host, row, places, lines, ends))


def _judged(docs: DataFrame, min_docs: int, max_share: float, min_kept_percent: int) -> DataFrame:
    """``docs`` with the measures of the text, ``clean_text``, ``n_boilerplate_words`` and ``kept``."""
    out = remove_lines(text_measures(docs), min_docs, max_share)
    left = F.when(F.col("clean_text") == F.col("text"), F.col("n_words")).otherwise(F.size(_words(F.coalesce("clean_text", F.lit("")))).cast("long"))
    out = out.withColumn("n_boilerplate_words", F.col("n_words") - left)
    depleted = (F.col("n_boilerplate_words") > 0) & (100 * (F.col("n_words") - F.col("n_boilerplate_words")) < min_kept_percent * F.col("n_words"))
    return out.withColumn("kept", ~F.col("base_failed") & ~depleted)


def clean(docs: DataFrame, min_docs: int = MIN_DOCS, max_share: float = MAX_SHARE,
          min_kept_percent: int = MIN_KEPT_PERCENT) -> DataFrame:
    """The documents kept, as ``doc_id``, ``source`` and the ``text`` without boilerplate lines."""
    judged = (_judged(docs.select("doc_id", "source", "text"), min_docs, max_share, min_kept_percent)
              .select("doc_id", "source", F.col("clean_text").alias("text"), "kept"))
    # written first: a filter on the verdict would be pushed down into every step of the measures
    return common.materialise(judged, "judged").where("kept").drop("kept")


def judge(docs: DataFrame, min_docs: int = MIN_DOCS, max_share: float = MAX_SHARE,
          min_kept_percent: int = MIN_KEPT_PERCENT) -> DataFrame:
    """The measures, ``base_failed``, the boilerplate words removed and the verdict ``kept``; the
    words are those that the cleaned text lacks."""
    return (_judged(docs.select("doc_id", "source", "text"), min_docs, max_share, min_kept_percent)
            .select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_boilerplate_words"))


#: The same rules in DuckDB SQL.
ORACLE_SQL = f"""
WITH d AS (SELECT doc_id, coalesce(source, chr(1)) AS host, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, text, list_filter(regexp_split_to_array(text, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS ws,
             list_filter(string_split(text, chr(10)), lambda x: regexp_replace(x, '[\\x20\\x09-\\x0D]+', '', 'g') <> '') AS ls FROM d),
win AS (SELECT doc_id, unnest(range(len(ws) - 2)) AS i, ws FROM w WHERE len(ws) >= 3),
keyed AS (SELECT doc_id, i, ws[i + 1] || ' ' || ws[i + 2] || ' ' || ws[i + 3] AS k FROM win),
rep AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, k) AS c FROM keyed),
cov AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM rep WHERE c > 1) GROUP BY doc_id),
ln AS (SELECT doc_id, host, trim(regexp_replace(lower(unnest(string_split(text, chr(10)))), '[\\x20\\x09-\\x0D]+', ' ', 'g')) AS line FROM d),
lw AS (SELECT doc_id, host, line, len(string_split(line, ' ')) AS words FROM ln WHERE line <> ''),
freq AS (SELECT host, line, count(DISTINCT doc_id) AS c FROM lw GROUP BY ALL),
hosts AS (SELECT host, count(DISTINCT doc_id) AS n FROM d GROUP BY ALL),
bad AS (SELECT host, line FROM freq JOIN hosts USING (host) WHERE c > greatest({MIN_DOCS}, floor(n * {MAX_SHARE}))),
tot AS (SELECT doc_id, sum(words) AS words, coalesce(sum(words) FILTER (bad.line IS NOT NULL), 0) AS removed
        FROM lw LEFT JOIN bad ON lw.host = bad.host AND lw.line = bad.line GROUP BY doc_id),
m AS (SELECT w.doc_id, len(ws) AS n_words, length(regexp_replace(text, '[\\x20\\x09-\\x0D]+', '', 'g')) AS word_chars,
             length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols,
             len(ls) - len(list_distinct(ls)) AS n_dup_lines, coalesce(cov.n, 0) AS n_repeat_words,
             coalesce(tot.removed, 0)::BIGINT AS n_boilerplate_words, coalesce(tot.words, 0) AS words
      FROM w LEFT JOIN cov USING (doc_id) LEFT JOIN tot USING (doc_id)),
b AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND NOT (n_boilerplate_words > 0 AND 100 * (words - n_boilerplate_words) < {MIN_KEPT_PERCENT} * words) AS kept, n_boilerplate_words
FROM b
"""
