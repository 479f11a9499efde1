"""Operator 9 (native): line-first quality rules.

Each line is judged on its own by rules on punctuation, navigation, noise and
boilerplate; lines that fail are removed; a document that loses too much of
its text, or fails the base rules, is rejected. All of it is array functions
within a row: nothing is shuffled, so no source or group of copies can be hot,
and a long document is sorted, never compared with itself pair by pair.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import SPACE_CLASS, SPACES, rows_where

SYMBOLS = "[#*$%&|<>]"
#: A line may end in these (fixed values): marks of Latin, Greek, Cyrillic and Armenian, Arabic and Urdu,
#: Indic, Tibetan, Burmese, Khmer, Ethiopic, Chinese and Japanese script, closing brackets and quotes.
MARKS = ".!?…:;,·։" + "؟،؛۔" + "।॥" + "།" + "။၊" + "។៕" + "።፧፣" + "。！？：；，、．｡" + ")\\]»”\"'’›」』）】》"
CLOSING = f"[{MARKS}][\\x20\\x09-\\x0D]*$"
#: Phrases of lines that frame a page.
BOILERPLATE = (
    "(?i)\\b(all rights reserved|terms of (use|service)|privacy policy|cookies?|javascript|lorem ipsum|"
    "licen[sc]ed under|click here|read more|sign (in|up)|log ?in|subscribe|share this|powered by)\\b"
)
#: A line fails if such phrases make up this share of its characters, however long it is.
BOILERPLATE_PERCENT = 10
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
#: A document that keeps less than this share of its word characters is rejected.
MIN_KEPT_PERCENT = 50


def line_passes(line: Column) -> Column:
    """Whether a line passes; blank lines pass.

    A line fails if it doesn't end in punctuation, is a bar or arrow separated
    list, has a symbol for every five words or more, shouts (a doubled
    exclamation mark for every third word), or is made up of boilerplate phrases
    by a tenth or more."""
    blank = ~line.rlike("[^\\x20\\x09-\\x0D]")
    words = F.regexp_count(line, F.lit("[^\\x20\\x09-\\x0D]+"))
    symbols = F.regexp_count(line, F.lit(SYMBOLS))
    shouts = (F.char_length(line) - F.char_length(F.replace(line, F.lit("!!"), F.lit("")))) / 2
    separators = F.regexp_count(line, F.lit(" [|>»•·] "))
    rest = F.char_length(F.regexp_replace(line, BOILERPLATE, ""))
    boilerplate = (F.char_length(line) - rest) * 100 >= F.char_length(line) * BOILERPLATE_PERCENT
    # Words are only counted on lines that have what is compared with their number.
    calm = ((symbols == 0) | (symbols * 5 < words)) & ((shouts == 0) | (shouts * 3 < words))
    return blank | (line.rlike(CLOSING) & (separators < 3) & calm & ~boilerplate)


def word_chars(text: Column) -> Column:
    return F.char_length(text) - F.regexp_count(text, F.lit(SPACE_CLASS))


def measured(docs: DataFrame, text: str = "text", *, spare_bits: int = 0) -> DataFrame:
    """docs with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, kept_text.

    A null text counts as having no line and no word, and so fails. Columns of
    docs with these names are replaced; others stay. Rows are independent:
    repeated rows get equal results, an empty table gives none. Results don't
    depend on spare_bits (52 at most), by which the hashes of windows are shortened."""
    whole = F.coalesce(F.col(text), F.lit(""))
    trimmed = F.btrim(whole, F.lit(SPACES))
    a = docs.withColumns({"_text": whole, "_words": F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, SPACE_CLASS + "+"))})
    a = a.withColumns({"_n": F.size("_words"), "_lines": F.split("_text", "\n", -1)})
    a = a.withColumn("_bits", F.ceil(F.log2(F.col("_n").cast("double") + 1)).cast("int") + F.lit(spare_bits))
    # A 3-word window becomes one long: the high bits of its hash, then its position. Sorted, equal
    # windows are neighbours (their words are compared too), unless unlike windows share those bits;
    # then the windows are sorted by their words. The positions found, in order, cover min(3,
    # distance to the next) words each.
    a = a.withColumn(
        "_keys",
        F.expr(
            """sort_array(if(_n < 3, cast(array() as array<bigint>), transform(sequence(0, _n - 3), i ->
                 shiftleft(shiftright(xxhash64(_words[i], _words[i + 1], _words[i + 2]), _bits), _bits) + i)))"""
        ),
    )
    # Most windows share their hash's bits with none; only those that do are looked at further.
    a = a.withColumn(
        "_near",
        F.expr(
            """filter(_keys, (x, k) -> (k > 0 AND shiftright(x, _bits) = shiftright(_keys[k - 1], _bits))
                 OR (k < size(_keys) - 1 AND shiftright(x, _bits) = shiftright(_keys[k + 1], _bits)))"""
        ),
    )
    place = "cast(_near[{k}] & (shiftleft(1L, _bits) - 1L) as int)"
    alike = "shiftright(_near[{a}], _bits) = shiftright(_near[{b}], _bits)"
    words = " AND ".join(f"_words[{place.format(k='{a}')} + {i}] = _words[{place.format(k='{b}')} + {i}]" for i in range(3))
    before, after = {"a": "k", "b": "k - 1"}, {"a": "k", "b": "k + 1"}
    clash = f"exists(sequence(1, size(_near) - 1), k -> {alike.format(**before)} AND NOT ({words.format(**before)}))"
    windows = "transform(transform(_near, x -> cast(x & (shiftleft(1L, _bits) - 1L) as int)), i -> struct(_words[i] AS a, _words[i + 1] AS b, _words[i + 2] AS c, i AS i))"
    a = a.withColumn("_exact", F.expr(f"if(size(_near) > 1 AND {clash}, sort_array({windows}), null)"))
    equal = "(_exact[{b}].a = x.a AND _exact[{b}].b = x.b AND _exact[{b}].c = x.c)"
    at = """sort_array(transform(filter({of}, (x, k) -> (k > 0 AND {left}) OR (k < size({of}) - 1 AND {right})), x -> {position}))"""
    sorted_ = at.format(of="_exact", left=equal.format(**before), right=equal.format(**after), position="cast(x.i AS bigint)")
    a = a.withColumn("_at", F.expr(f"if(_exact IS NULL, sort_array(transform(_near, x -> x & (shiftleft(1L, _bits) - 1L))), {sorted_})"))
    repeated = F.expr(
        """if(size(_at) = 0, 0L, aggregate(transform(_at, (x, k) -> if(k = size(_at) - 1, 3L, least(3L, _at[k + 1] - x))), 0L, (s, x) -> s + x))"""
    )
    nonblank = F.filter("_lines", lambda x: x.rlike("[^\\x20\\x09-\\x0D]"))
    a = a.withColumns({"_nonblank": nonblank, "_good": F.filter("_lines", line_passes)})
    a = a.withColumn("kept_text", F.array_join("_good", "\n"))
    a = a.withColumns(
        {
            "n_words": F.col("_n").cast("long"),
            "word_chars": word_chars(F.col("_text")).cast("long"),
            "n_symbols": F.regexp_count("_text", F.lit(SYMBOLS)).cast("long"),
            "n_dup_lines": (F.size("_nonblank") - F.size(F.array_distinct("_nonblank"))).cast("long"),
            "n_repeat_words": repeated,
        }
    )
    a = a.withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * MAX_REPEAT_PERCENT))
    kept = ~F.col("base_failed") & (word_chars(F.col("kept_text")) * 100 >= F.col("word_chars") * MIN_KEPT_PERCENT)
    return a.withColumn("kept", kept).drop("_text", "_words", "_n", "_lines", "_bits", "_keys", "_near", "_exact", "_at", "_nonblank", "_good")


COLUMNS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]


def judge(docs: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key and the measures and verdict of each document; see measured."""
    return measured(docs.select(F.col(key), F.col(text)), text).select(key, *COLUMNS)


def clean(docs: DataFrame, *, text: str = "text") -> DataFrame:
    """The documents that pass, with the lines that failed removed from text; columns as in docs."""
    names = docs.columns
    picked = docs.select(F.struct(*[docs[c] for c in names]).alias("_row"), F.col(text).alias("_in"))
    columns = [F.col("kept_text").alias(text) if c == text else F.col("_row")[c].alias(c) for c in names]
    return rows_where(measured(picked, "_in"), F.col("kept"), columns)


ORACLE = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws, string_split(t, chr(10)) AS ls FROM d),
g AS (SELECT doc_id, i, ws[i] || ' ' || ws[i+1] || ' ' || ws[i+2] AS g FROM w, unnest(range(1, len(ws) - 1)) AS u(i) WHERE len(ws) >= 3),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM g) WHERE c > 1),
p AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM r, unnest([0, 1, 2]) AS u(k) GROUP BY doc_id),
x AS (SELECT doc_id, ws, length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS word_chars,
             len(regexp_extract_all(t, '[#*$%&|<>]')) AS n_symbols,
             list_filter(ls, lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS nb,
             list_sum(list_transform(list_filter(ls, lambda l:
               regexp_matches(l, '[MARKS][\x20\x09-\x0D]*$')
               AND len(regexp_extract_all(l, ' [|>»•·] ')) < 3
               AND len(regexp_extract_all(l, '[#*$%&|<>]')) * 5 < len(regexp_extract_all(l, '[^\x20\x09-\x0D]+'))
               AND len(regexp_extract_all(l, '!!')) * 3 < len(regexp_extract_all(l, '[^\x20\x09-\x0D]+'))
               AND (length(l) - length(regexp_replace(l, '(?i)\b(all rights reserved|terms of (use|service)|privacy policy|cookies?|javascript|lorem ipsum|licen[sc]ed under|click here|read more|sign (in|up)|log ?in|subscribe|share this|powered by)\b', '', 'g'))) * 100 < length(l) * 10
             ), lambda l: length(regexp_replace(l, '[\x20\x09-\x0D]', '', 'g')))) AS good_chars
      FROM w),
y AS (SELECT doc_id, len(ws)::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols,
             (len(nb) - len(list_distinct(nb)))::BIGINT AS n_dup_lines, coalesce(n, 0)::BIGINT AS n_repeat_words,
             coalesce(good_chars, 0) AS good_chars
      FROM x LEFT JOIN p USING (doc_id)),
z AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM y)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND good_chars * 100 >= word_chars * 50 AS kept
FROM z
""".replace("MARKS", MARKS.replace("'", "''"))
