import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tidemark.llm import rules as R


def plain(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    grams = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    times = Counter(grams)
    hit = {i + k for i, g in enumerate(grams) if times[g] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(hit)


TEXTS = [
    None, "", " \t\n ", "one", "a b c a b c", "x x x x x", "a b\nc a b c d", "l one\nl one\n\n\nl one ", "été | ## été",
    " ".join(f"w{i % 70}" for i in range(200)), " ".join(f"w{i}" for i in range(60)) + ".", "\x0bq\x0c" * 40, "word " * 30000,
]


def test_measures(spark):
    docs = spark.createDataFrame([(i, t, 1, "x") for i, t in enumerate(TEXTS)], "doc_id long, text string, n_words int, kept string")
    out = {r.doc_id: r for r in R.judge(docs).collect()}
    for i, t in enumerate(TEXTS[:-1]):
        r, want = out[i], plain(t)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want, t
        assert r.base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0])
        assert not (r.base_failed and r.kept)
    assert out[len(TEXTS) - 1].n_repeat_words == 30000
    assert out[10].kept and not out[0].kept
    assert R.judge(docs.filter(F.lit(False))).count() == 0


def test_lines(spark):
    cases = {
        "A plain sentence.": True, "": True, "   ": True, "no end": False, "Home | News | Sport | Weather.": False,
        "a b c d e f g h i j # k.": True, "a# b# c# d.": False, "BUY!! NOW!! CHEAP!!": False, "We use cookies to serve you.": False,
        "We use cookies, " + "which is a plain word in a long paragraph of prose, " * 3 + "here.": True, "Click here, read more. " * 30: False,
        "Wow!! this is a long and calm sentence.": True, "“Quoted.”": True,
        "यह एक वाक्य है।": True, "یہ ایک جملہ ہے۔": True, "هل هذا سؤال؟": True, "これは文です。": True, "「はい」": True, "ይህ ዓረፍተ ነገር ነው።": True, "यह एक": False, "a ] b": False, "a \\": False, "(so it is)": True, "[1]": True,
    }
    df = spark.createDataFrame(list(enumerate(cases)), "i int, line string").select("i", R.line_passes(F.col("line")).alias("ok"))
    assert [r.ok for r in df.orderBy("i").collect()] == list(cases.values())


def test_cleaning_keeps_columns_and_removes_failing_lines(spark):
    good = " ".join(f"w{i}" for i in range(80)) + "."
    docs = spark.createDataFrame(
        [(1, good + "\nHome | News | Sport | More\n" + good[::-1][1:] + ".", "en", "_row"), (2, "short.", "en", None), (3, None, None, None)],
        "doc_id long, text string, lang string, source string",
    )
    out = R.clean(docs)
    assert out.columns == docs.columns
    assert [(r.doc_id, "News" in r.text, r.text.count("\n"), r.source) for r in out.collect()] == [(1, False, 1, "_row")]


def test_repeated_rows_get_equal_results(spark):
    text = " ".join(f"w{i}" for i in range(60)) + ".\nHome | News | Sport | More"
    docs = spark.createDataFrame([(1, text), (1, text), (2, text), (None, text), (None, None)], "doc_id long, text string")
    out = [tuple(r)[1:] for r in R.judge(docs).collect() if r.n_words]
    assert len(out) == 4 and len(set(out)) == 1 and R.judge(docs).count() == 5
    assert R.clean(docs).count() == 4


@pytest.mark.parametrize("spare", [0, 44, 52])
def test_windows_whose_hashes_meet_hide_no_repeat(spark, spare):
    rng = random.Random(spare)
    texts = [" ".join(rng.choice("abcdefgh") for _ in range(n)) for n in (0, 2, 3, 4, 30, 90, 110, 120)] + TEXTS[:11]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    out = {r.doc_id: r.n_repeat_words for r in R.measured(docs, spare_bits=spare).collect()}
    assert out == {i: plain(t)[4] for i, t in enumerate(texts)}
