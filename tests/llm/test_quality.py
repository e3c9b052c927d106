"""Quality rules against brute force."""

import re

from tidelog.llm import quality

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    covered = set()
    for i, w in enumerate(windows):
        if windows.count(w) > 1:
            covered.update(range(i, i + 8))
    return {
        "n_words": len(words),
        "word_chars": sum(map(len, words)),
        "n_symbols": len(re.findall(r"[#*$%&|<>]", text)),
        "n_dup_lines": len(lines) - len(set(lines)),
        "n_repeat_words": len(covered),
        "base_failed": len(words) < 20 or 100 * len(covered) > 30 * len(words),
    }


TEXTS = [
    None,
    "",
    " \n\t\x0b ",
    "one two",
    "the cat and the dog sat with him on a mat " * 3,
    " ".join(f"w{i} the" for i in range(30)),
    " ".join(f"w{i} the" for i in range(30)) + "\n" + " ".join(f"w{i} the" for i in range(6)),
    "the line of it\nthe line of it\n\n  \nthe line of it\r\nand other words of the text are in here for now",
    "a b c d e f g h i a b c d e f g h " + "z " * 40,
    "the #a# b *c* $d$ %e% &f& |g| <h> of and it is to be as on by " * 2,
    "é ö x 日本 the of " * 5,
    "Der Hund und die Katze sind in dem Haus mit " + " ".join(f"wort{i}" for i in range(20)),
]


def test_measures_and_verdicts(documents):
    rows = [(i, t, "en", "s") for i, t in enumerate(TEXTS)] + [(4, TEXTS[4], None, None), (None, "x", None, None)]
    got = quality.quality_verdicts(documents(rows)).collect()
    assert len(got) == len(rows)
    for r in got:
        expected = brute(TEXTS[r.doc_id] if r.doc_id is not None else "x")
        assert {k: r[k] for k in expected} == expected
        assert r.kept == (r.failed_rules == "") and not (r.kept and r.base_failed)
    verdicts = {r.doc_id: r for r in got}
    assert verdicts[5].kept and verdicts[11].kept
    assert "symbols" in verdicts[9].failed_rules and "few_words" in verdicts[0].failed_rules


def test_good_documents_keep_their_columns(documents):
    docs = documents([(i, t, "en", "s") for i, t in enumerate(TEXTS)])
    kept = quality.keep_good(docs)
    assert kept.schema == docs.schema
    expected = {r.doc_id for r in quality.quality_verdicts(docs).collect() if r.kept}
    assert {r.doc_id for r in kept.collect()} == expected


def test_empty_table(documents, spark):
    docs = spark.createDataFrame([], "doc_id bigint, text string")
    assert quality.quality_verdicts(docs).count() == 0 and quality.keep_good(docs).count() == 0


def test_filters_stay_above_the_measures(documents):
    """A filter written out over the measures would evaluate arrays once per element."""
    long_text = " ".join(f"w{i} the" for i in range(60_000))
    kept = quality.quality_verdicts(documents([(1, long_text, "en", "s")])).filter("kept")
    assert [r.n_words for r in kept.collect()] == [120_000]


def test_clean_labelled_documents_are_kept(spark, sf_dir):
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    verdicts = quality.quality_verdicts(spark.read.parquet(f"{sf_dir}/documents.parquet")).join(labels, "doc_id").collect()
    assert all(r.kept or r.base_failed for r in verdicts if r.quality == 1)
    bad = [r for r in verdicts if r.quality == 0]
    assert sum(not r.kept for r in bad) >= 0.9 * len(bad)
