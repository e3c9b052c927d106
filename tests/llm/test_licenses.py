"""License scans: phrases against brute force, notices with words put in, left out and split."""

import re

from tidelog.llm import licenses

PERMISSION = licenses.TEMPLATES["mit"][2]
TEXTS = [
    None,
    "",
    "...",
    "MIT License, mit-license; the MIT  LICENSE!",
    "GNU General Public\nLicense; General public licenses; apache license apache License",
    "license mit", "mit", "submit license, mit licensed, mitélicense mit",
    "x " * 300 + "Released under the MIT License. " + "y " * 50,
    "This work is licensed under the GNU General Public License, version 3.",
    PERMISSION,
    PERMISSION.replace("free of charge", "wholly free of any charge").replace("associated ", ""),
    " ".join(PERMISSION.split()[:6]) + " other words " * 30,
    "Licensed under CC BY-NC 4.0.\n" + "some text here " * 20 + "\nAll rights reserved.",
    "日本 mit license 語",
]


def brute(text):
    lower = (text or "").translate({c: c + 32 for c in range(65, 91)})
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)
    found = sorted(
        (i, label)
        for phrase, label in licenses.PHRASES.items()
        for i in range(len(words))
        if words[i : i + len(phrase.split())] == phrase.split()
    )
    labels = ",".join(sorted({label for _, label in found}))
    return (len(words), len(found), found[0][0] if found else None, found[-1][0] if found else None, labels)


def test_scans(documents):
    rows = [(i, t, "en", "s") for i, t in enumerate(TEXTS)] + [(None, TEXTS[3], None, None), (3, TEXTS[3], "en", "s")]
    got = licenses.scan_licenses(documents(rows)).collect()
    assert len(got) == len(rows)
    by_id = {}
    for r in got:
        text = TEXTS[3 if r.doc_id is None else r.doc_id]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == brute(text)
        assert set(filter(None, r.base_labels.split(","))) <= set(filter(None, r.labels.split(",")))
        assert 0 <= r.score <= 1
        by_id[r.doc_id] = r
    labels = {i: r.labels for i, r in by_id.items()}
    assert labels[0] == labels[1] == labels[2] == labels[5] == labels[6] == ""
    assert labels[8] == labels[10] == labels[11] == "mit" and by_id[10].score == 1
    assert labels[9] == "gpl,gpl-3" and labels[12] == ""
    assert labels[13] == "all-rights-reserved,cc-by-nc"
    assert 0.6 <= by_id[11].score < 1
    (span,) = by_id[8].findings
    assert (span.from_word, span.to_word) == (300, 305)


def test_repeated_notices(documents):
    """Every copy of a short notice is found, however near the copies are."""
    notice = "All rights reserved."
    texts = ["\n".join([notice] * n) for n in (1, 2, 3, 2000)]
    texts += [f"{notice} x {notice}", f"{notice} x y {notice} z {notice} {notice}", f"p 1 {notice} " * 50]
    texts += ["Released under the MIT License. " * 3, "Licensed under CC 4.0 BY licensed under CC BY 4.0. " * 2]
    rows = [(i, t, "en", "s") for i, t in enumerate(texts)]
    got = {r.doc_id: r for r in licenses.scan_licenses(documents(rows)).collect()}
    for i, text in enumerate(texts[:7]):
        assert got[i].labels == "all-rights-reserved" and got[i].score == 1
        places = [k for k, word in enumerate(re.findall("[a-z0-9]+", text.lower())) if word == "all"]
        assert [(f.from_word, f.to_word) for f in got[i].findings] == [(k, k + 3) for k in places]
    assert got[7].labels == "mit" and len(got[7].findings) == 3
    assert got[8].labels == "cc-by"


def test_texts_shorter_than_a_run_and_empty_tables(spark, documents):
    got = licenses.scan_licenses(documents([(1, "a b", "en", "s"), (2, "a", "en", "s")])).collect()
    assert sorted((r.doc_id, r.n_words, r.labels) for r in got) == [(1, 2, ""), (2, 1, "")]
    assert licenses.scan_licenses(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0


def test_no_python_in_the_plan(documents):
    plan = licenses.scan_licenses(documents([(1, "a b c", "en", "s")]))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan
