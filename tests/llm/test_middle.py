"""Fill-in-the-middle transformation against plain slicing."""

import hashlib

import pytest

from tidelog.llm import middle


def expected(doc_id, text, m=middle.Middle()):
    text = text or ""
    h = hashlib.sha256(f"{m.seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * i : 8 * i + 8], 16) for i in range(4))
    n = len(text)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, mid, s = text[:a], text[a:b], text[b:]
    if not text or any(x in text for x in (m.prefix, m.suffix, m.middle)) or h3 % 100 >= m.rate:
        return n, "plain", None, None, text, text
    if h4 % 100 < m.spm:
        return n, "spm", a, b - a, m.suffix + s + m.prefix + p + m.middle + mid, text
    return n, "psm", a, b - a, m.prefix + p + m.suffix + s + m.middle + mid, text


TEXTS = [
    None,
    "",
    "a",
    "\n",
    "<P>",
    "has <S> inside",
    "<M",
    "<P<S<M>>",
    "$1 \\2 ${x} (.*) \\Q",
    "é😀́中\r\n \u0085x" * 7,
    "a<b>\n" * 50,
    "😀" * 4096,
    "x\n" * 4096 + "tail",
    "no end \n\n",
]


@pytest.mark.parametrize("how", [middle.Middle(), middle.Middle(seed=7, rate=100, spm=50, prefix="<pre>", suffix="<suf>", middle="<mid>")])
def test_every_text_equals_slicing(spark, documents, how):
    rows = [(i * 31 + k, t, "en", "s") for i in range(8) for k, t in enumerate(TEXTS)]
    rows += [(5, "same row", "en", "s")] * 3 + [(None, "no id", "en", "s")]
    docs = documents(rows, extra=("h", "a", "id", "whole", "output", "form"))
    got = middle.transform_texts(docs, how).collect()
    wanted = [(i, *expected(i, t, how)) for i, t, _, _ in rows]
    assert sorted(map(tuple, got), key=repr) == sorted(wanted, key=repr)
    assert {r.form for r in got} == {"plain", "psm", "spm"}


def test_other_columns_are_kept(spark, documents):
    docs = documents([(i, f"text {i} of words", "en", "s") for i in range(20)], extra=("h", "a", "id", "whole", "output"))
    done = middle.transform_documents(docs)
    assert done.columns == docs.columns
    before = {r.doc_id: r.asDict() for r in docs.collect()}
    for r in done.collect():
        was = before[r.doc_id]
        assert r.text == expected(r.doc_id, was["text"])[4]
        assert {k: v for k, v in r.asDict().items() if k != "text"} == {k: v for k, v in was.items() if k != "text"}


def test_very_long_text_and_empty_table(spark, documents):
    text = "aé😀\n<" * 300_000
    (row,) = middle.transformed_digests(documents([(11, text, "en", "s")])).collect()
    n, form, prefix, mid, output, restored = expected(11, text)
    assert (row.n, row.form, row.prefix_chars, row.middle_chars) == (n, form, prefix, mid)
    assert row.output_sha256 == hashlib.sha256(output.encode()).hexdigest()
    assert row.restored_sha256 == hashlib.sha256(text.encode()).hexdigest()
    assert middle.transformed_digests(documents([(1, "x", "en", "s")]).limit(0)).count() == 0


def test_marks_are_checked():
    for mark in ("P", "<>", "<a<b>", "<a b>"):
        with pytest.raises(ValueError):
            middle.Middle(prefix=mark)
    with pytest.raises(ValueError):
        middle.Middle(prefix="<S>")


def test_no_python_in_the_plan(spark, documents):
    docs = documents([(1, "x y", "en", "s")])
    plan = middle.transformed_digests(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
