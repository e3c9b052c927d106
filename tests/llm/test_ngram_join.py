"""The Jaccard join against brute force, with settings small enough to reach every path."""

import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from tidelog.llm import components, ngram_join, shingles

LOWER = {c: c + 32 for c in range(65, 91)}


def brute(rows, width, top):
    sets = []
    for i, text in rows:
        words = (text or "").translate(LOWER)
        for c in "\t\n\x0b\x0c\r":
            words = words.replace(c, " ")
        words = [w for w in words.split(" ") if w]
        grams = zip(*(words[k:] for k in range(width))) if len(words) >= width else [tuple(words)] if words else []
        sets.append((i, frozenset(grams)))
    classes = defaultdict(list)
    for i, s in sets:
        classes[s].append(i)
    keys = [s for s in classes if s]
    parent = list(range(len(keys)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    holders = defaultdict(list)
    for k, s in enumerate(keys):
        for x, overlap in Counter(x for g in s for x in holders[g]).items():
            if 100 * overlap >= top * (len(s) + len(keys[x]) - overlap):
                parent[root(x)] = root(k)
        for g in s:
            holders[g].append(k)
    members = defaultdict(list)
    for k, s in enumerate(keys):
        members[root(k)] += classes[s]
    component = {i: min(ids) for ids in members.values() for i in ids}
    return {i: (len(s), component.get(i, i)) for i, s in sets}


def near_copies(seed):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(3000)]

    def edited(words, edits):
        words = list(words)
        for _ in range(edits):
            kind, place = rng.random(), rng.randrange(len(words))
            if kind < 0.4:
                words[place] = rng.choice(vocabulary)
            elif kind < 0.7 and len(words) > 1:
                del words[place]
            else:
                words.insert(place, rng.choice(vocabulary))
        return words

    texts = []
    for n in (3, 8, 20, 60, 150, 150, 400):
        base = [rng.choice(vocabulary) for _ in range(n)]
        group = [base]
        for _ in range(rng.choice([5, 40, 70])):
            group.append(edited(rng.choice(group) if rng.random() < 0.5 else base, rng.randint(0, max(1, n // 18))))
        texts += group
    passage = [rng.choice(vocabulary) for _ in range(60)]
    for _ in range(40):
        own = [rng.choice(vocabulary) for _ in range(rng.randint(5, 100))]
        place = rng.randint(0, len(own))
        texts.append(own[:place] + passage + own[place:])
    texts = [" ".join(t) for t in texts]
    texts += [None, "", " \n", "a", "A", "a b", "b a", "A\tB\x0b", "É é ß", texts[0].upper()]
    rows = list(enumerate(texts))
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize(
    "seed, join",
    [
        (1, ngram_join.Join(3, 90, 100, frequent=4, short_list=3)),
        (2, ngram_join.Join(3, 90, 100, frequent=1000, short_list=2)),
        (3, ngram_join.Join(2, 70, 100, frequent=3, short_list=2, least_paired=5)),
        (4, ngram_join.Join()),
        (5, ngram_join.Join(5, 80, 100, frequent=1, short_list=2)),
        (6, ngram_join.Join(1, 60, 100, frequent=2, short_list=2)),
    ],
)
def test_components_equal_brute_force(spark, documents, seed, join):
    rows = near_copies(seed)
    docs = documents([(i, t, "en", "s") for i, t in rows])
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.jaccard_components(docs, join).collect()}
    assert got == brute(rows, join.width, join.top)


def test_one_of_each_component(documents):
    rows = near_copies(5)
    expected = brute(rows, 5, 80)
    twice = [*rows, *rows[:7], (None, "only here and nowhere else at all my friend"), (None, None)]
    docs = documents([(i, t, "en", "s") for i, t in twice])
    kept = ngram_join.one_of_each_component(docs)
    assert kept.schema == docs.schema
    ids = Counter(r.doc_id for r in kept.collect())
    wanted = Counter(i for i, (n, c) in expected.items() if n and i == c)
    wanted += Counter(i for i, _ in twice if i is None or expected[i][0] == 0)
    assert ids == wanted


def entries_of(join, sets, counts):
    """Index entries of sets of tokens, each given as a list of numbers below 2**63."""
    kind = pa.list_(pa.struct([("token", pa.int64()), ("n_sets", pa.int64())]))
    shared = [[{"token": t, "n_sets": counts[t]} for t in s if counts[t] > 1] for s in sets]
    batch = pa.RecordBatch.from_arrays(
        [pa.array(range(len(sets)), pa.int64()), pa.array([len(s) for s in sets], pa.int64()), pa.array(shared, kind)],
        ["cid", "n", "shared"],
    )
    found = {}
    for out in ngram_join._entries(join)([batch]):
        for row in out.to_pylist():
            found[row["cid"]] = row["entries"]
    return found


@pytest.mark.parametrize("top", [60, 80, 90])
def test_linked_sets_share_an_entry(top):
    join = ngram_join.Join(top=top, frequent=3, least_paired=5)
    rng = random.Random(top)
    sets = []
    for n in [rng.randint(3, 380) for _ in range(150)]:
        base = [rng.getrandbits(62) for _ in range(n)]
        sets.append(base)
        for _ in range(6):
            edits = rng.randint(0, int(n * (100 - top) / 100) + 1)
            kept = rng.sample(base, max(1, n - rng.randint(0, edits)))
            sets.append(kept + [rng.getrandbits(62) for _ in range(rng.randint(0, edits))])
    counts = {t: c if c > 1 and rng.random() < 0.9 else 2 for t, c in Counter(t for s in sets for t in s).items()}
    found = entries_of(join, sets, counts)
    linked = 0
    for begin in range(0, len(sets), 7):
        for i in range(begin, begin + 7):
            for j in range(i + 1, begin + 7):
                a, b = set(sets[i]), set(sets[j])
                if 100 * len(a & b) >= top * len(a | b):
                    linked += 1
                    assert set(found[i]) & set(found[j])
    assert linked > 300


def test_entries_grow_with_a_set_and_not_with_its_square():
    rng = random.Random(3)
    for n in (50, 100, 200, 300):
        tokens = [rng.getrandbits(62) for _ in range(n)]
        found = entries_of(ngram_join.Join(), [tokens], dict.fromkeys(tokens, 1000))
        assert 0 < len(found[0]) <= n


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id bigint, text string")
    assert ngram_join.jaccard_components(docs).count() == 0 and ngram_join.one_of_each_component(docs).count() == 0


def test_long_texts_hash_like_short_ones(monkeypatch):
    text = " ".join(f"word{i % 50}" for i in range(500)).encode() + b" " + b"x" * 300 + b" end"
    data = np.frombuffer(text, np.uint8)
    whole = shingles.shingle_sets(shingles.WordHasher(), [data], 3)[0]
    monkeypatch.setattr(shingles, "BLOCK_BYTES", 100)
    cut = shingles.shingle_sets(shingles.WordHasher(), [data, data[:0], data[:7]], 3)
    assert (cut[0] == whole).all() and [len(s) for s in cut[1:]] == [0, 1]


def test_chain_and_star_components(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 60)] + [(7, 7), (300, 200), (200, 300)]
    got = components.components(spark.createDataFrame(links, "a bigint, b bigint")).collect()
    roots = {r.node: r.root for r in got}
    expected = dict.fromkeys(range(41), 0) | dict.fromkeys(range(100, 160), 100) | {200: 200, 300: 200}
    assert roots == expected and len(got) == len(expected)
    assert components.components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0
