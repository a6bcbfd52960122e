"""Near duplicates, repeated passages, components and their edge cases against brute force."""

import random
import re
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from quern.llm import linking, near_dedup
from quern.llm.components import components
from quern.llm.near_dedup import near_duplicates
from quern.llm.paragraph_dedup import cut_paragraphs, remove_repeats, repeated_passages, tune_bands
from quern.llm.shared import Workspace

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {k: k + 32 for k in range(65, 91)}


def words(t):
    return WORD.findall((t or "").translate(LOWER))


def union_find(items, pairs):
    par = {x: x for x in items}

    def find(x):
        while par[x] != x:
            par[x] = par[par[x]]
            x = par[x]
        return x

    for a, b in pairs:
        par[find(a)] = find(b)
    return find


def brute_components(rows, size, num, den):
    sets = {}
    for d, t in rows:
        w = words(t)
        sets[d] = frozenset(tuple(w[k : k + size]) for k in range(max(1, len(w) - size + 1))) if w else frozenset()
    ids = sorted(sets)
    pairs = []
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            both = len(sets[a] & sets[b])
            if both and den * both >= num * (len(sets[a]) + len(sets[b]) - both):
                pairs.append((a, b))
    find = union_find(ids, pairs)
    low = {}
    for i in ids:
        low[find(i)] = min(low.get(find(i), i), i)
    return {i: (len(sets[i]), low[find(i)]) for i in ids}


def families(seed, groups, copies):
    """Texts that differ from their family's first by some words, so that many pairs lie about the threshold."""
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdefgh") for _ in range(4)) for _ in range(400)]
    rows, n = [], 0
    for _ in range(groups):
        base = [rng.choice(vocabulary) for _ in range(rng.choice([2, 8, 40, 120]))]
        for _ in range(rng.randint(1, copies)):
            t = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 4, 8])):
                t[rng.randrange(len(t))] = rng.choice(vocabulary[:6])
            rows.append((n, " ".join(t)))
            n += 1
    return rows


@pytest.mark.parametrize("small, size, num", [(48, 3, 85), (3, 3, 85), (3, 5, 80)])
def test_components_equal_brute_force(spark, monkeypatch, small, size, num):
    monkeypatch.setattr(linking, "SMALL", small)  # large lists on a small table
    rows = families(small + size, 25, 14) + [(9001, None), (9002, ""), (9003, " \n"), (9004, "One"), (9005, "one"), (9006, "w " * 9000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("c", F.lit("clash"))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_duplicates(df, size=size, num=num).collect()}
    want = brute_components(rows, size, num, 100)
    assert got == want
    kept = {r.doc_id for r in near_duplicates(df, size=size, num=num).where("kept").collect()}
    assert kept == {i for i, (_, c) in want.items() if i == c}


def test_one_large_group(spark, monkeypatch):
    """A hot family beside lone documents: one component where brute force says so."""
    monkeypatch.setattr(linking, "SMALL", 8)
    rng = random.Random(8)
    vocabulary = ["".join(rng.choice("klmnop") for _ in range(5)) for _ in range(300)]
    base = [rng.choice(vocabulary) for _ in range(100)]
    rows = []
    for i in range(160):
        t = list(base)
        for _ in range(rng.choice([1, 2, 3, 6])):
            t[rng.randrange(100)] = rng.choice(vocabulary[:5])
        rows.append((i, " ".join(t)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_duplicates(df, size=3, num=85).collect()}
    assert got == brute_components(rows, 3, 85, 100)


def test_repeated_rows_and_null_ids(spark):
    df = spark.createDataFrame([(4, "a b c d e f"), (4, "a b c d e f"), (2, "a b c d e f"), (None, "a b c d e f"), (None, "g h i j k l"), (5, "x y z x y w")], "doc_id long, text string")
    got = sorted(((r.doc_id, r.component_id, r.kept) for r in near_duplicates(df).collect()), key=str)
    assert got == sorted([(4, 2, False), (4, 2, False), (2, 2, True), (None, 2, False), (None, None, True), (5, 5, True)], key=str)
    assert near_duplicates(df.limit(0)).count() == 0


def test_components_of_chains_stars_and_loops(spark):
    rng = random.Random(3)
    edges = [(i, i + 1) for i in range(60)] + [(100, x) for x in range(101, 160)] + [(200, 201), (201, 202), (202, 200), (300, 300)]
    rng.shuffle(edges)
    got = {r.c: r.root for r in components(spark.createDataFrame(edges, "a long, b long"), Workspace(spark, "test")).collect()}
    groups = defaultdict(set)
    for c, r in got.items():
        groups[r].add(c)
    assert sorted(map(sorted, groups.values())) == [list(range(61)), list(range(100, 160)), [200, 201, 202]]


def test_the_same_without_a_mounted_folder(spark, monkeypatch):
    from quern.llm import often

    rows = families(77, 6, 5)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    monkeypatch.setattr(often, "is_mounted", lambda uri: False)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_duplicates(df, size=3, num=85).collect()}
    assert got == brute_components(rows, 3, 85, 100)
    assert {r.doc_id for r in repeated_passages(spark.createDataFrame(passages(5), "doc_id long, text string")).collect()} == long_repeats(passages(5), 51)


def test_bands_reach_their_recall():
    for t in (0.5, 0.8, 0.9):
        b = tune_bands(t)
        assert 1 - (1 - t**2) ** b >= 0.995 > 1 - (1 - t**2) ** (b - 1)


def test_paragraphs_follow_their_words():
    rng = np.random.default_rng(1)
    passage = rng.integers(0, 2**63, 60, dtype=np.uint64)
    cuts = []
    for k in range(30):
        before, after = (rng.integers(0, 2**63, n, dtype=np.uint64) for n in rng.integers(0, 40, 2))
        w = np.concatenate([before, passage, after])
        start, row = cut_paragraphs(w, np.array([0, len(w), 0]))
        assert (row == 1).all() and start[0] == 0 and (np.diff(np.append(start, len(w))) > 4).all() or len(w) < 11
        cuts.append({int(s) - len(before) for s in start})
    inner = {c for c in cuts[0] if 5 <= c <= 50}
    assert len(inner) >= 2 and all({c for c in x if 5 <= c <= 50} == inner for x in cuts)


def passages(seed):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdefghijkl") for _ in range(5)) for _ in range(3000)]
    text = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    shared = [text(rng.randint(55, 90)) for _ in range(6)]
    line = text(12)
    rows = []
    for i in range(80):
        t = text(rng.randint(30, 150))
        if i % 3 == 0:  # a passage in the middle of a line
            at = rng.randrange(len(t))
            t[at:at] = shared[i // 3 % 6]
        if i % 4 == 0:  # a short common line is no passage
            t += ["\n", *line, "\n"]
        rows.append((i, " ".join(t)))
    return rows


def long_repeats(rows, k):
    seen, hit = {}, set()
    for d, t in rows:
        w = words(t)
        for j in range(len(w) - k + 1):
            o = seen.setdefault(tuple(w[j : j + k]), d)
            if o != d:
                hit |= {o, d}
    return hit


def test_passages(spark):
    rows = passages(5) + [(900, None), (901, ""), (902, "short"), (903, "word " * 3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("row", F.lit("clash"))
    found = repeated_passages(df).collect()
    assert {r.doc_id for r in found} == long_repeats(rows, 51)
    cut = remove_repeats(df)
    assert cut.columns == df.columns
    left = [(r.doc_id, r.text) for r in cut.collect()]
    assert not long_repeats(left, 51)
    text, clean = dict(left), dict(rows)
    untouched = set(clean) - {r.doc_id for r in found}
    assert all(text[d] == clean[d] for d in untouched)
    # the first occurrence stays
    assert all(text[r.class_id] == clean[r.class_id] for r in found if r.doc_id == r.class_id and r.n_removed == 0)


def test_whole_copies_go(spark):
    t = " ".join(f"word{i}" for i in range(80))
    df = spark.createDataFrame([(3, t), (1, t), (2, "other " + t.upper()), (None, "lone text")], "doc_id long, text string")
    assert {r.doc_id for r in remove_repeats(df).collect()} <= {1, 2, None}
    assert repeated_passages(df.limit(0)).count() == 0 and remove_repeats(df.limit(0)).count() == 0


def test_near_paragraphs_are_linked(spark):
    """Equal up to few words in long paragraphs of one word: sets decide, not lengths."""
    rows = [(i, "intro%d " % i + "same " * (40 + i) + "end%d" % i) for i in range(4)]
    got = repeated_passages(spark.createDataFrame(rows, "doc_id long, text string"), least=20).collect()
    assert {r.doc_id for r in got} == {0, 1, 2, 3}


def test_no_list_is_longer_than_its_sketch():
    assert near_dedup.LISTED <= near_dedup.K


def test_sets_of_many_own_items_stay_in_large_lists(spark):
    """Copies with more own shingles than ``HEAD`` have no head; the large lists hold them all the same."""
    rng = random.Random(41)
    base = ["".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(3000)]
    rows = []
    for i in range(60):
        t = list(base)
        edits = rng.choice([33, 36, 40, 60])
        for k, at in enumerate(range(rng.randrange(40), 3000, 3000 // edits)):
            t[at] = f"own{i}x{k}"
        rows.append((i, " ".join(t)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_duplicates(df, size=3, num=85).collect()}
    assert got == brute_components(rows, 3, 85, 100)


def test_passages_with_edits_are_whole(spark):
    """Passages with one word changed for every 50 or so, inside differing text: all but their ends go."""
    rng = random.Random(12)
    fresh = lambda n: ["".join(rng.choice("abcdefghijkl") for _ in range(8)) for _ in range(n)]
    rows, edited = [], {}
    for i in range(40):
        n, edits = ((60, [30]), (100, [33, 66]), (90, []))[i % 3]
        passage = fresh(n)
        copy = list(passage)
        for k in edits:
            copy[k] = fresh(1)[0]
        rows.append((i, " ".join(fresh(40) + passage + fresh(40))))
        rows.append((100 + i, " ".join(fresh(30) + copy + fresh(50))))
        edited[100 + i] = (30, n)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r.doc_id: (r.start, r.n_words, r.n_removed) for r in repeated_passages(df).where("doc_id >= 100").collect()}
    assert sum(found.get(d) == (at, n, n) for d, (at, n) in edited.items()) >= 38
    left = {r.doc_id: len(words(r.text)) for r in remove_repeats(df).collect()}
    assert sum(left[d] == 80 for d in edited) >= 38 and all(left[i] == len(words(dict(rows)[i])) for i in range(40))


def shingled(t, size=5):
    w = words(t)
    return frozenset(tuple(w[k : k + size]) for k in range(max(1, len(w) - size + 1)))


def test_passages_of_the_least_length(spark):
    """Exact passages of 50 to 52 words inside differing text, against all windows of 50 words."""
    rng = random.Random(77)
    fresh = lambda n: ["".join(rng.choice("abcdefghijkl") for _ in range(8)) for _ in range(n)]
    rows = []
    for i in range(150):
        passage = fresh(rng.choice([50, 51, 52]))
        rows += [(2 * i, " ".join(fresh(rng.randrange(80)) + passage + fresh(rng.randrange(80)))), (2 * i + 1, " ".join(fresh(rng.randrange(80)) + passage + fresh(rng.randrange(80))))]
    rows += [(1000 + i, " ".join(fresh(200))) for i in range(20)]
    short = fresh(49)
    rows += [(2000 + i, " ".join(fresh(30) + short + fresh(30))) for i in range(6)]
    got = {r.doc_id for r in repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    want = long_repeats(rows, 50)
    assert len(want) == 300 and got <= want and len(got) >= 0.98 * len(want)


def test_paragraphs_at_the_threshold(spark):
    """Lines with scattered edits inside differing documents, against the Jaccard similarity of all pairs."""
    rng = random.Random(78)
    fresh = lambda n: ["".join(rng.choice("abcdefghijkl") for _ in range(8)) for _ in range(n)]
    rows, lines = [], {}
    for i in range(150):
        n, edits = ((50, [25]), (60, [30]), (92, [31, 62]), (100, [20, 60]), (60, [20, 40]), (140, [35, 70, 105]), (70, [18, 36, 54]))[i % 7]
        a = fresh(n)
        b = list(a)
        for k in edits:
            b[k] = fresh(1)[0]
        for d, line in ((2 * i, a), (2 * i + 1, b)):
            lines[d] = " ".join(line)
            rows.append((d, "\n".join([" ".join(fresh(rng.randrange(1, 40))), lines[d], " ".join(fresh(rng.randrange(1, 40)))])))
    close = set()
    for i in range(150):
        x, y = shingled(lines[2 * i]), shingled(lines[2 * i + 1])
        if 100 * len(x & y) >= 80 * len(x | y):
            close |= {2 * i, 2 * i + 1}
    got = repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    # 92 words with two edits are not close, but 62 of them are
    far = {2 * i + k for i in range(150) for k in (0, 1) if i % 7 in (4, 6)}
    hit = {r.doc_id for r in got}
    assert not hit & far and len(hit & close) >= 0.97 * len(close) and 150 < len(close) < 300
    whole = {r.doc_id: r.n_removed for r in got}
    assert sum(whole.get(d, 0) == len(words(lines[d])) for d in close if d % 2) >= 0.97 * len(close) / 2


def test_repeated_rows_null_ids_and_clashing_columns(spark):
    t, u = " ".join(f"word{i}" for i in range(70)), " ".join(f"other{i}" for i in range(70))
    rows = [(None, t), (None, t), (7, u), (7, u), (8, None), (8, ""), (None, "lone")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert repeated_passages(df).count() == 0 and remove_repeats(df).count() == 7
    more = df.union(spark.createDataFrame([(9, u.upper()), (3, t + "\ntail of its own")], df.schema)).withColumn("cuts", F.lit("a")).withColumn("cut_id", F.lit(1)).withColumn("_cuts", F.lit(2)).withColumn("row", F.lit(3)).withColumn("c", F.lit(4))
    found = {(r.doc_id, r.n_words, r.n_removed, r.class_id) for r in repeated_passages(more).collect()}
    assert found == {(None, 70, 0, None), (3, 70, 70, None), (7, 70, 0, 7), (9, 70, 70, 7)}
    left = remove_repeats(more)
    assert left.columns == more.columns
    assert sorted(((r.doc_id, r.text) for r in left.collect()), key=str) == sorted([*rows, (3, "tail of its own")], key=str)


def test_a_very_long_text(spark):
    """150,000 distinct words on one line, twice, once with an edit; and a part of it elsewhere."""
    base = [f"w{i}" for i in range(150_000)]
    edited = [*base[:70_000], "edit", *base[70_001:]]
    rows = [(1, " ".join(base)), (2, " ".join(edited)), (3, "before " + " ".join(base[1000:1100]) + " behind")]
    got = {r.doc_id: r.n_removed for r in repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: 0, 2: 150_000, 3: 100}
