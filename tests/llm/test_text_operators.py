"""Line dedup, the Jaccard join and decontamination against brute force."""

import hashlib
import random
import re

import pytest

from quarry.llm.decontaminate import contamination, with_hits
from quarry.llm.jaccard_join import jaccard_groups
from quarry.llm.line_dedup import dedup_lines, drop_duplicate_lines, normal
from quarry.llm.shingles import CharShingles, WordShingles


def prose(seed, n):
    r = random.Random(seed)
    syllables = "an be co de fu ga hi jo ka lo mi no pu ra so tu va we xi zo".split()
    return " ".join("".join(r.choices(syllables, k=r.randint(1, 3))) for _ in range(n))


def edited(text, seed, k):
    r = random.Random(seed)
    w = text.split(" ")
    for i in r.sample(range(len(w)), k):
        w[i] = f"new{r.randint(0, 999)}"
    return " ".join(w)


def root(parent, x):
    while parent[x] != x:
        x = parent[x]
    return x


@pytest.fixture(scope="module")
def corpus():
    base = prose(1, 200)
    docs = [(i, prose(100 + i, 40 + i)) for i in range(20)]
    docs += [(100, base), (101, base), (102, base.upper())] + [(103 + i, edited(base, i, 2)) for i in range(12)] + [(130 + i, edited(base, 50 + i, 12)) for i in range(6)]
    docs += [(200, None), (201, ""), (202, "   \n"), (203, "one"), (204, "ONE"), (205, "one two three"), (206, "one two three"), (207, "x y z w")]
    return docs


def shingles(text, k):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


@pytest.mark.parametrize(("k", "percent"), [(4, 85), (5, 80)])
def test_jaccard_groups_match_brute_force(spark, corpus, k, percent):
    sets = {i: shingles(t, k) for i, t in corpus}
    parent = {i: i for i in sets}
    for a in sets:
        for b in sets:
            o = len(sets[a] & sets[b])
            if a < b and o and 100 * o >= percent * (len(sets[a]) + len(sets[b]) - o):
                x, y = root(parent, a), root(parent, b)
                parent[max(x, y)] = min(x, y)
    df = spark.createDataFrame([(i, t, "extra") for i, t in corpus], "doc_id long, text string, component_id string")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_groups(df, shingle=k, percent=percent, frequent_at=3).collect()}
    assert got == {i: (len(s), root(parent, i)) for i, s in sets.items()}


def substrings(text, k):
    return {text[i : i + k] for i in range(max(1, len(text) - k + 1))}


@pytest.mark.parametrize("k", [1, 2, 3, 5, 8, 13])
def test_hashed_sets_measure_like_sets_of_texts(k):
    texts = [prose(i, 30) for i in range(6)] + [edited(prose(0, 30), 3, 2), "abc", "abcd", "", "aaaaaaaaaaaaaaaaaaaaaaaa", "日本語のテキスト" * 3, "x\ud800y" * 4]
    for kind, sets in ((CharShingles(k), [substrings(t, k) for t in texts]), (WordShingles(k), [shingles(t, k) for t in texts])):
        made = [kind.of(t) for t in texts]
        for x, a in zip(sets, made):
            assert len(x) == len(a) or not x
            for y, b in zip(sets, made):
                assert kind.common(a, b) == len(x & y)
                assert not isinstance(kind, CharShingles) or kind.sizes(texts).tolist() == [len(t) for t in sets]
                added, removed = kind.difference(a, b)
                assert (len(added), len(removed)) == (len(y - x), len(x - y))


def test_jaccard_groups_of_nothing_and_repeats(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert jaccard_groups(empty).count() == 0
    df = spark.createDataFrame([(1, "a b c d e"), (1, "a b c d e"), (None, "a b c d e"), (2, "a b c d e")], "doc_id long, text string")
    assert sorted(tuple(r) for r in jaccard_groups(df).collect()) == [(1, 2, 1), (2, 2, 1)]


def test_line_classes_match_brute_force(spark):
    r = random.Random(3)
    lines = [prose(i, 30) for i in range(40)]
    hub = prose(999, 60)
    lines += [hub] * 4 + [edited(hub, i, 1) for i in range(15)] + [edited(hub, 100 + i, 9) for i in range(10)] + ["short", "SHORT", "  short ", "", "x"]
    r.shuffle(lines)
    docs = [(i, "\n".join(lines[i * 8 : i * 8 + 8])) for i in range(-(-len(lines) // 8))] + [(900, None), (901, "")]
    df = spark.createDataFrame([(i, t, 1) for i, t in docs], "doc_id long, text string, line_no int")
    places = [(i, n, normal(x)) for i, t in docs if t for n, x in enumerate(t.split("\n")) if normal(x)]
    parent = {p[:2]: p[:2] for p in places}
    sets = {p[:2]: substrings(p[2], 8) for p in places}
    for a in parent:
        for b in parent:
            if a < b:
                o = len(sets[a] & sets[b])
                if 100 * o >= 80 * (len(sets[a]) + len(sets[b]) - o):
                    x, y = root(parent, a), root(parent, b)
                    parent[max(x, y)] = min(x, y)
    got = {(x["doc_id"], x["line_no"]): (x["keep_doc_id"], x["keep_line_no"]) for x in dedup_lines(df).collect()}
    assert got == {p: root(parent, p) for p in parent}
    kept = {x["doc_id"]: x["text"] for x in drop_duplicate_lines(df).collect()}
    assert kept[900] is None and kept[901] == ""
    for i, t in docs:
        if t:
            left = [x for n, x in enumerate(t.split("\n")) if not normal(x) or root(parent, (i, n)) == (i, n)]
            assert kept.get(i, "") == ("\n".join(left) if any(x.strip() for x in left) else "")


def test_lines_of_nothing(spark):
    assert dedup_lines(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    assert drop_duplicate_lines(spark.createDataFrame([], "doc_id long, text string, x int")).columns == ["doc_id", "text", "x"]


def brute_hits(text, items, size):
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    low = lambda s: re.sub("[A-Z]", lambda m: m[0].lower(), s or "")
    w = word.findall(low(text))
    hit, found = set(), set()
    for i, t in items:
        iw = word.findall(low(t))
        for s in range(max(1, len(iw) - size + 1)) if iw else ():
            win = iw[s : s + size]
            for p in range(len(w) - len(win) + 1):
                if w[p : p + len(win)] == win:
                    hit.update(range(p, p + len(win)))
                    found.add(str(i))
    return len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)


@pytest.mark.parametrize("max_windows", [500_000, 60])
def test_contamination_matches_brute_force(spark, max_windows):
    items = [(1, prose(1, 30)), (2, "Tiny item"), (10, prose(2, 10)), (3, None), (4, "!!"), (5, prose(1, 30)), (None, prose(3, 12))]
    docs = [
        (1, prose(9, 20) + " " + " ".join(items[0][1].split()[4:19]) + " " + prose(8, 5)),
        (2, "so TINY, item! tiny-item"),
        (3, items[2][1].replace(" ", "\n").upper()),
        (4, None),
        (5, ""),
        (6, prose(77, 300)),
        (6, prose(77, 300)),
        (7, " ".join(items[0][1].split()[:9])),
        (8, "été " + items[0][1] + " ñ"),
        (9, items[6][1]),
    ]
    d = spark.createDataFrame([(i, t, "c") for i, t in docs], "doc_id long, text string, n_hit string")
    b = spark.createDataFrame(items, "item_id long, text string")
    got = sorted(tuple(r) for r in contamination(d, b, max_windows=max_windows).collect())
    known = [x for x in items if x[0] is not None]
    assert got == sorted((i, *brute_hits(t, known, 10)) for i, t in docs)


def test_contamination_of_nothing(spark):
    d = spark.createDataFrame([], "doc_id long, text string")
    b = spark.createDataFrame([], "item_id long, text string")
    assert contamination(d, b).count() == 0
    one = spark.createDataFrame([(1, "a b", 5)], "doc_id long, text string, starts int")
    row = with_hits(one, b).first()
    assert row["starts"] == 5 and row["__hits"]["items"] == []


def test_a_large_benchmark_is_joined_and_long_texts_are_whole(spark):
    items = [(i, prose(7000 + i, 60)) for i in range(40)] + [(100, "qzsolo"), (101, "qztwo words")]
    words = lambda i: items[i][1].split()
    docs = [(1, prose(1, 30_000) + " " + " ".join(words(3)[10:35]) + " " + prose(2, 20_000)), (2, prose(5, 10) + " " + " ".join(words(9)[:10])), (3, " ".join(words(9)[:9])), (4, "QZsolo!"), (5, "qztwo; WORDS two"), (6, None), (6, "")]
    d = spark.createDataFrame([(i, t, "x", 1) for i, t in docs], "doc_id long, text string, __starts string, __text int")
    b = spark.createDataFrame(items, "item_id long, text string")
    small, large = (sorted(tuple(r) for r in contamination(d, b, max_windows=n).collect()) for n in (500_000, 10))
    assert large == small and [x for x in small if x[0] != 1] == sorted((i, *brute_hits(t, items, 10)) for i, t in docs if i != 1)
    assert {i: n for i, _, n, *_ in large if n} == {1: 25, 2: 10, 4: 1, 5: 2}
    kept = with_hits(d, b, max_windows=10)
    assert kept.columns == [*d.columns, "__hits"] and {r["__starts"] for r in kept.collect()} == {"x"}
