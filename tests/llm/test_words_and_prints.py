"""Operators 11 to 13 on small and awkward inputs, against brute force."""

from __future__ import annotations

import hashlib
import itertools
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow.parquet as pq
import pytest
import xxhash
from pyspark.sql import functions as F

from quernstone.llm import fill_middle, fingerprints, queries, spelling
from quernstone.llm.common import WordHash, grams, written

SMALL = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string"


def sha(x) -> str:
    return hashlib.sha256(x if isinstance(x, bytes) else x.encode()).hexdigest()


def table(spark, rows, name="rows"):
    """The rows with columns whose names clash with those that operators use inside."""
    clash = ["id", "word", "n", "key", "a", "b", "at", "form", "root", "text_", "next", "next_id", "need", "of", "part", "head", "bands", "tokens", "h1", "lead", "component", "output"]
    d = spark.createDataFrame(rows, SCHEMA).repartition(3)
    return written(d.select("*", *[F.lit("v").alias(c) for c in clash]), name)


# --- operator 11 ---


def near(a: str, b: str) -> bool:
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    if len(a) < len(b):
        a, b = b, a
    return len(a) == len(b) + 1 and any(a[:i] + a[i + 1 :] == b for i in range(len(a)))


def brute_variants(rows):
    count = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % 199 == 0:
                i = h % len(run)
                run = run[:i] + run[i + 1 :]
            if len(run) >= 6:
                count[run] += 1
    count = {w: n for w, n in count.items() if n >= 5}
    around = {w: [] for w in count}
    for a, b in itertools.combinations(count, 2):
        if near(a, b):
            around[a].append(b)
            around[b].append(a)
    form = {}
    for w, others in around.items():
        best = min(others, key=lambda o: (-count[o], o), default=None)
        form[w] = best if best is not None and count[best] >= 5 * count[w] else None
    out = []
    for w, n in count.items():
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, form[w], root, n, len(around[w]), count.get(form[w])))
    return sorted(out)


def variant_rows(df):
    return sorted((r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in df.collect())


def noisy(seed: int) -> list:
    """Texts of words with one to three edits, frequent ones and chains among them."""
    r = random.Random(seed)
    bases = ["kitten", "mittens", "Straße", "aaaaaaa", "ababab", "garçon", "ÀÉÎÕÜÿ", "naïveté", "zzzzzzzz", "abcdefgh"]
    letters = "abkÉéÿßzt"
    rows = []
    for doc in range(60):
        out = []
        for _ in range(80):
            w = r.choice(bases[: 1 + doc % len(bases)])
            for _ in range(r.choice([0, 0, 0, 0, 0, 0, 1, 1, 2])):
                i = r.randrange(len(w))
                w = r.choice([w[:i] + w[i + 1 :], w[:i] + r.choice(letters) + w[i + 1 :], w[:i] + r.choice(letters) + w[i:]])
            out.append(r.choice([w, w, w.upper() if w.isascii() else w]))
        rows.append((doc, r.choice([" ", "-", "1", "\n"]).join(out)))
    return [*rows, (1000, "garden " * 150 + "gardem " * 30 + "gerdem " * 6)]


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_variants_match_brute_force(spark, seed):
    rows = noisy(seed)
    want = brute_variants(rows)
    assert any(f for _, f, _, _, _, _ in want) and any(r != (f or w) for w, f, r, _, _, _ in want)
    assert variant_rows(spelling.variants(table(spark, rows))) == want


def test_variants_of_awkward_rows(spark):
    long = "x" * 30_000
    rows = [(1, None), (2, ""), (3, "abc de"), (None, "wonder " * 5), (None, "wonder wander"), (4, "wander " * 4), (4, "wander " * 4), (5, f"{long} " * 5), (6, f"{long}x {long}x " * 3), (7, f"{long[:-1]}y " * 40)]
    got = {w if len(w) < 20 else (len(w), w[-1]): (f and len(f), len(root), n, k, m) for w, f, root, n, k, m in variant_rows(spelling.variants(table(spark, rows)))}
    want = {w if len(w) < 20 else (len(w), w[-1]): (f and len(f), len(root), n, k, m) for w, f, root, n, k, m in brute_variants(rows)}
    assert got == want and len(got) >= 4
    assert variant_rows(spelling.variants(table(spark, rows).limit(0))) == []
    assert variant_rows(spelling.variants(table(spark, [(1, "aaaaab aaaaac"), (2, None)]))) == []


def test_ties_of_forms_go_to_the_smallest_word(spark):
    rows = [(1, "planet " * 5 + "plaMet " * 30 + "plamet plabet " + "plabet " * 29 + "plabet " + "ÿlanet " * 31)]
    assert variant_rows(spelling.variants(table(spark, rows))) == brute_variants(rows)


def test_roots_double_their_distance(spark):
    steps = [(i, i + 1) for i in range(37)] + [(100 + i, 20) for i in range(50)]
    got = {r.id: r.root_id for r in spelling.roots(spark.createDataFrame(steps, "id long, form_id long")).collect()}
    assert got == {i: 37 for i, _ in steps}


def test_deletions_are_those_of_the_strings():
    for w in ["aab", "kitten", "aaaaaa", "ÿÿàb", "a"]:
        keys, first, last = spelling.deletions(w)
        assert keys[0] == spelling.deletions(w + "b" if w[-1] != "b" else w + "c")[0][-1]  # a deletion at the end gives the word
        assert len(set(keys[1:].tolist())) == len({w[:i] + w[i + 1 :] for i in range(len(w))}) == len(first) - 1
        assert all(len(set(w[a : b + 1])) == 1 for a, b in zip(first[1:], last[1:], strict=True))


def test_spelling_query_is_the_brute_force(spark):
    t = pq.read_table(f"{SMALL}/documents.parquet").to_pydict()
    assert variant_rows(queries.QUERIES["op11_spelling_variants"](spark, SMALL)) == brute_variants(zip(t["doc_id"], t["text"], strict=True))


# --- operator 12 ---

TEXTS = [None, "", "a", "ab", "\r\n\t\x00", "é\U0001f600 x", "has <M> mark", "almost <S <P <", "<" * 9, "S>P>M>" * 40, "w\n" * 3000, "é" * 1024, "é" * 1025, "\U0001f600" * 2047, "x" * 200_000]


def brute_middle(doc, text):
    text = text or ""
    n = len(text)
    d = hashlib.sha256(f"1:{'' if doc is None else doc}".encode()).hexdigest()
    h = [int(d[8 * i : 8 * i + 8], 16) for i in range(4)]
    low, high = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = text[:low], text[low:high], text[high:]
    if not text or h[2] % 100 >= 90 or re.search("<[PSM]>", text):
        return doc, n, "plain", None, None, sha(text), sha(text)
    out = f"<S>{s}<P>{p}<M>{m}" if h[3] % 100 < 20 else f"<P>{p}<S>{s}<M>{m}"
    return doc, n, "spm" if h[3] % 100 < 20 else "psm", low, high - low, sha(out), sha(text)


def test_fill_in_middle_matches_brute_force(spark):
    rows = [(i * len(TEXTS) + j, t) for i in range(12) for j, t in enumerate(TEXTS)] + [(None, "no id"), (5, "twice"), (5, "twice")]
    df = fill_middle.fill_in_middle(table(spark, rows))
    whole = fill_middle.restored(F.col("output"), F.col("form"))
    got = [tuple(r) for r in df.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256), F.sha2(whole, 256)).collect()]
    want = [brute_middle(*r) for r in rows]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert {r[2] for r in want} == {"plain", "psm", "spm"}
    assert fill_middle.fill_in_middle(table(spark, rows).limit(0)).collect() == []


def test_places_in_blocks_are_those_of_the_whole():
    for text in ["", "a", "é\n" * 511, "é\n" * 512, "é\n" * 513, "\U0001f600a\r\n" * 700]:
        at = fill_middle.offsets(text, fill_middle.CODE_POINT)
        n, end = fill_middle.places(text)
        assert n == len(at) == len(text)
        assert [end(k) for k in range(n + 1)] == [0] + [b for _, b in at]


def test_units_of_another_pattern():
    n, end = fill_middle.places("un deux  trois", r"\S+|\s+")
    assert (n, [end(k) for k in range(6)]) == (5, [0, 2, 3, 7, 9, 14])
    assert fill_middle.cut(3, "un deux", r"\w+")[0] == 3


# --- operator 13 ---


def brute_shingles(text) -> set:
    w = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute_print(text) -> str:
    """The signature by Python's own integers, over the library's word hashes."""
    w = WordHash()((text or "").encode().lower())
    if not len(w):
        return ""
    out = ""
    for a, b in zip(fingerprints.A.tolist(), fingerprints.B.tolist(), strict=True):
        m = min((a * int(x) + b) % (1 << 64) for x in grams(w, min(5, len(w))))
        m ^= m >> 31
        m = m * 0x9E3779B97F4A7C15 % (1 << 64)
        out += f"{(m ^ m >> 29) >> 48:04x}"
    return out


def brute_edits(rows):
    first = {}
    for i, t in rows:
        if i is not None:
            h = xxhash.xxh64((t or "").encode(), seed=42).intdigest()
            first[i] = min(first.get(i, (1 << 63, "")), (h - (1 << 64) * (h >> 63), t or ""))
    ids = sorted(first)
    after = dict(zip(ids, ids[1:] + ids[:1], strict=True))
    out = []
    for i, t in rows:
        t = t or ""
        n, nxt = len(t) // 4, first[after[i]][1] if i is not None else ""
        other = t[: len(t) - n] + nxt[:n]
        a, b, c = brute_print(t), brute_print(other), brute_print(nxt)
        out.append((i, len(t), sha(other), a, b, alike(a, b), alike(a, c) if i is not None else None))
    return sorted(out, key=str)


def alike(a, b):
    if not a or not b:
        return float(a == b)
    return sum(a[k : k + 4] == b[k : k + 4] for k in range(0, 512, 4)) / 128


def some_words(n, seed):
    r = random.Random(seed)
    return " ".join(r.choice(["Alpha", "beta", "gamma", "été", "Ω"]) + str(r.randrange(60)) for _ in range(n))


LONG = some_words(120, 1)
PRINT_ROWS = [(9, LONG), (2, None), (3, ""), (4, " \n"), (11, LONG), (11, some_words(40, 2)), (11, some_words(40, 2)), (5, "one"), (6, "one two three"), (7, "é" * 7), (30, some_words(3000, 3)), (12, LONG.replace("1", "2", 1)), (None, LONG), (None, None), (8, LONG.upper().replace("ÉTÉ", "été").replace("Ω", "Ω"))]


def test_edits_match_brute_force(spark):
    got = [tuple(r) for r in fingerprints.edits(table(spark, PRINT_ROWS)).collect()]
    assert sorted(got, key=str) == brute_edits(PRINT_ROWS)
    assert fingerprints.edits(table(spark, PRINT_ROWS).limit(0)).collect() == []
    assert sorted(tuple(r) for r in fingerprints.edits(table(spark, [(1, LONG)])).collect()) == brute_edits([(1, LONG)])


def test_fingerprint_query_edits_as_brute_force(spark):
    t = pq.read_table(f"{SMALL}/documents.parquet").to_pydict()
    rows = sorted(zip(t["doc_id"], [x or "" for x in t["text"]], strict=True))
    got = {r.doc_id: r for r in queries.QUERIES["op13_fingerprints"](spark, SMALL).collect()}
    assert len(got) == len(rows)
    errors = []
    for (i, x), (j, y) in zip(rows, rows[1:] + rows[:1], strict=True):
        n = len(x) // 4
        other = x[: len(x) - n] + y[:n]
        assert (got[i].n_chars, got[i].edited_sha256) == (len(x), sha(other))
        assert got[i].near_next == alike(got[i].fingerprint, got[j].fingerprint)
        a, b = brute_shingles(x), brute_shingles(other)
        if a and b:
            errors.append(got[i].near_edited - len(a & b) / len(a | b))
    assert abs(np.mean(errors)) < 0.01 and np.sqrt(np.mean(np.square(errors))) < 0.05


def test_classes_against_brute_force(spark):
    t = pq.read_table(f"{SMALL}/documents.parquet").to_pydict()
    rows = list(zip(t["doc_id"], t["text"], strict=True))
    r = random.Random(5)
    top = max(t["doc_id"])
    base = [x for _, x in rows if x and 60 < len(x.split()) < 400][:12]
    for k, x in enumerate(base):  # near copies, some of which link only by way of others
        w = x.split()
        for j in range(12):
            w = list(w)
            w[r.randrange(len(w))] = f"new{j}"
            rows.append((top + 1 + 12 * k + j, " ".join(w)))
    sets = {i: brute_shingles(x) for i, x in rows}
    least = {i: i for i in sets}

    def find(x):
        while least[x] != x:
            x = least[x]
        return x

    links = [(a, b) for a, b in itertools.combinations(sorted(sets), 2) if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    for a, b in links:
        a, b = sorted((find(a), find(b)))
        least[b] = a
    got = {x.doc_id: x.class_id for x in fingerprints.classes(table(spark, rows)).collect()}
    assert set(got) == set(sets) and all(got[x] <= x for x in got)
    assert sum(got[a] == got[b] for a, b in links) >= 0.95 * len(links)
    assert all(find(x) == find(got[x]) for x in got)  # what is joined is linked
    assert fingerprints.classes(table(spark, rows).limit(0)).collect() == []


def test_classes_of_awkward_rows(spark):
    got = sorted((r.doc_id, r.class_id) for r in fingerprints.classes(table(spark, [x for x in PRINT_ROWS if x[0] is not None])).collect())
    assert dict(got)[9] == 8 and dict(got)[12] == 8 and dict(got)[2] == 2 and dict(got)[4] == 4
    assert len(got) == len({i for i, _ in PRINT_ROWS if i is not None})
