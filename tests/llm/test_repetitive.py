"""Decontamination of repetitive texts: all ways of counting hits agree, within bounded memory."""

from __future__ import annotations

import os
import random
import subprocess
import sys
import time

import pytest

from quernstone.llm import decontaminate as D
from quernstone.llm import jaccard
from quernstone.llm.common import WordHash

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def laid_over(text: list[str], item: list[str]):
    """The best overlap that counts, over every place of a text: (agreeing words, first, last)."""
    best, m = None, len(item)
    need = D.needed(m)
    for start in range(1 - m, len(text)):
        same = [0 <= start + i < len(text) and text[start + i] == item[i] for i in range(m)]
        at = [i for i, x in enumerate(same) if x]
        n, run = len(at), (at[0], at[-1] + 1) if at else (0, 0)
        if n < need:
            score = top = first = 0
            run = (0, 0)
            for i, x in enumerate(same):
                score += 1 if x else -D.PENALTY
                if score <= 0:
                    score, first = 0, i + 1
                elif score > top:
                    top, run = score, (first, i + 1)
            n = sum(same[run[0] : run[1]])
            if n < min(need, D.ENOUGH):
                continue
        if n and (best is None or n > best[0]):
            best = (n, start + run[0], start + run[1] - 1)
    return best


@pytest.mark.parametrize("hits, crowded, window, compared", [(1 << 20, 2, 1 << 18, 1 << 20), (16, 2, 64, 32), (16, 0, 64, 1 << 20), (1, 0, 1 << 18, 1), (64, 1, 300, 256)])
def test_all_ways_of_counting_agree(monkeypatch, hits, crowded, window, compared):
    for name, x in {"AT_ONCE": hits, "CROWDED": crowded, "WINDOW": window, "COMPARED": compared, "SPAN": window // 2}.items():
        monkeypatch.setattr(D, name, x)
    r, hashed = random.Random(hits + crowded), WordHash()
    for _ in range(60):
        words = "abcdefghijklmnopqrstuvwxyz"[: r.choice([1, 2, 3, 6, 26])]
        items = [[r.choice(words) for _ in range(r.randrange(1, 50))] for _ in range(r.randrange(1, 5))]
        text = [r.choice(words) for _ in range(r.randrange(150))]
        if r.random() < 0.5:
            text += [w if r.random() < 0.75 else "zz" for w in r.choice(items)] + [r.choice(words) for _ in range(9)]
        got = D.Block(list(range(len(items))), [" ".join(x) for x in items]).verified(hashed(" ".join(text).encode()))
        # a hit needs a seed, and short items all their words: what has none is not looked at
        want = {k: laid_over(text, x) for k, x in enumerate(items) if len(x) >= 4 or "".join(x) in "".join(text)}
        assert got == [(k, n, len(items[k]), a, b) for k, x in want.items() if x for n, a, b in [x] if len(items[k]) >= 4 or n == len(items[k])]


REPETITIVE = """
import resource
from quernstone.llm.common import WordHash
from quernstone.llm.decontaminate import Block
hashed = WordHash()
for unit in ("word ", "one two ", "a b c d e f g h i j "):
    k = len(unit.split())
    found = Block([1, 2], [unit * (2000 // k), unit * (1000 // k) + "end"]).verified(hashed(unit.encode() * (200_000 // k)))
    assert [x[:3] for x in found] == [(1, 2000, 2000), (2, 1000, 1001)], found
print(resource.getrusage(resource.RUSAGE_SELF).ru_maxrss // 1024)
"""


def test_repetitive_texts_take_bounded_memory():
    env = {**os.environ, "PYTHONPATH": ROOT}
    out = subprocess.run([sys.executable, "-c", REPETITIVE], capture_output=True, text=True, env=env, timeout=120)
    assert out.returncode == 0, out.stderr
    assert int(out.stdout.split()[-1]) < 500


def test_documents_too_long_to_link_by_a_common_part_never_meet(spark):
    """Twenty thousand documents whose only common shingle stands too late in their prefixes: no pairs are made."""
    live = spark.range(20_000).selectExpr("1L AS token", "id AS grp", "20 AS at", "id AS node", "cast(92 + id % 40 AS int) AS n", "0.5D AS w", "id AS c")
    begin = time.time()
    assert jaccard._crossing(live).count() == 0
    assert time.time() - begin < 30  # their pairs would take minutes
    near = spark.range(40).selectExpr("1L AS token", "id AS grp", "0 AS at", "id AS node", "cast(92 + id % 2 AS int) AS n", "0.5D AS w", "id % 4 AS c")
    far = near.selectExpr("token + 1 AS token", "grp", "at", "node", "n", "w", "c")
    want = {(a, b) for a in range(40) for b in range(a + 1, 40) if a % 4 != b % 4}
    assert {(r.a, r.b) for r in jaccard._crossing(near.unionByName(far)).collect()} == want
