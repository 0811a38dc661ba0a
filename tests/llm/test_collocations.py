import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkstrata.llm import collocations

SCHEMA = "lang string, text string"
LOWER = str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})


def plain_rows(rows: list[tuple[str | None, str | None]], least: int, top: int) -> list[tuple]:
    f: dict[str, Counter] = {}
    n: Counter = Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\x0a-\x0d]", (text or "").translate(LOWER)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for d in range(1, 5):
                f.setdefault(lang, Counter()).update(tuple(w[i : i + d]) for i in range(len(w) - d + 1))
    out = []
    for lang, own in f.items():
        candidates = {p: a for p, a in own.items() if len(p) >= 2 and a >= least}
        kept = []
        for p, a in candidates.items():
            inside = lambda q: any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1))
            if any(len(q) > len(p) and 100 * b >= 80 * a and inside(q) for q, b in candidates.items()):
                continue
            score, _, l, r = min((2_000_000 * a // (own[p[:k]] + own[p[k:]]), k, own[p[:k]], own[p[k:]]) for k in range(1, len(p)))
            kept.append((-score, -a, " ".join(p).encode(), l, r))
        out += [(lang, k, p.decode(), -a, l, r, n[lang], -score) for k, (score, a, p, l, r) in enumerate(sorted(kept)[:top], 1)]
    return sorted(out)


def rows(seed: int, n: int) -> list[tuple[str | None, str | None]]:
    r = random.Random(seed)
    stock = ["The", "the", "of", "é", "É", "new", "york", "city", "hall", "a b", "▁", "x\x00", "zürich", "中文"]
    out: list[tuple[str | None, str | None]] = []
    for _ in range(n):
        text = ""
        for _ in range(r.randrange(40)):
            text += r.choice([" ", " ", "  ", "\t", ", ", ".", "\n", "\r\n", "\x0b", "!?"]) if r.random() < 0.3 else " "
            text += "New York City hall" if r.random() < 0.1 else r.choice(stock)
        out.append((r.choice(["en", "en", "en", "de", None, "und", ""]), text))
    return out + [(None, None), ("en", ""), ("xx", None), ("en", " \t\n.,"), ("de", "the of " * 3000)] + [("en", "same words here again.")] * 12


@pytest.mark.parametrize("cut", [False, True])
def test_collocations_against_brute_force(spark, monkeypatch, cut):
    if cut:
        for name, value in (("SHARD_WORDS", 150), ("RANGE_PATHS", 60), ("SAMPLE", 1)):
            monkeypatch.setattr(collocations, name, value)
    own = rows(3, 150)
    df = spark.createDataFrame(own, SCHEMA).repartition(6).withColumns({"doc_id": F.lit(None), "n": F.lit("clash"), "h1": F.lit("clash"), "f": F.lit(0), "a.b": F.lit(1)})
    out = collocations.collocations(df, 5, 80, 40)
    assert out.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(map(tuple, out.collect())) == plain_rows(own, 5, 40)
    if cut:
        tries = collocations.shards(df)
        assert any(len(codes) for codes, _ in collocations.common_prefixes(tries))


def test_collocations_of_nothing(spark):
    assert collocations.collocations(spark.createDataFrame([], SCHEMA)).count() == 0
    assert collocations.collocations(spark.createDataFrame([("en", None), (None, ""), ("en", "two words")], SCHEMA)).count() == 0


def test_trie_round_trip():
    r = np.random.default_rng(4)
    for n in (1, 2, 50, 4000):
        numbers = r.integers(0, 7, n + 1)
        numbers[-1] = 0
        columns, counts = collocations.sorted_paths(collocations.paths(numbers, len(numbers)))
        plain = Counter()
        for i in np.flatnonzero(numbers):
            path = numbers[i : i + 4].tolist()
            end = path.index(0) if 0 in path else 4
            plain[tuple(path[:end] + [0] * (4 - end))] += 1
        assert dict(zip(map(tuple, columns.T.tolist()), counts.tolist())) == dict(plain)
        assert list(map(tuple, columns.T.tolist())) == sorted(plain)
        if not counts.size:
            continue
        hashes = np.arange(100, 107, dtype=np.uint64) << np.uint64(40)
        names = [b"w%d" % k for k in range(7)]
        own, times, found, first = collocations.read_trie(collocations.serialised(columns, counts, hashes, names))
        assert (found[own] == hashes[columns]).all() and (times == counts).all()
        assert first == [names[w] for w in np.unique(columns[0])]
