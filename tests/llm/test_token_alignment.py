import hashlib
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from sparkstrata.llm import token_alignment

public_tokenizers = pytest.importorskip("public_tokenizers")
A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
SCHEMA = "doc_id long, text string"
LETTERS = [*"aabcdeTHE'  \t\n\n.,;!?()-_0123é中文ß 　\r▁😀<|>", "the", "ing", " and", "<|endoftext|>", "</s>", "'ll", " ", "\x1c", "\x00"]


def plain_ends(parts: list[bytes]) -> list[int]:
    out, at = [], 0
    for x in parts:
        at += len(x)
        out.append(at)
    return out


def plain_alignment(own: token_alignment.Aligner, text: str | None) -> tuple[int, int, list[str], list[tuple[int, int]]]:
    """Tokens, groups and links of a whole text by the libraries, without chunks."""
    whole = " " + (text or "")
    a, b = (own.a.encode(whole, add_special_tokens=False).ids, own.b.encode(text)) if text else ([], [])
    a_parts, b_parts = [own.a_bytes[i] for i in a], [own.b_bytes[i] for i in b]
    if not text or b"".join(a_parts) != whole.encode() or b"".join(b_parts) != whole.encode():
        return 0, 0, [], []
    a_ends, b_ends = plain_ends(a_parts), plain_ends(b_parts)
    links = [(a[x], b[y]) for x, p in enumerate(a_ends) for y, q in enumerate(b_ends) if p == q]
    groups, i, j = [], 0, 0
    for end in sorted({*a_ends} & {*b_ends}):
        x, y = a_ends.index(end) + 1, b_ends.index(end) + 1
        groups.append(",".join(map(str, a[i:x])) + "|" + ",".join(map(str, b[j:y])))
        i, j = x, y
    return len(a), len(b), groups, links


def plain_rows(rows: list[tuple[int | None, str | None]]) -> list[tuple]:
    own = token_alignment.aligner(A, B)
    found = [(d, *plain_alignment(own, t)) for d, t in rows]
    count = Counter(x for *_, links in found for x in links)
    best: dict[int, int] = {}
    for (_, b), n in count.items():
        best[b] = max(best.get(b, 0), n)
    return [
        (d, n_a, n_b, len(groups), len(links), sum(count[x] == best[x[1]] for x in links), sum(count[x] for x in links), hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else "")
        for d, n_a, n_b, groups, links in found
    ]


def texts() -> list[tuple[int | None, str | None]]:
    r = random.Random(5)
    rows: list[tuple[int | None, str | None]] = [(k, "".join(r.choice(LETTERS) for _ in range(r.randrange(1, 40)))) for k in range(150)]
    rows += [(200, None), (201, ""), (202, " "), (203, "\n"), (204, "a▁b"), (205, "the end " * 700), (206, "x" * 3000), (None, "no id"), (None, None), (7, "again"), (7, "again")]
    return rows


@pytest.mark.parametrize("hand_out", [False, True])
def test_alignment_against_brute_force(spark, monkeypatch, hand_out):
    monkeypatch.setattr(token_alignment, "HELD_PAIRS", 50)
    monkeypatch.setattr(token_alignment, "PASSED_PAIRS", 20)
    rows = texts()
    df = spark.createDataFrame(rows, SCHEMA).repartition(5).withColumns({"n_a": F.lit("clash"), "key": F.lit(1), "keys": F.lit("x"), "a.b": F.lit(2)})
    out = token_alignment.align_documents(df, A, B, hand_out)
    assert out.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert sorted(map(repr, map(tuple, out.collect()))) == sorted(map(repr, plain_rows(rows)))


def test_alignment_of_no_rows_and_of_nulls_only(spark):
    assert token_alignment.align_documents(spark.createDataFrame([], SCHEMA), A, B).count() == 0
    out = token_alignment.align_documents(spark.createDataFrame([(None, None), (1, None)], SCHEMA), A, B)
    assert [tuple(r)[1:] for r in out.collect()] == [(0, 0, 0, 0, 0, 0, "")] * 2


def test_chunks_give_what_whole_texts_give():
    own = token_alignment.aligner(A, B)
    r = random.Random(8)
    for _ in range(3000):
        text = "".join(r.choice(LETTERS) for _ in range(r.randrange(1, 25)))
        n_a, n_b, groups, links = plain_alignment(own, text)
        got = next(own.texts([text.encode()]))
        assert got[:3] == (n_a, n_b, len(groups)), repr(text)
        assert got[4].tolist() == [b << 32 | a for a, b in links], repr(text)


def test_longest_texts_of_hot_pairs(spark):
    rows = [(k, "the " * 400 if k % 3 else f"word{k} the") for k in range(60)]
    out = token_alignment.align_documents(spark.createDataFrame(rows, SCHEMA).repartition(7), A, B)
    assert sorted(map(tuple, out.collect())) == sorted(plain_rows(rows))
