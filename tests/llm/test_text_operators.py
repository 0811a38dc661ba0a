import base64
import hashlib
import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from pyspark.sql import functions as F

from sparkstrata.llm import context_mixing, packing, page_difference, piece_bpe, quality_knn, rotation_codes, separator_scan
from sparkstrata.llm.queries import vocabulary


def test_piece_encoding_is_exact():
    import sentencepiece

    own = piece_bpe.PieceEncoder(vocabulary("piece_bpe_32k.model"))
    lib = sentencepiece.SentencePieceProcessor(model_file=vocabulary("piece_bpe_32k.model"))
    r = random.Random(2)
    texts = ["", " ", "   a", "\n", "a  b", "▁", "a▁b", "<s> </s> <0x0A>", "日本語 漢字", "🙂 x", " " * 40 + "x" + " " * 37, "a\x00b", "word\r\nnext", "thethethe" * 50]
    texts += ["".join(r.choice("ab \n▁éxyzthein.,0") for _ in range(r.randint(0, 60))) for _ in range(2000)]
    for t in texts:
        ids = lib.encode(t, add_eos=True)
        assert own.encode(t) == ids, t
        assert own.decode(ids) == lib.decode(ids), t


def test_piece_digest(docs, no_docs):
    import sentencepiece

    lib = sentencepiece.SentencePieceProcessor(model_file=vocabulary("piece_bpe_32k.model"))
    want = []
    for r in docs.collect():
        ids = lib.encode(r.text or "", add_eos=True)
        want.append((str(r.doc_id), len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(lib.decode(ids).encode()).hexdigest()))
    got = piece_bpe.encode_digest(docs, vocabulary("piece_bpe_32k.model")).collect()
    assert sorted((str(r[0]), *r[1:]) for r in got) == sorted(want)
    assert piece_bpe.encode_digest(no_docs, vocabulary("piece_bpe_32k.model")).count() == 0
    assert piece_bpe.encode_documents(docs.where("doc_id = 401"), vocabulary("piece_bpe_32k.model")).first().ids == [lib.eos_id()]


def test_packing(docs, no_docs):
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(vocabulary("word_bpe_49k.json"))
    got = packing.pack_documents(docs, vocabulary("word_bpe_49k.json")).collect()
    want = Counter()
    for r in docs.collect():
        ids = np.array([*lib.encode(r.text or "", add_special_tokens=False).ids, 2], "<u4")
        for s in range(0, len(ids), 4096):
            p = ids[s : s + 4096]
            want[r.doc_id, s, len(p), zlib.crc32(p.tobytes()), len(ids)] += 1
    assert Counter((r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in got) == want
    by = {}
    for r in got:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert sorted(by) == list(range(len(by)))
    for own in by.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 4096
    assert packing.pack_documents(no_docs, vocabulary("word_bpe_49k.json")).count() == 0


@pytest.mark.parametrize("seed", range(4))
def test_plan_uses_each_piece_once_with_little_padding(seed):
    r = np.random.default_rng(seed)
    histogram = np.zeros(65, np.int64)
    for k in np.clip(r.lognormal(2.5, 0.8, 5000).astype(int), 1, 64):
        histogram[k] += 1
    plan = packing.plan(histogram)
    used = np.zeros(65, np.int64)
    for own, n in plan:
        assert sum(own) <= 64 and n > 0
        for k in own:
            used[k] += n
    assert (used == histogram).all()
    assert (histogram * np.arange(65)).sum() / (64 * sum(n for _, n in plan)) > 0.97
    assert packing.plan(np.zeros(65, np.int64)) == []


def test_word_ids_equal_the_library():
    own = packing.WordIds(vocabulary("word_bpe_49k.json"))
    r = random.Random(4)
    texts = ["I'VE they'll.", "<|endoftext|> a<|startoftext|>b", "Σσς İ", "a — b…"] + ["".join(r.choice("abcXYZ '.,!-09éß…—  İΣ<|>'s") for _ in range(r.randint(0, 50))) for _ in range(1500)]
    for t, ids in zip(texts, own.many([t.encode() for t in texts])):
        assert np.frombuffer(ids, "<u4").tolist() == own.tokenizer.encode(t, add_special_tokens=False).ids, t


def test_quality_learns_and_holds_out(spark):
    r = random.Random(6)
    stock = "the river moves over stone and light under the old bridge near a quiet town".split()
    rows, labels = [], []
    for d in range(600):
        good = r.random() < 0.7
        text = " ".join(r.choice(stock) for _ in range(r.randint(20, 80)))
        text = text.capitalize() + "." if good else r.choice([text.upper() + "!!", " ".join(w + "%%%" for w in text.split()), " ".join([stock[d % 10]] * 40), text.replace(" ", " | ")])
        rows.append((d, text))
        labels.append((d, int(good), 0))
    docs = spark.createDataFrame(rows + [(1000, None), (1001, ""), (None, "x")], "doc_id long, text string")
    lab = spark.createDataFrame(labels + [(1001, None, 0), (5000, 1, 0)], "doc_id long, quality int, toxic int")
    got = {x.doc_id: x for x in quality_knn.quality_scores(docs, lab).collect()}
    assert len(got) == 603
    assert all(x.held_out == (zlib.crc32(str(d).encode()) % 3 == 1) for d, x in got.items() if d is not None)
    assert all(0 <= x.score <= 1 and x.predicted == int(x.score >= 0.5) for x in got.values())
    held = [(got[d].predicted, q) for d, q, _ in labels if got[d].held_out]
    assert np.mean([a == b for a, b in held]) > 0.95
    none = quality_knn.quality_scores(docs, lab.limit(0)).collect()
    assert {x.score for x in none} == {0.5}
    assert quality_knn.quality_scores(docs.limit(0), lab).count() == 0


def test_labels_of_held_out_rows_have_no_influence(spark):
    docs = spark.createDataFrame([(d, ("good text here. " if d % 2 else "BAD!! ") * (5 + d % 7)) for d in range(200)], "doc_id long, text string")
    labels = [(d, d % 2) for d in range(200)]
    flipped = [(d, 1 - q if zlib.crc32(str(d).encode()) % 3 == 1 else q) for d, q in labels]
    a, b = ({x.doc_id: x.score for x in quality_knn.quality_scores(docs, spark.createDataFrame(t, "doc_id long, quality int")).collect()} for t in (labels, flipped))
    assert a == b


def plain_links(rows, threshold=0.98):
    def fine(v):
        return v is not None and len(v) and all(x is not None and math.isfinite(x) for x in v) and any(v)

    n = [0] * len(rows)
    near = {k: {k} for k in range(len(rows))}
    for i, (_, v, a) in enumerate(rows):
        for j, (_, w, b) in enumerate(rows[:i]):
            if a is not None and a == b and fine(v) and fine(w) and len(v) == len(w):
                if np.dot(v, w) / math.sqrt(np.dot(v, v) * np.dot(w, w)) >= threshold:
                    n[i] += 1
                    n[j] += 1
                    near[i].add(j)
                    near[j].add(i)
    out = []
    for k in range(len(rows)):
        seen, todo = {k}, [k]
        while todo:
            for x in near[todo.pop()] - seen:
                seen.add(x)
                todo.append(x)
        c = min(rows[x][0] for x in seen)
        out.append((rows[k][0], n[k], c, c == rows[k][0]))
    return sorted(out)


@pytest.mark.parametrize("block", [2048, 7])
def test_embedding_links(spark, block):
    r = np.random.default_rng(8)
    rows, k = [], 0
    for label in (0, 1, None):
        for _ in range(8):
            base = r.standard_normal(16)
            for e in (0, 0, 0.02, 0.05, 0.1, 0.3):
                rows.append((k, (base + e * r.standard_normal(16)).astype(np.float32).tolist(), label))
                k += 1
    rows += [(500, None, 0), (501, [0.0] * 16, 0), (502, [float("nan")] + [1.0] * 15, 0), (503, [], 0), (504, [1.0, 2.0], 0), (505, [2.0, 4.0], 0), (506, [1e30] * 16, 0), (507, [1e-30] * 16, 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(3)
    got = rotation_codes.near_links(df, block=block)
    assert sorted(tuple(x) for x in got.collect()) == plain_links([(a, [np.float64(np.float32(x)) for x in v] if v is not None else None, c) for a, v, c in rows])
    assert rotation_codes.near_links(df.limit(0)).count() == 0


def test_code_bounds_hold():
    r = np.random.default_rng(9)
    x = rotation_codes._unit(r.standard_normal((300, 64)))
    y = rotation_codes._unit(x + 0.1 * r.standard_normal((300, 64)) * r.random((300, 1)))
    codes, factors = rotation_codes.encode(x)
    got, true = np.diag(rotation_codes.estimates(codes, factors, y)), (x * y).sum(axis=1)
    near = true >= 0.98
    assert near.sum() > 50 and (got >= rotation_codes.least_estimate(factors, 0.98))[near].all()
    other = rotation_codes._unit(r.standard_normal((300, 64)))
    assert abs((rotation_codes.estimates(codes, factors, other) - x @ other.T).mean()) < 0.005  # unbiased


def test_separator_scan_of_raw_files(spark, tmp_path):
    r = np.random.default_rng(10)
    want = {}
    for name in ("a", "b"):
        sizes = [0, 5, 0, 130, 3, 64, 63, 1, 0]
        ids = np.concatenate([np.append(r.integers(0, 9, n), 99) for n in sizes] + [r.integers(0, 9, 20)]).astype("<u2")
        ids.tofile(tmp_path / f"{name}.bin")
        at = 0
        for n in sizes:
            want.setdefault(name, []).append((at, n))
            at += n + 1
    np.zeros(0, "<u2").tofile(tmp_path / "empty.bin")
    for block in (16, 64, 1 << 16):
        got = {}
        for x in separator_scan.scan(separator_scan.token_files(spark, str(tmp_path), "<u2", block), 99, "<u2").collect():
            got.setdefault(x.file[-5], []).append((x.start, x.n_tokens))
        assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in want.items()}


def test_token_counts(docs, no_docs):
    import public_tokenizers
    import tiktoken

    with open(vocabulary("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    lib = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = sorted((str(r.doc_id), len(lib.encode_ordinary(r.text or ""))) for r in docs.collect())
    for block in (64, 65_536):
        got = separator_scan.count_documents(docs, vocabulary("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, 50256, block)
        assert sorted((str(r.doc_id), r.n_tokens) for r in got.collect()) == want
    assert separator_scan.count_documents(no_docs, vocabulary("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, 50256).count() == 0


@pytest.mark.parametrize("held", [1 << 18, 5])
def test_language_model(docs, no_docs, monkeypatch, held):
    monkeypatch.setattr(context_mixing, "HELD_WORDS", held)
    rows = [(r.doc_id, (r.text or "").encode().lower().split()) for r in docs.collect()]
    out = lambda d: d is not None and zlib.crc32(str(d).encode()) % 7 == 2
    c = Counter(w for d, t in rows if not out(d) for w in [*t, None])
    n, v = sum(c.values()), len(c)
    want = sorted((str(d), out(d), len(t) + 1, sum(c[w] > 0 for w in [*t, None]), n, round(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in [*t, None]), 6)) for d, t in rows)
    got = context_mixing.score_documents(docs).collect()
    assert sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == want
    assert all(r.score < 0 and r.bits_per_byte >= 0 for r in got)
    assert context_mixing.score_documents(no_docs).count() == 0


def test_language_model_is_a_distribution():
    """Probabilities of the two ends of each decision add up: an adaptive code over a small alphabet sums to at most one."""
    model = context_mixing.Model(np.array([11, 22, 33], np.uint64), np.array([5, 3, 2]), 14, 4, 4)
    model.ready()
    vocabulary_ = context_mixing.Vocabulary(model)
    vocabulary_.leaf, vocabulary_.count, vocabulary_.spelled = np.array([0, 1, 2], np.int32), np.array([5, 3, 2]), np.zeros(3)
    documents = [np.array(x, np.int32) for x in ([], *([a] for a in range(3)), *([a, b] for a in range(3) for b in range(3)))]
    total = sum(math.exp(x) for x in model.log_p(documents, vocabulary_))
    assert 0 < total < 1


def test_short_texts_refine_all_weights(spark, monkeypatch):
    """Tasks of few short documents train the weights too, from every document but a task's first."""
    monkeypatch.setattr(context_mixing, "CODE_WORDS", 20)
    r = random.Random(15)
    stock = [f"word{k}" for k in range(60)]
    docs = spark.createDataFrame([(" ".join(stock[min(r.randrange(60), r.randrange(60))] for _ in range(r.randint(5, 40))),) for _ in range(60)], "text string").coalesce(1)
    model, _ = context_mixing.train(docs, 4)
    fresh = context_mixing.Model(np.array([1], np.uint64), np.array([1]), 2, 2, 1)
    for k in range(context_mixing.N_CONTEXTS):
        assert (model.weights[k] != fresh.weights[k]).sum() >= 4
    assert (model.spelling.weights != fresh.spelling.weights).any(axis=1).sum() >= 6
    model.ready()
    long_ = np.array(r.choices(range(5), k=400), np.int32)
    events, slots, firsts = model.steps(long_, np.arange(400), np.array([0]))
    weights = model.weights.copy()
    model.run(model.stretch, weights, *events, slots, firsts, carry=True)
    assert len(events[0]) > 600 and (weights[-1] != model.weights[-1]).any()


def plain_score(model, text):
    """The score of a text, event by event: the code's bits, the repeats, the spelling."""
    u32, u64 = (1 << 32) - 1, (1 << 64) - 1

    def spread(x):
        x = x * 0x9E3779B1 & u32
        x ^= x >> 15
        x = x * 0x2C1B3C6D & u32
        return x ^ x >> 13

    def mixed(h):
        h ^= h >> 32
        h = h * 0x9E3779B97F4A7C15 & u64
        h ^= h >> 29
        h = h * 0xD6E8FEB86659FD93 & u64
        return h ^ h >> 32

    sigmoid = lambda z: 1 / (1 + math.exp(-z))
    odds = lambda zeros, ones: math.log((ones + 0.4) / (zeros + 0.4))
    words = text.encode().lower().split()
    byte_weight = [mixed(k << 32) | 1 for k in range(1, 257)]
    hashes = [mixed((sum(byte_weight[c] * (mixed(k + 1) | 1) for k, c in enumerate(w)) + len(w)) & u64) for w in words]
    held = {int(h): (int(leaf), int(c)) for h, leaf, c in zip(model.hashes, model.leaves, model.counts)}
    known = [held.get(h, (model.escape, -1)) for h in hashes]
    leaves = [k[0] for k in known] + [model.end]
    same = [False] + [a == b for a, b in zip(words[1:], words)] + [False]
    if not words:
        same = [False]
    total = 0.0
    seen = {False: [0, 0], True: [0, 0]}  # tokens and repeats after what is no repeat, and after a repeat
    after = False
    for x in same:
        n, k = seen[after]
        p = (k + 1) / (n + 2) if after else (k + 1) / (n + 401)
        total += math.log(p if x else 1 - p)
        seen[after][0] += 1
        seen[after][1] += x
        after = x
    events, topic = [], 64
    for k, leaf in enumerate(leaves):
        if not same[k]:
            one = leaves[k - 1] if k else model.end
            two = leaves[k - 2] if k > 1 else model.end
            contexts = [None, one + (1 << 20), one * 8209 + two + (2 << 20), topic + (3 << 20)]
            for depth, at in enumerate(range(model.offsets[leaf], model.offsets[leaf + 1])):
                node = int(model.nodes[at])
                slots = [node if c is None else (spread(c & u32) & context_mixing.SLOTS - 1) ^ (spread(node) & context_mixing.SLOTS - 1) for c in contexts]
                events.append((node, model.signs[at], min(depth, 15) * 2, slots))
        if leaf < 64:
            topic = leaf
    weights = model.weights.astype(float).copy()
    own = {}
    at, block = 0, 32
    while at < len(events):
        errors, gates = [], Counter()
        for node, sign, gate, slots in events[at : at + block]:
            x = [odds(float(model.zeros[k][slot]), float(model.ones[k][slot])) for k, slot in enumerate(slots)]
            zeros, ones = own.get(node, (0.4, 0.4))
            x.append(math.log(ones / zeros) if at else 0.0)
            gate += abs(x[2]) > 1
            z = max(-11.5, min(11.5, sign * sum(w * v for w, v in zip(weights[:, gate], x))))
            total += math.log(sigmoid(z))
            errors.append((gate, (1 - sigmoid(z)) * sign, x))
            gates[gate] += 1
        for gate, e, x in errors:
            weights[: len(x), gate] += np.array(x) * e * 0.02 / math.sqrt(gates[gate] + 16)
        for node, sign, *_ in events[at : at + block]:
            zeros, ones = own.get(node, (0.4, 0.4))
            own[node] = (zeros, ones + 1) if sign > 0 else (zeros + 1, ones)
        at, block = at + block, block * 2
    for k, w in enumerate(words):
        if leaves[k] != model.escape or same[k]:
            continue
        spelled, data = 0.0, b"\0" * 5 + w + b" "
        for j in range(5, len(data)):
            for bit in range(8):
                x = []
                for o in (2, 3, 5):
                    before = sum(data[j - b] << 8 * (b - 1) for b in range(1, o + 1))
                    slot = ((mixed(before + (o << 56) & u64) & u32) ^ spread((data[j] | 256) >> (8 - bit))) & context_mixing.SPELL_SLOTS - 1
                    order = (2, 3, 5).index(o)
                    x.append(odds(float(model.spelling.zeros[order][slot]), float(model.spelling.ones[order][slot])))
                p = min(max(sigmoid(max(-12, min(12, float(np.dot(model.spelling.weights[bit], x))))), 1e-5), 1 - 1e-5)
                spelled += math.log(p if data[j] >> (7 - bit) & 1 else 1 - p)
        share = max(max(known[k][1], 0) - 0.6, 0) / model.rest
        left = max(0.6 * model.rest_kinds / model.rest, 1e-3)
        total += math.log((share + math.exp(spelled) * left) / max(1.0, (model.rest - 0.6 * model.rest_kinds) / model.rest + left))
    return total / math.log(10)


@pytest.mark.parametrize("code", [8190, 12])
def test_scores_equal_a_plain_scorer(spark, docs, monkeypatch, code):
    monkeypatch.setattr(context_mixing, "CODE_WORDS", code)
    own = docs.where("length(coalesce(text, '')) < 6000").withColumn("held_out", F.lit("clash"))
    extra = spark.createDataFrame([(900, "a a a a b b unheard unheard \u00c9lan " * 3), (901, "solitaire" * 40), (902, "?")], "doc_id long, text string")
    own = own.select("doc_id", "text", "held_out").unionByName(extra.withColumn("held_out", F.lit("")))
    model, _ = context_mixing.train(context_mixing.id_text(own).where(~context_mixing.held_out()), 4)
    got = {(x.doc_id, x.n_tokens): x.score for x in context_mixing.score_documents(own).collect()}
    assert len(got) > 50
    for r in own.collect():
        score = got[r.doc_id, len((r.text or "").encode().split()) + 1]
        assert abs(plain_score(model, r.text or "") - score) < 1e-3 * max(1, abs(score)), (r.doc_id, r.text)


def test_second_word_before_decides():
    """A word that only the two words before tell: their predictor alone sees it."""
    model = context_mixing.Model(np.array([11, 22, 33, 44], np.uint64), np.array([9, 9, 9, 9]), 40, 5, 4)
    leaves = np.array([0, 2, 3, model.end, 1, 2, 3, model.end])
    (node, _, _), slots, _ = model.steps(leaves, np.array([0, 2, 3, -1, 1, 2, 3, -2]), np.array([0, 4]))
    third = [sum(model.offsets[x + 1] - model.offsets[x] for x in leaves[:k]) for k in (2, 6)]
    a, b = int(third[0]), int(third[1])
    assert node[a] == node[b] and slots[1][a] == slots[1][b]
    assert slots[2][a] != slots[2][b]
    assert len(model.weights) == 5 and context_mixing.CODE_WORDS >= 8190


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body><nav><ul><li><a href="/a">Menu</a></ul></nav>
<!-- ad --><div class="ad">Buy &amp; save</div><div id="cookie-notice">We use cookies</div><div class="layout has-sidebar"><article class="post"><h1>Title &eacute;</h1>
<p>First <b>bold</b>&nbsp;text<br>goes
on<p>Second &lt;tag&gt;<form><input>Send</form></article><aside>Side</aside><section class="comments"><p>Nice!</p></section></div><footer>&copy; x</footer></body></html>"""


def test_article_of_a_page(spark):
    got = page_difference.extract(spark.createDataFrame([(1, "http://h/a", PAGE), (2, None, None), (3, "bad url", "<p>x"), (4, "http://h/b", "")], "page_id long, url string, html string")).collect()
    texts = {r.page_id: r.text for r in got}
    assert texts == {1: "Title é\n\nFirst bold text goes on\n\nSecond <tag>", 2: "", 3: "x", 4: ""}
    assert {r.page_id: r.n_chars for r in got} == {k: len(v) for k, v in texts.items()}


def test_shared_lines_of_unmarked_pages_go(spark):
    page = lambda body: f"<html><body><div>Site name</div><div><p>{body}</p></div><div>All rights</div></body></html>"
    rows = [(k, f"http://h/x/{k}", page(f"Story number {k} with words")) for k in range(6)] + [(9, "http://other/x/1", page("Lone"))]
    got = {r.page_id: r.text for r in page_difference.extract(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)).collect()}
    assert got == {k: f"Story number {k} with words" for k in range(6)} | {9: "Site name\n\nLone\n\nAll rights"}


def test_runs_of_one_path_have_partners(spark):
    page = lambda body: f"<html><body><div>Site name</div><div><p>{body}</p></div><div>All rights</div></body></html>"
    urls = ["http://h/a", *["http://h/m"] * 600, "http://h/z", *[f"http://q/list?page={k}" for k in range(5)], *["http://lone/x"] * 3]
    rows = [(k, u, page(f"Story number {k} with words")) for k, u in enumerate(urls)]
    got = {r.page_id: r.text for r in page_difference.extract(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)).collect()}
    story = {k: f"Story number {k} with words" for k in range(len(urls))}
    assert got == {k: f"Site name\n\n{t}\n\nAll rights" if "lone" in urls[k] else t for k, t in story.items()}


def test_extraction_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(page_difference, "WAITING", 3)
    r = random.Random(31)
    frame = [f"Frame line {k}" for k in range(6)]
    rows, plain = [], []
    for k in range(240):
        host = r.choice(["a", "b", "c", "one"]) if k else "lonely"
        path = "/hot" if host == "one" and r.random() < 0.9 else f"/{r.choice('xyz')}/{r.randrange(12)}"
        body = sorted(r.sample(frame, r.randrange(5))) + [f"Own line {k} {j}" for j in range(r.randrange(3))]
        marked = r.random() < 0.2
        html = "".join(f"<div>{x}</div>" for x in body)
        rows.append((k, f"http://{host}{path}", f"<body><article>{html}</article></body>" if marked else f"<body>{html}<nav>Menu</nav></body>"))
        plain.append((host, path, k, body, marked))
    got = {x.page_id: x.text for x in page_difference.extract(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(5)).collect()}
    order = sorted(plain)
    for n, (host, path, k, body, marked) in enumerate(order):
        near = [next((x for x in side if x[1] != path), None) for side in ([x for x in order[:n][::-1] if x[0] == host], [x for x in order[n + 1 :] if x[0] == host])]
        near = [x for x in near if x]
        same = lambda x: next((i for i, (c, d) in enumerate(zip(x[1], path)) if c != d), min(len(x[1]), len(path)))
        partner = max(near, key=same)[3] + ["Menu"] if near else []
        left = body if marked else [x for x in body if x not in partner]  # both are sorted, so common lines are the shared ones
        assert got[k] == "\n\n".join(left or body), (host, path, k)


def test_extraction_of_hostile_pages(spark):
    schema = "page_id long, url string, html string"
    assert page_difference.extract(spark.createDataFrame([], schema)).count() == 0
    long_ = "<p>" + "word " * 200_000 + "</p>"
    html = {
        1: "<p>a &amp b &#x41; &nosuch; <b>c", 2: "</div></p>tail<p", 3: "<article><p>one<script>never ends", 4: "<!-- never ends <p>x", 5: "a < b and <3 c",
        6: "<article " + "x" * 5000, 7: "<p>\u00a0 \u2003x\ty</p>", 8: long_, 9: "<div>" * 3000 + "deep" + "</div>" * 3000, 10: "<body hidden><p>kept</p>",
    }
    rows = [(k, f"http://h{k}/", t) for k, t in html.items()] + [(7, "http://h7/", html[7])] * 2 + [(None, None, "<p>no id")] * 3
    df = spark.createDataFrame(rows, schema).withColumn("text", F.lit("clash")).withColumn("part", F.lit(9)).withColumn("host", F.lit("clash"))
    out = page_difference.extract(df)
    assert out.columns == ["page_id", "url", "text", "n_chars"]
    got = [(x.page_id, x.text) for x in out.collect()]
    assert len(got) == len(rows) and all(x.n_chars == len(x.text) for x in out.collect())
    texts = dict(got)
    assert texts[1] == "a & b A &nosuch; c" and texts[2].startswith("tail") and texts[3] == "one" and texts[4] == "" and texts[5] == "a < b and <3 c"
    assert texts[7] == "x y" and texts[8] == ("word " * 200_000).strip() and texts[9] == "deep" and texts[10] == "kept" and texts[None] == "no id"


def test_common_lines_is_longest():
    r = random.Random(12)
    for _ in range(300):
        a, b = ([r.randrange(4) for _ in range(r.randrange(9))] for _ in range(2))
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i in range(len(a)):
            for j in range(len(b)):
                table[i + 1][j + 1] = table[i][j] + 1 if a[i] == b[j] else max(table[i][j + 1], table[i + 1][j])
        found = page_difference.common_lines(a, b)
        assert len(found) == table[-1][-1]
        rest = iter(b)
        assert all(a[k] in rest for k in sorted(found))


def test_partner_decides_which_marked_elements_are_the_article(spark):
    page = lambda k: f"<body><div>Site {k}</div><main><div>Section</div><article><h1>Story {k}</h1><p>Shared words</p></article><article><p>Read this too</p></article></main></body>"
    copy = "<body><article><p>Told twice</p></article></body>"
    rows = [(k, f"http://h/x/{k}", page(k)) for k in range(5)] + [(k, f"http://copies/{k}", copy) for k in (7, 8)] + [(9, "http://lone/x", page(9))] * 2
    got = [(r.page_id, r.text) for r in page_difference.extract(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)).collect()]
    assert len(got) == len(rows)
    assert dict(got) == {k: f"Story {k}\n\nShared words" for k in range(5)} | {7: "Told twice", 8: "Told twice", 9: "Section\n\nStory 9\n\nShared words\n\nRead this too"}
