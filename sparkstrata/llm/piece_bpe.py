"""Exact SentencePiece BPE encoding by backtracking over longest matches.

A piece sequence is the BPE encoding of a text exactly if every two adjacent
pieces are what merging their joined text gives. So the encoder goes from left
to right, takes the longest piece that matches (an Aho-Corasick automaton finds
all matches in one scan) and is compatible with the piece before, and steps back
where none is; a bit for each position remembers that no encoding goes on from
there. Compatibility is decided by re-merging the two pieces and kept.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from sparkstrata.llm.common import arrow_schema, id_text, record_batch, sliced

#: The mark that stands for a blank in pieces (fixed value of the library).
BLANK = "▁"
#: A worker keeps the ids of so many chunks.
CACHE_CHUNKS = 700_000
#: A chunk that ends in a letter, and the marks after it.
LETTERS_AND_MARKS = re.compile(r"(.*[^\W\d_])([!-/:-@\[-`{-~]+)")
#: Chunks that merges never cross: no piece has a blank after another character, and none has a line end.
CHUNK = re.compile(r" +[^ \n]*|[^ \n]+|\n")


class Chunks(dict):
    """(decimal ids, decoded bytes) of chunks; those that aren't there yet are encoded when asked for."""

    def __init__(self, encoder: "PieceEncoder"):
        self.encoder = encoder

    def __missing__(self, chunk: str) -> tuple[bytes, bytes]:
        x = self.encoder.joined(chunk)
        if x is None:
            ids = self.encoder.chunk_ids(chunk)
            x = " ".join(map(str, ids)).encode(), self.encoder.chunk_bytes(ids)
        if len(self) < CACHE_CHUNKS and len(chunk) <= 64:
            self[chunk] = x
        return x


class PieceEncoder:
    def __init__(self, path: str):
        import ahocorasick
        from sentencepiece import SentencePieceProcessor

        model = SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        self.pieces = [model.id_to_piece(i) for i in range(n)]
        self.eos = model.eos_id()
        self.bytes = {int(self.pieces[i][3:5], 16): i for i in range(n) if model.is_byte(i)}
        plain = [i for i in range(n) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
        self.ids = {self.pieces[i]: i for i in plain}
        self.scores = {self.pieces[i]: model.get_score(i) for i in plain}
        if any(BLANK in p.lstrip(BLANK) or "\n" in p for p in self.ids):
            raise ValueError("pieces with inner blanks or line ends need other chunks")
        self.known = {p for p in self.ids if len(p) == 1}
        self.fits: dict[int, bool] = {}
        self.cache = Chunks(self)
        self.automaton = ahocorasick.Automaton()
        for p, i in self.ids.items():
            if self.remerge(p) == [i]:  # other pieces can't come out of merges
                self.automaton.add_word(p, (i, len(p)))
        self.automaton.make_automaton()

    def remerge(self, text: str) -> list[int]:
        """The encoding of known characters by merging: the best score first, of equal scores the leftmost."""
        parts: list[str] = list(text)
        after = list(range(1, len(parts) + 1))
        before = list(range(-1, len(parts) - 1))
        scores, heap = self.scores, []

        def offer(a: int, b: int) -> None:
            whole = parts[a] + parts[b]
            if (score := scores.get(whole)) is not None:
                heapq.heappush(heap, (-score, a, b, whole))

        for a in range(len(parts) - 1):
            offer(a, a + 1)
        while heap:
            _, a, b, whole = heapq.heappop(heap)
            if not parts[a] or not parts[b] or after[a] != b or parts[a] + parts[b] != whole:
                continue
            parts[a], parts[b] = whole, ""
            after[a] = c = after[b]
            if c < len(parts):
                before[c] = a
                offer(a, c)
            if before[a] >= 0:
                offer(before[a], a)
        return [self.ids[p] for p in parts if p]

    def compatible(self, a: int, b: int) -> bool:
        key = a << 32 | b
        found = self.fits.get(key)
        if found is None:
            if len(self.fits) > 1_000_000:
                self.fits.clear()
            found = self.fits[key] = self.remerge(self.pieces[a] + self.pieces[b]) == [a, b]
        return found

    def backtrack(self, text: str) -> list[int]:
        """The encoding of known characters with at most one blank, at the start."""
        n = len(text)
        match: list[list[tuple[int, int]]] = [[] for _ in range(n)]
        for end, found in self.automaton.iter(text):
            match[end - found[1] + 1].append(found)  # the longest comes last
        out: list[int] = []
        tried: list[int] = []
        failed, at, k = 0, 0, len(match[0]) - 1
        while at < n:
            options = match[at]
            while k >= 0:
                piece, length = options[k]
                if not failed >> (at + length) & 1 and (not out or self.compatible(out[-1], piece)):
                    break
                k -= 1
            if k >= 0:
                out.append(piece)
                tried.append(k)
                at += length
                k = len(match[at]) - 1 if at < n else -1
            else:
                failed |= 1 << at
                at -= len(self.pieces[out.pop()])
                k = tried.pop() - 1
        return out

    def chunk_ids(self, chunk: str) -> list[int]:
        """The ids of one chunk, blanks written as blanks."""
        text = chunk.replace(" ", BLANK)
        known = self.known
        encode = self.remerge if text.startswith(BLANK * 2) else self.backtrack
        if known.issuperset(text):
            return encode(text)
        out: list[int] = []
        start = 0
        for k, c in enumerate(text):
            if c not in known:
                if k > start:
                    out += encode(text[start:k])
                out += [self.bytes[x] for x in c.encode()]
                start = k + 1
                encode = self.backtrack
        return out + encode(text[start:]) if start < len(text) else out

    def chunk_bytes(self, ids: list[int]) -> bytes:
        """What ids decode to, as UTF-8."""
        names = self.pieces
        lone = {i: bytes([x]) for x, i in self.bytes.items()} if not hasattr(self, "lone") else self.lone
        self.lone = lone
        return b"".join(lone.get(i) or names[i].replace(BLANK, " ").encode() for i in ids)

    def parts(self, text: str) -> list[tuple[bytes, bytes]]:
        """(decimal ids, decoded bytes) of each chunk of a text, which gets a leading blank as the library gives it."""
        if not text:
            return []
        return list(map(self.cache.__getitem__, CHUNK.findall(" " + text.replace(BLANK, " "))))

    def joined(self, chunk: str) -> tuple[bytes, bytes] | None:
        """What a chunk's letters and the marks after them give together, if the pieces where they meet are compatible."""
        m = LETTERS_AND_MARKS.fullmatch(chunk)
        if not m or chunk.startswith("  "):
            return None
        (a, x), (b, y) = self.cache[m[1]], self.cache[m[2]]
        if self.compatible(int(a.rsplit(b" ", 1)[-1]), int(b.split(b" ", 1)[0])):
            return a + b" " + b, x + y
        return None

    def encode(self, text: str) -> list[int]:
        """All ids of a text, with the end id."""
        return [int(i) for p in self.parts(text) for i in p[0].split()] + [self.eos]

    def decode(self, ids: list[int]) -> str:
        """The text of ids: control ids give nothing, the blank that encoding puts first is taken away."""
        text = self.chunk_bytes([i for i in ids if i in self._plain()]).decode(errors="replace")
        return text[1:] if text.startswith(" ") else text

    def _plain(self) -> set[int]:
        if not hasattr(self, "plain"):
            self.plain = set(self.ids.values()) | set(self.bytes.values())
        return self.plain


ENCODERS: dict[str, PieceEncoder] = {}


def piece_encoder(path: str) -> PieceEncoder:
    """The encoder of a model file, one for each worker process."""
    if path not in ENCODERS:
        ENCODERS[path] = PieceEncoder(path)
    return ENCODERS[path]


def encode_documents(docs: DataFrame, model: str) -> DataFrame:
    """(doc_id, ids): the ids of every whole text with the end id; null text is empty and gives the end id alone."""
    schema = "doc_id long, ids array<int>"
    arrow = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = piece_encoder(model)
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                yield record_batch({"doc_id": part.column("doc_id"), "ids": [own.encode(t) for t in part.column("text").to_pylist()]}, arrow)

    return id_text(docs).mapInArrow(run, schema)


def encode_digest(docs: DataFrame, model: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of every whole text, as `encode_documents` and decoding give them.

    Null text is empty; rows without doc_id and repeated rows are encoded as any
    other; no rows give no rows.
    """
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    arrow = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = piece_encoder(model)
        sha256 = hashlib.sha256
        end = str(own.eos).encode()
        for b in sliced(batches):
            rows = []
            for d, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist()):
                found = own.parts(text)
                ids = b" ".join([x for x, _ in found] + [end])
                decoded = b"".join([x for _, x in found])
                rows.append((d, ids.count(b" ") + 1, sha256(ids).hexdigest(), sha256(decoded[1:]).hexdigest()))
            if rows:
                yield record_batch(dict(zip(arrow.names, zip(*rows))), arrow)

    return id_text(docs).mapInArrow(run, schema)
