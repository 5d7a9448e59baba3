"""SentencePiece BPE encoding by backtracking, and decoding, for models with or without byte fallback.

The library merges, over and over, the neighbouring pair whose union is the best piece. The same result without merging
whole texts:

1. A sequence of pieces is the encoding exactly if every two neighbours are compatible, that is, if merging the text of
   the two alone gives the two back. (The first merge across a border of the whole text would happen between the two
   alone too, as merges inside a piece never depend on what stands around it.)
2. An Aho-Corasick automaton over the pieces finds the longest piece at every place of a text.
3. From left to right the longest piece that is compatible with the one before is taken, else the next shorter one. Where
   none is left, the place is marked in a bitfield of failed places and the piece before is shortened. A prefix has one
   encoding only, so a place that failed once fails always, and no place is tried twice.

Pieces that merging their own text wouldn't give back can't occur and are left out. No merge crosses two characters that
no piece holds next to each other, so texts are cut there first; what lies between cuts is encoded once per task and
looked up after that, if it is short. Characters that no piece holds become their bytes, or the unknown piece.

Texts are normalised by the library's own normaliser. Null and empty texts have no pieces and decode to an empty text.
Repeated rows are encoded like any other, null ids are kept, an empty table gives no rows, other columns are ignored. A
text of any length is one row; it is cut in blocks of bounded size. Models with unused pieces, or whose
normaliser drops white space, are refused.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from engram.llm.common import map_slices

SPACE = "▁"
BLOCK = 1 << 20  # characters that are cut at a time


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class Pieces:
    """The pieces of a model, and what merging says about them."""

    PAIRS = 400_000

    def __init__(self, path: str):
        import ahocorasick
        import sentencepiece

        self.library = model = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = range(model.get_piece_size())
        self.text = [model.id_to_piece(i) for i in ids]
        self.unknown = model.unk_id()
        self.silent = {i for i in ids if model.is_control(i)}
        # the value of a byte's piece, such as <0x0A>
        self.byte = {i: int(self.text[i][1:-1], 16) for i in ids if model.is_byte(i)}
        self.of_byte = {v: i for i, v in self.byte.items()}
        if any(model.is_unused(i) for i in ids) or "a" not in model.normalize("  a")[2:]:
            raise ValueError("models with unused pieces, or that drop white space, are not supported")
        usual = [i for i in ids if i != self.unknown and i not in self.silent and i not in self.byte]
        self.score = {self.text[i]: model.get_score(i) for i in usual}
        self.id = {self.text[i]: i for i in usual}
        self.neighbours = {p[k : k + 2] for p in self.score for k in range(len(p) - 1)}
        letters = {c for p in self.score for c in p}
        # letters stand for themselves even where they are no piece of their own
        self.tokens = {c for c in letters} | {p for p in self.score if self.merge(p) == [p]}
        self.automaton = ahocorasick.Automaton()
        for p in self.tokens:
            self.automaton.add_word(p, p)
        self.automaton.make_automaton()
        self.shorter: dict[str, str | None] = {}
        for p in self.tokens:
            self.shorter[p] = next((p[:k] for k in range(len(p) - 1, 0, -1) if p[:k] in self.tokens), None)
        self.pairs: dict[tuple[str, str], bool] = {}

    def merge(self, text: str) -> list[str]:
        """Pieces of a short text by merging the best neighbours, the left ones of equals first."""
        parts = list(text)
        while len(parts) > 1:
            best, at = None, -1
            for k in range(len(parts) - 1):
                s = self.score.get(parts[k] + parts[k + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, k
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def compatible(self, a: str, b: str) -> bool:
        """Whether a before b stays as it is: no merge crosses the border when the two are merged again from letters."""
        known = self.pairs.get((a, b))
        if known is None:
            if len(self.pairs) >= self.PAIRS:
                self.pairs.clear()
            known = self.pairs[a, b] = a[-1] + b[0] not in self.neighbours or self.merge(a + b) == [a, b]
        return known

    def backtrack(self, text: str) -> list[str]:
        """Pieces of a text all of whose letters are known."""
        longest: list[str | None] = [None] * len(text)
        for end, piece in self.automaton.iter(text):
            longest[end - len(piece) + 1] = piece  # ends ascend, so the longest comes last
        failed = bytearray(len(text) // 8 + 1)
        out: list[str] = []
        at, piece = 0, longest[0]
        while at < len(text):
            while piece is not None:
                end = at + len(piece)
                if not failed[end >> 3] >> (end & 7) & 1 and (not out or self.compatible(out[-1], piece)):
                    break
                piece = self.shorter[piece]
            if piece is None:
                failed[at >> 3] |= 1 << (at & 7)
                piece = out.pop()
                at -= len(piece)
                piece = self.shorter[piece]
                continue
            out.append(piece)
            at = end
            piece = longest[at] if at < len(text) else None
        return out

    def encode(self, text: str) -> list[int]:
        """Ids of a normalised text without a cut inside: known letters, or one unknown character."""
        if len(text) == 1 and text not in self.tokens:
            return [self.of_byte[b] for b in text.encode()] if self.of_byte else [self.unknown]
        out = []
        for p in self.backtrack(text):
            i = self.id.get(p)
            out += [i] if i is not None else [self.of_byte[b] for b in p.encode()] if self.of_byte else [self.unknown]
        return out


class Codec:
    """Ids of texts and texts of ids, with a memory of the stretches a task has met."""

    LIMIT, LONG = 500_000, 64  # stretches that are kept, and their characters at most

    def __init__(self, path: str):
        self.pieces = p = Pieces(path)
        letters = sorted({c for t in p.tokens for c in t})
        self.number = np.zeros(0x110000, np.int32)  # 0: in no piece
        self.number[[ord(c) for c in letters]] = np.arange(1, len(letters) + 1)
        self.width = len(letters) + 1
        pairs = np.zeros(self.width**2, bool)
        for a, b in p.neighbours:
            pairs[self.number[ord(a)] * self.width + self.number[ord(b)]] = True
        self.pairs = np.packbits(pairs, bitorder="little")
        self.known: dict[str, int] = {}
        self.ids: list[np.ndarray] = []
        text = [t.replace(SPACE, " ") for t in p.text]
        self.bytes = [b"" if i in p.silent else t.encode() for i, t in enumerate(text)]
        self.bytes[p.unknown] = p.library.decode([p.unknown]).encode()
        # with a mark of word starts before each text, the first one's is no space of the text
        self.opening = len(p.library.normalize("a")) > 1

    def _cuts(self, joined: str, starts: np.ndarray) -> np.ndarray:
        """Where a text starts or two characters meet that no piece joins."""
        cut = np.zeros(len(joined), bool)
        for a in range(0, len(joined), BLOCK):
            lead = max(a - 1, 0)
            n = self.number[np.frombuffer(joined[lead : a + BLOCK].encode("utf-32-le"), np.uint32)].astype(np.int64)
            key = n[:-1] * self.width + n[1:]
            cut[lead + 1 : lead + len(n)] = (self.pairs[key >> 3] >> (key & 7).astype(np.uint8) & 1) == 0
        cut[starts] = True
        return np.flatnonzero(cut)

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        """Ids of each text."""
        normal = [self.pieces.library.normalize(t) if t else "" for t in texts]
        lengths = np.array([len(t) for t in normal], np.int64)
        starts = np.cumsum(lengths) - lengths
        joined = "".join(normal)
        at = self._cuts(joined, starts[lengths > 0]).tolist() if joined else []
        known, ids = self.known, self.ids
        if len(ids) > self.LIMIT:
            known.clear()
            ids.clear()
        found = []
        for a, b in zip(at, [*at[1:], len(joined)], strict=True):
            stretch = joined[a:b]
            n = known.get(stretch)
            if n is None:
                n = len(ids)
                if b - a <= self.LONG:
                    known[stretch] = n
                ids.append(np.array(self.pieces.encode(stretch), np.int32))
            found.append(n)
        first = np.searchsorted(np.array(at, np.int64), np.concatenate([starts, [len(joined)]]))
        counts = np.array([len(x) for x in ids], np.int64)
        numbers = np.array(found, np.int64)
        flat = np.concatenate(ids) if ids else np.zeros(0, np.int32)
        origin = np.cumsum(counts) - counts
        out = []
        for a, b in zip(first, first[1:], strict=False):
            n = numbers[a:b]
            c = counts[n]
            out.append(flat[np.repeat(origin[n] - np.cumsum(c) + c, c) + np.arange(c.sum())])
        return out

    def decode(self, ids: list[int]) -> bytes:
        """Text of the ids, UTF-8. Bytes that are no UTF-8 become U+FFFD one by one, control pieces nothing."""
        table, byte = self.bytes, self.pieces.byte
        out, k = [], 0
        while k < len(ids) and ids[k] in self.pieces.silent:
            k += 1
        # the mark that opens a text goes with the first piece that shows something
        if self.opening and k < len(ids) and ids[k] not in byte and ids[k] != self.pieces.unknown:
            out.append(table[ids[k]].removeprefix(b" "))
            k += 1
        rest = ids[k:]
        if byte.keys().isdisjoint(rest):
            return b"".join(out) + b"".join([table[i] for i in rest])
        run = bytearray()
        for i in rest:
            v = byte.get(i)
            if v is not None:
                run.append(v)
                continue
            if run:
                out.append(_clean(bytes(run)))
                run.clear()
            out.append(table[i])
        out.append(_clean(bytes(run)))
        return b"".join(out)


def _clean(run: bytes) -> bytes:
    try:
        run.decode()
        return run
    except UnicodeDecodeError:
        pass
    out, k = [], 0
    while k < len(run):
        for n in (1, 2, 3, 4):
            try:
                out.append(run[k : k + n].decode())
                break
            except UnicodeDecodeError:
                n = 1
        else:
            out.append("�")
        k += n
    return "".join(out).encode()


def encode_documents(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, ids."""
    path = path or default_model()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(path)
        for b in batches:
            ids = codec.encode(b.column("text").cast(pa.string()).to_pylist())
            ends = np.cumsum([len(i) for i in ids])
            flat = np.concatenate(ids) if ids else np.zeros(0, np.int32)
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), pa.array(flat, pa.int32()))
            yield pa.RecordBatch.from_arrays([b.column("doc_id").cast(pa.int64()), lists], ["doc_id", "ids"])

    return map_slices(docs.select("doc_id", "text"), run, "doc_id bigint, ids array<int>")


def decode_documents(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, text of the ids; a null list is an empty text."""
    path = path or default_model()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(path)
        for b in batches:
            texts = [codec.decode(ids or []) for ids in b.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id").cast(pa.int64()), pa.array(texts, pa.binary()).cast(pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id bigint, text string")


def round_trip(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256: digests of what `encode_documents` and `decode_documents` give, in
    one pass that moves neither ids nor texts."""
    path = path or default_model()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(path)
        digits = [str(i) for i in range(len(codec.bytes))]
        for b in batches:
            encoded = [i.tolist() for i in codec.encode(b.column("text").cast(pa.string()).to_pylist())]
            yield pa.RecordBatch.from_arrays(
                [
                    b.column("doc_id").cast(pa.int64()),
                    pa.array([len(i) for i in encoded], pa.int64()),
                    pa.array([hashlib.sha256(",".join([digits[x] for x in i]).encode()).hexdigest() for i in encoded]),
                    pa.array([hashlib.sha256(codec.decode(i)).hexdigest() for i in encoded]),
                ],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return map_slices(docs.select("doc_id", "text"), run, "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string")
