"""Fill-in-middle, the Merkle manifest and the piece codec against brute force and the library."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from engram.llm import fill_in_middle as fim
from engram.llm import merkle_manifest as mm
from engram.llm import piece_codec as pc

DOC = "doc_id bigint, text string, lang string, source string, n_chars bigint"
UNITS = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def sha(t: str) -> str:
    return hashlib.sha256(t.encode()).hexdigest()


def awkward_texts() -> list:
    r = random.Random(5)
    texts = [None, "", " ", "\n\n", "one", " one ", "a<P>b c", "x <S", "S> y", "\x00 a\x00", "▁▁ a", "é 😀 ﬀ  x　y", "word " * 30_000, "z" * 90_000, "tail  "]
    return texts + ["".join(r.choice("ab \t\né😀<PSM>") for _ in range(r.randrange(40))) for _ in range(300)]


# ---------------------------------------------------------------- fill in middle


@pytest.mark.parametrize("kind", ["few", "many", "runs", "mixed"])
def test_boundary_set_selects(kind):
    r = random.Random(1)
    x = {
        "few": sorted(r.sample(range(300_000), 900)),
        "many": list(range(0, 200_000, 3)),
        "runs": [*range(5, 70_000), *range(131_072, 131_080)],
        "mixed": sorted({*range(0, 60_000, 2), *range(65_530, 67_000), *range(200_000, 200_900, 7)}),
    }[kind]
    got = fim.BoundarySet(np.array(x))
    assert len(got) == len(x) and [got.select(k) for k in range(len(x))] == x
    kinds = {type(c).__name__ for c in got.containers}
    assert kinds == {"few": {"Sparse"}, "many": {"Bits", "Sparse"}, "runs": {"Runs"}, "mixed": {"Bits", "Runs", "Sparse"}}[kind] or kind == "many"
    assert all(c.nbytes() <= 8192 for c in got.containers)
    with pytest.raises(IndexError):
        got.select(len(x))


def test_empty_boundary_set():
    assert len(fim.boundaries("")) == 0


def _plain_fim(doc_id, text):
    text = text or ""
    h = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(h[k : k + 8], 16) for k in (0, 8, 16, 24)]
    units = UNITS.findall(text)
    n = len(units)
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 50:
        return n, "plain", None, None, text
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    return (n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}") if h[3] % 100 < 80 else (n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}")


def test_fill_in_middle(spark):
    texts = awkward_texts()
    rows = [(i if i else None, t, "x", i, "clash", "clash") for i, t in enumerate(texts)] + [(7, "again and again", "x", 0, "c", "c")] * 2
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, n bigint, form string, output string").repartition(3)
    want = sorted(((r[0], *_plain_fim(r[0], r[1])) for r in rows), key=repr)
    got = [tuple(r) for r in fim.fill_in_middle(docs).collect()]
    assert sorted(got, key=repr) == want
    assert {r[2] for r in got} == {"plain", "spm", "psm"}
    digests = sorted(map(tuple, fim.round_trip(docs).select("doc_id", "output_sha256", "restored_sha256").collect()), key=repr)
    assert digests == sorted(((r[0], sha(_plain_fim(r[0], r[1])[4]), sha(r[1] or "")) for r in rows), key=repr)
    assert fim.round_trip(docs.limit(0)).count() == 0


# ---------------------------------------------------------------- Merkle manifest


def _field(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def _leaf(d, s, lang, n, t):
    return sha("".join(map(_field, (d, s, lang, n, t))))


def _tree(hashes):
    """Levels of a tree, from the leaves."""
    levels = [hashes]
    while len(levels[-1]) > 1:
        levels.append([sha("".join(levels[-1][k : k + 16])) for k in range(0, len(levels[-1]), 16)])
    return levels


def _siblings(levels, k):
    out = []
    for level in levels[:-1]:
        a = k // 16 * 16
        out.append((level[a:k], level[k + 1 : a + 16]))
        k //= 16
    return out


def _plain_merkle(rows):
    groups = {}
    for d, t, lang, s, n in rows:
        groups.setdefault(s, []).append((d is not None, d, _leaf(d, s, lang, n, t), t, lang, n))
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: _tree([x[2] for x in groups[s]]) for s in names if groups[s].sort(key=lambda x: (x[0], x[1] or 0, x[2])) is None}
    top = _tree([trees[s][-1][0] for s in names])
    out = []
    for j, s in enumerate(names):
        for k, (_, d, h, t, lang, n) in enumerate(groups[s]):
            path = _siblings(trees[s], k) + _siblings(top, j)
            acc = h
            if d is not None and zlib.crc32(str(d).encode()) % 5 == 0 and t is not None:
                acc = _leaf(d, s, lang, n, "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t))
            for a, b in path:
                acc = sha("".join([*a, acc, *b]))
            out.append((d, h, trees[s][-1][0], top[-1][0], sha("".join(x for a, b in path for x in (*a, *b))), acc, acc == top[-1][0]))
    return sorted(out, key=repr)


@pytest.mark.parametrize("case", ["hot", "one source", "many sources", "one row", "singles"])
def test_merkle(spark, case):
    r = random.Random(2)
    text = lambda i: r.choice([None, "", f"Text É {i}", "plain lower", "X" * 5000])
    rows = {
        "hot": [(i, text(i), r.choice(["en", None]), "hot" if i % 3 else r.choice([None, "", "b", "é", "z"]), r.choice([i, None])) for i in range(900)] + [(None, "no id", None, "hot", None)] * 3 + [(5, "Twice", "en", "hot", 1)] * 2,
        "one source": [(i, text(i), "en", "s", i) for i in range(257)],
        "many sources": [(i, text(i), "en", f"s{i % 300}", i) for i in range(700)],
        "one row": [(10, "Only ONE", "en", "s", 8)],
        "singles": [(i, "Same", "en", f"s{i}", 4) for i in range(17)],
    }[case]
    docs = spark.createDataFrame([(*x, "clash", 1) for x in rows], DOC + ", leaf string, lo int").repartition(4)
    got = mm.verify(docs).select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified").collect()
    assert sorted(map(tuple, got), key=repr) == _plain_merkle(rows)


def test_merkle_of_nothing(spark):
    assert mm.verify(spark.createDataFrame([], DOC)).collect() == []


# ---------------------------------------------------------------- pieces


@pytest.fixture(scope="module")
def codec():
    return pc.Codec(pc.default_model())


def test_codec_equals_library(codec):
    r = random.Random(3)
    tokens = sorted(codec.pieces.tokens)

    def text():
        n = r.randrange(60)
        return r.choice([
            lambda: "".join(chr(r.choice([r.randrange(0, 0xD800), r.randrange(0xE000, 0x110000), r.randrange(128)])) for _ in range(n)),
            lambda: "".join(r.choice("ab \n▁\t\0the<s>") for _ in range(n)),
            lambda: "".join(r.choice("aeinorst") for _ in range(n)),
            lambda: "".join(r.choice(tokens) for _ in range(n // 4)),
            lambda: " " * n + "".join(chr(r.randrange(0x4E00, 0x5000)) for _ in range(n)),
        ])()

    texts = [text() for _ in range(4000)] + ["a" * 20_000, " " * 20_000, "".join(r.choice("abcXYZ019+/") for _ in range(50_000))]
    library = codec.pieces.library
    got = [x.tolist() for x in codec.encode(texts)]
    assert got == library.encode(texts)
    assert [codec.decode(x).decode() for x in got] == library.decode(got)


def test_decode_of_any_ids(codec):
    r = random.Random(4)
    space = codec.pieces.id["▁"]
    for _ in range(3000):
        ids = [r.choice([r.randrange(32_000), r.randrange(262), space, 3 + 0xE4, 3 + 0xB8, 3 + 0xAD]) for _ in range(r.randrange(8))]
        assert codec.decode(ids).decode() == codec.pieces.library.decode(ids)


def test_failed_places_are_needed(codec):
    """Texts whose longest pieces lead astray, so that pieces are taken back."""
    p = codec.pieces
    back = [t for t in (a + b for a in ("▁the", "ing", "▁un", "st") for b in sorted(p.tokens)[::40]) if all(c in p.tokens for c in t)]
    assert all(p.backtrack(t) == p.merge(t) for t in back)
    greedy = 0
    for t in back:
        k = 0
        for piece in p.backtrack(t):
            longest = max((t[k:e] for e in range(k + 1, len(t) + 1) if t[k:e] in p.tokens), key=len)
            greedy += longest != piece
            k += len(piece)
    assert greedy > 0


def test_documents(spark, codec):
    texts = awkward_texts()
    rows = [(i if i else None, t, "x", i) for i, t in enumerate(texts)] + [(3, "again", "x", 1)] * 2
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, ids string, n_tokens bigint").repartition(3)
    library = codec.pieces.library
    want = [(d, library.encode(t or "")) for d, t, *_ in rows]
    got = pc.encode_documents(docs)
    assert sorted(((r[0], r[1]) for r in got.collect()), key=repr) == sorted(want, key=repr)
    back = pc.decode_documents(got).collect()
    assert sorted(map(tuple, back), key=repr) == sorted(((d, library.decode(i)) for d, i in want), key=repr)
    digests = sorted(map(tuple, pc.round_trip(docs).collect()), key=repr)
    assert digests == sorted(((d, len(i), sha(",".join(map(str, i))), sha(library.decode(i))) for d, i in want), key=repr)
    assert pc.round_trip(docs.limit(0)).count() == 0 and pc.decode_documents(pc.encode_documents(docs.limit(0))).count() == 0
