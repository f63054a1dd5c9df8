"""Token alignment against token ends compared document by document."""

import base64
import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers as P
import sentencepiece
from tokenizers import Tokenizer

from plumbline.llm import align, queries

SCHEMA = "doc_id long, text string, pairs string, row string, id string, groups string"


def plain(docs):
    a_side, b_side = Tokenizer.from_file(P.path(align.A_FILE)), sentencepiece.SentencePieceProcessor(model_file=P.path(align.B_FILE))
    a_side.encode_special_tokens = True
    ranks = {int(k): base64.b64decode(b) for b, k in map(bytes.split, open(P.path("byte_bpe_50k.tiktoken"), "rb"))}

    def piece(k):
        p = b_side.id_to_piece(k)
        return bytes([int(p[3:5], 16)]) if re.fullmatch("<0x[0-9A-F]{2}>", p) else p.replace("▁", " ").encode()
    per, count = [], Counter()
    for i, t in docs:
        whole = (" " + (t or "")).encode()
        a, b = (a_side.encode(" " + t, add_special_tokens=False).ids, b_side.encode(t)) if t else ([], [])
        if b"".join(ranks[x] for x in a) != whole or b"".join(map(piece, b)) != whole:
            a = b = []
        ends = []
        for side, size in ((a, lambda x: len(ranks[x])), (b, lambda x: len(piece(x)))):
            at, own = 0, {}
            for k, x in enumerate(side):
                at += size(x)
                own[at] = k
            ends.append(own)
        both, p, q, groups = sorted(set(ends[0]) & set(ends[1])), 0, 0, []
        for e in both:
            groups.append(",".join(map(str, a[p : ends[0][e] + 1])) + "|" + ",".join(map(str, b[q : ends[1][e] + 1])))
            p, q = ends[0][e] + 1, ends[1][e] + 1
        links = [(a[ends[0][e]], b[ends[1][e]]) for e in both]
        count.update(links)
        per.append((i, len(a), len(b), len(both), links, hashlib.sha256(";".join(groups).encode()).hexdigest() if a else ""))
    top = defaultdict(int)
    for (_, y), n in count.items():
        top[y] = max(top[y], n)
    return sorted(((i, na, nb, ng, len(ls), sum(count[x] == top[x[1]] for x in ls), sum(count[x] for x in ls), s) for i, na, nb, ng, ls, s in per), key=str)


def frame(spark, docs):
    return spark.createDataFrame([(i, t, *"abcd") for i, t in docs], SCHEMA).repartition(3)


PARTS = [" ", "  ", "\n", "\t", "a", "é", "𝒳", "<|endoftext|>", "</s>", "<0x0A>", "don't", "'s", "123", "▁", " ", "　", "ß", "!?", "\r\n", "\x00",
         "\x85", "\x1c", " x", " word", " Word", "-well", " 12 "]


def test_odd_texts(spark):
    rng = random.Random(3)
    docs = [(k, "".join(rng.choices(PARTS, k=rng.randrange(0, 60)))) for k in range(150)]
    docs += [(k, "".join(rng.choices([" ", *PARTS[-6:], "a", "é"], k=60))) for k in range(150, 250)]
    docs += [(None, None), (1, ""), (1, "twice"), (1, "twice"), (5, "x" * 3_000), (6, " ".join(["word"] * 400)), (7, " a b" * 500), (None, "no key here")]
    got = sorted((tuple(r) for r in align.alignments(frame(spark, docs)).collect()), key=str)
    want = plain(docs)
    assert got == want and sum(w[1] > 0 for w in want) > 150 and sum(w[1] == 0 for w in want) > 20
    assert align.alignments(frame(spark, [])).count() == 0
    assert [tuple(r) for r in align.alignments(frame(spark, [(3, None)])).collect()] == [(3, 0, 0, 0, 0, 0, 0, "")]


def test_query(spark, sf):
    docs = [(r.doc_id, r.text) for r in queries.table(spark, sf, "documents").collect()]
    assert sorted((tuple(r) for r in queries.Q["op12_alignment"](spark, sf).collect()), key=str) == plain(docs)


def test_pieces_and_memory(monkeypatch):
    rng = random.Random(4)
    own = align.sides(f"{align.TOKENIZERS}/{align.A_FILE}", f"{align.TOKENIZERS}/{align.B_FILE}")
    for _ in range(100):
        text = "".join(rng.choices([" ", *PARTS[:13], *PARTS[14:]], k=40))
        cut = align.pieces(text)
        assert " ".join(cut) == text
        whole, parts = own.encode([text]), own.encode(cut) if cut else ([], [], [])
        for side in (0, 1):
            assert [i for x in parts[side] for i in x] == (whole[side][0] if text else [])
    x, y = align.overlaps(*(np.array(v) for v in ([0, 0, 1], [0, 2, 5], [0, 0, 1], [0, 4, 5])))
    assert list(zip(x.tolist(), y.tolist(), strict=True)) == [(0, 0), (1, 0), (1, 1), (2, 2)]
