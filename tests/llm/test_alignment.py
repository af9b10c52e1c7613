"""Alignment of two tokenizers, against plain Python."""

import re
from collections import Counter
from hashlib import sha256

import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from sitelens.llm import queries, token_alignment
from sitelens.llm.common import prepare

from .test_text_operators import prose

A_PATH, B_PATH = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")

ODD = [
    None, "", " ", "a", "  a  b", "a\n\n  b\t c  d　 e", "x <|endoftext|> y", "<s> </s> <0x41> z", "▁", "a▁b",
    "café \U0001f600\U0001f601 日本", "a\x00b c", "a\x1cb \x85 c", "don't we'll 'S x's", "a \n b", "ﬁ Å̊", "word " * 50,
    " lead", "trail ", "\n", "a\r\nb  \r\n  c", "​ zero​width ﻿", "a" * 3000, "a.b,c!d", "word. \n x", "word.\n\nNext",
    "x ) . y", "é.².", ".", "don't.'s", 'e.g.: "x."  ', "end.  ", "end.\n", "no break", "ſ. ĳ! Ω.",
]


class Plain:
    def __init__(self):
        self.a, self.b = Tokenizer.from_file(A_PATH), sentencepiece.SentencePieceProcessor(model_file=B_PATH)
        self.a.encode_special_tokens = True
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        hidden = [b for b in range(256) if b not in shown]
        self.byte = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}

    def piece(self, i):
        p = self.b.id_to_piece(i)
        m = re.fullmatch("<0x(..)>", p)
        return bytes([int(m[1], 16)]) if m else p.replace("▁", " ").encode()

    def __call__(self, text):
        """(ids A, ids B, groups, links) or None."""
        if not text:
            return None
        data = (" " + text).encode()
        a, b = self.a.encode(" " + text, add_special_tokens=False).ids, self.b.encode(text)
        bytes_a, bytes_b = [bytes(self.byte[c] for c in self.a.id_to_token(i)) for i in a], [self.piece(i) for i in b]
        if b"".join(bytes_a) != data or b"".join(bytes_b) != data:
            return None
        owner_a, owner_b = ([i for i, t in enumerate(side) for _ in t] for side in (bytes_a, bytes_b))
        links = sorted(set(zip(owner_a, owner_b)))  # tokens that share a byte overlap
        groups, at = [], 0
        for end in range(1, len(data) + 1):
            if end == len(data) or (owner_a[end] != owner_a[end - 1] and owner_b[end] != owner_b[end - 1]):
                ends = [sorted(set(owner[at:end])) for owner in (owner_a, owner_b)]
                groups.append("|".join(",".join(str(ids[i]) for i in side) for ids, side in zip((a, b), ends)))
                at = end
        return a, b, groups, [(a[i], b[j]) for i, j in links]


def brute(texts):
    plain = Plain()
    found = [plain(t) for t in texts]
    count = Counter(pair for f in found if f for pair in set(f[3]))
    most = {}
    for (a, _), n in count.items():
        most[a] = max(most.get(a, 0), n)
    out = []
    for f in found:
        if f is None:
            out.append((0, 0, 0, 0, 0, 0, ""))
            continue
        a, b, groups, links = f
        best = sum(count[pair] == most[pair[0]] for pair in links)
        out.append((len(a), len(b), len(groups), len(links), best, sum(count[p] for p in links), sha256(";".join(groups).encode()).hexdigest()))
    return out


ROWS = [(i, t) for i, t in enumerate(ODD)] + [(100 + i, prose(20 + 9 * i, i)) for i in range(40)]
ROWS += [(107, ROWS[-33][1]), (None, "the last"), (None, "the last"), (500, prose(20_000, 9)), (501, "The the the. The, the!")]


def test_alignment_query(spark, documents, sf):
    got = queries.QUERIES["op13_token_alignment"](spark, sf(documents=documents(ROWS)))
    assert got.dtypes[:7] == [(c, "bigint") for c in ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")]
    want = [(r[0], *f) for r, f in zip(ROWS, brute([r[1] for r in ROWS]))]
    key = lambda r: (r[0] is not None, r[0] or 0, r[1:])
    assert sorted(map(tuple, got.collect()), key=key) == sorted(want, key=key)


@pytest.mark.parametrize("gathered", [0, 300])
def test_rare_pairs_are_joined(spark, documents, gathered):
    """A pair table beyond what is gathered gives the same sums."""
    docs = documents(ROWS)
    got = token_alignment.report(docs, A_PATH, B_PATH, gathered=gathered).select("doc_id", "n_best", "count_sum").collect()
    want = [(r[0], f[4], f[5]) for r, f in zip(ROWS, brute([r[1] for r in ROWS]))]
    key = lambda r: (r[0] is not None, r[0] or 0, r[1:])
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)


def test_alignment_of_no_rows(spark, documents):
    prepare(spark)
    assert token_alignment.report(documents([(0, "x")]).limit(0), A_PATH, B_PATH).collect() == []
    [row] = token_alignment.report(documents([(0, None)]), A_PATH, B_PATH).collect()
    assert (row["n_a"], row["n_links"], row["count_sum"], row["groups_sha256"]) == (0, 0, 0, "")


def test_a_small_memory_changes_nothing():
    texts = [prose(200, i) for i in range(30)] + ODD
    small, large = (token_alignment.Aligner(A_PATH, B_PATH, n) for n in (50, 100_000))
    assert [small([t]) for t in texts] == [large([t]) for t in texts]
