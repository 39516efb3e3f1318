"""Cross-tokenizer alignment against a plain version, piece by piece and on odd tables."""

from __future__ import annotations

import collections
import hashlib

import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from support import SF
from tokenizers import Tokenizer

from millrace.llm import align as module
from millrace.llm import registry
from millrace.llm.align import Aligner, align

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
TEXT = st.text(st.sampled_from([*" \n\t.,;:!?'-|)abeiourstnlé数😀▁0157ABCZ"]), max_size=40)


@pytest.fixture(scope="module")
def plain():
    bpe, pieces = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    bpe.encode_special_tokens = True
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    back = {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in own)}

    def tokens(text):
        a, b = bpe.encode(" " + text, add_special_tokens=False).ids, pieces.encode(text)
        a_bytes = [bytes(back[c] for c in bpe.id_to_token(i)) for i in a]
        b_bytes = [bytes([int(pieces.id_to_piece(i)[3:-1], 16)]) if pieces.is_byte(i) else pieces.id_to_piece(i).replace("▁", " ").encode() for i in b]
        return a, b, a_bytes, b_bytes

    return tokens


def ranges(tokens):
    at, out = 0, []
    for t in tokens:
        out.append((at, at + len(t)))
        at += len(t)
    return out


def brute(rows, tokens):
    docs, count = [], collections.Counter()
    for i, text in rows:
        if text:
            a, b, a_bytes, b_bytes = tokens(text)
            want = (" " + text).encode()
        if not text or b"".join(a_bytes) != want or b"".join(b_bytes) != want:
            docs.append((i, 0, 0, 0, [], ""))
            continue
        ra, rb = ranges(a_bytes), ranges(b_bytes)
        ends = sorted({e for _, e in ra} & {e for _, e in rb})
        inside = lambda ids, spans, lo, hi: ",".join(str(t) for t, (s, e) in zip(ids, spans, strict=True) if lo <= s and e <= hi)
        groups = [f"{inside(a, ra, lo, hi)}|{inside(b, rb, lo, hi)}" for lo, hi in zip([0, *ends], ends, strict=False)]
        links = [(x, y) for x, (s, e) in zip(a, ra, strict=True) for y, (u, v) in zip(b, rb, strict=True) if s < v and u < e]
        count.update(links)
        docs.append((i, len(a), len(b), len(groups), links, hashlib.sha256(";".join(groups).encode()).hexdigest()))
    best = collections.Counter()
    for (_, b), n in count.items():
        best[b] = max(best[b], n)
    return sorted(((i, a, b, g, len(l), sum(count[x] == best[x[1]] for x in l), sum(count[x] for x in l), s) for i, a, b, g, l, s in docs), key=repr)


def found(df):
    return sorted((tuple(r) for r in df.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256").collect()), key=repr)


def documents(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return df.withColumns({c: F.lit("clash") for c in ("id", "row", "pair", "pairs", "links", "total", "best", "n", "b", "n_a")})


ODD = [
    (1, None), (2, ""), (3, " "), (4, "  two  spaces  "), (5, "\n"), (6, "a\n\nb \n c\t d"), (7, "</s><|endoftext|><unk> plain text"),
    (8, "a ▁ mark"), (9, "Été à l'école 数学 😀, naïve."), (None, "no id"), (None, "no id"), (10, "word"), (10, "word"), (10, "another word"),
    (11, "x" * 5000), (12, "many words, some marks; and again. " * 300), (13, "ends in space "), (14, " begins with one"), (15, "nul\0 inside"), (16, "- (a) [b] |c| 12,345.67"),
]


@given(st.lists(TEXT, max_size=6))
@settings(max_examples=150, deadline=None)
def test_word_by_word_tokens_are_the_libraries_own(plain, texts):
    aligner = _aligner()
    for text in texts:
        a, b, _, _ = plain(text)
        assert list(memoryview(aligner.encode_a(text)).cast("H")) == a
        assert list(memoryview(aligner.b.encode([text])[0]).cast("H")) == b


_HELD = []


def _aligner():
    if not _HELD:
        _HELD.append(Aligner(A, B))
    return _HELD[0]


@given(st.lists(TEXT, min_size=1, max_size=8))
@settings(max_examples=80, deadline=None)
def test_windows_give_the_groups_and_links_of_the_plain_version(plain, texts):
    rows = list(enumerate(texts))
    want = {r[0]: r for r in brute(rows, plain)}
    docs, edge, pairs, counts = _aligner().together(rows)
    for k, (i, n_a, n_b, n_groups, sha) in enumerate(docs):
        assert (n_a, n_b, n_groups, sha) == (*want[i][1:4], want[i][7])
        assert counts[edge[k] : edge[k + 1]].sum() == want[i][4]


def test_odd_documents_equal_the_plain_version(spark, plain):
    want = brute(ODD, plain)
    assert found(align(documents(spark, ODD), A, B)) == want
    assert found(align(documents(spark, ODD), A, B, common_pairs=3)) == want  # the rest of the pairs is joined
    assert found(align(documents(spark, ODD), A, B, common_pairs=0)) == want
    assert found(align(documents(spark, []), A, B)) == []


def test_long_texts_go_in_pieces(spark, plain, monkeypatch):
    want = brute(ODD, plain)
    for name, value in {"PIECE_CHARS": 40, "TASK_PAIRS": 50, "MEMO_WORDS": 3, "MEMO_WINDOWS": 4, "_ROW_PAIRS": 7}.items():
        monkeypatch.setattr(module, name, value)
    assert found(align(documents(spark, ODD), A, B)) == want


def test_registered_query_equals_the_plain_version(spark, plain):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    small = [r for r in rows if len(r[1] or "") < 4000]
    got = found(registry.op12_alignment(spark, SF))
    assert len(got) == len(rows)
    whole = {r[0]: r for r in got}
    for r in brute(small, plain):
        assert whole[r[0]][:5] == r[:5] and whole[r[0]][7] == r[7]


def test_words_met_before_are_not_tokenised_or_compared_again(plain, monkeypatch):
    aligner, compared, real = Aligner(A, B), [], Aligner.same
    monkeypatch.setattr(Aligner, "same", staticmethod(lambda coded, flat, want: compared.extend(want) or real(coded, flat, want)))
    rows = [(1, "alpha beta, gamma\ndelta " * 500 + "end"), (2, "end alpha"), (3, "a b alpha"), (4, "½ ﬁ end"), (5, "end ▁"), (6, "▁ 　 alpha")]
    want = brute(rows, plain)
    docs, edge, _, counts = aligner.together(rows)
    assert [d[:4] for d in docs] == [w[:4] for w in want] and [d[4] for d in docs] == [w[7] for w in want]
    assert [int(counts[i:j].sum()) for i, j in zip(edge[:-1], edge[1:], strict=True)] == [w[4] for w in want]
    assert sum(map(len, compared)) < 200
    compared.clear()
    assert aligner.together(rows[:2])[0] == docs[:2] and not compared
