"""Alignments against all pairs of tokens, counts against a whole count."""

import hashlib
from collections import Counter

import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from sparkcols.llm import alignment, plans

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def pair():
    tokenizer = Tokenizer.from_file(A)
    tokenizer.encode_special_tokens = True
    return tokenizer, sentencepiece.SentencePieceProcessor(model_file=B)


def spans(tokens):
    out, at = [], 0
    for i, data in tokens:
        out.append((i, at, at + len(data)))
        at += len(data)
    return out, b"".join(d for _, d in tokens)


def by_hand(pair, text):
    """Groups and links (pairs of ids, one for each overlapping pair of tokens); None without tokens."""
    a, b = pair
    if not text:
        return None
    wanted = (" " + text).encode()
    letters = alignment.letters_of_bytes()
    done = a.encode(" " + text, add_special_tokens=False)
    own, joined = spans([(i, bytes(letters[c] for c in a.id_to_token(i))) for i in done.ids])
    piece = lambda i: bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()
    other, joined_b = spans([(i, piece(i)) for i in b.encode(text)])
    if joined != wanted or joined_b != wanted:
        return None
    links = [(i, j) for i, s, e in own for j, t, f in other if s < f and t < e]
    ends, groups, last = sorted({e for *_, e in own} & {e for *_, e in other}), [], 0
    for end in ends:
        part = lambda x: ",".join(str(i) for i, s, e in x if last <= s < end)
        groups.append(f"{part(own)}|{part(other)}")
        last = end
    return len(own), len(other), groups, links


def expected(pair, rows):
    done = [(key, by_hand(pair, text)) for key, text in rows]
    counts = Counter(link for _, x in done if x for link in x[3])
    most = {}
    for (_, j), n in counts.items():
        most[j] = max(most.get(j, 0), n)
    out = []
    for key, x in done:
        if x is None:
            out.append((key, 0, 0, 0, 0, 0, 0, ""))
            continue
        n_a, n_b, groups, links = x
        best = sum(counts[k] == most[k[1]] for k in links)
        digest = hashlib.sha256(";".join(groups).encode()).hexdigest()
        out.append((key, n_a, n_b, len(groups), len(links), best, sum(counts[k] for k in links), digest))
    return sorted(out, key=repr)


TEXTS = [
    "Hello world", "Hello world", None, "", " ", "  two  blanks ", "a\nb\tc\r\n\n", "über naïve Straße 東京 🙂👩‍👩‍👧", "<|endoftext|> <s> </s> <unk> <0x41>",
    "x" * 300, "1234567890 " * 40, "▁ odd ▁", "ﬁ ½ Å", "\x00\x01", "don't 'tis", "émigré" * 50, "​﻿zero",
]


def test_odd_texts_repeats_and_clashing_names(spark, pair, monkeypatch):
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(3, "Hello there"), (3, "Hello there"), (None, "Hello")]
    df = spark.createDataFrame([(*r, 5, "q") for r in rows], "doc_id long, text string, block long, k string").coalesce(2)
    got = sorted((tuple(r) for r in alignment.score(df, A, B).collect()), key=repr)
    assert got == expected(pair, rows)


def test_each_text_alone(pair):
    words = alignment.words_of(open(A, "rb").read(), open(B, "rb").read())
    one = alignment.align_block(TEXTS, words)
    for i, text in enumerate(TEXTS):
        alone = alignment.align_block([text], words)
        assert (alone.n_a[0], alone.n_b[0], alone.n_groups[0], alone.n_links[0], alone.groups[0]) == (
            one.n_a[i], one.n_b[i], one.n_groups[i], one.n_links[i], one.groups[i]
        )


def test_groups_as_text(spark, pair):
    rows = list(enumerate(TEXTS))
    got = {r.doc_id: r.groups for r in alignment.align(spark.createDataFrame(rows, "doc_id long, text string"), A, B).collect()}
    for key, text in rows:
        x = by_hand(pair, text)
        assert got[key] == (";".join(x[2]) if x else "")


@pytest.mark.parametrize("most", [0, 3, 1 << 19])
def test_words_are_encoded_as_in_their_text(pair, sf_dir, monkeypatch, most):
    """Cutting at blanks and remembering words changes no id."""
    import pyarrow.parquet as pq

    monkeypatch.setattr(alignment, "REMEMBERED", most)
    texts = [t for t in pq.read_table(f"{sf_dir}/documents.parquet", columns=["text"])["text"].to_pylist() if t]
    joints = ["", " ", "  ", "\n", " \n", "\n ", "\t", "\xa0", " \xa0", "\u3000 ", "\x1c ", ". ", " '", "'s ", "\u0301", " \u0301"]
    texts += [f"{x}{j}{y}" for j in joints for x in ("one", "1", "", "?", "é") for y in ("two", "2", "", "!", "ß", "s")]
    texts = [t for t in texts if t]
    words = alignment.Words(*(f(open(p, "rb").read()) for f, p in ((alignment.byte_level, A), (alignment.piece_level, B))))
    for part in (texts, texts[::-1]):
        (ids_a, many_a), (ids_b, many_b) = words.encoded(part)
        own = [e.ids for e in pair[0].encode_batch([" " + t for t in part], add_special_tokens=False)]
        other = pair[1].encode(part)
        assert ids_a.tolist() == [i for x in own for i in x] and many_a.tolist() == [len(x) for x in own]
        assert ids_b.tolist() == [i for x in other for i in x] and many_b.tolist() == [len(x) for x in other]
    assert len(words.known) <= most


def test_empty_table(spark):
    assert alignment.score(spark.createDataFrame([], "doc_id long, text string"), A, B).collect() == []


def test_query(spark, sf_dir, pair):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    short = [r for r in rows if len(r[1] or "") < 3000]
    got = sorted((tuple(r) for r in alignment.score(spark.createDataFrame(short, "doc_id long, text string").repartition(5), A, B).collect()), key=repr)
    assert got == expected(pair, short)
    done = {r.doc_id: r for r in plans.op13_alignment(spark, sf_dir).collect()}
    assert sorted(done) == sorted(k for k, _ in rows)
    for key, n_a, n_b, n_groups, n_links, _, _, digest in expected(pair, short):
        r = done[key]
        assert (r.n_a, r.n_b, r.n_groups, r.n_links, r.groups_sha256) == (n_a, n_b, n_groups, n_links, digest)
