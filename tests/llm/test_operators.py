import base64
import hashlib
import random
import re

import numpy as np
import pytest

from sparkcols.llm import (
    byte_bpe,
    html_text,
    license_scan,
    line_dedup,
    mixing,
    near_vectors,
    ngram_join,
    ordinal_quality,
    quality_rules,
    secrets,
)

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


@pytest.fixture(scope="module")
def docs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet").cache()


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty, repeated and long rows, and a column with a clashing name."""
    rows = [
        (1, None, None, "x"),
        (2, "", "s", "x"),
        (3, "  \n \n", "s", "x"),
        (4, "a line of words that comes twice here\n" * 3, None, "x"),
        (4, "a line of words that comes twice here\n" * 3, None, "x"),
        (None, "password = 'abcdefgh1234'", "s", None),
        (6, "word " * 60000, "t", "x"),
        (7, "É𝒳 token=abcdefgh12345678 AKIAABCDEFGHIJKL0 " + "0af" * 14, "t", "x"),
    ]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, id string")


def groups(sets, linked):
    root = {k: k for k in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    keys = sorted(sets)
    for i, a in enumerate(keys):
        for b in keys[i + 1 :]:
            if sets[a] and sets[b] and linked(sets[a], sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {k: find(k) for k in keys}


def jaccard(percent):
    return lambda a, b: 100 * len(a & b) >= percent * len(a | b)


def test_bpe_equals_public_library_and_round_trips(spark, docs, odd):
    import public_tokenizers as P
    import tiktoken

    path = P.path("byte_bpe_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    known = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    for table in (docs.select("doc_id", "text"), odd.select("doc_id", "text")):
        rows = byte_bpe.decode(byte_bpe.encode(table, path, P.PATTERN), path).collect()
        got = sorted((r.doc_id or 0, list(r.ids), bytes(r.decoded)) for r in rows)
        want = sorted((r.doc_id or 0, known.encode_ordinary(r.text or ""), (r.text or "").encode()) for r in table.collect())
        assert got == want
    rng, queue = random.Random(1), byte_bpe.RankQueue(len(ranks))
    for text in ("a" * 5000, "ab" * 3000, "".join(rng.choice("abcé你e") for _ in range(4000))):
        pieces = __import__("regex").findall(P.PATTERN, text)
        assert sum((byte_bpe.merge(p.encode(), ranks, queue) for p in pieces), []) == known.encode_ordinary(text)


def test_mixing_stays_within_a_block():
    for weights in (mixing.WEIGHTS, {"a": 1, "b": 2, mixing.OTHERS: 4}, {"a": 3, mixing.OTHERS: 3}):
        slots, period = mixing.period_slots(weights), sum(weights.values())
        assert sorted(sum(slots.values(), [])) == list(range(period))
        for name, own in slots.items():
            for t in range(period + 1):
                assert abs(sum(s < t for s in own) - t * weights[name] / period) < 1


def test_mixing_keeps_all_rows(spark, odd):
    assert mixing.mixed(odd).count() == odd.count()
    assert mixing.mixed(odd.limit(0)).count() == 0
    with pytest.raises(ValueError):
        mixing.schedule(odd.withColumnRenamed("id", "mix_slot"))


def base_spans(text):
    out = []
    for m in re.finditer(
        r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text
    ):
        out += [(m.start(), 0, m.end(), "assign")] if len(m[1]) >= 8 else []
    out += [(m.start(), 1, m.end(), "access") for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    out += [(m.start(), 2, m.end(), "hex") for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]
    return ",".join(f"{k}:{a}:{b}" for a, _, b, k in sorted(out))


def test_secrets_base_spans(docs, odd):
    for table in (docs, odd):
        got = sorted((r.doc_id or 0, r.base_sha256) for r in secrets.digest(secrets.scan(table)).collect())
        want = sorted(
            (r.doc_id or 0, hashlib.sha256(base_spans(r.text or "").encode()).hexdigest()) for r in table.collect()
        )
        assert got == want
    assert secrets.scan(odd.limit(0)).count() == 0


def test_secrets_tell_examples_from_live_ones(spark):
    value, copied = "Zx81mQ0pLr7TtY2bNn4K", "example0key1example0"
    rows = [(i, f"api_key = {copied}", f"o{i}") for i in range(5)]
    rows += [(10, f"token: {value}", "a"), (11, f"see {value} there", "a"), (12, f"see {copied} there", "b")]
    got = {r.doc_id: r for r in secrets.digest(secrets.scan(spark.createDataFrame(rows, "doc_id long, text string, source string"))).collect()}
    assert got[0].n_example == 1 and got[0].n_live == 0
    assert got[10].n_live == 1 and got[11].spans == "bare:4:24" and got[12].spans == ""


@pytest.mark.parametrize("width,percent", [(3, 90), (5, 80)])
def test_ngram_join_equals_all_pairs(docs, width, percent):
    sets = {}
    for r in docs.collect():
        w = WORD.findall(lower(r.text or ""))
        sets[r.doc_id] = {tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else set()
    want = groups(sets, jaccard(percent))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.components(docs, width, percent).collect()}
    assert got == {k: (len(s), want[k]) for k, s in sets.items()}


def test_ngram_join_finds_chains(spark):
    """Each text shares 90 % with the next one only; the leader rounds must not lose the far ends."""
    rows = [(i, " ".join(f"w{j}" for j in range(4 * i, 4 * i + 100))) for i in range(12)]
    got = ngram_join.components(spark.createDataFrame(rows, "doc_id long, text string"), 3, 90).collect()
    assert {r.component_id for r in got} == {0}


def test_ngram_join_odd_rows(odd):
    got = sorted((r.doc_id or 0, r.n_shingles, r.component_id) for r in ngram_join.components(odd, 3, 90).collect())
    assert [g for g in got if g[0] in (1, 2, 3)] == [(1, 0, 1), (2, 0, 2), (3, 0, 3)]
    assert len(got) == odd.count() and ngram_join.components(odd.limit(0)).count() == 0


def test_line_dedup_recall_and_precision(docs):
    lines = []
    for r in docs.collect():
        for i, line in enumerate((r.text or "").split("\n")):
            words = re.findall(rb"[^\x20\x09-\x0D]+", lower(line).encode())
            if words:
                lines.append((r.doc_id, i, b" ".join(words)))
    sets = {w: {w[j : j + 8] for j in range(max(1, len(w) - 7))} for w in {x[2] for x in lines}}
    root = groups(sets, lambda a, b: 5 * min(len(a), len(b)) >= 4 * max(len(a), len(b)) and jaccard(80)(a, b))
    seen, want = set(), set()
    for d, i, w in sorted(lines):
        if root[w] in seen:
            want.add((d, i))
        seen.add(root[w])
    got = {(r.doc, i) for r in line_dedup.lost_lines(docs).collect() for i in r.lost}
    assert len(got & want) >= 0.99 * len(want) and len(got - want) <= 0.01 * len(want)


def test_line_dedup_odd_rows(odd):
    got = {r.doc_id: r for r in line_dedup.dedup(odd).collect()}
    assert got[1].kept_text is None and got[2].kept_text == "" and got[3].n_lost == 0
    assert got[4].n_lost == 2 and got[4].kept_text == "a line of words that comes twice here\n"
    assert line_dedup.dedup(odd).count() == odd.count() and line_dedup.dedup(odd.limit(0)).count() == 0


def plain_measures(text):
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    where, covered = {}, set()
    for i in range(len(words) - 7):
        where.setdefault(tuple(words[i : i + 8]), []).append(i)
    for at in where.values():
        if len(at) > 1:
            covered |= {i + j for i in at for j in range(8)}
    n = len(words)
    failed = n < 20 or 100 * len(covered) > 30 * n
    symbols = sum(c in "#*$%&|<>" for c in text)
    return n, sum(map(len, words)), symbols, len(lines) - len(set(lines)), len(covered), failed


def test_quality_rules_measures(docs, odd):
    for table in (docs, odd):
        got = sorted(
            (r.doc_id or 0, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed)
            for r in quality_rules.judge(table).collect()
        )
        assert got == sorted((r.doc_id or 0, *plain_measures(r.text or "")) for r in table.collect())
    assert quality_rules.judge(odd.limit(0)).count() == 0


def test_html_text():
    page = """<html><head><title>t</title><style>p{}</style></head><body><header>Site</header><nav><a>menu</a></nav>
    <div class="cookie-notice">We use cookies, yes.</div><article><h1>Head &amp; tail</h1><p>One, <b>two.<br>Three, four,
    five. <ul><li>item<li>other</ul><div class="comments"><p>Nice, very nice, so nice.</p></div></article>
    <aside>Side</aside><footer>&copy; foot</footer><script>var p = "</p>";</script></body></html>"""
    assert html_text.main_text(page) == "Head & tail One, two. Three, four, five. item other"
    assert html_text.main_text("") == "" and html_text.main_text("<p></p><!-- x") == ""


def test_html_text_rows(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/pages.parquet")
    got = html_text.extract(rows).collect()
    assert len(got) == rows.count() and all(len(r.text) == r.n_chars > 0 for r in got)
    none = spark.createDataFrame([(1, "u", None), (None, None, "")], "page_id long, url string, html string")
    assert [r.text for r in html_text.extract(none).collect()] == ["", ""]


def test_near_vectors_recall_and_ties(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(2000, 32)).astype(np.float32)
    x[1000:1400] = x[7]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(5000, None), (5020, [0.0] * 32), (5040, [float("nan")] * 32)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    from pyspark.sql import functions as F

    got = {}
    for r in near_vectors.search(df, F.col("vec_id") % 20 == 0).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
    hits = 0
    for q, found in got.items():
        score = x.astype(float) @ x[q].astype(float)
        order = [i for i in np.lexsort((np.arange(2000), -np.round(score, 9))) if i != q][:20]
        hits += len(set(order) & set(found))
        if 1000 <= q < 1400:
            assert found == [7, *(i for i in range(1000, 1020) if i != q)][:20]
    assert len(got) == 100 and hits >= 0.9 * 20 * len(got)


def test_license_scan(spark):
    rows = [
        (1, "Released under the MIT License.", "r/LICENSE"),
        (2, "some code", "r/a/b/x"),
        (3, "code\nLicensed under the Apache License, Version 2.0.\nmore and more code that goes on for long, and for longer than its header", "r/a/y"),
        (4, "nothing", "q/z"),
        (5, None, None),
    ]
    got = {r.doc_id: (r.license, r.via) for r in license_scan.scan(spark.createDataFrame(rows, "doc_id long, text string, path string")).collect()}
    assert got == {1: ("MIT", "text"), 2: ("MIT", "r"), 3: ("Apache-2.0", "text"), 4: (None, None), 5: (None, None)}


def test_ordinal_quality(spark):
    good, poor, bad = "calm clear useful words", "junk 111 222 ###", "vile idiot words"
    rows = [(i, " ".join(random.Random(i).choices((bad, poor, good)[i % 3].split(), k=12))) for i in range(90)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 3 == 2), int(i % 3 == 0)) for i in range(60)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in ordinal_quality.score(docs, ordinal_quality.fit(docs, labels)).collect()}
    assert all(got[i].kept == (i % 3 > 0) for i in range(60, 90))
    assert all(r.p_1 >= r.p_2 for r in got.values())
    empty = spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string")
    assert ordinal_quality.score(empty, ordinal_quality.fit(empty, labels.limit(0))).count() == 2


def test_license_scan_kinds_headers_and_full_texts(spark):
    from sparkcols.llm.licences import BSD2, BSD3, MIT, text

    wrap = lambda parts: "\n\n".join(re.sub(r"(.{40,70}) ", r"\1\n", p) for p in parts)
    header = """# This program is free software: you can redistribute it and/or modify
# it under the terms of the GNU General Public License as published by
# the Free Software Foundation, either version {} of the License, or
# (at your option) any later version.
#
# This program is distributed in the hope that it will be useful, but
# WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY.

import os
print(os.getcwd())"""
    texts = {
        "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
        "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
        "GPL-2.0": "This work is licensed under the GNU GPL, version 2.",
        "LGPL-3.0": "This work is licensed under the GNU Lesser GPL, version 3.",
        "MIT": "MIT License\n\nCopyright (c) 2020 Some One\n\n" + wrap(MIT),
        "BSD-2-Clause": "Copyright 2020 Some One\n\n" + wrap(BSD2),
        "BSD-3-Clause": "/* " + wrap(BSD3) + " */\n\nint main(void) { return 0; }\n\nint other(void) { return elsewhere(); }",
        "ISC": "# SPDX-License-Identifier: ISC\nprint('hello')",
        "GPL-3.0": header.format(3),
        "MPL-2.0": text("MPL-2.0"),
        "LGPL-2.1": text("LGPL-2.1"),
        "Apache-2.0": text("Apache-2.0"),
        "Apache-1.1": "Licensed under the Apache License, Version 1.1",
        "GPL": "This work is licensed under the GNU General Public License",
        "GPL-2.0/GPL-3.0": header.format(2) + "\n\nThis work is licensed under the GNU General Public License, version 3",
    }
    plain = [f"row {i} of {w} and the rest of it, with more words" for i, w in enumerate(["code", "prose", "tables", "notes"] * 10)]
    rows = [(name, t, f"d{i}/LICENSE") for i, (name, t) in enumerate(texts.items())] + [(None, t, f"e/{i}") for i, t in enumerate(plain)]
    df = spark.createDataFrame(rows, "name string, text string, path string")
    got = license_scan.scan(df, key="name").collect()
    assert {r.name: r.own_license for r in got if r.name} == {n: n for n in texts}
    assert all(r.own_license is None for r in got if not r.name)
