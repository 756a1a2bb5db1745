from sparkcols.llm import grouping, line_dedup


def crossed_copies(n):
    """A line of 60 words, n copies with three words changed at its end, and n/10 lines with nine words changed at its
    start, too many for the first line, but so that half of the copies have six of these changes too."""
    words = [f"word{i:02d}" for i in range(60)]
    changed = [f"news{i}" for i in range(6)]
    lines = [" ".join(words)]
    for i in range(n):
        head = changed if i % 2 else words[:6]
        lines.append(" ".join([*head, *words[6:59], f"end{i}"]))
    for i in range(n // 10):
        lines.append(" ".join([*changed, *words[6:56], *(f"far{i}x{j}" for j in range(4))]))
    return lines


def shingles(line):
    return {line[i : i + 8] for i in range(max(1, len(line) - 7))}


def test_items_like_many_copies_of_a_leader_make_few_pairs(spark, monkeypatch):
    """Lines unlike the leader, but like half of its copies: a few of these link them, and their pairs aren't made."""
    lines = crossed_copies(300)
    sets = [shingles(x) for x in lines]
    like = lambda a, b: 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])
    far = range(301, len(lines))
    assert not any(like(0, b) for b in far) and sum(like(a, b) for a in range(301) for b in far) > 2_000
    made = []
    whole = grouping.all_pairs

    def counted(*args):
        pairs = whole(*args)
        made.append(pairs.count())
        return pairs

    monkeypatch.setattr(grouping, "all_pairs", counted)
    texts = spark.createDataFrame(list(enumerate(lines)), "id long, line string")
    # the first line has most keys, so it leads; the others meet it under one key
    rows = [(1, i, len(x), 1) for i, x in enumerate(sets)] + [(k, i, len(sets[i]), 1) for k in (2, 3) for i in (0, k)]
    posts = spark.createDataFrame(rows, "key long, id long, size long, need int")
    held = lambda ids, parts: texts.join(ids, "id", "left_semi").repartition(parts, "id")
    parts = line_dedup.alike_pairs, line_dedup.line_items, line_dedup.line_parities
    roots = {r.id: r.root for r in grouping.linked(posts, held, 80, *parts).collect()}
    assert roots == dict.fromkeys(range(len(lines)), 0)
    assert sum(made) < 1_500


def test_crowded_keys(spark):
    rows = [(key, i) for key, n in ((1, 256), (2, 257), (3, 257)) for i in range(n)]
    posts = spark.createDataFrame([(k, i, 9, 1) for k, i in rows], "key long, id long, size long, need int")
    assert [tuple(r) for r in grouping.crowded(posts, None).orderBy("key").collect()] == [(2, 257), (3, 257)]
    roots = spark.createDataFrame([(i, 0) for i in range(257)], "id long, root long")
    assert grouping.crowded(posts, roots).isEmpty()
