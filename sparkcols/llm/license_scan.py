"""License scans: sparse TF-IDF cosine of lines, blocks and whole texts to licence templates, then inheritance from the nearest directory.

A document most of whose text is a licence is a licence file of its directory.
A document with a licence line or header has a licence of its own. All others
inherit from the nearest directory above them that has a licence file.
"""

from __future__ import annotations

import re
from math import log

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkcols.llm.licences import TEMPLATES
from sparkcols.session import staged

#: least cosine of a licence line, block or text, and least share of a licence file's characters in them
HEADER, WHOLE = 0.7, 0.5
#: a line end and the lines without letters and digits after it, which part the blocks of a text or of a comment
BLOCK_END = r"(?:\r\n|\r|\n)(?:[^\p{L}\p{N}\r\n]*(?:\r\n|\r|\n))+"
#: a version as a licence states it
VERSION = (
    r"(?i)(?:version|\bv\.?|licen[cs]e|\b[AL]?GPL|\bMPL|\bCC0|attribution[a-z-]*|\bBY(?:-(?:NC|ND|SA))*)"
    r"[^a-z0-9]{0,8}v?\.?\s*([0-9]+(?:\.[0-9]+)?)"
)
#: shapes of compared parts
LINE, BLOCK, TEXT = range(3)
#: classes of weight in the bound of a part's cosine, and the unit of squared weights, which are summed as whole numbers
CLASSES, UNIT = 6, 1e-6
#: templates of more distinct words are full texts, which may name other versions
FULL = 200


def terms(text: Column) -> Column:
    """Distinct lower-case runs of letters and digits."""
    return F.array_distinct(F.filter(F.split(F.lower(text), r"[^a-z0-9]+"), lambda w: w != ""))


def ancestors(path: Column) -> Column:
    """The directories above a path, nearest first, the root '' last."""
    parts = F.split(path, "/")
    return F.transform(
        F.sequence(F.size(parts) - 1, F.lit(0)), lambda n: F.array_join(F.slice(parts, 1, n), "/")
    )


def words_of(text: str) -> list[str]:
    return sorted({w for w in re.split("[^a-z0-9]+", text.lower()) if w})


def family(name: str) -> tuple[str, str]:
    """A licence's name without its version, and the version ('' if it has none)."""
    found = re.fullmatch(r"(.+)-([0-9]+\.[0-9]+)", name)
    return (found[1], found[2]) if found else (name, "")


def within(words: list[str]) -> str:
    return "w IN ({})".format(", ".join(f"'{w}'" for w in words))


def scan(
    df: DataFrame, templates: dict[str, list[str]] = TEMPLATES, text: str = "text", path: str = "path", key: str = "doc_id"
) -> DataFrame:
    """One row per row of ``df``: the key, ``own_license``, ``own_cosine``, ``license``, ``via``.

    Single lines, blocks of several lines, whole texts of several blocks, and
    all licence parts of a document taken together are compared with every
    template. A whole text counts before a block and a block before a line,
    then the higher cosine, then the first licence name. Parts taken together
    decide between licences without a version, whose paragraphs are shared.

    A part that states another version than its template has that version; one
    that states none has the licence's name alone where the template states it.
    Parts with several versions of one licence give all of them, joined by '/',
    unless a full text is the best part.

    ``via`` is 'text', the directory inherited from, or null with a null
    licence. Document frequencies of the templates' terms are counted over all
    lines of all documents. Null and empty texts have no licence of their own;
    null paths inherit nothing. In a directory with several licence files the
    one with the most files counts, then the first name. Rows are told apart by
    key and path: repeated ones must agree in text, else the best part of all
    counts. Other columns are not looked at.
    """
    spark = df.sparkSession
    names = sorted(templates)
    entries = [(name, words_of(t), t) for name in names for t in ([templates[name]] if isinstance(templates[name], str) else templates[name])]
    known = sorted({w for _, ws, _ in entries for w in ws}) or [""]
    value = F.coalesce(F.col(text), F.lit(""))
    split = lambda c: F.split(c, r"[\r\n]+")
    held = lambda c: F.filter(terms(c), lambda w: w.isin(known))
    # statistics: number of lines, and of lines with each term, over everything
    total = df.agg(F.sum(F.size(split(value)))).first()[0] or 0
    lines = df.select(F.explode(split(value)).alias("line"))
    counted = lines.select(F.explode(held(F.col("line"))).alias("w")).groupBy("w").agg(F.count("*").alias("n"))
    counts = {r["w"]: r["n"] for r in counted.collect()}
    weight = {w: round(_idf(total, counts.get(w, 0)) ** 2 / UNIT) for w in known}
    rest = max(weight.values())  # a word of no template weighs as much as the rarest one

    # a part's known words must hold HEADER ** 2 of its squared length, else no template can be near enough
    ranked = sorted(known, key=lambda w: weight[w])
    steps = [c for c in (ranked[i * len(ranked) // CLASSES : (i + 1) * len(ranked) // CLASSES] for i in range(CLASSES)) if c]
    cases = " ".join(f"WHEN {within(c)} THEN {weight[c[-1]]}L" for c in steps)
    most = F.expr(f"aggregate(t, 0L, (s, w) -> s + CASE {cases} ELSE 0L END)")
    parts = lambda shape, c: F.transform(c, lambda x: F.struct(F.lit(shape).alias("shape"), x.alias("part")))
    blocks = F.split(value, BLOCK_END)
    several = F.filter(blocks, lambda b: F.trim(b).rlike(r"[\r\n]"))
    whole = F.when(F.size(blocks) > 1, F.array(value)).otherwise(F.array().cast("array<string>"))
    units = df.select(
        F.col(key).alias("k"), F.col(path).alias("p"),
        F.posexplode(F.concat(parts(LINE, split(value)), parts(BLOCK, several), parts(TEXT, whole))).alias("at", "u"),
    ).select("k", "p", "at", "u.shape", "u.part", terms(F.col("u.part")).alias("all"))
    units = units.select("k", "p", "at", "shape", "part", F.size("all").alias("all"), F.filter("all", lambda w: w.isin(known)).alias("t"))
    # a part with fewer than two of the templates' terms is no candidate
    near = units.where((F.size("t") >= 2) & ((1 - HEADER**2) * most >= HEADER**2 * rest * (F.col("all") - F.size("t"))))
    near = staged(
        near.select(
            "k", "p", "at", "shape", "t", F.length("part").alias("n"), ((F.col("all") - F.size("t")).cast("long") * rest).alias("rare"),
            F.regexp_extract("part", VERSION, 1).alias("version"), F.monotonically_increasing_id().alias("unit"),
        ),
        "licence-candidates",
    )
    table = [(w, i, weight[w]) for i, (_, ws, _) in enumerate(entries) for w in ws] + [(w, -1, weight[w]) for w in known]
    table = F.broadcast(spark.createDataFrame(table, "w string, i int, w2 long"))
    lengths = [float(sum(weight[w] for w in ws)) for _, ws, _ in entries]
    stated = [bool(family(n)[1]) and family(n)[1].removesuffix(".0") in [v.removesuffix(".0") for v in re.findall(VERSION, t)] for n, _, t in entries]
    full = [len(ws) > FULL for _, ws, _ in entries]
    of = lambda values, i: F.get(F.lit(values), i)

    def best(candidates: DataFrame, some: list[int] | None = None) -> DataFrame:
        """(unit, cosine, i) of the nearest template of each candidate (unit, t, rare) that is near enough."""
        rows = candidates.select("unit", "rare", F.explode("t").alias("w")).join(table, "w").groupBy("unit", "i")
        sums = rows.agg(F.sum("w2").alias("s"), F.first("rare").alias("rare")).groupBy("unit")
        sums = sums.agg(F.max(F.when(F.col("i") < 0, F.col("s") + F.col("rare"))).alias("own"), F.collect_list(F.when(F.col("i") >= 0, F.struct("i", "s"))).alias("all"))
        if some is not None:
            sums = sums.withColumn("all", F.filter("all", lambda x: x["i"].isin(some)))
        cosine = lambda x: F.round(x["s"] / F.sqrt(F.col("own") * of(lengths, x["i"])), 6)
        top = F.array_max(F.transform("all", lambda x: F.struct(cosine(x).alias("cosine"), (-x["i"]).alias("back"))))
        return sums.select("unit", top.alias("top")).where(F.col("top.cosine") >= HEADER).select("unit", "top.cosine", (-F.col("top.back")).alias("i"))

    good = staged(near.join(best(near), "unit"), "licence-parts")
    plain, own_version = of([family(n)[0] for n, _, _ in entries], F.col("i")), of([family(n)[1] for n, _, _ in entries], F.col("i"))
    named = F.when(own_version == "", of([n for n, _, _ in entries], F.col("i")))
    named = named.when(F.col("version") != "", F.concat_ws("-", plain, F.when(F.col("version").contains("."), F.col("version")).otherwise(F.concat("version", F.lit(".0")))))
    named = named.when(of(stated, F.col("i")), plain).otherwise(of([n for n, _, _ in entries], F.col("i")))
    good = good.withColumns({"own": named, "plain": plain, "clear": (own_version != "") & (F.col("version") != "")})
    once = good.groupBy("k", "p", "at", "shape").agg(
        F.max(F.struct("cosine", (-F.col("i")).alias("back"), "own", "plain", "clear")).alias("b"), F.max("n").alias("n"), F.first("t").alias("t"), F.first("rare").alias("rare")
    )
    docs = once.groupBy("k", "p").agg(
        F.max(F.struct("shape", F.col("b.cosine").alias("cosine"), F.col("b.back").alias("back"), F.col("b.own").alias("own"), F.col("b.plain").alias("plain"))).alias("best"),
        F.collect_set(F.when(F.col("b.clear"), F.struct("b.plain", "b.own"))).alias("versions"),
        F.greatest(*(F.coalesce(F.sum(F.when(F.col("shape") == s, F.col("n"))), F.lit(0)) for s in (LINE, BLOCK, TEXT))).alias("n"),
        F.count("*").alias("parts"),
        F.array_distinct(F.flatten(F.collect_list("t"))).alias("t"),
        F.max("rare").alias("rare"),
    )
    docs = staged(docs.withColumn("unit", F.monotonically_increasing_id()), "licence-documents")
    # paragraphs that licences share are told apart by what else the document holds
    free = [i for i, (n, _, _) in enumerate(entries) if not family(n)[1]]
    mergeable = docs.where((F.col("parts") > 1) & (F.col("best.shape") < TEXT) & F.col("best.plain").isin([n for n in names if not family(n)[1]]))
    merged = best(mergeable, free).select("unit", F.col("cosine").alias("all_cosine"), of([n for n, _, _ in entries], F.col("i")).alias("all_own"))
    docs = docs.join(merged, "unit", "left")
    apart = F.array_sort(F.transform(F.filter("versions", lambda v: v["plain"] == F.col("best.plain")), lambda v: v["own"]))
    own = F.when(F.col("all_own").isNotNull(), F.col("all_own")).when(~of(full, -F.col("best.back")) & (F.size(apart) > 1), F.array_join(apart, "/"))
    hits = staged(
        docs.select("k", "p", own.otherwise(F.col("best.own")).alias("own"), F.coalesce("all_cosine", "best.cosine").alias("cosine"), "n"), "licences"
    )
    rows = df.select(F.col(key).alias("k"), F.col(path).alias("p"), F.length(value).alias("size")).join(
        hits.select(F.col("k").alias("hk"), F.col("p").alias("hp"), "own", "cosine", "n"),
        F.col("k").eqNullSafe(F.col("hk")) & F.col("p").eqNullSafe(F.col("hp")),
        "left",
    )
    rows = staged(rows.drop("hk", "hp"), "scanned")
    files = (
        rows.where(F.col("own").isNotNull() & F.col("p").isNotNull() & (F.col("n") >= WHOLE * F.col("size")))
        .groupBy(F.get(ancestors(F.col("p")), F.lit(0)).alias("dir"), "own")
        .agg(F.count("*").alias("files"))
        .groupBy("dir")
        .agg(F.max_by("own", F.struct("files", F.transform(F.split("own", ""), lambda c: -F.ascii(c)))).alias("given"))
    )
    files = staged(files, "licence-files")
    # directories, not documents, look for their nearest ancestor: a directory with very many documents asks once
    dirs = rows.where("p is not null").select(F.get(ancestors(F.col("p")), F.lit(0)).alias("at")).distinct()
    asked = dirs.select("at", F.posexplode(F.concat(F.array("at"), F.when(F.col("at") != "", ancestors(F.col("at"))).otherwise(F.array().cast("array<string>")))).alias("far", "dir"))
    near = asked.join(files, "dir").groupBy("at").agg(F.min(F.struct("far", "dir", "given")).alias("from"))
    near = staged(near, "inherited")
    done = rows.withColumn("at", F.get(ancestors(F.col("p")), F.lit(0))).join(near, "at", "left")
    return done.select(
        F.col("k").alias(key),
        F.col("own").alias("own_license"),
        F.col("cosine").alias("own_cosine"),
        F.coalesce("own", "from.given").alias("license"),
        F.when(F.col("own").isNotNull(), "text").otherwise(F.col("from.dir")).alias("via"),
    )


def _idf(total: int, count: int) -> float:
    return round(log((1 + total) / (1 + count)) + 1, 9)
