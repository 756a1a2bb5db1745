"""Secret scans: spans by pattern, judged by how many owners a value has in the whole corpus.

Candidate values are hashed and counted by distinct repositories and owners.
A value that many owners or many repositories hold is a copied example; one that
few hold looks live, and its occurrences without a telling name are spans as well.
These are looked for in runs of value characters outside the base spans, and in
such runs cut at ``=``, at ``/`` and at dots, so that ``?t=VALUE``, ``path/VALUE``
and ``VALUE.`` are found; each way of cutting leaves disjoint pieces.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkcols.session import staged

VALUE = r"[A-Za-z0-9+/_.=-]"
#: Kinds in their order, with pattern, prefix of the value inside the match, least length of the value
ASSIGN = r"""(?:(?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?"""
KINDS = (
    ("assign", ASSIGN + VALUE + "+", ASSIGN, 8),
    ("access", r"AKIA[A-Z0-9]+", None, 16),
    ("hex", r"[0-9a-f]{32,}", None, 32),
    ("bare", "", None, 8),
)
#: characters of a piece for each way of cutting; a value without a name has a digit or a capital after a small letter
PIECES = (r"[A-Za-z0-9+/_.=-]", r"[A-Za-z0-9+/_.-]", r"[A-Za-z0-9+_.-]", r"[A-Za-z0-9+_-]")
#: values that more owners, or more repositories, than this hold are examples
MAX_OWNERS, MAX_REPOSITORIES = 2, 10
#: spans collected before they are put into a list of lists, so that long lists aren't copied for every span
CHUNK = 128
SPAN = "struct<start:int,kind:int,end:int,value:string>"


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value worked out once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def pairs(text: Column, pattern: str) -> Column:
    """Every match with the gap before it."""
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.split(text, pattern, -1)
    return F.zip_with(matches, F.slice(gaps, 1, F.size(matches)), lambda m, g: F.struct(m.alias("hit"), g.alias("gap")))


def value_of(hit: Column, lead: str | None) -> Column:
    return hit if lead is None else F.regexp_replace(hit, "^" + lead, "")


def spans(text: Column, order: int, pattern: str | None = None) -> Column:
    """Start, end, order of the kind and value of every match, found as the gaps that splitting leaves."""
    _, own, lead, least = KINDS[order]
    pattern = pattern or own

    def step(state: Column, pair: Column) -> Column:
        start = state["at"] + F.length(pair["gap"])
        end = start + F.length(pair["hit"])
        value = value_of(pair["hit"], lead)
        span = F.array(F.struct(start.alias("start"), F.lit(order).alias("kind"), end.alias("end"), value.alias("value")))
        fits, full = F.length(value) >= least, F.size(state["found"]) >= CHUNK
        return F.struct(
            end.alias("at"),
            F.when(fits & full, span).when(fits, F.concat(state["found"], span)).otherwise(state["found"]).alias("found"),
            F.when(fits & full, F.concat(state["done"], F.array(state["found"]))).otherwise(state["done"]).alias("done"),
        )

    none, no_lists = F.array().cast(f"array<{SPAN}>"), F.array().cast(f"array<array<{SPAN}>>")
    start = F.struct(F.lit(0).alias("at"), none.alias("found"), no_lists.alias("done"))
    end = lambda s: F.flatten(F.concat(s["done"], F.array(s["found"])))
    return F.when(text.rlike(pattern), F.aggregate(pairs(text, pattern), start, step, end)).otherwise(none)


def masked(text: Column, order: int) -> Column:
    """``text`` with blanks for the matches of a kind, at unchanged positions."""
    _, pattern, lead, least = KINDS[order]

    def blanked(p: Column) -> Column:
        fits = F.length(value_of(p["hit"], lead)) >= least
        return F.concat(p["gap"], F.when(fits, F.repeat(F.lit(" "), F.length(p["hit"]))).otherwise(p["hit"]))

    tail = F.element_at(F.split(text, pattern, -1), -1)
    return F.when(text.rlike(pattern), F.concat(F.array_join(F.transform(pairs(text, pattern), blanked), ""), tail)).otherwise(text)


def bare_pattern(cut: int) -> str:
    """A whole run of a cut's characters that looks like a value."""
    chars = PIECES[cut]
    return rf"(?<!{chars})(?={chars}*?(?:[0-9]|[a-z][A-Z])){chars}{{8,}}"


def bare_spans(text: Column) -> Column:
    """Runs of value characters outside base spans, and their pieces, with repeats; closing dots don't belong to a value."""

    def cut(run: Column) -> Column:
        inner = [
            F.transform(
                spans(run["value"], 3, bare_pattern(i)),
                lambda s: F.struct(
                    (run["start"] + s["start"]).alias("start"),
                    s["kind"].alias("kind"),
                    (run["start"] + s["end"]).alias("end"),
                    s["value"].alias("value"),
                ),
            )
            for i in range(1, len(PIECES))
        ]
        none = F.array().cast(f"array<{SPAN}>")
        return F.concat(F.array(run), F.when(run["value"].rlike("[=/.]"), F.concat(*inner)).otherwise(none))

    def trimmed(s: Column) -> Column:
        value = F.rtrim(s["value"], F.lit("."))
        end = s["start"] + F.length(value)
        return F.struct(s["start"].alias("start"), s["kind"].alias("kind"), end.alias("end"), value.alias("value"))

    whole = let(
        masked(text, 0), lambda a: let(masked(a, 1), lambda b: let(masked(b, 2), lambda c: spans(c, 3, bare_pattern(0))))
    )
    # a piece that several cuts give is there several times; array_distinct compares structs pairwise
    found = F.transform(F.flatten(F.transform(whole, cut)), trimmed)
    return F.filter(found, lambda s: F.length(s["value"]) >= KINDS[3][3])


def written(found: Column) -> Column:
    """Spans as kind:start:end in their order, comma-joined."""
    names = F.array(*(F.lit(k[0]) for k in KINDS))
    return F.concat_ws(",", F.transform(found, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])))


def scan(
    df: DataFrame,
    text: str = "text",
    key: str = "doc_id",
    owner: str = "source",
    max_owners: int = MAX_OWNERS,
    max_repositories: int = MAX_REPOSITORIES,
) -> DataFrame:
    """One row per row of ``df``: the key, ``found`` (base spans), ``added`` (other places of live values), ``n_live``, ``n_example``.

    A repository is a value of ``key``, an owner one of ``owner`` (null counts
    as one of either; a key of two owners counts for both). A value is known by its characters without closing dots and
    equals signs. It is live if no more than ``max_owners`` owners and
    ``max_repositories`` repositories hold it. Of added spans that overlap, the
    one that starts first stays, of those the longest. Null and empty texts have
    no spans. Repeated rows give repeated results and count once; other columns
    are not looked at, whatever their names.
    """
    value = F.coalesce(F.col(text), F.lit(""))
    rows = df.select(
        F.col(key).alias("key"),
        F.xxhash64(F.coalesce(F.col(owner), F.lit(""))).alias("own"),
        F.xxhash64(value).alias("body"),
        F.array_sort(F.concat(*(spans(value, i) for i in range(3)))).alias("found"),
        bare_spans(value).alias("bare"),
    )
    rows = staged(rows, "secrets")
    each = (
        rows.where((F.size("found") > 0) | (F.size("bare") > 0))
        .select("key", "own", "body", F.explode(F.concat("found", "bare")).alias("s"))
        .distinct()
        .withColumn("hash", F.sha2(F.rtrim(F.col("s")["value"], F.lit("=.")), 256))
    )
    # distinct repositories and owners of a hash in steps, so that a common value is reduced before each shuffle
    held = each.groupBy("hash", "own", "key").agg(F.max((F.col("s")["kind"] < 3).cast("int")).alias("named"))
    held = held.groupBy("hash", "own").agg(F.count("*").alias("keys"), F.max("named").alias("named"))
    live = (
        held.groupBy("hash")
        .agg(F.count("*").alias("owners"), F.sum("keys").alias("keys"), F.max("named").alias("named"))
        .where((F.col("named") == 1) & (F.col("owners") <= max_owners) & (F.col("keys") <= max_repositories))
        .select("hash")
    )
    base = F.col("s")["kind"] < 3
    place = Window.partitionBy("key", "own", "body", "base").orderBy(F.col("s")["start"], F.col("s")["end"].desc())
    before = F.max(F.col("s")["end"]).over(place.rowsBetween(Window.unboundedPreceding, -1))
    judged = each.join(live, "hash").select("key", "own", "body", "s", base.alias("base")).withColumn("before", before)
    judged = judged.where(F.col("base") | F.col("before").isNull() | (F.col("before") <= F.col("s")["start"]))
    extra = judged.groupBy(F.col("key").alias("k"), F.col("own").alias("o"), F.col("body").alias("b")).agg(
        F.array_sort(F.collect_list(F.when(~F.col("base"), F.col("s")))).alias("added"),
        F.count("*").alias("n_live"),
        F.count(F.when(F.col("base"), 1)).alias("n_base"),
    )
    same = rows["key"].eqNullSafe(extra["k"]) & (rows["own"] == extra["o"]) & (rows["body"] == extra["b"])
    none = F.array().cast(rows.schema["found"].dataType)
    return rows.join(extra, same, "left").select(
        F.col("key").alias(key),
        "found",
        F.coalesce("added", none).alias("added"),
        F.coalesce("n_live", F.lit(0)).alias("n_live"),
        (F.size("found") - F.coalesce("n_base", F.lit(0))).alias("n_example"),
    )


def digest(found: DataFrame, key: str = "doc_id") -> DataFrame:
    """The registered query's columns."""
    count = lambda i: F.size(F.filter("found", lambda s: s["kind"] == i)).cast("long")
    return found.select(
        key,
        *(count(i).alias(f"n_{KINDS[i][0]}") for i in range(3)),
        F.sha2(written(F.col("found")), 256).alias("base_sha256"),
        written(F.array_sort(F.concat("found", "added"))).alias("spans"),
        "n_live",
        "n_example",
    )
