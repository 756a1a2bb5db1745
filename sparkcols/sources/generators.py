"""Generators: every value is a function of the row's key.

The same rows come out for every partitioning and after any task retry, which
``rand(seed)`` does not promise. Each takes a table with a key column, so it
works on ``spark.range(n)`` and on a stored table alike.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from sparkcols.functions.scalars import hash_bits, pick, rand_u64

# Domains of the sales-like table.
CATEGORIES = 10
SUBCATEGORIES = 1000
AMOUNT_LIMIT = 1000
QUANTITY_LIMIT = 100
SEED = 42

# Components and actions that make up the event names.
COMPONENTS = [
    "button", "link", "icon", "card", "row", "cell", "chip", "tag", "avatar", "logo",
    "modal", "dialog", "tooltip", "popover", "toast", "sidebar", "navbar", "toolbar", "breadcrumb", "tab",
    "accordion", "carousel", "slider", "switch", "checkbox", "radio", "dropdown", "datepicker", "timepicker",
    "colorpicker", "textarea", "input", "form", "table", "list", "grid", "tree", "menu", "panel", "drawer",
    "badge", "banner", "alert", "progress", "spinner", "skeleton", "divider", "pagination", "stepper", "rating",
]
ACTIONS = [
    "click", "dblclick", "hover", "focus", "blur", "open", "close", "toggle", "submit", "reset",
    "select", "deselect", "expand", "collapse", "scroll", "drag", "drop", "resize", "load", "error",
]


def vocabulary(k: int) -> list[str]:
    """The first ``k`` event names, all actions of a component before the next component."""
    names = [f"{component}_{action}" for component in COMPONENTS for action in ACTIONS]
    if not 0 < k <= len(names):
        raise ValueError(f"k must be 1..{len(names)}")
    return names[:k]


def number_sequence(spark: SparkSession, n: int) -> DataFrame:
    return spark.range(n)


def uniform_columns(df: DataFrame, key: str, seed: int = SEED) -> DataFrame:
    """The sales-like table for the keys of ``df``; each column has a salt of its own,
    so columns are independent of each other."""
    bits = {c: hash_bits(key, f"{seed}:{c}:") for c in ("category", "subcategory", "amount", "quantity")}
    return df.select(
        F.col(key).alias("id"),
        F.concat(F.lit("cat_"), (bits["category"] % CATEGORIES).cast("string")).alias("category"),
        F.concat(F.lit("sub_"), (bits["subcategory"] % SUBCATEGORIES).cast("string")).alias("subcategory"),
        ((bits["amount"] % (AMOUNT_LIMIT * 100)) / 100).alias("amount"),
        (bits["quantity"] % QUANTITY_LIMIT + 1).alias("quantity"),
    )


def gen_uniform(spark: SparkSession, n: int, seed: int = SEED) -> DataFrame:
    return uniform_columns(number_sequence(spark, n), "id", seed)


def event_columns(df: DataFrame, key: str, k: int) -> DataFrame:
    """Event names taken in turn from a vocabulary of ``k`` names."""
    names = vocabulary(k)
    return df.select(
        F.col(key).alias("id"),
        pick(names, F.col(key) % k + 1).alias("event_type"),
        F.current_timestamp().alias("created_at"),
    )


def gen_events(spark: SparkSession, n: int, k: int) -> DataFrame:
    return event_columns(number_sequence(spark, n), "id", k)


def gen_values(spark: SparkSession, n: int) -> DataFrame:
    """Rows with a random unsigned 64-bit ``value`` for tables whose IDs are filled at insert."""
    return number_sequence(spark, n).select("id", rand_u64("id").alias("value"))
