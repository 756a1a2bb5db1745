"""Scalar expressions. Every function here returns a built-in Column expression."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from sparkcols.schemas import U64

ColumnOrName = Column | str


def _col(c: ColumnOrName) -> Column:
    return F.col(c) if isinstance(c, str) else c


# Byte units of 1024 and the time units of the report format.
BYTE_UNITS = ["B", "KB", "MB", "GB", "TB", "PB"]
TIME_UNITS = [(3600.0, "hour"), (60.0, "min"), (1.0, "sec"), (1e-3, "ms"), (1e-6, "us")]

_FRACTION = 2**52


def fixed_point(value: ColumnOrName, digits: int) -> Column:
    """Text of a double with up to three decimals, rounded on its exact binary value.

    ``format_string('%.2f')`` rounds the shortest decimal text of the double
    instead, so 2.055 (stored just below) would become 2.06. The fraction of a
    double from 1 upwards is a whole multiple of 2^-52, so it is scaled to a
    long and rounded half to even in integer arithmetic.
    """
    x = F.abs(_col(value))
    whole = F.floor(x)
    scaled = ((x - whole) * float(_FRACTION)).cast("long") * 10**digits
    low = F.shiftright(scaled, 52)
    rest = scaled.bitwiseAND(F.lit(_FRACTION - 1))
    up = (rest > _FRACTION // 2) | ((rest == _FRACTION // 2) & (low % 2 == 1))
    units = whole * 10**digits + low + up.cast("int")
    sign = F.when(_col(value) < 0, "-").otherwise("")
    text = F.lpad((units % 10**digits).cast("string"), digits, "0")
    return F.concat(sign, F.floor(units / 10**digits).cast("string"), F.lit("."), text)


def _stepped(steps: list[tuple[Column, Column]], last: Column) -> Column:
    """The value of the first step whose condition holds."""
    out = last
    for condition, value in reversed(steps):
        out = F.when(condition, value).otherwise(out)
    return out


def readable_bytes(n: ColumnOrName) -> Column:
    """Byte count as text such as ``1.5 MB``."""
    size = _col(n).cast("double")
    below = [size < 1024.0 ** (power + 1) for power in range(len(BYTE_UNITS) - 1)]
    powers = [F.lit(1024.0**power) for power in range(len(BYTE_UNITS))]
    units = [F.lit(unit) for unit in BYTE_UNITS]
    amount = size / _stepped(list(zip(below, powers)), powers[-1])
    return F.concat(fixed_point(amount, 1), F.lit(" "), _stepped(list(zip(below, units)), units[-1]))


def readable_time(seconds: ColumnOrName) -> Column:
    """Duration as text such as ``1.50 ms``."""
    s = _col(seconds).cast("double")
    amounts = [s / 3600, s / 60, s, s * 1e3, s * 1e6]
    reached = [s >= floor for floor, _ in TIME_UNITS]
    units = [F.lit(unit) for _, unit in TIME_UNITS]
    amount = _stepped(list(zip(reached, amounts)), s * 1e9)
    return F.concat(fixed_point(amount, 2), F.lit(" "), _stepped(list(zip(reached, units)), F.lit("ns")))


def safe_ratio(a: ColumnOrName, b: ColumnOrName, missing: float | None = None) -> Column:
    """``a / b``, or infinity when the divisor is not positive; ``missing`` when it is null."""
    a, b = _col(a), _col(b)
    return F.when(b > 0, a / b).when(b.isNotNull(), F.lit(float("inf"))).otherwise(F.lit(missing).cast("double"))


def digest(column: ColumnOrName, salt: str = "") -> Column:
    """md5 text of a key, with an optional salt in front."""
    key = _col(column).cast("string")
    return F.md5(F.concat(F.lit(salt), key) if salt else key)


def hash_bits(column: ColumnOrName, salt: str = "") -> Column:
    """60 hash bits of a key as a non-negative long."""
    return F.conv(F.substring(digest(column, salt), 1, 15), 16, 10).cast("long")


def rand_u64(column: ColumnOrName, salt: str = "") -> Column:
    """A 64-bit unsigned value drawn from a key, equal on every evaluation."""
    return F.conv(F.substring(digest(column, salt), 1, 16), 16, 10).cast(U64)


def epoch_millis(ts: ColumnOrName) -> Column:
    """Whole milliseconds since 1970; a timestamp without a zone is read as UTC.

    Casting such a timestamp would read it in the session's zone. Its distance
    from 1970 does not depend on any setting. The type test is a constant, so
    the plan keeps only the branch that applies.
    """
    t = _col(ts)
    since = t - F.expr("TIMESTAMP_NTZ '1970-01-01 00:00:00'")
    part = {unit: F.extract(F.lit(unit), since) for unit in ("DAY", "HOUR", "MINUTE", "SECOND")}
    minutes = (part["DAY"].cast("long") * 24 + part["HOUR"]) * 60 + part["MINUTE"]
    wall = minutes * 60_000 + F.floor(part["SECOND"] * 1000).cast("long")
    return F.when(F.typeof(t) == "timestamp_ntz", wall).otherwise(F.unix_millis(t.cast("timestamp")))


def _uuid_time(ts: ColumnOrName) -> Column:
    """The 12 leading digits of a time-ordered UUID."""
    millis = epoch_millis(ts)
    beyond = F.raise_error(F.concat(F.lit("no UUID for the time "), millis.cast("string"))).cast("string")
    return F.when((millis >= 0) & (millis < F.lit(2**48)), F.lpad(F.lower(F.hex(millis)), 12, "0")).when(millis.isNotNull(), beyond)


def uuid_bytes(ts: ColumnOrName, key: ColumnOrName) -> Column:
    """Time-ordered UUID (version 7) as 16 bytes, which order as its text does.

    48 bits of milliseconds, then 72 bits of the key's digest. A time before
    1970 or beyond 48 bits stops the job.
    """
    tail = digest(key)
    return F.unhex(F.concat(_uuid_time(ts), F.lit("7"), F.substring(tail, 1, 3), F.lit("8"), F.substring(tail, 4, 15)))


def uuid_text(column: ColumnOrName) -> Column:
    """A 16-byte UUID as text of 36 characters."""
    digits = F.lower(F.hex(_col(column)))
    return F.concat_ws("-", *[F.substring(digits, at, n) for at, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))])


def uuid_v7(ts: ColumnOrName, key: ColumnOrName) -> Column:
    """Time-ordered UUID (version 7) as text."""
    head, tail = _uuid_time(ts), digest(key)
    return F.concat(
        F.substring(head, 1, 8), F.lit("-"), F.substring(head, 9, 4),
        F.lit("-7"), F.substring(tail, 1, 3),
        F.lit("-8"), F.substring(tail, 4, 3),
        F.lit("-"), F.substring(tail, 7, 12),
    )


def id_text(column: ColumnOrName) -> Column:
    """A number ID as text; for 16-byte UUIDs see ``uuid_text``."""
    return _col(column).cast("string")


def concat_key(*columns: ColumnOrName, sep: str = "|") -> Column:
    """One text key from several columns.

    Two different keys collide when a value holds the separator; grouping on
    the columns themselves does not.
    """
    return F.concat_ws(sep, *[_col(c).cast("string") for c in columns])


def modulo(column: ColumnOrName, k: int) -> Column:
    return _col(column) % F.lit(k)


def pick(values: list[str], position: ColumnOrName) -> Column:
    """The element of a constant list at a 1-based position."""
    return F.element_at(F.array(*[F.lit(v) for v in values]), _col(position).cast("int"))
