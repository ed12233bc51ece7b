"""Keys at given places of a table's order, found by counting instead of sorting.

A search keeps a bracket of keys around each wanted place. A round takes a fixed-size sample of the keys inside, with the
smallest hashes, picks pivots from it around the place, and counts the rows below each pivot in one narrow
aggregate. That shrinks a bracket by about the sample's size, so a table of 10^12 rows takes three or four rounds of
two scans over its key columns. The last few keys are then fetched and the wanted one is read off. Nothing is
sorted, shuffled or written, and every count is exact: the sample only says where to look.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F, types as T

from tablewright.functions.columns import balanced, data_type, quoted

# Keys that a round samples, pivots that it counts, and keys that may be fetched at the end.
SAMPLE, PIVOTS, FETCHED = 2_000, 31, 2_000


@dataclass(frozen=True)
class Place:
    """A key of the table's order: the values that spell it out, and the rows in front of it."""

    values: tuple
    before: int


def _plain(df: DataFrame, name: str) -> Column:
    """A key column in a form that comes back from the driver unchanged."""
    kind = data_type(df, name)
    if isinstance(kind, T.TimestampType):
        return F.unix_micros(quoted(name))
    if isinstance(kind, (T.DateType, T.TimestampNTZType)):
        return quoted(name).cast("string")
    return quoted(name)


def literal(df: DataFrame, name: str, value: object) -> Column:
    """A value of _plain as a constant of the column's type."""
    kind = data_type(df, name)
    if value is None:
        return F.lit(None).cast(kind)
    if isinstance(kind, T.TimestampType):
        return F.timestamp_micros(F.lit(value))
    return F.lit(value).cast(kind)


def _key(df: DataFrame, names: Sequence[str]) -> Column:
    return F.struct(*[quoted(name).alias(f"k{i}") for i, name in enumerate(names)])


def _bound(df: DataFrame, names: Sequence[str], values: Sequence[object]) -> Column:
    return F.struct(*[literal(df, name, value).alias(f"k{i}") for i, (name, value) in enumerate(zip(names, values))])


def precedes(df: DataFrame, names: Sequence[str], values: Sequence[object]) -> Column:
    """True for rows whose key comes before the given one; ascending, nulls first.

    Keys are compared as structs, whose constants are data of the plan, and by their first column besides, which reaches the scan.
    """
    first, value = quoted(names[0]), values[0]
    plain = first.isNull() if value is None else first.isNull() | (first <= literal(df, names[0], value))
    return plain & (_key(df, names) < _bound(df, names, values))


def reaches(df: DataFrame, names: Sequence[str], values: Sequence[object]) -> Column:
    """True for rows whose key is the given one or comes after it."""
    after = _key(df, names) >= _bound(df, names, values)
    return after if values[0] is None else (quoted(names[0]) >= literal(df, names[0], values[0])) & after


def _order(values: tuple) -> tuple:
    """Sorts keys on the driver as Spark sorts them."""
    def rank(value: object) -> tuple:
        if value is None:
            return (0, 0)
        if isinstance(value, float) and value != value:
            return (2, 0)
        return (1, value.encode() if isinstance(value, str) else bytes(value) if isinstance(value, bytearray) else value)

    return tuple(rank(value) for value in values)


class _Search:
    """The bracket around one place: the largest key known to be at or before it, the smallest known to be after it."""

    def __init__(self, place: int, rows: int):
        self.place, self.rows = place, rows
        self.low: Place | None = None  # at or before the place
        self.high: Place | None = None  # after the place
        self.found: Place | None = None

    @property
    def below(self) -> int:
        return 0 if self.low is None else self.low.before

    @property
    def inside(self) -> int:
        return (self.rows if self.high is None else self.high.before) - self.below

    def filter(self, df: DataFrame, names: Sequence[str]) -> Column:
        sides = []
        if self.low is not None:
            sides.append(reaches(df, names, self.low.values))
        if self.high is not None:
            sides.append(precedes(df, names, self.high.values))
        return balanced(Column.__and__, sides) if sides else F.lit(True)

    def learn(self, place: Place) -> None:
        if place.before <= self.place and (self.low is None or _order(place.values) > _order(self.low.values)):
            self.low = place
        if place.before > self.place and (self.high is None or _order(place.values) < _order(self.high.values)):
            self.high = place


def keys_at(df: DataFrame, names: Sequence[str], places: Sequence[int], rows: int | None = None) -> list[Place]:
    """The keys at 0-based places in ascending order of the key columns, nulls first, as Places.

    Equal keys may be any number: a Place says how many rows come before its key.
    """
    keys = df.select(*[quoted(name) for name in dict.fromkeys(names)])
    rows = df.count() if rows is None else rows
    if any(not 0 <= place < rows for place in places):
        raise ValueError(f"places {list(places)} are not all within {rows} rows")
    searches = {place: _Search(place, rows) for place in places}
    while open_ := [s for s in searches.values() if s.found is None]:
        wide = [s for s in open_ if s.inside > FETCHED]
        for search in open_:
            if search.inside <= FETCHED:
                _finish(keys, names, search)
        if wide:
            _shrink(keys, names, wide)
    return [searches[place].found for place in places]


def _sampled(keys: DataFrame, names: Sequence[str], search: _Search, size: int) -> list[tuple]:
    """Distinct keys in the bracket, those with the smallest hashes; at most `size`, whatever the table's size."""
    plain = [_plain(keys, name).alias(f"k{i}") for i, name in enumerate(names)]
    inside = keys.where(search.filter(keys, names)).select(*plain, F.xxhash64(*[quoted(name) for name in names]).alias("h"))
    found = {tuple(row)[:-1] for row in inside.orderBy("h").limit(size).collect()}
    return sorted(found, key=_order)


def _counted(keys: DataFrame, names: Sequence[str], pivots: Sequence[tuple]) -> list[Place]:
    below = [F.count_if(F.col("key") < _bound(keys, names, pivot)).alias(f"n{i}") for i, pivot in enumerate(pivots)]
    counts = keys.select(_key(keys, names).alias("key")).agg(*below).head()
    return [Place(pivot, counts[i]) for i, pivot in enumerate(pivots)]


def _shrink(keys: DataFrame, names: Sequence[str], searches: Sequence[_Search]) -> None:
    """One round: pivots from a sample around each place, all counted exactly in one aggregate."""
    samples: dict[tuple, list[tuple]] = {}
    pivots: dict[tuple, tuple] = {}
    for search in searches:
        bracket = (search.low, search.high)
        if str(bracket) not in samples:
            samples[str(bracket)] = _sampled(keys, names, search, SAMPLE)
        sample = samples[str(bracket)]
        middle = (search.place - search.below) * len(sample) // search.inside
        reach = max(int(3 * len(sample) ** 0.5), PIVOTS // 2 + 1)
        first, last = max(middle - reach, 0), min(middle + reach, len(sample) - 1)
        step = max((last - first) // (PIVOTS - 3), 1)
        for i in {0, len(sample) - 1, *range(first, last + 1, step)}:
            pivots.setdefault(_order(sample[i]), sample[i])
    before = [(search.low, search.high) for search in searches]
    counted = _counted(keys, names, [pivots[key] for key in sorted(pivots)])
    for search, bounds in zip(searches, before):
        for place in counted:
            search.learn(place)
        if (search.low, search.high) == bounds:
            _step_on(keys, names, search)


def _step_on(keys: DataFrame, names: Sequence[str], search: _Search) -> None:
    """The bracket begins with a key that very many rows share: either it is the one, or the search goes on behind it."""
    low = search.low
    if low is None:  # the bracket starts at the table's first key
        first = keys.select(*[_plain(keys, name).alias(f"k{i}") for i, name in enumerate(names)], *[quoted(n).alias(f"s{i}") for i, n in enumerate(names)])
        row = first.orderBy(*[f"s{i}" for i in range(len(names))]).limit(1).head()
        search.low = Place(tuple(row)[: len(names)], 0)
        return
    same = balanced(Column.__and__, [quoted(n).eqNullSafe(literal(keys, n, v)) for n, v in zip(names, low.values)])
    inside = search.filter(keys, names)
    equal = keys.agg(F.count_if(inside & same).alias("n")).head()["n"]
    if search.place < low.before + equal:
        search.found = low
        return
    rest = keys.where(inside & ~same).select(*[_plain(keys, n).alias(f"k{i}") for i, n in enumerate(names)], *[quoted(n).alias(f"s{i}") for i, n in enumerate(names)])
    row = rest.orderBy(*[f"s{i}" for i in range(len(names))]).limit(1).head()
    search.low = Place(tuple(row)[: len(names)], low.before + equal)


def _finish(keys: DataFrame, names: Sequence[str], search: _Search) -> None:
    """Fetch the few keys left in the bracket and read off the wanted one."""
    plain = [_plain(keys, name).alias(f"k{i}") for i, name in enumerate(names)]
    left = sorted((tuple(row) for row in keys.where(search.filter(keys, names)).select(*plain).collect()), key=_order)
    wanted = left[search.place - search.below]
    before = search.below + sum(1 for values in left if _order(values) < _order(wanted))
    search.found = Place(wanted, before)


def between(df: DataFrame, names: Sequence[str], low: Place | None, high: Place | None) -> DataFrame:
    """The rows whose keys lie from one place on to another, that one excluded."""
    found = df
    if low is not None:
        found = found.where(reaches(df, names, low.values))
    if high is not None:
        found = found.where(precedes(df, names, high.values))
    return found
