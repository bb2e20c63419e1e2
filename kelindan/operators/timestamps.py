"""Normalising timestamps of mixed notation, precision and zone.

Every notation is one branch of a single regular expression with named groups. One ``regexp_replace`` turns a value into
its components; calendar ranges are then checked and instants assembled by integer day arithmetic, all inside the JVM.
"""

from __future__ import annotations

from zoneinfo import available_timezones

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Month names, Indonesian and English, in full and short.
MONTHS = {
    1: "januari january jan",
    2: "februari pebruari february feb peb",
    3: "maret march mar mrt",
    4: "april apr",
    5: "mei may",
    6: "juni june jun",
    7: "juli july jul",
    8: "agustus august agu ags agt agust aug",
    9: "september sept sep",
    10: "oktober october okt oct",
    11: "november nopember nov nop",
    12: "desember december des dec",
}
# Weekday names, which are read and set aside.
WEEKDAYS = (
    "senin selasa rabu kamis jumat jum'at sabtu minggu ahad sen sel rab kam jum sab min mgg monday tuesday wednesday thursday "
    "friday saturday sunday mon tue tues wed thu thur thurs fri sat sun"
)
# Named zones, minutes east of UTC.
ZONES = {
    "z": 0, "utc": 0, "gmt": 0, "wib": 420, "wita": 480, "wit": 540, "cet": 60, "cest": 120, "est": -300, "edt": -240,
    "aest": 600, "aedt": 660,
}

#: name of the branch -> (pattern, may a time of day follow?); groups are named <component><branch letter>.
DATE_FORMATS: dict[str, tuple[str, bool]] = {
    "year first": (r"(?<ya>\d{4})(?<pa>[-/.])(?<ma>\d{1,2})\k<pa>(?<da>\d{1,2})", True),
    "day first": (r"(?<db>\d{1,2})(?<pb>[-/.])(?<mb>\d{1,2})\k<pb>(?<yb>\d{4})", True),
    "day, month name": (r"(?<dc>\d{1,2})(?:st|nd|rd|th)?[ -]?(?<mc>[a-z]+)\.?,?[ -]?(?<yc>\d{4})", True),
    "month name, day": (r"(?<md>[a-z]+)\.? ?(?<dd>\d{1,2})(?:st|nd|rd|th)?,? ?(?<yd>\d{4})", True),
    "month name": (r"(?:bulan )?(?<me>[a-z]+)\.?,? ?(?<ye>\d{4})", False),
    "year, month": (r"(?<yf>\d{4})[-/.](?<mf>\d{1,2})", False),
    "month, year": (r"(?<mg>\d{1,2})[-/.](?<yg>\d{4})", False),
    "digits": (r"(?<yh>\d{4})(?<mh>\d{2})(?<dh>\d{2})(?<uh>(?<hh>\d{2})(?<ih>\d{2})(?<sh>\d{2}))?", False),
    "epoch": (r"(?<ek>\d{10})(?:\d{3})?", False),
}
_TIME = (
    r"(?:t| ?[,|] ?| ?\{\{!\}\} ?| (?:pukul|pkl\.?|jam|at) | - | )"
    r"(?<hx>\d{1,2})(?<px>[:.])(?<ix>\d{2})(?:\k<px>(?<sx>\d{2})(?:[.,]\d+)?)?(?: ?(?<ax>[ap])\.?m\.?)?"
    r"(?: ?\(?(?<zx>(?:utc|gmt)?[+-]\d{1,2}(?::?\d{2})?|" + "|".join(sorted(ZONES, key=lambda z: (-len(z), z))) + r")\)?)?"
)


def _pattern() -> str:
    timed = "|".join(p for p, t in DATE_FORMATS.values() if t)
    bare = "|".join(p for p, t in DATE_FORMATS.values() if not t)
    day = "|".join(sorted(WEEKDAYS.split(), key=lambda w: (-len(w), w)))
    return rf"^(?:(?:{day})\.?,? ?)?(?:\(?(?:{timed})\)?(?:{_TIME})?|\(?(?:{bare})\)?)$"


PATTERN = _pattern()
_PARTS = [
    ("y", "abcdefgh"), ("m", "abcdefgh"), ("d", "abcdh"), ("h", "hx"), ("i", "hx"), ("s", "hx"), ("a", "x"), ("z", "x"), ("u", "h"), ("e", "k"),
]
_MARK = "\u0001"
TEMPLATE = _MARK + "\u0002".join("".join(f"${{{part}{branch}}}" for branch in branches) for part, branches in _PARTS)


def _lookup(entries: dict[str, int]) -> Column:
    return F.create_map(*[F.lit(x) for kv in entries.items() for x in kv])


def _two(c: str) -> str:
    return f"lpad(cast({c} as string), 2, '0')"


def normalise_timestamps(df: DataFrame, value: str, zone: str, out: str = "norm", default_zone: str = "Asia/Jakarta") -> DataFrame:
    """Adds ``out``: ``YYYY-MM``, ``YYYY-MM-DD`` or, for a time of day, ``YYYY-MM-DDTHH:MM:SSZ``; null where ``value`` denotes no
    real day, month or instant (null, blank and free text, impossible dates and times, offsets beyond 14 hours).

    ``zone`` names a column with an IANA zone for wall clocks without one; null, blank or unknown zones count as
    ``default_zone``. A wall clock that occurred twice is the earlier instant; one that was skipped takes the offset before
    the change. Columns of ``df`` stay, ``out`` replaces one of its name; working columns never clash with them, as the
    components live in one struct of a reserved name that is dropped. Repeated rows stay repeated.
    """
    known = sorted(available_timezones())
    clean = F.lower(F.trim(F.regexp_replace(F.col(value), r"[\s\u00a0\u2007\u2009\u202f\ufeff]+", " ")))
    names = {name: number for number, words in MONTHS.items() for name in words.split()}
    names |= {str(n): n for n in range(1, 13)} | {f"{n:02d}": n for n in range(1, 10)}
    p, steps = "__ts_", []

    def add(frame: DataFrame, **columns: str | Column) -> DataFrame:
        """One projection of working columns; Catalyst keeps apart what is dear and used more than once."""
        steps.extend(columns)
        return frame.withColumns({p + k: F.expr(v) if isinstance(v, str) else v for k, v in columns.items()})

    work = add(df, one=F.regexp_replace(clean, PATTERN, TEMPLATE))
    work = add(work, c=F.when(F.col(p + "one").startswith(_MARK), F.split(F.substring(F.col(p + "one"), 2, 1 << 20), "\u0002")))
    work = add(
        work,
        y=f"try_cast({p}c[0] as int)",
        m=F.try_element_at(_lookup(names), F.col(p + "c")[1]),
        d=f"try_cast({p}c[2] as int)",
        h=f"try_cast({p}c[3] as int)",
        i=f"coalesce(try_cast({p}c[4] as int), 0)",
        s=f"coalesce(try_cast({p}c[5] as int), 0)",
        ap=f"{p}c[6]",
        z=f"{p}c[7]",
        zd=F.regexp_replace(F.col(p + "c")[7], "[^0-9+-]", ""),
        epoch=f"try_cast({p}c[9] as bigint)",
        month_only=f"{p}c[2] = ''",
        utc=f"{p}c[8] <> ''",
        tz=F.when(F.trim(F.col(zone)).isin(known), F.trim(F.col(zone))).otherwise(F.lit(default_zone)),
    )
    work = add(
        work,
        hour=f"case when {p}ap = '' then if({p}h < 24, {p}h, null) when {p}h between 1 and 12 then {p}h % 12 + if({p}ap = 'p', 12, 0) end",
        last=f"case when {p}m in (4, 6, 9, 11) then 30 when {p}m <> 2 then 31 "
        f"when {p}y % 4 = 0 and ({p}y % 100 <> 0 or {p}y % 400 = 0) then 29 else 28 end",
        # Years run from March, so that the leap day comes last.
        yr=f"{p}y - if({p}m <= 2, 1, 0)",
        zh=f"try_cast(substring({p}zd, 2, if(length({p}zd) in (2, 4), 1, 2)) as int)",
        zm=f"coalesce(try_cast(substring({p}zd, if(length({p}zd) = 4, 3, 4), 2) as int), 0)",
    )
    work = add(
        work,
        # Days since 1970-01-01 of a real civil date.
        days=f"case when {p}y >= 1 and {p}m is not null and {p}d between 1 and {p}last then {p}yr div 400 * 146097 + ({p}yr % 400) * 365 "
        f"+ ({p}yr % 400) div 4 - ({p}yr % 400) div 100 + (153 * ({p}m + if({p}m > 2, -3, 9)) + 2) div 5 + {p}d - 1 - 719468 end",
        offset=F.when(F.col(p + "utc"), F.lit(0))
        .when(F.expr(f"{p}zd <> ''"), F.expr(f"case when {p}zh * 60 + {p}zm <= 840 and {p}zm < 60 then ({p}zh * 60 + {p}zm) * if({p}zd like '-%', -1, 1) end"))
        .otherwise(F.try_element_at(_lookup(ZONES), F.col(p + "z"))),
    )
    work = add(work, local=f"case when {p}hour is not null and {p}i < 60 and {p}s < 60 then {p}days * 86400 + {p}hour * 3600 + {p}i * 60 + {p}s end")
    wall = F.unix_seconds(F.to_utc_timestamp(F.timestamp_seconds(F.col(p + "local")), F.col(p + "tz")))
    work = add(
        work,
        t=F.coalesce(F.col(p + "epoch"), F.when(F.expr(f"{p}z = '' and not {p}utc"), wall).otherwise(F.expr(f"{p}local - {p}offset * 60"))),
    )
    work = add(work, n=f"cast(floor({p}t / 86400) as bigint) + 719468")
    work = add(work, doe=f"{p}n % 146097")
    work = add(work, yoe=f"({p}doe - {p}doe div 1460 + {p}doe div 36524 - {p}doe div 146096) div 365")
    work = add(work, doy=f"{p}doe - (365 * {p}yoe + {p}yoe div 4 - {p}yoe div 100)")
    work = add(work, mp=f"(5 * {p}doy + 2) div 153")
    text = (
        f"concat(lpad(cast({p}n div 146097 * 400 + {p}yoe + if({p}mp < 10, 0, 1) as string), 4, '0'), '-', {_two(f'({p}mp + if({p}mp < 10, 3, -9))')}, "
        f"'-', {_two(f'({p}doy - (153 * {p}mp + 2) div 5 + 1)')}, 'T', {_two(f'({p}t div 3600 % 24)')}, ':', {_two(f'({p}t div 60 % 60)')}, ':', "
        f"{_two(f'({p}t % 60)')}, 'Z')"
    )
    written = f"concat(lpad(cast({p}y as string), 4, '0'), '-', {_two(p + 'm')}"
    norm = F.expr(
        f"case when {p}epoch is not null then {text} when {p}month_only then if({p}y >= 1 and {p}m is not null, {written}), null) "
        f"when {p}days is null then null when {p}h is null then {written}, '-', {_two(p + 'd')}) else {text} end"
    )
    # A partition id counts as not deterministic: a filter on the result then stays above it, instead of being pushed down with
    # the whole computation written out again and again in it.
    return work.withColumn(out, F.when(F.spark_partition_id() >= 0, norm)).drop(*[p + k for k in steps])
