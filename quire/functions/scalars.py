"""Column to Column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ELLIPSIS = "…"


#: All characters that count as white space.
BLANKS = r"[\t-\r\x1c- \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+"


def collapse_clip(s: Column, n: int) -> Column:
    """White space to single blanks, trimmed; longer than n characters: the first n - 1 and an ellipsis. Null counts as empty.

    Only what holds the first n + 1 characters that aren't blank is looked at, however long the text is.
    """
    one = BLANKS[:-1]
    head = F.regexp_extract(F.coalesce(s, F.lit("")), f"^{one}*+(?:[^{one[1:-1]}]{one}*+){{0,{n + 1}}}", 0)
    flat = F.trim(F.regexp_replace(head, BLANKS, " "))
    return F.when(F.length(flat) > n, F.concat(F.substring(flat, 1, n - 1), F.lit(ELLIPSIS))).otherwise(flat)


def doc_date(s: Column) -> Column:
    """YYYYMMDD[HHmmSS], with D: before it or without, as a date and time; all else as it is."""
    day, full = r"^(?:D:)?(\d{4})(\d{2})(\d{2})", r"^(?:D:)?(\d{4})(\d{2})(\d{2})(\d{2})(\d{2})(\d{2})"
    shown = F.regexp_replace(s, day + "(?s).*$", "$1-$2-$3")
    return F.when(s.rlike(full), F.regexp_replace(s, full + "(?s).*$", "$1-$2-$3 $4:$5:$6")).when(s.rlike(day), shown).otherwise(s)


def human_size(n: Column) -> Column:
    """Whole KB (1 at least) below 1 MB, MB with one decimal below 1 GB, then GB with two; halves go to the even neighbour."""
    def scaled(unit: int, digits: int) -> Column:
        whole = F.bround(n.cast("double") * 10**digits / unit, 0).cast("long")
        return whole if not digits else F.concat(F.floor(whole / 10**digits).cast("string"), F.lit("."), F.lpad((whole % 10**digits).cast("string"), digits, "0"))

    kb = F.greatest(scaled(1 << 10, 0), F.lit(1)).cast("string")
    return F.when(n < 1 << 20, F.concat(kb, F.lit(" KB"))).when(n < 1 << 30, F.concat(scaled(1 << 20, 1), F.lit(" MB"))).otherwise(F.concat(scaled(1 << 30, 2), F.lit(" GB")))


def path_key(s: Column) -> Column:
    """A path's lexical key: one kind of separator, no empty or dot segments, .. takes its parent away."""
    parts = F.filter(F.split(F.replace(s, F.lit("\\"), F.lit("/")), "/"), lambda x: (x != "") & (x != "."))
    kept = F.aggregate(parts, F.array().cast("array<string>"), lambda a, x: F.when(x == "..", F.slice(a, 1, F.greatest(F.size(a) - 1, F.lit(0)))).otherwise(F.concat(a, F.array(x))))
    return F.concat(F.when(s.startswith("/"), "/").otherwise(""), F.array_join(kept, "/"))


def boxes_touch(ax0: Column, ay0: Column, ax1: Column, ay1: Column, bx0: Column, by0: Column, bx1: Column, by1: Column) -> Column:
    """Strict overlap of two boxes."""
    return (ax0 < bx1) & (bx0 < ax1) & (ay0 < by1) & (by0 < ay1)


def same_line(ay0: Column, ay1: Column, by0: Column, by1: Column) -> Column:
    """Either band's middle lies inside the other band."""
    a, b = (ay0 + ay1) / 2, (by0 + by1) / 2
    return a.between(by0, by1) | b.between(ay0, ay1)


def x_overlap(ax0: Column, ax1: Column, bx0: Column, bx1: Column, slack: float = 0.01) -> Column:
    return (F.least(ax1, bx1) - F.greatest(ax0, bx0)) > slack


def center_in(x0: Column, y0: Column, x1: Column, y1: Column, bx0: Column, by0: Column, bx1: Column, by1: Column) -> Column:
    return ((x0 + x1) / 2).between(bx0, bx1) & ((y0 + y1) / 2).between(by0, by1)


def same_color(a: Column, b: Column, slack: float = 0.01) -> Column:
    """As many channels, each within the slack; two absent colours are the same."""
    near = F.forall(F.zip_with(a, b, lambda x, y: F.abs(x - y) <= slack), lambda x: x)
    return F.when(a.isNull() | b.isNull(), a.isNull() & b.isNull()).otherwise((F.size(a) == F.size(b)) & near)


def rect_key(x0: Column, y0: Column, x1: Column, y1: Column, digits: int = 1) -> Column:
    return F.concat_ws(",", *[F.bround(c, digits).cast("string") for c in (x0, y0, x1, y1)])


def segment_distance(px: Column, py: Column, ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    """Distance of a point from a segment; from its end where the segment has no length."""
    dx, dy = bx - ax, by - ay
    length = dx * dx + dy * dy
    t = F.when(length == 0, 0.0).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), ((px - ax) * dx + (py - ay) * dy) / F.when(length == 0, 1).otherwise(length))))
    return F.hypot(px - (ax + t * dx), py - (ay + t * dy))


def norm_rotation(degrees: Column) -> Column:
    """A quarter turn of 0, 90, 180 or 270; an error for anything else."""
    d = degrees.cast("int")
    return F.when(d % 90 == 0, F.pmod(d, F.lit(360))).otherwise(F.raise_error(F.lit("not a quarter turn")).cast("int"))


def rotate_box(x0: Column, y0: Column, x1: Column, y1: Column, rotation: Column, width: Column, height: Column) -> tuple[Column, Column, Column, Column]:
    """A box of the unrotated page on the page as shown."""
    pick = lambda a, b, c, d: F.when(rotation == 90, b).when(rotation == 180, c).when(rotation == 270, d).otherwise(a)
    return pick(x0, height - y1, width - x1, y0), pick(y0, x0, height - y1, width - x1), pick(x1, height - y0, width - x0, y1), pick(y1, x1, height - y0, width - x0)


def unrotate_point(x: Column, y: Column, rotation: Column, width: Column, height: Column) -> tuple[Column, Column]:
    """A point of the page as shown on the unrotated page."""
    pick = lambda a, b, c, d: F.when(rotation == 90, b).when(rotation == 180, c).when(rotation == 270, d).otherwise(a)
    return pick(x, y, width - x, width - y), pick(y, height - x, height - y, x)


#: What kinds of marks and fields are called.
MARK_NOUNS = {"textbox": "text box", "ink": "ink", "line": "line", "shape": "shape", "stamp": "stamp", "imagestamp": "image", "newfield": "form field"}
FIELD_LABELS = {"text": "Text Field", "checkbox": "Checkbox", "dropdown": "Dropdown"}


def _named(kind: Column, names: dict[str, str], otherwise: Column) -> Column:
    known = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
    return F.coalesce(F.try_element_at(known, kind), otherwise)


def mark_noun(kind: Column) -> Column:
    """What a kind of mark is called; a kind without a name of its own by itself, in small letters."""
    return _named(kind, MARK_NOUNS, F.lower(kind))


def kind_label(kind: Column) -> Column:
    """What a kind of field is called; others by themselves, each word with a capital."""
    return _named(kind, FIELD_LABELS, F.initcap(kind))


def foreign_label(kind: Column, author: Column) -> Column:
    """A foreign mark's kind, and by whom it is where that is known."""
    return F.concat(kind, F.when(F.coalesce(author, F.lit("")) != "", F.concat(F.lit(" by "), author)).otherwise(""))
