"""Makers and product lines of bars in titles and searches."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Makers, in order.
MAKERS = [
    ("PAMP", r"\bpamp(?:\s+suisse)?\b"),
    ("Geiger", r"\bgeiger(?:\s+edelmetalle)?\b"),
    ("Perth Mint", r"\bperth\s+mint\b"),
    ("Scottsdale", r"\bscottsdale\b"),
    ("Valcambi", r"\bvalcambi\b"),
    ("Heraeus", r"\bheraeus\b"),
    ("Credit Suisse", r"\bcredit\s+suisse\b"),
]
#: Product lines of a maker, in order: name, pattern in titles, other names in searches.
LINES = {
    "Geiger": [
        ("Square", r"\bsquare\b", ["square bar"]),
        ("Original", r"\boriginal\b", ["original bar"]),
        ("Schloss Guldengossa", r"\bschloss\b|\bguldengossa\b", ["schloss", "guldengossa", "castle"]),
        ("Security Line", r"\bsecurity\s*line\b", ["security"]),
        ("Fireworks", r"\bfirework", ["firework"]),
        ("Tree of Life", r"\btree\s+of\s+life\b", ["tree of life", "tara"]),
        ("Love", r"\blove\b|\bheart", ["hearts", "valentines", "valentine"]),
        ("Christmas", r"\bchristmas\b|\bxmas\b", ["merry christmas", "xmas", "holiday"]),
        ("USA Edition", r"\busa\s*edition\b|\bold\s*glory\b", ["old glory", "usa"]),
        ("Shamrock", r"\bshamrock\b", ["irish", "clover"]),
        ("Edelmetalle", r"\bedelmetalle\b", ["edelmetalle"]),
    ],
    "PAMP": [
        ("Fortuna", r"\bfortuna\b", ["lady fortuna"]),
        ("Rosa", r"\brosa\b", ["rose"]),
        ("Lady of Liberty", r"\blady\s+of\s+liberty\b|\bliberty\b", ["liberty"]),
        ("Veriscan", r"\bveriscan\b", []),
        ("Love", r"\blove\b", ["heart"]),
        ("Romanesque Cross", r"\bromanesque\b", ["cross"]),
        ("America the Free", r"\bamerica\s+the\s+free\b", ["bald eagle"]),
        ("Multigram", r"\bmultigram\b", ["divisible", "breakable"]),
        ("Coca-Cola", r"\bcoca[- ]?cola\b|\bcoke\b", ["coke", "coca cola"]),
        ("Zodiac - Aries", r"\baries\b", ["ram"]),
        ("Zodiac - Taurus", r"\btaurus\b", ["bull"]),
        ("Zodiac - Gemini", r"\bgemini\b", ["twins"]),
        ("Zodiac - Cancer", r"\bcancer\b", ["crab"]),
        ("Zodiac - Leo", r"\bleo\b", ["lion"]),
        ("Zodiac - Virgo", r"\bvirgo\b", ["maiden"]),
        ("Zodiac - Libra", r"\blibra\b", ["scales"]),
        ("Zodiac - Scorpio", r"\bscorpio\b", ["scorpion"]),
        ("Zodiac - Sagittarius", r"\bsagittarius\b", ["archer"]),
        ("Zodiac - Capricorn", r"\bcapricorn\b", ["goat"]),
        ("Zodiac - Aquarius", r"\baquarius\b", ["water bearer"]),
        ("Zodiac - Pisces", r"\bpisces\b", ["fish"]),
        ("Lunar", r"\blunar\b", ["zodiac"]),
    ],
    "Perth Mint": [
        ("Cast", r"\bcast\b", ["poured"]),
        ("Minted", r"\bminted\b", []),
        ("Kangaroo", r"\bkangaroo\b", []),
        ("Lakshmi", r"\blakshmi\b", []),
        ("Dragon", r"\bdragon\b", ["dragon bar"]),  # not "dragon ball"
    ],
    "Scottsdale": [
        ("Stacker", r"\bstacker\b", ["stackable"]),
        ("Cast", r"\bcast\b", ["poured", "chunky"]),
        ("Tombstone", r"\btombstone\b", ["nugget"]),
    ],
    "Valcambi": [("CombiBar", r"\bcombi\s*bar\b", ["combi", "divisible"])],
    "Heraeus": [("Kinebar", r"\bkinebar\b", ["hologram"])],
    "Credit Suisse": [
        ("Classic", r"\bclassic\b", []),
        ("Statue of Liberty", r"\bstatue\s+of\s+liberty\b|\bliberty\b", ["liberty"]),
    ],
}
BLOT = r"\bdragon\b\s*ball"


def _low(title: Column) -> Column:
    return F.regexp_replace(F.lower(title), BLOT, "x")


def makers(title: Column) -> Column:
    """All makers that a title names, in order, as an array; none for null."""
    low = F.lower(F.coalesce(title, F.lit("")))
    return F.array_compact(F.array(*[F.when(low.rlike(p), name) for name, p in MAKERS]))


def maker(title: Column) -> Column:
    return F.get(makers(title), F.lit(0))


def canonical_maker(name: Column) -> Column:
    """A maker's name as it is written here, whatever its case and blanks; null for others."""
    low = F.lower(F.regexp_replace(F.trim(name), r"\s+", " "))
    out = F.when(low == "pamp suisse", "PAMP")
    for known, _ in MAKERS:
        out = out.when(low == known.lower(), known)
    return out


def _line(own: Column, holds) -> Column:
    out = F.when(F.lit(False), "")
    for name, lines in LINES.items():
        first = F.when(F.lit(False), "")
        for line, pattern, others in lines:
            first = first.when(holds(line, pattern, others), line)
        out = out.when(own == name, first)
    return out


def line_in_title(own: Column, title: Column) -> Column:
    """The first product line of the maker ``own`` (a canonical name) whose pattern the title holds."""
    return _line(own, lambda line, pattern, others: _low(title).rlike(pattern))


def line_in_search(own: Column, search: Column) -> Column:
    """The same for a search, where other names count as well, as whole words."""

    def holds(line: str, pattern: str, others: list[str]) -> Column:
        words = [r"\b" + o.replace(" ", r"\s+") + r"\b" for o in others]
        return _low(search).rlike("|".join([pattern, *words]))

    return _line(own, holds)


def line_by_hint(own: Column, hint: Column) -> Column:
    """The line that a field of a form names: by its name, another name, or its pattern."""
    low = F.trim(_low(hint))
    return _line(own, lambda line, pattern, others: low.isin(line.lower(), *others) | low.rlike(pattern))


def mismatch(title: Column, own: Column, line: Column) -> Column:
    """The rule by which a title of another bar than the line ``line`` of ``own`` (a canonical name) goes:
    another maker in it, or another line of this maker; null if it stays. Titles without a line stay,
    and all do where maker or line is not given."""
    wanted = own.isNotNull() & line.isNotNull()
    other = F.exists(makers(title), lambda m: m != own)
    found = line_in_title(own, title)
    return F.when(~F.coalesce(wanted, F.lit(False)), F.lit(None)).when(other, "barBrandMismatch").when(found != line, "barSeriesMismatch")
