"""Text of a chart: frequencies, names, positions, elevations."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Patterns (fixed values).
FREQUENCY = r"\b(1[0-3]\d\.\d{1,3}|2\d{2}\.\d{1,3})(?:[^\d]|$)"
ICAO = r"\b(L[FG][A-Z]{2}|EG[A-Z]{2}|EH[A-Z]{2}|LG[A-Z]{2})\b"
LATITUDE = r"(?i)(\d{1,3})\s+(\d{1,2})\s+(\d{1,2})\s*([NS])"
LONGITUDE = r"(?i)(\d{1,3})\s+(\d{1,2})\s+(\d{1,2})\s*([EW])"
TICK = r"(\d{1,3})\s*°\s*(\d{1,2})\s*['′]\s*([NSEW])"
ALTITUDE = r"(\d{2,5})\s*(?:ft|FT)\b"
HEADING = r"\b(\d{3})\b"
ROUTE = r"\b([ULBH][A-Z]?\d{1,3})\b"
WAYPOINT = r"^[A-Z]{3,5}$"
HOLDING = r"(?i)\b(HOLD(?:ING)?|INBOUND|OUTBOUND|RACETRACK)\b"
REPORTING = r"(?i)\b(NHP|VRP)\b"
RUNWAY = r"(?i)\b(PAPI|MEHT|RWY|THR|TORA|TODA|LDA)\b"
HELIPAD = r"\bH\d+\b"
AIRPORT_ELEVATION = r"(?i)ALT\s+AD\s*[:\s]\s*(\d+)"
OBSTACLE_WORDS = "OBSTACLE OBST WARNING MAST TOWER CHIMNEY CRANE STACK PYLON ANTENNA".split()
HELI_WORDS = "HELIPAD HELIPORT HELICOPTER".split()
#: Service words in order of precedence (fixed values).
SERVICES = (
    ("ARRIVAL", "APP"), ("ARRIVAL WEST", "APP"), ("ARRIVAL EAST", "APP"), ("TOWER WEST", "TWR"), ("TOWER EAST", "TWR"), ("TWR", "TWR"), ("TOWER", "TWR"), ("APP", "APP"),
    ("APPROACH", "APP"), ("GND", "GND"), ("GROUND", "GND"), ("ATIS", "ATIS"), ("AFIS", "FIS"), ("FIS", "FIS"), ("A/A", "other"),
)
#: Words that look like waypoint names and are none (fixed values).
NOT_WAYPOINTS = (
    "VFR IFR AIP NIL TWR APP GND FIS NDB VOR DME RWY SIA ULM DEP SIV DTHR RFFS ACB AVT ZNM LINFO REES THR TMA CTR ATZ SID STAR GPS ILS LOC TXT ALT LAT LON LONG VAR OCA ATS ATT CAP VUE ACT "
    "ADD AGL ATC ADF AFF AFN AFS AGC AGR AGS OCH MSA MDA MKR MAG MAP LLZ FAF FAP FAT RVR TDZ TCH SDF PAR NPA IAF IAP DH DA AMDT CHG REFS INFO PAPI MEHT TORA TODA LDA ASD "
    "FR GP RY DE AD SVC NON ONG AVI EG OS LN"
).split()


def frequencies(text: Column) -> Column:
    """array of frequency texts, first to last, repeats dropped."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(FREQUENCY), 1))


def icao_codes(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(text, F.lit(ICAO), 1))


def dms_to_degrees(text: Column, pattern: str) -> Column:
    """Signed degrees of the first position of ``pattern`` (LATITUDE or LONGITUDE); null if there is none."""
    part = lambda k: F.nullif(F.regexp_extract(text, pattern, k), F.lit(""))
    value = part(1).cast("double") + part(2).cast("double") / 60.0 + part(3).cast("double") / 3600.0
    return F.when(F.upper(part(4)).isin("S", "W"), -value).otherwise(value)


def elevations(text: Column) -> Column:
    """struct(msl, agl): the first two digit groups of two digits or more, '' where absent."""
    groups = F.filter(F.regexp_extract_all(text, F.lit(r"(\d+)"), 1), lambda x: F.length(x) >= 2)
    return F.struct(F.coalesce(F.get(groups, 0), F.lit("")).alias("msl"), F.coalesce(F.get(groups, 1), F.lit("")).alias("agl"))


def is_waypoint(text: Column, blacklist=NOT_WAYPOINTS) -> Column:
    t = F.trim(text)
    return t.rlike(WAYPOINT) & ~t.isin(*blacklist)


def obstacle_number(text: Column, low: int = 50, high: int = 2000) -> Column:
    """The height if the text is a bare number of three or four digits in bounds, else null."""
    n = F.when(F.trim(text).rlike(r"^\d{3,4}$"), F.trim(text).cast("int"))
    return F.when(n.between(low, high), n)


def printable_share(text: Column) -> Column:
    return F.length(F.regexp_replace(text, r"[^ -~]", "")) / F.nullif(F.length(text), F.lit(0))


def service(row: Column, services=SERVICES) -> Column:
    """Service of an upper-cased text row: the first word in order of precedence that it contains, else other."""
    out = F.lit("other")
    for word, name in reversed(services):
        out = F.when(F.contains(row, F.lit(word)), name).otherwise(out)
    return out


def is_helipad_label(text: Column, keywords=tuple(HELI_WORDS)) -> Column:
    hit = text.rlike(HELIPAD)
    for k in keywords:
        hit = hit | F.contains(F.upper(text), F.lit(k))
    return hit


def airport_elevation(text: Column) -> Column:
    return F.nullif(F.regexp_extract(text, AIRPORT_ELEVATION, 1), F.lit("")).cast("int")


def keyword_hits(text: Column, keywords) -> Column:
    """array of the keywords that stand as words in the upper-cased text, in keyword order."""
    return F.array_intersect(F.array(*map(F.lit, keywords)), F.split(F.upper(text), r"[^A-Z0-9]+"))


def edge_marker(text: Column, x: Column, y: Column, width, height, lat=(34, 45), lon=(20, 30), margin: float = 0.08) -> Column:
    """'lat', 'lon' or null: a two-digit degree label near a side (latitudes) or near top or bottom (longitudes)."""
    n = F.when(F.trim(text).rlike(r"^\d{2}$"), F.trim(text).cast("int"))
    side = (x < width * margin) | (x > width * (1 - margin))
    rim = (y < height * margin) | (y > height * (1 - margin))
    return F.when(n.between(*lat) & side, "lat").when(n.between(*lon) & rim, "lon")


def strip_fence(text: Column) -> Column:
    """Text without a surrounding code fence."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.trim(text), r"^```[a-zA-Z]*\s*", ""), r"\s*```$", ""))


def position_label(lat: Column, lon: Column) -> Column:
    return F.format_string("%.4fN %.4fW", lat, -lon)
