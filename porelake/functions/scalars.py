"""Column functions: names, checksums, dates, publishers, formulas, geometry, bond orders, t-factors, heat capacity."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable

from pyspark.sql import Column, functions as F

# Publishers by DOI prefix.
PUBLISHERS = {"10.1021": "ACS", "10.1039": "RSC", "10.1002": "WILEY", "10.1038": "Nature", "10.1126": "Science", "10.1016": "SciDirect", "10.1007": "Springer", "10.3390": "MDPI"}

# Constants of the harmonic heat capacity and of unit conversion.
AVOGADRO, BOLTZMANN, PLANCK_CM = 6.02214076e23, 1.3806504e-23, 1.98644586e-23
THZ_TO_WAVENUMBER = 33.35641


def structure_name(path: Column) -> Column:
    """The file name without every `.cif` in it."""
    return F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\.cif", "")


def file_stem(path: Column) -> Column:
    """The file name without its last extension."""
    return F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"(.)\.[^.]*$", "$1")


def checksum(content: Column) -> Column:
    """SHA-256 of bytes or text, in lower-case hex."""
    return F.sha2(content.cast("binary"), 256)


def publisher(doi: Column) -> Column:
    """By the exact text before the first slash; other DOIs are `other`, null and `unknown` are `unknown`."""
    prefix = F.element_at(F.split(doi, "/"), 1)
    names = F.create_map(*(F.lit(x) for pair in PUBLISHERS.items() for x in pair))
    return F.when(doi.isNull() | (prefix == "unknown"), "unknown").otherwise(F.coalesce(names[prefix], F.lit("other")))


def date_from_parts(parts: Column) -> Column:
    """[y, m, d] of which the last may be missing -> YYYY-MM-DD, YYYY-MM or YYYY."""
    part = lambda i: F.lpad(F.get(parts, F.lit(i)).cast("string"), 2, "0")
    year = F.get(parts, F.lit(0)).cast("string")
    return F.when(F.size(parts) == 3, F.concat_ws("-", year, part(1), part(2))).when(F.size(parts) == 2, F.concat_ws("-", year, part(1))).otherwise(year)


def publication_date(metadata: Column) -> Column:
    """Metadata JSON -> the date published online, else in print, else of the first licence, else `unknown`."""
    read = lambda path: F.from_json(F.get_json_object(metadata, path), "array<int>")
    found = F.coalesce(read("$.message.published-online.date-parts[0]"), read("$.message.published-print.date-parts[0]"), read("$.message.license[0].start.date-parts[0]"))
    return F.when(found.isNull(), "unknown").otherwise(date_from_parts(found))


def formula_tokens(formula: Column) -> Column:
    """The element symbols of a formula, in order."""
    return F.regexp_extract_all(formula, F.lit(r"([A-Z][a-z]?)(\d*)"), 1)


def formula_of(elements: Iterable[str], explicit: bool = False) -> str:
    """Symbols from A to Z with their counts; a count of one is left out unless explicit."""
    return "".join(f"{e}{n if n > 1 or explicit else ''}" for e, n in sorted(Counter(elements).items()))


def formula_column(elements: Column, explicit: bool = False) -> Column:
    """formula_of() of an array column."""
    count = lambda e: F.size(F.filter(elements, lambda x: x == e)).cast("string")
    return F.array_join(F.transform(F.array_sort(F.array_distinct(elements)), lambda e: F.concat(e, count(e) if explicit else F.when(count(e) == "1", "").otherwise(count(e)))), "")


def tokens_of(formula: str) -> list[str]:
    return [m[0] for m in re.findall(r"([A-Z][a-z]?)(\d*)", formula)]


def structure_identifier(nodes: Column, linkers: Column, topology: Column, catenation: Column, reference: Column) -> Column:
    """[node].[node].linker MOFid-v2.<topology>.cat<catenation>;<reference>"""
    boxed = F.array_join(F.transform(nodes, lambda n: F.concat(F.lit("["), n, F.lit("]"))), ".")
    return F.concat(F.concat_ws(".", boxed, F.array_join(linkers, ".")), F.lit(" MOFid-v2."), topology, F.lit(".cat"), catenation.cast("string"), F.lit(";"), reference)


def percentage(part: Column, whole: Column) -> Column:
    """100 part / whole with two places and a blank before the sign."""
    return F.format_string("%.2f %%", 100.0 * part / whole)


def wrapped(delta: Column) -> Column:
    """A difference of fractional coordinates, brought to the nearest image along its axis (half to even)."""
    return delta - F.rint(delta)


def vector_angle(x1: Column, y1: Column, z1: Column, x2: Column, y2: Column, z2: Column) -> Column:
    """Degrees between two vectors; a dot product of exactly zero gives zero."""
    dot = x1 * x2 + y1 * y2 + z1 * z2
    cosine = dot / F.sqrt(x1 * x1 + y1 * y1 + z1 * z1) / F.sqrt(x2 * x2 + y2 * y2 + z2 * z2)
    return F.when(dot == 0.0, F.lit(0.0)).otherwise(F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cosine)))))


def plane_through(p: tuple[Column, ...], q: tuple[Column, ...], r: tuple[Column, ...]) -> tuple[Column, Column, Column, Column]:
    """Normal (p-q) x (r-q) and offset p . normal of the plane through three points."""
    u, v = [a - b for a, b in zip(p, q)], [a - b for a, b in zip(r, q)]
    n = (u[1] * v[2] - u[2] * v[1], u[2] * v[0] - u[0] * v[2], u[0] * v[1] - u[1] * v[0])
    return *n, p[0] * n[0] + p[1] * n[1] + p[2] * n[2]


def plane_distance(point: tuple[Column, ...], plane: tuple[Column, ...]) -> Column:
    """Signed distance of a point from a plane."""
    a, b, c, d = plane
    return (a * point[0] + b * point[1] + c * point[2] - d) / F.sqrt(a * a + b * b + c * c)


def plane_projection(point: tuple[Column, ...], plane: tuple[Column, ...]) -> tuple[Column, Column, Column]:
    a, b, c, d = plane
    k = (a * point[0] + b * point[1] + c * point[2] - d) / (a * a + b * b + c * c)
    return point[0] - a * k, point[1] - b * k, point[2] - c * k


def t4(second: Column, largest: Column) -> Column:
    return (360 - (second + largest)) / 141.0


def t5(second: Column, largest: Column) -> Column:
    return (largest - second) / 60.0


def t6(gamma: Column) -> Column:
    return gamma / 180.0


def bond_order(element: Column, distance: Column, a: Column, c: Column) -> Column:
    """10 ** (a distance + c) with the coefficients of the neighbour; that of hydrogen is 1.25 at most."""
    order = F.pow(F.lit(10.0), a * distance + c)
    return F.when(element == "H", F.least(order, F.lit(1.25))).otherwise(order)


def heat_capacity(wavenumber: Column, temperature: Column | float) -> Column:
    """Molar harmonic heat capacity (J/mol/K) of a mode; modes that aren't positive contribute nothing."""
    t = temperature if isinstance(temperature, Column) else F.lit(float(temperature))
    x = F.lit(PLANCK_CM / BOLTZMANN) * wavenumber / t
    e = F.exp(x)
    return F.when(wavenumber > 0, F.lit(AVOGADRO * BOLTZMANN) * x * x * e / ((e - 1) * (e - 1))).otherwise(F.lit(0.0))


def heat_capacity_of(wavenumber: float, temperature: float) -> float:
    if wavenumber <= 0:
        return 0.0
    x = PLANCK_CM / BOLTZMANN * wavenumber / temperature
    return AVOGADRO * BOLTZMANN * x * x * math.exp(x) / (math.exp(x) - 1) ** 2


def presence_label(has_metal: Column, has_carbon: Column) -> Column:
    """Four labels of a structure by whether it has metal and carbon."""
    return F.when(has_metal & has_carbon, "has metal and carbon").when(has_metal, "missing carbon").when(has_carbon, "missing metal").otherwise("missing metal and carbon")


def three_way(x: Column, y: Column) -> Column:
    return F.when(x > y, 1).when(x < y, -1).otherwise(0)


def same_list(x: Column, y: Column) -> Column:
    """Equal length and elements."""
    return (F.size(x) == F.size(y)) & (x == y)


def first_known(key: Column, *maps: Column) -> Column:
    """A feature's value from the first of the maps that has it."""
    return F.coalesce(*(m[key] for m in maps))


def bond_limit(r1: Column, r2: Column) -> Column:
    """The distance below which two sites bond, by their radii: tolerance 0.2 if either is heavy, else 0.5."""
    return r1 + r2 + F.when((r1 > 1.95) | (r2 > 1.95), 0.2).otherwise(0.5)
