"""Element reference data as a dimension table, one row for each element, and predicates on symbols."""

from __future__ import annotations

from functools import cache

from pyspark.sql import DataFrame, SparkSession

# Fixed values, in order of atomic number (symbols; each of the next tables: symbol and value).
SYMBOLS = (
    "H", "He", "Li", "Be", "B", "C", "N", "O", "F", "Ne", "Na", "Mg", "Al", "Si", "P", "S", "Cl", "Ar", "K", "Ca",
    "Sc", "Ti", "V", "Cr", "Mn", "Fe", "Co", "Ni", "Cu", "Zn", "Ga", "Ge", "As", "Se", "Br", "Kr", "Rb", "Sr", "Y",
    "Zr", "Nb", "Mo", "Tc", "Ru", "Rh", "Pd", "Ag", "Cd", "In", "Sn", "Sb", "Te", "I", "Xe", "Cs", "Ba", "La", "Ce",
    "Pr", "Nd", "Pm", "Sm", "Eu", "Gd", "Tb", "Dy", "Ho", "Er", "Tm", "Yb", "Lu", "Hf", "Ta", "W", "Re", "Os", "Ir",
    "Pt", "Au", "Hg", "Tl", "Pb", "Bi", "Po", "At", "Rn", "Fr", "Ra", "Ac", "Th", "Pa", "U", "Np", "Pu", "Am", "Cm",
    "Bk", "Cf", "Es", "Fm", "Md", "No", "Lr", "Rf", "Db", "Sg", "Bh", "Hs", "Mt", "Ds",
)
# Covalent radii (Å) that solvent cleaning uses.
CLEANING_RADII = {
    "H": 0.23,
    "He": 1.5,
    "Li": 1.28,
    "Be": 0.96,
    "B": 0.83,
    "C": 0.68,
    "N": 0.68,
    "O": 0.68,
    "F": 0.64,
    "Ne": 1.5,
    "Na": 1.66,
    "Mg": 1.41,
    "Al": 1.21,
    "Si": 1.2,
    "P": 1.05,
    "S": 1.02,
    "Cl": 0.99,
    "Ar": 1.51,
    "K": 2.03,
    "Ca": 1.76,
    "Sc": 1.7,
    "Ti": 1.6,
    "V": 1.53,
    "Cr": 1.39,
    "Mn": 1.61,
    "Fe": 1.52,
    "Co": 1.26,
    "Ni": 1.24,
    "Cu": 1.32,
    "Zn": 1.22,
    "Ga": 1.22,
    "Ge": 1.17,
    "As": 1.21,
    "Se": 1.22,
    "Br": 1.21,
    "Kr": 1.5,
    "Rb": 2.2,
    "Sr": 1.95,
    "Y": 1.9,
    "Zr": 1.75,
    "Nb": 1.64,
    "Mo": 1.54,
    "Tc": 1.47,
    "Ru": 1.46,
    "Rh": 1.42,
    "Pd": 1.39,
    "Ag": 1.45,
    "Cd": 1.54,
    "In": 1.42,
    "Sn": 1.39,
    "Sb": 1.39,
    "Te": 1.47,
    "I": 1.4,
    "Xe": 1.5,
    "Cs": 2.44,
    "Ba": 2.15,
    "La": 2.07,
    "Ce": 2.04,
    "Pr": 2.03,
    "Nd": 2.01,
    "Pm": 1.99,
    "Sm": 1.98,
    "Eu": 1.98,
    "Gd": 1.96,
    "Tb": 1.94,
    "Dy": 1.92,
    "Ho": 1.92,
    "Er": 1.89,
    "Tm": 1.9,
    "Yb": 1.87,
    "Lu": 1.87,
    "Hf": 1.75,
    "Ta": 1.7,
    "W": 1.62,
    "Re": 1.51,
    "Os": 1.44,
    "Ir": 1.41,
    "Pt": 1.36,
    "Au": 1.36,
    "Hg": 1.32,
    "Tl": 1.45,
    "Pb": 1.46,
    "Bi": 1.48,
    "Po": 1.4,
    "At": 1.21,
    "Rn": 1.5,
    "Fr": 2.6,
    "Ra": 2.21,
    "Ac": 2.15,
    "Th": 2.06,
    "Pa": 2.0,
    "U": 1.96,
    "Np": 1.9,
    "Pu": 1.87,
    "Am": 1.8,
    "Cm": 1.69,
    "Bk": 1.54,
    "Cf": 1.83,
    "Es": 1.5,
    "Fm": 1.5,
    "Md": 1.5,
    "No": 1.5,
    "Lr": 1.5,
    "Rf": 1.5,
    "Db": 1.5,
    "Sg": 1.5,
    "Bh": 1.5,
    "Hs": 1.5,
    "Mt": 1.5,
    "Ds": 1.5,
}

# Covalent radii (Å) that the analysis of metal sites uses.
SITE_RADII = {
    "H": 0.31,
    "He": 0.28,
    "Li": 1.28,
    "Be": 0.96,
    "B": 0.84,
    "C": 0.73,
    "N": 0.71,
    "O": 0.66,
    "F": 0.57,
    "Ne": 0.58,
    "Na": 1.66,
    "Mg": 1.41,
    "Al": 1.21,
    "Si": 1.11,
    "P": 1.07,
    "S": 1.05,
    "Cl": 1.02,
    "Ar": 1.06,
    "K": 2.03,
    "Ca": 1.76,
    "Sc": 1.7,
    "Ti": 1.6,
    "V": 1.53,
    "Cr": 1.39,
    "Mn": 1.5,
    "Fe": 1.42,
    "Co": 1.38,
    "Ni": 1.24,
    "Cu": 1.32,
    "Zn": 1.22,
    "Ga": 1.22,
    "Ge": 1.2,
    "As": 1.19,
    "Se": 1.2,
    "Br": 1.2,
    "Kr": 1.16,
    "Rb": 2.2,
    "Sr": 1.95,
    "Y": 1.9,
    "Zr": 1.75,
    "Nb": 1.64,
    "Mo": 1.54,
    "Tc": 1.47,
    "Ru": 1.46,
    "Rh": 1.42,
    "Pd": 1.39,
    "Ag": 1.45,
    "Cd": 1.44,
    "In": 1.42,
    "Sn": 1.39,
    "Sb": 1.39,
    "Te": 1.38,
    "I": 1.39,
    "Xe": 1.4,
    "Cs": 2.44,
    "Ba": 2.15,
    "La": 2.07,
    "Ce": 2.04,
    "Pr": 2.03,
    "Nd": 2.01,
    "Pm": 1.99,
    "Sm": 1.98,
    "Eu": 1.98,
    "Gd": 1.96,
    "Tb": 1.94,
    "Dy": 1.92,
    "Ho": 1.92,
    "Er": 1.89,
    "Tm": 1.9,
    "Yb": 1.87,
    "Lu": 1.87,
    "Hf": 1.75,
    "Ta": 1.7,
    "W": 1.62,
    "Re": 1.51,
    "Os": 1.44,
    "Ir": 1.41,
    "Pt": 1.36,
    "Au": 1.36,
    "Hg": 1.32,
    "Tl": 1.45,
    "Pb": 1.46,
    "Bi": 1.48,
    "Po": 1.4,
    "At": 1.5,
    "Rn": 1.5,
    "Fr": 2.6,
    "Ra": 2.21,
    "Ac": 2.15,
    "Th": 2.06,
    "Pa": 2.0,
    "U": 1.96,
    "Np": 1.9,
    "Pu": 1.87,
    "Am": 1.8,
    "Cm": 1.69,
}

# Typed radii (Å) that the bond-order check uses; U is absent from it.
TYPED_RADII = {
    "H": 0.38,
    "Li": 0.86,
    "Be": 0.53,
    "B": 1.01,
    "C": 0.88,
    "N": 0.86,
    "O": 0.89,
    "F": 0.82,
    "Na": 1.15,
    "Mg": 1.28,
    "Al": 1.53,
    "Si": 1.38,
    "P": 1.28,
    "S": 1.20,
    "Cl": 1.17,
    "K": 1.44,
    "Ca": 1.17,
    "Sc": 1.62,
    "Ti": 1.65,
    "V": 1.51,
    "Cr": 1.53,
    "Mn": 1.53,
    "Fe": 1.43,
    "Co": 1.31,
    "Ni": 1.33,
    "Cu": 1.31,
    "Zn": 1.41,
    "Ga": 1.40,
    "Ge": 1.35,
    "As": 1.39,
    "Se": 1.40,
    "Br": 1.39,
    "Rb": 1.65,
    "Sr": 1.30,
    "Y": 1.84,
    "Zr": 1.73,
    "Nb": 1.66,
    "Mo": 1.57,
    "Ru": 1.58,
    "Rh": 1.63,
    "Pd": 1.68,
    "Ag": 1.56,
    "Cd": 1.56,
    "In": 1.53,
    "Sn": 1.64,
    "Sb": 1.64,
    "Te": 1.65,
    "I": 1.58,
    "Cs": 1.85,
    "Ba": 1.52,
    "La": 1.91,
    "Ce": 1.98,
    "Pr": 1.75,
    "Nd": 1.92,
    "Sm": 1.89,
    "Eu": 1.83,
    "Gd": 1.79,
    "Tb": 1.82,
    "Dy": 1.79,
    "Ho": 1.63,
    "Er": 1.80,
    "Tm": 1.84,
    "Yb": 1.80,
    "Lu": 1.86,
    "Hf": 1.73,
    "W": 1.33,
    "Re": 1.29,
    "Ir": 1.50,
    "Pt": 1.66,
    "Au": 1.68,
    "Hg": 1.88,
    "Pb": 1.72,
    "Bi": 1.72,
    "Th": 1.97,
    "Np": 1.73,
    "Pu": 1.71,
}

# Standard atomic masses (u, IUPAC abridged).
MASSES = {
    "H": 1.008,
    "He": 4.0026,
    "Li": 6.94,
    "Be": 9.0122,
    "B": 10.81,
    "C": 12.011,
    "N": 14.007,
    "O": 15.999,
    "F": 18.998,
    "Ne": 20.18,
    "Na": 22.99,
    "Mg": 24.305,
    "Al": 26.982,
    "Si": 28.085,
    "P": 30.974,
    "S": 32.06,
    "Cl": 35.45,
    "Ar": 39.95,
    "K": 39.098,
    "Ca": 40.078,
    "Sc": 44.956,
    "Ti": 47.867,
    "V": 50.942,
    "Cr": 51.996,
    "Mn": 54.938,
    "Fe": 55.845,
    "Co": 58.933,
    "Ni": 58.693,
    "Cu": 63.546,
    "Zn": 65.38,
    "Ga": 69.723,
    "Ge": 72.63,
    "As": 74.922,
    "Se": 78.971,
    "Br": 79.904,
    "Kr": 83.798,
    "Rb": 85.468,
    "Sr": 87.62,
    "Y": 88.906,
    "Zr": 91.224,
    "Nb": 92.906,
    "Mo": 95.95,
    "Tc": 97.0,
    "Ru": 101.07,
    "Rh": 102.91,
    "Pd": 106.42,
    "Ag": 107.87,
    "Cd": 112.41,
    "In": 114.82,
    "Sn": 118.71,
    "Sb": 121.76,
    "Te": 127.6,
    "I": 126.9,
    "Xe": 131.29,
    "Cs": 132.91,
    "Ba": 137.33,
    "La": 138.91,
    "Ce": 140.12,
    "Pr": 140.91,
    "Nd": 144.24,
    "Pm": 145.0,
    "Sm": 150.36,
    "Eu": 151.96,
    "Gd": 157.25,
    "Tb": 158.93,
    "Dy": 162.5,
    "Ho": 164.93,
    "Er": 167.26,
    "Tm": 168.93,
    "Yb": 173.05,
    "Lu": 174.97,
    "Hf": 178.49,
    "Ta": 180.95,
    "W": 183.84,
    "Re": 186.21,
    "Os": 190.23,
    "Ir": 192.22,
    "Pt": 195.08,
    "Au": 196.97,
    "Hg": 200.59,
    "Tl": 204.38,
    "Pb": 207.2,
    "Bi": 208.98,
    "Po": 209.0,
    "At": 210.0,
    "Rn": 222.0,
    "Fr": 223.0,
    "Ra": 226.0,
    "Ac": 227.0,
    "Th": 232.04,
    "Pa": 231.04,
    "U": 238.03,
    "Np": 237.0,
    "Pu": 244.0,
    "Am": 243.0,
    "Cm": 247.0,
    "Bk": 247.0,
    "Cf": 251.0,
    "Es": 252.0,
    "Fm": 257.0,
    "Md": 258.0,
    "No": 259.0,
    "Lr": 262.0,
    "Rf": 267.0,
    "Db": 270.0,
    "Sg": 269.0,
    "Bh": 270.0,
    "Hs": 270.0,
    "Mt": 278.0,
    "Ds": 281.0,
}

# Pauling electronegativities; elements without one are left out.
ELECTRONEGATIVITIES = {
    "H": 2.20,
    "Li": 0.98,
    "Be": 1.57,
    "B": 2.04,
    "C": 2.55,
    "N": 3.04,
    "O": 3.44,
    "F": 3.98,
    "Na": 0.93,
    "Mg": 1.31,
    "Al": 1.61,
    "Si": 1.90,
    "P": 2.19,
    "S": 2.58,
    "Cl": 3.16,
    "K": 0.82,
    "Ca": 1.00,
    "Sc": 1.36,
    "Ti": 1.54,
    "V": 1.63,
    "Cr": 1.66,
    "Mn": 1.55,
    "Fe": 1.83,
    "Co": 1.88,
    "Ni": 1.91,
    "Cu": 1.90,
    "Zn": 1.65,
    "Ga": 1.81,
    "Ge": 2.01,
    "As": 2.18,
    "Se": 2.55,
    "Br": 2.96,
    "Rb": 0.82,
    "Sr": 0.95,
    "Y": 1.22,
    "Zr": 1.33,
    "Nb": 1.6,
    "Mo": 2.16,
    "Tc": 1.9,
    "Ru": 2.2,
    "Rh": 2.28,
    "Pd": 2.20,
    "Ag": 1.93,
    "Cd": 1.69,
    "In": 1.78,
    "Sn": 1.96,
    "Sb": 2.05,
    "Te": 2.1,
    "I": 2.66,
    "Cs": 0.79,
    "Ba": 0.89,
    "La": 1.10,
    "Ce": 1.12,
    "Pr": 1.13,
    "Nd": 1.14,
    "Sm": 1.17,
    "Gd": 1.20,
    "Dy": 1.22,
    "Ho": 1.23,
    "Er": 1.24,
    "Tm": 1.25,
    "Lu": 1.27,
    "Hf": 1.3,
    "Ta": 1.5,
    "W": 2.36,
    "Re": 1.9,
    "Os": 2.2,
    "Ir": 2.20,
    "Pt": 2.28,
    "Au": 2.54,
    "Hg": 2.00,
    "Tl": 1.62,
    "Pb": 2.33,
    "Bi": 2.02,
    "Po": 2.0,
    "At": 2.2,
    "Ra": 0.9,
    "Ac": 1.1,
    "Th": 1.3,
    "Pa": 1.5,
    "U": 1.38,
    "Np": 1.36,
    "Pu": 1.28,
}
# Static dipole polarisabilities (atomic units) of elements that linkers are made of.
POLARISABILITIES = {
    "H": 4.5,
    "B": 20.5,
    "C": 11.3,
    "N": 7.4,
    "O": 5.3,
    "F": 3.74,
    "Si": 37.3,
    "P": 25.0,
    "S": 19.4,
    "Cl": 14.6,
    "Se": 28.9,
    "Br": 21.0,
    "I": 32.9,
}

# Bond order 10 ** (a * distance + c) of a carbon with such a neighbour.
BOND_ORDER_A = {
    "H": -0.6093,
    "B": -2.2011,
    "C": -1.2685,
    "N": -1.2680,
    "O": -1.0525,
    "Cl": -0.7621,
    "Br": -0.8003,
}
BOND_ORDER_C = {
    "H": 0.5927,
    "B": 3.4380,
    "C": 1.8855,
    "N": 1.8401,
    "O": 1.5189,
    "Cl": 1.3723,
    "Br": 1.5272,
}

# What isn't a metal to solvent cleaning, and to the analysis of metal sites.
CLEANING_NON_METALS = frozenset(
    {
        "H", "He", "B", "C", "N", "O", "F", "Ne", "P", "S", "Cl", "Ar", "Se", "Br", "Kr", "I", "Xe", "Rn",
    }
)
SITE_NON_METALS = frozenset(
    {
        "H", "D", "B", "C", "N", "O", "F", "P", "S", "Cl", "Se", "Br", "I",
    }
)

# Metals by price, and abundance of rare earths in the crust (ppm).
EXPENSIVE_METALS = frozenset(
    {
        "Au", "Ag", "Dy", "Eu", "Ga", "Gd", "Hf", "In", "Ir", "La", "Mo", "Nd", "Pd", "Pr", "Pt", "Rh", "Ru", "Se", "Sm",
        "Tb", "Te", "Tm", "U", "Y",
    }
)
RARE_METALS_PPM = {
    "Sc": 22.0,
    "Y": 33.0,
    "La": 39.0,
    "Ce": 66.5,
    "Pr": 9.2,
    "Nd": 41.5,
    "Pm": 1e-14,
    "Sm": 7.05,
    "Eu": 2.0,
    "Gd": 6.2,
    "Tb": 1.2,
    "Dy": 5.2,
    "Ho": 1.3,
    "Er": 3.5,
    "Tm": 0.52,
    "Yb": 3.2,
    "Lu": 0.8,
}

# Formulas of ions that cleaning keeps, elements from A to Z; H3O is only reached where blanks are trimmed.
IONS = frozenset(
    {
        "Ag4I8", "AgC2N2", "AsF6", "AsHO4", "AuC2N2", "BF4", "Bi2I9", "Bi4I18", "Br", "C10H10N", "C10H10N2", "C12H14N2",
        "C2H10N2", "C2H3O2", "C2H5O", "C2H8N", "C2H8NO", "C3H10N", "C3H8N", "C4H10N", "C4H10NO", "C4H12N", "C4H16N3",
        "C5FeN6O", "C5H12N", "C5H14N", "C5H14N2", "C5H14NO", "C5H6N", "C5H7N2", "C6CrO12", "C6FeO12", "C6H11N2", "C6H14N",
        "C6H14N2", "C6H15N", "C6H16N", "C6H16N2", "C6H17N3", "C6H18N2", "C6H2O4S", "C6H2O5", "C6H4NO2", "C7H7O3S",
        "C8H20N", "C8H20N2", "C8H4O4", "C9H17N2", "C9H22P", "C9H3O6", "CF3O3S", "CH5N2", "CH6N", "CH6N3", "CH7N4", "CH7O",
        "CdCl4", "Cl", "Cl4Co", "ClO4", "CoH18N6", "CrO4", "F", "F6P", "F6Sb", "F6Si", "F6Ta", "F6Ti", "H12MnO6", "H2NO4",
        "H4N", "H4NO", "HO4S", "I", "I3", "Li", "Mo12O40P", "Mo8O26", "NO3", "Na", "O19W6", "O4Re", "O4S", "O4Se", "O4Tc",
    }
)
TRIMMED_IONS = IONS | {"H3O"}

HEAVY_RADIUS, HEAVY_TOLERANCE, TOLERANCE = 1.95, 0.2, 0.5


@cache
def cleaning_radii() -> dict[str, float]:
    return CLEANING_RADII


@cache
def site_radii() -> dict[str, float]:
    """D has the radius of H."""
    table = SITE_RADII
    return table | {"D": table["H"]}


@cache
def typed_radii() -> dict[str, float]:
    return TYPED_RADII


@cache
def atomic_numbers() -> dict[str, int]:
    return {s: z for z, s in enumerate(SYMBOLS, 1)} | {"D": 1}


def is_cleaning_metal(symbol: str) -> bool:
    return symbol in atomic_numbers() and symbol not in CLEANING_NON_METALS


def is_site_metal(symbol: str) -> bool:
    return symbol not in SITE_NON_METALS


def bond_tolerance(a: str, b: str) -> float:
    radii = site_radii()
    return HEAVY_TOLERANCE if max(radii[a], radii[b]) > HEAVY_RADIUS else TOLERANCE


def bonded(a: str, b: str, distance: float) -> bool:
    """Whether two sites bond at a distance: closer than their radii and the tolerance."""
    return distance < site_radii()[a] + site_radii()[b] + bond_tolerance(a, b)


def group_and_block(z: int) -> tuple[int | None, str]:
    """Group (none for the f block) and block of an element, from its place in the periodic table."""
    if z in (1, 2):
        return (1, "s") if z == 1 else (18, "s")
    for start, end in ((3, 10), (11, 18)):
        if start <= z <= end:
            k = z - start
            return (k + 1, "s") if k < 2 else (k + 11, "p")
    for start, end in ((19, 36), (37, 54)):
        if start <= z <= end:
            k = z - start
            return k + 1, "s" if k < 2 else "d" if k < 12 else "p"
    start = 55 if z <= 86 else 87
    k = z - start
    if k < 2:
        return k + 1, "s"
    if k < 16:
        return None, "f"
    return k - 13, "d" if k < 26 else "p"


def valence_electrons(symbol: str) -> int:
    """s and d: the group; p: the group less 10; f: 3 for the first of the row, then one more each; noble gases 8, He 2."""
    z = atomic_numbers()[symbol]
    group, block = group_and_block(z)
    if symbol == "He":
        return 2
    if group == 18:
        return 8
    if block == "f":
        return z - (57 if z < 80 else 89) + 3
    return group - 10 if block == "p" else group


SCHEMA = (
    "z int, symbol string, mass double, r_csd double, r_site double, r_typed double, is_metal_curation boolean, is_metal_site boolean, is_lanthanide boolean, is_actinide boolean, "
    "is_heavy boolean, block string, grp int, valence int, bo_a double, bo_c double, is_expensive boolean, abundance_ppm double"
)


def element_rows() -> list[tuple]:
    masses, a, c, ppm = MASSES, BOND_ORDER_A, BOND_ORDER_C, RARE_METALS_PPM
    rows = []
    for z, s in enumerate(SYMBOLS, 1):
        group, block = group_and_block(z)
        site = site_radii().get(s)
        rows.append(
            (z, s, masses[s], cleaning_radii()[s], site, typed_radii().get(s), is_cleaning_metal(s), is_site_metal(s), 56 < z < 72, 88 < z < 97, site is not None and site > HEAVY_RADIUS, block, group, valence_electrons(s), a.get(s), c.get(s), s in EXPENSIVE_METALS, ppm.get(s))
        )
    return rows


def elements(spark: SparkSession) -> DataFrame:
    """The element dimension: 110 rows, so broadcast by any join with it."""
    return spark.createDataFrame(element_rows(), SCHEMA)
