"""Free-text survey answers: countries, schools, institutions and years."""

from pyspark.sql import Column, functions as F

# Country spellings.
CZECH = ["CZ", "Czechia", "Czech Republic"]
BRITISH = ["UK", "UNITED KINGDOM"]
# School of the first-listed country.
SCHOOL_COUNTRIES = {
    "UK": ["uk", "united kingdom"],
    "CZ": ["cz", "czechia", "czech republic"],
    "DE-speak": ["germany", "switzerland", "austria"],
}
SCHOOLS = ["UK", "CZ", "DE-speak", "Other"]
# Substrings that mark a university.
UNIVERSITY_MARKERS = [
    "university", "tum", "tu dresden", "ensg", "charles", "leeds", "chicago", "oregon", "east anglia", "edinburgh",
    "manchester", "cambridge", "bournemouth", "westminster", "munich", "open university", "heriot", "ucla", "ghana",
    "wien", "tu ",
]
# Number words, looked for in this order.
YEAR_WORDS = [
    (["a year", "one year"], 1.0), (["two"], 2.0), (["three"], 3.0), (["four"], 4.0), (["five"], 5.0),
    (["six"], 6.0), (["seven"], 7.0), (["eight"], 8.0), (["nine"], 9.0), (["ten"], 10.0),
]


def country_name(raw: Column) -> Column:
    c = F.trim(raw)
    return (F.when(c.isNull(), "Unknown")
            .when(c.isin(CZECH), "Czechia")
            .when(F.upper(c).isin(BRITISH), "United Kingdom")
            .when(c.contains("United Kingdom") & c.contains(","), "Multi-UK")
            .when(F.upper(c) == "USA", "USA")
            .when(F.upper(c) == "FRANCE", "France")
            .otherwise(c))


def country_display(raw: Column) -> Column:
    c = F.trim(raw)
    return F.when(F.upper(c) == "UK", "UK").when(c.isin(CZECH), "Czechia").otherwise(c)


def school(raw: Column) -> Column:
    """School of the country listed first, before any comma or slash."""
    first = F.lower(F.trim(F.element_at(F.split(F.trim(raw), "[,/]"), 1)))
    expr = F.when(first.isNull(), "Other")
    for name, countries in SCHOOL_COUNTRIES.items():
        expr = expr.when(first.isin(countries), name)
    return expr.otherwise("Other")


def institution_class(raw: Column) -> Column:
    low = F.lower(raw)
    return (F.when(low.isNull(), "Not provided")
            .when(low.contains("leibniz") & ~low.contains("university"), "Research institute")
            .when(low.rlike("|".join(UNIVERSITY_MARKERS)), "University / higher education")
            .otherwise("Other"))


def parse_years(raw: Column) -> Column:
    """Number words first, in their order, then the first number; NULL if there is neither."""
    low = F.lower(F.trim(raw))
    expr = F.when(low.isNull(), F.lit(None).cast("double"))
    for words, value in YEAR_WORDS:
        expr = expr.when(low.rlike("|".join(words)), value)
    return expr.otherwise(F.nullif(F.regexp_extract(low, r"(\d+(\.\d+)?)", 1), F.lit("")).cast("double"))
