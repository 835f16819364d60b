"""Text normalisation of offers: names, packs, brands, codes, links."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Latin spelling of Cyrillic letters.
CYRILLIC = {
    "а": "a", "б": "b", "в": "v", "г": "g", "д": "d", "е": "e", "ж": "zh", "з": "z", "и": "i", "й": "y",
    "к": "k", "л": "l", "м": "m", "н": "n", "о": "o", "п": "p", "р": "r", "с": "s", "т": "t", "у": "u",
    "ф": "f", "х": "h", "ц": "ts", "ч": "ch", "ш": "sh", "щ": "sht", "ъ": "a", "ь": "y", "ю": "yu", "я": "ya",
}
#: Brand spellings and their canonical names.
BRAND_ALIASES = {
    "nestle": "Nestlé", "nestlé": "Nestlé", "нестле": "Nestlé", "kaufland": "Kaufland", "billa": "Billa", "lidl": "Lidl",
    "milka": "Milka", "ariel": "Ariel", "nivea": "NIVEA", "pampers": "Pampers", "coca-cola": "Coca-Cola", "pepsi": "Pepsi",
    "lay's": "Lay's", "lays": "Lay's", "pringles": "Pringles", "felix": "Felix", "whiskas": "Whiskas", "activia": "Activia",
    "danone": "Danone", "president": "Président",
}


def collapse(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


@F.pandas_udf(T.StringType())
def decomposed(c: pd.Series) -> pd.Series:
    """Compatibility decomposition (NFKD), which Spark has no function for."""
    return c.map(lambda x: unicodedata.normalize("NFKD", x), na_action="ignore")


def normalise_name(c: Column) -> Column:
    """Decomposed, lower case, punctuation and marks dropped, white space collapsed."""
    return collapse(F.regexp_replace(F.lower(decomposed(c)), r"(?U)[^\p{L}\p{N}_\s]", ""))


def normalise_title(c: Column) -> Column:
    """As ``normalise_name``, but punctuation becomes a space."""
    return collapse(F.regexp_replace(F.lower(c), r"(?U)[^\w\s]", " "))


def normalise_pack(c: Column) -> Column:
    """Lower case, decimal comma to point, white space collapsed; empty to null."""
    return F.nullif(collapse(F.regexp_replace(F.lower(F.trim(c)), r"(\d),(\d)", "$1.$2")), F.lit(""))


def brand_key(c: Column) -> Column:
    """What brands are compared by; empty to null."""
    return F.nullif(F.lower(F.trim(c)), F.lit(""))


def canonical_brand(c: Column) -> Column:
    """The canonical name of a known spelling; any other brand as it is."""
    known = F.create_map(*[F.lit(x) for pair in BRAND_ALIASES.items() for x in pair])
    return F.coalesce(F.try_element_at(known, F.lower(F.trim(c))), c)


def name_slug(c: Column) -> Column:
    """Latin slug of a name: letters and digits, hyphens between; `product` if nothing is left."""
    out = F.lower(c)
    for cyr, lat in CYRILLIC.items():
        if len(lat) > 1:
            out = F.replace(out, F.lit(cyr), F.lit(lat))
    single = {k: v for k, v in CYRILLIC.items() if len(v) == 1}
    out = F.translate(out, "".join(single), "".join(single.values()))
    out = F.regexp_replace(F.regexp_replace(out, r"(?U)[^\p{L}\p{N}]+", "-"), "^-+|-+$", "")
    return F.coalesce(F.nullif(out, F.lit("")), F.lit("product"))


def currency_code(c: Column) -> Column:
    """Legacy codes and an empty code are EUR, others upper case."""
    up = F.upper(c)
    return F.when(up.isin("ЛВ", "LV", "BGN", "ЛВ.") | (F.coalesce(c, F.lit("")) == ""), "EUR").otherwise(up)


def source_code(c: Column) -> Column:
    return F.when(c == "brochure", "brochure").otherwise("web")


def article_id(c: Column) -> Column:
    """Article id in a product link, or null."""
    return F.nullif(F.regexp_extract(c, r"/(BTY-[A-Z0-9]+)/", 1), F.lit(""))


def larger_image(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(c, r"w=\d+", "w=400"), r"h=\d+", "h=400")


def next_section(c: Column) -> Column:
    """The link with the number after the first `/ar/` raised by one, or null."""
    part = lambda k: F.regexp_extract(c, r"^(.*?/ar/)(\d+)(.*)$", k)
    return F.when(c.rlike(r"^.*?/ar/\d+"), F.concat(part(1), (part(2).cast("long") + 1).cast("string"), part(3)))


def pack_label(pack: Column, kind: Column) -> Column:
    return F.trim(F.concat_ws(" ", pack, kind))
